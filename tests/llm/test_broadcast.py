"""What op7 broadcasts is bounded in bytes."""

import public_tokenizers

from paysift.llm.token_counts import SHORT, token_counts


def test_long_pre_tokens_are_joined(spark, monkeypatch):
    import sentencepiece
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, "ab " * i + "x" * (SHORT + i) + "\n" + "é" * 100) for i in range(9)]
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v, real=type(spark.sparkContext).broadcast: sent.append(v) or real(self, v))
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    m = sentencepiece.SentencePieceProcessor(model_file=model)
    assert got == {i: len(m.encode(t)) for i, t in rows}
    assert sent and all(len(k.encode()) <= SHORT for d in sent if isinstance(d, dict) for k in d)
