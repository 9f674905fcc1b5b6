"""Trie BPE against the library's own encoding and decoding."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paysift.llm import trie_bpe
from paysift.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  a", "a  ", "a \n b", "x<|endoftext|>y <|endoftext|><|endoftext|> z", "a" * 700, "\u3000 x\u00a0 y\u0085 z",
       "don't I'll we've 'sss", "\u65e5\u672c\u8a9e \U0001f600\U0001f44d\U0001f3fd a\u0301", "\x00\x01 \x1c b", "-" * 500, "\u0558a \u0558b"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_odd_texts_nulls_and_clashing_names(spark, library):
    rows = [(i, t, "mine", i) for i, t in enumerate(ODD)] + [(3, ODD[3], "mine", 3), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n long")
    out = trie_bpe.decode(trie_bpe.encode(docs, PATH), PATH)
    assert sorted(out.columns) == ["decoded", "doc_id", "ids", "n", "text"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.ids, r.decoded) == expected(library, r.text)
    assert trie_bpe.decode(trie_bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_decode_of_any_ids(spark, library):
    some = spark.createDataFrame([([50256, 0, 50255],), ([],), (None,), ([447],), ([None, -1, 10 ** 6, 5],)], "ids array<int>")
    got = [r.decoded for r in trie_bpe.decode(some, PATH).collect()]
    assert got == [library.decode([50256, 0, 50255], skip_special_tokens=False), "", "", library.decode([447]), library.decode([5])]


def test_random_texts_equal_the_library(library):
    model = trie_bpe.Vocabulary(PATH)
    r = random.Random(7)
    parts = [" ", "  ", "\n", "\t", " the", "e", "th", "ing", "er", "0", "12", "'", "s", "ll", "\u00e9", "\u00df", "\u2026", "--", "=", "<|endoftext|>", "\u0436", "\u4e2d", "\U0001f600", ","]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 60))) for _ in range(2000)]
    texts += [bytes(r.choices(range(128), k=40)).decode() for _ in range(2000)]
    texts += ["".join(map(chr, r.choices(range(1, 0x500), k=30))) for _ in range(2000)]
    for text, got in zip(texts, model.encode_texts(texts), strict=True):
        assert memoryview(got).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_walked_at_once_share_their_prefixes(library):
    model = trie_bpe.Vocabulary(PATH)
    r = random.Random(3)
    words = sorted({bytes(r.choices(b"abel ing", k=r.randint(1, 9))).replace(b" ", b"") or b"a" for _ in range(3000)})
    for w, ids in zip(words, model.walk(words), strict=True):
        assert ids == library.encode(w.decode(), add_special_tokens=False).ids


def test_small_memory_and_long_texts(spark, library, monkeypatch):
    for name, value in (("MEMORY", 20), ("PART", 100), ("LONGEST", 6), ("PAIRS", 50)):
        monkeypatch.setattr(trie_bpe, name, value)
    model = trie_bpe.Vocabulary(PATH)
    long = " ".join(f"word{i % 37} <|endoftext|> x{i}  y\n" for i in range(300))
    assert len(trie_bpe.slices(long, model.added)) > 20
    assert "".join(trie_bpe.slices(long, model.added)) == long
    got = b"".join(model.encode_texts([s])[0] for s in trie_bpe.slices(long, model.added))
    assert memoryview(got).cast("i").tolist() == library.encode(long, add_special_tokens=False).ids


def test_text_over_a_part(spark, library):
    text = "".join(f"word{i % 1000}, " for i in range(300_000))
    assert len(text) > 2 * trie_bpe.PART
    row = trie_bpe.decode(trie_bpe.encode(spark.createDataFrame([(text,)], "text string"), PATH), PATH).first()
    assert (row.ids, row.decoded) == expected(library, text)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        trie_bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids, text = expected(library, r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_trie_bpe"](spark, sf).collect()}
    assert got == want


def test_memory_is_bounded_and_what_is_in_use_stays(library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "MEMORY", 300)
    model = trie_bpe.Vocabulary(PATH)
    walked, walk = [], model.walk
    model.walk = lambda words: walked.extend(words) or walk(words)
    for k in range(40):
        text = " always here" + "".join(f" w{k}x{i}" for i in range(50))
        assert memoryview(model.encode_texts([text])[0]).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids
        assert max(len(model.of_pieces), len(model.of_words)) <= 300 + 60
    assert walked.count(b" always") == 1  # before, all was forgotten at once


def test_decoding_reads_no_merges(library, monkeypatch):
    """A worker that decodes holds the bytes of the tokens alone."""
    import pyarrow as pa
    monkeypatch.setattr(trie_bpe, "_with", lambda df, name, kind, source, make: make)
    monkeypatch.setattr(trie_bpe, "vocabulary", None)
    ids = library.encode("some text, <|endoftext|> more", add_special_tokens=False).ids
    made = list(trie_bpe.decode(None, PATH)(pa.array([ids, None], pa.list_(pa.int32()))))
    assert [t for _, _, texts in made for t in texts.to_pylist()] == ["some text, <|endoftext|> more", ""]
    assert sum(x.nbytes for x in trie_bpe.token_bytes(PATH)) < 2_000_000


def test_a_batch_is_held_a_group_at_a_time(library, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(trie_bpe, "PART", 10)
    column = pa.array(["é" * 4, None, "abc", "", "x" * 30, "y"])
    assert list(trie_bpe._groups(column)) == [(0, 3), (3, 5), (5, 6)]
    assert list(trie_bpe._groups(column.slice(2))) == [(0, 3), (3, 4)]


def test_batches_are_bounded_by_bytes(spark):
    """Rows that are long together come in several batches, to encoding and to decoding."""
    import pyarrow as pa
    docs = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("some words "), 20_000).alias("text"))  # 13 MB

    def size(column):
        yield 0, len(column), pa.array([column.nbytes] * len(column), pa.int64())

    got = trie_bpe._with(docs, "size", "long", "text", size).collect()
    assert len(got) == 60 and max(r["size"] for r in got) < 2 * trie_bpe.BATCH
    ids = docs.select("id", F.array_repeat(F.lit(7), 60_000).alias("ids"))
    got = trie_bpe._with(ids, "size", "long", "ids", size).collect()
    assert len(got) == 60 and max(r["size"] for r in got) < 2 * trie_bpe.BATCH


def test_words_of_a_large_vocabulary_are_walked_once(library):
    """A worker meets some hundred thousand different words; they are remembered."""
    model = trie_bpe.Vocabulary(PATH)
    texts = [" ".join(f"{i}" for i in range(k, k + 1000)) for k in range(0, 250_000, 1000)]
    for text in texts:
        model.encode_texts([text])
    walked, walk = [], model.walk
    model.walk = lambda words: walked.extend(words) or walk(words)
    again = [model.encode_texts([text])[0] for text in texts]
    assert not walked
    for text, got in zip(texts[::50], again[::50], strict=True):
        assert memoryview(got).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids


def test_endings_of_words_before_a_stop(library):
    model = trie_bpe.Vocabulary(PATH)
    texts = ["a.", " a,", " don't; stop!", "é:", " é?", ".", " .", " ж.", "the 's. x's, 'll!", "1. 2, a1;", "a.\nb", "퟿."]
    for text, got in zip(texts, model.encode_texts(texts), strict=True):
        assert memoryview(got).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids
