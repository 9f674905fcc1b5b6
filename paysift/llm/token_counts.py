"""Token counts without token ids (operator 7).

Each distinct pre-token is encoded once; a document's count is the sum over
its pre-tokens of frequency x pieces.  The pre-tokens are cut where the
vocabulary can never merge: before a run of word marks (no piece has a mark
after another character) and around a newline (no piece holds one), so the sum
equals the count of the whole text.

Plan: (1) one pass counts pre-tokens over all documents (partial sums in the
tasks, then a shuffle on the pre-token); each is encoded once and the table is
written.  (2) the ``hot`` most frequent pre-tokens of at most ``SHORT`` bytes, so a
bounded table, are broadcast and summed in the second pass over the documents; only the rarer
or longer ones leave it as (row, pre-token, frequency) and are joined to the table by
shuffle.  A frequent long pre-token is a hot key of that join, whose rows (one per
document that has it) AQE splits.

Nulls and empty texts have no tokens.  Rows that repeat an id, or a whole row,
are counted each on their own.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, save

#: Pre-tokens of a normalised text (a space is written as the mark).
MARK = "▁"
PRE_TOKEN = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Distinct pre-tokens a task holds before it passes its partial counts on.
FLUSH = 200_000
#: Bytes of the longest pre-token that is broadcast.
SHORT = 64


def check_vocabulary(processor) -> None:
    """Raises where the cuts of PRE_TOKEN would not be exact."""
    model = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", p) for p in model):
        raise ValueError("this vocabulary merges across pre-tokens")


def pre_tokens(text: str | None) -> list[str]:
    return PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def pieces_of(processor, tokens: list[str]) -> list[int]:
    """Piece counts of pre-tokens; the library adds a mark before each text,
    so that is taken off first, or a newline (2 pieces) is put before."""
    texts = [t[1:] if t[0] == MARK else "\n" + t for t in tokens]
    counts = [len(x) for x in processor.encode(texts, num_threads=1)]
    return [1 if t == MARK else n if t[0] == MARK else n - 2 for t, n in zip(tokens, counts, strict=True)]


def piece_table(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """(pre_token, total, pieces) of all distinct pre-tokens, written."""
    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(pre_tokens(text.as_py()))
                if len(seen) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pre_token", "n"])
                    seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["pre_token", "n"])

    def encode(batches):
        import sentencepiece
        processor = sentencepiece.SentencePieceProcessor(model_file=model_path)
        check_vocabulary(processor)
        for batch in batches:
            n = pieces_of(processor, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["pre_token", "total", "pieces"])

    counts = (docs.select(F.col(text_col).alias("text")).mapInArrow(count, "pre_token string, n long")
              .groupBy("pre_token").agg(F.sum("n").alias("total")))
    return save(counts.mapInArrow(encode, "pre_token string, total long, pieces long"), "pieces")


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 hot: int = 500_000) -> DataFrame:
    """(id, n_bytes, n_tokens) per row.  ``hot``: at most so many of the
    most frequent short pre-tokens are broadcast (any value gives the same counts)."""
    spark = prepare(docs.sparkSession)
    table = piece_table(docs, model_path, text_col)
    # The least frequency to broadcast, from counts by eighths of an octave (a
    # few hundred rows), so that no task sorts them all.
    octave = F.floor(F.log2("total") * 8)
    level, taken = float("inf"), 0
    short = table.where(F.octet_length("pre_token") <= SHORT)
    for r in short.groupBy(octave.alias("o")).count().orderBy(F.desc("o")).collect():
        if taken + r["count"] > hot:
            break
        level, taken = r["o"], taken + r["count"]
    top = short.where(octave >= F.lit(level)).select("pre_token", "pieces").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def scan(batches):
        pieces = known.value
        for batch in batches:
            rows, sums, rest_row, rest, rest_n = [], [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                total = 0
                for t, n in Counter(pre_tokens(text.as_py())).items():
                    p = pieces.get(t)
                    if p is None:
                        rest_row.append(row)
                        rest.append(t)
                        rest_n.append(n)
                    else:
                        total += n * p
                rows.append(row)
                sums.append(total)
            k = len(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows + rest_row, pa.int64()),
                pa.concat_arrays([batch.column(1), pa.nulls(len(rest), batch.column(1).type)]),
                pa.concat_arrays([batch.column(3), pa.nulls(len(rest), pa.int64())]),
                pa.array(sums + rest_n, pa.int64()), pa.array([None] * k + rest, pa.string())],
                ["_row", id_col, "n_bytes", "n", "pre_token"])

    kind = docs.schema[id_col].dataType.simpleString()
    scanned = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.col(text_col).alias("_text"),
                          F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
                          ).mapInArrow(scan, f"_row long, `{id_col}` {kind}, n_bytes long, n long, pre_token string")
    # One written table for both branches: rows and their rarer pre-tokens.
    scanned = save(scanned, "token_scan")
    heads = scanned.where("pre_token is null").drop("pre_token")
    tails = (scanned.where("pre_token is not null").select("_row", "pre_token", "n").join(table.select("pre_token", "pieces"), "pre_token")
             .groupBy("_row").agg(F.sum(F.col("n") * F.col("pieces")).alias("_rest")))
    return (heads.join(tails, "_row", "left")
            .select(id_col, "n_bytes", (F.col("n") + F.coalesce("_rest", F.lit(0))).alias("n_tokens")))
