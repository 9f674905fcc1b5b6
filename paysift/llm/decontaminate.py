"""Benchmark decontamination by winnowing (operator 4).

Both sides keep, of every ``WINDOW - GRAM + 1`` consecutive 5-grams, the one of
least hash.  Which one that is depends on the words of the window alone, so a
window of 10 words that occurs in a document and in an item leaves the same
fingerprint at the same place on both sides: every shared span of 10 words or
more is found.  Fingerprints are joined by hash and each hit is extended over
the words around it, compared as strings; only whole windows count.

An item of fewer than 10 words is one window; for each such length there is,
documents' n-grams of that length are looked up too (at most 9 lengths).

Scale: a document's fingerprints leave the scan only if a bit filter of the
benchmark's may hold them.  The filter's size is fixed; when it is full, more
rows are shuffled and the result stays.  Items meet documents as distinct
windows: a fingerprint and the words around it are one row, however many items
have them, and one row of a document, with the list of its places.  So a word
that is an item by itself, many times, costs one comparison a document; which
items a window belongs to is joined to what was found.  Rows of one join key
(a passage that many documents hold) are dealt over ``SALTS`` tasks, to each of
which the distinct windows of the benchmark go.

Null and empty texts have no words; items without words are never found.
Repeated documents get a row each; repeated item ids count once.  A null item
id counts as the empty string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (ALNUM_MASK, bit_filter, gram_hash, in_filter, mix, prepare, row_counts, save, segments, signed, stored,
                     text_buffers, window_argmin, words)

GRAM, WINDOW = 5, 10
#: A key's document rows are dealt over so many tasks.
SALTS = 16
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))


def fingerprints(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the kept 5-grams of rows' words (row: sorted)."""
    grams = gram_hash(h, GRAM)
    best = window_argmin(grams, WINDOW - GRAM + 1)
    places = np.unique(best[row[:len(best)] == row[WINDOW - 1:]]) if len(best) else best
    return places, grams[places]


def short_grams(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all n-grams inside rows, apart from the 5-grams'."""
    grams = gram_hash(h, n)
    places = np.flatnonzero(row[:len(grams)] == row[n - 1:]) if len(grams) else np.zeros(0, np.int64)
    return places, mix(grams[places] + np.uint64(n))


def _around(raw, row, s, e, places, before: int, after: int):
    """Lower-case words places - before .. places + after of the same row, and
    each place's index among them."""
    out, index = [], []
    for p in places.tolist():
        lo, hi = p, p
        while lo > 0 and p - lo < before and row[lo - 1] == row[p]:
            lo -= 1
        while hi < len(row) and hi < p + after and row[hi] == row[p]:
            hi += 1
        out.append([raw[s[i]:e[i]].tobytes().translate(_LOWER).decode() for i in range(lo, hi)])
        index.append(p - lo)
    return out, index


_ITEM = "h long, item string, shape int, words array<string>, at int"


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(distinct windows: win, h, shape, words, at), (members: win, item); ``win``
    is the SHA-256 of the window's words and the fingerprint's place in them."""
    def scan(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            out = []
            for lo, hi in segments(offsets):
                row, s, e, h = words(raw, offsets, lo, hi, ALNUM_MASK, fold=True)
                counts = row_counts(row, lo, hi)
                long = counts[row - lo] >= WINDOW
                places, grams = fingerprints(row, h)
                keep = long[places] if len(places) else np.zeros(0, bool)
                found = [(places[keep], grams[keep], 0)]
                for n in np.unique(counts[(counts > 0) & (counts < WINDOW)]).tolist():
                    p, g = short_grams(row, h, n)
                    whole = counts[row[p] - lo] == n
                    found.append((p[whole], g[whole], n))
                for p, g, n in found:
                    text, at = _around(raw, row, s, e, p, GRAM if n == 0 else 0, WINDOW if n == 0 else n)
                    for i, x in enumerate(p.tolist()):
                        out.append((int(signed(g[i:i + 1])[0]), batch.column(0)[int(row[x])].as_py(), n, text[i], at[i]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32()], strict=True)],
                                             ["h", "item", "shape", "words", "at"])

    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    win = F.unhex(F.sha2(F.concat_ws(" ", F.col("shape").cast("string"), F.col("at").cast("string"), F.concat_ws(" ", "words")), 256)).alias("win")
    found = save(items.mapInArrow(scan, _ITEM).select(win, "*"), "item_fingerprints")
    distinct = found.groupBy("win").agg(*[F.first(c).alias(c) for c in ("h", "shape", "words", "at")])
    return save(distinct, "item_windows"), found.select("win", "item").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text", filter_bits: int = 1 << 24,
         row_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: _row, id, n_words), (spans: _row, win, start, end of the words
    inside occurrences of a distinct window; those that touch are one),
    (members: win, item).  ``_row`` is ``row_col``, or numbers of this one read."""
    spark = prepare(docs.sparkSession)
    windows, members = item_windows(benchmark, item_id, item_text)
    lengths = [r["shape"] for r in windows.where("shape > 0").select("shape").distinct().collect()]  # 9 at most
    known = bit_filter(windows.select("h").distinct(), filter_bits)

    def scan(batches):
        bitmap = known.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            ids, n_words = batch.column(0).to_numpy(), []
            grams: dict[tuple, list[int]] = {}  # (row, shape, hash, words, at): places
            for lo, hi in segments(offsets):
                row, s, e, h = words(raw, offsets, lo, hi, ALNUM_MASK, fold=True)
                counts = row_counts(row, lo, hi)
                n_words.append(counts)
                starts = np.cumsum(counts) - counts
                for n, (p, g) in [(0, fingerprints(row, h)), *((n, short_grams(row, h, n)) for n in lengths)]:
                    keep = in_filter(bitmap, g)
                    p, g = p[keep], g[keep]
                    text, at = _around(raw, row, s, e, p, GRAM if n == 0 else 0, WINDOW if n == 0 else n)
                    for r, key, w, a, place in zip(row[p].tolist(), signed(g).tolist(), text, at, (p - starts[row[p] - lo]).tolist(), strict=True):
                        grams.setdefault((r, n, key, tuple(w), a), []).append(place)
            k, j = len(ids), len(grams)
            hit, shape, keys, text, at = zip(*grams, strict=True) if grams else ((),) * 5
            after = lambda values, kind: pa.concat_arrays([pa.nulls(k, kind), pa.array(values, kind)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([ids, ids[np.array(hit, np.int64)]])), pa.concat_arrays([batch.column(1), pa.nulls(j, batch.column(1).type)]),
                pa.concat_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *n_words])), pa.nulls(j, pa.int64())]),
                after(list(grams.values()), pa.list_(pa.int32())), after(shape, pa.int32()), after(keys, pa.int64()),
                after([list(w) for w in text], pa.list_(pa.string())), after(at, pa.int32())],
                ["_row", id_col, "n_words", "places", "shape", "h", "words", "at"])

    def extend(batches):
        for batch in batches:
            out = []
            for r, places, n, w, a, win, iw, ia in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                left, right = 0, n
                if n and w != iw or not n and w[a:a + GRAM] != iw[ia:ia + GRAM]:
                    continue
                if not n:
                    while left < min(a, ia) and w[a - left - 1] == iw[ia - left - 1]:
                        left += 1
                    while right < min(len(w) - a, len(iw) - ia) and w[a + right] == iw[ia + right]:
                        right += 1
                    if left + right < WINDOW:
                        continue
                start = end = places[0] - left
                for p in places:  # ascending
                    if p - left > end:
                        out.append((r, win, start, end))
                        start = p - left
                    end = p + right
                out.append((r, win, start, end))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.binary(), pa.int64(), pa.int64()], strict=True)], ["_row", "win", "start", "end"])

    kind = docs.schema[id_col].dataType.simpleString()
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    scanned = save(docs.select(number.alias("_row"), F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(
        scan, f"_row long, `{id_col}` {kind}, n_words long, places array<int>, shape int, h long, words array<string>, at int"), "document_fingerprints")
    dealt = windows.select("win", "h", "shape", F.col("words").alias("iw"), F.col("at").alias("ia"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    found = scanned.where("h is not null").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(dealt, ["h", "shape", "_salt"])
    spans = found.select("_row", "places", "shape", "words", "at", "win", "iw", "ia").mapInArrow(extend, "_row long, win binary, start long, end long")
    return scanned.where("h is null").select("_row", id_col, "n_words"), spans, members


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(_row, id, n_words, n_hit, items: sorted array of item ids)."""
    heads, spans, members = hits(docs, benchmark, id_col, text_col, **kw)
    spans = save(spans, "contaminated_spans")
    earlier = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(earlier), F.lit(0))))
    covered = (spans.select("_row", "start", "end").distinct().withColumn("_new", new)
               .groupBy("_row").agg(F.sum("_new").alias("n_hit")))
    items = spans.select("_row", "win").distinct().join(members, "win").select("_row", "item").distinct().groupBy("_row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return (heads.join(covered, "_row", "left").join(items, "_row", "left")
            .select("_row", id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark."""
    rows, name = stored(docs)
    _, spans, _ = hits(rows, benchmark, id_col, text_col, row_col=name)
    bad = save(spans.select("_row").distinct(), "contaminated_rows")
    return rows.join(bad.withColumnRenamed("_row", name), name, "left_anti").select(*docs.columns)
