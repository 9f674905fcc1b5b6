"""Importance resampling towards a target distribution (operator 12).

Features are runs of ``low`` to ``high`` consecutive words, hashed into
``buckets``; a bucket's gain is the log ratio of its smoothed shares in the
target and in the documents, and a document's weight the mean gain of its
features.  Weights plus Gumbel noise of the id draw without replacement in
proportion to the weights.

1. One pass counts buckets over all documents, one over the target: each task
   sends at most ``buckets`` sums.  The gains, ``buckets`` longs, are broadcast.
2. A second pass over the documents gives each row its weight; the narrow table
   is written once.
3. Rows per score are counted (noise and gains are bounded, so there are at most
   some 150,000 scores, however many rows), which gives the score of the last
   row drawn.  Only rows from that score on are sorted, by ranges of (score, id,
   row), and ranked by their place in a range and the ranges' counts.

In a task, n-grams are interned per stretch of at most SEGMENT bytes (a longer
text is taken in stretches that overlap by ``high`` - 1 words) in an
open-addressed NumPy table: keys are xxhash64, equal keys are verified on their
bytes, slots hold a bucket and a count.  Each distinct n-gram's bucket is
computed once, and the slot ids of the occurrences gather the gains.

Null and empty texts, and those without words, have no features and weight 0.
A null id draws as the empty string and comes last among equal scores.  Rows
that repeat an id are rows of their own with the same noise; which of two such
rows with one score comes first is their order in the written table.  An empty
target or no documents give gains and ranks by the same formulas.  Carried
columns that have the name of a result are replaced by it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_MASK, SEGMENT, lanes, prepare, same_bytes, save, segments, text_buffers

_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]  # xxHash's fixed primes
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
RESULT = ["n_features", "n_words", "weight", "score", "rank"]


def _rotl(x, n: int):
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxhash64(buf: np.ndarray, word: np.ndarray, s: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of the byte strings buf[s:s + size]; ``word``: lanes.
    Those under 32 bytes are hashed together, length by length."""
    out = np.empty(len(s), np.uint64)
    order = np.argsort(size, kind="stable")
    sizes, first = np.unique(size[order], return_index=True)
    for n, a, b in zip(sizes.tolist(), first.tolist(), np.append(first, len(order))[1:].tolist(), strict=True):
        at = order[a:b]
        if n > 31:
            out[at] = [xxhash.xxh64_intdigest(buf[i:i + n].tobytes()) for i in s[at].tolist()]
            continue
        p, h, j = s[at], np.full(len(at), _P[4] + np.uint64(n), np.uint64), 0
        while j + 8 <= n:
            h = _rotl(h ^ (_rotl(word[p + j] * _P[1], 31) * _P[0]), 27) * _P[0] + _P[3]
            j += 8
        if j + 4 <= n:
            h = _rotl(h ^ ((word[p + j] & np.uint64(0xFFFFFFFF)) * _P[0]), 23) * _P[1] + _P[2]
            j += 4
        while j < n:
            h = _rotl(h ^ (buf[p + j].astype(np.uint64) * _P[4]), 11) * _P[0]
            j += 1
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
        out[at] = h ^ (h >> np.uint64(32))
    return out


class Table:
    """Open-addressed table of the byte strings buf[s:s + size]; ``slot``: the
    slot of each occurrence, ``bucket`` and ``count``: of each slot."""

    def __init__(self, buf: np.ndarray, s: np.ndarray, size: np.ndarray, buckets: int, hashes=xxhash64):
        word = lanes(buf)
        key = hashes(buf, word, s, size)
        room = 1 << max(4, (2 * len(s)).bit_length())
        mask = np.uint64(room - 1)
        holder = np.full(room, -1, np.int64)  # the occurrence that a slot was made for
        self.slot = (key & mask).astype(np.int64)
        todo = np.arange(len(s))
        while len(todo):
            at = self.slot[todo]
            free = holder[at] < 0
            holder[at[free]] = todo[free]  # one of those that want it
            who = holder[at]
            same = (key[who] == key[todo]) & (size[who] == size[todo])
            check = np.flatnonzero(same & (who != todo))
            same[check] = same_bytes(word, s[who[check]], s[todo[check]], size[todo[check]])
            todo = todo[~same]
            self.slot[todo] = (self.slot[todo] + 1) & (room - 1)
        self.count = np.bincount(self.slot, minlength=room)
        self.bucket = np.zeros(room, np.int64)
        used = np.flatnonzero(holder >= 0)
        data = memoryview(buf)
        a = s[holder[used]]
        self.bucket[used] = [zlib.crc32(data[i:j]) % buckets for i, j in zip(a.tolist(), (a + size[holder[used]]).tolist(), strict=True)]


def stretches(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, first byte, last byte + 1): rows of at most
    SEGMENT bytes together, or a part of a longer row, cut where no word is."""
    for lo, hi in segments(offsets):
        a, end = int(offsets[lo]), int(offsets[hi])
        while hi - lo == 1 and end - a > SEGMENT:
            b = a + SEGMENT
            gap = np.flatnonzero(~ALNUM_MASK[raw[a:b]])
            while not len(gap) and b < end:
                gap = np.flatnonzero(~ALNUM_MASK[raw[b:b + SEGMENT]]) + (b - a)
                b += SEGMENT
            if not len(gap):
                break
            b = a + int(gap[-1]) + 1
            yield lo, hi, a, b
            a = b
        yield lo, hi, a, end


def _features(raw, offsets, lo: int, hi: int, a: int, b: int, carry: bytes, low: int, high: int):
    """Words of raw[a:b] after those of ``carry`` (of the same row), joined by
    one space: (buffer, row, start and size of each n-gram, words per row, last words)."""
    text = _FOLD[np.concatenate([np.frombuffer(carry, np.uint8), raw[a:b]])]
    m = ALNUM_MASK[text]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    marks = offsets[lo + 1:hi] - a  # no carry if there are several rows
    marks = marks[(marks > 0) & (marks < len(text))]
    first[marks], last[marks - 1] = m[marks], m[marks - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets[lo:hi + 1], np.maximum(s - len(carry), 0) + a, "right") - 1 + lo if hi - lo > 1 else np.full(len(s), lo)
    size = e - s
    at = np.cumsum(size + 1) - size - 1
    buf = np.full(int(size.sum()) + len(size) + 8, 0x20, np.uint8)
    buf[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())] = text[m]
    old = int((s < len(carry)).sum())
    rows, starts, sizes = [], [], []
    for n in range(low, high + 1):
        i = np.arange(max(0, old - n + 1), max(0, len(s) - n + 1))
        i = i[row[i] == row[i + n - 1]]
        rows.append(row[i])
        starts.append(at[i])
        sizes.append(at[i + n - 1] + size[i + n - 1] - at[i])
    tail = max(0, len(s) - high + 1)
    rest = buf[at[tail]:at[-1] + size[-1] + 1].tobytes() if tail < len(s) else b""
    words = np.bincount(row[old:] - lo, minlength=hi - lo)
    return buf, np.concatenate(rows), np.concatenate(starts), np.concatenate(sizes), words, rest


def _tables(column, low: int, high: int, buckets: int):
    """(first row, last row + 1, table, row of each occurrence, words per row)."""
    raw, offsets = text_buffers(column)
    before, carry = -1, b""
    for lo, hi, a, b in stretches(raw, offsets):
        buf, row, s, size, words, rest = _features(raw, offsets, lo, hi, a, b, carry if lo == before else b"", low, high)
        before, carry = lo, rest
        yield lo, hi, Table(buf, s, size, buckets), row, words


def bucket_counts(texts: DataFrame, text_col: str, low: int, high: int, buckets: int) -> np.ndarray:
    """Features of all rows per bucket."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, t, _, _ in _tables(batch.column(0), low, high, buckets):
                total += np.bincount(t.bucket, weights=t.count, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = texts.select(F.col(f"`{text_col}`")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)  # at most a row per bucket
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, total, aim = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (total + n)) / float((s + 1) * (aim + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, low: int, high: int, id_col: str, text_col: str, carry=()) -> DataFrame:
    """(id, c: the carried columns, n_features, n_words, weight) per row."""
    known = docs.sparkSession.sparkContext.broadcast(gain)

    def scan(batches):
        gain = known.value
        for batch in batches:
            n, total, words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, hi, t, row, w in _tables(batch.column(0), low, high, len(gain)):
                got = gain[t.bucket][t.slot]
                n[lo:hi] += np.bincount(row - lo, minlength=hi - lo)
                total[lo:hi] += np.bincount(row - lo, weights=got, minlength=hi - lo).astype(np.int64)
                words[lo:hi] += w
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *[pa.array(x) for x in (n, words, weight)]], ["id", "c", "n_features", "n_words", "weight"])

    others = [F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")]
    rows = docs.select(F.col(f"`{text_col}`").alias("t"), F.col(f"`{id_col}`").alias("id"), F.struct(*others).alias("c"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(scan, f"id {kinds['id']}, c {kinds['c']}, n_features long, n_words long, weight long")


def noise(id_col, seed: int):
    """Gumbel noise of an id, in thousandths, from the first 32 bits of a hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Adds ``rank`` to a written table (id, n_words, score...): 1, 2, 3... of
    the rows drawn, null otherwise."""
    fits = F.col("n_words") >= min_words
    counts = scored.where(fits).groupBy("score").count().toArrow().sort_by([("score", "descending")])  # a row per score
    upto = np.cumsum(counts.column(1).to_numpy())
    wanted = int(upto[-1]) * percent // 100 if len(upto) else 0
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    level = counts.column(0)[int(np.searchsorted(upto, wanted))].as_py()
    high = fits & (F.col("score") >= level)
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    placed = save(scored.where(high).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    ranges = placed.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(ranges), "part").withColumn("rank", F.when(place <= wanted, place))
    names = [c for c in scored.columns if c != "row"]
    return ranked.select(*names, "rank").union(scored.where(~high).select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, low: int = 1, high: int = 1,
             buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", carry=()) -> DataFrame:
    """Per row of ``docs``: its id, the ``carry`` columns, n_features, n_words,
    weight, score and rank (null: not drawn).  Of the N rows with ``min_words``
    words or more, floor(percent N / 100) are drawn."""
    prepare(docs.sparkSession)
    if not 1 <= low <= high:
        raise ValueError("runs of 1 word at least")
    gain = gains(bucket_counts(docs, text_col, low, high, buckets), bucket_counts(target, target_col, low, high, buckets))
    carry = [c for c in carry if c not in (*RESULT, id_col)]
    scored = weigh(docs, gain, low, high, id_col, text_col, carry).withColumn("score", F.col("weight") + noise("id", seed))
    ranked = draw(save(scored, "scored"), percent, min_words)
    return ranked.select(F.col("id").alias(id_col), *[F.col("c").getField(c).alias(c) for c in carry], *RESULT)
