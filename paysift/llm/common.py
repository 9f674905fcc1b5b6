"""Shared helpers of the training-data operators.

``words``/``gram_hash`` work on the UTF-8 bytes of an Arrow string column with
numpy: word boundaries come from a 256-entry byte table and every word gets a
64-bit content hash, so equal words have equal hashes in every task.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Bytes of text handled at a time by the numpy helpers (memory stays a small
#: multiple of this, whatever the batch).
SEGMENT = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when it is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once under the shared checkpoint folder and reads it
    back: cuts lineage, survives lost executors, computes once."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Removes the folder of a table from ``save`` that no later plan reads."""
    spark = written.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a row number column whose name none of its columns has."""
    name, taken = "_row", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def stored(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written once with its row number, and the number's column: for
    operators that read it several times.  A number made anew by each read
    would depend on how the scan is split, which differs between jobs."""
    rows, name = numbered(docs)
    return save(rows, "documents"), name


# ---------------------------------------------------------------- byte tables



#: Words are runs of bytes other than space and \t \n \v \f \r.
SPACES = [0x20, *range(0x09, 0x0E)]
WS_MASK = np.ones(256, bool)
WS_MASK[SPACES] = False
#: Words are runs of ASCII letters, digits and non-ASCII bytes.
ALNUM_MASK = np.zeros(256, bool)
ALNUM_MASK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, SEGMENT) + 1
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[name] = np.cumprod(a)
    return _POW["p"][:n], _POW["i"][:n]


#: Byte values of the rolling hash, with and without folding A-Z.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_FOLDED = _BYTES.copy()
_FOLDED[0x41:0x5B] = _BYTES[0x61:0x7B]


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string or binary Arrow column; nulls
    are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if big else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def segments(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SEGMENT bytes each, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SEGMENT, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _piece_words(buf, marks, mask, values):
    """Words of one piece: (start, end, hash); ``marks``: row starts in it."""
    m = mask[buf]
    if not m.any():
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    first = m.copy()
    first[1:] &= ~m[:-1]
    marks = marks[marks < len(buf)]
    first[marks] = m[marks]
    last = m.copy()
    last[:-1] &= ~m[1:]
    inner = marks[marks > 0] - 1
    last[inner] = m[inner]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, inv = _powers(len(buf))
    cum = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * p, out=cum[1:])
    return s, e, mix((cum[e] - cum[s]) * inv[s] + (e - s).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int, mask: np.ndarray, fold: bool):
    """Words of rows lo..hi-1: (row, start byte, end byte, hash) arrays; fold:
    A-Z count as a-z.  A row longer than SEGMENT is cut between words."""
    values = _FOLDED if fold else _BYTES
    a, b = int(offsets[lo]), int(offsets[hi])
    out = []
    while a < b:
        end = min(b, a + SEGMENT) if hi - lo == 1 else b
        while end < b:  # only within one long row: go back to a separator, or on
            sep = np.flatnonzero(~mask[raw[a:end]])
            if len(sep):
                end = a + int(sep[-1]) + 1
                break
            end = min(b, end + (end - a))
        s, e, h = _piece_words(raw[a:end], offsets[lo:hi] - a if hi - lo > 1 else np.zeros(1, np.int64), mask, values)
        out.append((s + a, e + a, h))
        a = end
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    s, e, h = (np.concatenate(x) for x in zip(*out, strict=True))
    return np.searchsorted(offsets[lo:hi + 1], s, "right") - 1 + lo, s, e, h


def span_hash(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The hash ``words`` gives (without folding) for each byte span s..e."""
    out = np.empty(len(s), np.uint64)
    lo = 0
    while lo < len(s):
        hi = max(lo + 1, int(np.searchsorted(e, s[lo] + SEGMENT, "right")))
        a, b = int(s[lo]), int(e[hi - 1])
        p, inv = _powers(b - a)
        cum = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTES[raw[a:b]] * p, out=cum[1:])
        i, j = s[lo:hi] - a, e[lo:hi] - a
        out[lo:hi] = mix((cum[j] - cum[i]) * inv[i] + (j - i).astype(np.uint64))
        lo = hi
    return out


_STEP = np.uint64(0xA0761D6478BD642F)


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (length n - k + 1, unmixed rows:
    the caller drops those that cross rows)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    powers = {1: h}
    size = 1
    while size * 2 <= k:
        x = powers[size]
        powers[size * 2] = x[:-size] * np.uint64(pow(int(_STEP), size, 1 << 64)) + x[size:]
        size *= 2
    have, out = size, powers[size]
    while have < k:
        nxt = 1 << ((k - have).bit_length() - 1)
        n = len(h) - have - nxt + 1
        out = out[:n] * np.uint64(pow(int(_STEP), nxt, 1 << 64)) + powers[nxt][have:have + n]
        have += nxt
    return mix(out + np.uint64(k))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def row_counts(rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return np.bincount(rows - lo, minlength=hi - lo)


def list_of(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.ListArray:
    """Arrow list column from flat values and row counts."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least value (the first of equal ones) in each window of w."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    best, size = np.arange(len(h)), 1
    while size < w:
        step = min(size, w - size)
        a, b = best[:-step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        size += step
    return best


def lanes(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes (little endian) from each place of ``buf`` on, which ends
    with 8 spare bytes."""
    out = np.empty(len(buf) - 7, np.uint64)
    for o in range(min(8, len(out))):
        part = buf[o:o + (len(buf) - o) // 8 * 8].view("<u8")
        out[o::8] = part[:len(out[o::8])]
    return out


def same_bytes(word: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the ``size`` bytes from a and from b on equal?  ``word``: lanes."""
    equal, open_, j = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(open_):
        left = size[open_] - j
        mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * np.clip(left, 0, 7).astype(np.uint64))) - np.uint64(1))
        differ = ((word[a[open_] + j] ^ word[b[open_] + j]) & mask) != 0
        equal[open_[differ]] = False
        open_ = open_[~differ & (left > 8)]
        j += 8
    return equal


# ---------------------------------------------------------------- bit filters

def bit_filter(hashes: DataFrame, bits: int):
    """Broadcast bit array of ``bits`` (a power of two up to 2^31: its size is
    the bound) with two bits set per value of the long column ``h``.  The
    bitmaps are built by a native aggregate and only their 4 KB chunks, bits / 8
    bytes in all, reach the driver."""
    spark = hashes.sparkSession
    at = F.array(F.col("h").bitwiseAND(F.lit(bits - 1)) + 1, F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1)) + 1)
    rows = (hashes.select(F.explode(at).alias("i")).groupBy(F.bitmap_bucket_number("i").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("i")).alias("m")).toLocalIterator())
    out = np.zeros((max(1, bits >> 15), 4096), np.uint8)
    for r in rows:
        out[r["b"] - 1] = np.frombuffer(r["m"], np.uint8)
    return spark.sparkContext.broadcast(out.reshape(-1)[:max(1, bits // 8)])


def in_filter(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each uint64 hash may be in the filter (no false negatives)."""
    mask = np.uint64(len(bitmap) * 8 - 1)
    a, b = h & mask, (h >> np.uint64(32)) & mask
    hit = lambda i: (bitmap[(i >> np.uint64(3)).astype(np.int64)] >> (i & np.uint64(7)).astype(np.uint8)) & 1
    out = hit(a).astype(bool)
    out[out] = hit(b[out]).astype(bool)
    return out
