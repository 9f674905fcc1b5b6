"""Near-duplicates by b-bit MinHash (operator 10).

A document's set is its distinct ``SHINGLE``-word shingles as 64-bit hashes.
Documents with equal sets are one class (a group of exact copies becomes one
row before anything is compared).  24 bands of 4 minima choose candidates.
A signature packs, in 4 bits each, the minima of 512 bins of the shingle hashes
(0: no shingle in the bin); the similarity of a candidate pair is estimated by
counting equal nibbles.  Bins draw from the set without replacement, so small
sets are compared almost exactly.  Bins of different minima agree by chance once
in 15; the estimate takes that off, which leaves a standard error of 0.02 at
most.  Pairs whose estimate is under the threshold by 5 standard errors (1 in 3
million) are not links, all others are confirmed on full sets.

Candidates without all pairs: each bucket's pivot, its member that shares the
most buckets, is compared with the others.  Links make components; buckets
whose members still lie in several components get a second pivot, and what is
left is compared block by block, only across components, in the condition of a
join (so only pairs that the estimate lets through become rows, each in the
first band it shares).  A link that
would only join one component to itself is not looked for.  A pair at the
threshold 0.85 is missed by all bands once in 50 million, at 0.8 once in
300,000; no bucket is capped.

Components: alternating large-star and small-star steps over written edge
tables, until they change nothing.

Nulls, empty texts and texts without words have no set and link with nothing.
Rows that repeat an id are documents of their own; the id of a component is
the smallest of its rows' ids (null ids count as the largest).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (WS_MASK, gram_hash, list_of, mix, prepare, row_counts, save, segments, signed, stored, text_buffers, words)

SHINGLE, BANDS, ROWS = 5, 24, 4
N_MINIMA = BANDS * ROWS
BINS = 512
SIG = [f"s{i}" for i in range(BINS // 16)]
_A = mix(np.arange(1, N_MINIMA + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_B = mix(np.arange(1, N_MINIMA + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))


def shingle_sets(raw, offsets, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of rows lo..hi-1, row after row, and each
    row's number of them.  Fewer words than a shingle: all of them as one."""
    row, _, _, h = words(raw, offsets, lo, hi, WS_MASK, fold=True)
    counts = row_counts(row, lo, hi)
    grams = gram_hash(h, SHINGLE)
    inside = row[:len(grams)] == row[SHINGLE - 1:] if len(grams) else np.zeros(0, bool)
    rows, sets = [row[:len(grams)][inside]], [grams[inside]]
    starts = np.cumsum(counts) - counts
    for n in range(1, SHINGLE):
        first = starts[counts == n]
        if len(first):
            rows.append(row[first])
            sets.append(mix(gram_hash(h, n)[first] + np.uint64(n)))
    row, h = np.concatenate(rows), np.concatenate(sets)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new] - lo, minlength=hi - lo)


def class_ids(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16-byte class of each set (sums of two mixes; n x 2 longs)."""
    ends = np.cumsum(counts)
    out = np.zeros((len(counts), 2), np.uint64)
    for k, salt in enumerate((0x1B873593, 0xE6546B64)):
        cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ mix(np.full(1, salt, np.uint64))))])
        out[:, k] = cum[ends] - cum[ends - counts] + counts.astype(np.uint64)
    return out


def signatures(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bin minima in 4 bits (rows x len(SIG) longs): 1 + minimum mod 15."""
    row = np.repeat(np.arange(len(counts)), counts)
    g = mix(sets ^ np.uint64(0x2545F4914F6CDD1D))
    g = g[np.lexsort((g, row))]
    at = row * BINS + (g >> np.uint64(55)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    nibble = np.zeros(len(counts) * BINS, np.uint64)
    nibble[at[first]] = mix(g[first]) % np.uint64(15) + np.uint64(1)
    return (nibble.reshape(len(counts), len(SIG), 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64)


def sketches(docs: DataFrame, row_col: str, id_col: str, text_col: str) -> DataFrame:
    """(_row, id, n, cls, s0.., bands) per row, written; cls null without a set."""
    def scan(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            n, cls, sig, bands = [], [], [], []
            for lo, hi in segments(offsets):
                sets, counts = shingle_sets(raw, offsets, lo, hi)
                full = counts > 0
                at = (np.cumsum(counts) - counts)[full]
                minima = np.zeros((int(full.sum()), N_MINIMA), np.uint64)
                for k in range(N_MINIMA if len(at) else 0):
                    x = sets * _A[k] + _B[k]
                    minima[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), at)
                b = np.zeros((len(counts), BANDS), np.uint64)
                for k in range(N_MINIMA):
                    b[full, k // ROWS] = mix(b[full, k // ROWS] ^ minima[:, k] + np.uint64(k + 1))
                n.append(counts)
                cls.append(class_ids(sets, counts))
                sig.append(signatures(sets, counts))
                bands.append(b)
            n = np.concatenate([np.zeros(0, np.int64), *n])
            blob = np.ascontiguousarray(np.concatenate([np.zeros((0, 2), np.uint64), *cls])).tobytes()
            ids = pa.array([blob[16 * i:16 * i + 16] if c else None for i, c in enumerate(n.tolist())], pa.binary())
            s = np.concatenate([np.zeros((0, len(SIG)), np.uint64), *sig])
            b = np.concatenate([np.zeros((0, BANDS), np.uint64), *bands])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), ids, *[pa.array(signed(np.ascontiguousarray(s[:, i]))) for i in range(len(SIG))],
                 list_of(signed(np.ascontiguousarray(b.reshape(-1))), np.full(len(b), BANDS))], ["_row", id_col, "n", "cls", *SIG, "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return save(docs.select(F.col(row_col).alias("_row"), F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(
        scan, f"_row long, `{id_col}` {kind}, n long, cls binary, {', '.join(f'{s} long' for s in SIG)}, bands array<long>"), "sketches")


def estimate(a: str, b: str) -> Column:
    """Similarity: the share of equal nibbles among the bins that either signature
    has, less the chance agreement of the others (1 in 15)."""
    low = F.lit(0x1111111111111111)

    def any_bit(x):  # a 1 per nibble that isn't 0
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(low))

    used, differ = F.lit(0), F.lit(0)
    for s in SIG:
        x, y = F.col(f"{a}.{s}"), F.col(f"{b}.{s}")
        used, differ = used + any_bit(x.bitwiseOR(y)), differ + any_bit(x.bitwiseXOR(y))
    return 1 - differ / used * (15 / 14)


def _possible(a: str, b: str, percent: int) -> Column:
    """May the pair reach the threshold: sizes exactly, similarity by estimate
    less 5 standard errors."""
    t = percent / 100
    share = t + (1 - t) / 15  # of equal nibbles, at the threshold
    margin = 5 * (share * (1 - share) / BINS) ** 0.5 * 15 / 14 + 0.005
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 100 >= large * percent) & (estimate(a, b) >= t - margin)


def confirm(pairs: DataFrame, docs: DataFrame, row_col: str, reps: DataFrame, text_col: str, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.  Texts of the
    classes that occur are joined on; the sets are made again from them."""
    needed = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b"))).distinct().join(reps.select("cls", "_row"), "cls")
    texts = save(docs.select(F.col(row_col).alias("_row"), F.col(text_col).alias("t")).join(needed, "_row").select("cls", "t"), "pair_texts")
    both = (pairs.join(texts.select(F.col("cls").alias("a"), F.col("t").alias("ta")), "a")
            .join(texts.select(F.col("cls").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def check(batches):
        for batch in batches:
            keep = []
            sides = [text_buffers(batch.column(i)) for i in (2, 3)]
            for i in range(batch.num_rows):
                x, y = (shingle_sets(raw, off, i, i + 1)[0] for raw, off in sides)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return save(both.mapInArrow(check, "a binary, b binary"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of all vertices of the edges (a, b): root is the least vertex
    of the component.  Large-star and small-star steps."""
    e = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = save(large.distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = save(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        # A star forest: one edge per leaf, and no centre is itself a leaf.
        centres, leaves = small.select(F.col("v").alias("x")).distinct(), small.groupBy(F.col("u").alias("x")).agg(F.count(F.lit(1)).alias("k"))
        open_ = leaves.where("k > 1").select("x").union(centres.join(leaves, "x").select("x")).limit(1).count()
        e = small
        if not open_:
            break
    return e.select(F.col("u").alias("cls"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> DataFrame:
    """(_row, id, n_shingles, component_id, root) per row; rows without a set
    are their own component with a null root."""
    docs, row = stored(docs.select(F.col(id_col), F.col(text_col)))
    return _near(docs, row, percent, id_col, text_col, block)


def _near(docs: DataFrame, row_col: str, percent: int, id_col: str, text_col: str, block: int = 512) -> DataFrame:
    """``near_duplicates`` of ``docs`` and ``row_col`` from ``stored``."""
    prepare(docs.sparkSession)
    rows = sketches(docs, row_col, id_col, text_col)
    sets = rows.where("cls is not null")
    reps = save(sets.groupBy("cls").agg(F.min("_row").alias("_row"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in SIG], F.first("bands").alias("bands")), "classes")
    in_band = reps.select("cls", F.posexplode("bands").alias("band", "key"))
    keys = ["band", "key"]
    shared = in_band.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = save(in_band.join(shared, keys).join(reps.drop("_row"), "cls"), "buckets")
    degree = member.groupBy("cls").agg(F.sum("size").alias("degree"))

    def compare(of: DataFrame, pivot: DataFrame, apart: bool) -> DataFrame:
        """Candidate pairs of each bucket's members with its pivot."""
        m = of.join(pivot, keys).where(F.col("root") != F.col("p.root") if apart else F.col("cls") != F.col("p.cls"))
        m = m.select(F.struct("n", *SIG).alias("m"), "p", "cls").where(_possible("m", "p", percent))
        return save(m.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct(), "pairs")

    def pivots(of: DataFrame, *more: str) -> DataFrame:
        return of.join(degree, "cls").groupBy(*keys).agg(F.max(F.struct("degree", "cls", "n", *SIG, *more)).alias("p"))

    def open_buckets(links: DataFrame) -> DataFrame:
        """Members of the buckets that still span several components."""
        rooted = member.join(components(links), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        several = rooted.groupBy(*keys).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(*keys)
        return save(rooted.join(several, keys), "open_buckets")

    links = confirm(compare(member, pivots(member), False), docs, row_col, reps, text_col, percent)
    left = open_buckets(links)
    # Second pivot: the best member outside the component of the best one.
    best = left.join(degree, "cls").groupBy(*keys).agg(F.max_by("root", F.struct("degree", "cls")).alias("r"))
    second = pivots(left.join(best, keys).where("root <> r"), "root")
    pairs = compare(left, second, True)
    if not pairs.isEmpty():
        links = links.union(confirm(pairs, docs, row_col, reps, text_col, percent)).distinct()
        left = open_buckets(links)
    # What is left, block by block across components.
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int")
    mine = F.pmod(F.xxhash64("cls"), parts).cast("int")
    side = left.withColumn("_p", parts).withColumn("_m", mine)
    x = side.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).withColumn("_i", F.col("_m")).withColumn("_j", F.col("_o"))
    y = side.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).withColumn("_j", F.col("_m")).withColumn("_i", F.col("_o"))
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*keys, "_i", "_j")]
    cond = on[0] & on[1] & on[2] & on[3] & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & _possible("x", "y", percent)
    shared_bands = F.zip_with("x.bands", "y.bands", lambda p, q: p == q)
    cond = cond & (F.array_position(shared_bands, True) == F.col("x.band") + 1)
    pairs = save(x.alias("x").join(y.alias("y"), cond).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct(), "pairs")
    if not pairs.isEmpty():
        links = links.union(confirm(pairs, docs, row_col, reps, text_col, percent)).distinct()
    roots = components(links)
    placed = sets.select("_row", id_col, "n", "cls").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = placed.groupBy("root").agg(F.min(id_col).alias("component_id"))
    joined = placed.join(least, "root").select("_row", id_col, F.col("n").alias("n_shingles"), "component_id", "root")
    return joined.union(rows.where("cls is null").select("_row", id_col, F.lit(0).cast("long"), F.col(id_col), F.lit(None).cast("binary")))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of its smallest id (of equal ids, one);
    rows without a set stay."""
    rows, name = stored(docs)
    found = _near(rows, name, percent, id_col, text_col)
    first = found.where("root is not null").groupBy("root").agg(F.min_by("_row", F.struct(F.col(id_col).isNull(), id_col, "_row")).alias("_row")).select("_row")
    keep = save(first.union(found.where("root is null").select("_row")), "kept_rows")
    return rows.join(keep.withColumnRenamed("_row", name), name, "left_semi").select(*docs.columns)
