"""Two-level prefix sums: exact global ranks without a single-partition window.

``row_number() OVER (PARTITION BY g ORDER BY h)`` over a whole table puts a
whole group (a class label: ~all rows) into one task.  Here the order key ``h``
is an md5 hex string, so its first 4 hex digits give 2^16 ordered, uniformly
filled buckets:

1. count rows per (group, bucket) — partial aggregation, ≤ #groups · 2^16 rows;
2. a running sum over that small table gives each bucket's offset;
3. rows get ``offset + row_number()`` inside their (group, bucket) partition —
   ~n/2^16 rows per window partition however large (or hot) a group is;
   at 10^12 rows that is ~1.5·10^7 rows per sort, which spills safely.

The rank equals ``row_number() OVER (PARTITION BY g ORDER BY h, key) - 1``
(0-based) exactly, because bucket order is a prefix of ``h`` order.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import hash_key, join_null_safe

BUCKET_HEX = 4  # 2^16 buckets


def with_hash(df: DataFrame, key: str, seed, salt: str, name: str = "_h") -> DataFrame:
    """Attach the order key ``md5(key|seed|salt)``."""
    return df.withColumn(name, hash_key(F.col(key), seed, salt))


def hash_rank(df: DataFrame, by=(), key: str = "txn_id", seed=42, salt: str = "rank",
              rank_col: str = "_rank", size_col: str | None = None) -> DataFrame:
    """Append the exact 0-based rank of each row within ``by`` in
    ``md5(key|seed|salt)`` order (ties broken by ``key``); optionally the
    group size as ``size_col``."""
    by = list(by)
    d = (with_hash(df, key, seed, salt)
         .withColumn("_b", F.conv(F.substring("_h", 1, BUCKET_HEX), 16, 10).cast("int")))
    bc = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    wcum = (Window.partitionBy(*by).orderBy("_b")
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bc = bc.withColumn("_off", F.sum("_bn").over(wcum) - F.col("_bn"))
    if size_col:
        bc = bc.withColumn(size_col, F.sum("_bn").over(Window.partitionBy(*by)))
    bc = bc.drop("_bn")
    w = Window.partitionBy(*by, "_b").orderBy("_h", key)
    out = (join_null_safe(d, bc, by + ["_b"])
            .withColumn(rank_col, F.col("_off") + F.row_number().over(w) - 1)
            .drop("_h", "_b", "_off"))
    return out


def below_quota(df: DataFrame, quota: DataFrame, by=(), key: str = "txn_id", seed=42, salt: str = "rank",
                of: DataFrame | None = None, store: bool = False) -> DataFrame:
    """Adds ``_in``: whether a row's rank within ``by`` (as in ``hash_rank``)
    is below its group's ``_quota`` (``quota``: by..., ``_quota``; one row per
    group, few groups).

    No wide row is shuffled: bucket counts give, per group, the one bucket
    that holds the quota-th row; only the keys of that bucket are ranked; the
    row found is the group's bound, and rows are compared with it in place.  ``of``:
    a stored table of the same keys to find the bounds in (``df`` itself if not
    given), so that a chain of such flags doesn't read its own past again; ``store``:
    the bounds are written at once, for a result that is read several times."""
    by = list(by)
    same = lambda a, b: reduce(and_, [a[c].eqNullSafe(b[f"_q_{c}"]) for c in by], F.lit(True))
    named = lambda t, *more: t.select(*[F.col(c).alias(f"_q_{c}") for c in by], *more)
    d = with_hash((df if of is None else of).select(*by, key), key, seed, salt).withColumn("_b", F.substring("_h", 1, BUCKET_HEX))
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_off", F.sum("_bn").over(upto) - F.col("_bn"))
    wanted = named(quota, "_quota")
    cut = (counts.join(F.broadcast(wanted), same(counts, wanted)).where("_off <= _quota and _quota < _off + _bn")
           .select(*[F.col(c).alias(f"_q_{c}") for c in by], F.col("_b").alias("_qb"), (F.col("_quota") - F.col("_off")).alias("_k")))
    inside = d.join(F.broadcast(cut), same(d, cut) & (F.col("_b") == F.col("_qb")))  # a row per group
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_h", key)) - 1
    bound = named(inside.withColumn("_i", place).where("_i = _k"), F.col("_h").alias("_bh"), F.col(key).alias("_bk"))
    if store:
        from ..sources.files import cut_lineage
        bound = cut_lineage(bound, "bounds")
    rows = with_hash(df, key, seed, salt)
    out = rows.join(F.broadcast(bound), same(rows, bound), "left")  # a row per group
    below = F.col("_bh").isNull() | (F.col("_h") < F.col("_bh")) | ((F.col("_h") == F.col("_bh")) & (F.col(key) < F.col("_bk")))
    return out.withColumn("_in", below).select(*df.columns, "_in")


def hash_ntile(df: DataFrame, k: int, by=(), key: str = "txn_id", seed=42, salt: str = "rank", name: str = "tile") -> DataFrame:
    """Adds ``name`` (0..k-1): the k-tile of each row within ``by`` in hash order, as
    ``ntile(k) OVER (PARTITION BY by ORDER BY h, key) - 1`` (sizes differ by one at
    most, the first ones are larger).

    As in ``below_quota`` no wide row is shuffled: bucket counts locate the k - 1
    first rows of the later tiles, only the keys of those buckets are ranked, and
    all rows are compared in place with their group's bounds."""
    if k < 2:
        return df.withColumn(name, F.lit(0))
    by = list(by)
    same = lambda a, b: reduce(and_, [a[c].eqNullSafe(b[f"_q_{c}"]) for c in by], F.lit(True))
    named = lambda t, *more: t.select(*[F.col(c).alias(f"_q_{c}") for c in by], *more)
    d = with_hash(df.select(*by, key), key, seed, salt).withColumn("_b", F.substring("_h", 1, BUCKET_HEX))
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (counts.withColumn("_off", F.sum("_bn").over(upto) - F.col("_bn"))
                    .withColumn("_n", F.sum("_bn").over(Window.partitionBy(*by))))
    first = F.expr(f"t * (_n div {k}) + least(t, _n % {k})")
    cut = (counts.withColumn("t", F.explode(F.array(*[F.lit(t).cast("long") for t in range(1, k)]))).withColumn("_first", first)
                 .where("_off <= _first and _first < _off + _bn")
                 .select(*by, "t", F.col("_b").alias("_qb"), (F.col("_first") - F.col("_off")).alias("_k")))
    wanted = F.broadcast(named(cut, "t", "_qb", "_k"))  # k - 1 rows per group
    buckets = F.broadcast(named(cut, "_qb").distinct())
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key)) - 1
    inside = d.join(buckets, same(d, buckets) & (F.col("_b") == F.col("_qb")), "left_semi").withColumn("_i", place)
    hit = inside.join(wanted, same(inside, wanted) & (F.col("_b") == F.col("_qb")) & (F.col("_i") == F.col("_k")))
    at = F.struct(F.col("_h"), F.col(key))
    bounds = named(hit.groupBy(*by).agg(*[F.max(F.when(F.col("t") == t, at)).alias(f"_t{t}") for t in range(1, k)]), *[f"_t{t}" for t in range(1, k)])
    rows = with_hash(df, key, seed, salt)
    out = rows.join(F.broadcast(bounds), same(rows, bounds), "left")  # a row per group
    passed = [F.coalesce((at >= F.col(f"_t{t}")).cast("int"), F.lit(0)) for t in range(1, k)]
    return out.withColumn("_tile", reduce(lambda a, b: a + b, passed, F.lit(0))).select(*df.columns, F.col("_tile").cast("int").alias(name))
