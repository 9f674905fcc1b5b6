"""Sampling, splitting and weighting.

All draws are deterministic functions of ``(txn_id, seed, salt)`` through
md5, so they do not depend on partitioning, survive task retries after an
executor loss, and can be restated in SQL.  Quotas are exact: a class with
n rows contributes exactly its quota, chosen by hash rank (``plans.prefix``),
never by Bernoulli ``sample``/``sampleBy``.

Quota arithmetic is done in integers on rational fractions (0.25 = 1/4, 0.2 =
1/5) so ``ceil``/``round`` never see binary-float noise.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantile import quantile_row
from ..plans.prefix import below_quota, hash_ntile, hash_rank
from ..sources.schema import TARGET

SEED = 42


def _frac(f: float) -> Fraction:
    return Fraction(str(f)).limit_denominator(10 ** 9)


def _div(a: Column, b: int) -> Column:
    """Integer quotient of wide decimals (no binary float, no overflow)."""
    return F.call_function("div", a, F.lit(b).cast("decimal(20,0)"))


def _wide(n: Column, times: int, plus: int) -> Column:
    return n.cast("decimal(20,0)") * F.lit(times).cast("decimal(12,0)") + F.lit(plus).cast("decimal(12,0)")


def round_quota(n: Column, frac: float) -> Column:
    """round-half-up(frac · n) in exact integer arithmetic."""
    q = _frac(frac)
    return _div(_wide(n, 2 * q.numerator, q.denominator), 2 * q.denominator).cast("bigint")


def ceil_quota(n: Column, frac: float) -> Column:
    q = _frac(frac)
    return _div(_wide(n, q.numerator, q.denominator - 1), q.denominator).cast("bigint")


def floor_quota(n: Column, frac: float) -> Column:
    q = _frac(frac)
    return _div(_wide(n, q.numerator, 0), q.denominator).cast("bigint")


def split_quotas(df: DataFrame, test_frac: float, label: str) -> DataFrame:
    """Test rows per class: ceil(test_frac · n) in all, shared by largest
    remainder (ties: the smaller label first).  One row per class."""
    q = _frac(test_frac)
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"))
    n = (n.crossJoin(F.broadcast(total))  # one row
          .withColumn("_quota", floor_quota(F.col("_n"), test_frac))
          .withColumn("_rest", _wide(F.col("_n"), q.numerator, 0) - F.col("_quota").cast("decimal(20,0)") * q.denominator))
    every = Window.partitionBy(F.lit(0))  # as many rows as classes
    left = ceil_quota(F.col("_all"), test_frac) - F.sum("_quota").over(every)
    place = F.row_number().over(every.orderBy(F.desc("_rest"), label))
    return n.select(label, (F.col("_quota") + F.when(place <= left, 1).otherwise(0)).cast("bigint").alias("_quota"))


def _quotas(df: DataFrame, label: str, quota) -> DataFrame:
    """One row per class: ``quota(_n)`` of its row count."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).select(label, quota(F.col("_n")).cast("bigint").alias("_quota"))


def stratified_sample(df: DataFrame, frac: float = 0.25, label: str = TARGET,
                      key: str = "txn_id", seed: int = SEED, store: bool = False) -> DataFrame:
    """Exact per-class proportion: the round(frac·n_c) rows of each class
    with the smallest hash (``store``: as in ``below_quota``)."""
    quota = _quotas(df, label, lambda n: round_quota(n, frac))
    return below_quota(df, quota, [label], key, seed, "sample", store=store).where("_in").drop("_in")


def train_test_split(df: DataFrame, test_frac: float = 0.2, label: str = TARGET,
                     key: str = "txn_id", seed: int = SEED, store: bool = False) -> DataFrame:
    """Adds ``split`` ∈ {train, test}; the test part has
    ceil(test_frac·n) rows, shared over the classes by largest remainder.
    Disjoint and exhaustive by construction (same rank, opposite predicate —
    no anti-join).  ``store``: as in ``below_quota``."""
    quota = F.broadcast(split_quotas(df, test_frac, label))  # a row per class
    return (below_quota(df, quota, [label], key, seed, "split", store=store)
            .withColumn("split", F.when(F.col("_in"), F.lit("test")).otherwise(F.lit("train"))).drop("_in"))


def hash_sample_n(df: DataFrame, n: int, key: str = "txn_id", seed: int = SEED,
                  salt: str = "sample_n") -> DataFrame:
    """min(n, len) rows without replacement — the n smallest hashes."""
    quota = df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("_quota"))
    return below_quota(df, quota, [], key, seed, salt).where("_in").drop("_in")


def _keep_quota(df: DataFrame, label: str, of: int, quota, key: str, seed: int, salt: str) -> DataFrame:
    """All rows of the other class, and ``quota(n1, n0)`` rows of class ``of``."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("_n1"), F.count_if(F.col(label) == 0).alias("_n0"))
    quotas = counts.select(F.explode(F.array(F.struct(F.lit(of).alias("c"), quota(F.col("_n1"), F.col("_n0")).cast("bigint").alias("_quota")),
                                             F.struct(F.lit(1 - of).alias("c"), (F.col("_n1") + F.col("_n0")).alias("_quota")))).alias("x"))
    quotas = quotas.select(F.col("x.c").cast(df.schema[label].dataType).alias(label), "x._quota")
    return below_quota(df.where(F.col(label).isin(0, 1)), quotas, [label], key, seed, salt).where("_in").drop("_in")


def undersample(df: DataFrame, ratio: int = 3, label: str = TARGET, key: str = "txn_id",
                seed: int = SEED) -> DataFrame:
    """I4: keep every positive; keep min(ratio·n1, n0) negatives."""
    return _keep_quota(df, label, 0, lambda n1, n0: F.least(n1 * ratio, n0), key, seed, "under")


def class_weights(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Per class weight n / (2·n_c) and the positive scale n0/n1."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = g.agg(F.sum("n_class").alias("_n"),
                F.sum(F.when(F.col(label) == 0, F.col("n_class"))).alias("_n0"),
                F.sum(F.when(F.col(label) == 1, F.col("n_class"))).alias("_n1"))
    return (g.crossJoin(F.broadcast(tot))
             .select(label, "n_class", (F.col("_n") / (2.0 * F.col("n_class"))).alias("weight"),
                     F.try_divide(F.col("_n0").cast("double"), F.col("_n1")).alias("scale_pos_weight")))


def with_weights(df: DataFrame, label: str = TARGET, weight_col: str = "weight") -> DataFrame:
    """Attach the balanced class weight as a column (for ``weightCol``)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label)  # <= number of classes rows


def stratified_folds(df: DataFrame, k: int = 5, label: str = TARGET, key: str = "txn_id",
                     seed: int = SEED) -> DataFrame:
    """``fold`` = k-tile of the class in hash order (fold sizes differ by at
    most one, first folds larger), usable as ``CrossValidator(foldCol=...)``."""
    return hash_ntile(df, k, [label], key, seed, "fold", "fold")


def rebalance_ratio(df: DataFrame, ratio: float, label: str = TARGET, key: str = "txn_id",
                    seed: int = SEED, mode: str = "downsample_majority") -> DataFrame:
    """Resample to a target positive share ``ratio``.

    ``downsample_majority`` (reference): keep all positives, keep
    int(n1·(1/ratio − 1)) negatives capped at n0 — the actual ratio can then
    differ from the target, so callers should report it.
    ``downsample_minority``: keep all negatives and int(n0·ratio/(1−ratio))
    positives capped at n1."""
    if mode == "downsample_majority":
        return _keep_quota(df, label, 0, lambda n1, n0: F.least(F.floor(n1 * (1.0 / ratio - 1)), n0), key, seed, "ratio")
    return _keep_quota(df, label, 1, lambda n1, n0: F.least(F.floor(n0 * (ratio / (1 - ratio))), n1), key, seed, "ratio")


def rebalance_flag(df: DataFrame, of: DataFrame, ratio: float, name: str, label: str = TARGET, key: str = "txn_id", seed: int = SEED) -> DataFrame:
    """I7 as a flag: whether ``rebalance_ratio`` of the stored table ``of``, which
    has the rows of ``df``, keeps the row (all rows have a class of 0 or 1)."""
    n1, n0 = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    quotas = of.agg(n1.alias("_n1"), n0.alias("_n0")).select(F.explode(F.array(
        F.struct(F.lit(0).alias("c"), F.least(F.floor(F.col("_n1") * (1.0 / ratio - 1)), F.col("_n0")).cast("bigint").alias("_quota")),
        F.struct(F.lit(1).alias("c"), (F.col("_n1") + F.col("_n0")).alias("_quota")))).alias("x"))
    quotas = quotas.select(F.col("x.c").cast(df.schema[label].dataType).alias(label), "x._quota")
    return below_quota(df, quotas, [label], key, seed, "ratio", of).withColumnRenamed("_in", name)


def time_split(df: DataFrame, q: float = 0.70, col: str = "step") -> DataFrame:
    """I8: ``period`` = early (step <= exact q-quantile) / late."""
    p = quantile_row(df, col, {"_cut": q})
    return (df.crossJoin(F.broadcast(p))
              .withColumn("period", F.when(F.col(col) <= F.col("_cut"), F.lit("early"))
                          .otherwise(F.lit("late")))
              .drop("_cut"))


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str = "txn_id") -> DataFrame:
    """Rows whose id is in a set (left semi join; the id side is
    shuffled or broadcast by Catalyst according to its size)."""
    return df.join(ids.select(key), key, "left_semi")


def hash_shuffle(df: DataFrame, key: str = "txn_id", seed: int = SEED) -> DataFrame:
    """Deterministic shuffle — a set is order-free, so the operator only
    exposes the permutation as an exact ``shuffle_pos`` column."""
    return hash_rank(df, [], key, seed, "shuffle", rank_col="shuffle_pos")


def union_samples(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
