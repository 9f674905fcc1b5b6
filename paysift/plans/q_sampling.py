"""Registered sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from ..oracle import SPLIT_CTES, rnd, with_txn
from ..registry import register
from ..sources.transactions import transactions


def _rank_sql(salt: str, by: str | None = "isFraud", src: str = "transactions",
              seed: int = 42) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return (f"row_number() OVER ({part}ORDER BY md5(concat_ws('|', txn_id, '{seed}', '{salt}')), "
            f"txn_id) - 1")


@register("stratified_sample", with_txn(f"""
SELECT txn_id, isFraud FROM (
  SELECT txn_id, isFraud, {_rank_sql('sample')} AS _rank, count(*) OVER (PARTITION BY isFraud) AS _n
  FROM transactions) r
WHERE _rank < floor((_n * 2 + 4) / 8)"""))
def stratified_sample(spark, sf):
    """Exact 25 % per class."""
    return S.stratified_sample(transactions(spark, sf), 0.25).select("txn_id", "isFraud")


@register("train_test_split", with_txn(
    f"""SELECT txn_id, isFraud, CASE WHEN _rank < quota THEN 'test' ELSE 'train' END AS split
FROM (SELECT txn_id, isFraud, {_rank_sql('split')} AS _rank FROM transactions) r JOIN k USING (isFraud)""",
    SPLIT_CTES))
def train_test_split(spark, sf):
    """80/20, test = ceil(0.2·n), shared by largest remainder."""
    return S.train_test_split(transactions(spark, sf), 0.2).select("txn_id", "isFraud", "split")


@register("hash_sample_n", with_txn(f"""
SELECT txn_id FROM (SELECT txn_id, {_rank_sql('sample_n', None)} AS _rank FROM transactions) r
WHERE _rank < 1000"""))
def hash_sample_n(spark, sf):
    """1,000 rows without replacement."""
    return S.hash_sample_n(transactions(spark, sf), 1000).select("txn_id")


@register("undersample", with_txn(f"""
SELECT txn_id, isFraud FROM (
  SELECT txn_id, isFraud, {_rank_sql('under')} AS _rank,
         count(*) FILTER (WHERE isFraud = 1) OVER () AS _n1,
         count(*) FILTER (WHERE isFraud = 0) OVER () AS _n0
  FROM transactions) r
WHERE isFraud = 1 OR _rank < least(_n1 * 3, _n0)"""))
def undersample(spark, sf):
    """I4: all positives + min(3·n1, n0) negatives."""
    return S.undersample(transactions(spark, sf), 3).select("txn_id", "isFraud")


@register("class_weights", rnd(with_txn("""
SELECT isFraud, n_class, sum(n_class) OVER () / (2.0 * n_class) AS weight,
       sum(CASE WHEN isFraud = 0 THEN n_class END) OVER () * 1.0
         / sum(CASE WHEN isFraud = 1 THEN n_class END) OVER () AS scale_pos_weight
FROM (SELECT isFraud, count(*) AS n_class FROM transactions GROUP BY isFraud) g"""),
    "weight", "scale_pos_weight"))
def class_weights(spark, sf):
    """Balanced class weights and scale_pos_weight."""
    return S.class_weights(transactions(spark, sf))


@register("stratified_folds", with_txn(f"""
SELECT txn_id, isFraud, CAST(ntile(5) OVER (PARTITION BY isFraud ORDER BY md5(concat_ws('|', txn_id, '42', 'fold')), txn_id) - 1 AS INT) AS fold FROM transactions"""))
def stratified_folds(spark, sf):
    """5 stratified folds."""
    return S.stratified_folds(transactions(spark, sf), 5).select("txn_id", "isFraud", "fold")


@register("rebalance_ratio", with_txn(f"""
SELECT txn_id, isFraud FROM (
  SELECT txn_id, isFraud, {_rank_sql('ratio')} AS _rank,
         count(*) FILTER (WHERE isFraud = 1) OVER () AS _n1,
         count(*) FILTER (WHERE isFraud = 0) OVER () AS _n0
  FROM transactions) r
WHERE isFraud = 1 OR _rank < least(floor(_n1 * (1.0 / 0.05 - 1)), _n0)"""))
def rebalance_ratio(spark, sf):
    """Keep all positives, resample negatives to a 5 % positive share."""
    return S.rebalance_ratio(transactions(spark, sf), 0.05).select("txn_id", "isFraud")


@register("rebalance_minority", with_txn(f"""
SELECT txn_id, isFraud FROM (
  SELECT txn_id, isFraud, {_rank_sql('ratio')} AS _rank,
         count(*) FILTER (WHERE isFraud = 1) OVER () AS _n1,
         count(*) FILTER (WHERE isFraud = 0) OVER () AS _n0
  FROM transactions) r
WHERE isFraud = 0 OR _rank < least(floor(_n0 * (0.01 / (1 - 0.01))), _n1)"""))
def rebalance_minority(spark, sf):
    """I7, downsample_minority: all negatives, positives down to a 1 % share."""
    return S.rebalance_ratio(transactions(spark, sf), 0.01, mode="downsample_minority").select("txn_id", "isFraud")


_RATIOS = [0.05, 0.005, 0.001, 0.0001]


@register("rebalance_summary", rnd(with_txn("\nUNION ALL\n".join(f"""
SELECT CAST({r} AS DOUBLE) AS target_ratio, count(*) AS n_rows, CAST(sum(isFraud) AS BIGINT) AS n_pos,
       avg(isFraud) AS actual_ratio FROM (
  SELECT isFraud, {_rank_sql('ratio')} AS _rank,
         count(*) FILTER (WHERE isFraud = 1) OVER () AS _n1,
         count(*) FILTER (WHERE isFraud = 0) OVER () AS _n0
  FROM transactions) r
WHERE isFraud = 1 OR _rank < least(floor(_n1 * (1.0 / {r} - 1)), _n0)""" for r in _RATIOS)),
    "target_ratio", "actual_ratio"))
def rebalance_summary(spark, sf):
    """I7 / L1 data side: actual sizes and positive share per target ratio
    (the cap makes low targets collapse to the full table)."""
    t = transactions(spark, sf)
    parts = [S.rebalance_ratio(t, r).agg(F.lit(r).alias("target_ratio"),
                                        F.count(F.lit(1)).alias("n_rows"),
                                        F.sum("isFraud").cast("bigint").alias("n_pos"),
                                        F.avg("isFraud").alias("actual_ratio"))
             for r in _RATIOS]
    return S.union_samples(*parts)


@register("time_split", with_txn("""
SELECT txn_id, step, CASE WHEN step <= (SELECT quantile_cont(step, 0.7) FROM transactions)
                     THEN 'early' ELSE 'late' END AS period FROM transactions"""))
def time_split(spark, sf):
    """I8: early / late at the exact 70th percentile of step."""
    return S.time_split(transactions(spark, sf), 0.7).select("txn_id", "step", "period")


@register("semi_join_ids", rnd(with_txn(f"""
SELECT txn_id, amount FROM transactions WHERE txn_id IN (
  SELECT txn_id FROM (SELECT txn_id, isFraud, {_rank_sql('sample')} AS _rank,
                             count(*) OVER (PARTITION BY isFraud) AS _n FROM transactions) r
  WHERE _rank < floor((_n * 2 + 4) / 8))"""), "amount"))
def semi_join_ids(spark, sf):
    """Rows whose id is in the stratified sample's id set."""
    t = transactions(spark, sf)
    ids = S.stratified_sample(t, 0.25).select("txn_id")
    return S.semi_join_ids(t, ids).select("txn_id", "amount")


@register("hash_shuffle", with_txn(
    f"SELECT txn_id, {_rank_sql('shuffle', None)} AS shuffle_pos FROM transactions"))
def hash_shuffle(spark, sf):
    """Deterministic permutation position of every row."""
    return S.hash_shuffle(transactions(spark, sf)).select("txn_id", "shuffle_pos")


@register("union_samples", with_txn(f"""
SELECT txn_id, isFraud, 'positive' AS part FROM transactions WHERE isFraud = 1
UNION ALL
SELECT txn_id, isFraud, 'negative_sample' FROM (
  SELECT txn_id, isFraud, {_rank_sql('under')} AS _rank FROM transactions WHERE isFraud = 0) r
WHERE _rank < 5000"""))
def union_samples(spark, sf):
    """UNION ALL of the positives and a 5,000-row negative sample."""
    t = transactions(spark, sf)
    pos = t.where(F.col("isFraud") == 1).select("txn_id", "isFraud", F.lit("positive").alias("part"))
    neg = (S.hash_sample_n(t.where(F.col("isFraud") == 0), 5000, salt="under")
           .select("txn_id", "isFraud", F.lit("negative_sample").alias("part")))
    return S.union_samples(pos, neg)
