"""Quotas, hot keys and buckets at sizes that the small tables don't reach."""

from pyspark.sql import functions as F

from paysift.operators import sampling as S
from paysift.operators.metrics import auc_scores, score_cumulants
from paysift.plans.prefix import below_quota, hash_rank
from paysift.plans.skew import attach_group_aggregates


def test_split_matches_published_size(spark):
    df = spark.range(1_588_602 + 2_053).select(F.when(F.col("id") < 2_053, 1).otherwise(0).alias("isFraud"))
    assert {r["isFraud"]: r["_quota"] for r in S.split_quotas(df, 0.2, "isFraud").collect()} == {0: 317_720, 1: 411}


def test_quotas_do_not_overflow(spark):
    n = spark.range(1).select(F.lit(20_000_000_000).alias("n"))
    assert n.select(S.round_quota(F.col("n"), 0.333333333)).first()[0] == 6_666_666_660
    assert n.select(S.ceil_quota(F.col("n"), 0.2)).first()[0] == 4_000_000_000


def test_below_quota_is_the_rank(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("txn_id"), (F.col("id") % 7 == 0).cast("int").alias("g"),
                                  F.lit("wide").alias("_h2"))
    ranked = {r["txn_id"]: r["_rank"] for r in hash_rank(df, ["g"], seed=1, salt="x").collect()}
    for quota in ({0: 0, 1: 5}, {0: 700, 1: 10 ** 9}):
        q = spark.createDataFrame(list(quota.items()), "g int, _quota long")
        got = below_quota(df, q, ["g"], seed=1, salt="x").collect()
        assert len(got) == 3000
        assert all(r["_in"] == (ranked[r["txn_id"]] < quota[r["g"]]) for r in got)


def test_sample_filter_is_below_the_exchange(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("txn_id"), F.lit(0).alias("isFraud"), F.lit("x").alias("payload"))
    plan = S.hash_sample_n(df, 10)._jdf.queryExecution().executedPlan().toString()
    exchanged = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x]
    assert all("payload" not in x for x in exchanged)


def test_null_keys_are_spread(spark):
    df = spark.range(40_000).select(F.col("id").alias("txn_id"), F.when(F.col("id") % 2 == 0, F.col("id") % 50).alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach_group_aggregates(df, ["k"], {"n": F.count(F.lit(1))}, row_key=["txn_id"])
        sizes = [r["count"] for r in out.where("k is null").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / 8
        assert out.where("k is null and n is not null").count() == 0
        assert out.where("k is not null and n <> 800").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_score_buckets_near_zero_and_above_one(spark):
    rows = [(1e-9 * (i + 1), int(i % 10 == 0)) for i in range(500)] + [(1.0 + i, int(i % 3 == 0)) for i in range(200)] + [(0.0, 0), (0.0, 1)]
    df = spark.createDataFrame(rows, "score double, label int")
    got = auc_scores(df).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got["roc_auc"] - auc) < 1e-12
    assert score_cumulants(df).agg(F.max("cpos"), F.max("cneg")).first() == (len(pos), len(neg))


def test_window_form_splits_hot_keys(spark):
    """A third of the rows has one key, another third none: no window partition is far above the mean."""
    df = spark.range(30_000).select(
        F.col("id").alias("txn_id"), (F.col("id") % 97).cast("double").alias("x"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 500)).alias("k"))
    aggs = {"n": F.count("x"), "s": F.sum("x"), "m": F.max("x")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = attach_group_aggregates(df, ["k"], aggs, "window", hot_rows=200, row_key=["txn_id"])
        assert out.columns == [*df.columns, *aggs]
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 2 * 30_000 / 8
        want = df.join(df.groupBy("k").agg(*[e.alias(n) for n, e in aggs.items()]), "k", "left").select(out.columns)
        assert out.exceptAll(want).count() == want.exceptAll(out).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
