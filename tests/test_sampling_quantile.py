"""Sampling invariants, exact quantiles, perturbation properties, profiles."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from paysift.functions.quantile import quantiles
from paysift.operators import perturb as L
from paysift.operators import profile as P
from paysift.operators import sampling as S
from paysift.plans.prefix import hash_rank


def test_hash_rank_equals_row_number(spark, txn):
    r = hash_rank(txn, ["isFraud"], "txn_id", 42, "t").select("txn_id", "_rank")
    h = F.md5(F.concat_ws("|", F.col("txn_id"), F.lit("42"), F.lit("t")))
    w = Window.partitionBy("isFraud").orderBy(h, "txn_id")
    o = txn.select("txn_id", (F.row_number().over(w) - 1).alias("_rank"))
    assert r.exceptAll(o).count() == 0 and r.count() == o.count()


def test_split_disjoint_exhaustive_and_quota(spark, txn):
    sp = S.train_test_split(txn, 0.2)
    assert sp.count() == txn.count()
    assert sp.select("txn_id").distinct().count() == txn.count()
    c = {(r.isFraud, r.split): r["count"] for r in sp.groupBy("isFraud", "split").count().collect()}
    # ceil(0.2 n) test rows in all, each class within one row of its share
    assert c[(0, "test")] + c[(1, "test")] == -(-txn.count() * 2 // 10)
    for lab in (0, 1):
        n = c[(lab, "test")] + c[(lab, "train")]
        assert n * 2 // 10 <= c[(lab, "test")] <= -(-n * 2 // 10)


def test_stratified_sample_quota(spark, txn):
    s = S.stratified_sample(txn, 0.25)
    got = dict(s.groupBy("isFraud").count().collect())
    full = dict(txn.groupBy("isFraud").count().collect())
    for k, n in full.items():
        assert got[k] == (2 * n + 4) // 8


def test_folds_balanced(spark, txn):
    f = S.stratified_folds(txn, 5).groupBy("isFraud", "fold").count().collect()
    by = {}
    for r in f:
        by.setdefault(r.isFraud, []).append(r["count"])
    for sizes in by.values():
        assert max(sizes) - min(sizes) <= 1


def test_rebalance_cap(spark):
    rows = [(f"p{i}", 1) for i in range(10)] + [(f"n{i}", 0) for i in range(5000)]
    df = spark.createDataFrame(rows, "txn_id STRING, isFraud INT")
    a = S.rebalance_ratio(df, 0.005)
    assert a.where("isFraud = 0").count() == 1990
    b = S.rebalance_ratio(df, 0.001)
    assert b.where("isFraud = 0").count() == 5000 and b.count() == 5010


@pytest.mark.parametrize("shape", ["ints", "mixed_sign", "hot_value"])
def test_quantiles_exact(spark, shape):
    rnd = random.Random(7)
    if shape == "ints":
        vals = [float(rnd.randint(0, 50)) for _ in range(3000)]
    elif shape == "mixed_sign":
        vals = ([rnd.uniform(-1e6, 1e6) for _ in range(2000)] + [0.0, -0.0, 1e-310, -1e-310, 2.0 ** 40]
                + [rnd.random() * 1e-9 for _ in range(200)])
    else:
        vals = [42.5] * 2500 + [rnd.gauss(42.5, 1e-6) for _ in range(300)] + [7.0]
    rows = [("a", v) for v in vals] + [("b", rnd.random()) for _ in range(777)] + [("c", 5.0)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE")
    qs = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    got = {(r.g, r.qi): r.value for r in quantiles(df, "x", qs, by=["g"]).collect()}
    exact = df.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(q) for q in qs])).alias("p")).collect()
    for r in exact:
        for i, v in enumerate(r.p):
            assert abs(got[(r.g, i)] - v) <= 1e-9 * max(1.0, abs(v)), (r.g, qs[i], got[(r.g, i)], v)
    glob = {r.qi: r.value for r in quantiles(df, "x", qs).collect()}
    ex = df.agg(F.percentile("x", F.array(*[F.lit(q) for q in qs])).alias("p")).first().p
    assert all(abs(glob[i] - v) <= 1e-9 * max(1.0, abs(v)) for i, v in enumerate(ex))


def test_log_keys_monotone(spark):
    from paysift.functions.quantile import with_log_keys
    vals = sorted({float("-inf"), -1e300, -3.5, -1.0, -1e-310, 0.0, 1e-310, 2.2250738585072014e-308,
                   0.5, 1.0, 1.0000000000000002, 2.0, 3.0, 1023.9999, 1024.0, 1e300, float("inf")})
    df = spark.createDataFrame([(v,) for v in vals], "x DOUBLE")
    rows = with_log_keys(df, "x").orderBy("x").collect()
    k = [(r._k1, r._k2) for r in rows]
    assert all(a <= b for a, b in zip(k, k[1:]))
    assert k[0][0] < 0 < k[-1][0] and rows[[r.x for r in rows].index(0.0)]._k1 == 0


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x DOUBLE")
    h = P.histogram(df, "x", bins=10)
    counts = {r.bin: r["count"] for r in h.collect()}
    assert counts[9] == 2 and sum(counts.values()) == 11 and len(counts) == 10


def test_constant_column_corr_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a DOUBLE, b DOUBLE")
    r = {(x.col_a, x.col_b): x.r for x in P.correlation_matrix(df, ["a", "b"]).collect()}
    assert r[("a", "b")] is None and r[("b", "b")] == pytest.approx(1.0)


def test_shuffle_subset_properties(spark, txn):
    base = txn.select("txn_id", "amount", "oldbalanceOrg")
    out = L.shuffle_subset(base, 0.10)
    for c in ("amount", "oldbalanceOrg"):
        assert sorted(r[0] for r in base.select(c).collect()) == sorted(r[0] for r in out.select(c).collect())
    changed = out.join(base.withColumnRenamed("amount", "a0").withColumnRenamed("oldbalanceOrg", "o0"), "txn_id") \
                 .where("amount <> a0 OR oldbalanceOrg <> o0").count()
    assert changed <= (txn.count() // 10)


def test_hash_randomness_matches_sql(spark):
    import duckdb
    from paysift.functions.core import hash_normal, hash_uniform
    from paysift.oracle import normal, u
    ids = [f"id{i}" for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "txn_id STRING")
    s = {r.txn_id: (r.u, r.z) for r in df.select(
        "txn_id", hash_uniform(F.col("txn_id"), 42, "x").alias("u"),
        hash_normal(F.col("txn_id"), 42, "y").alias("z")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(txn_id VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(i,) for i in ids])
    ku = "concat_ws('|', txn_id, '42', 'x')"
    kz = "concat_ws('|', txn_id, '42', 'y')"
    q = f"SELECT txn_id, {u(ku)} AS u, {normal(kz)} AS z FROM t"
    for tid, uu, zz in con.execute(q).fetchall():
        assert s[tid][0] == uu and abs(s[tid][1] - zz) < 1e-12


def test_permutation_importance_properties(spark, txn):
    """Permuting a feature the scorer ignores changes nothing; a feature it
    uses moves F1."""
    from paysift.operators.features import feature_matrix
    from paysift.plans import robustness as R
    fm = feature_matrix(txn)
    out = {r.feature: r.f1_drop_pct for r in R.permutation_importance(
        fm, R.feature_pseudo_scorer, 0.5, ["day", "is_high_risk_type"]).collect()}
    assert out["day"] == 0.0
    assert out["is_high_risk_type"] != 0.0
