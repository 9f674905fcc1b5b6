"""The steps that the model and robustness queries share, against plain versions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paysift.operators import boosting as B
from paysift.operators import features as FE
from paysift.plans import robustness as R
from paysift.plans.skew import attach_nested_aggregates


@pytest.mark.parametrize("hot_rows", [40, 10_000])
def test_nested_aggregates(spark, hot_rows):
    """Every fifth row has one key, with a step of half its rows; some keys and steps are null."""
    i = F.col("id")
    key = F.when(i % 5 == 0, F.lit("hot")).when(i % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), i % 83))
    df = spark.range(4000).select(i.alias("txn_id"), key.alias("k"), F.when(i % 10 == 0, 3).when(i % 11 != 0, i % 29).cast("int").alias("s"), (i % 17).cast("double").alias("x"))
    a, b = {"n": F.count("x"), "m": F.max("x")}, {"nn": F.count("x"), "t": F.sum("x")}
    got = attach_nested_aggregates(df, "k", a, "s", b, hot_rows, ["txn_id"])
    per = lambda keys, aggs: df.dropna(subset=keys).groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    want = df.join(per(["k"], a), "k", "left").join(per(["k", "s"], b), ["k", "s"], "left").select(got.columns)
    assert got.columns == [*df.columns, "n", "m", "nn", "t"] and got.count() == 4000
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_matrix_is_a_projection_of_a_stored_table(spark, txn):
    plan = FE.feature_matrix(txn)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_permuted_values_are_those_of_the_hash_ranks(spark):
    n, cols = 70, ["a", "b", "c"]
    rows = [(f"t{i}", float(i % 13), float(i * 7 % 31), float(i % 3), int(i * 7 % 31 + i % 13 > 22)) for i in range(n)]
    df = spark.createDataFrame(rows, "txn_id string, a double, b double, c double, isFraud int")
    scorer = lambda d: d.withColumn("score", F.when(F.col("a") + F.col("b") + F.col("c") > 22, 0.9).otherwise(0.1))
    md5 = lambda *x: hashlib.md5("|".join(x).encode()).hexdigest()
    got = {r["feature"]: r for r in R.permutation_importance(df, scorer, 0.5, cols).collect()}
    assert sorted(got) == cols
    places = sorted(range(n), key=lambda i: md5(f"t{i}", "42", "perm_pos"))

    def f1(x):
        hit = [sum(v) > 22 for v in x]
        tp = sum(h and r[4] for h, r in zip(hit, rows, strict=True))
        return 2 * tp / (sum(hit) + sum(r[4] for r in rows))

    base = f1([r[1:4] for r in rows])
    for j, c in enumerate(cols):
        source = sorted(range(n), key=lambda i: md5(f"t{i}|{c}", "42", "perm_src"))
        x = [list(r[1:4]) for r in rows]
        for to, at in zip(places, source, strict=True):
            x[to][j] = rows[at][1 + j]
        assert abs(got[c]["f1"] - f1(x)) < 1e-12
        assert abs(got[c]["f1_drop_pct"] - (base - f1(x)) / base * 100) < 1e-9


def test_columns_of_the_same_codes_share_a_histogram():
    r = np.random.RandomState(3)
    codes = r.randint(0, 8, (500, 4)).astype(np.uint8)
    codes[:, 3] = codes[:, 1]
    distinct, like = B._distinct(codes, np.arange(4))
    assert distinct == [0, 1, 2] and like.tolist() == [0, 1, 2, 1]
    y = (codes[:, 1] > 3).astype(float)
    p = B.DEFAULTS | {"max_depth": 3}
    a = B.grow(codes, 0.5 - y, np.full(500, 0.25), np.arange(4), p, 8)
    assert a["feature"][0] == 1 and a["bin"][0] == 3  # the first of equals
    assert np.sign(B.walk(a, codes)).tolist() == np.where(y == 1, 1.0, -1.0).tolist()
