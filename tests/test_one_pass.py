"""Tiles, shared bucket tables and entity counts against plain versions."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from paysift.functions.quantile import Buckets
from paysift.operators import profile as P
from paysift.plans.prefix import hash_ntile, hash_rank


@pytest.mark.parametrize("k", [1, 2, 5, 9])
def test_tiles_are_those_of_the_rank(spark, k):
    df = spark.range(701).select(F.col("id").cast("string").alias("txn_id"), F.when(F.col("id") < 4, None).otherwise((F.col("id") % 90 == 0).cast("int")).alias("g"), F.lit("wide").alias("_h2"))
    ranked = {r["txn_id"]: (r["_rank"], r["_n"]) for r in hash_rank(df, ["g"], seed=3, salt="x", size_col="_n").collect()}
    got = hash_ntile(df, k, ["g"], seed=3, salt="x", name="t")
    assert got.columns == [*df.columns, "t"]
    rows = got.collect()
    assert len(rows) == 701
    for r in rows:
        rank, n = ranked[r["txn_id"]]
        large, size = n % k, n // k
        assert r["t"] == (rank // (size + 1) if rank < large * (size + 1) else large + (rank - large * (size + 1)) // size)


def test_no_wide_row_is_shuffled_for_tiles(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("txn_id"), F.lit(0).alias("g"), F.lit("x").alias("payload"))
    plan = hash_ntile(df, 5, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert all("payload" not in x for x in plan.split("\n") if "Exchange hashpartitioning" in x or "Exchange rangepartitioning" in x)


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(2)
    rows = [(r.choice([None, "a", "b", "c", "d"]), r.choice([None, "b", "x"]), r.choice([None, float("nan"), 0.0, -5.5, 1e9 + r.random(), r.gauss(0, 3)]), r.gauss(1e6, 1)) for _ in range(900)]
    return spark.createDataFrame(rows, "nameOrig string, nameDest string, u double, v double").repartition(4).cache()


def test_moments_and_quantiles_from_one_table(table):
    b = Buckets(P.long_form(table, ["u", "v"]), "value", ["column"], moments=True)
    got = {r["column"]: r for r in b.moments().collect()}
    q = {r["column"]: r for r in b.quantile_row({"p10": 0.1, "p50": 0.5}).collect()}
    for c in ("u", "v"):
        x = [r[c] for r in table.collect() if r[c] is not None and not math.isnan(r[c])]
        assert got[c]["count"] == len(x) and got[c]["min"] == min(x) and got[c]["max"] == max(x)
        assert math.isclose(got[c]["mean"], statistics.fmean(x), rel_tol=1e-12) and math.isclose(got[c]["std"], np.std(x, ddof=1), rel_tol=1e-9)
        assert math.isclose(q[c]["p10"], np.quantile(x, 0.1), rel_tol=1e-9, abs_tol=1e-12) and math.isclose(q[c]["p50"], np.quantile(x, 0.5), rel_tol=1e-9, abs_tol=1e-12)


def test_describe_and_fences_share_their_passes(table):
    described, fences = P.column_profile(table, ["v"], [0.25, 0.75], quartiles=True)
    d, f = described.first(), P.iqr_outliers(table, ["v"], fences).first()
    assert (d["p25"], d["p75"]) == (f["q1"], f["q3"]) and P.iqr_outliers(table, ["v"]).first() == f
    assert f["n_outliers"] == sum(not f["lower"] <= r["v"] <= f["upper"] for r in table.collect())


def test_distinct_counts_without_expand(table):
    stats, senders, receivers, both = P.entity_profile(table, 2)
    want = {r["column"]: (r["n_unique"], r["avg_txn_per_entity"]) for r in P.entity_stats(table).collect()}
    assert want == {r["column"]: (r["n_unique"], r["avg_txn_per_entity"]) for r in stats.collect()} == {"nameOrig": (4, 225.0), "nameDest": (2, 450.0)}
    for c, top in (("nameOrig", senders), ("nameDest", receivers)):
        assert top.collect() == P.top_entities(table, c, 2).collect()
    assert both.first()[0] == P.entity_overlap(table).first()[0] == 1
    assert "Expand" not in P.entity_stats(table)._jdf.queryExecution().executedPlan().toString()


def test_histogram_of_known_ranges(table):
    plain = P.histogram(table, "v", bins=7).orderBy("bin").collect()
    known = table.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count("v").alias("_n"))
    assert plain == P.histogram(table, "v", bins=7, ranges=known).orderBy("bin").collect()
    x = [r["v"] for r in table.collect()]
    assert [r["count"] for r in plain] == np.histogram(x, 7)[0].tolist()


def test_clipped_histogram_computes_its_source_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    names = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
    raw = spark.range(200).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(c) for i, c in enumerate(names)], (F.col("id") % 5 == 0).cast("int").alias("isFraud"))
    out = P.histogram_clipped(raw.mapInArrow(counted, raw.schema), bins=4).collect()
    assert rows.value == 200
    assert sum(r["count"] for r in out) == 400


def test_adversarial_rows_read_the_shared_matrix(spark, monkeypatch):
    from paysift.plans import q_models
    from paysift.registry import QUERIES
    asked, table = [], q_models.feature_table
    monkeypatch.setattr(q_models, "feature_table", lambda s, d: asked.append(d) or table(s, d))
    assert QUERIES["adversarial_rows"](spark, "/root/testdata/sf0.001").count() == 1000
    assert len(asked) == 1
