"""Fits of every model family, and files with bad lines and missing keys."""

import pytest
from pyspark.sql import functions as F

from paysift.operators import models as M
from paysift.operators.sampling import stratified_folds
from paysift.sources import files as IO
from paysift.sources.schema import TARGET

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def train(spark):
    x = F.col("id")
    df = spark.range(240).select(x.cast("string").alias("txn_id"), (x % 13).cast("double").alias("a"), (x % 7).cast("double").alias("b"))
    return df.withColumn(TARGET, (F.col("a") + F.col("b") > 10).cast("int")).withColumn("weight", F.lit(1.0)).cache()


def test_every_family_fits(train):
    for pipe in (M.logistic_pipeline(COLS, "weight"), M.forest_pipeline(COLS, 5, 4, "weight"), M.gbt_pipeline(COLS, 5, 3, weight_col="weight")):
        m, _ = M.fit(pipe, train)
        assert M.accuracy(M.score(m, train, "m")).first()["accuracy"] > 0.85


def test_search_draws_differ(train):
    folds = stratified_folds(train, 2)
    _, res = M.random_search(M.forest_pipeline(COLS), {"numTrees": [2, 3], "maxDepth": [2]}, 9, folds, k=2)
    assert sorted(r["params"] for r in res.collect()) == ["numTrees=2;maxDepth=2", "numTrees=3;maxDepth=2"]


def test_importances_side_by_side(train):
    a, _ = M.fit(M.forest_pipeline(COLS, 5, 4), train)
    b, _ = M.fit(M.gbt_pipeline(COLS, 3, 3), train)
    got = M.compare_importances(M.feature_importances(a, COLS, "rf"), M.feature_importances(b, COLS, "gbt"), top=1)
    assert got.count() == 1 and {"importance_rf", "rank_gbt"} <= set(got.columns)


def test_bad_csv_line_is_kept_apart(spark, tmp_path):
    from paysift.sources.schema import TXN_SCHEMA
    names = [f.name for f in TXN_SCHEMA.fields]
    numbers = [str(f.dataType.simpleString()) for f in TXN_SCHEMA.fields]
    good = ",".join("x" if t == "string" else "1" for t in numbers)
    (tmp_path / "t.csv").write_text("\n".join([",".join(names), good, ",".join(["bad"] * len(names))]) + "\n")
    got = IO.read_transactions_csv(spark, str(tmp_path / "t.csv")).cache()
    assert got.where(F.col(IO.CORRUPT).isNull()).count() == 1
    assert got.where(F.col(IO.CORRUPT).isNotNull()).first()[IO.CORRUPT].startswith("bad")


def test_threshold_default(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"other": 1}\n')
    (tmp_path / "b.json").write_text('{"optimal_threshold": 0.35}\n')
    assert IO.read_threshold(spark, str(tmp_path / "a.json")).first()[0] == IO.DEFAULT_THRESHOLD
    assert IO.read_threshold(spark, str(tmp_path / "b.json")).first()[0] == 0.35
