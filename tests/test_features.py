"""Feature groups: literal edge cases (FIXTURES §4) and plan equivalences."""

import math

import pytest
from pyspark.sql import functions as F

from paysift.operators import features as FE
from paysift.sources.files import save_dataset

SCHEMA = ("txn_id STRING, step INT, type STRING, amount DOUBLE, nameOrig STRING, "
          "oldbalanceOrg DOUBLE, newbalanceOrig DOUBLE, nameDest STRING, oldbalanceDest DOUBLE, "
          "newbalanceDest DOUBLE, isFraud INT")


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_temporal_features(spark):
    steps = [0, 6, 7, 23, 24, 743]
    df = spark.createDataFrame([(s,) for s in steps], "step INT")
    out = {r.step: (r.hour, r.day, r.is_night)
           for r in FE.create_temporal_features(df).collect()}
    assert [out[s] for s in steps] == [(0, 0, 1), (6, 0, 1), (7, 0, 0), (23, 0, 0),
                                       (0, 1, 1), (23, 30, 0)]


def test_log_features_clip(spark):
    df = spark.createDataFrame([(-5.0,), (0.0,), (math.e - 1,)], "amount DOUBLE")
    got = [r.log_amount for r in FE.create_log_features(df, ["amount"]).collect()]
    assert got[0] == 0.0 and got[1] == 0.0 and abs(got[2] - 1.0) < 1e-12


def test_clean_and_validate(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (3.0,), (7.0,),
                                (None,)], "x DOUBLE")
    got = [r.x for r in FE.clean_and_validate(df).collect()]
    assert got == [7.0, 3.0, 0.0, 3.0, 7.0, 0.0]


def test_p95_flag(spark):
    rows = [(f"t{i}", 1, "PAYMENT", a, "C1", 0.0, 0.0, "M1", 0.0, 0.0, 0)
            for i, a in enumerate([1.0, 2.0, 10.0])]
    df = FE.create_type_features(FE.create_basic_features(_rows(spark, rows)))
    p = FE.amount_p95(df).first()[0]
    assert abs(p - 9.2) < 1e-12
    flags = {r.amount: r.high_amount_flag for r in FE.create_interaction_features(df).collect()}
    assert flags == {1.0: 0, 2.0: 0, 10.0: 1}


@pytest.mark.parametrize("strategy", ["join", "window"])
def test_sender_std_single_row_and_null_key(spark, strategy):
    rows = [("a", 1, "PAYMENT", 5.0, "C1", 0.0, 0.0, "M1", 0.0, 0.0, 0),
            ("b", 1, "PAYMENT", 7.0, None, 0.0, 0.0, "M1", 0.0, 0.0, 0),
            ("c", 2, "PAYMENT", 1.0, "C2", 0.0, 0.0, "M1", 0.0, 0.0, 0),
            ("d", 2, "PAYMENT", 3.0, "C2", 0.0, 0.0, "M1", 0.0, 0.0, 0)]
    out = {r.txn_id: r for r in FE.create_sender_features(_rows(spark, rows), strategy).collect()}
    assert out["a"].std_amount_sender == 0.0 and out["a"].txn_count_sender == 1
    assert out["b"].txn_count_sender is None and out["b"].std_amount_sender is None
    assert abs(out["c"].std_amount_sender - math.sqrt(2.0)) < 1e-12


def test_salted_join_equals_plain_join(spark, txn):
    """hot_rows=3 forces the hot-key path (salting + replication) for every
    sender; the result must equal the plain window form."""
    base = FE.drop_leakage(txn)
    a = FE.create_sender_velocity_features(base, hot_rows=3, row_key=["txn_id"])
    b = (base.transform(lambda d: FE.create_sender_features(d, "window"))
             .transform(lambda d: FE.create_velocity_features(d, "window")))
    cols = ["txn_id", "txn_count_sender", "avg_amount_sender", "max_amount_sender",
            "std_amount_sender", "txn_per_step_sender", "amt_per_step_sender"]
    ra = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                for r in a.select(*cols).collect())
    rb = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                for r in b.select(*cols).collect())
    assert len(ra) == base.count() and ra == rb


def test_feature_matrix_plans_agree(spark, txn):
    a = FE.feature_matrix(txn)
    b = FE.feature_matrix(txn, group_strategy="window")
    assert a.columns == b.columns and len(a.columns) == 43
    diff = a.exceptAll(b).count() + b.exceptAll(a).count()
    if diff:  # tolerate last-ulp differences in sums
        ra = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in a.collect())
        rb = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in b.collect())
        assert ra == rb


def test_narrow_types(spark, txn):
    t = {r.column: r.narrow_type for r in FE.narrow_types(txn.drop("txn_id")).collect()}
    assert t["isFraud"] == "tinyint" and t["step"] in ("smallint", "tinyint")


def test_feature_matrix_hot_receivers(spark, txn):
    """hot_rows=50: every receiver (and several senders) takes the salted
    path; the matrix must equal the window plan's."""
    a = FE.feature_matrix(txn, hot_rows=50)
    b = FE.feature_matrix(txn, group_strategy="window")
    ra = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in a.collect())
    rb = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in b.collect())
    assert ra == rb


def test_feature_matrix_window_hot_keys(spark, txn):
    """hot_rows=5: most senders and all receivers take the split path of the window plan."""
    a = FE.feature_matrix(txn, group_strategy="window", hot_rows=5)
    b = FE.feature_matrix(txn)
    ra = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in a.collect())
    rb = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in b.collect())
    assert ra == rb


def test_narrowed_sink(spark, tmp_path):
    rows = [(1, 300, 0.5, None, "a"), (2, -70000, 0.25, None, None), (None, 5, None, None, "b")]
    df = spark.createDataFrame(rows, "a long, b long, c double, d long, e string")
    save_dataset(df, str(tmp_path / "t"), narrow=True)
    back = spark.read.parquet(str(tmp_path / "t"))
    kinds = dict(back.dtypes)
    assert (kinds["a"], kinds["b"], kinds["c"], kinds["e"]) == ("tinyint", "int", "float", "string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    save_dataset(df.withColumn("c", F.lit(0.1)), str(tmp_path / "u"), narrow=True)
    assert dict(spark.read.parquet(str(tmp_path / "u")).dtypes)["c"] == "double"
    save_dataset(df.limit(0), str(tmp_path / "v"), narrow=True)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 0


def test_select_by_type_and_presence(spark):
    df = spark.createDataFrame([("x", 1, 2.0, True)], "k string, a int, b double, y boolean")
    assert FE.select_numeric(df, exclude=["b"], keep=["k"]).columns == ["k", "a"]
    assert FE.select_numeric(df, keep=["a"]).columns == ["a", "b"]
    assert FE.select_existing(df, ["b", "none", "k"]).columns == ["b", "k"]


def test_recomputed_features_follow_their_columns(spark, txn):
    fm = FE.feature_matrix(txn)
    same = FE.recompute_features(fm)
    assert same.columns == fm.columns
    diff = same.join(fm.alias("f"), "txn_id").where(F.abs(same["log_amount"] - F.col("f.log_amount")) > 1e-9).count()
    assert diff == 0
    moved = FE.recompute_features(fm.withColumn("newbalanceOrig", F.lit(0.0)).withColumn("amount", F.lit(9.0)))
    r = moved.select(F.min("is_zero_balance"), F.max(F.abs(F.col("error_orig") - (F.col("oldbalanceOrg") - 9.0))), F.max("log_amount"), F.min("log_amount")).first()
    assert r[0] == 1 and r[1] < 1e-9 and abs(r[2] - math.log(10)) < 1e-12 and r[2] == r[3]


def test_names_are_not_written_with_the_group_features(spark, txn, monkeypatch):
    from paysift.operators import features as FE
    from paysift.sources import files
    written, plain = {}, files.cut_lineage
    monkeypatch.setattr(files, "cut_lineage", lambda df, name="cut": written.update({name: df.columns}) or plain(df, name))
    for strategy in ("join", "window"):
        assert FE.feature_matrix(txn, strategy).count() == txn.count()
        assert "txn_id" in written["group-features"] and not {"nameOrig", "nameDest"} & set(written["group-features"])
