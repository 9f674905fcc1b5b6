"""Evaluation operators: FIXTURES §4 literals and published golden arithmetic."""

import pytest
from pyspark.sql import functions as F

from paysift.operators import metrics as K


def _scores(spark, pairs, model="m"):
    return spark.createDataFrame([(model, l, s) for l, s in pairs], "model STRING, label INT, score DOUBLE")


def test_roc_and_ap_four_rows(spark):
    sc = _scores(spark, [(1, .9), (0, .8), (1, .8), (0, .1)])
    r = K.auc_scores(sc, ["model"]).first()
    assert abs(r.roc_auc - 0.875) < 1e-12
    assert abs(r.pr_auc - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-12


def test_auc_one_class_is_null(spark):
    r = K.auc_scores(_scores(spark, [(0, .2), (0, .7)]), ["model"]).first()
    assert r.roc_auc is None and r.pr_auc is None


def test_auc_symmetry(spark, txn):
    """AUC(1 - s) = 1 - AUC(s) on real rows (bucketed prefix path)."""
    from paysift.plans.robustness import feature_pseudo_scorer
    from paysift.operators.features import feature_matrix
    s = feature_pseudo_scorer(feature_matrix(txn)).select(
        F.lit("m").alias("model"), F.col("isFraud").alias("label"), "score")
    a = K.auc_scores(s, ["model"]).first().roc_auc
    b = K.auc_scores(s.withColumn("score", 1 - F.col("score")), ["model"]).first().roc_auc
    assert abs(a + b - 1) < 1e-9


def test_no_predicted_positives(spark):
    m = K.threshold_metrics(_scores(spark, [(1, .1), (0, .2)]), 0.5, ["model"]).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)


def test_golden_confusion_spark(spark):
    rows = ([(1, .9)] * 409 + [(0, .9)] * 16 + [(1, .05)] * 2 + [(0, .05)] * 50)
    m = K.threshold_metrics(_scores(spark, rows), 0.10, ["model"]).first()
    assert (round(m.recall, 6), round(m.precision, 6), round(m.f1, 6)) == (0.995134, 0.962353, 0.978469)


def test_sweep_matches_direct(spark, txn):
    from paysift.plans.q_metrics import pseudo_scores
    sc = pseudo_scores(spark, "/root/testdata/sf0.001").where(F.col("model") == "pseudo_a")
    sw = {round(r.threshold, 2): (r.tp, r.fp) for r in K.threshold_sweep(sc).collect()}
    for t in (0.1, 0.5, 0.9):
        d = K.confusion_counts(sc, t).first()
        assert sw[t] == (d.tp, d.fp)


def test_optimal_threshold_rules(spark):
    sw = spark.createDataFrame([
        ("a", 0.10, 0.9, 0.25, 0.4), ("a", 0.15, 0.9, 0.30, 0.45), ("a", 0.20, 0.5, 0.5, 0.5),
        ("b", 0.10, 0.9, 0.05, 0.09), ("b", 0.15, 0.8, 0.10, 0.2), ("b", 0.20, 0.5, 0.15, 0.2),
        ("c", 0.10, 0.0, 0.0, 0.0)], "model STRING, threshold DOUBLE, recall DOUBLE, precision DOUBLE, f1 DOUBLE")
    got = {r.model: (r.optimal_threshold, r.rule) for r in K.optimal_threshold(sw, ["model"]).collect()}
    assert got["a"] == (0.10, "max_recall_at_precision")   # equal max recall -> lower threshold
    assert got["b"] == (0.15, "max_f1")                     # no precision >= .2 -> first max F1
    assert got["c"] == (0.5, "default")


@pytest.mark.parametrize("gap,status", [(0.049, "OK"), (0.05, "WARN"), (0.10, "OVERFIT"), (-0.2, "OVERFIT")])
def test_overfit_status(spark, gap, status):
    r = spark.range(1).select(K.overfit_status(F.lit(gap)).alias("s")).first()
    assert r.s == status


def test_select_model_fallback(spark):
    cmp = spark.createDataFrame([("x", 0.5, 0.2), ("y", 0.7, 0.15)], "model STRING, f1 DOUBLE, gap DOUBLE")
    r = K.select_model(cmp).first()
    assert (r.selected_model, r.rule) == ("y", "max_f1")
    cmp2 = spark.createDataFrame([("x", 0.5, 0.01), ("y", 0.7, 0.15)], "model STRING, f1 DOUBLE, gap DOUBLE")
    assert K.select_model(cmp2).first().selected_model == "x"


def test_degradation_zero_base(spark):
    r = spark.range(1).select(K.degradation_pct(F.lit(0.0), F.lit(0.3)).alias("d"),
                              K.degradation_pct(F.lit(0.5), F.lit(0.25)).alias("e")).first()
    assert r.d == 0.0 and r.e == 50.0
