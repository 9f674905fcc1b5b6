"""The scenarios of the suite share what they have in common, and give the rows of single tests."""

import pytest
from pyspark.sql import functions as F

from paysift.functions.core import hash_below, hash_normal, hash_uniform, normal_of
from paysift.operators import metrics as K
from paysift.plans import robustness as R
from paysift.registry import finish
from paysift.sources.schema import TARGET

RAW = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
COLS = ["is_high_risk_type", "is_zero_balance", "log_oldbalanceDest", "log_oldbalanceOrg", *RAW]


@pytest.fixture(scope="module")
def rows(spark):
    x = lambda i, n: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n))
    df = spark.range(600).select(F.col("id").cast("string").alias("txn_id"), (x(1, 5) == 0).cast("int").alias(TARGET), x(2, 40).cast("int").alias("step"), "id",
                                 *[(x(3 + i, 50000) / 1.0).alias(c) for i, c in enumerate(RAW)], x(9, 2).cast("int").alias("is_high_risk_type"))
    return df.withColumns({"is_zero_balance": (F.col("newbalanceOrig") == 0).cast("int"), "log_oldbalanceDest": F.log1p("oldbalanceDest"),
                           "log_oldbalanceOrg": F.log1p("oldbalanceOrg")}).drop("id").cache()


def test_draws_below_a_share(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.col("id").cast("string")).alias("k"))
    for share in (0.0, 0.05, 0.3, 0.5, 1.0, 2 ** -52):
        assert df.where(hash_below(share, F.col("k"), 42, "a", "b") != (hash_uniform(F.col("k"), 42, "a", "b") < share)).count() == 0
    # the bound itself isn't below
    u = df.select(hash_uniform(F.col("k"), 42, "a").alias("u")).where("k = '7'").first()["u"]
    one = df.where("k = '7'")
    assert not one.select(hash_below(u, F.col("k"), 42, "a")).first()[0] and one.select(hash_below(u + 2 ** -52, F.col("k"), 42, "a")).first()[0]
    h = F.md5(F.concat_ws("|", F.col("k"), F.lit("42"), F.lit("x")))
    assert df.where(normal_of(h) != hash_normal(F.col("k"), 42, "x")).count() == 0


def test_suite_scores_a_row_once_for_all_scenarios_that_take_it_as_it_is(rows):
    seen = []

    def scorer(df):
        seen.append(df.count())
        return R.feature_pseudo_scorer(df)

    suite = R.robustness_suite(rows, scorer, 0.5, COLS, COLS, n_adv=20)
    late = rows.where(F.col("step") > 28).count()
    assert len(seen) == 1 and seen[0] < 600 * 10.2 + 20 + 2 * late  # 15 copies of a row and 4 of a late one before
    fm, sc = rows, R.feature_pseudo_scorer
    single = R.consolidated_results(R.baseline(fm, sc, 0.5), R.imbalance_test(fm, sc, 0.5), R.noise_test(fm, sc, 0.5), R.drift_test(fm, sc, 0.5),
                                    R.adversarial_eval(fm, sc, 0.5, 20).withColumns({c: F.col(c).cast("double") for c in ("adv_rows", "adv_detected", "adv_missed")}),
                                    R.corruption_test(fm, sc, 0.5, COLS))
    key = lambda t: {r["scenario"]: r.asDict() for r in finish(t.select(*sorted(t.columns))).collect()}
    a, b = key(suite), key(single)
    assert len(a) == 22 and a == b
    assert a["adversarial_mix"]["adv_rows"] == 20 and a["baseline"]["f1"] > 0


def test_scenarios_write_counts_of_scores(rows, monkeypatch):
    written, plain = [], R._materialise
    monkeypatch.setattr(R, "_materialise", lambda df: written.append(df.columns) or plain(df))
    R.corruption_test(rows, R.feature_pseudo_scorer, 0.5, COLS)
    R.drift_test(rows, R.feature_pseudo_scorer, 0.5)
    assert [c for c in written if "score" in c] == [["scenario", "score", "pos", "neg"]] * 2


def test_metrics_of_counts_are_those_of_rows(spark):
    sc = spark.createDataFrame([("a", 1, .9), ("a", 0, .9), ("a", None, .2), ("a", 1, None), ("b", 1, .4), ("b", 0, .7), ("b", 0, .1)], "g string, label int, score double")
    want = K.compute_metrics(sc, 0.5, ["g"]).orderBy("g").collect()
    assert K.compute_metrics(K.score_counts(sc, ["g"]), 0.5, ["g"], counted=True).orderBy("g").collect() == want


def test_features_are_permuted_a_few_at_a_time(rows, monkeypatch):
    want = R.permutation_importance(rows, R.feature_pseudo_scorer, 0.5, RAW).collect()
    freed = []
    monkeypatch.setattr(R, "PERMUTED", 2)
    monkeypatch.setattr(R, "free_shuffles", freed.append)
    assert R.permutation_importance(rows, R.feature_pseudo_scorer, 0.5, RAW).collect() == want and len(freed) == 3
