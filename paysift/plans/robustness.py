"""Robustness scenarios (L1, L7, L12, L14-L16): perturb a feature table,
re-score it, and evaluate — every scenario is a DataFrame of metrics with a
``scenario`` column, so scenarios union into one consolidated table.

A *scorer* is any ``DataFrame -> DataFrame`` that adds a ``score`` column
(``P(y=1)``): a fitted Spark ML pipeline (``model_scorer``) or the fixed
feature formula ``feature_pseudo_scorer`` (deterministic, SQL-checkable).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import hash_below, hash_key, normal_of
from ..operators import metrics as K
from ..operators import perturb as L
from ..operators import sampling as S
from ..operators.features import recompute_features
from ..session import checkpoint_dir, free_shuffles
from ..sources.schema import TARGET

Scorer = Callable[[DataFrame], DataFrame]

# Imbalance targets, missing-cell rates, adversarial size and
# the sizes of the timed scoring runs (all rows are timed as well).
IMBALANCE_RATIOS = [0.005, 0.001, 0.0001]
MISSING_RATES = [0.0, 0.05, 0.10, 0.20]
N_ADVERSARIAL = 1000
SCORING_SIZES = [10_000, 100_000, 1_000_000]


def model_scorer(model) -> Scorer:
    def f(df: DataFrame) -> DataFrame:
        out = model.transform(df)
        return out.withColumn("score", vector_to_array("probability")[1]) \
                  .drop("features", "rawPrediction", "probability", "prediction")
    return f


def feature_pseudo_scorer(df: DataFrame) -> DataFrame:
    """A fixed logistic formula of feature columns (no training, no hash) over
    what the perturbations touch: type flag, amount and the raw balances."""
    z = (2.5 * F.col("is_high_risk_type") + 1.5 * F.col("is_zero_balance")
         + F.col("amount") / 25000.0 - 0.05 * F.col("log_oldbalanceDest")
         + 0.02 * F.col("log_oldbalanceOrg") - F.col("oldbalanceOrg") / 40000.0
         - F.col("newbalanceOrig") / 20000.0 + F.col("newbalanceDest") / 60000.0
         - F.col("oldbalanceDest") / 60000.0 - 2.5)
    return df.withColumn("score", F.round(1.0 / (1.0 + F.exp(-z)), 3))


def _metrics(scored: DataFrame, threshold, scenario: str, by=()) -> DataFrame:
    m = K.compute_metrics(scored.withColumnRenamed(TARGET, "label"), threshold, list(by))
    return m.withColumn("scenario", F.lit(scenario))


def baseline(features: DataFrame, scorer: Scorer, threshold) -> DataFrame:
    return _metrics(scorer(features), threshold, "baseline")


def _materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: the sample feeding many scenarios is written once to the
    shared checkpoint folder (survives executor loss; never
    ``localCheckpoint``)."""
    from ..sources.files import cut_lineage
    return cut_lineage(df, "scenario-sample")


def _rows(features: DataFrame, n: int | None) -> DataFrame:
    """All rows, or n of them if the caller asks for a sample."""
    return features if n is None else _materialise(S.hash_sample_n(features, n, salt="noise_sample"))


def imbalance_test(features: DataFrame, scorer: Scorer, threshold,
                   ratios=IMBALANCE_RATIOS) -> DataFrame:
    """L1: all positives + negatives resampled to each target share; the
    actual share is reported (the cap makes small targets collapse)."""
    tag = lambda df, name, ratio: df.withColumn("scenario", F.lit(name)).withColumn("target_ratio", F.lit(ratio).cast("double"))
    x = S.union_samples(tag(features, "imbalance_base", None),
                        *[tag(S.rebalance_ratio(features, r), f"imbalance_{r}", r) for r in ratios])
    m = _counted_metrics(_scores(scorer(x), "scenario", "target_ratio"), threshold, ["scenario", "target_ratio"])
    pos = F.col("tp") + F.col("fn")
    return m.withColumn("actual_ratio", pos / (pos + F.col("fp") + F.col("tn")))


def noise_test(features: DataFrame, scorer: Scorer, threshold,
               sample_n: int | None = None, recompute: bool = False,
               exclude_train: DataFrame | None = None, key: str = "txn_id") -> DataFrame:
    """L2 + L13: noise levels on all rows (or on ``sample_n``), all levels in
    one exploded scoring pass; F1/recall degradation vs the same rows
    without noise.  ``recompute``: features derived from the noisy columns
    follow them (otherwise only the raw columns change); ``exclude_train``: keys
    of rows that the scorer was fitted on, which are left out."""
    if exclude_train is not None:
        features = features.join(exclude_train.select(key), key, "left_anti")
    sub = _rows(features, sample_n)
    noisy = {k: v for k, v in L.NOISE_LEVELS.items() if any(v)}  # the others draw nothing
    lv = F.explode(F.array(*[F.struct(F.lit(f"noise_{k}").alias("scenario"), F.lit(k).alias("lvl"),
                                      F.lit(a).alias("sa"), F.lit(b).alias("sb"))
                             for k, (a, b) in noisy.items()]))
    x = sub.withColumn("_l", lv).select("*", "_l.scenario", "_l.lvl", "_l.sa", "_l.sb").drop("_l")
    x = L.noise_inject_by_level(x, "lvl", "sa", "sb")
    parts = [_scores(scorer(recompute_features(x) if recompute else x), "scenario")]
    parts += [_scores(scorer(sub).withColumn("scenario", F.lit(f"noise_{k}")), "scenario") for k in L.NOISE_LEVELS if k not in noisy]
    m = _counted_metrics(S.union_samples(*parts), threshold, ["scenario"])
    return _with_degradation(_materialise(m), "noise_none")


def _scores(scored: DataFrame, *more: str) -> DataFrame:
    """The narrow columns that metrics read."""
    return scored.select(*more, F.col(TARGET).alias("label"), "score")


def _counted_metrics(scores: DataFrame, threshold, by: list[str]) -> DataFrame:
    """``compute_metrics`` of scores that are drawn once: several aggregates read them, so
    their counts per distinct score, never more rows, are written."""
    if not isinstance(threshold, (int, float)):
        return K.compute_metrics(_materialise(scores), threshold, by)
    return K.compute_metrics(_materialise(K.score_counts(scores, by)), threshold, by, counted=True)


def _with_degradation(tab: DataFrame, base_scenario: str) -> DataFrame:
    b = tab.where(F.col("scenario") == base_scenario).select(
        F.col("f1").alias("_bf1"), F.col("recall").alias("_brec"))
    return (tab.crossJoin(F.broadcast(b))
               .withColumn("f1_drop_pct", K.degradation_pct(F.col("_bf1"), F.col("f1")))
               .withColumn("recall_drop_pct", K.degradation_pct(F.col("_brec"), F.col("recall")))
               .drop("_bf1", "_brec"))


def drift_test(features: DataFrame, scorer: Scorer, threshold) -> DataFrame:
    """L3-L5 on the late period (I8): 3x fraud amounts, 30 % zeroed sender
    balances, all-TRANSFER — one union, one grouped metrics pass.
    ``drift_impact`` = baseline F1 − scenario F1."""
    late = S.time_split(features).where(F.col("period") == "late").drop("period")
    base_f1 = baseline(features, scorer, threshold).select(F.col("f1").alias("_bf1"))
    parts = [late.withColumn("scenario", F.lit("drift_none")),
             L.drift_scale(late, 3.0).withColumn("scenario", F.lit("drift_3x_fraud_amount")),
             L.drift_zero(late, 0.3).withColumn("scenario", F.lit("drift_30pct_zero_balance")),
             L.drift_force_type(late).withColumn("scenario", F.lit("drift_all_transfer"))]
    x = S.union_samples(*parts)
    m = _counted_metrics(_scores(scorer(x), "scenario"), threshold, ["scenario"])
    return (m.crossJoin(F.broadcast(base_f1))
             .withColumn("drift_impact", F.col("_bf1") - F.col("f1")).drop("_bf1"))


def adversarial_eval(features: DataFrame, scorer: Scorer, threshold,
                     n_adv: int = N_ADVERSARIAL, base_n: int | None = None) -> DataFrame:
    """All rows (or ``base_n`` sampled ones) + n_adv stealth-fraud rows (flagged
    explicitly); overall metrics plus detected / missed / recall on the
    adversarial rows."""
    adv = L.adversarial_rows(features, n_adv)
    base = features if base_n is None else S.hash_sample_n(features, base_n, salt="adv_base")
    base = base.withColumn("is_adversarial", F.lit(0))
    mix = base.unionByName(adv)
    scored = _scores(scorer(mix), "is_adversarial")
    if isinstance(threshold, (int, float)):
        scored = _materialise(K.score_counts(scored, ["is_adversarial"]))
        both = scored.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        overall = K.compute_metrics(both, threshold, counted=True).withColumn("scenario", F.lit("adversarial_mix"))
        a = _found(scored, threshold)
    else:
        scored = _materialise(scored)
        overall = _metrics(scored.withColumnRenamed("label", TARGET), threshold, "adversarial_mix")
        a = scored.where(F.col("is_adversarial") == 1).agg(
            F.count(F.lit(1)).alias("adv_rows"), F.count_if(F.col("score") >= threshold).alias("adv_detected"))
    return (overall.crossJoin(a)
            .withColumn("adv_missed", F.col("adv_rows") - F.col("adv_detected"))
            .withColumn("adv_recall", F.try_divide(F.col("adv_detected").cast("double"), F.col("adv_rows"))))


def _found(counts: DataFrame, threshold: float) -> DataFrame:
    """(adv_rows, adv_detected) of score counts by ``is_adversarial``."""
    n = F.col("pos") + F.col("neg")
    return counts.where(F.col("is_adversarial") == 1).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("adv_rows"), F.coalesce(F.sum(F.when(F.col("score") >= F.lit(float(threshold)), n)), F.lit(0)).alias("adv_detected"))


def corruption_test(features: DataFrame, scorer: Scorer, threshold, feature_cols: list[str],
                    sample_n: int | None = None) -> DataFrame:
    """L8-L11 + L13: missing cells at each rate (zero-filled), swapped and
    zeroed balances, 10 % within-column shuffle — F1 drop vs no corruption.
    One union, one grouped metrics pass."""
    sub = _rows(features, sample_n)
    parts = [L.mask_missing(sub, r, feature_cols).withColumn("scenario", F.lit(f"missing_{r}"))
             for r in MISSING_RATES]
    parts += [L.swap_columns(sub).withColumn("scenario", F.lit("swap_balances")),
              L.zero_columns(sub).withColumn("scenario", F.lit("zero_balances")),
              L.shuffle_subset(sub, 0.10).withColumn("scenario", F.lit("shuffle_10pct"))]
    x = S.union_samples(*parts)
    m = _counted_metrics(_scores(scorer(x), "scenario"), threshold, ["scenario"])
    return _with_degradation(_materialise(m), "missing_0.0")


def feature_sensitivity(features: DataFrame, scorer: Scorer, threshold, feature_cols: list[str],
                        sample_n: int | None = None) -> DataFrame:
    """Zero one feature at a time and re-score — ONE scoring pass over
    all rows exploded by feature (plus the unmodified copy as
    the baseline), not a driver loop of 41 jobs; F1 drop % per feature,
    sorted descending."""
    sub = _rows(features, sample_n)
    names = ["__none__"] + list(feature_cols)
    x = sub.withColumn("zeroed_feature", F.explode(F.array(*[F.lit(c) for c in names])))
    x = x.withColumns({c: F.when(F.col("zeroed_feature") == c, F.lit(0).cast(sub.schema[c].dataType))
                       .otherwise(F.col(c)) for c in feature_cols})
    m = K.threshold_metrics(scorer(x).withColumnRenamed(TARGET, "label"), threshold, ["zeroed_feature"])
    base = m.where(F.col("zeroed_feature") == "__none__").select(F.col("f1").alias("_bf1"))
    return (m.where(F.col("zeroed_feature") != "__none__").crossJoin(F.broadcast(base))
             .select(F.col("zeroed_feature").alias("feature"), "f1", "recall",
                     K.degradation_pct(F.col("_bf1"), F.col("f1")).alias("f1_drop_pct"))
             .orderBy(F.desc("f1_drop_pct"), "feature"))


#: Features whose values are permuted at a time.
PERMUTED = 6


def _permuted(sub: DataFrame, placed: DataFrame, some: list[tuple[int, str]], scorer: Scorer, threshold, key: str, seed: int) -> DataFrame:
    """Metrics per feature of ``some`` when its values are permuted; ``placed``: the rows with their place ``_pos``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for i, c in some]))
    src = sub.select(key, pairs.alias("p")).select(F.col("p.f").alias("f"), F.col("p.v").alias("v"),
                                                   hash_key(F.concat_ws("|", F.col(key), F.col("p.c")), seed, "perm_src").alias("h"))
    src = src.select("f", "v", F.unhex("h").alias("h"), F.conv(F.substring("h", 1, 3), 16, 10).cast("int").alias("b"))
    upto = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = src.groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
    counts = _materialise(counts.select("f", "b", (F.sum("n").over(upto) - F.col("n")).alias("off")))  # 4,096 rows per feature
    src = src.withColumn("i", F.row_number().over(Window.partitionBy("f", "b").orderBy("h"))).join(F.broadcast(counts), ["f", "b"])
    moved = src.select((F.col("off") + F.col("i") - 1).alias("_pos"), F.struct("f", "v").alias("p"))
    moved = moved.groupBy("_pos").agg(F.array_sort(F.collect_list("p")).alias("_moved"))
    names = F.create_map(*[x for i, c in some for x in (F.lit(i), F.lit(c))])
    y = placed.join(moved, "_pos").withColumn("_m", F.explode("_moved")).withColumns({"permuted_feature": F.element_at(names, F.col("_m.f")), "_pv": F.col("_m.v")})
    y = y.withColumns({c: F.when(F.col("permuted_feature") == c, F.col("_pv").cast(sub.schema[c].dataType))
                       .otherwise(F.col(c)) for _, c in some}).drop("_pv", "_pos", "_m", "_moved")
    return K.threshold_metrics(scorer(y).withColumnRenamed(TARGET, "label"), threshold, ["permuted_feature"])


def permutation_importance(features: DataFrame, scorer: Scorer, threshold,
                           feature_cols: list[str], sample_n: int | None = None,
                           key: str = "txn_id", seed: int = 42) -> DataFrame:
    """M10 for any model: F1 drop when one feature's values are permuted
    across the sample (the others untouched), for every feature at once.

    Per feature the rows' values are ranked by a hash of ``row|feature`` (two-level:
    counts of 4,096 hash buckets per feature give offsets, rows are ranked inside a
    bucket) and each value is sent, alone, to the row of that place; the values of
    a place are collected, joined with its row once, and exploded by feature there:
    no wide row is shuffled per feature.  ``PERMUTED`` features go at a time, their
    shuffles are freed before the next ones: the disk that is used doesn't grow with
    the number of features.  Metrics are grouped by feature."""
    sub = _rows(features, sample_n)
    placed = _materialise(S.hash_rank(sub, [], key, seed, "perm_pos", rank_col="_pos"))
    parts = []
    for a in range(0, len(feature_cols), PERMUTED):
        some = list(enumerate(feature_cols))[a:a + PERMUTED]
        parts.append(_materialise(_permuted(sub, placed, some, scorer, threshold, key, seed)))  # a row per feature
        free_shuffles(sub.sparkSession)
    m = S.union_samples(*parts)
    base = _metrics(scorer(sub), threshold, "base").select(F.col("f1").alias("_bf1"))
    return (m.crossJoin(F.broadcast(base))
             .select(F.col("permuted_feature").alias("feature"), "f1", "recall",
                     K.degradation_pct(F.col("_bf1"), F.col("f1")).alias("f1_drop_pct"))
             .orderBy(F.desc("f1_drop_pct"), "feature"))


#: Scenarios that all rows are in, those of the late period, and the rows' variants: a
#: variant has its own values, every other scenario takes a row as it is.
_EVERYWHERE = ["baseline", "imbalance_base", *[f"noise_{k}" for k in L.NOISE_LEVELS], *[f"missing_{r}" for r in MISSING_RATES],
               "swap_balances", "zero_balances", "shuffle_10pct", "adversarial_mix"]
_DRIFTS = ["drift_none", "drift_3x_fraud_amount", "drift_30pct_zero_balance", "drift_all_transfer"]
_NOISY = [f"noise_{k}" for k, v in L.NOISE_LEVELS.items() if any(v)]
_CHANGED = [*_NOISY, *[f"missing_{r}" for r in MISSING_RATES if r > 0], "swap_balances", "zero_balances", "shuffle_10pct", *_DRIFTS[1:]]


def _scenario_columns(columns: list[str], feature_cols: list[str], kinds: dict, key: str, seed: int) -> tuple[dict, dict, dict]:
    """Per column: the hash of its noise, the noisy value before its repair, and the value in each
    variant (``_v``: its number in ``_CHANGED`` from 1 on, 0: as it is)."""
    number = {name: i + 1 for i, name in enumerate(_CHANGED)}
    at = lambda name: F.col("_v") == number[name]
    noisy, levels = F.col("_v").between(1, len(_NOISY)), [x.removeprefix("noise_") for x in _NOISY]  # the first ones
    hashed, drawn, value = {}, {}, {}
    for c in columns:
        cases = []
        if c == "amount" or c in L.BALANCE_COLS:
            level = F.get(F.array(*map(F.lit, levels)), F.col("_v") - 1)
            sigma = F.get(F.array(*[F.lit(float(L.NOISE_LEVELS[k][0 if c == "amount" else 1])) for k in levels]), F.col("_v") - 1)
            hashed[f"_h_{c}"] = F.when(noisy, hash_key(F.col(key), seed, "noise", level, c))
            drawn[f"_d_{c}"] = F.when(noisy, F.greatest(F.col(c) * (1 + sigma * normal_of(F.col(f"_h_{c}"))), F.lit(0.0)))
            cases.append((noisy, L._finite_or_zero(F.col(f"_d_{c}"))))
        if c == "amount":
            cases.append((at("drift_3x_fraud_amount"), F.when(F.col(TARGET) == 1, F.col(c) * 3.0).otherwise(F.col(c))))
        if c in ("oldbalanceOrg", "newbalanceOrig"):
            cases.append((at("drift_30pct_zero_balance"), F.lit(0.0)))  # rows that are drawn alone have the variant
        if c.startswith("type_") or c == "is_high_risk_type":
            cases.append((at("drift_all_transfer"), F.lit(int(c in ("type_TRANSFER", "is_high_risk_type")))))
        if c in feature_cols:
            for r in MISSING_RATES:
                if r > 0:
                    kept = F.when(~hash_below(r, F.col(key), seed, "missing", str(r), c), F.col(c))
                    cases.append((at(f"missing_{r}"), F.coalesce(kept, F.lit(0.0).cast(kinds[c]))))
        swap = {"oldbalanceOrg": "oldbalanceDest", "oldbalanceDest": "oldbalanceOrg", "newbalanceOrig": "newbalanceDest", "newbalanceDest": "newbalanceOrig"}
        if c in swap:
            cases.append((at("swap_balances"), F.col(swap[c])))
        if c in L.BALANCE_COLS:
            cases.append((at("zero_balances"), F.lit(0).cast(kinds[c])))
        if c in ("amount", "oldbalanceOrg"):
            cases.append((at("shuffle_10pct"), F.col(f"_new_{c}")))  # rows of the subset alone have the variant
        if cases:
            chain = F.when(*cases[0])
            for cond, v in cases[1:]:
                chain = chain.when(cond, v)
            value[c] = chain.otherwise(F.col(c)).cast(kinds[c])
    return hashed, drawn, value


def _by_scenario(counts: DataFrame) -> DataFrame:
    """Score counts by variant and flags as those by scenario."""
    bit = lambda i: (-F.col("scenario")).bitwiseAND(F.lit(1 << i)) > 0
    as_is = [x for x in _EVERYWHERE if x not in _CHANGED]
    some = lambda cond, *names: F.when(cond, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.array(*map(F.lit, as_is)), some(~bit(1), "shuffle_10pct"), some(bit(0), "drift_none"), some(bit(0) & ~bit(2), "drift_3x_fraud_amount"),
                     some(bit(0) & ~bit(3), "drift_30pct_zero_balance"), *[some(bit(4 + i), f"imbalance_{r}") for i, r in enumerate(IMBALANCE_RATIOS)])
    names = (F.when(F.col("is_adversarial") == 1, F.array(F.lit("adversarial_mix")))
              .when(F.col("scenario") > 0, F.array(F.get(F.array(*map(F.lit, _CHANGED)), F.col("scenario") - 1))).otherwise(names))
    return (counts.select(F.explode(names).alias("scenario"), "score", "pos", "neg").groupBy("scenario", "score")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def robustness_suite(features: DataFrame, scorer: Scorer, threshold: float, columns: list[str], feature_cols: list[str],
                     n_adv: int = N_ADVERSARIAL, key: str = "txn_id", seed: int = 42) -> DataFrame:
    """All scenarios of L1-L11 (rows of ``consolidated_results``) in one pass.

    The ``columns`` that the scorer reads are written once with what the scenarios
    need of a row (kept at each ratio, late or not, shuffled values); its rows are
    then exploded by variant, each column taking its variant's value, and scored.
    Scenarios that take a row as it is share its score: counts per variant, flags
    of the row and distinct score are written, and dealt to the scenarios."""
    columns = list(dict.fromkeys([*columns, "amount", *L.BALANCE_COLS]))  # swaps read all balances
    stored = _materialise(features.select(key, TARGET, "step", *[c for c in columns if c != "step"]))
    kinds = {f.name: f.dataType for f in stored.schema}
    base = S.time_split(stored).withColumn("_late", F.col("period") == "late").drop("period")
    for i, r in enumerate(IMBALANCE_RATIOS):
        base = S.rebalance_flag(base, stored, r, f"_keep{i}", key=key, seed=seed)
    base = L.in_subset(base, stored, 0.10, key, seed)
    shuffled = ("amount", "oldbalanceOrg")
    moved = _materialise(L.shuffled_values(stored.select(key, *shuffled), 0.10, shuffled, key, seed)[1])
    none = {f"_new_{c}": F.lit(None).cast(kinds[c]) for c in shuffled}
    base = _materialise(base.where("_in").join(moved, key).unionByName(base.where("not _in").withColumns(none)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    late, moves, grows = yes(F.col("_late")), yes(F.col("_in")), yes(F.col(TARGET) == 1)
    zeroed = late & hash_below(0.3, F.col(key), seed, "drift_zero")
    # What a row's scenarios as it is depend on, one bit each.
    bits = [late, moves, late & grows, zeroed, *[yes(F.col(f"_keep{i}")) for i in range(len(IMBALANCE_RATIOS))]]
    flags = reduce(lambda a, b: a + b, [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(bits)])
    own = {"shuffle_10pct": moves, "drift_3x_fraud_amount": late & grows, "drift_30pct_zero_balance": zeroed, "drift_all_transfer": late}
    none = F.array().cast("array<int>")
    variants = F.concat(F.array(F.lit(0), *[F.lit(i + 1) for i, c in enumerate(_CHANGED) if c not in own]),
                        *[F.when(own[c], F.array(F.lit(i + 1))).otherwise(none) for i, c in enumerate(_CHANGED) if c in own])
    hashed, drawn, value = _scenario_columns(columns, feature_cols, kinds, key, seed)
    rows = base.withColumn("_flags", flags).withColumn("_v", F.explode(variants)).withColumns(hashed).withColumns(drawn).withColumns(value)
    # Named by the variant's number, or below it by the flags of a row that is as it was.
    rows = rows.select(F.when(F.col("_v") > 0, F.col("_v")).otherwise(-F.col("_flags")).alias("scenario"), F.lit(0).alias("is_adversarial"), TARGET, *columns)
    adv = L.adversarial_rows(base, n_adv, key=key, seed=seed).withColumn("scenario", F.lit(0))
    scored = scorer(rows.unionByName(adv.select("scenario", "is_adversarial", F.col(TARGET).cast(kinds[TARGET]).alias(TARGET), *[F.col(c).cast(kinds[c]).alias(c) for c in columns])))
    counts = _materialise(K.score_counts(_scores(scored, "scenario", "is_adversarial"), ["scenario", "is_adversarial"]))
    m = _materialise(K.compute_metrics(_by_scenario(counts), threshold, ["scenario"], counted=True))  # a row per scenario
    found = _found(counts, threshold).select(F.col("adv_rows").cast("double").alias("_rows"), F.col("adv_detected").cast("double").alias("_hit"))
    f1 = {s: m.where(F.col("scenario") == s).select(F.col("f1").alias(f"_f_{i}"), F.col("recall").alias(f"_r_{i}")) for i, s in enumerate(("baseline", "noise_none", "missing_0.0"))}
    for t in (*f1.values(), found):
        m = m.crossJoin(F.broadcast(t))  # one row each
    starts = lambda *p: reduce(or_, [F.col("scenario").startswith(x) for x in p])
    corrupted = starts("missing_") | F.col("scenario").isin("swap_balances", "zero_balances", "shuffle_10pct")
    drop = lambda k: F.when(starts("noise_"), K.degradation_pct(F.col(f"_{k[0]}_1"), F.col(k))).when(corrupted, K.degradation_pct(F.col(f"_{k[0]}_2"), F.col(k)))
    mix, positives = F.col("scenario") == "adversarial_mix", F.col("tp") + F.col("fn")
    ratio = F.coalesce(*[F.when(F.col("scenario") == f"imbalance_{r}", F.lit(float(r))) for r in IMBALANCE_RATIOS])
    return m.select("scenario", "recall", "precision", "f1", "roc_auc", "pr_auc", "fpr", "tp", "fp", "fn", "tn", ratio.alias("target_ratio"),
                    F.when(starts("imbalance_"), positives / (positives + F.col("fp") + F.col("tn"))).alias("actual_ratio"),
                    drop("f1").alias("f1_drop_pct"), drop("recall").alias("recall_drop_pct"),
                    F.when(starts("drift_"), F.col("_f_0") - F.col("f1")).alias("drift_impact"),
                    F.when(mix, F.col("_rows")).alias("adv_rows"), F.when(mix, F.col("_hit")).alias("adv_detected"),
                    F.when(mix, F.col("_rows") - F.col("_hit")).alias("adv_missed"), F.when(mix, F.try_divide(F.col("_hit"), F.col("_rows"))).alias("adv_recall"))


def consolidated_results(*tables: DataFrame) -> DataFrame:
    """Union of ragged scenario tables by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def risk_flags(consolidated: DataFrame, base_f1: float | None = None) -> DataFrame:
    """Worst-recall scenario, largest |F1 − baseline F1|, and the flags
    'any recall < .70' and 'any drift recall < .80'."""
    b = consolidated.where(F.col("scenario") == "baseline").select(F.col("f1").alias("_bf1"))
    j = consolidated.crossJoin(F.broadcast(b))
    return j.agg(
        F.min_by("scenario", F.struct("recall", "scenario")).alias("worst_recall_scenario"),
        F.min("recall").alias("worst_recall"),
        F.max_by("scenario", F.struct(F.abs(F.col("f1") - F.col("_bf1")), F.col("scenario")))
         .alias("max_f1_deviation_scenario"),
        F.max(F.abs(F.col("f1") - F.col("_bf1"))).alias("max_f1_deviation"),
        F.max((F.col("recall") < 0.70).cast("int")).alias("any_recall_below_70"),
        F.max(F.when(F.col("scenario").startswith("drift"), (F.col("recall") < 0.80).cast("int"))
              .otherwise(0)).alias("any_drift_recall_below_80"))


def scoring_throughput(features: DataFrame, scorer: Scorer, sizes=SCORING_SIZES) -> DataFrame:
    """Wall time of scoring n rows into a no-op sink (after one warm-up
    call), per size and for all rows: seconds, ms/row, rows/s."""
    spark = SparkSession.getActiveSession()
    checkpoint_dir(spark)
    scorer(S.hash_sample_n(features, 100, salt="warmup")).write.format("noop").mode("overwrite").save()
    n_total = features.count()
    rows = []
    for n in sorted({min(n, n_total) for n in sizes} | {n_total}):
        k = n
        # Materialise the sample first (reliable checkpoint in the shared
        # checkpoint dir) so only scoring is timed.
        d = _materialise(S.hash_sample_n(features, k, salt="throughput")) if k < n_total else features
        t0 = time.time()
        scorer(d).write.format("noop").mode("overwrite").save()
        sec = time.time() - t0
        rows.append((n, k, sec, sec * 1000.0 / max(k, 1), k / sec if sec > 0 else None))
    return spark.createDataFrame(rows, "requested_rows BIGINT, rows BIGINT, seconds DOUBLE, "
                                       "ms_per_row DOUBLE, rows_per_sec DOUBLE")
