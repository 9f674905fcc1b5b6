"""Evaluation operators K1-K12 on a ``(group..., label, score)`` table.

Every operator takes optional group keys ``by`` (model, split, scenario) so
one pass evaluates many models/scenarios.  Curves and AUCs are exact:

* scores are reduced to distinct values with positive/negative counts
  (partial aggregation), then cumulated in descending score order with a
  two-level prefix sum — per (group, score bucket) totals (256 buckets per
  octave, so scores near 0 and above 1 are spread as well as those between)
  give bucket offsets, and only the distinct scores of one bucket share a
  window partition;
* ROC-AUC is the trapezoid / Mann–Whitney sum with half credit for ties;
  PR-AUC is average precision Σ ΔR·P with no interpolation (not Spark's
  trapezoidal ``areaUnderPR``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import join_null_safe
from ..functions.quantile import with_log_keys


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0 when undefined (sklearn ``zero_division=0``)."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


# --- K1 / K2 -------------------------------------------------------------------

def confusion_counts(scores: DataFrame, threshold, by=(), label: str = "label",
                     score: str = "score") -> DataFrame:
    """K1: tp, fp, fn, tn at ``score >= threshold`` (a number or a column,
    e.g. a per-model threshold joined in)."""
    by = list(by)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(score) >= t
    y = F.col(label) == 1
    return scores.groupBy(*by).agg(
        F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
        F.count_if(~pred & y).alias("fn"), F.count_if(~pred & ~y).alias("tn"))


def with_rates(counts: DataFrame) -> DataFrame:
    """K2: recall, precision, F1 (0 when undefined) and FPR from counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (counts.withColumn("recall", _div0(tp, tp + fn))
                  .withColumn("precision", _div0(tp, tp + fp))
                  .withColumn("f1", _div0(2 * tp, 2 * tp + fp + fn))
                  .withColumn("fpr", _div0(fp, fp + tn)))


def threshold_metrics(scores: DataFrame, threshold, by=(), label="label", score="score") -> DataFrame:
    return with_rates(confusion_counts(scores, threshold, by, label, score))


# --- K3 - K6 -------------------------------------------------------------------

def score_counts(scores: DataFrame, by=(), label: str = "label", score: str = "score") -> DataFrame:
    """A row per group and distinct score (NULL is one) with ``pos, neg``: what
    the curves and metrics need of the rows."""
    return scores.groupBy(*by, score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).cast("bigint").alias("neg"))


def score_cumulants(scores: DataFrame, by=(), label: str = "label", score: str = "score", counted: bool = False) -> DataFrame:
    """Distinct scores per group with ``pos, neg`` and inclusive cumulative
    counts ``cpos, cneg`` in descending score order, plus group totals
    ``P, N``.  ``counted``: ``scores`` is a table of ``score_counts`` by ``by``."""
    by = list(by)
    d = scores.where(F.col(score).isNotNull())
    d = (d if counted else score_counts(d, by, label, score)).select(*by, F.col(score).alias("_s"), "pos", "neg")
    d = with_log_keys(d, "_s").withColumnRenamed("_k1", "_b").drop("_k2")
    bt = d.groupBy(*by, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wdesc = (Window.partitionBy(*by).orderBy(F.desc("_b"))
                   .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    wall = Window.partitionBy(*by)
    bt = (bt.withColumn("_op", F.sum("_bp").over(wdesc) - F.col("_bp"))
            .withColumn("_on", F.sum("_bn").over(wdesc) - F.col("_bn"))
            .withColumn("P", F.sum("_bp").over(wall))
            .withColumn("N", F.sum("_bn").over(wall))
            .drop("_bp", "_bn"))
    win = (Window.partitionBy(*by, "_b").orderBy(F.desc("_s"))
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (join_null_safe(d, bt, by + ["_b"])
             .withColumn("cpos", F.col("_op") + F.sum("pos").over(win))
             .withColumn("cneg", F.col("_on") + F.sum("neg").over(win))
             .select(*by, F.col("_s").alias("threshold"), "pos", "neg", "cpos", "cneg", "P", "N"))


def auc_scores(scores: DataFrame, by=(), label="label", score="score") -> DataFrame:
    """K3 + K4: ``roc_auc`` (ties half credit) and ``pr_auc`` (average
    precision); NULL when a group has only one class."""
    c = score_cumulants(scores, by, label, score)
    roc_term = F.col("neg") * ((F.col("cpos") - F.col("pos")) + F.col("pos") * 0.5)
    ap_term = F.col("pos") * (F.col("cpos") / (F.col("cpos") + F.col("cneg")))
    g = c.groupBy(*by).agg(F.sum(roc_term).alias("_roc"), F.sum(ap_term).alias("_ap"),
                           F.max("P").alias("_P"), F.max("N").alias("_N"))
    ok = (F.col("_P") > 0) & (F.col("_N") > 0)
    return g.select(*by,
                    F.when(ok, F.col("_roc") / (F.col("_P").cast("double") * F.col("_N"))).alias("roc_auc"),
                    F.when(ok, F.col("_ap") / F.col("_P")).alias("pr_auc"))


def roc_curve(scores: DataFrame, by=(), label="label", score="score") -> DataFrame:
    """K5: (threshold, fpr, tpr) at every distinct score."""
    c = score_cumulants(scores, by, label, score)
    return c.select(*by, "threshold", _div0(F.col("cneg"), F.col("N")).alias("fpr"),
                    _div0(F.col("cpos"), F.col("P")).alias("tpr"))


def pr_curve(scores: DataFrame, by=(), label="label", score="score") -> DataFrame:
    """K6: (threshold, precision, recall) at every distinct score."""
    c = score_cumulants(scores, by, label, score)
    return c.select(*by, "threshold",
                    _div0(F.col("cpos"), F.col("cpos") + F.col("cneg")).alias("precision"),
                    _div0(F.col("cpos"), F.col("P")).alias("recall"))


# --- K7 / K8 -------------------------------------------------------------------

def sweep_grid(start: float = 0.10, stop: float = 0.91, step: float = 0.05) -> list[float]:
    """``start + i·step`` for i while < stop (NumPy ``arange`` values)."""
    out, i = [], 0
    while start + i * step < stop:
        out.append(start + i * step)
        i += 1
    return out


def threshold_sweep(scores: DataFrame, thresholds=None, by=(), label="label",
                    score="score") -> DataFrame:
    """K7: recall / precision / F1 at every threshold of the grid in ONE
    pass: rows are bucketed by how many thresholds they reach, the ≤ len+1
    buckets per group are counted, and suffix sums give each threshold."""
    by = list(by)
    ts = sweep_grid() if thresholds is None else list(thresholds)
    k = sum((F.col(score) >= F.lit(t)).cast("int") for t in ts)
    g = scores.groupBy(*by, k.alias("_k")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold"))
                               for i, t in enumerate(ts)]))
    x = g.select("*", grid.alias("_t")).select(*by, "_k", "_pos", "_neg", "_t.i", "_t.threshold")
    c = x.groupBy(*by, "i", "threshold").agg(
        F.sum(F.when(F.col("_k") > F.col("i"), F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_k") > F.col("i"), F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("_k") <= F.col("i"), F.col("_pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("_k") <= F.col("i"), F.col("_neg")).otherwise(0)).alias("tn"))
    return with_rates(c).select(*by, "threshold", "recall", "precision", "f1", "tp", "fp", "fn", "tn")


def optimal_threshold(sweep: DataFrame, by=(), min_precision: float = 0.20,
                      default: float = 0.5) -> DataFrame:
    """K8: the lowest threshold with the highest recall among those with
    precision >= min_precision (and recall > 0); otherwise the lowest
    threshold with the highest F1 (> 0); otherwise ``default``.  The sweep
    has ≤ 17 rows per group, so the arg-max runs over a bounded list."""
    by = list(by)
    ok = (F.col("precision") >= min_precision) & (F.col("recall") > 0)
    g = sweep.groupBy(*by).agg(
        F.min_by(F.struct(F.col("threshold")),
                 F.when(ok, F.struct(-F.col("recall"), F.col("threshold")))).alias("_r"),
        F.min_by(F.struct(F.col("threshold")),
                 F.when(F.col("f1") > 0, F.struct(-F.col("f1"), F.col("threshold")))).alias("_f"),
        F.max(F.when(ok, F.col("recall"))).alias("best_recall"),
        F.max("f1").alias("best_f1"))
    thr = F.coalesce(F.col("_r.threshold"), F.col("_f.threshold"), F.lit(default))
    rule = (F.when(F.col("_r").isNotNull(), F.lit("max_recall_at_precision"))
             .when(F.col("_f").isNotNull(), F.lit("max_f1")).otherwise(F.lit("default")))
    return g.select(*by, thr.alias("optimal_threshold"), rule.alias("rule"))


# --- K9 - K12 ------------------------------------------------------------------

def compute_metrics(scores: DataFrame, threshold, by=(), label="label", score="score", counted: bool = False) -> DataFrame:
    """Recall, precision, F1, ROC-AUC, PR-AUC, FPR, tp, fp, fn, tn per
    group, in ONE pass over the rows: the confusion counts at ``threshold``
    are read off the distinct-score table that the AUCs need anyway.

    ``threshold`` is a number, or the NAME of a column that is constant
    within each group (e.g. a per-model threshold joined in).  (The
    reference zeroes all counts when only one class occurs in both labels
    and predictions; true counts are kept here.)  ``counted``: ``scores`` is a
    table of ``score_counts`` by ``by``, and the threshold a number."""
    by = list(by)
    if isinstance(threshold, Column):
        m = threshold_metrics(scores, threshold, by, label, score)
        a = auc_scores(scores, by, label, score)
        j = m.join(a, by, "left") if by else m.crossJoin(a)
        return j.select(*by, "recall", "precision", "f1", "roc_auc", "pr_auc", "fpr",
                        "tp", "fp", "fn", "tn")
    keys = by + ([threshold] if isinstance(threshold, str) else [])
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    c = score_cumulants(scores, keys, label, score, counted)
    roc_term = F.col("neg") * ((F.col("cpos") - F.col("pos")) + F.col("pos") * 0.5)
    ap_term = F.col("pos") * (F.col("cpos") / (F.col("cpos") + F.col("cneg")))
    hit = F.col("threshold") >= t
    g = c.groupBy(*keys).agg(
        F.sum(roc_term).alias("_roc"), F.sum(ap_term).alias("_ap"),
        F.max("P").alias("_P"), F.max("N").alias("_N"),
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).cast("bigint").alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).cast("bigint").alias("fp"))
    ok = (F.col("_P") > 0) & (F.col("_N") > 0)
    g = (g.withColumn("fn", (F.col("_P") - F.col("tp")).cast("bigint"))
          .withColumn("tn", (F.col("_N") - F.col("fp")).cast("bigint"))
          .withColumn("roc_auc", F.when(ok, F.col("_roc") / (F.col("_P").cast("double") * F.col("_N"))))
          .withColumn("pr_auc", F.when(ok, F.col("_ap") / F.col("_P"))))
    return with_rates(g).select(*by, "recall", "precision", "f1", "roc_auc", "pr_auc", "fpr",
                                "tp", "fp", "fn", "tn")


def overfit_check(scores: DataFrame, thresholds: DataFrame, model: str = "model",
                  split: str = "split", label="label", score="score") -> DataFrame:
    """Train vs test recall at each model's threshold; gap = train −
    test; status OK (|gap| < .05), WARN (< .10), else OVERFIT."""
    s = scores.join(F.broadcast(thresholds.select(model, "optimal_threshold")), model)
    m = threshold_metrics(s, F.col("optimal_threshold"), [model, split], label, score)
    p = m.groupBy(model).agg(
        F.max(F.when(F.col(split) == "train", F.col("recall"))).alias("train_recall"),
        F.max(F.when(F.col(split) == "test", F.col("recall"))).alias("test_recall"))
    gap = F.col("train_recall") - F.col("test_recall")
    return p.withColumn("gap", gap).withColumn("status", overfit_status(F.col("gap")))


def overfit_status(gap: Column) -> Column:
    g = F.abs(gap)
    return F.when(g < 0.05, F.lit("OK")).when(g < 0.10, F.lit("WARN")).otherwise(F.lit("OVERFIT"))


def select_model(comparison: DataFrame, model: str = "model", gap: str = "gap",
                 f1: str = "f1") -> DataFrame:
    """The max-F1 model among |gap| < 0.10, else the max-F1 model
    overall (model name breaks ties).  One row."""
    ok = F.abs(F.col(gap)) < 0.10
    g = comparison.agg(
        F.min_by(F.col(model), F.when(ok, F.struct(-F.col(f1), F.col(model)))).alias("_stable"),
        F.min_by(F.col(model), F.struct(-F.col(f1), F.col(model))).alias("_any"))
    return g.select(F.coalesce("_stable", "_any").alias("selected_model"),
                    F.when(F.col("_stable").isNotNull(), F.lit("stable_max_f1"))
                     .otherwise(F.lit("max_f1")).alias("rule"))


def degradation_pct(base: Column, x: Column) -> Column:
    """(base − x) / base · 100, 0 when base = 0."""
    return F.when(base == 0, F.lit(0.0)).otherwise((base - x) / base * 100)
