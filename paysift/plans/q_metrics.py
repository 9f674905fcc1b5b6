"""Registered evaluation queries (K1-K12) on a deterministic pseudo-score.

The scores table needs no trained model, so every metric has an exact SQL
twin: two fixed score formulas of row-wise features plus hash noise,
rounded to 3 dp so that ties occur (ROC tie handling is exercised).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import hash_uniform
from ..operators import metrics as K
from ..operators import sampling as S
from ..oracle import SPLIT_CTES, rnd, u, with_txn
from ..registry import ORACLES, register
from ..sources.transactions import transactions

# The two pseudo-score formulas (weights of row-wise signals).
PSEUDO_MODELS = {
    "pseudo_a": (2.5, 1.5, 25000.0, 2.0, -4.0),
    "pseudo_b": (1.0, 3.0, 50000.0, 3.0, -3.5),
}
GRID = K.sweep_grid()


def pseudo_scores(spark, sf) -> DataFrame:
    """scores(model, split, txn_id, label, score) for both pseudo models."""
    t = S.train_test_split(transactions(spark, sf), 0.2)
    parts = []
    for name, (w_risk, w_zero, amt_scale, w_noise, bias) in PSEUDO_MODELS.items():
        z = (F.lit(w_risk) * F.col("type").isin("TRANSFER", "CASH_OUT").cast("double")
             + F.lit(w_zero) * (F.col("newbalanceOrig") == 0).cast("double")
             + F.col("amount") / F.lit(amt_scale)
             + F.lit(w_noise) * (hash_uniform(F.col("txn_id"), 42, name) - 0.5)
             + F.lit(bias))
        s = F.round(1.0 / (1.0 + F.exp(-z)), 3)
        parts.append(t.select(F.lit(name).alias("model"), "split", "txn_id",
                              F.col("isFraud").alias("label"), s.alias("score")))
    return S.union_samples(*parts)


def _scores_sql() -> str:
    split = ("CASE WHEN row_number() OVER (PARTITION BY isFraud ORDER BY "
             "md5(concat_ws('|', txn_id, '42', 'split')), txn_id) - 1 "
             "< quota THEN 'test' ELSE 'train' END")
    parts = []
    for name, (w_risk, w_zero, amt_scale, w_noise, bias) in PSEUDO_MODELS.items():
        uu = u(f"concat_ws('|', txn_id, '42', '{name}')")
        z = (f"({w_risk} * CAST(type IN ('TRANSFER', 'CASH_OUT') AS DOUBLE) "
             f"+ {w_zero} * CAST(newbalanceOrig = 0 AS DOUBLE) + amount / {amt_scale} "
             f"+ {w_noise} * ({uu} - 0.5) + ({bias}))")
        parts.append(f"SELECT '{name}' AS model, split, txn_id, isFraud AS label, "
                     f"round(1.0 / (1.0 + exp(-{z})), 3) AS score FROM tt")
    return (f"{SPLIT_CTES},\ntt AS (SELECT *, {split} AS split FROM transactions JOIN k USING (isFraud)),\n"
            f"sc AS ({' UNION ALL '.join(parts)})")


SC = _scores_sql()


def _q(body: str, *dcols) -> str:
    return rnd(with_txn(body, SC), *dcols)


_CUM = """d AS (SELECT model, split, score AS threshold, CAST(sum(label) AS BIGINT) AS pos,
          CAST(count(*) - sum(label) AS BIGINT) AS neg FROM sc GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS cpos, sum(neg) OVER w AS cneg,
          sum(pos) OVER (PARTITION BY model, split) AS P, sum(neg) OVER (PARTITION BY model, split) AS N
      FROM d WINDOW w AS (PARTITION BY model, split ORDER BY threshold DESC
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_AUC = """SELECT model, split,
  CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(neg * ((cpos - pos) + pos * 0.5)) / (max(P) * 1.0 * max(N)) END AS roc_auc,
  CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (cpos * 1.0 / (cpos + cneg))) / max(P) END AS pr_auc
FROM c GROUP BY model, split"""
_COUNTS = """SELECT model, split, count(*) FILTER (WHERE score >= {t} AND label = 1) AS tp,
  count(*) FILTER (WHERE score >= {t} AND label <> 1) AS fp,
  count(*) FILTER (WHERE score < {t} AND label = 1) AS fn,
  count(*) FILTER (WHERE score < {t} AND label <> 1) AS tn FROM {src} GROUP BY model, split"""
_RATES = """coalesce(tp * 1.0 / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(tp * 1.0 / nullif(tp + fp, 0), 0.0) AS precision,
  coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1,
  coalesce(fp * 1.0 / nullif(fp + tn, 0), 0.0) AS fpr"""


def _cum_ctes():
    a, b = _CUM.split(",\nc AS ")
    return [a, "c AS " + b]


@register("confusion_counts", _q(_COUNTS.format(t=0.5, src="sc")))
def confusion_counts(spark, sf):
    """K1 per (model, split) at 0.5."""
    return K.confusion_counts(pseudo_scores(spark, sf), 0.5, ["model", "split"])


@register("threshold_metrics", _q(
    f"SELECT *, {_RATES} FROM ({_COUNTS.format(t=0.5, src='sc')}) k",
    "recall", "precision", "f1", "fpr"))
def threshold_metrics(spark, sf):
    """K2 per (model, split) at 0.5."""
    return K.threshold_metrics(pseudo_scores(spark, sf), 0.5, ["model", "split"])


@register("roc_auc", rnd(with_txn(f"SELECT model, split, roc_auc FROM ({_AUC}) a", SC, *_cum_ctes()),
                         "roc_auc"))
def roc_auc(spark, sf):
    """K3: exact ROC-AUC (ties half credit) per (model, split)."""
    return K.auc_scores(pseudo_scores(spark, sf), ["model", "split"]).select("model", "split", "roc_auc")


@register("average_precision", rnd(with_txn(f"SELECT model, split, pr_auc FROM ({_AUC}) a", SC, *_cum_ctes()),
                                   "pr_auc"))
def average_precision(spark, sf):
    """K4: average precision per (model, split)."""
    return K.auc_scores(pseudo_scores(spark, sf), ["model", "split"]).select("model", "split", "pr_auc")


@register("roc_curve", rnd(with_txn(
    "SELECT model, split, threshold, coalesce(cneg * 1.0 / nullif(N, 0), 0.0) AS fpr, "
    "coalesce(cpos * 1.0 / nullif(P, 0), 0.0) AS tpr FROM c", SC, *_cum_ctes()),
    "threshold", "fpr", "tpr"))
def roc_curve(spark, sf):
    """K5: ROC points at every distinct score."""
    return K.roc_curve(pseudo_scores(spark, sf), ["model", "split"])


@register("pr_curve", rnd(with_txn(
    "SELECT model, split, threshold, coalesce(cpos * 1.0 / nullif(cpos + cneg, 0), 0.0) AS precision, "
    "coalesce(cpos * 1.0 / nullif(P, 0), 0.0) AS recall FROM c", SC, *_cum_ctes()),
    "threshold", "precision", "recall"))
def pr_curve(spark, sf):
    """K6: precision-recall points at every distinct score."""
    return K.pr_curve(pseudo_scores(spark, sf), ["model", "split"])


def _sweep_sql(src="sc"):
    return "\nUNION ALL\n".join(
        f"SELECT model, split, CAST({t!r} AS DOUBLE) AS threshold, {_RATES.replace(' AS fpr', ' AS _fpr')}, "
        f"tp, fp, fn, tn FROM ({_COUNTS.format(t=repr(t), src=src)}) k" for t in GRID)


@register("threshold_sweep", _q(
    "SELECT model, split, threshold, recall, precision, f1, tp, fp, fn, tn FROM ("
    + _sweep_sql() + ")", "threshold", "recall", "precision", "f1"))
def threshold_sweep(spark, sf):
    """K7: the 17-threshold sweep in one pass per (model, split)."""
    return K.threshold_sweep(pseudo_scores(spark, sf), GRID, ["model", "split"])


_OPT = f"""sw AS (SELECT * FROM ({_sweep_sql()}) x WHERE split = 'test'),
opt AS (SELECT model,
  coalesce(
    arg_min(threshold, (-recall, threshold)) FILTER (WHERE precision >= 0.2 AND recall > 0),
    arg_min(threshold, (-f1, threshold)) FILTER (WHERE f1 > 0),
    0.5) AS optimal_threshold,
  CASE WHEN count(*) FILTER (WHERE precision >= 0.2 AND recall > 0) > 0 THEN 'max_recall_at_precision'
       WHEN count(*) FILTER (WHERE f1 > 0) > 0 THEN 'max_f1' ELSE 'default' END AS rule
  FROM sw GROUP BY model)"""


def _test_sweep(spark, sf):
    sc = pseudo_scores(spark, sf)
    return sc, K.threshold_sweep(sc.where(F.col("split") == "test"), GRID, ["model"])


@register("optimal_threshold", rnd(with_txn("SELECT * FROM opt", SC, _OPT), "optimal_threshold"))
def optimal_threshold(spark, sf):
    """K8: threshold choice per model from the test-split sweep."""
    _, sw = _test_sweep(spark, sf)
    return K.optimal_threshold(sw, ["model"])


ORACLES["threshold_json"] = f"SELECT optimal_threshold FROM ({ORACLES['optimal_threshold']}) WHERE model = 'pseudo_a'"


@register("compute_metrics", rnd(with_txn(
    f"SELECT k.model, k.split, {_RATES}, a.roc_auc, a.pr_auc, tp, fp, fn, tn "
    f"FROM ({_COUNTS.format(t=0.5, src='sc')}) k JOIN ({_AUC}) a ON k.model = a.model AND k.split = a.split",
    SC, *_cum_ctes()), "recall", "precision", "f1", "roc_auc", "pr_auc", "fpr"))
def compute_metrics(spark, sf):
    """The 10-field metric bundle per (model, split) at 0.5."""
    return K.compute_metrics(pseudo_scores(spark, sf), 0.5, ["model", "split"])


_CMP = f"""cmp AS (
  SELECT k.model, {_RATES}, a.roc_auc, a.pr_auc, k.tp, k.fp, k.fn, k.tn, o.optimal_threshold
  FROM (SELECT s.model, s.split,
          count(*) FILTER (WHERE score >= o.optimal_threshold AND label = 1) AS tp,
          count(*) FILTER (WHERE score >= o.optimal_threshold AND label <> 1) AS fp,
          count(*) FILTER (WHERE score < o.optimal_threshold AND label = 1) AS fn,
          count(*) FILTER (WHERE score < o.optimal_threshold AND label <> 1) AS tn
        FROM sc s JOIN opt o ON s.model = o.model GROUP BY s.model, s.split) k
  JOIN opt o ON k.model = o.model
  JOIN ({_AUC}) a ON k.model = a.model AND k.split = a.split
  WHERE k.split = 'test')"""


def _model_comparison(spark, sf):
    sc, sw = _test_sweep(spark, sf)
    opt = K.optimal_threshold(sw, ["model"])
    test = sc.where(F.col("split") == "test").join(F.broadcast(opt.select("model", "optimal_threshold")), "model")
    m = K.compute_metrics(test, "optimal_threshold", ["model"])
    return sc, opt, m.join(opt.select("model", "optimal_threshold"), "model")


@register("model_comparison", rnd(with_txn(
    "SELECT model, recall, precision, f1, roc_auc, pr_auc, fpr, tp, fp, fn, tn, optimal_threshold FROM cmp",
    SC, _OPT, *_cum_ctes(), _CMP), "recall", "precision", "f1", "roc_auc", "pr_auc", "fpr",
    "optimal_threshold"))
def model_comparison(spark, sf):
    """K9: per-model test metrics at each model's own threshold."""
    _, _, m = _model_comparison(spark, sf)
    return m.select("model", "recall", "precision", "f1", "roc_auc", "pr_auc", "fpr",
                    "tp", "fp", "fn", "tn", "optimal_threshold")


_OVF = """ovf AS (
  SELECT model, train_recall, test_recall, train_recall - test_recall AS gap,
    CASE WHEN abs(train_recall - test_recall) < 0.05 THEN 'OK'
         WHEN abs(train_recall - test_recall) < 0.10 THEN 'WARN' ELSE 'OVERFIT' END AS status
  FROM (SELECT s.model,
      max(rec) FILTER (WHERE split = 'train') AS train_recall,
      max(rec) FILTER (WHERE split = 'test') AS test_recall
    FROM (SELECT s.model, s.split,
            coalesce(count(*) FILTER (WHERE score >= o.optimal_threshold AND label = 1) * 1.0
              / nullif(count(*) FILTER (WHERE label = 1), 0), 0.0) AS rec
          FROM sc s JOIN opt o ON s.model = o.model GROUP BY s.model, s.split) s
    GROUP BY s.model) p)"""


@register("overfit_check", rnd(with_txn("SELECT * FROM ovf", SC, _OPT, _OVF),
                               "train_recall", "test_recall", "gap"))
def overfit_check(spark, sf):
    """train/test recall gap and status per model."""
    sc, sw = _test_sweep(spark, sf)
    return K.overfit_check(sc, K.optimal_threshold(sw, ["model"]))


@register("select_model", with_txn("""
SELECT coalesce(arg_min(c.model, (-c.f1, c.model)) FILTER (WHERE abs(v.gap) < 0.10),
                arg_min(c.model, (-c.f1, c.model))) AS selected_model,
       CASE WHEN count(*) FILTER (WHERE abs(v.gap) < 0.10) > 0 THEN 'stable_max_f1' ELSE 'max_f1' END AS rule
FROM cmp c JOIN ovf v ON c.model = v.model""", SC, _OPT, *_cum_ctes(), _CMP, _OVF))
def select_model(spark, sf):
    """Model selection by F1 with the overfit guard."""
    sc, opt, m = _model_comparison(spark, sf)
    ovf = K.overfit_check(sc, opt)
    return K.select_model(m.join(ovf.select("model", "gap"), "model"))


@register("top_models_by_recall", _q(
    f"SELECT model, split, recall FROM (SELECT *, {_RATES} FROM ({_COUNTS.format(t=0.5, src='sc')}) k) "
    "WHERE split = 'test' ORDER BY recall DESC, model LIMIT 2", "recall"))
def top_models_by_recall(spark, sf):
    """The two best models by test recall (model name breaks ties)."""
    m = K.threshold_metrics(pseudo_scores(spark, sf), 0.5, ["model", "split"])
    return (m.where(F.col("split") == "test").select("model", "split", "recall")
             .orderBy(F.desc("recall"), "model").limit(2))


@register("worst_case", rnd(with_txn("""
SELECT arg_min(model || '/' || split, (recall, model || '/' || split)) AS worst_recall_group,
       min(recall) AS worst_recall,
       arg_max(model || '/' || split, (abs(f1 - (SELECT avg(f1) FROM m)), model || '/' || split))
         AS max_f1_deviation_group
FROM m""", SC, f"m AS (SELECT *, {_RATES} FROM ({_COUNTS.format(t=0.5, src='sc')}) k)"), "worst_recall"))
def worst_case(spark, sf):
    """Arg-min recall and arg-max |F1 − mean F1| over (model, split)."""
    m = K.threshold_metrics(pseudo_scores(spark, sf), 0.5, ["model", "split"]) \
         .withColumn("grp", F.concat_ws("/", "model", "split"))
    mean_f1 = m.agg(F.avg("f1").alias("_mf1"))
    j = m.crossJoin(F.broadcast(mean_f1))
    return j.agg(
        F.min_by("grp", F.struct("recall", "grp")).alias("worst_recall_group"),
        F.min("recall").alias("worst_recall"),
        F.max_by("grp", F.struct(F.abs(F.col("f1") - F.col("_mf1")), F.col("grp")))
         .alias("max_f1_deviation_group"))
