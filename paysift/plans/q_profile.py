"""Registered profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..oracle import rnd, with_events, with_txn
from ..registry import register
from ..sources.transactions import event_transactions, transactions

MONEY = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]


def _union_cols(cols, select_tmpl, src="transactions"):
    return "\nUNION ALL\n".join(select_tmpl.format(c=c, src=src) for c in cols)


# --- A2 / B5 ---------------------------------------------------------------

@register("scan_parquet", with_txn(
    "SELECT txn_id, step, type, amount, nameOrig, nameDest, isFraud FROM transactions"))
def scan_parquet(spark, sf):
    return transactions(spark, sf).select("txn_id", "step", "type", "amount", "nameOrig",
                                          "nameDest", "isFraud")


@register("filter_label", with_txn(
    "SELECT txn_id, amount, type FROM transactions WHERE isFraud = 1"))
def filter_label(spark, sf):
    return transactions(spark, sf).where(F.col("isFraud") == 1).select("txn_id", "amount", "type")


# --- D1 - D7 -----------------------------------------------------------------

_D1_COLS = ["txn_id", "step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
            "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud"]


@register("null_profile", with_txn(
    "SELECT c AS \"column\", CAST(m AS BIGINT) AS missing_count, "
    "round(m * 100.0 / n, 4) AS missing_pct FROM (\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS c, count(*) - count({c}) AS m, count(*) AS n FROM transactions"
        for c in _D1_COLS) + ") t"))
def null_profile(spark, sf):
    return P.null_profile(transactions(spark, sf))


@register("class_balance", with_txn("""
SELECT isFraud, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct,
  round(CAST(sum(CASE WHEN isFraud = 0 THEN count(*) ELSE 0 END) OVER () AS DOUBLE)
        / greatest(sum(CASE WHEN isFraud = 1 THEN count(*) ELSE 0 END) OVER (), 1), 4) AS imbalance_ratio
FROM transactions GROUP BY isFraud"""))
def class_balance(spark, sf):
    return P.class_balance(transactions(spark, sf))


@register("flag_distribution", with_txn(
    "SELECT isFlaggedFraud, count(*) AS count FROM transactions GROUP BY isFlaggedFraud"))
def flag_distribution(spark, sf):
    return P.flag_distribution(transactions(spark, sf))


@register("type_fraud_rate", with_txn("""
SELECT type, count(isFraud) AS total_count, CAST(sum(isFraud) AS BIGINT) AS fraud_count,
       round(sum(isFraud) * 100.0 / count(isFraud), 4) AS fraud_rate
FROM transactions GROUP BY type ORDER BY total_count DESC, type"""))
def type_fraud_rate(spark, sf):
    return P.type_fraud_rate(transactions(spark, sf))


@register("hourly_profile", with_txn("""
SELECT CAST(step % 24 AS INT) AS hour, count(isFraud) AS tx_count,
       CAST(sum(isFraud) AS BIGINT) AS fraud_count,
       round(sum(isFraud) * 100.0 / count(isFraud), 4) AS fraud_rate
FROM transactions GROUP BY 1"""))
def hourly_profile(spark, sf):
    return P.hourly_profile(transactions(spark, sf))


@register("daily_profile", with_txn("""
SELECT *, count(*) OVER () AS n_days, min(day) OVER () AS day_min, max(day) OVER () AS day_max FROM (
SELECT CAST(floor(step / 24) AS INT) AS day, count(isFraud) AS tx_count,
       CAST(sum(isFraud) AS BIGINT) AS fraud_count,
       round(sum(isFraud) * 100.0 / count(isFraud), 4) AS fraud_rate
FROM transactions GROUP BY 1) d"""))
def daily_profile(spark, sf):
    return P.daily_profile(transactions(spark, sf))


@register("mean_hourly_fraud_rate", rnd(with_txn("""
SELECT CAST(step % 24 AS INT) AS hour, avg(isFraud) * 100 AS fraud_rate_pct
FROM transactions GROUP BY 1"""), "fraud_rate_pct"))
def mean_hourly_fraud_rate(spark, sf):
    return P.mean_hourly_fraud_rate(transactions(spark, sf))


@register("hourly_profile_events", rnd(with_events("""
SELECT CAST(step % 24 AS INT) AS hour, count(*) AS tx_count,
       CAST(sum(amount) AS DOUBLE) AS amount_sum
FROM ev GROUP BY 1"""), "amount_sum"))
def hourly_profile_events(spark, sf):
    """D5 on the second (timestamped) source: events as hour ticks."""
    ev = event_transactions(spark, sf)
    return ev.groupBy(F.pmod(F.col("step"), F.lit(24)).cast("int").alias("hour")).agg(
        F.count(F.lit(1)).alias("tx_count"), F.sum("amount").alias("amount_sum"))


# --- D8 - D11 ----------------------------------------------------------------

_PCTS = [("p1", 0.01), ("p5", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75),
         ("p95", 0.95), ("p99", 0.99)]


def _describe_sql(cols, src, pcts=_PCTS):
    q = ", ".join(f"quantile_cont({{c}}, {p}) AS {n}" for n, p in pcts)
    return "\nUNION ALL\n".join(
        (f"SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, "
         f"stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, "
         + q.replace("{c}", c) + f", CAST(max({c}) AS DOUBLE) AS max FROM {src}")
        for c in cols)


@register("numeric_describe", rnd(with_txn(_describe_sql(MONEY, "transactions")),
                                  "mean", "std", "min", "p1", "p5", "p25", "p50", "p75",
                                  "p95", "p99", "max"))
def numeric_describe(spark, sf):
    return P.numeric_describe(transactions(spark, sf))


@register("iqr_outliers", rnd(with_txn("\nUNION ALL\n".join(f"""
SELECT '{c}' AS "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower,
  q3 + 1.5 * (q3 - q1) AS upper,
  (SELECT count(*) FROM transactions WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers,
  (SELECT count(*) FROM transactions WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0
    / (SELECT count(*) FROM transactions) AS outlier_pct
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM transactions) q"""
    for c in MONEY)), "q1", "q3", "iqr", "lower", "upper", "outlier_pct"))
def iqr_outliers(spark, sf):
    return P.iqr_outliers(transactions(spark, sf))


_ERR_CTE = ("e AS (SELECT *, oldbalanceOrg - newbalanceOrig - amount AS errorOrig, "
            "newbalanceDest - oldbalanceDest - amount AS errorDest FROM transactions)")


@register("balance_consistency", rnd(with_txn(
    "SELECT d.*, n.nonzero_count, n.nonzero_pct FROM (\n"
    + _describe_sql(["errorOrig", "errorDest"], "e",
                    [("p25", 0.25), ("p50", 0.5), ("p75", 0.75)])
    + ") d JOIN (\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} <> 0) AS nonzero_count, "
        f"avg(CASE WHEN {c} <> 0 THEN 1 ELSE 0 END) * 100 AS nonzero_pct FROM e"
        for c in ["errorOrig", "errorDest"])
    + ') n ON d."column" = n."column"', _ERR_CTE),
    "mean", "std", "min", "p25", "p50", "p75", "max", "nonzero_pct"))
def balance_consistency(spark, sf):
    return P.balance_consistency(transactions(spark, sf))


@register("error_by_class", rnd(with_txn("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", isFraud, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"min({c}) AS min, max({c}) AS max, avg(CASE WHEN {c} <> 0 THEN 1 ELSE 0 END) * 100 AS nonzero_pct "
    f"FROM e GROUP BY isFraud" for c in ["errorOrig", "errorDest"]), _ERR_CTE),
    "mean", "std", "min", "max", "nonzero_pct"))
def error_by_class(spark, sf):
    return P.error_by_class(transactions(spark, sf))


# --- D12 - D19, S1 - S3, U2 ---------------------------------------------------

@register("entity_stats", rnd(with_txn("""
SELECT 'nameOrig' AS "column", count(DISTINCT nameOrig) AS n_unique,
       count(*) * 1.0 / count(DISTINCT nameOrig) AS avg_txn_per_entity FROM transactions
UNION ALL
SELECT 'nameDest', count(DISTINCT nameDest), count(*) * 1.0 / count(DISTINCT nameDest) FROM transactions"""),
    "avg_txn_per_entity"))
def entity_stats(spark, sf):
    return P.entity_stats(transactions(spark, sf))


@register("top_senders", with_txn(
    "SELECT nameOrig, count(*) AS txn_count FROM transactions GROUP BY nameOrig "
    "ORDER BY txn_count DESC, nameOrig LIMIT 10"))
def top_senders(spark, sf):
    return P.top_entities(transactions(spark, sf), "nameOrig", 10)


@register("top_receivers", with_txn(
    "SELECT nameDest, count(*) AS txn_count FROM transactions GROUP BY nameDest "
    "ORDER BY txn_count DESC, nameDest LIMIT 10"))
def top_receivers(spark, sf):
    return P.top_entities(transactions(spark, sf), "nameDest", 10)


@register("entity_overlap", with_txn(
    "SELECT count(*) AS overlap_count FROM (SELECT nameOrig FROM transactions WHERE nameOrig IS NOT NULL "
    "INTERSECT SELECT nameDest FROM transactions WHERE nameDest IS NOT NULL) t"))
def entity_overlap(spark, sf):
    return P.entity_overlap(transactions(spark, sf))


@register("amount_by_class", rnd(with_txn("""
SELECT isFraud, avg(amount) AS mean, quantile_cont(amount, 0.5) AS median,
       stddev_samp(amount) AS std, min(amount) AS min, max(amount) AS max
FROM transactions GROUP BY isFraud"""), "mean", "median", "std", "min", "max"))
def amount_by_class(spark, sf):
    return P.amount_by_class(transactions(spark, sf))


@register("fraud_share_by_type", rnd(with_txn("""
SELECT type, CAST(sum(isFraud) AS BIGINT) AS fraud_count,
       sum(isFraud) * 100.0 / (SELECT sum(isFraud) FROM transactions) AS pct_of_fraud,
       sum(isFraud) * 100.0 / count(*) AS pct_of_type
FROM transactions GROUP BY type HAVING sum(isFraud) > 0"""), "pct_of_fraud", "pct_of_type"))
def fraud_share_by_type(spark, sf):
    return P.fraud_share_by_type(transactions(spark, sf))


@register("fraud_balance_patterns", rnd(with_txn("""
SELECT count(*) AS fraud_count,
       count(*) FILTER (WHERE newbalanceOrig = 0) AS sender_zeroed,
       count(*) FILTER (WHERE oldbalanceDest = 0) AS receiver_zero,
       count(*) FILTER (WHERE newbalanceOrig = 0) * 100.0 / count(*) AS sender_zeroed_pct,
       count(*) FILTER (WHERE oldbalanceDest = 0) * 100.0 / count(*) AS receiver_zero_pct
FROM transactions WHERE isFraud = 1"""), "sender_zeroed_pct", "receiver_zero_pct"))
def fraud_balance_patterns(spark, sf):
    return P.fraud_balance_patterns(transactions(spark, sf))


@register("top_fraud_hours", with_txn(
    "SELECT CAST(step % 24 AS INT) AS hour, count(*) AS fraud_count FROM transactions "
    "WHERE isFraud = 1 GROUP BY 1 ORDER BY fraud_count DESC, hour LIMIT 5"))
def top_fraud_hours(spark, sf):
    return P.top_fraud_hours(transactions(spark, sf))


@register("type_stacked_counts", with_txn(
    "SELECT type, CAST(sum(isFraud) AS BIGINT) AS fraud, count(isFraud) AS total, "
    "CAST(count(isFraud) - sum(isFraud) AS BIGINT) AS non_fraud FROM transactions GROUP BY type"))
def type_stacked_counts(spark, sf):
    return P.type_stacked_counts(transactions(spark, sf))


def _hist_sql(src_sql, by, bins=100, density=False):
    """DuckDB twin of ``profile.histogram`` over ``src_sql`` (columns by..., x).
    Returns (body, extra CTEs)."""
    sel = lambda t: "".join(f"{t}.{b}, " for b in by)
    on = lambda a, b: " AND ".join([f"{a}.{k} = {b}.{k}" for k in by] or ["TRUE"])
    ctes = [
        f"s0 AS ({src_sql})",
        f"""r0 AS (SELECT {''.join(b + ', ' for b in by)}
    CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS _lo2,
    CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS _hi2, count(*) AS _n
  FROM s0 GROUP BY ALL)""",
        f"r AS (SELECT *, (_hi2 - _lo2) / {bins} AS _w FROM r0)",
        f"""c AS (SELECT {sel('s')}CAST(least(floor((s.x - r._lo2) / r._w), {bins - 1}) AS INT) AS bin,
    count(*) AS cnt FROM s0 s JOIN r ON {on('s', 'r')} GROUP BY ALL)""",
    ]
    dens = ", coalesce(c.cnt, 0) / (r._n * r._w) AS density" if density else ""
    body = f"""SELECT {sel('r')}CAST(b.bin AS INT) AS bin, r._lo2 + b.bin * r._w AS bin_lo,
  r._lo2 + (b.bin + 1) * r._w AS bin_hi, coalesce(c.cnt, 0) AS count{dens}
FROM r CROSS JOIN range(0, {bins}) b(bin)
LEFT JOIN c ON {on('r', 'c')} AND c.bin = b.bin"""
    return body, ctes


def _hist_oracle(src_sql, by, bins=100, density=False, dcols=("bin_lo", "bin_hi")):
    body, ctes = _hist_sql(src_sql, by, bins, density)
    return rnd(with_txn(body, *ctes), *dcols)


_HIST_SRC = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM transactions "
    f"WHERE {c} IS NOT NULL AND NOT isnan({c}) AND ({c} > 0 OR NOT EXISTS "
    f"(SELECT 1 FROM transactions WHERE {c} > 0))" for c in MONEY)


@register("histogram_amount", _hist_oracle(_HIST_SRC, ['"column"']))
def histogram_amount(spark, sf):
    return P.histogram_columns(transactions(spark, sf))


_CLIP_SRC = f"""
SELECT l."column", l.isFraud, least(greatest(l.value, q.p1), q.p99) AS x FROM (
  SELECT 'errorOrig' AS "column", isFraud, errorOrig AS value FROM e
  UNION ALL SELECT 'errorDest', isFraud, errorDest FROM e) l
JOIN (SELECT "column", isFraud, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99 FROM (
  SELECT 'errorOrig' AS "column", isFraud, errorOrig AS value FROM e
  UNION ALL SELECT 'errorDest', isFraud, errorDest FROM e) GROUP BY ALL) q
ON l."column" = q."column" AND l.isFraud = q.isFraud"""


def _clip_oracle():
    body, ctes = _hist_sql(_CLIP_SRC, ['"column"', "isFraud"])
    return rnd(with_txn(body, _ERR_CTE, *ctes), "bin_lo", "bin_hi")


@register("histogram_clipped", _clip_oracle())
def histogram_clipped(spark, sf):
    return P.histogram_clipped(transactions(spark, sf))


_DENS_SRC = """
SELECT isFraud, 'amount' AS "column", amount AS x FROM transactions WHERE amount > 0
UNION ALL
SELECT isFraud, 'balance_change_orig', least(greatest(oldbalanceOrg - newbalanceOrig, -1e7), 1e7)
FROM transactions"""


@register("histogram_density", _hist_oracle(_DENS_SRC, ['"column"', "isFraud"], density=True,
                                            dcols=("bin_lo", "bin_hi", "density")))
def histogram_density(spark, sf):
    return P.histogram_density(transactions(spark, sf))


# --- D20 - D25, A9 -------------------------------------------------------------

_CORR = MONEY + ["step", "isFraud"]


def _corr_sql(a, b, src="transactions"):
    return (f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) = 0 THEN NULL "
            f"ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END")


@register("correlation_matrix", rnd(with_txn("\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {i} AS i, {j} AS j, {_corr_sql(a, b)} AS r FROM transactions"
    for i, a in enumerate(_CORR) for j, b in enumerate(_CORR))), "r"))
def correlation_matrix(spark, sf):
    return P.correlation_matrix(transactions(spark, sf))


@register("strong_correlations", rnd(with_txn(
    "SELECT col_a, col_b, r FROM (" + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_corr_sql(a, b)} AS r FROM transactions"
        for i, a in enumerate(_CORR) for j, b in enumerate(_CORR) if i < j) + ") WHERE abs(r) > 0.7"), "r"))
def strong_correlations(spark, sf):
    return P.strong_correlations(transactions(spark, sf))


@register("night_vs_day", rnd(with_txn("""
SELECT CAST(step % 24 BETWEEN 0 AND 6 AS INT) AS is_night, count(*) AS tx_count,
       avg(isFraud) * 100 AS fraud_rate, count(*) * 100.0 / sum(count(*)) OVER () AS share_pct
FROM transactions GROUP BY 1"""), "fraud_rate", "share_pct"))
def night_vs_day(spark, sf):
    return P.night_vs_day(transactions(spark, sf))


@register("dataset_overview", rnd(with_txn("""
SELECT count(*) AS n_rows, count(DISTINCT step) AS n_steps, count(DISTINCT type) AS n_types,
  count(DISTINCT nameOrig) AS n_senders, count(DISTINCT nameDest) AS n_receivers,
  CAST(sum(isFraud) AS BIGINT) AS fraud_count, sum(isFraud) * 100.0 / count(*) AS fraud_pct,
  CAST(floor(count(*) / greatest(sum(isFraud), 1)) AS BIGINT) AS imbalance_ratio,
  avg(CASE WHEN isFraud = 1 THEN CAST(newbalanceOrig = 0 AS INT) END) * 100 AS drained_pct
FROM transactions"""), "fraud_pct", "drained_pct"))
def dataset_overview(spark, sf):
    return P.dataset_overview(transactions(spark, sf))


@register("nan_inf_counts", with_txn("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE isnan({c})) AS nan_count, "
    f"count(*) FILTER (WHERE isinf({c})) AS inf_count FROM transactions" for c in MONEY)))
def nan_inf_counts(spark, sf):
    return P.nan_inf_counts(transactions(spark, sf), MONEY)
