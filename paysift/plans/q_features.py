"""Registered feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import profile as P
from ..oracle import rnd, rnd_sig, with_events, with_txn
from ..registry import register
from ..sources.files import cut_lineage, read_parquet, save_dataset, scratch_path
from ..sources.schema import FEATURE_COLUMNS, FEATURE_GROUPS, TARGET
from ..sources.transactions import event_transactions, transactions

_ID = ["txn_id"]


def _txn(spark, sf):
    return FE.drop_leakage(transactions(spark, sf))


# --- SQL fragments (DuckDB) ---------------------------------------------------

_BASIC = """oldbalanceOrg - newbalanceOrig AS balance_diff_orig,
  newbalanceDest - oldbalanceDest AS balance_diff_dest,
  amount / (oldbalanceOrg + 1) AS amount_to_balance_ratio,
  CAST(newbalanceOrig = 0 AS INT) AS is_zero_balance"""
_ERRORS = """oldbalanceOrg - amount - newbalanceOrig AS error_orig,
  oldbalanceDest + amount - newbalanceDest AS error_dest,
  abs(oldbalanceOrg - amount - newbalanceOrig) AS abs_error_orig,
  abs(oldbalanceDest + amount - newbalanceDest) AS abs_error_dest"""
_TYPES = """CAST(type = 'CASH_IN' AS INT) AS type_CASH_IN, CAST(type = 'CASH_OUT' AS INT) AS type_CASH_OUT,
  CAST(type = 'DEBIT' AS INT) AS type_DEBIT, CAST(type = 'PAYMENT' AS INT) AS type_PAYMENT,
  CAST(type = 'TRANSFER' AS INT) AS type_TRANSFER,
  CAST(type IN ('TRANSFER', 'CASH_OUT') AS INT) AS is_high_risk_type"""
_TEMPORAL = """CAST(((step % 24) + 24) % 24 AS INT) AS hour, CAST(floor(step / 24) AS INT) AS day,
  CAST(((step % 24) + 24) % 24 BETWEEN 0 AND 6 AS INT) AS is_night"""

_AGG_CTES = [
    """s AS (SELECT nameOrig, count(amount) AS txn_count_sender, avg(amount) AS avg_amount_sender,
  max(amount) AS max_amount_sender, coalesce(stddev_samp(amount), 0) AS std_amount_sender
  FROM transactions WHERE nameOrig IS NOT NULL GROUP BY nameOrig)""",
    """r AS (SELECT nameDest, count(amount) AS txn_count_receiver, avg(amount) AS avg_amount_receiver
  FROM transactions WHERE nameDest IS NOT NULL GROUP BY nameDest)""",
    """v AS (SELECT nameOrig, step, count(amount) AS txn_per_step_sender, sum(amount) AS amt_per_step_sender
  FROM transactions WHERE nameOrig IS NOT NULL GROUP BY nameOrig, step)""",
    "p AS (SELECT quantile_cont(amount, 0.95) AS p95 FROM transactions)",
]

_LOGS = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
         "abs_error_orig", "abs_error_dest"]

_FLOATS = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
           "balance_diff_orig", "balance_diff_dest", "amount_to_balance_ratio", "error_orig",
           "error_dest", "abs_error_orig", "abs_error_dest", "avg_amount_sender",
           "max_amount_sender", "std_amount_sender", "avg_amount_receiver",
           "amt_per_step_sender"] + [f"log_{c}" for c in _LOGS]


def _feature_matrix_sql():
    logs = ",\n  ".join(
        f"CASE WHEN {c} IS NULL OR isnan({c}) THEN {c} ELSE ln(1 + greatest({c}, 0)) END AS log_{c}"
        for c in _LOGS)
    f_cte = f"""f AS (SELECT t.txn_id, t.step, t.amount, t.oldbalanceOrg, t.newbalanceOrig, t.oldbalanceDest,
  t.newbalanceDest, t.isFraud, t.type, {_BASIC.replace(chr(10), ' ')}, {_ERRORS.replace(chr(10), ' ')},
  {_TYPES.replace(chr(10), ' ')}, {_TEMPORAL.replace(chr(10), ' ').replace('step', 't.step')},
  s.txn_count_sender, s.avg_amount_sender, s.max_amount_sender, s.std_amount_sender,
  r.txn_count_receiver, r.avg_amount_receiver, v.txn_per_step_sender, v.amt_per_step_sender,
  CAST(t.amount >= p.p95 AS INT) AS high_amount_flag
  FROM transactions t
  LEFT JOIN s ON t.nameOrig = s.nameOrig
  LEFT JOIN r ON t.nameDest = r.nameDest
  LEFT JOIN v ON t.nameOrig = v.nameOrig AND t.step = v.step
  CROSS JOIN p)"""
    g_cte = f"""g AS (SELECT *,
  CAST(high_amount_flag = 1 AND is_zero_balance = 1 AS INT) AS high_amount_and_zero_balance,
  CAST(high_amount_flag = 1 AND is_high_risk_type = 1 AS INT) AS high_amount_and_high_risk_type,
  {logs}
  FROM f)"""
    # ±inf -> finite max/min of the column, NaN/NULL -> 0.
    sel = []
    for c in FEATURE_COLUMNS:
        if c in _FLOATS:
            sel.append(
                f"coalesce(CASE WHEN isnan({c}) THEN 0.0 "
                f"WHEN {c} = 'inf'::DOUBLE THEN max(CASE WHEN isfinite({c}) THEN {c} END) OVER () "
                f"WHEN {c} = '-inf'::DOUBLE THEN min(CASE WHEN isfinite({c}) THEN {c} END) OVER () "
                f"ELSE {c} END, 0.0) AS {c}")
        else:
            sel.append(f"coalesce({c}, 0) AS {c}")
    body = "SELECT txn_id, " + ",\n  ".join(sel) + f", {TARGET} FROM g"
    return rnd(with_txn(body, *_AGG_CTES, f_cte, g_cte), *_FLOATS)


def _stored(spark, sf):
    """The derived payment table, written once: its joins run once, whatever
    the number of passes over the table."""
    return cut_lineage(transactions(spark, sf), "transactions")


@register("feature_matrix", _feature_matrix_sql())
def feature_matrix(spark, sf):
    """F11 (flagship): 41 features + target, skew-safe join plan."""
    return FE.feature_matrix(_stored(spark, sf))


@register("feature_matrix_window", _feature_matrix_sql())
def feature_matrix_window(spark, sf):
    """F11 with the window plan for F5-F7 (same result, different plan)."""
    return FE.feature_matrix(_stored(spark, sf), group_strategy="window")


@register("drop_leakage", rnd(with_txn(
    "SELECT * EXCLUDE (isFlaggedFraud) FROM transactions"),
    "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"))
def drop_leakage(spark, sf):
    return _txn(spark, sf)


@register("basic_features", rnd(with_txn(f"SELECT txn_id, {_BASIC} FROM transactions"),
                                "balance_diff_orig", "balance_diff_dest", "amount_to_balance_ratio"))
def basic_features(spark, sf):
    return FE.create_basic_features(_txn(spark, sf)).select(
        *_ID, "balance_diff_orig", "balance_diff_dest", "amount_to_balance_ratio", "is_zero_balance")


@register("balance_error_features", rnd(with_txn(f"SELECT txn_id, {_ERRORS} FROM transactions"),
                                        "error_orig", "error_dest", "abs_error_orig", "abs_error_dest"))
def balance_error_features(spark, sf):
    return FE.create_balance_error_features(_txn(spark, sf)).select(
        *_ID, "error_orig", "error_dest", "abs_error_orig", "abs_error_dest")


@register("type_features", with_txn(f"SELECT txn_id, {_TYPES} FROM transactions"))
def type_features(spark, sf):
    return FE.create_type_features(_txn(spark, sf)).select(
        *_ID, "type_CASH_IN", "type_CASH_OUT", "type_DEBIT", "type_PAYMENT", "type_TRANSFER",
        "is_high_risk_type")


@register("temporal_features", with_txn(f"SELECT txn_id, {_TEMPORAL} FROM transactions"))
def temporal_features(spark, sf):
    return FE.create_temporal_features(_txn(spark, sf)).select(*_ID, "hour", "day", "is_night")


@register("temporal_features_events", with_events(
    f"SELECT txn_id, {_TEMPORAL} FROM ev"))
def temporal_features_events(spark, sf):
    """F4 on the hour-tick events source."""
    return FE.create_temporal_features(event_transactions(spark, sf)).select(
        *_ID, "hour", "day", "is_night")


@register("sender_features", rnd(with_txn(
    "SELECT t.txn_id, s.txn_count_sender, s.avg_amount_sender, s.max_amount_sender, s.std_amount_sender "
    "FROM transactions t LEFT JOIN s ON t.nameOrig = s.nameOrig", _AGG_CTES[0]),
    "avg_amount_sender", "max_amount_sender", "std_amount_sender"))
def sender_features(spark, sf):
    return FE.create_sender_features(_txn(spark, sf)).select(
        *_ID, "txn_count_sender", "avg_amount_sender", "max_amount_sender", "std_amount_sender")


@register("sender_features_events", rnd(with_events(
    "SELECT t.txn_id, s.txn_count_sender, s.avg_amount_sender, s.max_amount_sender, s.std_amount_sender "
    "FROM ev t LEFT JOIN s ON t.nameOrig = s.nameOrig",
    _AGG_CTES[0].replace("FROM transactions", "FROM ev")),
    "avg_amount_sender", "max_amount_sender", "std_amount_sender"))
def sender_features_events(spark, sf):
    """F5 on the events source (sender = user)."""
    return FE.create_sender_features(event_transactions(spark, sf)).select(
        *_ID, "txn_count_sender", "avg_amount_sender", "max_amount_sender", "std_amount_sender")


@register("receiver_features", rnd(with_txn(
    "SELECT t.txn_id, r.txn_count_receiver, r.avg_amount_receiver "
    "FROM transactions t LEFT JOIN r ON t.nameDest = r.nameDest", _AGG_CTES[1]),
    "avg_amount_receiver"))
def receiver_features(spark, sf):
    return FE.create_receiver_features(_txn(spark, sf)).select(
        *_ID, "txn_count_receiver", "avg_amount_receiver")


@register("velocity_features", rnd(with_txn(
    "SELECT t.txn_id, v.txn_per_step_sender, v.amt_per_step_sender "
    "FROM transactions t LEFT JOIN v ON t.nameOrig = v.nameOrig AND t.step = v.step", _AGG_CTES[2]),
    "amt_per_step_sender"))
def velocity_features(spark, sf):
    return FE.create_velocity_features(_txn(spark, sf)).select(
        *_ID, "txn_per_step_sender", "amt_per_step_sender")


@register("join_sender_agg", rnd(with_txn(
    "SELECT t.txn_id, t.nameOrig, s.txn_count_sender, s.avg_amount_sender "
    "FROM transactions t LEFT JOIN s ON t.nameOrig = s.nameOrig", _AGG_CTES[0]),
    "avg_amount_sender"))
def join_sender_agg(spark, sf):
    """Group-by + left equi-join back on one key (explicit join form,
    with hot-key salting)."""
    t = _txn(spark, sf)
    agg = t.groupBy("nameOrig").agg(F.count("amount").alias("txn_count_sender"),
                                    F.avg("amount").alias("avg_amount_sender"),
                                    F.count(F.lit(1)).alias("_rows"))
    from .skew import salted_left_join
    return salted_left_join(t, agg, ["nameOrig"], row_key=_ID).select(
        *_ID, "nameOrig", "txn_count_sender", "avg_amount_sender")


@register("join_velocity_agg", rnd(with_txn(
    "SELECT t.txn_id, t.nameOrig, t.step, v.txn_per_step_sender, v.amt_per_step_sender "
    "FROM transactions t LEFT JOIN v ON t.nameOrig = v.nameOrig AND t.step = v.step", _AGG_CTES[2]),
    "amt_per_step_sender"))
def join_velocity_agg(spark, sf):
    """Left equi-join on two keys, F5+F7 merged table (one detail join)."""
    t = _txn(spark, sf)
    return FE.create_sender_velocity_features(t, row_key=_ID).select(
        *_ID, "nameOrig", "step", "txn_per_step_sender", "amt_per_step_sender")


@register("interaction_features", with_txn(
    "SELECT txn_id, high_amount_flag, "
    "CAST(high_amount_flag = 1 AND newbalanceOrig = 0 AS INT) AS high_amount_and_zero_balance, "
    "CAST(high_amount_flag = 1 AND type IN ('TRANSFER','CASH_OUT') AS INT) AS high_amount_and_high_risk_type "
    "FROM (SELECT t.*, CAST(t.amount >= p.p95 AS INT) AS high_amount_flag FROM transactions t CROSS JOIN p)",
    _AGG_CTES[3]))
def interaction_features(spark, sf):
    """F8 (exact p95, broadcast one-row cross join)."""
    d = _txn(spark, sf).transform(FE.create_basic_features).transform(FE.create_type_features)
    return FE.create_interaction_features(d).select(
        *_ID, "high_amount_flag", "high_amount_and_zero_balance", "high_amount_and_high_risk_type")


@register("amount_p95", rnd(with_txn("SELECT quantile_cont(amount, 0.95) AS amount_p95 FROM transactions"),
                            "amount_p95"))
def amount_p95(spark, sf):
    """Global exact quantile as a one-row table."""
    return FE.amount_p95(_txn(spark, sf))


@register("log_features", rnd(with_txn(
    "SELECT txn_id, " + ", ".join(f"ln(1 + greatest({c}, 0)) AS log_{c}" for c in _LOGS)
    + f" FROM (SELECT *, {_ERRORS.replace(chr(10), ' ')} FROM transactions)"),
    *[f"log_{c}" for c in _LOGS]))
def log_features(spark, sf):
    d = _txn(spark, sf).transform(FE.create_balance_error_features)
    return FE.create_log_features(d).select(*_ID, *[f"log_{c}" for c in _LOGS])


_CV_COLS = ["ratio_raw", "neg_ratio_raw", "zero_ratio_raw"]


@register("clean_validate", rnd(with_txn(
    "SELECT txn_id, " + ", ".join(
        f"coalesce(CASE WHEN isnan({c}) THEN 0.0 "
        f"WHEN {c} = 'inf'::DOUBLE THEN max(CASE WHEN isfinite({c}) THEN {c} END) OVER () "
        f"WHEN {c} = '-inf'::DOUBLE THEN min(CASE WHEN isfinite({c}) THEN {c} END) OVER () "
        f"ELSE {c} END, 0.0) AS {c}" for c in _CV_COLS)
    + " FROM (SELECT txn_id, amount / newbalanceOrig AS ratio_raw, "
      "-amount / newbalanceOrig AS neg_ratio_raw, "
      "(newbalanceOrig - newbalanceOrig) / newbalanceOrig AS zero_ratio_raw FROM transactions)"),
    *_CV_COLS))
def clean_validate(spark, sf):
    """F10 on data that really holds ±inf and NaN: IEEE ratios over the
    drained senders (newbalanceOrig = 0)."""
    t = _txn(spark, sf)
    nb, a = F.col("newbalanceOrig"), F.col("amount")
    d = t.select(*_ID, FE._ieee_div(a, nb).alias("ratio_raw"),
                 FE._ieee_div(-a, nb).alias("neg_ratio_raw"),
                 FE._ieee_div(nb - nb, nb).alias("zero_ratio_raw"))
    return FE.clean_and_validate(d)


def _narrow_sql(columns, head: str, kind: str) -> str:
    """A row per column: ``head`` (of the column c) and the smallest type."""
    def narrow(c):
        if c in ("step", "isFraud"):
            fits = lambda t, lo, hi: f"WHEN min({c}) >= {lo} AND max({c}) <= {hi} THEN '{t}' "
            return "CASE " + fits("tinyint", -128, 127) + fits("smallint", -32768, 32767) + fits("int", -2147483648, 2147483647) + "ELSE 'bigint' END"
        return f"CASE WHEN coalesce(max(CAST(CAST(CAST({c} AS FLOAT) AS DOUBLE) <> {c} AS INT)), 0) = 0 THEN 'float' ELSE 'double' END"
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", {head.format(c=c)}, {narrow(c)} AS {kind} FROM transactions" for c in columns)


_NUMERIC = ["step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "isFraud"]
_RANGE = "CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value"


@register("narrow_types", rnd(with_txn(_narrow_sql(_NUMERIC, _RANGE, "narrow_type")), "min_value", "max_value"))
def narrow_types(spark, sf):
    """B1: smallest lossless type per numeric column."""
    return FE.narrow_types(_txn(spark, sf).drop("txn_id"))


@register("narrowed_parquet_roundtrip", rnd(with_txn(_narrow_sql(_NUMERIC, "count({c}) AS n_values, " + _RANGE, "stored_type")), "min_value", "max_value"))
def narrowed_parquet_roundtrip(spark, sf):
    """B1 at the sink: the payments written in narrow types and read back; type
    in the file, values and range of each numeric column."""
    path = scratch_path(spark, "narrowed")
    save_dataset(cut_lineage(_txn(spark, sf), "payments"), path, narrow=True)
    back = FE.select_numeric(read_parquet(spark, path))
    rows = [F.struct(F.lit(f.name).alias("column"), F.count(f.name).alias("n_values"), F.min(f.name).cast("double").alias("min_value"),
                     F.max(f.name).cast("double").alias("max_value"), F.lit(f.dataType.simpleString()).alias("stored_type")) for f in back.schema.fields]
    return back.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@register("select_numeric", rnd(with_txn(f"SELECT txn_id, {', '.join(_NUMERIC[:-1])} FROM transactions"), *_NUMERIC[1:-1]))
def select_numeric(spark, sf):
    """The numeric columns but the target, with the row's key."""
    return FE.select_numeric(_txn(spark, sf), exclude=[TARGET], keep=_ID)


@register("select_existing", rnd(with_txn(f"SELECT {', '.join(_NUMERIC)} FROM transactions"), *_NUMERIC[1:-1]))
def select_existing(spark, sf):
    """The feature columns and the target, as far as the payments have them."""
    return FE.select_existing(_txn(spark, sf), [*FEATURE_COLUMNS, TARGET])


_CATALOGUE_SQL = "WITH fm AS (" + _feature_matrix_sql() + ") " + " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS feature, replace(lower(typeof(any_value({c}))), 'integer', 'int') AS dtype, count({c}) AS n_values FROM fm"
    for i, c in enumerate([*FEATURE_COLUMNS, TARGET], 1))


@register("feature_catalogue", _CATALOGUE_SQL)
def feature_catalogue(spark, sf):
    """(ordinal, name, dtype, non-null values) of the feature matrix."""
    fm = FE.feature_matrix(_stored(spark, sf))
    fields = [f for f in fm.schema.fields if f.name != "txn_id"]
    row = fm.agg(*[F.count(f.name).alias(f"n{i}") for i, f in enumerate(fields)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("feature"),
                 F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"n{i}").alias("n_values"))
        for i, f in enumerate(fields)])).alias("_r")).select("_r.*")


@register("feature_group_summary", rnd(f"""SELECT g.feature_group, CAST(g.n AS INT) AS n_features, count(*) AS n_rows,
  avg(isFraud) * 100 AS fraud_rate_pct, {len(FEATURE_COLUMNS)} AS n_features_total
FROM ({_feature_matrix_sql()}) CROSS JOIN (VALUES {", ".join(f"('{g}', {len(c)})" for g, c in FEATURE_GROUPS.items())}) g(feature_group, n)
GROUP BY ALL""", "fraud_rate_pct"))
def feature_group_summary(spark, sf):
    """A10: rows, fraud rate and per-group feature counts of the matrix."""
    fm = FE.feature_matrix(_stored(spark, sf))
    row = fm.agg(F.count(F.lit(1)).alias("n_rows"), (F.avg(TARGET) * 100).alias("fraud_rate_pct"))
    groups = spark.createDataFrame([(g, len(c)) for g, c in FEATURE_GROUPS.items()],
                                   "feature_group STRING, n_features INT")
    return groups.crossJoin(row).withColumn("n_features_total", F.lit(len(FEATURE_COLUMNS)))


# --- D22 - D26 over the feature matrix -------------------------------------------

def _fm_sql_body():
    """The feature-matrix SQL without the final rounding, as a CTE ``fm``."""
    sql = _feature_matrix_sql()
    inner = sql[sql.index("FROM (\n") + 7: sql.rindex("\n) _q")]
    return inner


def _fm_cte():
    return _fm_sql_body()


_TC_FEATS = [c for c in FEATURE_COLUMNS]


def _target_corr_sql():
    inner = _fm_cte()
    # inner is a full WITH ... SELECT; wrap it as a subquery
    parts = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, CASE WHEN stddev_pop({c}) * stddev_pop(isFraud) = 0 THEN NULL "
        f"ELSE covar_pop({c}, isFraud) / (stddev_pop({c}) * stddev_pop(isFraud)) END AS corr FROM fm"
        for c in _TC_FEATS)
    return rnd(f"WITH fm AS ({inner})\nSELECT * FROM ({parts}) WHERE corr IS NOT NULL", "corr")


@register("target_correlation", _target_corr_sql())
def target_correlation(spark, sf):
    """D22 over the 41-feature matrix."""
    fm = FE.feature_matrix(_stored(spark, sf))
    return P.target_correlation(fm, FEATURE_COLUMNS)


_FLAGS = ["is_zero_balance", "is_high_risk_type", "is_night", "high_amount_flag",
          "high_amount_and_zero_balance", "high_amount_and_high_risk_type"]


@register("flag_lift", rnd(
    f"WITH fm AS ({_fm_cte()})\n" + "\nUNION ALL\n".join(
        f"SELECT '{f}' AS flag, avg({f}) * 100 AS prevalence_pct, "
        f"coalesce(avg(CASE WHEN {f} = 1 THEN isFraud END) * 100, 0.0) AS fraud_rate_pct FROM fm"
        for f in _FLAGS), "prevalence_pct", "fraud_rate_pct"))
def flag_lift(spark, sf):
    """D25 over the feature flags."""
    return P.flag_lift(FE.feature_matrix(_stored(spark, sf)), _FLAGS)


@register("feature_stats", rnd_sig(
    f"WITH fm AS ({_fm_cte()})\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, "
        f"CAST(max({c}) AS DOUBLE) AS max FROM fm" for c in FEATURE_COLUMNS), "mean", "std", "max"),
    significant=True)
def feature_stats(spark, sf):
    """Per-feature mean / std / max."""
    return P.feature_stats(FE.feature_matrix(_stored(spark, sf)), FEATURE_COLUMNS)


@register("night_fraud_rate", rnd(
    f"WITH fm AS ({_fm_cte()})\nSELECT is_night, count(*) AS tx_count, avg(isFraud) * 100 AS fraud_rate, "
    "count(*) * 100.0 / sum(count(*)) OVER () AS share_pct FROM fm GROUP BY is_night",
    "fraud_rate", "share_pct"))
def night_fraud_rate(spark, sf):
    """D24 on the feature matrix's is_night flag."""
    return P.night_vs_day(FE.feature_matrix(_stored(spark, sf)))


@register("stream_row_features", rnd(with_txn(
    f"SELECT txn_id, {_BASIC}, {_ERRORS}, {_TEMPORAL} FROM transactions"),
    "balance_diff_orig", "balance_diff_dest", "amount_to_balance_ratio", "error_orig",
    "error_dest", "abs_error_orig", "abs_error_dest"))
def stream_row_features(spark, sf):
    """F1/F2/F4 through Structured Streaming: the payment table is written
    as parquet files, consumed by a file stream (availableNow) into an
    exactly-once parquet sink, and the sink is read back."""
    from ..streaming.features import run_parquet_stream
    src, sink, ck = (scratch_path(spark, n) for n in ("stream-src", "stream-sink", "stream-ckpt"))
    transactions(spark, sf).write.parquet(src)
    run_parquet_stream(spark, src, sink, ck)
    return spark.read.parquet(sink).select(
        "txn_id", "balance_diff_orig", "balance_diff_dest", "amount_to_balance_ratio",
        "is_zero_balance", "error_orig", "error_dest", "abs_error_orig", "abs_error_dest",
        "hour", "day", "is_night")
