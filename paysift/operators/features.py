"""Feature groups F1-F10 and the schema operators B1-B3, B6-B10.

Each ``create_*`` is ``DataFrame -> DataFrame`` and composes with
``DataFrame.transform``.  Row-wise groups (F1-F4, F9) are pure projections and
also run on streaming DataFrames.  Group features (F5-F7) go through the
skew-safe aggregate-and-attach plan in ``plans.skew``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType, NumericType

from ..functions.core import as_flag, clip_lower, existing, numeric_columns, safe_div
from ..functions.quantile import quantile_row
from ..plans.skew import HOT_ROWS, attach_group_aggregates, attach_nested_aggregates, salted_left_join
from ..session import checkpoint_dir
from ..sources.schema import (FEATURE_COLUMNS, HIGH_RISK_TYPES, LEAKAGE_COLS,
                              LOG_TARGETS, TARGET, TXN_TYPES)


def _ieee_div(num: Column, den: Column) -> Column:
    """IEEE division (x/0 = ±inf, 0/0 = NaN) as pandas does; ANSI Spark would
    raise, and ``try_divide`` would give NULL.  The F10 cleaning step then
    repairs the infinities exactly as the reference does."""
    return (F.when(den != 0, num / den)
             .when(num > 0, F.lit(float("inf")))
             .when(num < 0, F.lit(float("-inf")))
             .when(num.isNotNull() & den.isNotNull(), F.lit(float("nan"))))


# --- B2 / B3 ---------------------------------------------------------------

def drop_leakage(df: DataFrame) -> DataFrame:
    """B2: drop the leakage column; absent columns are ignored."""
    return df.drop(*LEAKAGE_COLS)


def drop_unused_columns(df: DataFrame) -> DataFrame:
    """Drop raw entity ids and the raw category after use."""
    return df.drop("nameOrig", "nameDest", "type")


# --- F1 - F4 (row-wise) ----------------------------------------------------

def create_basic_features(df: DataFrame) -> DataFrame:
    """F1."""
    return df.withColumns({
        "balance_diff_orig": F.col("oldbalanceOrg") - F.col("newbalanceOrig"),
        "balance_diff_dest": F.col("newbalanceDest") - F.col("oldbalanceDest"),
        "amount_to_balance_ratio": _ieee_div(F.col("amount"), F.col("oldbalanceOrg") + 1),
        "is_zero_balance": as_flag(F.col("newbalanceOrig") == 0),
    })


def create_balance_error_features(df: DataFrame) -> DataFrame:
    """F2 (sender: old − amount − new; receiver: old + amount − new)."""
    eo = F.col("oldbalanceOrg") - F.col("amount") - F.col("newbalanceOrig")
    ed = F.col("oldbalanceDest") + F.col("amount") - F.col("newbalanceDest")
    return df.withColumns({"error_orig": eo, "error_dest": ed}).withColumns({
        "abs_error_orig": F.abs("error_orig"), "abs_error_dest": F.abs("error_dest")})


def create_type_features(df: DataFrame, types=TXN_TYPES) -> DataFrame:
    """One flag per payment type (fixed vocabulary, so the
    schema is known without a data pass) plus the high-risk IN-list flag."""
    cols = {f"type_{t}": as_flag(F.col("type") == t) for t in types}
    cols["is_high_risk_type"] = as_flag(F.col("type").isin(*HIGH_RISK_TYPES))
    return df.withColumns(cols)


def create_temporal_features(df: DataFrame) -> DataFrame:
    """hour = step mod 24 (floor semantics), day = step div 24,
    night = hour BETWEEN 0 AND 6."""
    return df.withColumns({
        "hour": F.pmod(F.col("step"), F.lit(24)).cast("int"),
        "day": F.floor(F.col("step") / 24).cast("int"),
    }).withColumn("is_night", as_flag(F.col("hour").between(0, 6)))


# --- F5 - F7 (group features) ----------------------------------------------

def create_sender_features(df: DataFrame, strategy: str = "join",
                           hot_rows: int = HOT_ROWS, row_key: list[str] | None = None,
                           of: DataFrame | None = None) -> DataFrame:
    """per-sender count, mean, max and sample std (single row → 0)."""
    a = F.col("amount")
    out = attach_group_aggregates(df, ["nameOrig"], {
        "txn_count_sender": F.count(a),
        "avg_amount_sender": F.avg(a),
        "max_amount_sender": F.max(a),
        "std_amount_sender": F.stddev_samp(a),
    }, strategy, hot_rows, row_key, of)
    return out.withColumn("std_amount_sender",
                          F.when(F.col("txn_count_sender").isNotNull(),
                                 F.coalesce(F.col("std_amount_sender"), F.lit(0.0))))


def create_receiver_features(df: DataFrame, strategy: str = "join",
                             hot_rows: int = HOT_ROWS, row_key: list[str] | None = None,
                             of: DataFrame | None = None) -> DataFrame:
    """per-receiver count and mean."""
    a = F.col("amount")
    return attach_group_aggregates(df, ["nameDest"], {
        "txn_count_receiver": F.count(a),
        "avg_amount_receiver": F.avg(a),
    }, strategy, hot_rows, row_key, of)


def create_velocity_features(df: DataFrame, strategy: str = "join",
                             hot_rows: int = HOT_ROWS, row_key: list[str] | None = None,
                             of: DataFrame | None = None) -> DataFrame:
    """per (sender, step) count and sum."""
    a = F.col("amount")
    return attach_group_aggregates(df, ["nameOrig", "step"], {
        "txn_per_step_sender": F.count(a),
        "amt_per_step_sender": F.sum(a),
    }, strategy, hot_rows, row_key, of)


def sender_velocity_table(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """F5 + F7 aggregates as ONE table keyed by (nameOrig, step).

    Both groupings are plain ``groupBy`` aggregates of the detail rows
    (partial aggregation before each shuffle, so a hot sender is reduced
    map-side).  The per-sender row is then joined onto the per-(sender, step)
    rows — a join of two aggregated tables whose per-sender fan-out is the
    number of distinct steps of that sender, not its transactions.  The
    detail rows are then joined only once, on (nameOrig, step)."""
    a = F.col("amount")
    v = df.groupBy("nameOrig", "step").agg(
        F.count(a).alias("txn_per_step_sender"),
        F.sum(a).alias("amt_per_step_sender"),
        F.count(F.lit(1)).alias("_rows"))
    s = df.groupBy("nameOrig").agg(
        F.count(a).alias("txn_count_sender"),
        F.avg(a).alias("avg_amount_sender"),
        F.max(a).alias("max_amount_sender"),
        F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias("std_amount_sender"),
        F.count(F.lit(1)).alias("_srows"))
    # A sender's velocity rows are at most its transactions (_srows), so the
    # same hot-key split bounds this join of the two aggregated tables too.
    vs = salted_left_join(v, s, ["nameOrig"], "_srows", hot_rows, ["nameOrig", "step"])
    return vs.select(
        "nameOrig", "step", "txn_count_sender", "avg_amount_sender", "max_amount_sender",
        "std_amount_sender", "txn_per_step_sender", "amt_per_step_sender", "_rows")


def create_sender_velocity_features(df: DataFrame, hot_rows: int = HOT_ROWS,
                                    row_key: list[str] | None = None) -> DataFrame:
    """F5 + F7 attached with a single join of the detail rows."""
    stats = sender_velocity_table(df, hot_rows)
    return salted_left_join(df, stats, ["nameOrig", "step"], "_rows", hot_rows, row_key)


# --- F8 - F10 --------------------------------------------------------------

def amount_p95(df: DataFrame) -> DataFrame:
    """One-row table holding the exact 95th percentile of amount."""
    return quantile_row(df, "amount", {"amount_p95": 0.95})


def create_interaction_features(df: DataFrame, p95: DataFrame | float | None = None) -> DataFrame:
    """F8: high-amount flag (amount >= exact p95) and its ANDs with the
    zero-balance and high-risk flags.  ``p95`` may be a constant (streaming)
    or a one-row table; by default it is computed from ``df``.  The one-row
    table is attached by a broadcast cross join — the plan stays lazy and no
    value passes through the driver."""
    if isinstance(p95, (int, float)):
        thr = F.lit(float(p95))
        base = df
    else:
        p = amount_p95(df) if p95 is None else p95
        base = df.crossJoin(F.broadcast(p.select(F.col(p.columns[0]).alias("_p95"))))
        thr = F.col("_p95")
    hi = F.col("amount") >= thr
    out = base.withColumns({
        "high_amount_flag": as_flag(hi),
    }).withColumns({
        "high_amount_and_zero_balance":
            as_flag((F.col("high_amount_flag") == 1) & (F.col("is_zero_balance") == 1)),
        "high_amount_and_high_risk_type":
            as_flag((F.col("high_amount_flag") == 1) & (F.col("is_high_risk_type") == 1)),
    })
    return out.drop("_p95") if "_p95" in out.columns else out


def create_log_features(df: DataFrame, targets=LOG_TARGETS) -> DataFrame:
    """log1p(clip(c, lower=0))."""
    return df.withColumns({f"log_{c}": F.log1p(clip_lower(c, 0.0)) for c in targets})


def finite_extremes(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-row table ``_mx_<c>, _mn_<c>``: max / min of the finite values of
    each column (one global aggregate with partial aggregation)."""
    inf = F.lit(float("inf"))
    aggs = []
    for c in cols:
        fin = F.when(~F.isnan(c) & (F.abs(F.col(c)) != inf), F.col(c))
        aggs += [F.max(fin).alias(f"_mx_{c}"), F.min(fin).alias(f"_mn_{c}")]
    return df.agg(*aggs)


def clean_and_validate(df: DataFrame, extremes: DataFrame | Row | None = None,
                       exclude=("txn_id",)) -> DataFrame:
    """±inf → the max/min of the finite values of that column, then
    NaN/NULL → 0 in every numeric column.

    The finite extremes are a one-row table attached by a broadcast cross
    join, or a row that the caller has read.  By default they are aggregated from
    ``df`` itself; a caller that reads the result often passes ``extremes``.
    The reference's two asserts (no NaN, no inf left) hold by construction
    of the projection below."""
    num = [f for f in df.schema.fields
           if isinstance(f.dataType, NumericType) and f.name not in exclude]
    fl = [f.name for f in num if isinstance(f.dataType, (DoubleType, FloatType))]
    numeric = {f.name for f in num}
    if fl:
        ext = finite_extremes(df, fl) if extremes is None else extremes
        if isinstance(ext, DataFrame):
            df = df.crossJoin(F.broadcast(ext))
    outs = []
    for f in df.schema.fields:
        c = f.name
        if c.startswith("_mx_") or c.startswith("_mn_"):
            continue
        if c in fl:
            x = F.col(c)
            at = F.col if isinstance(ext, DataFrame) else (lambda name: F.lit(ext[name]))
            repaired = (F.when(x == F.lit(float("inf")), at(f"_mx_{c}"))
                         .when(x == F.lit(float("-inf")), at(f"_mn_{c}")))
            x = F.when(F.abs(x) < F.lit(float("inf")), x).otherwise(F.coalesce(repaired, F.lit(0.0)))
            outs.append(x.cast(f.dataType).alias(c))
        elif c in numeric:
            outs.append(F.coalesce(F.col(c), F.lit(0)).cast(f.dataType).alias(c))
        else:
            outs.append(F.col(c))
    return df.select(*outs)


def select_features(df: DataFrame, keep_key: bool = True) -> DataFrame:
    """Final column order: txn_id (carried key, never a feature), the 41
    features, the target."""
    cols = (["txn_id"] if keep_key and "txn_id" in df.columns else []) + FEATURE_COLUMNS + [TARGET]
    return df.select(*cols)


def _row_features(df: DataFrame) -> DataFrame:
    """The row-wise groups (no shuffle, stream-compatible)."""
    return (drop_leakage(df)
            .transform(create_basic_features)
            .transform(create_balance_error_features)
            .transform(create_type_features)
            .transform(create_temporal_features)
            .transform(create_log_features))


_ROW_FLOATS = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
               "balance_diff_orig", "balance_diff_dest", "amount_to_balance_ratio",
               "error_orig", "error_dest", "abs_error_orig", "abs_error_dest"] + \
              [f"log_{c}" for c in LOG_TARGETS]
_DERIVED_FLOATS = _ROW_FLOATS[5:]
_SV_FLOATS = ["avg_amount_sender", "max_amount_sender", "std_amount_sender", "amt_per_step_sender"]
_RV_FLOATS = ["avg_amount_receiver"]


#: Receivers whose aggregates (some 60 bytes each) are broadcast.
BROADCAST_ROWS = 1_000_000


def feature_matrix(df: DataFrame, group_strategy: str = "join",
                   hot_rows: int = HOT_ROWS, materialise: bool = True) -> DataFrame:
    """the full feature pipeline (41 features + target, txn_id carried).

    Plan:

    * F5 + F7 are windows over ONE exchange of the raw columns by sender
      (``plans.skew.attach_nested_aggregates``): rows of a step are a part of
      their sender's;
    * F6 is attached by a join with the per-receiver aggregates (partial
      aggregation; broadcast up to ``BROADCAST_ROWS`` receivers, else skew-safe),
      or with ``group_strategy="window"`` by windows per receiver, before those by
      sender; hot receivers take their values from the hot-key list there;
    * the raw columns but the names, with these eight, are written once (``materialise``); p95
      for F8 and F10's finite extremes are a row each, read from it;
    * F1-F4, F8, F9 and F10 are one projection of that table, so that a reader of
      a few columns computes only those, and no derived column is shuffled."""
    from ..sources.files import cut_lineage
    cut = cut_lineage if materialise else (lambda t, name: t)
    raw = drop_leakage(df)
    key = ["txn_id"] if "txn_id" in raw.columns else raw.columns
    a = F.col("amount")
    senders = {"txn_count_sender": F.count(a), "avg_amount_sender": F.avg(a), "max_amount_sender": F.max(a), "std_amount_sender": F.stddev_samp(a)}
    detail = raw
    if group_strategy == "window":  # two columns more for the exchange by sender, not six for the one by receiver
        detail = create_receiver_features(raw, "window", hot_rows, key, raw).drop("nameDest")
    out = attach_nested_aggregates(detail, "nameOrig", senders, "step", {"txn_per_step_sender": F.count(a), "amt_per_step_sender": F.sum(a)},
                                   hot_rows, [c for c in key if c in detail.columns], lambda t: cut(t, "hot"))
    out = out.withColumn("std_amount_sender", F.when(F.col("txn_count_sender").isNotNull(), F.coalesce(F.col("std_amount_sender"), F.lit(0.0))))
    if group_strategy != "window":
        # Rows without a step have no (sender, step) to take sender features from.
        out = out.withColumns({c: F.when(F.col("step").isNotNull(), F.col(c)) for c in senders})
        rv = cut(raw.groupBy("nameDest").agg(F.count(a).alias("txn_count_receiver"), F.avg(a).alias("avg_amount_receiver"), F.count(F.lit(1)).alias("_rows")), "receiver")
        if materialise and rv.count() <= BROADCAST_ROWS:
            out = out.join(F.broadcast(rv.drop("_rows")), "nameDest", "left")
        else:
            out = salted_left_join(out, rv, ["nameDest"], "_rows", hot_rows, key)
    out = _row_features(cut(out.drop("nameOrig", "nameDest"), "group-features"))  # no feature reads the names from here on
    ext, p95 = finite_extremes(out, _ROW_FLOATS + _SV_FLOATS + _RV_FLOATS), amount_p95(out)
    if materialise:  # a row each
        ext, bound = ext.first(), p95.first()
        p95 = p95 if bound is None or bound[0] is None else bound[0]
    out = create_interaction_features(out, p95)
    return clean_and_validate(select_features(drop_unused_columns(out)), ext)


def recompute_features(df: DataFrame, p95: DataFrame | float | None = None) -> DataFrame:
    """A feature table whose raw columns were changed, with F1, F2 and F9 (and
    F8, if the bound ``p95`` is given) derived from them anew; NaN and ±inf are
    0 there.  Group features and types stay as they are."""
    out = df.transform(create_basic_features).transform(create_balance_error_features).transform(create_log_features)
    if p95 is not None:
        out = create_interaction_features(out, p95)
    repaired = {c: F.when(F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))) | F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c))
                for c in _DERIVED_FLOATS}
    return out.withColumns(repaired).select(*df.columns)


# --- B1, B4, B11 ---------------------------------------------------------

def select_numeric(df: DataFrame, exclude=(), keep=()) -> DataFrame:
    """``keep`` and the numeric columns but those of ``exclude``."""
    return df.select(*keep, *numeric_columns(df, [*exclude, *keep]))


def select_existing(df: DataFrame, cols) -> DataFrame:
    """Those of ``cols`` that ``df`` has, in the order of ``cols``."""
    return df.select(*existing(df, cols))


_INT_RANGES = [("tinyint", -128, 127), ("smallint", -32768, 32767),
               ("int", -2**31, 2**31 - 1)]


def narrow_types(df: DataFrame) -> DataFrame:
    """B1: per numeric column, min/max and the smallest lossless type —
    integers by range, floats to FLOAT only when every value survives the
    round trip (pandas ``downcast`` semantics).  One global aggregate."""
    num = [f for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    aggs = []
    for f in num:
        c = F.col(f.name)
        aggs += [F.min(c).cast("double").alias(f"mn_{f.name}"),
                 F.max(c).cast("double").alias(f"mx_{f.name}")]
        if isinstance(f.dataType, (DoubleType, FloatType)):
            aggs.append(F.max(as_flag(c.cast("float").cast("double") != c)).alias(f"lossy_{f.name}"))
    stats = df.agg(*aggs)
    rows = []
    for f in num:
        mn, mx = F.col(f"mn_{f.name}"), F.col(f"mx_{f.name}")
        if isinstance(f.dataType, IntegralType):
            t = F.lit("bigint")
            for name, lo, hi in reversed(_INT_RANGES):
                t = F.when((mn >= lo) & (mx <= hi), F.lit(name)).otherwise(t)
        else:
            t = F.when(F.coalesce(F.col(f"lossy_{f.name}"), F.lit(0)) == 0, F.lit("float")) \
                 .otherwise(F.lit("double"))
        rows.append(F.struct(F.lit(f.name).alias("column"), mn.alias("min_value"),
                             mx.alias("max_value"), t.alias("narrow_type")))
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def chosen_types(df: DataFrame) -> dict[str, str]:
    """The narrow type of each numeric column (a row per column)."""
    return {r["column"]: r["narrow_type"] for r in narrow_types(df).select("column", "narrow_type").collect()}


def apply_narrow_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns to the types chosen by ``narrow_types`` (sink side)."""
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c)
                       for c in df.columns])
