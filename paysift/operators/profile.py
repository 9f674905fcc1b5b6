"""Table profiles D1-D28, top-k S1-S3, set ops U2 and the overview A9.

Every profile is a (small) aggregate DataFrame computed with partial
aggregation; wide per-column profiles are one ``agg`` (one scan) followed by
an ``explode`` to long form.  Quantiles use the exact bracketed helper in
``functions.quantile`` (no single-task value map).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import as_flag, guarded_corr, safe_div
from ..functions.quantile import Buckets, quantile_row
from ..sources.schema import MONEY_COLS, TARGET

# Percentiles of the univariate describe.
DESCRIBE_PCTS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
# The correlation set of the profile.
CORR_COLS = MONEY_COLS + ["step", TARGET]
HIST_BINS = 100


def _pct(num: Column, den: Column, dp: int = 4) -> Column:
    return F.round(safe_div(num * 100.0, den), dp)


def long_form(df: DataFrame, cols: list[str], name: str = "column",
              value: str = "value") -> DataFrame:
    """Wide → long (one row per (row, column)) as doubles."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols
    ])).alias("_kv")).select(f"_kv.{name}", f"_kv.{value}")


def _stack_agg(row: DataFrame, cols: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn a one-row aggregate with columns ``{prefix}_{col}`` into one row
    per column: ``column, field...``."""
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 *[F.col(f"{p}__{c}").alias(f) for f, p in fields.items()])
        for c in cols])).alias("_r")).select("_r.*")


# --- D1 - D7 ----------------------------------------------------------------

def null_profile(df: DataFrame) -> DataFrame:
    """Per column, missing count and percent (4 dp)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(f"m__{c}") for c in cols])
    out = row.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m__{c}").alias("missing_count"))
        for c in cols])).alias("_r")).select("_n", "_r.*")
    return out.select("column", "missing_count",
                      _pct(F.col("missing_count"), F.col("_n")).alias("missing_pct"))


def class_balance(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Per class count and percent; the 1:N imbalance ratio uses
    max(fraud, 1) as the divisor."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    tot = g.agg(F.sum("count").alias("_t"),
                F.sum(F.when(F.col(label) == 1, F.col("count")).otherwise(0)).alias("_f"),
                F.sum(F.when(F.col(label) == 0, F.col("count")).otherwise(0)).alias("_nf"))
    return (g.crossJoin(F.broadcast(tot))
             .select(label, "count", _pct(F.col("count"), F.col("_t")).alias("pct"),
                     F.round(F.col("_nf") / F.greatest(F.col("_f"), F.lit(1)), 4)
                      .alias("imbalance_ratio"))
             .orderBy(label))


def flag_distribution(df: DataFrame, flag: str = "isFlaggedFraud") -> DataFrame:
    """D3: value counts of the flag column."""
    return df.groupBy(flag).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"))


def type_fraud_rate(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Per type total, fraud count and rate %, by total desc."""
    return (df.groupBy("type")
              .agg(F.count(label).alias("total_count"),
                   F.sum(label).cast("bigint").alias("fraud_count"))
              .withColumn("fraud_rate", _pct(F.col("fraud_count"), F.col("total_count")))
              .orderBy(F.desc("total_count"), "type"))


def _rate_by(df: DataFrame, key: Column, name: str, label: str) -> DataFrame:
    return (df.groupBy(key.alias(name))
              .agg(F.count(label).alias("tx_count"),
                   F.sum(label).cast("bigint").alias("fraud_count"))
              .withColumn("fraud_rate", _pct(F.col("fraud_count"), F.col("tx_count"))))


def hourly_profile(df: DataFrame, label: str = TARGET) -> DataFrame:
    """D5 (+D7): per hour of step count, fraud, rate %."""
    return _rate_by(df, F.pmod(F.col("step"), F.lit(24)).cast("int"), "hour", label).orderBy("hour")


def daily_profile(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Per day count, fraud, rate %; plus the number of days and the day
    range (computed over the small per-day table)."""
    d = _rate_by(df, F.floor(F.col("step") / 24).cast("int"), "day", label)
    s = d.agg(F.count(F.lit(1)).alias("n_days"), F.min("day").alias("day_min"),
              F.max("day").alias("day_max"))
    return d.crossJoin(F.broadcast(s)).orderBy("day")


def mean_hourly_fraud_rate(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Mean fraud rate (%) per hour (avg(label)*100)."""
    return (df.groupBy(F.pmod(F.col("step"), F.lit(24)).cast("int").alias("hour"))
              .agg((F.avg(label) * 100).alias("fraud_rate_pct")))


# --- D8 - D11 ---------------------------------------------------------------

def numeric_describe(df: DataFrame, cols=MONEY_COLS, pcts=DESCRIBE_PCTS) -> DataFrame:
    """Count, mean, sample std, min, percentiles, max per column
    (nulls and NaN left out).  One pass gives the bucket counts and the moments of
    all columns, two more the percentiles."""
    return column_profile(df, cols, pcts)[0]


def column_profile(df: DataFrame, cols=MONEY_COLS, pcts=DESCRIBE_PCTS, quartiles: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """D8 and, with ``quartiles``, the fences of D9 (column, q1, q3, iqr, lower,
    upper), from the same three passes."""
    cols = list(cols)
    b = Buckets(long_form(df.select(*cols), cols), "value", ["column"], moments=True)
    names = {f"p{int(round(p * 100))}": p for p in pcts}
    qs = b.quantile_row(names | ({"_q1": 0.25, "_q3": 0.75} if quartiles else {}))
    if quartiles:
        from ..sources.files import cut_lineage
        qs = cut_lineage(qs, "column-quantiles")  # a row per column, read by both
    described = b.moments().join(F.broadcast(qs), "column").select("column", "count", "mean", "std", "min", *names.keys(), "max")
    return described, _fences(qs.select("column", F.col("_q1").alias("q1"), F.col("_q3").alias("q3"))) if quartiles else None


def _fences(q: DataFrame) -> DataFrame:
    return (q.withColumn("iqr", F.col("q3") - F.col("q1"))
             .withColumn("lower", F.col("q1") - 1.5 * F.col("iqr"))
             .withColumn("upper", F.col("q3") + 1.5 * F.col("iqr")))


def iqr_outliers(df: DataFrame, cols=MONEY_COLS, fences: DataFrame | None = None) -> DataFrame:
    """Q1, Q3, IQR, fences (1.5·IQR) and strict outlier count / % (2 dp
    in the reference print; full precision here).  ``fences`` from
    ``column_profile`` save the three passes of the quartiles; the counts are one
    aggregate with two columns per column, so rows are not unpivoted for them."""
    from ..sources.files import cut_lineage
    cols = list(cols)
    if fences is None:
        fences = cut_lineage(_fences(quantile_row(long_form(df.select(*cols), cols), "value", {"q1": 0.25, "q3": 0.75}, by=["column"])), "fences")
    wide = fences.agg(*[F.max(F.when(F.col("column") == c, F.col(s))).alias(f"{s}__{c}") for c in cols for s in ("lower", "upper")])
    counts = df.select(*cols).crossJoin(F.broadcast(wide)).agg(F.count(F.lit(1)).alias("_n"), *[  # one row
        F.count_if((F.col(c) < F.col(f"lower__{c}")) | (F.col(c) > F.col(f"upper__{c}"))).alias(f"o__{c}") for c in cols])
    long = counts.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o__{c}").alias("n_outliers")) for c in cols])).alias("_r")).select("_n", "_r.*")
    return (fences.join(F.broadcast(long), "column")  # a row per column
            .select("column", "q1", "q3", "iqr", "lower", "upper", "n_outliers", (F.col("n_outliers") * 100.0 / F.col("_n")).alias("outlier_pct")))


def eda_errors(df: DataFrame) -> DataFrame:
    """The profile's balance-equation errors (receiver sign is the opposite
    of the feature F2)."""
    return df.withColumns({
        "errorOrig": F.col("oldbalanceOrg") - F.col("newbalanceOrig") - F.col("amount"),
        "errorDest": F.col("newbalanceDest") - F.col("oldbalanceDest") - F.col("amount"),
    })


def balance_consistency(df: DataFrame) -> DataFrame:
    """Per error column, non-zero count / % and describe statistics."""
    e = eda_errors(df)
    cols = ["errorOrig", "errorDest"]
    desc = numeric_describe(e, cols, [0.25, 0.5, 0.75])
    nz = _stack_agg(e.agg(*[x for c in cols for x in (F.count_if(F.col(c) != 0).alias(f"n__{c}"), (F.avg(as_flag(F.col(c) != 0)) * 100).alias(f"p__{c}"))]),
                    cols, {"nonzero_count": "n", "nonzero_pct": "p"})
    return desc.join(F.broadcast(nz), "column")  # a row per column


def error_by_class(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Per (error column, class) mean, std, min, max, % non-zero."""
    e = eda_errors(df).select(label, "errorOrig", "errorDest")
    lf = e.select(label, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))
        for c in ["errorOrig", "errorDest"]])).alias("_kv")).select(label, "_kv.*")
    return lf.groupBy("column", label).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        (F.avg(as_flag(F.col("value") != 0)) * 100).alias("nonzero_pct"))


# --- D12 - D19, S1 - S3, U2 -------------------------------------------------

def entity_counts(df: DataFrame, col: str) -> DataFrame:
    """(entity, txn_count): what D12, S1 and U2 count, summed in the tasks first."""
    return df.groupBy(F.col(col).alias("entity")).agg(F.count(F.lit(1)).alias("txn_count"))


def _n_distinct(df: DataFrame, col: str, name: str, approx: bool = False) -> DataFrame:
    """One row: distinct non-null values, each column in an aggregate of its own
    (several exact distinct counts in one would copy every row per column)."""
    if approx:
        return df.agg(F.approx_count_distinct(col, 0.01).alias(name))
    return entity_counts(df, col).agg(F.count("entity").alias(name))


def entity_stats(df: DataFrame, cols=("nameOrig", "nameDest"), approx: bool = False) -> DataFrame:
    """Distinct entities and average transactions per entity (exact, from the
    counts per entity; ``approx=True`` uses HyperLogLog++ sketches, which
    merge map-side and never shuffle the keys)."""
    def one(c):
        if approx:
            row = df.agg(F.count(F.lit(1)).alias("_n"), F.approx_count_distinct(c, 0.01).alias("n_unique"))
        else:
            row = entity_counts(df, c).agg(F.sum("txn_count").alias("_n"), F.count("entity").alias("n_unique"))
        return row.select(F.lit(c).alias("column"), "n_unique", (F.col("_n") / F.col("n_unique")).alias("avg_txn_per_entity"))

    return reduce(DataFrame.unionAll, [one(c) for c in cols])


def entity_profile(df: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """D12, S1 of both sides and U2 from two written tables of counts."""
    from ..sources.files import cut_lineage
    s, r = (cut_lineage(entity_counts(df, c), c) for c in ("nameOrig", "nameDest"))
    stats = reduce(DataFrame.unionAll, [t.agg(F.sum("txn_count").alias("_n"), F.count("entity").alias("n_unique")).select(
        F.lit(c).alias("column"), "n_unique", (F.col("_n") / F.col("n_unique")).alias("avg_txn_per_entity")) for c, t in (("nameOrig", s), ("nameDest", r))])
    top = [t.select(F.col("entity").alias(c), "txn_count").orderBy(F.desc("txn_count"), F.asc(c)).limit(n) for c, t in (("nameOrig", s), ("nameDest", r))]
    both = s.where("entity is not null").join(r.select("entity"), "entity", "left_semi").agg(F.count(F.lit(1)).alias("overlap_count"))
    return stats, *top, both


def top_entities(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Top-n entities by transaction count (key breaks ties) — a
    partial-aggregated count followed by TakeOrderedAndProject."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("txn_count"))
              .orderBy(F.desc("txn_count"), F.asc(col)).limit(n))


def entity_overlap(df: DataFrame) -> DataFrame:
    """Number of entities that are both sender and receiver."""
    s = df.select(F.col("nameOrig").alias("entity")).where(F.col("entity").isNotNull())
    r = df.select(F.col("nameDest").alias("entity")).where(F.col("entity").isNotNull())
    return s.intersect(r).agg(F.count(F.lit(1)).alias("overlap_count"))


def amount_by_class(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Per class mean, exact median, std, min, max of amount."""
    mom = df.groupBy(label).agg(F.avg("amount").alias("mean"),
                                F.stddev_samp("amount").alias("std"),
                                F.min("amount").alias("min"), F.max("amount").alias("max"))
    med = quantile_row(df, "amount", {"median": 0.5}, by=[label])
    return mom.join(F.broadcast(med), label).select(label, "mean", "median", "std", "min", "max")


def fraud_share_by_type(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Per type, fraud count, % of all fraud, % of the type's rows
    (types with fraud only, as value_counts on the fraud subset)."""
    g = df.groupBy("type").agg(F.sum(label).cast("bigint").alias("fraud_count"),
                               F.count(F.lit(1)).alias("_type_n"))
    tot = g.agg(F.sum("fraud_count").alias("_tf"))
    return (g.where(F.col("fraud_count") > 0).crossJoin(F.broadcast(tot))
             .select("type", "fraud_count",
                     (F.col("fraud_count") * 100.0 / F.col("_tf")).alias("pct_of_fraud"),
                     (F.col("fraud_count") * 100.0 / F.col("_type_n")).alias("pct_of_type"))
             .orderBy(F.desc("fraud_count"), "type"))


def fraud_balance_patterns(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Within fraud, drained senders and zero-balance receivers."""
    f = df.where(F.col(label) == 1)
    return f.agg(F.count(F.lit(1)).alias("fraud_count"),
                 F.count_if(F.col("newbalanceOrig") == 0).alias("sender_zeroed"),
                 F.count_if(F.col("oldbalanceDest") == 0).alias("receiver_zero")) \
            .withColumn("sender_zeroed_pct", F.col("sender_zeroed") * 100.0 / F.col("fraud_count")) \
            .withColumn("receiver_zero_pct", F.col("receiver_zero") * 100.0 / F.col("fraud_count"))


def top_fraud_hours(df: DataFrame, n: int = 5, label: str = TARGET) -> DataFrame:
    """The n hours with most fraud (hour breaks ties)."""
    return (df.where(F.col(label) == 1)
              .groupBy(F.pmod(F.col("step"), F.lit(24)).cast("int").alias("hour"))
              .agg(F.count(F.lit(1)).alias("fraud_count"))
              .orderBy(F.desc("fraud_count"), "hour").limit(n))


def type_stacked_counts(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Fraud / non-fraud counts per type."""
    return (df.groupBy("type")
              .agg(F.sum(label).cast("bigint").alias("fraud"), F.count(label).alias("total"))
              .withColumn("non_fraud", F.col("total") - F.col("fraud")))


def histogram(df: DataFrame, value, by=(), bins: int = HIST_BINS, positive_only: bool = False,
              density: bool = False, ranges: DataFrame | None = None) -> DataFrame:
    """``bins`` equal-width bins between the data min and max per
    group (NumPy semantics: the max falls in the last bin).  With
    ``positive_only`` the histogram uses x > 0 when any exists, else all rows
    (D16 / B8).  Empty bins are emitted with count 0.  One pass finds the ranges
    (or the caller has them: by..., _lo, _hi, _n), one counts.  ``by`` must be a
    low-cardinality grouping: the table of ranges, a row per group, is broadcast."""
    from ..sources.files import cut_lineage
    by = list(by)
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    base = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if ranges is None:
        pos = F.when(F.col("_x") > 0, F.col("_x"))
        some = F.count(pos) > 0 if positive_only else F.lit(False)
        ranges = base.groupBy(*by).agg(
            F.when(some, F.min(pos)).otherwise(F.min("_x")).alias("_lo"), F.max("_x").alias("_hi"),
            F.when(some, F.count(pos)).otherwise(F.count(F.lit(1))).alias("_n"), some.alias("_positive"))
    else:
        ranges = ranges.withColumn("_positive", F.lit(False))
    # NumPy widens an empty range to [lo - 0.5, hi + 0.5].
    flat = F.col("_lo") == F.col("_hi")
    rng = (ranges.withColumn("_lo2", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")))
                 .withColumn("_hi2", F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")))
                 .withColumn("_w", (F.col("_hi2") - F.col("_lo2")) / bins))
    rng = cut_lineage(rng.select(*by, "_lo2", "_w", "_n", "_positive"), "ranges")
    small = F.broadcast(rng.select(*by, "_lo2", "_w", "_positive"))
    j = (base.join(small, by) if by else base.crossJoin(small)).where(~F.col("_positive") | (F.col("_x") > 0))
    b = F.least(F.floor((F.col("_x") - F.col("_lo2")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    counts = j.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select(*by, "_lo2", "_w", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = (grid.join(counts, by + ["bin"], "left")
               .select(*by, "bin",
                       (F.col("_lo2") + F.col("bin") * F.col("_w")).alias("bin_lo"),
                       (F.col("_lo2") + (F.col("bin") + 1) * F.col("_w")).alias("bin_hi"),
                       F.coalesce(F.col("count"), F.lit(0)).alias("count"),
                       "_n", "_w"))
    if density:
        out = out.withColumn("density", F.col("count") / (F.col("_n") * F.col("_w")))
    return out.drop("_n", "_w")


def histogram_columns(df: DataFrame, cols=MONEY_COLS, bins: int = HIST_BINS) -> DataFrame:
    """D16 for several columns at once (positive values, log-axis data)."""
    lf = long_form(df.select(*cols), list(cols))
    return histogram(lf, "value", by=["column"], bins=bins, positive_only=True)


def histogram_clipped(df: DataFrame, label: str = TARGET, bins: int = HIST_BINS) -> DataFrame:
    """Per (error column, class) histogram after clipping to that
    group's p1..p99."""
    from ..sources.files import cut_lineage
    e = cut_lineage(eda_errors(df).select(label, "errorOrig", "errorDest"), "errors")  # read four times
    lf = e.select(label, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))
        for c in ["errorOrig", "errorDest"]])).alias("_kv")).select(label, "_kv.*")
    lf = lf.where(F.col("value").isNotNull())
    b = Buckets(lf, "value", ["column", label])
    q = cut_lineage(b.quantile_row({"_p1": 0.01, "_p99": 0.99}), "clips")  # a row per column and class
    c = (lf.join(F.broadcast(q), ["column", label])
           .withColumn("value", F.least(F.greatest(F.col("value"), F.col("_p1")), F.col("_p99"))))
    # Clipped values reach from p1 to p99, so the ranges are known.
    ranges = q.join(b.sizes(), ["column", label]).select("column", label, F.col("_p1").alias("_lo"), F.col("_p99").alias("_hi"), "_n")
    return histogram(c, "value", by=["column", label], bins=bins, ranges=ranges)


def histogram_density(df: DataFrame, label: str = TARGET, bins: int = HIST_BINS) -> DataFrame:
    """Density histograms by class — amount (x > 0) and the sender
    balance change clipped to ±1e7."""
    amt = df.where(F.col("amount") > 0).select(label, F.lit("amount").alias("column"),
                                              F.col("amount").alias("value"))
    chg = df.select(label, F.lit("balance_change_orig").alias("column"),
                    F.least(F.greatest(F.col("oldbalanceOrg") - F.col("newbalanceOrig"),
                                       F.lit(-1e7)), F.lit(1e7)).alias("value"))
    return histogram(amt.unionByName(chg), "value", by=["column", label], bins=bins, density=True)


# --- D20 - D27 ---------------------------------------------------------------

def correlation_matrix(df: DataFrame, cols=CORR_COLS) -> DataFrame:
    """Pearson matrix as long form (col_a, col_b, r) — all pairs in ONE
    aggregate; zero-variance pairs give NULL (no ANSI error)."""
    cols = list(cols)
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(guarded_corr(F.col(a).cast("double"), F.col(b).cast("double"))
                        .alias(f"{i}|{cols.index(b)}"))
    row = df.agg(*aggs)
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            k = f"{min(i, j)}|{max(i, j)}"
            pairs.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                  F.lit(i).alias("i"), F.lit(j).alias("j"),
                                  F.col(f"`{k}`").alias("r")))
    return row.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*")


def strong_correlations(df: DataFrame, cols=CORR_COLS, threshold: float = 0.7) -> DataFrame:
    """Upper-triangle pairs with |r| > threshold."""
    return (correlation_matrix(df, cols)
            .where((F.col("i") < F.col("j")) & (F.abs("r") > threshold))
            .select("col_a", "col_b", "r"))


def target_correlation(df: DataFrame, features: list[str], label: str = TARGET) -> DataFrame:
    """Corr of every feature with the target in ONE aggregate; NULL
    (zero variance) dropped; ordered by |r| desc."""
    row = df.agg(*[guarded_corr(F.col(c).cast("double"), F.col(label).cast("double"))
                   .alias(f"c{i}") for i, c in enumerate(features)])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("corr"))
        for i, c in enumerate(features)])).alias("_r")).select("_r.*")
    return long.where(F.col("corr").isNotNull()).orderBy(F.desc(F.abs("corr")), "feature")


def top_feature_corr(df: DataFrame, features: list[str], k: int = 15, label: str = TARGET) -> DataFrame:
    """Correlation matrix of the top-k features by |corr with target|
    plus the target.  The top-k list is a bounded (k-row) result; the matrix
    itself needs the column names at plan time, so the k names are read from
    the small ranking (not from the data)."""
    top = [r["feature"] for r in target_correlation(df, features, label).limit(k).collect()]
    return correlation_matrix(df, top + [label])


def night_vs_day(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Per is_night count, fraud rate %, share of all rows %."""
    night = as_flag(F.pmod(F.col("step"), F.lit(24)).between(0, 6)) if "is_night" not in df.columns \
        else F.col("is_night")
    g = df.groupBy(night.alias("is_night")).agg(F.count(F.lit(1)).alias("tx_count"),
                                               (F.avg(label) * 100).alias("fraud_rate"))
    return g.withColumn("share_pct", F.col("tx_count") * 100.0 / F.sum("tx_count").over(Window.partitionBy()))


def flag_lift(df: DataFrame, flags: list[str], label: str = TARGET) -> DataFrame:
    """Per flag, prevalence % and fraud rate % among flagged rows (0 when
    the flag is never set)."""
    aggs = []
    for f in flags:
        aggs += [(F.avg(F.col(f)) * 100).alias(f"p__{f}"),
                 F.coalesce(F.avg(F.when(F.col(f) == 1, F.col(label))) * 100, F.lit(0.0)).alias(f"r__{f}")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.col(f"p__{f}").alias("prevalence_pct"),
                 F.col(f"r__{f}").alias("fraud_rate_pct")) for f in flags])).alias("_r")).select("_r.*")


def feature_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per feature mean, sample std, max — one aggregate."""
    row = df.agg(*[e for c in cols for e in (
        F.avg(c).alias(f"mean__{c}"), F.stddev_samp(c).alias(f"std__{c}"),
        F.max(F.col(c).cast("double")).alias(f"max__{c}"))])
    return _stack_agg(row, cols, {"mean": "mean", "std": "std", "max": "max"})


def nan_inf_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN and ±inf cell counts per (double) column."""
    row = df.agg(*[e for c in cols for e in (
        F.count_if(F.isnan(c)).alias(f"nan__{c}"),
        F.count_if(F.abs(F.col(c)) == F.lit(float("inf"))).alias(f"inf__{c}"))])
    return _stack_agg(row, cols, {"nan_count": "nan", "inf_count": "inf"})


# --- A9 -----------------------------------------------------------------------

def dataset_overview(df: DataFrame, label: str = TARGET, approx: bool = False) -> DataFrame:
    """Rows, ticks, types, senders, receivers, fraud count / %,
    imbalance ratio (total // fraud), % of fraud that drained the sender.  One
    aggregate per (tick, type), a small written table, has all but the entities;
    those are counted one aggregate each.  ``approx=True`` counts senders and
    receivers with HyperLogLog++."""
    from ..sources.files import cut_lineage
    drained = F.when(F.col(label) == 1, as_flag(F.col("newbalanceOrig") == 0))
    small = cut_lineage(df.groupBy("step", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("bigint").alias("fraud"), F.sum(drained).alias("drained"), F.count(drained).alias("known")), "overview")
    row = small.agg(F.sum("n").alias("n_rows"), F.sum("fraud").cast("bigint").alias("fraud_count"), F.try_divide(F.sum("drained").cast("double"), F.sum("known")).alias("_drain"))
    for t, c, name in ((small, "step", "n_steps"), (small, "type", "n_types"), (df, "nameOrig", "n_senders"), (df, "nameDest", "n_receivers")):
        row = row.crossJoin(F.broadcast(_n_distinct(t, c, name, approx and t is df)))  # one row each
    return row.select(
        "n_rows", "n_steps", "n_types", "n_senders", "n_receivers", "fraud_count",
        (F.col("fraud_count") * 100.0 / F.col("n_rows")).alias("fraud_pct"),
        F.floor(F.col("n_rows") / F.greatest(F.col("fraud_count"), F.lit(1))).cast("bigint")
         .alias("imbalance_ratio"),
        (F.col("_drain") * 100).alias("drained_pct"))
