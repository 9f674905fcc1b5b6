"""Exact quantiles by distributed radix selection.

Spark's exact ``percentile`` aggregate merges a value→count map of every
distinct value of a group into one task, and ``percentile_approx`` merges one
sketch per partition into one task — both unbounded at 100 TB.  Here the
answer is exact (linear interpolation between order statistics, equal to
DuckDB ``quantile_cont`` / NumPy ``linear``) and every single-task step works
on a bounded table:

* every double gets two monotone bucket keys from one ``log2`` (coarse:
  256 buckets per octave, fine: 2^30 per octave) — built-in functions only;
* round 1 counts rows per coarse bucket (≤ ~2^19 buckets per group,
  partial aggregation) and a running count locates, for each target rank,
  its bucket and its rank inside the bucket;
* round 2 re-scans only rows of those buckets (broadcast join with the
  #groups × #quantiles × 2 targets) and counts fine buckets (≤ 2^22 per
  coarse bucket);
* round 3 reduces rows of the chosen fine buckets (values within a relative
  width of ~6·10^-10) to distinct values with counts and picks the order
  statistic.

The coarse bucket table (bounded, see round 1) is written once: row counts,
target ranks and, if asked for, the moments of each group come from it.  The two
tiny target tables between rounds (bucket ids per target rank) are materialised
as local relations, so each round scans the input once, three times in all.

``by`` must be a low-cardinality grouping (class label, payment type): the
target tables are broadcast and their size is #groups × len(qs) × 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OFF1 = 1 << 20      # > 256 * 1075 (log2 of the smallest subnormal is -1074)
_OFF2 = 1 << 42      # > 2^30 * 1075


def with_log_keys(df: DataFrame, x: str) -> DataFrame:
    """Append two monotone (non-decreasing in ``x``) bucket keys:
    ``_k1 = ±(floor(256·log2|x|) + off)`` and the finer
    ``_k2 = ±(floor(2^30·log2|x|) + off)``, mirrored for negatives, 0 for
    zero.  ``log2`` is semi-monotonic, so ordering by (k1, k2, x) is
    ordering by x; a k1 bucket spans a relative width of 2^(1/256) − 1
    (0.27 %) and holds at most 2^22 distinct k2 values."""
    a = F.abs(F.col(x))
    d = df.withColumn("_qL", F.log2(a))
    inf = F.lit(float("inf"))

    def key(scale, off, top):
        k = F.floor(F.col("_qL") * scale).cast("long") + F.lit(off)
        k = F.when(a == inf, F.lit(top)).when(a == 0, F.lit(0)).otherwise(k)
        return F.when(F.col(x) < 0, -k).otherwise(k)
    d = d.withColumn("_k1", key(256.0, _OFF1, 2 * _OFF1)).withColumn("_k2", key(float(1 << 30), _OFF2, 2 * _OFF2))
    return d.drop("_qL")


def _cut(df: DataFrame) -> DataFrame:
    """Materialise a tiny target table — #groups × #quantiles × 2 rows, a
    bound fixed by the call, not by the data — as a local relation, so the
    next round's plan does not re-embed (and re-run) the previous rounds.
    Like the split points of a range partitioner, only these bounded
    bucket ids pass through the driver, never data rows."""
    rows = df.collect()
    return df.sparkSession.createDataFrame(rows, df.schema)


def _locate(counts: DataFrame, part: list[str], order: str, targets: DataFrame,
            tkeys: list[str], out: str) -> DataFrame:
    """For each target row (tkeys + ``_rank``), find the ``order`` value whose
    cumulative count range covers ``_rank``; return tkeys + ``out`` + the
    rank inside it (``_rank``)."""
    w = (Window.partitionBy(*part).orderBy(order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = counts.withColumn("_end", F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))
    j = c.join(F.broadcast(targets), part) if part else c.crossJoin(F.broadcast(targets))
    hit = j.where((F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_end")))
    return hit.select(*tkeys, F.col(order).alias(out), (F.col("_rank") - F.col("_start")).alias("_rank"))


class Buckets:
    """Round 1 over ``value`` (nulls and NaN left out) per group: a written table
    of coarse buckets with their counts and, with ``moments``, their mean, squared
    deviations, least and greatest value."""

    def __init__(self, df: DataFrame, value, by=(), moments: bool = False):
        from ..sources.files import cut_lineage
        self.by, self.moments_kept = list(by), moments
        x = (F.col(value) if isinstance(value, str) else value).cast("double")
        self.rows = with_log_keys(df.select(*self.by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")), "_x")
        more = [F.avg("_x").alias("_avg"), F.var_pop("_x").alias("_var"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")] if moments else []
        self.counts = cut_lineage(self.rows.groupBy(*self.by, F.col("_k1").alias("_b1")).agg(F.count(F.lit(1)).alias("_c"), *more), "buckets")

    def sizes(self) -> DataFrame:
        return self.counts.groupBy(*self.by).agg(F.sum("_c").alias("_n"))

    def moments(self) -> DataFrame:
        """by..., count, mean, std (sample), min, max: the buckets' moments put
        together, their deviations from the group's mean taken before squaring."""
        if not self.moments_kept:
            raise ValueError("these buckets have counts only")
        every = Window.partitionBy(*self.by) if self.by else Window.partitionBy(F.lit(0))  # over a bounded table
        c = self.counts.withColumn("_n", F.sum("_c").over(every)).withColumn("_mean", F.sum(F.col("_avg") * F.col("_c")).over(every) / F.col("_n"))
        off = F.col("_c") * (F.col("_var") + (F.col("_avg") - F.col("_mean")) * (F.col("_avg") - F.col("_mean")))
        return c.groupBy(*self.by).agg(F.max("_n").alias("count"), F.max("_mean").alias("mean"),
                                       F.sqrt(F.try_divide(F.sum(off), F.nullif(F.max("_n") - 1, F.lit(0)))).alias("std"), F.min("_lo").alias("min"), F.max("_hi").alias("max"))

    def quantiles(self, qs) -> DataFrame:
        """Long form: columns ``*by, qi (int), q (double), value (double)``."""
        by, base, c1 = self.by, self.rows, self.counts
        qs = [float(q) for q in qs]
        qt = F.explode(F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(q).alias("q")) for i, q in enumerate(qs)]))
        tg = (self.sizes().select(*by, "_n", qt.alias("_t")).select(*by, "_n", "_t.qi", "_t.q")
              .withColumn("_rn", (F.col("_n") - 1).cast("double") * F.col("q"))
              .withColumn("_p0", F.floor("_rn").cast("long"))
              .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
              .withColumn("_rank", F.when(F.col("_side") == 0, F.col("_p0")).otherwise(F.ceil("_rn").cast("long"))))
        tkeys = by + ["qi", "_side"]
        t1 = _cut(_locate(c1.select(*by, "_b1", "_c"), by, "_b1", tg.select(*tkeys, "_rank"), tkeys, "_b1"))

        # round 2: next 24 key bits, only rows of the located coarse buckets
        r2 = base.withColumn("_b1", F.col("_k1")).join(F.broadcast(t1.withColumnRenamed("_rank", "_r1")), by + ["_b1"])
        c2 = r2.groupBy(*tkeys, F.col("_k2").alias("_b2")).agg(F.count(F.lit(1)).alias("_c"))
        t2 = _cut(_locate(c2, tkeys, "_b2", t1.select(*tkeys, "_rank"), tkeys, "_b2"))

        # round 3: distinct values of the located fine buckets
        t12 = t1.select(*tkeys, "_b1").join(t2, tkeys)
        r3 = (base.withColumn("_b1", F.col("_k1")).withColumn("_b2", F.col("_k2"))
                  .join(F.broadcast(t12.withColumnRenamed("_rank", "_r2")), by + ["_b1", "_b2"]))
        c3 = r3.groupBy(*tkeys, "_x").agg(F.count(F.lit(1)).alias("_c"))
        t3 = _locate(c3, tkeys, "_x", t2.select(*tkeys, "_rank"), tkeys, "_v")

        v = t3.groupBy(*by, "qi").agg(F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_v0"),
                                      F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_v1"))
        meta = tg.where(F.col("_side") == 0).select(*by, "qi", "q", "_rn", "_p0")
        out = meta.join(v, by + ["qi"])
        val = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_rn") - F.col("_p0"))
        return out.select(*by, "qi", "q", val.cast("double").alias("value"))

    def quantile_row(self, named_qs: dict) -> DataFrame:
        """Wide form: one row per group with one column per name in ``named_qs``."""
        names = list(named_qs)
        return self.quantiles([named_qs[n] for n in names]).groupBy(*self.by).agg(*[
            F.max(F.when(F.col("qi") == i, F.col("value"))).alias(n) for i, n in enumerate(names)])


def quantiles(df: DataFrame, value, qs, by=()) -> DataFrame:
    """Long form: columns ``*by, qi (int), q (double), value (double)``."""
    return Buckets(df, value, by).quantiles(qs)


def quantile_row(df: DataFrame, value, named_qs: dict, by=()) -> DataFrame:
    """Wide form: one row per group with one column per name in ``named_qs``."""
    return Buckets(df, value, by).quantile_row(named_qs)
