"""Skew-safe "aggregate, then attach to every row" (W1 / C1 / C2).

The reference groups, aggregates and merges the aggregate back onto each row.
Two Spark plans express it:

* ``window``: ``agg.over(Window.partitionBy(keys, salt))`` — one Exchange.  Keys
  of at most ``hot_rows`` rows have one salt, so the window is theirs alone.  A
  hot key's rows are dealt over ``ceil(rows / hot_rows)`` salts and take their
  values from its row of the hot-key list, which carries the aggregates
  (partial aggregation before its shuffle); no window partition exceeds
  ~``hot_rows`` rows.
* ``join`` (default): ``groupBy(keys).agg`` with partial (map-side)
  aggregation, then a left join back.  Hot keys — more than ``hot_rows`` rows —
  are split: their detail rows get a deterministic salt in
  ``[0, ceil(rows / hot_rows))`` and their single aggregate row is replicated
  once per salt, so no (key, salt) join group exceeds ~``hot_rows`` rows.
  The hot-key list is broadcast; it has at most ``N / hot_rows`` rows, a
  bound that holds by construction.  Salts come from a hash of the row, never
  ``rand()``; rows with a NULL key are salted the same way (they match nothing,
  but would all be dealt to one task), so a recomputed task after an executor loss re-draws the same
  salt.  AQE may still turn the join into a broadcast when the aggregate is
  small at runtime.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
#: Rows with a NULL key never match; they are dealt over this many salts.
NULL_PARTS = 1 << 16


def salted_left_join(detail: DataFrame, stats: DataFrame, keys: list[str],
                     rows_col: str = "_rows", hot_rows: int = HOT_ROWS,
                     row_key: list[str] | None = None) -> DataFrame:
    """Left-join ``stats`` (one row per key, with a row-count column
    ``rows_col``) onto ``detail``, splitting hot keys."""
    row_key = row_key or detail.columns
    hot = F.broadcast(  # <= N / hot_rows rows
        stats.where(F.col(rows_col) > hot_rows)
             .select(*keys, F.ceil(F.col(rows_col) / F.lit(hot_rows)).cast("int").alias("_parts")))
    d = detail.join(hot, keys, "left").withColumn("_salt", _row_salt(keys, row_key)).drop("_parts")
    s = (stats.join(hot, keys, "left")
              .withColumn("_salt", F.explode(F.sequence(
                  F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
              .drop("_parts", rows_col))
    return d.join(s, keys + ["_salt"], "left").drop("_salt")


def _row_salt(keys: list[str], row_key: list[str]) -> Column:
    """Salt of a row joined with the hot-key list (``_parts``)."""
    null_key = reduce(or_, [F.col(k).isNull() for k in keys])
    row_hash = F.xxhash64(*row_key)
    return (F.when(null_key, F.pmod(row_hash, F.lit(NULL_PARTS)))
             .when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(row_hash, F.col("_parts")))).cast("int")


def _attach_by_window(detail: DataFrame, keys: list[str], aggs: dict[str, Column], hot_rows: int,
                      row_key: list[str], of: DataFrame) -> DataFrame:
    notnull = reduce(and_, [F.col(k).isNotNull() for k in keys])
    hot = F.broadcast(  # <= N / hot_rows rows
        of.where(notnull).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.struct(*[e.alias(n) for n, e in aggs.items()]).alias("_hot"))
          .where(F.col("_rows") > hot_rows)
          .select(*keys, F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("int").alias("_parts"), "_hot"))
    d = detail.join(hot, keys, "left").withColumn("_salt", _row_salt(keys, row_key))
    w = Window.partitionBy(*keys, "_salt")
    return d.select(*detail.columns, *[F.when(F.col("_parts").isNotNull(), F.col(f"_hot.{n}")).when(notnull, e.over(w)).alias(n)
                                       for n, e in aggs.items()])


def _frequent(rows: DataFrame, keys: list[str], aggs: dict[str, Column], hot_rows: int, name: str) -> DataFrame:
    """(keys, ``_parts<name>``, ``_hot<name>``: struct of ``aggs``) of the keys with more
    than ``hot_rows`` rows; at most N / hot_rows rows.  Only keys in hash buckets of
    that many rows are grouped: few buckets have them, unless a key is hot."""
    rows = rows.where(reduce(and_, [F.col(k).isNotNull() for k in keys])).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(NULL_PARTS)))
    full = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select("_bucket")
    return (rows.join(F.broadcast(full), "_bucket", "left_semi").groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_rows"), F.struct(*[e.alias(n) for n, e in aggs.items()]).alias(f"_hot{name}"))
            .where(F.col("_rows") > hot_rows).select(*keys, F.ceil(F.col("_rows") / F.lit(hot_rows)).cast("int").alias(f"_parts{name}"), f"_hot{name}"))


def attach_nested_aggregates(detail: DataFrame, key: str, aggs: dict[str, Column], sub: str, sub_aggs: dict[str, Column],
                             hot_rows: int = HOT_ROWS, row_key: list[str] | None = None, store=lambda t: t) -> DataFrame:
    """Append ``aggs`` per ``key`` and ``sub_aggs`` per (``key``, ``sub``) by windows over
    ONE exchange and one sort of the detail rows; NULL keys get NULL.

    Rows of a hot key are dealt out by ``sub`` and take the key's aggregates from
    the hot-key list; those of a hot (key, sub) are dealt out row by row and take
    both.  ``store`` is applied to the two lists (to write them once)."""
    hot = store(_frequent(detail, [key], aggs, hot_rows, "1"))
    # A (key, sub) is hot only if its key is.
    few = detail.join(F.broadcast(hot.select(key)), key, "left_semi")
    hot_sub = store(_frequent(few, [key, sub], sub_aggs, hot_rows, "2"))
    of_row = F.xxhash64(*(row_key or detail.columns))
    salt = (F.when(F.col(key).isNull(), F.pmod(of_row, F.lit(NULL_PARTS))).when(F.col("_parts2").isNotNull(), F.pmod(of_row, F.col("_parts2")))
            .when(F.col("_parts1").isNotNull(), F.pmod(F.xxhash64(sub), F.col("_parts1"))).otherwise(F.lit(0)))
    d = detail.join(F.broadcast(hot.select(key, "_parts1")), key, "left").join(F.broadcast(hot_sub.select(key, sub, "_parts2")), [key, sub], "left")
    d = d.select(*detail.columns, salt.cast("int").alias("_salt")).repartition(key, "_salt").sortWithinPartitions(key, "_salt", sub)
    has, has_sub = F.col(key).isNotNull(), F.col(key).isNotNull() & F.col(sub).isNotNull()
    every, each = Window.partitionBy(key, "_salt"), Window.partitionBy(key, "_salt", sub)
    d = d.select("*", *[F.when(has, e.over(every)).alias(n) for n, e in aggs.items()])
    d = d.select("*", *[F.when(has_sub, e.over(each)).alias(n) for n, e in sub_aggs.items()])
    d = d.join(F.broadcast(hot.select(key, "_hot1")), key, "left").join(F.broadcast(hot_sub.select(key, sub, "_hot2")), [key, sub], "left")
    taken = lambda names, h: [F.when(F.col(h).isNotNull(), F.col(f"{h}.{n}")).otherwise(F.col(n)).alias(n) for n in names]
    return d.select(*detail.columns, *taken(aggs, "_hot1"), *taken(sub_aggs, "_hot2"))


def attach_group_aggregates(detail: DataFrame, keys: list[str], aggs: dict[str, Column],
                            strategy: str = "join", hot_rows: int = HOT_ROWS,
                            row_key: list[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """Append ``aggs`` (name → aggregate expression) computed per ``keys`` to
    every row of ``detail``.  Rows whose key is NULL get NULL aggregates (the
    reference's group-by drops NULL keys, so the merge leaves them missing).
    ``of``: a table with the same rows to aggregate from, where ``detail`` is
    a longer plan over it (``detail`` itself if not given)."""
    of = detail if of is None else of
    if strategy == "window":
        return _attach_by_window(detail, keys, aggs, hot_rows, row_key or detail.columns, of)
    stats = of.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()],
                                  F.count(F.lit(1)).alias("_rows"))
    return salted_left_join(detail, stats, keys, "_rows", hot_rows, row_key)
