"""The transactions view over the driver's star-schema tables.

The reference reads one flat payment table.  Our inputs are the driver's
parquet tables, so the payment table is *derived* by Spark from them (see
FIXTURES.md §1 for the mapping); its size grows with ``lineitem``.

Plan shape: ``orders ⋈ customer``, then ``lineitem ⋈`` the result (both large:
sort-merge on the order key), then ``⋈ supplier``.  No broadcast hint is given — Catalyst
broadcasts a side only when its statistics are under
``spark.sql.autoBroadcastJoinThreshold`` and AQE re-checks with runtime sizes,
which is the size check we want on a cluster where ``customer`` is large.
Only the columns used are read (``ReadSchema`` is pruned by the selects).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1995-01-01"
EVENTS_EPOCH = "2024-01-01"

# Order priority -> payment type mapping of the fixture.
PRIORITY_TO_TYPE = [
    ("1-URGENT", "TRANSFER"),
    ("2-HIGH", "CASH_OUT"),
    ("3-MEDIUM", "PAYMENT"),
    ("4-NOT SPECIFIED", "CASH_IN"),
]
OTHER_TYPE = "DEBIT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _priority_to_type(c: Column) -> Column:
    out = None
    for prio, typ in PRIORITY_TO_TYPE:
        out = (F.when(c == prio, typ) if out is None else out.when(c == prio, typ))
    return out.otherwise(OTHER_TYPE)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment table with TXN_SCHEMA columns, derived from lineitem/orders/
    customer/supplier."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_shipdate", "l_extendedprice", "l_discount")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")

    of = od.join(cu, od.o_custkey == cu.c_custkey)  # before the lines: these are dealt out once
    j = (li.join(of, li.l_orderkey == of.o_orderkey)
           .join(su, li.l_suppkey == su.s_suppkey))

    ship = F.col("l_shipdate").cast("date")
    price = F.col("l_extendedprice")
    cbal = F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 10
    sbal = F.greatest(F.col("s_acctbal"), F.lit(0.0)) * 10
    prio = F.col("o_orderpriority")
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string"),
                    F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string"),
                    F.col("l_quantity").cast("int").cast("string"),
                    ship.cast("string")).alias("txn_id"),
        F.datediff(ship, F.lit(EPOCH).cast("date")).cast("int").alias("step"),
        _priority_to_type(prio).alias("type"),
        price.alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nameOrig"),
        cbal.alias("oldbalanceOrg"),
        F.greatest(cbal - price, F.lit(0.0)).alias("newbalanceOrig"),
        F.concat(F.lit("M"), F.col("l_suppkey").cast("string")).alias("nameDest"),
        sbal.alias("oldbalanceDest"),
        (sbal + price * (1 - F.col("l_discount"))).alias("newbalanceDest"),
        F.when(prio.isin("1-URGENT", "2-HIGH") & (price >= 30000) & (price >= cbal)
               & (F.col("l_discount") >= 0.085), 1).otherwise(0).cast("int").alias("isFraud"),
        F.when((prio == "1-URGENT") & (price >= 95000), 1).otherwise(0)
         .cast("int").alias("isFlaggedFraud"),
    )


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second, timestamped source: ``events`` as an hour-tick payment stream.

    step = whole hours since 2024-01-01, sender = user, amount = value,
    type = event_type.  It has no receiver, balances or label."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    # Wall-clock arithmetic on TIMESTAMP_NTZ: independent of the session zone.
    hours = (F.datediff(F.col("ts").cast("date"), F.lit(EVENTS_EPOCH).cast("date")) * 24
             + F.hour("ts"))
    return ev.select(
        F.col("event_id").cast("string").alias("txn_id"),
        hours.cast("int").alias("step"),
        F.col("event_type").alias("type"),
        F.col("value").alias("amount"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("nameOrig"),
    )
