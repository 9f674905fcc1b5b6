"""File sources and sinks.

Sources declare their schema (no inference pass over the data).  Sinks write
through Spark's own committers, so a lost executor's partial output is never
published.  Scratch output goes under the session's shared
``spark.checkpoint.dir`` (``session.checkpoint_dir``), never a machine-local
folder on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir
from .schema import TXN_SCHEMA

DEFAULT_THRESHOLD = 0.10
CORRUPT = "_corrupt_record"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared checkpoint directory that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back: one computation (a reliable ``checkpoint()`` of an
    unpersisted plan computes it twice), fault tolerant, lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)  # read by this job alone, so the smaller form
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_transactions_csv(spark: SparkSession, path: str, schema: T.StructType = TXN_SCHEMA,
                          mode: str = "PERMISSIVE") -> DataFrame:
    """A1: CSV with a header and a declared schema.  ``mode`` is Spark's
    malformed-row policy (PERMISSIVE / DROPMALFORMED / FAILFAST); in PERMISSIVE
    mode ``_corrupt_record`` holds the text of a line that doesn't fit."""
    read = spark.read.option("header", True).option("mode", mode)
    if mode.upper() != "PERMISSIVE":
        return read.schema(schema).csv(path)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return read.schema(wide).option("columnNameOfCorruptRecord", CORRUPT).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A2: parquet scan (column pruning and filter pushdown by Catalyst)."""
    return spark.read.parquet(path)


def save_dataset(df: DataFrame, path: str, partition_by: list[str] | None = None, narrow: bool = False) -> None:
    """A3: parquet, snappy, overwrite, no index column.  ``narrow`` (B1): numeric
    columns are written in the smallest type that holds all their values
    (one more pass over ``df`` finds it)."""
    if narrow:
        from ..operators.features import apply_narrow_types, chosen_types
        df = apply_narrow_types(df, chosen_types(df))
    w = df.write.option("compression", "snappy").mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_table_csv(df: DataFrame, path: str) -> None:
    """A4: CSV with header for SMALL result tables (one file)."""
    df.repartition(1).write.option("header", True).mode("overwrite").csv(path)


def save_json(df: DataFrame, path: str) -> None:
    """A5: JSON lines of a small result table (parameters, thresholds,
    confusion counts)."""
    df.repartition(1).write.mode("overwrite").json(path)


def read_threshold(spark: SparkSession, path: str, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One-row table ``optimal_threshold`` read from JSON; a missing key
    (or file content without it) falls back to ``default``."""
    schema = T.StructType([T.StructField("optimal_threshold", T.DoubleType())])
    df = spark.read.schema(schema).option("multiLine", False).json(path)
    return df.agg(F.coalesce(F.max("optimal_threshold"), F.lit(default)).alias("optimal_threshold"))


def save_model(model, path: str) -> None:
    """Spark ML persistence (PipelineModel / any MLWritable)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
