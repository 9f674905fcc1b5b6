"""Row-wise feature groups on a Structured Streaming DataFrame.

The reference has no streaming code.  What carries over unchanged is the
row-wise part of the feature pipeline (F1-F4, F9) and the interaction flags
(F8) once the p95 threshold is a constant taken from a batch table; group
features (F5-F7) need whole-history aggregates and stay batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import features as FE
from ..sources.schema import TXN_SCHEMA


def stream_row_features(stream: DataFrame, p95: float | None = None) -> DataFrame:
    """F1-F4 + F9 (and F8 with a constant ``p95``) on a streaming source."""
    out = FE._row_features(stream)
    if p95 is not None:
        out = FE.create_interaction_features(out, float(p95))
    return out


def run_parquet_stream(spark: SparkSession, src: str, sink: str, checkpoint: str,
                       p95: float | None = None, schema=TXN_SCHEMA):
    """Process every file present in ``src`` (parquet, declared schema) into
    the parquet folder ``sink`` with the exactly-once file sink, then stop
    (``availableNow`` trigger).  ``checkpoint`` must be a shared folder."""
    stream = spark.readStream.schema(schema).parquet(src)
    q = (stream_row_features(stream, p95).writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q
