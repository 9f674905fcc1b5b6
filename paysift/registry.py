"""Registered queries: name → (Spark callable, DuckDB oracle SQL or None).

Every callable takes ``(spark, sf_dir)`` and reads the driver's tables whole.
Float outputs are rounded to 6 dp on both sides (``finish`` /
``oracle.rnd``) so the value hash does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def finish(df: DataFrame, dp: int = 6, significant: bool = False) -> DataFrame:
    """Round every floating column to ``dp`` decimals (comparison form), or
    — for aggregates of large magnitudes — to float32 precision (~7
    significant digits, IEEE round-to-nearest in both engines)."""
    def r(c):
        return F.col(c).cast("float").cast("double") if significant else F.round(F.col(c), dp).cast("double")
    return df.select(*[r(f.name).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def _tuned(spark: SparkSession) -> SparkSession:
    """The JVM doesn't compile methods of more than 8,000 bytes; projections of 41
    features are longer as one method, and run faster split up."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def register(name: str, oracle: str | None = None, rounded: bool = True,
             significant: bool = False):
    def deco(fn):
        if rounded:
            QUERIES[name] = lambda spark, sf, _fn=fn: finish(_fn(_tuned(spark), sf), significant=significant)
        else:
            QUERIES[name] = lambda spark, sf, _fn=fn: _fn(_tuned(spark), sf)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# Import the modules that call ``register`` (order = listing order).
from .plans import q_profile  # noqa: E402,F401
from .plans import q_features  # noqa: E402,F401
from .plans import q_sampling  # noqa: E402,F401
from .plans import q_metrics  # noqa: E402,F401
from .plans import q_perturb  # noqa: E402,F401
from .plans import q_models  # noqa: E402,F401
