"""Column-level helpers.  All are built-in Spark expressions (JVM side, inside
whole-stage codegen) — no Python UDF anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO52 = float(2 ** 52)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den, default: float | None = 0.0) -> Column:
    """``num / den`` that yields ``default`` (or NULL) instead of raising when
    the divisor is 0 or NULL (ANSI mode raises on ``/ 0``)."""
    q = F.try_divide(col(num), col(den))
    return q if default is None else F.coalesce(q, F.lit(default))


def as_flag(cond: Column) -> Column:
    """Boolean → 0/1 INT flag (NULL stays NULL)."""
    return cond.cast("int")


def clip_lower(c, lo: float) -> Column:
    """pandas ``clip(lower=lo)``: NULL stays NULL, NaN stays NaN."""
    c = col(c)
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.greatest(c, F.lit(lo)))


def clip(c, lo: Column | float, hi: Column | float) -> Column:
    c = col(c)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.least(F.greatest(c, lo), hi))


def is_inf(c) -> Column:
    return F.abs(col(c)) == F.lit(float("inf"))


def hash_key(*parts) -> Column:
    """md5 hex of ``p1|p2|...`` — deterministic across engines, partitionings
    and task retries (unlike ``rand()``), so a recomputed task after an
    executor loss draws the same values.  Constant parts next to each other are
    joined beforehand."""
    cols: list[Column | str] = []
    for p in parts:
        if isinstance(p, Column):
            cols.append(p)
        elif cols and isinstance(cols[-1], str):
            cols[-1] += f"|{p}"
        else:
            cols.append(str(p))
    return F.md5(F.concat_ws("|", *[c if isinstance(c, Column) else F.lit(c) for c in cols]))


def _bits(h: Column, at: int) -> Column:
    """13 hex digits from ``at`` on as a number.  It goes through a long: the JVM reads
    doubles of more than 15 digits by big-number arithmetic."""
    return F.conv(F.substring(h, at, 13), 16, 10).cast("long").cast("double")


def hash_uniform(*parts) -> Column:
    """U[0,1) from the first 52 bits of ``md5(p1|p2|...)``."""
    h = hash_key(*parts)
    return _bits(h, 1) / F.lit(TWO52)


def hash_below(share: float, *parts) -> Column:
    """``hash_uniform(*parts) < share``, without reading the number: of 52 bits, those
    below have a hex form before that of the least number that isn't."""
    bound = math.ceil(share * TWO52)
    if not 0 < bound < 2 ** 52:
        return F.lit(bound > 0)
    return hash_key(*parts) < F.lit(f"{bound:013x}")


def hash_uniform_open(*parts) -> Column:
    """U(0,1) (never 0) for logarithms: (k+1)/(2^52+1)."""
    h = hash_key(*parts)
    return (_bits(h, 1) + 1) / F.lit(TWO52 + 1)


def hash_normal(*parts) -> Column:
    """Standard normal by Box–Muller from the two disjoint 52-bit halves of
    ONE md5 (hex digits 1-13 and 14-26), each mapped to (0, 1)."""
    return normal_of(hash_key(*parts))


def normal_of(h: Column) -> Column:
    """The normal of ``hash_normal`` from its md5.  In a branch of a condition Spark
    computes each mention of ``h`` anew: there it should be a column."""
    k1 = _bits(h, 1)
    k2 = _bits(h, 14)
    u1 = (k1 + 1) / F.lit(TWO52 + 1)
    u2 = (k2 + 1) / F.lit(TWO52 + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def guarded_corr(x, y) -> Column:
    """Pearson r that is NULL (not an ANSI divide-by-zero error) when either
    side has zero variance."""
    x, y = col(x), col(y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def r6(c) -> Column:
    """Round a floating result to 6 dp for engine-independent comparison."""
    return F.round(col(c), 6)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Select by type — numeric columns of a DataFrame."""
    from pyspark.sql.types import NumericType
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def existing(df: DataFrame, cols) -> list[str]:
    """Keep-columns-that-exist guard."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (``<=>``), keeping one
    copy of each key column — group keys may legitimately be NULL."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])
