"""Table perturbations for robustness evaluation.

Every random draw is a hash of ``(txn_id, seed, purpose, column)`` — the same
value on every run, partitioning and task retry, and reproducible in SQL.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import hash_below, hash_normal, hash_uniform
from ..functions.quantile import quantile_row
from ..plans.prefix import below_quota, hash_rank
from ..sources.schema import BALANCE_COLS, TARGET

SEED = 42

# Noise levels (amount sigma, balance sigma).
NOISE_LEVELS = {
    "none": (0.0, 0.0),
    "low": (0.05, 0.05),
    "medium": (0.10, 0.10),
    "high": (0.20, 0.15),
    "extreme": (0.30, 0.25),
}
# Columns an adversarial row has at 0.
ADV_ZERO_COLS = ["error_orig", "error_dest", "abs_error_orig", "abs_error_dest",
                 "log_abs_error_orig", "log_abs_error_dest"]


def _finite_or_zero(c):
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)


def noise_inject(df: DataFrame, amount_sigma: float, balance_sigma: float, level: str = "",
                 key: str = "txn_id", seed: int = SEED) -> DataFrame:
    """L2: multiplicative Gaussian noise c·(1 + σ·z), clipped at 0, then
    ±inf/NaN → 0.  One independent z per (row, column, level)."""
    cols = {}
    for c, sig in [("amount", amount_sigma)] + [(b, balance_sigma) for b in BALANCE_COLS]:
        if sig > 0 and c in df.columns:
            z = hash_normal(F.col(key), seed, "noise", level, c)
            cols[c] = _finite_or_zero(F.greatest(F.col(c) * (1 + F.lit(sig) * z), F.lit(0.0)))
    return df.withColumns(cols) if cols else df


def noise_inject_by_level(df: DataFrame, level_col: str, amount_sigma_col: str,
                          balance_sigma_col: str, key: str = "txn_id", seed: int = SEED) -> DataFrame:
    """L2 for many levels at once: the level name and the two sigmas are
    columns (rows exploded by level), so every level is one pass."""
    for c, sig in [("amount", amount_sigma_col)] + [(b, balance_sigma_col) for b in BALANCE_COLS]:
        if c in df.columns:  # z, then the noisy value, then its repair: each computed once
            df = df.withColumn("_z", hash_normal(F.col(key), seed, "noise", F.col(level_col), c))
            df = df.withColumn("_z", F.greatest(F.col(c) * (1 + F.col(sig) * F.col("_z")), F.lit(0.0)))
            df = df.withColumn(c, F.when(F.col(sig) > 0, _finite_or_zero(F.col("_z"))).otherwise(F.col(c))).drop("_z")
    return df


def drift_scale(df: DataFrame, factor: float = 3.0, col: str = "amount",
                label: str = TARGET) -> DataFrame:
    """Label-conditional scaling (fraud amounts × factor)."""
    return df.withColumn(col, F.when(F.col(label) == 1, F.col(col) * factor).otherwise(F.col(col)))


def drift_zero(df: DataFrame, frac: float = 0.3, cols=("oldbalanceOrg", "newbalanceOrig"),
               key: str = "txn_id", seed: int = SEED) -> DataFrame:
    """L4: zero the given columns on a random ``frac`` of rows (one mask
    shared by all columns)."""
    m = hash_below(frac, F.col(key), seed, "drift_zero")
    return df.withColumns({c: F.when(m, F.lit(0.0)).otherwise(F.col(c)) for c in cols if c in df.columns})


def drift_force_type(df: DataFrame, target_type: str = "TRANSFER") -> DataFrame:
    """Every row becomes ``target_type`` (one-hot flags) and high-risk."""
    flags = {c: F.lit(1 if c == f"type_{target_type}" else 0) for c in df.columns
             if c.startswith("type_")}
    if "is_high_risk_type" in df.columns:
        flags["is_high_risk_type"] = F.lit(1)
    return df.withColumns(flags)


def adversarial_rows(features: DataFrame, n: int = 1000, label: str = TARGET,
                     key: str = "txn_id", seed: int = SEED) -> DataFrame:
    """Stealth fraud — n legit rows relabelled 1, amount ~ U(100, p25 of
    legit amounts), balance diffs = amount·U(.95, 1.05), zero-balance /
    high-amount flags and balance-error columns set to 0.  Rows carry
    ``is_adversarial = 1`` (the reference found them by index and also caught
    original rows)."""
    legit = features.where(F.col(label) == 0)
    p25 = quantile_row(legit, "amount", {"_p25": 0.25})
    quota = legit.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("_quota"))
    base = below_quota(legit, quota, [], key, seed, "adversarial").where("_in").drop("_in").crossJoin(F.broadcast(p25))
    amt = F.lit(100.0) + hash_uniform(F.col(key), seed, "adv_amount") * (F.col("_p25") - 100.0)
    out = base.withColumn("amount", amt)
    upd = {label: F.lit(1).cast(features.schema[label].dataType)}
    for c in ("balance_diff_orig", "balance_diff_dest"):
        if c in out.columns:
            upd[c] = F.col("amount") * (0.95 + 0.10 * hash_uniform(F.col(key), seed, "adv", c))
    for c in ("is_zero_balance", "high_amount_flag", "high_amount_and_zero_balance"):
        if c in out.columns:
            upd[c] = F.lit(0).cast(features.schema[c].dataType)
    for c in ADV_ZERO_COLS:
        if c in out.columns:
            upd[c] = F.lit(0.0)
    return out.withColumns(upd).drop("_p25").withColumn("is_adversarial", F.lit(1))


def mask_missing(df: DataFrame, rate: float, cols: list[str], key: str = "txn_id",
                 seed: int = SEED, fill: float = 0.0) -> DataFrame:
    """Each cell independently missing with probability ``rate``, then
    zero-filled (the reference's imputation)."""
    if rate <= 0:
        return df
    upd = {}
    for c in cols:
        m = hash_below(rate, F.col(key), seed, "missing", str(rate), c)
        upd[c] = F.coalesce(F.when(~m, F.col(c)), F.lit(fill).cast(df.schema[c].dataType))
    return df.withColumns(upd)


def swap_columns(df: DataFrame, pairs=(("oldbalanceOrg", "oldbalanceDest"),
                                       ("newbalanceOrig", "newbalanceDest"))) -> DataFrame:
    """Swap sender/receiver balance columns."""
    upd = {}
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            upd[a], upd[b] = F.col(b), F.col(a)
    return df.withColumns(upd)


def zero_columns(df: DataFrame, cols=tuple(BALANCE_COLS)) -> DataFrame:
    """Set columns to 0."""
    return df.withColumns({c: F.lit(0).cast(df.schema[c].dataType) for c in cols if c in df.columns})


def shuffle_subset(df: DataFrame, frac: float = 0.10, cols=("amount", "oldbalanceOrg"),
                   key: str = "txn_id", seed: int = SEED) -> DataFrame:
    """Permute the values of each column among one random subset of
    floor(frac·n) rows, independently per column.

    Only the subset is ranked and joined; all other rows pass through.
    Subset position = exact hash rank; for column c the value placed at
    position i comes from the subset row whose c-specific hash rank is i.
    Both ranks come from the two-level prefix (no single-partition window),
    and the value move is an equi-join on the rank, which is uniformly
    spread.  The multiset of each column is unchanged."""
    r, moved = shuffled_values(df, frac, cols, key, seed)
    changed = r.where("_in").join(moved, key).withColumns({c: F.col(f"_new_{c}") for c in cols}).select(*df.columns)
    return r.where("not _in").select(*df.columns).union(changed)


def shuffled_values(df: DataFrame, frac: float, cols, key: str = "txn_id", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_in`` (is the row in the subset), and (key, ``_new_<c>``...)
    of the subset's rows: the value that each column gets."""
    r = in_subset(df, df, frac, key, seed)
    moved = hash_rank(r.where("_in").select(key, *cols), [], key, seed, "subset", rank_col="_pos")
    for c in cols:
        src = hash_rank(moved.select(F.col(key).alias("_key"), F.col(c).alias(f"_new_{c}")), [], "_key", seed, f"perm|{c}", rank_col="_pos")
        moved = moved.join(src.drop("_key"), "_pos")
    return r, moved.select(F.col(key), *[F.col(f"_new_{c}") for c in cols])


def in_subset(df: DataFrame, of: DataFrame, frac: float, key: str = "txn_id", seed: int = SEED) -> DataFrame:
    """``df`` with ``_in``: the floor(frac·n) rows of ``of`` that are shuffled."""
    q = Fraction(str(frac)).limit_denominator(10 ** 9)
    n = of.agg(F.expr(f"count(1) * {q.numerator} div {q.denominator}").alias("_quota"))
    return below_quota(df, n, [], key, seed, "subset", of)
