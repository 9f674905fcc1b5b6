"""Registered perturbation queries (L2-L6, L8-L11, L13) with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import perturb as L
from ..oracle import normal, rnd, u, with_txn
from ..registry import register
from ..sources.transactions import transactions
from .q_features import _TYPES, _feature_matrix_sql

_DZ_KEY = "concat_ws('|', txn_id, '42', 'drift_zero')"
_MISS_KEY = "concat_ws('|', txn_id, '42', 'missing', '0.1', '{c}')"
MONEY = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]


def _txn(spark, sf):
    return FE.drop_leakage(transactions(spark, sf))


def _noise_sql(level: str, a_sig: float, b_sig: float) -> str:
    cols = []
    for c, sig in [("amount", a_sig)] + [(b, b_sig) for b in MONEY[1:]]:
        z = normal(f"concat_ws('|', txn_id, '42', 'noise', '{level}', '{c}')")
        x = f"greatest({c} * (1 + {sig} * {z}), 0.0)"
        cols.append(f"CASE WHEN isnan({x}) OR isinf({x}) THEN 0.0 ELSE {x} END AS {c}")
    return rnd(with_txn("SELECT txn_id, " + ", ".join(cols) + " FROM transactions"), *MONEY)


@register("noise_inject", _noise_sql("medium", 0.10, 0.10))
def noise_inject(spark, sf):
    """L2: medium multiplicative Gaussian noise on amount and balances."""
    return L.noise_inject(_txn(spark, sf), 0.10, 0.10, "medium").select("txn_id", *MONEY)


@register("drift_scale", rnd(with_txn(
    "SELECT txn_id, CASE WHEN isFraud = 1 THEN amount * 3.0 ELSE amount END AS amount FROM transactions"),
    "amount"))
def drift_scale(spark, sf):
    """L3: fraud amounts × 3."""
    return L.drift_scale(_txn(spark, sf), 3.0).select("txn_id", "amount")


@register("drift_zero", rnd(with_txn(
    "SELECT txn_id, " + ", ".join(
        f"CASE WHEN {u(_DZ_KEY)} < 0.3 "
        f"THEN 0.0 ELSE {c} END AS {c}" for c in ["oldbalanceOrg", "newbalanceOrig"])
    + " FROM transactions"), "oldbalanceOrg", "newbalanceOrig"))
def drift_zero(spark, sf):
    """L4: zero both sender balances on a shared random 30 % of rows."""
    return L.drift_zero(_txn(spark, sf), 0.3).select("txn_id", "oldbalanceOrg", "newbalanceOrig")


@register("drift_force_type", with_txn(
    "SELECT txn_id, 0 AS type_CASH_IN, 0 AS type_CASH_OUT, 0 AS type_DEBIT, 0 AS type_PAYMENT, "
    "1 AS type_TRANSFER, 1 AS is_high_risk_type, isFraud FROM transactions"))
def drift_force_type(spark, sf):
    """Every row forced to TRANSFER / high risk."""
    d = FE.create_type_features(_txn(spark, sf))
    return L.drift_force_type(d).select("txn_id", "type_CASH_IN", "type_CASH_OUT", "type_DEBIT",
                                        "type_PAYMENT", "type_TRANSFER", "is_high_risk_type", "isFraud")


@register("mask_missing", rnd(with_txn(
    "SELECT txn_id, " + ", ".join(
        f"CASE WHEN {u(_MISS_KEY.format(c=c))} "
        f"< 0.1 THEN 0.0 ELSE coalesce({c}, 0.0) END AS {c}" for c in MONEY)
    + " FROM transactions"), *MONEY))
def mask_missing(spark, sf):
    """10 % of cells missing independently, then zero-filled."""
    return L.mask_missing(_txn(spark, sf), 0.1, MONEY).select("txn_id", *MONEY)


@register("swap_columns", rnd(with_txn(
    "SELECT txn_id, oldbalanceDest AS oldbalanceOrg, newbalanceDest AS newbalanceOrig, "
    "oldbalanceOrg AS oldbalanceDest, newbalanceOrig AS newbalanceDest FROM transactions"), *MONEY[1:]))
def swap_columns(spark, sf):
    """sender/receiver balances swapped."""
    return L.swap_columns(_txn(spark, sf)).select("txn_id", *MONEY[1:])


@register("zero_columns", with_txn(
    "SELECT txn_id, 0.0 AS oldbalanceOrg, 0.0 AS newbalanceOrig, 0.0 AS oldbalanceDest, "
    "0.0 AS newbalanceDest, amount FROM transactions"))
def zero_columns(spark, sf):
    """Every balance zeroed."""
    return L.zero_columns(_txn(spark, sf)).select("txn_id", *MONEY[1:], "amount")


def _rank(salt: str, src_cols="txn_id") -> str:
    return f"row_number() OVER (ORDER BY md5(concat_ws('|', txn_id, '42', '{salt}')), txn_id) - 1"


@register("shuffle_subset", rnd(with_txn("""
SELECT r.txn_id,
  CASE WHEN r._in THEN a.amount ELSE r.amount END AS amount,
  CASE WHEN r._in THEN o.oldbalanceOrg ELSE r.oldbalanceOrg END AS oldbalanceOrg
FROM r
LEFT JOIN (SELECT """ + _rank("perm|amount") + """ AS _pos, amount FROM r WHERE _in) a ON r._pos = a._pos
LEFT JOIN (SELECT """ + _rank("perm|oldbalanceOrg") + """ AS _pos, oldbalanceOrg FROM r WHERE _in) o
  ON r._pos = o._pos""",
    "r0 AS (SELECT txn_id, amount, oldbalanceOrg, " + _rank("subset") + " AS _pos, "
    "count(*) OVER () AS _n FROM transactions)",
    "r AS (SELECT *, _pos < floor(_n * 1 / 10) AS _in FROM r0)"), "amount", "oldbalanceOrg"))
def shuffle_subset(spark, sf):
    """Values of amount and oldbalanceOrg permuted within one 10 %
    subset, independently per column."""
    return L.shuffle_subset(_txn(spark, sf), 0.10).select("txn_id", "amount", "oldbalanceOrg")


_ADV_COLS = ["txn_id", "isFraud", "amount", "balance_diff_orig", "balance_diff_dest",
             "is_zero_balance", "high_amount_flag", "high_amount_and_zero_balance", "error_orig",
             "error_dest", "abs_error_orig", "abs_error_dest", "log_abs_error_orig",
             "log_abs_error_dest", "is_adversarial"]


def _adv_sql() -> str:
    fm = _feature_matrix_sql()
    inner = fm[fm.index("FROM (\n") + 7: fm.rindex("\n) _q")]
    ua = u("concat_ws('|', txn_id, '42', 'adv_amount')")
    ub1 = u("concat_ws('|', txn_id, '42', 'adv', 'balance_diff_orig')")
    ub2 = u("concat_ws('|', txn_id, '42', 'adv', 'balance_diff_dest')")
    amt = f"(100.0 + {ua} * (p._p25 - 100.0))"
    return rnd(f"""WITH fm AS ({inner}),
legit AS (SELECT * FROM fm WHERE isFraud = 0),
p AS (SELECT quantile_cont(amount, 0.25) AS _p25 FROM legit),
pick AS (SELECT * FROM (SELECT *, {_rank('adversarial')} AS _rank FROM legit) WHERE _rank < 1000)
SELECT txn_id, 1 AS isFraud, {amt} AS amount,
  {amt} * (0.95 + 0.10 * {ub1}) AS balance_diff_orig,
  {amt} * (0.95 + 0.10 * {ub2}) AS balance_diff_dest,
  0 AS is_zero_balance, 0 AS high_amount_flag, 0 AS high_amount_and_zero_balance,
  0.0 AS error_orig, 0.0 AS error_dest, 0.0 AS abs_error_orig, 0.0 AS abs_error_dest,
  0.0 AS log_abs_error_orig, 0.0 AS log_abs_error_dest, 1 AS is_adversarial
FROM pick CROSS JOIN p""", "amount", "balance_diff_orig", "balance_diff_dest", "error_orig",
               "error_dest", "abs_error_orig", "abs_error_dest", "log_abs_error_orig",
               "log_abs_error_dest")


@register("adversarial_rows", _adv_sql())
def adversarial_rows(spark, sf):
    """1,000 stealth-fraud rows synthesised from legit feature rows."""
    from . import q_models  # its table is shared: the payments are joined once
    return L.adversarial_rows(q_models.feature_table(spark, sf), 1000).select(*_ADV_COLS)
