"""SQL oracle texts (DuckDB dialect) for the correctness gate.

Each oracle is an independent ANSI-SQL restatement of a Spark operator over
the raw driver tables; the transactions view is the CTE below (FIXTURES.md §1).
Helpers keep the float conventions identical on both sides: every computed
float is rounded to 6 dp, counts are BIGINT, flags INT.
"""

from __future__ import annotations

TXN_CTE = """transactions AS (
SELECT concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
                 CAST(l.l_quantity AS INT), CAST(l.l_shipdate AS DATE)) AS txn_id,
  CAST(date_diff('day', DATE '1995-01-01', CAST(l.l_shipdate AS DATE)) AS INT) AS step,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT'
       WHEN '3-MEDIUM' THEN 'PAYMENT' WHEN '4-NOT SPECIFIED' THEN 'CASH_IN' ELSE 'DEBIT' END AS type,
  l.l_extendedprice AS amount,
  concat('C', o.o_custkey) AS nameOrig,
  greatest(c.c_acctbal, 0.0) * 10 AS oldbalanceOrg,
  greatest(greatest(c.c_acctbal, 0.0) * 10 - l.l_extendedprice, 0.0) AS newbalanceOrig,
  concat('M', l.l_suppkey) AS nameDest,
  greatest(s.s_acctbal, 0.0) * 10 AS oldbalanceDest,
  greatest(s.s_acctbal, 0.0) * 10 + l.l_extendedprice * (1 - l.l_discount) AS newbalanceDest,
  CAST(CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') AND l.l_extendedprice >= 30000
        AND l.l_extendedprice >= greatest(c.c_acctbal, 0.0) * 10
        AND l.l_discount >= 0.085 THEN 1 ELSE 0 END AS INT) AS isFraud,
  CAST(CASE WHEN o.o_orderpriority = '1-URGENT' AND l.l_extendedprice >= 95000 THEN 1 ELSE 0 END AS INT) AS isFlaggedFraud
FROM lineitem l
JOIN orders o   ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""

EVENTS_CTE = """ev AS (
SELECT CAST(event_id AS VARCHAR) AS txn_id,
  CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS INT) AS step,
  event_type AS type, value AS amount, concat('U', user_id) AS nameOrig
FROM events
)"""


def with_txn(body: str, *extra_ctes: str) -> str:
    """Prefix ``body`` with the transactions CTE (and more CTEs)."""
    ctes = ",\n".join([TXN_CTE, *extra_ctes])
    return f"WITH {ctes}\n{body}"


def with_events(body: str, *extra_ctes: str) -> str:
    ctes = ",\n".join([EVENTS_CTE, *extra_ctes])
    return f"WITH {ctes}\n{body}"


def u(parts_sql: str) -> str:
    """DuckDB twin of ``functions.core.hash_uniform``: ``parts_sql`` is the
    '|'-joined key expression."""
    return f"(CAST(('0x' || substr(md5({parts_sql}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def u_open(parts_sql: str) -> str:
    return (f"((CAST(('0x' || substr(md5({parts_sql}), 1, 13)) AS BIGINT) + 1)"
            f" / 4503599627370497.0)")


def normal(key_sql: str) -> str:
    """Box–Muller twin of ``hash_normal``: both uniforms from one md5."""
    h = f"md5({key_sql})"
    u1 = f"((CAST(('0x' || substr({h}, 1, 13)) AS BIGINT) + 1) / 4503599627370497.0)"
    u2 = f"((CAST(('0x' || substr({h}, 14, 13)) AS BIGINT) + 1) / 4503599627370497.0)"
    return f"(sqrt(-2.0 * ln({u1})) * cos(2 * pi() * {u2}))"


def rnd(sql: str, *double_cols: str, dp: int = 6) -> str:
    """Round the named float columns of ``sql``'s result (comparison form,
    twin of ``registry.finish``)."""
    if not double_cols:
        return sql
    rep = ", ".join(f"CAST(round({c}, {dp}) AS DOUBLE) AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _q"


def rnd_sig(sql: str, *double_cols: str) -> str:
    """float32-precision twin of ``registry.finish(significant=True)``."""
    rep = ", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in double_cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) _q"


#: Test rows per class of the 80/20 split (largest remainder), for ``quota``.
SPLIT_CTES = """n AS (SELECT isFraud, count(*) AS n, count(*) // 5 AS q, count(*) % 5 AS rest FROM transactions GROUP BY isFraud),
k AS (SELECT isFraud, q + CASE WHEN row_number() OVER (ORDER BY rest DESC, isFraud)
        <= (sum(n) OVER () + 4) // 5 - sum(q) OVER () THEN 1 ELSE 0 END AS quota FROM n)"""
