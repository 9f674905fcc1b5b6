"""Driver contract: entry() runs; registered queries agree with their SQL
oracles on the smallest fixture (the driver checks sf0.01)."""

import math

import duckdb
import pytest

SF_SMALL = "/root/testdata/sf0.001"

ORACLE_SAMPLE = ["type_fraud_rate", "class_balance", "numeric_describe", "feature_matrix",
                 "stratified_sample", "roc_auc", "threshold_sweep", "noise_inject",
                 "shuffle_subset", "histogram_amount"]


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert len(df.columns) == 43 and df.count() > 0


def test_registries_aligned():
    from __spark_entry__ import oracle_sql, queries
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for r in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r))
    return cols, sorted(out, key=repr)


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle(spark, name):
    from __spark_entry__ import oracle_sql, queries
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    s = queries()[name](spark, SF_SMALL).toPandas()
    o = con.execute(oracle_sql()[name]).df()
    assert _rows(s) == _rows(o)
