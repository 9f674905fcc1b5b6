"""Hash draws: the values that plain Python gives, read without big-number arithmetic."""

import hashlib
import math

from pyspark.sql import functions as F

from paysift.functions.core import hash_normal, hash_uniform, hash_uniform_open


def test_draws_equal_plain_python_and_go_through_a_long(spark):
    keys = [*(f"{i}-{i % 7}-1995" for i in range(500)), "", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    out = df.select("k", hash_uniform(F.col("k"), 42, "u").alias("u"), hash_uniform_open(F.col("k"), 42, "o").alias("o"), hash_normal(F.col("k"), 42, "n").alias("n"))
    rows = out.collect()
    assert len(rows) == len(keys)
    for r in rows:
        bits = lambda salt, at: int(hashlib.md5("|".join([*([] if r["k"] is None else [r["k"]]), "42", salt]).encode()).hexdigest()[at:at + 13], 16)  # noqa: B023, E731
        assert r["u"] == bits("u", 0) / 2 ** 52 and r["o"] == (bits("o", 0) + 1) / (2 ** 52 + 1)
        u1, u2 = (bits("n", 0) + 1) / (2 ** 52 + 1), (bits("n", 13) + 1) / (2 ** 52 + 1)
        assert math.isclose(r["n"], math.sqrt(-2 * math.log(u1)) * math.cos(2 * math.pi * u2), rel_tol=1e-9, abs_tol=1e-12)
    plan = df.select(hash_uniform(F.col("k"), 1).alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("as bigint") == 1  # before, the digits were cast to double
