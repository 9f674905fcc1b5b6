"""Whitening against numpy's own solver, and the parts of the solver."""

import math

import numpy as np
import pytest

from paysift.llm import whitening as W
from paysift.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, k=8):
    """n, deviations, eigenvalues, trace and whitened rows (sign free)."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(object) + 100_000
    n, s = len(x), x.sum(0)
    off = n * x - s
    c = off.astype(float) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, (off * off).sum(1), values, float(np.trace(c.T @ c / n)), c @ axes / np.sqrt(values)


def check(rows, vectors, k=8):
    n, deviation, values, trace, white = plain(vectors, k)
    assert len(rows) == n * len(values)
    got = np.zeros(white.shape)
    for r in rows:
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert math.isclose(r.explained, values[r.component - 1] / trace, rel_tol=1e-9)
        assert r.identity_error < 1e-8
        got[r.vec_id, r.component - 1] = r.whitened
    sign = np.sign((got * white).sum(0))
    assert np.abs(got - white * sign).max() < 1e-7


def test_against_numpy(spark):
    r = np.random.RandomState(3)
    vectors = (r.randn(400, 24) * np.linspace(2, 0.1, 24)).astype(np.float32).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(7)
    check(W.whiten(df).collect(), vectors)


def test_few_dimensions_doubles_and_carried_columns(spark):
    r = np.random.RandomState(4)
    vectors = r.randn(50, 3).astype(np.float32).tolist()
    df = spark.createDataFrame([(i, v, i, "mine") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label long, n string")
    rows = W.whiten(df, carry=["label", "n"]).collect()
    check(rows, vectors)
    assert rows[0].__fields__ == ["vec_id", "label", *W.RESULT] and all(x.label == x.vec_id for x in rows)


def test_dropped_rows(spark):
    r = np.random.RandomState(5)
    vectors = r.randn(30, 5).tolist()
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    df = spark.createDataFrame([*enumerate(vectors), *[(100 + i, v) for i, v in enumerate(bad)], (None, None)], SCHEMA)
    check(W.whiten(df).collect(), vectors)


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], SCHEMA)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], SCHEMA)
    for df in (empty, same, spark.createDataFrame([(1, [0.5, 0.25])], SCHEMA)):
        out = W.whiten(df)
        assert out.columns == ["vec_id", *W.RESULT] and out.count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(6)], SCHEMA)  # rank 1
    assert {r.component for r in W.whiten(line).collect()} == {1}


def test_repeated_rows_and_null_ids_count(spark):
    vectors = [[0.0, 1.0], [0.0, 1.0], [2.0, 0.5], [1.0, -1.0]]
    rows = W.whiten(spark.createDataFrame([(None if i < 2 else 9, v) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert len(rows) == 8 and {r.n for r in rows} == {4}
    assert sorted(r.deviation for r in rows if r.component == 1) == sorted(plain(vectors)[1])


@pytest.mark.parametrize("kind", ["random", "identity", "clusters", "nearly", "rank one"])
@pytest.mark.parametrize("n", [1, 2, 3, 30])
def test_components(kind, n):
    r = np.random.RandomState(n)
    q = np.linalg.qr(r.randn(n, n))[0]
    high = np.where(np.arange(n) < (n + 1) // 2, 5.0, 1.0)
    a = {"random": lambda: (m := r.randn(n, n)) @ m.T, "identity": lambda: np.eye(n), "clusters": lambda: (q * high) @ q.T,
         "nearly": lambda: (q * (high + 1e-10 * np.arange(n))) @ q.T, "rank one": lambda: np.ones((n, n))}[kind]()
    a = (a + a.T) / 2
    values, vectors = W.leading_components(a, 8)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:8]).max() < 1e-11 * max(1, values[0])
    assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * max(1, values[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_tridiagonal_and_counts():
    r = np.random.RandomState(8)
    a = r.randn(12, 12)
    a += a.T
    d, e, steps = W.tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    for at, v in reversed(steps):
        h = np.eye(12)
        h[at:, at:] -= 2 * np.outer(v, v)
        t = h @ t @ h
    assert np.abs(t - a).max() < 1e-12
    points = np.linspace(-8, 8, 33)
    assert W.sturm_counts(d, e * e, points, 1e-300).tolist() == [(np.linalg.eigvalsh(a) < p).sum() for p in points]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    number = {v: i for i, v in enumerate(t.vec_id)}
    rows = QUERIES["op13_whitening"](spark, sf).collect()
    from pyspark.sql import Row
    check([Row(**{**r.asDict(), "vec_id": number[r.vec_id]}) for r in rows], [list(v) for v in t.embedding])
