"""PCA whitening of embeddings (operator 13).

1. Entries become integers, x = floor(scale c) + shift.  One pass sums them
   exactly: n and, per dimension, S.
2. A second pass adds up the covariance: each task centres its rows (n x - S is
   an exact integer, divided by n) and multiplies, so that it sends one D x D
   matrix, summed by Spark per row of the matrix.
3. The matrix, whose size depends on the dimension alone, is solved on the
   driver: Householder reflections make it tridiagonal, Sturm counts and
   bisection find the leading eigenvalues (a batch of points at a time), inverse
   iteration their vectors, made orthogonal again within clusters of close
   eigenvalues, and the reflections carry them back.
4. The D x k projection is broadcast; the whitened rows are written once.  Their
   own mean and then their centred covariance are two more passes (k and k x k
   sums), for the identity error.

Rows whose vector is null, empty, or holds nulls, NaN or infinities are
dropped, as are those that have another dimension than most (of equally
frequent ones the larger).  Repeated rows count each.  No rows: an empty result.
Components whose eigenvalue is 0 (to rounding) can't be whitened and are left
out, so a constant table has none and the result is empty.  ``deviation`` is
null where it exceeds a long; entries so large that n x would do raise an error.
Carried columns that have the name of a result are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_of, prepare, save

RESULT = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
#: Rows centred and multiplied at a time.
BLOCK = 4096
_EPS = np.finfo(float).eps


# ------------------------------------------------------- symmetric eigenproblem

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """(diagonal, off-diagonal, reflections) by Householder: reflection k is
    (first row, v) of I - 2 v v'."""
    a = np.array(a, float)
    n, steps = len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            continue
        edge = -np.copysign(size, x[0])
        x[0] -= edge
        v = x / np.linalg.norm(x)
        part = a[k + 1:, k + 1:]
        p = part @ v
        w = p - (v @ p) * v
        part -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = edge
        steps.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), steps


def sturm_counts(d: np.ndarray, e2: np.ndarray, points: np.ndarray, tiny: float) -> np.ndarray:
    """Eigenvalues below each point: negative terms of the Sturm sequence."""
    q = d[0] - points
    count = (q < 0).astype(int)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - points - e2[i - 1] / q
        count += q < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, all bisected at once."""
    n = len(d)
    around = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    low, high = float((d - around).min()), float((d + around).max())
    tiny = max(_EPS * max(abs(low), abs(high)), np.finfo(float).tiny) * _EPS
    wanted = n - 1 - np.arange(k)  # so many eigenvalues are smaller
    a, b = np.full(k, low - abs(low) * _EPS - tiny), np.full(k, high + abs(high) * _EPS + tiny)
    while True:
        middle = a + (b - a) / 2
        if not np.any((middle > a) & (middle < b)):
            return middle
        below = sturm_counts(d, e * e, middle, tiny) > wanted
        b, a = np.where(below, middle, b), np.where(below, a, middle)


def _solve(d, e, shift, x, tiny):
    """(T - shift) y = x by elimination with row exchanges; ~0 pivots are tiny."""
    n = len(d)
    diag, up, upup, x = d - shift, np.append(e, 0.0), np.zeros(n), x.copy()
    for i in range(n - 1):
        below = e[i]
        if abs(below) > abs(diag[i]):  # exchange rows i and i + 1
            diag[i], up[i], upup[i], rest, after = below, diag[i + 1], up[i + 1], diag[i], up[i]
            x[i], x[i + 1] = x[i + 1], x[i]
            f = rest / diag[i]
            diag[i + 1], up[i + 1] = after - f * up[i], -f * upup[i]
        else:
            if abs(diag[i]) < tiny:
                diag[i] = tiny
            f = below / diag[i]
            diag[i + 1] -= f * up[i]
        x[i + 1] -= f * x[i]
    for i in range(n - 1, -1, -1):
        if abs(diag[i]) < tiny:
            diag[i] = tiny
        x[i] -= (up[i] * x[i + 1] if i + 1 < n else 0) + (upup[i] * x[i + 2] if i + 2 < n else 0)
        x[i] /= diag[i]
    return x


def tridiagonal_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; vectors of a cluster
    of close eigenvalues are kept orthogonal to each other."""
    n = len(d)
    norm = float((np.abs(d) + np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))).max())
    tiny = max(norm * _EPS, np.finfo(float).tiny)
    out = np.zeros((n, len(values)))
    start = np.random.RandomState(1)
    cluster, before = 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = k
        shift = value if before is None or k == cluster else min(value, before - 4 * tiny)
        before = shift
        x = start.uniform(-1, 1, n)
        for _ in range(6):
            x = _solve(d, e, shift, x / np.abs(x).max(), tiny)
            for _ in range(3):
                x /= np.linalg.norm(x)
                near = out[:, cluster:k]
                x -= near @ (near.T @ x)
            x /= np.linalg.norm(x)
        x -= out[:, :k] @ (out[:, :k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix."""
    d, e, steps = tridiagonal(a)
    values = leading_eigenvalues(d, e, min(k, len(d)))
    vectors = tridiagonal_vectors(d, e, values)
    for at, v in reversed(steps):
        vectors[at:] -= 2 * np.outer(v, v @ vectors[at:])
    return values, vectors / np.linalg.norm(vectors, axis=0)


# --------------------------------------------------------------- passes on Spark

def _entries(column, dim: int, scale: int, shift: int) -> np.ndarray:
    """x of each row of a list column without nulls (rows x dim longs)."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    return np.floor(scale * c).astype(np.int64) + shift


def _add_up(df: DataFrame, width: int, part) -> np.ndarray:
    """Sum over tasks of ``part(batch) -> rows x width doubles``; a task sends one
    such matrix, Spark adds them row by row, and the driver gets the sum."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                p = part(batch)
                total = p if total is None else total + p
        total = np.zeros((0, width)) if total is None else total
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(width)]], names)

    names = ["i", *[f"v{j}" for j in range(width)]]
    sums = (df.mapInArrow(run, "i int, " + ", ".join(f"{v} double" for v in names[1:]))
            .groupBy("i").agg(*[F.sum(v).alias(v) for v in names[1:]]).toArrow().sort_by("i"))
    return np.column_stack([sums.column(j + 1).to_numpy() for j in range(width)]) if sums.num_rows else np.zeros((0, width))


def usable(vectors: DataFrame, col: str) -> tuple[DataFrame, int]:
    """Rows with a finite vector of the usual dimension, and that dimension."""
    v = F.col(f"`{col}`")
    finite = vectors.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sizes = finite.groupBy(F.size(v).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return (finite, 0) if sizes is None else (finite.where(F.size(v) == sizes["dim"]), sizes["dim"])


def sums(rows: DataFrame, col: str, dim: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """(n, exact sum of x per dimension); no row of a task is sent."""
    def run(batches):
        n, total, largest = 0, np.zeros(dim, np.int64), 0
        for batch in batches:
            x = _entries(batch.column(0), dim, scale, shift)
            if len(x):
                largest = max(largest, int(np.abs(x).max()))
                if largest > 1 << 52:
                    raise OverflowError("embedding entries over 2^52 after scaling")
                n, total = n + len(x), total + x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array([n] * dim), pa.array(total), pa.array([largest] * dim)], ["i", "n", "s", "m"])

    found = (rows.select(F.col(f"`{col}`")).mapInArrow(run, "i int, n long, s long, m long")
             .groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("m").alias("m")).orderBy("i").collect())  # a row per dimension
    n, largest = found[0]["n"], max(r["m"] for r in found)
    if n * largest > 1 << 61:
        raise OverflowError("n times the largest entry exceeds a long")
    return n, [r["s"] for r in found]


def covariance(rows: DataFrame, col: str, dim: int, n: int, total: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """Covariance of x, divisor n, centred before multiplying."""
    def part(batch):
        out = np.zeros((dim, dim))
        for a in range(0, batch.num_rows, BLOCK):
            x = (n * _entries(batch.column(0).slice(a, BLOCK), dim, scale, shift) - total) / n
            out += x.T @ x
        return out

    v = _add_up(rows.select(F.col(f"`{col}`")), dim, part) / n
    return (v + v.T) / 2


def whiten(vectors: DataFrame, k: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding",
           carry=()) -> DataFrame:
    """(id, the ``carry`` columns, component, n, deviation, whitened, explained,
    identity_error): a row per usable vector and component, up to k."""
    spark = prepare(vectors.sparkSession)
    carry = [c for c in carry if c not in (*RESULT, id_col)]
    rows, dim = usable(vectors, vector_col)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = (f"`{id_col}` {kinds[id_col]}, " + "".join(f"`{c}` {kinds[c]}, " for c in carry)
              + "component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not dim:
        return spark.createDataFrame([], schema)
    n, s = sums(rows, vector_col, dim, scale, shift)
    total = np.array(s, np.int64)
    v = covariance(rows, vector_col, dim, n, total, scale, shift)
    trace = float(np.trace(v))
    if trace <= 0:
        return spark.createDataFrame([], schema)
    values, axes = leading_components(v, k)
    good = values > 16 * dim * _EPS * trace
    values, axes = values[good], axes[:, good]
    if not len(values):
        return spark.createDataFrame([], schema)
    known = spark.sparkContext.broadcast(axes / np.sqrt(values))  # dim x k

    def project(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                b = batch.slice(a, BLOCK)
                off = n * _entries(b.column(2), dim, scale, shift) - total
                fits = (off.astype(float) ** 2).sum(1) < 9.2e18
                deviation = (np.where(fits[:, None], off, 0) ** 2).sum(1)
                w = (off / n) @ known.value
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(deviation, mask=~fits), list_of(w.reshape(-1), np.full(len(w), w.shape[1]))],
                                                 ["id", "c", "deviation", "w"])

    others = [F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")]
    base = rows.select(F.col(f"`{id_col}`").alias("id"), F.struct(*others).alias("c"), F.col(f"`{vector_col}`"))
    white = save(base.mapInArrow(project, f"id {kinds[id_col]}, c {base.schema['c'].dataType.simpleString()}, deviation long, w array<double>"), "whitened")
    width = len(values)
    matrix = lambda batch: batch.column(0).flatten().to_numpy().reshape(-1, width)
    mean = _add_up(white.select("w"), width, lambda b: matrix(b).sum(0)[None, :])[0] / n

    def centred(batch):
        w = matrix(batch) - mean
        return w.T @ w

    error = float(np.abs(_add_up(white.select("w"), width, centred) / n - np.eye(width)).max())
    explained = F.array(*[F.lit(float(x / trace)) for x in values])
    return (white.select(F.col("id").alias(id_col), *[F.col("c").getField(c).alias(c) for c in carry], "deviation", F.posexplode("w").alias("at", "whitened"))
            .select(id_col, *carry, (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")))
