"""Embedding whitening: distributed covariance, float32 eigenvectors refined in higher precision."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.functions.storage import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Precision of the refinement; eigenvectors come out exact to double precision.
HIGH = np.longdouble
# An entry of this size or more has no whole number that the sums below hold.
TOO_LARGE = float(1 << 62)
ROWS = 4096


def _norm(a: np.ndarray) -> float:
    return float(np.sqrt((a * a).sum()))


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One step of Ogita and Aishima: better vectors, values, the pairs that are too close to part, the size of the correction."""
    r = np.eye(len(a), dtype=HIGH) - x.T @ x
    s = x.T @ (a @ x)
    # Rounding must not part the two halves, or small gaps turn it into vectors that are not orthogonal.
    s, r = (s + s.T) / 2, (r + r.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= 2 * (_norm(off) + _norm(a) * _norm(r))
    with np.errstate(divide="ignore", invalid="ignore"):
        e = np.where(close, r / 2, (s + values[None, :] * r) / gap)
    return x + x @ e, values, close, _norm(e)


def _subsolve(a: np.ndarray, x: np.ndarray, values: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Vectors of each cluster of close values, turned to the eigenvectors of the matrix within the cluster.

    The matrix is shifted by the cluster's mean and scaled in the higher
    precision, so that double precision resolves gaps inside the cluster.
    """
    order = np.argsort(values, kind="stable")
    x, chained = x[:, order], close[np.ix_(order, order)]
    start = 0
    for i in range(1, len(order) + 1):
        if i < len(order) and chained[i - 1, i]:
            continue
        if i - start > 1:
            own = x[:, start:i]
            # Not quite orthogonal vectors would tilt the small matrix.
            own = own @ (1.5 * np.eye(i - start, dtype=HIGH) - 0.5 * (own.T @ own))
            inner = own.T @ (a @ own)
            inner = inner - np.eye(i - start, dtype=HIGH) * (np.trace(inner) / (i - start))
            if size := np.abs(inner).max():
                inner = inner / size
            x[:, start:i] = own @ np.linalg.eigh(((inner + inner.T) / 2).astype(np.float64))[1].astype(HIGH)
        start = i
    return x


def eigenvectors(matrix: np.ndarray, most_steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, to double precision.

    Eigenvectors in float32 start the iteration of Ogita and Aishima, which
    squares the error in every step by products in higher precision. Where
    values lie too close for a step to part them, the cluster is solved by
    itself and the iteration goes on. It ends when a step corrects nothing
    that doubles hold, or no less than the one before; equal values keep any
    orthonormal vectors.
    """
    scale = np.abs(matrix).max() if matrix.size else 0.0
    a = matrix.astype(HIGH) / (scale or 1)
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    last = np.inf
    for _ in range(most_steps):
        x, values, close, moved = _step(a, x)
        if (close & ~np.eye(len(a), dtype=bool)).any():
            x = _subsolve(a, x, values, close)
        elif moved < 1e-17 * len(a) or last < 1e-6 and moved > last / 2:
            break
        last = moved
    x = x / np.sqrt((x * x).sum(0))
    values = (x * (a @ x)).sum(0) * (scale or 1)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), x[:, order].astype(np.float64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            yield b.slice(lo, ROWS)


def _sums(dims: int):
    """The number of vectors of a task and their sum in every dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for b in _blocks(batches):
            x = _matrix(b.column(0), dims)
            n += len(x)
            # Halves of 32 bits, so that no sum of a block overflows.
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * dims, pa.int64()), pa.array(range(dims), pa.int32()), pa.array([str(t) for t in total])], ["n", "i", "total"]
            )

    return run


def _products(mean: np.ndarray, weights: np.ndarray | None = None):
    """Sums of the products of all pairs of centred entries (of their projections, with weights): a row of the matrix each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(mean) if weights is None else weights.shape[1]
        total = np.zeros((size, size))
        for b in _blocks(batches):
            y = _matrix(b.column(0), len(mean)) - mean
            y = y if weights is None else y @ weights
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "products"])

    return run


def _covariance(vectors: DataFrame, n: int, mean: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Covariance of all vectors with divisor n: every task adds its own, Spark adds the tasks' row by row."""
    size = len(mean) if weights is None else weights.shape[1]
    rows = vectors.mapInArrow(_products(mean, weights), "i int, products array<double>")
    summed = rows.groupBy("i").agg(*[F.sum(F.col("products")[j]).alias(f"c{j}") for j in range(size)]).collect()
    return np.array([list(r)[1:] for r in sorted(summed)]).reshape(size, size) / n


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """``vec_id`` and ``x``, the vector as whole numbers ``floor(factor * c)``.

    Rows drop out whose vector is null, empty or holds an entry that is null,
    not finite or beyond 2**62 after the factor.
    """
    scaled = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * factor))
    sound = F.forall(F.col(vector_col), lambda c: F.coalesce(F.abs(c.cast("double") * factor) < TOO_LARGE, F.lit(False)))
    return rows.filter(sound & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("x"))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _deviations(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """Sum over the dimensions of (n * x - total) squared, exact; null where a long cannot hold it."""
    # What every intermediate number stays below, as exact integers.
    widest = max(n * max(abs(int(x.max())), abs(int(x.min()))) + abs(t) for t in total)
    if widest * widest * len(total) < 1 << 63:
        apart = x * n - np.array(total, np.int64)
        return pa.array((apart * apart).sum(1))
    exact = [sum((n * v - t) ** 2 for v, t in zip(row, total, strict=True)) for row in x.tolist()]
    return pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())


def _whitened(n: int, total: list[int], weights: np.ndarray, explained: list, identity_error: float | None):
    mean = np.array([float(t / n) for t in total])
    k = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), len(total))
            projected = ((x - mean) @ weights).ravel()
            each = pa.array(np.repeat(np.arange(len(x)), k))
            numbers = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(each), numbers, pa.array(np.full(len(each), n)), _deviations(x, n, total).take(each),
                    pa.array(projected, pa.float64(), from_pandas=True), pa.array(explained * len(x), pa.float64()),
                    pa.array([identity_error] * len(each), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(rows: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """A row for each vector and component: ``whitened`` (the projection over the root of the variance), and what holds for all.

    The fit list is every distinct vector of whole numbers once: ``n`` vectors
    with a sum in every dimension. A second pass sums products of centred
    entries; tasks send a matrix of dims x dims, which Spark adds row by row,
    so what reaches the driver depends on the dimension alone. There the
    eigenvectors are found (``eigenvectors``). ``identity_error`` comes from a
    third pass over the fit list: the covariance of the whitened list less the
    identity. ``deviation`` is exact, and null where a long cannot hold it.

    The dimension is the most frequent one, the longest of equally frequent;
    vectors of another drop out like those that ``whole_vectors`` drops.
    Repeated rows and null ids keep their rows. A component without variance
    has no ``whitened`` (null) and counts for nothing in ``identity_error``. A
    table without vectors gives no rows.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, id_col, vector_col, factor)
    common = vectors.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))
    dims = common["dims"]
    vectors = vectors.filter(F.size("x") == dims)
    fit = written(vectors.select("x").distinct(), "whitening-fit")
    sums = fit.mapInArrow(_sums(dims), "n long, i int, total string")
    summed = sorted(sums.groupBy("i").agg(F.sum("n"), F.sum(F.col("total").cast("decimal(38,0)"))).collect())
    n, total = summed[0][1], [int(r[2]) for r in summed]
    mean = np.array([float(t / n) for t in total])
    covariance = _covariance(fit, n, mean)
    values, vectors_of = eigenvectors(covariance)
    k = min(components, dims)
    trace = float(np.trace(covariance))
    signs = np.sign(vectors_of[np.abs(vectors_of).argmax(0), np.arange(dims)])
    spread = values[:k] > dims * np.finfo(np.float64).eps * max(values[0], 0)
    weights = (vectors_of * signs)[:, :k] / np.sqrt(np.where(spread, values[:k], 1))
    explained = [max(float(v), 0.0) / trace if trace > 0 else None for v in values[:k]]
    identity_error = None
    if spread.any():
        own = _covariance(fit, n, mean, weights[:, spread])
        identity_error = float(np.abs(own - np.eye(len(own))).max())
    weights = np.where(spread, weights, np.nan)
    return vectors.mapInArrow(_whitened(n, total, weights, explained, identity_error), SCHEMA)
