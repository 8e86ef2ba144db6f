import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditframe.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def turned(values, seed=0):
    """A matrix of these eigenvalues and its eigenvectors, in the higher precision."""
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((len(values),) * 2))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(len(values), dtype=np.longdouble) - 0.5 * (q.T @ q))
    return ((q * np.array(values, np.longdouble)) @ q.T), q


@pytest.mark.parametrize(
    "values", [np.linspace(9, 1, 20), [5, 5 - 1e-9, 5 - 3e-9, 2, 1, 1e-6], [4, 4, 4, 1, 0, 0], [1e8, 1.0, 1 - 1e-7, 1e-8], [3.0], [0.0, 0.0]], ids=str
)
def test_vectors_are_exact_to_double_precision(values):
    matrix, _ = turned(values)
    found, vectors = whitening.eigenvectors(matrix)
    top = max(abs(np.array(values)))
    assert np.allclose(found, sorted(values, reverse=True), rtol=0, atol=4e-15 * (top or 1))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-14
    left = matrix @ vectors - vectors * found
    assert np.abs(left).max() <= 1e-14 * (top or 1)


def test_clustered_values_part_their_vectors():
    values = [5, 5 - 1e-9, 5 - 3e-9, 2, 1]
    matrix, q = turned(values, 3)
    _, vectors = whitening.eigenvectors(matrix)
    # Double precision alone leaves an error near 1e-7 in these vectors.
    assert np.abs(np.abs(q.T @ vectors) - np.eye(5)).max() < 1e-9


def by_hand(rows, components=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, total = len(fit), [int(s) for s in fit.sum(0)]
    y = fit - np.array([t / n for t in total])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        w = (np.array(x) - np.array([t / n for t in total])) @ vectors[:, :components] / np.sqrt(values[:components])
        out[i] = (n, sum((n * c - t) ** 2 for c, t in zip(x, total, strict=True)), w, values[:components] / values.sum())
    return out


def test_whitening_by_hand(spark, table):
    rows = [(r.vec_id, r.embedding) for r in table("embeddings").collect()]
    rows += [(10_000, rows[0][1]), (10_001, rows[0][1]), (10_002, None), (10_003, [None, *rows[0][1][1:]]), (10_004, [math.nan, *rows[0][1][1:]]), (10_005, [math.inf, *rows[0][1][1:]])]
    want = by_hand(rows)
    got = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    assert len(got) == 4 * len(want) and {r.vec_id for r in got} == set(want)
    signs = {}
    for r in got:
        n, deviation, w, explained = want[r.vec_id]
        sign = signs.setdefault(r.component, np.sign(w[r.component - 1]) * np.sign(r.whitened))
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened * sign - w[r.component - 1]) < 1e-9 and abs(r.explained - explained[r.component - 1]) < 1e-12
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_registered_query(spark):
    got = queries.op13_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = got.collect()
    own = [r.whitened for r in rows if r.component == 1]
    assert abs(np.mean(own)) < 0.2 and rows[0].identity_error < 1e-4


def test_odd_rows(spark):
    def whiten(rows):
        df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"x": F.lit(1), "n": F.lit(2), "a.b": F.lit(3)})
        return sorted(map(tuple, whitening.whiten(df).collect()), key=str)

    assert whiten([]) == [] and whiten([(1, None), (2, []), (3, [None])]) == []
    one = whiten([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])
    # One vector varies in nothing: a row a component, without a projection.
    assert len(one) == 6 and all(r[2:] == (1, 0, None, None, None) for r in one)
    # A single dimension has one component; vectors of another length drop out.
    line = whiten([(1, [0.0]), (2, [1.0]), (3, [2.0]), (4, [1.0, 2.0])])
    assert [r[0] for r in line] == [1, 2, 3] and [round(abs(r[4]), 9) for r in line] == [round(math.sqrt(1.5), 9), 0, round(math.sqrt(1.5), 9)]
    # A component without variance is null beside one that varies.
    flat = whiten([(1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert [r[4] is None for r in flat] == [False, True] * 2 and flat[0][6] < 1e-12
    # Exact sums beyond 32 bits, and deviations that no long holds.
    wide = whiten([(1, [2.0**45, 0.0]), (2, [-(2.0**45), 0.0])])
    assert {r[3] for r in wide} == {None}
