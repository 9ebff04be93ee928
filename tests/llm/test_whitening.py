"""Whitened vectors against a dense decomposition."""

import math

import numpy as np
import pytest

from glossa.llm import whitening


def dense(vectors):
    """(n, deviation by row, eigenvalues, eigenvectors, trace, mean, x) in plain arithmetic."""
    width = max(map(len, vectors), default=0)
    xs = [[math.floor(256 * float(c)) for c in v] + [0] * (width - len(v)) for v in vectors]
    fit = sorted({tuple(x) for x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, float)
    c = a - a.mean(axis=0)
    values, y = np.linalg.eigh(c.T @ c / n)
    deviation = [sum((n * p - s) ** 2 for p, s in zip(x, sums)) for x in xs]
    return n, deviation, values[::-1], y[:, ::-1], a.mean(axis=0), np.array(xs, float)


def held(rows, vectors, top=4):
    n, deviation, values, y, mean, x = dense([v for _, v in vectors])
    got = {}
    for r in rows:
        got.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(got) == list(range(1, top + 1))
    want = (x - mean) @ (y[:, :top] / np.sqrt(values[:top]))
    for k, by_id in got.items():
        assert sum(map(len, by_id.values())) == len(vectors)
        signs = set()
        for (i, _), w, d in zip(vectors, want[:, k - 1], deviation):
            r = by_id[i][0]
            assert (r.n, r.deviation) == (n, d)
            assert r.explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9
            assert abs(r.whitened) == pytest.approx(abs(w), abs=1e-7)
            if abs(w) > 1e-6:
                signs.add(np.sign(r.whitened) == np.sign(w))
        assert len(signs) == 1


@pytest.mark.parametrize("width", [4, 5, 33, 64])
def test_against_dense(spark, width):
    rng = np.random.default_rng(width)
    base = rng.standard_normal((300, width)) * np.linspace(3, 0.2, width)
    vectors = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(150)]  # a third are copies
    bad = [(-1, None), (-2, [None] + [0.0] * (width - 1)), (-3, [float("nan")] * width), (-4, [float("inf")] + [0.0] * (width - 1))]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in vectors + bad], "vec_id long, embedding array<double>, whitened double").repartition(5)
    held(whitening.whitened(df).collect(), vectors)


def test_real_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    held(whitening.query(df).collect(), vectors)


def test_equal_eigenvalues_and_fewer_components(spark):
    corners = [[float(a), float(b), 0.0] for a in (-1, 1) for b in (-1, 1)]
    rows = whitening.whitened(spark.createDataFrame(list(enumerate(corners)), "vec_id long, embedding array<float>")).collect()
    assert {r.component for r in rows} == {1, 2} and len(rows) == 8
    assert all(r.explained == pytest.approx(0.5) and r.identity_error < 1e-12 for r in rows)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.query(spark.createDataFrame([], schema)).collect() == []
    assert whitening.query(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], schema)).collect() == []
    assert whitening.query(spark.createDataFrame([(1, [])], schema)).collect() == []
    ragged = [(1, [1.0]), (None, [1.0, 0.0]), (3, [0.0, 5.0]), (4, [])]
    rows = whitening.query(spark.createDataFrame(ragged, schema)).collect()
    assert {(r.vec_id, r.n) for r in rows} == {(1, 3), (None, 3), (3, 3), (4, 3)} and {r.component for r in rows} == {1, 2}
    huge = whitening.query(spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.5])], schema)).collect()
    assert [r.deviation for r in huge if r.vec_id == 1] == [None] and len(huge) == 3


def test_breakdown_restarts():
    """An operator of rank one breaks the basis down at once; the search goes on and finds the rest zero."""
    u = np.ones(40) / np.sqrt(40)
    values, vectors, passes = whitening.leading(lambda q: 7.0 * np.outer(u, u @ q), 40, 4, 8)
    assert values[0] == pytest.approx(7.0) and np.abs(values[1:]).max() < 1e-12 and passes <= 5
    assert abs(vectors[:, 0] @ u) == pytest.approx(1.0)


def test_packed_vectors():
    x = np.array([[1, -2, 0], [40_000, 0, 0], [0, 0, 0], [2**40, 5, -(2**63)]])
    packed = whitening._pack(x)
    assert (whitening._unpack(packed, 3) == x).all() and [len(p) for p in packed] == [5, 5, 1, 25]


def test_passes_end_by_residuals():
    """A few strong directions in many: the search ends long before the basis is whole."""
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((600, 600)))[0]
    e = np.concatenate([[900, 700, 500, 300], np.linspace(1, 0.1, 596)])
    values, vectors, passes = whitening.leading(lambda b: q @ (e[:, None] * (q.T @ b)), 600)
    assert values == pytest.approx(e[:4], rel=1e-12) and passes < 20
    assert np.abs(np.abs((q[:, :4] * vectors).sum(axis=0)) - 1).max() < 1e-12
