"""Whitening against numpy's eigenvalues and whole-number arithmetic."""

import math

import numpy as np
import pytest

from timbrewatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, i int, deviation string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 1, 2, "clash") for k, v in vectors], SCHEMA)


def restated(vectors, components=32):
    dim = max((len(v) for _, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)), default=0)
    rows = [(k, [math.floor(64 * float(np.float32(x))) + 1_000_000 for x in v]) for k, v in vectors
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    n = len(rows)
    sums = [sum(x[i] for _, x in rows) for i in range(dim)]
    deviation = [(k, sum((n * x[i] - sums[i]) ** 2 for i in range(dim))) for k, x in rows]
    y = np.array([[x[i] - sums[i] / n for i in range(dim)] for _, x in rows])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, deviation, y @ u, e, (y * y).sum() / n


def check(spark, vectors, rank=None):
    got = {}
    for r in whitening.whiten(frame(spark, vectors)).collect():
        got.setdefault(r.component, []).append(r)
    n, deviation, projected, e, trace = restated(vectors)
    assert sorted(got) == list(range(1, (rank or min(32, len(e))) + 1))
    for c, rows in got.items():
        assert sorted((r.vec_id, r.deviation) for r in rows) == sorted(deviation) and {r.n for r in rows} == {n}
        want = {}
        for (k, _), p in zip(deviation, projected[:, c - 1]):
            want.setdefault(k, []).append(p / math.sqrt(e[c - 1]))
        mine = {}
        for r in rows:
            mine.setdefault(r.vec_id, []).append(r.whitened)
        sign = np.sign(sum(a * b for k in want for a, b in zip(mine[k], want[k])))
        assert max(abs(sign * a - b) for k in want for a, b in zip(sorted(mine[k]), sorted(want[k], key=lambda v: sign * v))) < 1e-6
        assert all(abs(r.explained / (e[c - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-9 for r in rows)


def test_awkward_rows(spark):
    r = np.random.default_rng(5)
    vectors = [(k, [float(x) for x in row]) for k, row in enumerate(r.normal(size=(300, 7)) * [9, 5, 3, 2, 1, 0.6, 0.4])]
    vectors += [(0, vectors[0][1]), (900, None), (901, []), (902, [1.0, None] + [0.0] * 5), (903, [float("nan")] * 7), (904, [float("inf")] + [1.0] * 6),
                (905, [1.0, 2.0])]
    check(spark, vectors)


def test_rank_and_constant_dimensions(spark):
    r = np.random.default_rng(6)
    vectors = [(k, [float(a), float(b), float(a), 3.0, float(a) - float(b)]) for k, (a, b) in enumerate(r.integers(-50, 50, size=(80, 2)))]
    check(spark, vectors, rank=2)


@pytest.mark.parametrize("vectors", [[], [(1, None), (2, [])], [(1, [1.0, 2.0])] * 3])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(frame(spark, vectors)).collect() == []


def test_entries_beyond_a_long(spark):
    rows = whitening.whiten(frame(spark, [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 5.0])])).collect()
    assert {r.vec_id for r in rows} == {1, 2, 3} and all(r.deviation is None for r in rows if r.vec_id < 3)
    assert all(math.isfinite(r.whitened) for r in rows)


def test_many_components_of_one_size(spark):
    """Equal eigenvalues: components are not unique, but the whitened covariance is the identity."""
    basis = [(k, [40.0 * (j == k // 2) * (-1) ** k for j in range(40)]) for k in range(80)]
    rows = whitening.whiten(frame(spark, basis)).collect()
    assert len(rows) == 80 * 32 and all(r.identity_error < 1e-12 for r in rows)


def test_factor_and_rotation():
    r = np.random.default_rng(7)
    a = r.normal(size=(30, 12))
    v = a @ a.T
    left = whitening.pivoted_cholesky(v)
    assert left.shape[1] == 12 and np.allclose(left @ left.T, v)
    turned = whitening.one_sided_jacobi(left)
    gram = turned.T @ turned
    assert np.allclose(np.diag(gram), np.linalg.eigvalsh(v)[::-1][:12]) and np.abs(gram - np.diag(np.diag(gram))).max() < 1e-12 * gram[0, 0]
