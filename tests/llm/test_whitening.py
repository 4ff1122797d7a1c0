"""Whitening against numpy's dense eigensolver."""

import numpy as np
import pytest

from receiptlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component string"


def dense(vectors):
    """Plain version: (means, values, axes) of the distinct whole-number vectors."""
    x = np.unique(np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000, axis=0)
    c = x - x.mean(0)
    values, axes = np.linalg.eigh(c.T @ c / len(x))
    return x, values[::-1], axes[:, ::-1]


def checked(got, vectors, components=16):
    x, values, axes = dense(vectors)
    n, sums = len(x), x.sum(0)
    rows = {}
    for r in got:
        rows.setdefault(r["vec_id"], {})[r["component"]] = r
    for i, v in enumerate(vectors):
        mine = rows[i]
        k = len(mine)
        assert k == min(components, (values > 1e-9).sum()) and sorted(mine) == list(range(1, k + 1))
        own = np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000
        assert mine[1]["n"] == n and mine[1]["deviation"] == sum(int(n * int(a) - int(s)) ** 2 for a, s in zip(own, sums, strict=True))
        want = (own - sums / n) @ axes[:, :k] / np.sqrt(values[:k])
        whitened = np.array([mine[j + 1]["whitened"] for j in range(k)])
        assert np.allclose(np.abs(want), np.abs(whitened), atol=1e-7)
        assert np.allclose([mine[j + 1]["explained"] for j in range(k)], values[:k] / values.sum(), rtol=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9 and max(r["residual"] for r in got) < 1e-12
    return rows


def test_whitening(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((700, 24)) * np.linspace(3, 1, 24)).astype(np.float32)
    vectors[100:140] = vectors[5]  # one vector many times counts once in the fit
    rows = [(i, v.tolist(), None, "x") for i, v in enumerate(vectors)]
    odd = [(None, vectors[0].tolist()), (5, vectors[5].tolist()), (901, None), (902, []), (903, [1.0, 2.0]), (904, [None, *vectors[0][1:].tolist()]), (905, [float("nan"), *vectors[0][1:].tolist()]), (906, [float("inf"), *vectors[0][1:].tolist()])]
    table = spark.createDataFrame(rows + [(i, v, 1, None) for i, v in odd], SCHEMA).repartition(5)
    got = whitening.whiten(table).collect()
    assert len(got) == (700 + 2) * 16 and {r["vec_id"] for r in got} == {*range(700), None}
    found = checked([r for r in got if r["vec_id"] is not None], vectors)
    signs = {c: np.sign(sum(found[i][c]["whitened"] * (vectors[i] @ vectors[0]) for i in range(50))) for c in range(1, 17)}
    assert set(signs.values()) <= {-1.0, 1.0}


def test_wide_and_narrow_vectors(spark, monkeypatch):
    """Restarts and inner steps are needed where the space is much wider than the subspace; few dimensions give few components."""
    monkeypatch.setattr(whitening, "WIDEST", 3)
    rng = np.random.default_rng(5)
    wide = rng.standard_normal((300, 120)) * np.r_[np.linspace(6, 4, 20), np.linspace(2, 0.5, 100)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide.astype(np.float32))], "vec_id long, embedding array<float>")
    checked(whitening.whiten(table).collect(), wide.astype(np.float32))
    narrow = np.float32([[1, 2, 7], [3, 4, 7], [5, 1, 7], [1, 2, 7], [-900, 2, 7]])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(narrow)], "vec_id long, embedding array<double>")
    checked(whitening.whiten(table).collect(), narrow)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_close_and_equal_eigenvalues():
    """Residuals of every pair reach double precision, whatever the gaps."""
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    values = np.r_[[100.0] * 3, 99.999, np.linspace(60, 55, 14), np.linspace(54.9, 1, 182)]
    a = (q * values) @ q.T
    got, x, residuals = whitening.leading_eigenpairs(lambda y: a @ y, 200, 16)
    assert np.allclose(got, values[:16], rtol=1e-12) and np.allclose(x.T @ x, np.eye(16), atol=1e-12) and residuals.max() < 1e-11


def test_minres_solves_each_column():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 3))
    b[:, 1] = 0
    x = whitening.minres(lambda y: a @ y, b, 60, 1e-13)
    assert np.allclose(a @ x, b, atol=1e-8)
