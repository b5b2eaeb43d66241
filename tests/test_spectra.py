"""Restarted and sampled spectra against numpy."""

import numpy as np
import pytest

from gridloom import linalg as L
from gridloom.sources.construct import from_dense


def symmetric(n, seed=0):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((n, n)) < 0.2, rng.standard_normal((n, n)), 0.0)
    return a + a.T + np.diag(np.linspace(-3, 9, n) ** 2 / 9)


@pytest.mark.parametrize("which", ["LM", "LA", "SA"])
def test_restarted_lanczos(spark, which):
    a = symmetric(120)
    every = np.linalg.eigvalsh(a)
    want = {"LM": sorted(every, key=lambda x: -abs(x))[:4], "LA": sorted(every)[::-1][:4], "SA": sorted(every)[:4]}[which]
    one = L.eigsh(from_dense(spark, a), 4, which=which, ncv=12, return_eigenvectors=False)
    values, vectors = L.eigsh(from_dense(spark, a), 4, which=which, ncv=12, tol=1e-10)
    v = vectors.collect()
    assert np.allclose(values, want) and not np.allclose(one, want)
    assert np.allclose(a @ v, v * values, atol=1e-7) and np.allclose(v.T @ v, np.eye(4))


def test_restarted_lanczos_as_frames(spark):
    a = symmetric(30, 1)
    values = L.eigsh(from_dense(spark, a), 1, which="LA", ncv=8, tol=1e-7, return_eigenvectors=False, distributed=True)
    assert np.allclose(values, np.linalg.eigvalsh(a)[-1:], rtol=1e-7)


def test_krylov_schur(spark):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((90, 90)) < 0.2, rng.standard_normal((90, 90)), 0.0)
    want = sorted(np.linalg.eigvals(a), key=lambda x: -abs(x))[:4]
    values, vectors = L.eigs(from_dense(spark, a), 4, ncv=16, tol=1e-9)
    assert np.allclose(sorted(abs(values)), sorted(np.abs(want))) and np.allclose(a @ vectors, vectors * values, atol=1e-6)
    assert all(min(abs(v - w) for w in np.linalg.eigvals(a)) < 1e-6 for v in values)


def test_restarted_singular_values(spark):
    rng = np.random.default_rng(3)
    a = np.where(rng.random((70, 50)) < 0.3, rng.standard_normal((70, 50)), 0.0)
    u, sigma, v = L.svds(from_dense(spark, a), 3, ncv=10, tol=1e-10)
    assert np.allclose(sigma, np.linalg.svd(a)[1][:3])
    assert np.allclose(a @ v.collect(), u.collect() * sigma, atol=1e-6)


def test_restarts_on_closed_spaces_and_limits(spark):
    a = np.diag([3.0, 3, 3, 1, 1, 0, 0, 0])  # three values: the space of the first vector closes after as many steps
    assert np.allclose(L.eigsh(from_dense(spark, a), 3, ncv=5, tol=1e-9, return_eigenvectors=False), [3, 3, 3])
    assert np.allclose(L.eigsh(from_dense(spark, a), 2, ncv=8, tol=1e-9, return_eigenvectors=False), [3, 3])
    with pytest.raises(RuntimeError, match="settled"):
        L.eigsh(from_dense(spark, symmetric(120)), 4, ncv=7, maxiter=1)
    for wrong in ({"tol": -1.0}, {"maxiter": 0}, {"tol": 1e-3, "ncv": 1}):
        with pytest.raises(ValueError):
            L.eigsh(from_dense(spark, a), 3, **wrong)
    with pytest.raises(ValueError, match="start vector"):
        L.eigsh(from_dense(spark, a), 1, tol=1e-3, v0=np.zeros(8))


def test_sampled_singular_values(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((60, 5)) @ np.diag([50, 20, 10, 5, 2.0]) @ rng.standard_normal((5, 40)) + 0.01 * rng.standard_normal((60, 40))
    want = np.linalg.svd(a)[1]
    got = L.sampled_svds(from_dense(spark, a), 4, more=4, power=1)
    u, v = got.left.collect(), got.right.collect()
    assert np.allclose(got.values, want[:4], rtol=1e-6) and np.allclose(u.T @ u, np.eye(4)) and np.allclose(v.T @ v, np.eye(4))
    assert np.allclose(u * got.values @ v.T, np.linalg.svd(a)[0][:, :4] * want[:4] @ np.linalg.svd(a)[2][:4], atol=1e-2)
    assert want[8] / 10 < got.bound < 20 * want[8] * np.sqrt(60)
    low = L.sampled_svds(from_dense(spark, np.outer(np.arange(1.0, 7), np.ones(5))), 3, power=0)  # of rank one
    assert np.isclose(low.values[0], np.sqrt(91 * 5)) and len(low.values) == 1
    for wrong in ({"k": 0}, {"k": 41}, {"power": -1}):
        with pytest.raises(ValueError):
            L.sampled_svds(from_dense(spark, a), **wrong)
    with pytest.raises(RuntimeError):
        L.sampled_svds(from_dense(spark, np.zeros((3, 3))), 1)


def test_restarted_runs_of_a_matrix_too_large_for_the_driver_take_blocks(spark, monkeypatch):
    """Steps are passes for a block of vectors, and a value of three equal blocks on the diagonal is found three times."""
    from gridloom.config import config_context
    from gridloom.linalg import spectral

    monkeypatch.setattr(spectral, "_restarted", None)  # a vector at a time, which takes jobs a step
    rng = np.random.default_rng(5)
    one = np.where(rng.random((10, 14)) < 0.5, rng.standard_normal((10, 14)), 0.0)
    one[3] = 0
    a = np.kron(np.eye(3), one)
    with config_context(local_cells=4):
        for m in (a, a.T):
            u, sigma, v = L.svds(from_dense(spark, m), 4, ncv=6, tol=1e-10)
            assert np.allclose(sigma, np.linalg.svd(a)[1][:4]) and np.isclose(sigma[0], sigma[2])
            u, v = u.collect(), v.collect()
            assert np.allclose(m @ v, u * sigma, atol=1e-7) and np.allclose(u.T @ u, np.eye(4)) and np.allclose(v.T @ v, np.eye(4))
        s = symmetric(70)  # six blocks of eight are not the whole space
        values, vectors = L.eigsh(from_dense(spark, s), 2, which="LA", ncv=8, tol=1e-9)
        assert np.allclose(values, np.linalg.eigvalsh(s)[::-1][:2]) and np.allclose(s @ vectors.collect(), vectors.collect() * values, atol=1e-6)


def test_the_gram_operator_forms_no_product(spark, monkeypatch):
    from gridloom.linalg import spectral
    from gridloom.operators.matrix import SparseMatrix

    monkeypatch.setattr(SparseMatrix, "matmat", None)
    a = np.random.default_rng(6).standard_normal((12, 30))
    x = np.arange(12.0)
    for fits in (True, False):
        monkeypatch.setattr(spectral, "passable", lambda *_, fits=fits: fits)
        assert np.allclose(L.gram_operator(from_dense(spark, a)).matvec(spectral.dense(spark, x)).collect(), a @ a.T @ x)


def test_a_pass_does_not_depend_on_how_files_are_cut(spark, monkeypatch):
    """Files read several at once, or in parts, once split a column's cells, or left them unsorted."""
    from gridloom.operators import passes

    a = np.where(np.random.default_rng(7).random((300, 50)) < 0.5, 1.5, 0.0)
    x = np.random.default_rng(8).standard_normal((300, 2))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(passes, "TASK_CELLS", 500)
    for most in ("2k", "64k", kept):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        by = passes.Passes(from_dense(spark, a), "j")
        assert np.allclose(by.times(x), a.T @ x) and np.allclose(by.normal(x), a @ (a.T @ x))
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


@pytest.mark.parametrize("wide", [True, False])
def test_sampled_values_send_no_cells(spark, monkeypatch, wide):
    """The same by passes as by joins, which sent every cell with its columns for each product."""
    from gridloom.linalg import sampled
    from gridloom.operators import passes

    rng = np.random.default_rng(10)
    a = rng.standard_normal((12, 3)) @ np.diag([9, 4, 1.0]) @ rng.standard_normal((3, 20)) + 0.01 * rng.standard_normal((12, 20))
    a = a if wide else a.T
    joins = []
    kept = sampled.SparseMatrix.matmul_transpose
    monkeypatch.setattr(sampled.SparseMatrix, "matmul_transpose", lambda *x: joins.append(x) or kept(*x))
    u, s, vt = np.linalg.svd(a)
    got = L.sampled_svds(from_dense(spark, a), 2, more=4)
    assert not joins and np.allclose(got.values, s[:2], rtol=1e-6) and s[6] / 10 < got.bound < 20 * s[6] * np.sqrt(20)
    x, y = got.left.collect(), got.right.collect()
    assert np.allclose(x.T @ x, np.eye(2)) and np.allclose(x * got.values @ y.T, u[:, :2] * s[:2] @ vt[:2], atol=1e-3)
    z = passes.drawn(np.arange(50_000), 2, 3)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs(np.corrcoef(z.T)[0, 1]) < 0.02


def test_sampled_values_that_come_often(spark):
    """Blocks on the diagonal: more copies of the leading value than columns, and a long rest; eight digits."""
    one = np.ones((10, 10)) + 2 * np.random.default_rng(13).random((10, 10))
    a = np.kron(np.eye(40), one)
    got = L.sampled_svds(from_dense(spark, a), 2, more=4, power=2)
    assert np.allclose(got.values, np.linalg.svd(one)[1][0], rtol=2e-8)
