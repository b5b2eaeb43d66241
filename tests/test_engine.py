"""The matrix operators against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gridloom as g
from gridloom import linalg as L
from gridloom.config import Option
from gridloom.linalg import preconditioners as P
from gridloom.operators import autodiff as D
from gridloom.sources.random import permuted
from gridloom.streaming.accumulate import Accumulator, running_sums

LAYOUTS = ("coo", "csr", "csc")


def sparse(rng, m, n, density=0.3):
    return rng.integers(-5, 6, (m, n)) * (rng.random((m, n)) < density) * 1.0


def with_duplicates(spark, a, layout="coo"):
    """The matrix with each cell in two parts."""
    i, j = np.nonzero(a)
    v = a[i, j]
    return g.coo_array((np.concatenate([v - 1, np.ones(len(v))]), (np.concatenate([i, i]), np.concatenate([j, j]))), a.shape, spark=spark).asformat(layout)


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(5)
    return sparse(rng, 7, 9), sparse(rng, 9, 6), rng


def test_threshold_and_values(spark):
    dense = np.array([[1, 0, -2, 0], [0, 0.25, 0, 3], [4, 0, 0, 0]])
    a = g.fromdense(spark, dense, threshold=0.2)
    assert (a.todense().collect() == dense).all() and a.canonical and a.nnz == 5
    assert (g.fromdense(spark, dense, threshold=0.25).todense().collect() == np.where(abs(dense) > 0.25, dense, 0)).all()
    assert g.fromdense(spark, np.array([[np.nan, 0.0]])).nnz == 1 and g.fromdense(spark, np.array([[np.nan, 1.0]]), threshold=0.1).nnz == 1
    with pytest.raises(ValueError):
        g.fromdense(spark, dense, threshold=-1)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_products(spark, pair, layout):
    a, b, rng = pair
    s, t = with_duplicates(spark, a, layout), with_duplicates(spark, b, layout)
    x, X, B = rng.integers(-3, 4, 9) * 1.0, rng.integers(-3, 4, (9, 4)) * 1.0, rng.integers(-3, 4, (2, 9, 3)) * 1.0
    assert (s.matvec(x).collect() == a @ x).all() and ((s @ X).collect() == a @ X).all() and ((s @ B).collect() == a @ B).all()
    assert (s.batched_matvec(B[:, :, 0]).collect() == B[:, :, 0] @ a.T).all()
    assert (s.matvec_transpose(np.ones(7)).collect() == a.T @ np.ones(7)).all() and (s.matmul_transpose(np.ones((7, 2))).collect() == a.T @ np.ones((7, 2))).all()
    p = s @ t
    assert (p.todense().collect() == a @ b).all() and p.layout == layout and p.canonical and p.nnz == np.count_nonzero(a @ b)
    assert s.product_rows(t) == sum(np.count_nonzero(a[:, k]) * np.count_nonzero(b[k]) for k in range(9))
    for bad in (np.ones(7), np.ones((7, 2))):
        with pytest.raises(ValueError):
            s @ bad
    with pytest.raises(ValueError):
        t @ s.astype("float64")


@pytest.mark.parametrize("layout", LAYOUTS)
def test_reductions(spark, pair, layout):
    a = pair[0]
    s = with_duplicates(spark, a, layout)
    assert (s.row_sums().collect() == a.sum(1)).all() and (s.col_sums().collect() == a.sum(0)).all()
    assert np.allclose(s.row_norms().collect(), np.linalg.norm(a, axis=1)) and np.allclose(s.col_norms().collect(), np.linalg.norm(a, axis=0))
    assert (s.diagonal().collect() == np.diag(a)).all() and s.trace().first()[0] == np.trace(a) and s.sum().first()[0] == a.sum()
    assert (s.sum(0).collect() == a.sum(0)).all() and (s.sum(-1).collect() == a.sum(1)).all()
    with pytest.raises(ValueError):
        s.sum(2)
    assert s.nnz == 2 * np.count_nonzero(a) and s.canonicalize().nnz == np.count_nonzero(a)
    assert (s.tril(1).todense().collect() == np.tril(a, 1)).all() and (s.triu(-1).todense().collect() == np.triu(a, -1)).all()
    assert (s.T.todense().collect() == a.T).all() and ((2 * s).todense().collect() == 2 * a).all()
    with pytest.raises(TypeError):
        s * True
    assert s.dot(s).first()[0] == (a * a).sum()


def test_zeros_stay_or_go(spark):
    a = g.coo_array((np.array([1.0, -1.0, 0.0]), (np.array([0, 0, 1]), np.array([0, 0, 1]))), (2, 2), spark=spark)
    assert a.sum_duplicates().nnz == 2 and g.add(a, a).nnz == 0 and a.prune().nnz == 2
    assert g.subtract(0, a).todense().collect().sum() == 0 and (a + 0) is a
    for bad in (lambda: a + 1, lambda: 1 - a):
        with pytest.raises(NotImplementedError):
            bad()
    with pytest.raises(TypeError):
        g.add(a, np.ones((2, 2)))
    with pytest.raises(TypeError):
        g.add(a, a.astype("float32"))
    with pytest.raises(ValueError):
        g.add(a, g.eye(spark, 3))


@pytest.mark.parametrize("left", LAYOUTS)
@pytest.mark.parametrize("right", ("coo", "csc"))
def test_sums_of_layouts(spark, left, right):
    a, b = sparse(np.random.default_rng(1), 4, 5), sparse(np.random.default_rng(2), 4, 5)
    s, t = with_duplicates(spark, a, left), with_duplicates(spark, b, right)
    assert ((s + t).todense().collect() == a + b).all() and ((s - t).todense().collect() == a - b).all()
    assert (s + t).layout == ("csc" if left == right == "csc" else "csr") and (s @ t.T).layout == left


def test_compressed_buffers(spark):
    a = g.csr_array((np.array([1.0, 2, 3]), np.array([1, 0, 1]), np.array([0, 2, 3])), (2, 2), spark=spark)
    assert (a.todense().collect() == [[2, 1], [0, 3]]).all()
    assert (g.csc_array((np.array([1.0, 2, 3]), np.array([1, 0, 1]), np.array([0, 2, 3])), (2, 2), spark=spark).todense().collect() == [[2, 0], [1, 3]]).all()
    assert [tuple(r) for r in a.indptr().orderBy("place").collect()] == [(0, 0, 2), (1, 2, 3)]
    assert g.csr_array(a.packed(), (2, 2)).todense().collect().tolist() == a.todense().collect().tolist()
    for bad in (np.array([0, 3]), np.array([0, 4, 3]), np.array([1, 2, 3])):
        with pytest.raises(ValueError):
            g.csr_array((np.ones(3), np.zeros(3), bad), (2, 2), spark=spark)
    with pytest.raises(ValueError):
        g.coo_array((np.ones(1), (np.array([5]), np.array([0]))), (2, 2), spark=spark, validate="full")
    for name, error in (("bsr", NotImplementedError), ("xyz", ValueError), (3, TypeError)):
        with pytest.raises(error):
            a.asformat(name)
    with pytest.raises(TypeError):
        g.csc_matvec(a, np.ones(2))


def test_constructors(spark):
    for n, m, k in ((3, 3, 0), (3, 5, 1), (5, 3, -2), (2, 2, 7), (0, 4, 0)):
        assert (g.eye(spark, n, m, k=k).todense().collect() == np.eye(n, m, k)).all()
    assert (g.diags(spark, [[1, 2], [3, 4]], [0, 1]).todense().collect() == [[1, 3, 0], [0, 2, 4], [0, 0, 0]]).all()
    assert (g.diags(spark, [5.0], 1, shape=(2, 3)).todense().collect() == [[0, 5, 0], [0, 0, 0]]).all()
    assert (g.diags(spark, 7.0, -1, shape=(3, 3)).todense().collect()[1, 0]) == 7
    for bad in (lambda: g.diags(spark, [[1], [2]], [0, 0]), lambda: g.diags(spark, [[1, 2, 3]], [0], shape=(2, 2))):
        with pytest.raises(ValueError):
            bad()
    assert g.identity(spark, 3, format="csc").layout == "csc" and g.issparse(g.eye(spark, 2)) and not g.issparse(np.eye(2))

    class Foreign:
        shape, row, col, data = (2, 2), np.array([0, 0]), np.array([1, 1]), np.array([1.0, 2.0])

        def tocoo(self):
            return self

    assert g.from_scipy(spark, Foreign()).todense().collect().tolist() == [[0, 3], [0, 0]] and g.asarray(spark, Foreign()).nnz == 1


def test_kron_and_blocks(spark):
    rng = np.random.default_rng(3)
    a, b = sparse(rng, 3, 4), sparse(rng, 2, 3)
    s, t = with_duplicates(spark, a), with_duplicates(spark, b)
    for layout in (None, *LAYOUTS):
        k = g.kron(s, t, layout)
        assert (k.todense().collect() == np.kron(a, b)).all() and k.layout == (layout or "coo")
    c, d = sparse(rng, 3, 3), sparse(rng, 2, 2)
    assert (g.kronsum(with_duplicates(spark, c), with_duplicates(spark, d)).todense().collect() == np.kron(np.eye(2), c) + np.kron(d, np.eye(3))).all()
    assert (g.block_array([[s, None], [None, b]]).todense().collect() == np.block([[a, np.zeros((3, 3))], [np.zeros((2, 4)), b]])).all()
    assert (g.vstack([s, s]).todense().collect() == np.vstack([a, a])).all() and (g.hstack([s, s], format="csc").todense().collect() == np.hstack([a, a])).all()
    assert g.block_diag([s, t]).shape == (5, 7) and g.block_array([[s, None], [None, None]]).shape == (3, 4)
    for bad in (lambda: g.block_array([[s, t]]), lambda: g.block_array([]), lambda: g.block_diag([s, None]), lambda: g.kronsum(s, t)):
        with pytest.raises(ValueError):
            bad()


def test_complex(spark):
    rng = np.random.default_rng(4)
    a = sparse(rng, 4, 4) + 1j * sparse(rng, 4, 4)
    s = g.fromdense(spark, a)
    x = rng.random(4) + 1j * rng.random(4)
    assert np.allclose(s.todense().collect(), a) and np.allclose((s @ x).collect(), a @ x) and np.allclose((s @ s).todense().collect(), a @ a)
    assert np.allclose(s.H.todense().collect(), a.conj().T) and np.allclose(complex(*s.vdot(s.T).first()[0]), np.vdot(a, a.T)) and np.allclose(complex(*s.dot(s.T).first()[0]), (a * a.T).sum())
    assert np.allclose(s.row_norms().collect(), np.linalg.norm(a, axis=1)) and np.allclose(s.rmatvec(x).collect(), a.conj().T @ x)
    assert np.allclose((2j * s).todense().collect(), 2j * a)
    with pytest.raises(TypeError):
        L.cg(s, x)


def test_derivatives(spark):
    rng = np.random.default_rng(6)
    a, x, y = sparse(rng, 5, 4), rng.random(4), rng.random(5)
    s, pattern = g.fromdense(spark, a), lambda m: m * (a != 0)
    d = lambda v: g.dense(spark, v)
    assert np.allclose(D.matvec_data_vjp(s, d(x), d(y)).todense().collect(), pattern(np.outer(y, x)))
    X, Y = rng.random((4, 3)), rng.random((5, 3))
    assert np.allclose(D.matmul_data_vjp(s, d(X), d(Y)).todense().collect(), pattern(Y @ X.T))
    assert np.allclose(D.rhs_vjp(s, d(y)).collect(), a.T @ y) and np.allclose(D.rhs_vjp(s, d(Y)).collect(), a.T @ Y)
    assert np.allclose(D.matvec_jvp(s, 2 * s, d(x), d(x)).collect(), 3 * a @ x)
    G = rng.random((5, 4))
    assert np.allclose(D.todense_vjp(s, d(G)).todense().collect(), pattern(G)) and np.allclose(D.row_sums_vjp(s, d(y)).todense().collect(), pattern(np.repeat(y[:, None], 4, 1)))
    assert np.allclose(D.col_sums_vjp(s, d(x)).todense().collect(), pattern(np.repeat(x[None], 5, 0))) and np.allclose(D.trace_vjp(s, 2.0).todense().collect(), pattern(2 * np.eye(5, 4)))
    assert np.allclose(D.diagonal_vjp(s, d(x)).todense().collect(), pattern(np.eye(5, 4) * x))
    assert D.matmul_data_vjp(with_duplicates(spark, a), d(X), d(Y)).nnz == 2 * np.count_nonzero(a)


@pytest.fixture(scope="module")
def systems(spark):
    rng = np.random.default_rng(7)
    m = sparse(rng, 24, 24, 0.15)
    spd, general = m @ m.T + 30 * np.eye(24), m + 20 * np.eye(24)
    return spd, general, g.fromdense(spark, spd), g.fromdense(spark, general), rng.random(24)


def test_krylov(systems):
    spd, general, s, t, x = systems
    for solve, a, m in ((L.cg, s, spd), (L.minres, s, spd), (L.bicgstab, t, general), (L.gmres, t, general)):
        for pre in (None, P.jacobi(a)):
            got, info = solve(a, m @ x, rtol=1e-10, M=pre, return_info=True)
            assert info.converged and int(info) == 0 and np.allclose(got.collect(), x), (solve.__name__, pre)
    shifted, info = L.minres(s, (spd - 3 * np.eye(24)) @ x, shift=3.0, rtol=1e-10, return_info=True)
    assert info.converged and np.allclose(shifted.collect(), x)
    indefinite = np.diag([1.0, -2, 3, -4])
    got, info = L.minres(g.fromdense(s.spark, indefinite), np.ones(4), rtol=1e-10, return_info=True)
    assert info.converged and np.allclose(got.collect(), 1 / np.diag(indefinite))
    seen = []
    _, status = L.cg(s, spd @ x, maxiter=1, callback=seen.append)
    assert status == 1 and len(seen) == 1
    assert L.cg(g.fromdense(s.spark, -spd), x)[1] == -2 and L.cg(s, np.full(24, np.nan))[1] == -3 and L.cg(s, np.zeros(24))[1] == 0
    assert L.gmres(t, general @ x, restart=3, rtol=1e-9, return_info=True)[1].converged
    with pytest.raises(ValueError):
        L.bicgstab(t, x, rtol=1e-3, tol=1e-4)
    for pre in (P.ilu0(t), P.exact(t), P.from_factorized(L.factorized(t)), lambda r: r / np.diag(general)):
        assert L.gmres(t, general @ x, M=pre, rtol=1e-9, return_info=True)[1].converged
    for pre in (P.ichol0(s), P.chebyshev(s), P.chebyshev(s, degree=4, lambda_min=20.0, lambda_max=300.0), P.identity(s), P.diagonal(s.spark, np.diag(spd))):
        assert L.cg(s, spd @ x, M=pre, rtol=1e-9, return_info=True)[1].converged
    for bad in (s, 3):
        with pytest.raises(TypeError):
            L.cg(s, x, M=bad)


def test_distributed_solvers(systems):
    spd, general, s, t, x = systems
    for solve, a, m, pre in ((L.cg, s, spd, P.jacobi(s)), (L.gmres, t, general, None)):
        got, info = solve(a, m @ x, rtol=1e-4, M=pre, return_info=True, distributed=True, maxiter=30)
        assert info.converged and np.allclose(got.collect(), x, atol=1e-2)


def test_matrix_free(systems):
    spd, general, s, t, x = systems
    op = L.LinearOperator((24, 24), lambda v: general @ v, lambda v: general.T @ v)
    assert np.allclose(L.bicgstab(op, general @ x, rtol=1e-10)[0], x) and np.allclose(L.gmres(op, general @ x, rtol=1e-10)[0], x)
    assert np.allclose((op.T @ x), general.T @ x) and np.allclose(op.H.matvec(x), general.T @ x)
    with pytest.raises(NotImplementedError):
        op.matmat(np.ones((24, 2)))
    assert np.allclose(L.aslinearoperator(s).matvec(g.dense(s.spark, x)).collect(), spd @ x)


def test_direct(systems):
    spd, general, s, t, x = systems
    assert np.allclose(L.spsolve(t, general @ x).collect(), x) and np.allclose(L.cholesky(s).solve(spd @ x).collect(), x)
    two = np.stack([x, 2 * x], 1)
    for method, a, m in (("lu", t, general), ("qr", t, general), ("ldlt", s, spd), ("spd", s, spd), ("cholesky_ata", t, general), ("auto", t, general)):
        assert np.allclose(L.factorized(a, method=method).solve(m @ two).collect(), two), method
    tall = np.vstack([general, spd])
    assert np.allclose(L.factorized(g.fromdense(s.spark, tall)).solve(tall @ x).collect(), x)
    f = L.splu(t)
    assert np.allclose(f.L.todense().collect() @ f.U.todense().collect(), general[f.perm])
    assert np.allclose(L.spsolve_triangular(s.tril(), np.tril(spd) @ x).collect(), x) and np.allclose(L.spsolve_triangular(s.triu(), np.triu(spd) @ x, lower=False).collect(), x)
    for bad in (lambda: L.cholesky(g.fromdense(s.spark, -spd)), lambda: L.splu(g.fromdense(s.spark, np.ones((3, 3)))), lambda: L.spsolve_triangular(g.fromdense(s.spark, np.array([[0.0, 0], [1, 1]])), np.ones(2))):
        with pytest.raises(RuntimeError):
            bad()
    with g.config_context(factor_rows=5):
        with pytest.raises(ValueError):
            L.spsolve(t, x, distributed=False)
        assert np.allclose(L.spsolve(t, general @ x).collect(), x)  # by fronts
    assert L.triangular_levels(g.diags(s.spark, [np.ones(4), np.ones(3)], [0, -1])).collect().tolist() == [0, 1, 2, 3]


def test_many_systems(spark):
    rng = np.random.default_rng(8)
    ms, xs = rng.random((3, 5, 5)) + 5 * np.eye(5), rng.random((3, 5))
    cells = spark.createDataFrame([(s, i, j, float(ms[s, i, j])) for s in range(3) for i in range(5) for j in range(5)], "s long, i long, j long, v double")
    rhs = spark.createDataFrame([(s, i, float((ms[s] @ xs[s])[i])) for s in range(3) for i in range(5)], "s long, i long, b double")
    for r in L.solve_many(cells, rhs).collect():
        assert r.x == pytest.approx(xs[r.s, r.i])


def test_spectra(systems):
    spd, general, s, t, _ = systems
    want = np.linalg.eigvalsh(spd)
    for which, part in (("LM", want[::-1]), ("SA", want), ("LA", want[::-1]), ("SM", want)):
        assert np.allclose(L.eigsh(s, 3, which=which, ncv=24, return_eigenvectors=False), part[:3])
    values, vectors = L.eigsh(s, 2, ncv=24)
    assert np.allclose(spd @ vectors.collect(), vectors.collect() * values)
    values, vectors = L.eigs(t, 3, ncv=24)
    assert np.allclose(general @ vectors, vectors * values)
    u, sv, v = L.svds(t, 3, ncv=24)
    assert np.allclose(sv, np.linalg.svd(general)[1][:3]) and np.allclose(general @ v.collect(), u.collect() * sv)
    alphas, betas, basis = L.lanczos(s, 6, v0=np.arange(1.0, 25))
    q = basis.collect()
    assert np.allclose(q.T @ q, np.eye(6)) and np.allclose(q.T @ spd @ q, np.diag(alphas) + np.diag(betas[:5], 1) + np.diag(betas[:5], -1), atol=1e-8)
    ring = 2 * np.eye(8) - np.roll(np.eye(8), 1, 0) - np.roll(np.eye(8), -1, 0)  # the default start is an eigenvector: the space is restarted
    assert np.allclose(L.eigsh(g.fromdense(s.spark, ring), 3, ncv=8, return_eigenvectors=False), np.sort(np.linalg.eigvalsh(ring))[::-1][:3])
    with pytest.raises(ValueError):
        L.eigsh(s, 3, which="XX")


def test_random(spark):
    a = g.random_array(spark, (30, 20), density=0.1, random_state=3)
    assert a.nnz == 60 == a.df.select("i", "j").distinct().count() and a.validate()
    assert sorted(a.df.collect()) == sorted(g.random_array(spark, (30, 20), density=0.1, random_state=3).df.collect()) != sorted(g.random_array(spark, (30, 20), density=0.1, random_state=4).df.collect())
    assert g.random_array(spark, (1, 5), density=0.5).nnz == 2 and g.rand(spark, 3, 3, 1.0).nnz == 9 and g.random(spark, 3, 3, 0.0).df.count() == 0
    calls = []
    b = g.random(spark, 4, 4, 0.5, data_rvs=lambda n: calls.append(n) or np.arange(n))
    assert calls == [8] and sorted(r.v for r in b.df.collect()) == list(range(8))
    assert sorted(permuted(np.arange(77), 77, 5).tolist()) == list(range(77))


def test_matrix_market(spark, tmp_path):
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.0\n3 1 -1.5\n2 2 4\n")
    assert g.read_matrix_market(spark, str(tmp_path / "s.mtx")).todense().collect().tolist() == [[2, 0, -1.5], [0, 4, 0], [-1.5, 0, 0]]
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n2 3 2\n1 3\n2 1\n")
    assert g.read_matrix_market(spark, str(tmp_path / "p.mtx")).todense().collect().tolist() == [[0, 0, 1], [1, 0, 0]]
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n")
    assert g.read_matrix_market(spark, str(tmp_path / "a.mtx")).collect().tolist() == [[1, 3], [2, 4]]
    a = g.read_matrix_market(spark, str(tmp_path / "s.mtx")).tocsc()
    g.write_parquet(a, str(tmp_path / "out"))
    b = g.read_parquet(spark, str(tmp_path / "out"))
    assert (b.layout, b.shape) == ("csc", (3, 3)) and (b.todense().collect() == a.todense().collect()).all()


def test_lazy(spark):
    rng = np.random.default_rng(9)
    a, b, c = sparse(rng, 4, 30), sparse(rng, 30, 3), sparse(rng, 3, 20)
    s = [g.fromdense(spark, m) for m in (a, b, c)]
    chain = g.lazy(s[0]) @ s[1] @ s[2]
    assert (chain.evaluate().todense().collect() == a @ b @ c).all() and chain.order() == ((0, 1), 2) and (chain.T.evaluate().todense().collect() == (a @ b @ c).T).all()
    assert ((chain @ np.ones(20)).collect() == a @ b @ c @ np.ones(20)).all()
    with pytest.raises(ValueError):
        chain @ s[0]


def test_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(0, k, 1.0), (1, 1, 2.0)], "i long, j long, v double").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema("i long, j long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    acc = Accumulator(spark, (2, 3))
    acc.start(stream).awaitTermination()
    assert acc.matrix().todense().collect().tolist() == [[1, 1, 1], [0, 6, 0]]
    before = acc.version
    acc.add(spark.createDataFrame([(0, 0, 9.0)], "i long, j long, v double"), before)  # a batch that was seen
    assert acc.matrix().todense().collect()[0, 0] == 1
    assert running_sums(spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "i long, j long, v double")).first()["v"] == 3
    query = running_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("sums").agg(F.sum("v")).first()[0] == 9


def test_config(spark):
    assert g.get_config("factor_rows") == 3000 and "spgemm_threads" in g.config.list()
    with g.config_context(cpu_threads=3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and g.runtime.info()["spark"] == spark.version
    with pytest.raises(KeyError):
        g.get_config("nothing")
    g.use_cpu()
    with pytest.raises(RuntimeError):
        g.use_gpu()
    assert g.is_available() and g.has_capability("cpu") and not g.has_capability("metal")


def test_plans(spark):
    """Products read only the columns they need, push the join key's filter down, and combine before they shuffle."""
    from gridloom.queries import queries

    plan = queries()["csr_matvec"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in plan and "IsNotNull(l_partkey)" in plan and "partial_sum" in plan


def test_config_options(spark, monkeypatch):
    own, heard = g.ConfigManager(), []
    off = own.on_change(lambda *x: heard.append(x))
    monkeypatch.setenv("GRIDLOOM_FACTOR_ROWS", "17")
    assert own.get("factor_rows") == 17 and own.source("factor_rows") == "environment" and own.describe("factor_rows")["default"] == 3000
    before = own.fingerprint()
    with own.patch(factor_rows=5, local_rows="9"):
        assert own.snapshot()["factor_rows"] == 5 and own.get("local_rows") == 9 and own.fingerprint() != before
    assert own.fingerprint() == before and heard == [("factor_rows", 17, 5), ("local_rows", 200_000, 9), ("factor_rows", 5, 17), ("local_rows", 9, 200_000)]
    off()
    own.define(Option("quick", True, "a test's option", startup=True))
    own.set("quick", "off")
    own.lock()
    with pytest.raises(RuntimeError):
        own.set("quick", True)
    for name, bad in (("quick", "maybe"), ("factor_rows", -1), ("factor_rows", 2.5), ("factor_rows", True)):
        own.unlock()
        with pytest.raises(ValueError):
            own.set(name, bad)
    assert len(heard) == 4 and own.to_environment()["GRIDLOOM_FACTOR_ROWS"] == "17"


def test_capabilities():
    c = g.capabilities
    assert c.CPU and not c.metal and c.status("CUDA") == "not_built" and "CPU" in c.reason("rocm") and c["extension"] and "cpu='available'" in repr(c)
    for bad in ("abacus", None):
        with pytest.raises(ValueError):
            g.has_capability(bad)


def test_random_options(spark):
    a = g.random_array(spark, (30, 40), density=0.1, dtype="float16", rng=3)
    v = np.array([r.v for r in a.df.collect()])
    assert a.dtype == "float16" and (v == v.astype(np.float16)).all() and len(set(v)) > 60
    assert sorted(a.df.collect()) == sorted(g.random_array(spark, (30, 40), density=0.1, dtype="float16", random_state=3).df.collect())
    z = g.random_array(spark, (30, 40), density=0.1, dtype="complex64", rng=3).todense().collect()
    assert (z.real != z.imag).sum() == 120
    for wrong, error in (({"rng": 1, "random_state": 1}, ValueError), ({"rng": np.random.default_rng(1)}, TypeError), ({"dtype": "int8"}, TypeError), ({"index_dtype": "int8"}, TypeError), ({"density": 1.5}, ValueError)):
        with pytest.raises(error):
            g.random_array(spark, (3, 4), **wrong)
    with pytest.raises(OverflowError):
        g.random_array(spark, (2**32, 4), density=0.0, index_dtype="int32")
    with pytest.raises(TypeError):
        g.random_array(spark, (3.0, 4))


def test_products_of_heavy_indices(spark, monkeypatch):
    from gridloom.operators import matrix as M

    rng = np.random.default_rng(8)
    a, b = sparse(rng, 30, 20), sparse(rng, 20, 25)
    a[:, 3], b[3, :] = rng.standard_normal(30), rng.standard_normal(25)
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(M, "TASK_PRODUCTS", 50)
    x, y = g.fromdense(spark, a), g.fromdense(spark, b)
    assert np.allclose(x.matmat(y).todense().collect(), a @ b) and np.allclose(x.gram().todense().collect(), a @ a.T)
    # complex cells are joined, with heavy indices split
    x, y = g.fromdense(spark, a + 1j * a), g.fromdense(spark, b - 2j * b)
    plan = x.matmat(y).df._jdf.queryExecution().toString()
    assert "xxhash64" in plan and np.allclose(x.matmat(y).todense().collect(), (a + 1j * a) @ (b - 2j * b))



def test_triangular_levels_solve(spark):
    rng = np.random.default_rng(12)
    low = np.tril(sparse(rng, 25, 25), -1) + np.diag(rng.uniform(1, 2, 25))
    b = rng.standard_normal(25)
    for m, lower in ((low, True), (low.T, False)):
        a = g.fromdense(spark, m)
        assert np.allclose(L.spsolve_triangular(a, b, lower=lower, distributed=True).collect(), np.linalg.solve(m, b))
        done = L.analyze_triangular(a, lower=lower)
        assert np.allclose(L.spsolve_triangular(a, b, lower=lower, analyzed=done).collect(), np.linalg.solve(m, b))
        with pytest.raises(ValueError):
            L.spsolve_triangular(a, b, lower=not lower, analyzed=done)
    unit = np.tril(low, -1) + np.eye(25)
    assert np.allclose(L.spsolve_triangular(g.fromdense(spark, np.tril(low, -1)), b, unit_diagonal=True, distributed=True).collect(), np.linalg.solve(unit, b))
    with pytest.raises(RuntimeError):
        L.spsolve_triangular(g.fromdense(spark, np.tril(low, -1)), b, distributed=True)


def test_minres_and_bounds(spark):
    rng = np.random.default_rng(15)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    m = q @ np.diag(np.concatenate([rng.uniform(1, 9, 15), -rng.uniform(1, 9, 15)])) @ q.T
    a, b = g.fromdense(spark, (m + m.T) / 2), rng.standard_normal(30)
    for M in (None, P.diagonal(spark, np.arange(1.0, 31.0))):
        x, info = L.minres(a, b, rtol=1e-9, M=M, return_info=True)
        assert info.converged and np.allclose(m @ x.collect(), b, atol=1e-6)
    x, info = L.minres(a, b, shift=0.5, rtol=1e-9, return_info=True)
    assert info.converged and np.allclose((m - 0.5 * np.eye(30)) @ x.collect(), b, atol=1e-6)
    bad = P.diagonal(spark, -np.ones(30))
    assert L.minres(a, b, M=bad, return_info=True)[1].status < 0
    p = q @ np.diag(rng.uniform(0.5, 20, 30)) @ q.T
    c = P.chebyshev(g.fromdense(spark, (p + p.T) / 2))
    assert 0 < c.lo < c.hi and c.hi > np.linalg.eigvalsh(p)[-1] - 1e-6


def test_reused_analyses_and_short_lanczos(spark):
    rng = np.random.default_rng(16)
    m = sparse(rng, 12, 12) + 9 * np.eye(12)
    a = g.fromdense(spark, m)
    one = P.ilu0(a)
    two = P.ilu0(a._like(a.df.withColumn("v", F.col("v") * 2)), reuse_analysis=one)
    x = rng.standard_normal(12)
    assert np.allclose(two.solve(x) * 2, one.solve(x)) and two.lower[3][0] is one.lower[3][0]
    with pytest.raises(ValueError):
        P.ilu0(g.fromdense(spark, np.eye(12)), reuse_analysis=one)
    s = g.fromdense(spark, m + m.T)
    full, short = L.lanczos(s, 6, return_basis=False), L.lanczos(s, 6, reorthogonalize=False, return_basis=False)
    assert np.allclose(full[0], short[0]) and np.allclose(full[1], short[1])


def test_derivatives_of_constructors(spark):
    rng = np.random.default_rng(21)
    a, b = (sparse(rng, 4, 3), sparse(rng, 3, 5))
    x, y = g.fromdense(spark, a), g.fromdense(spark, b)
    dense_of = lambda m: m.todense().collect()
    cot = rng.standard_normal((12, 15))
    a_bar, b_bar = D.kron_vjp(x, y, g.fromdense(spark, cot))
    blocks = cot.reshape(4, 3, 3, 5)
    assert np.allclose(dense_of(a_bar), np.einsum("ikjl,kl->ij", blocks, b) * (a != 0)) and np.allclose(dense_of(b_bar), np.einsum("ikjl,ij->kl", blocks, a) * (b != 0))
    assert np.allclose(dense_of(D.kron_jvp(x, 2 * x, y, y)), 3 * np.kron(a, b))
    cot = rng.standard_normal((7, 8))
    first, second = D.block_diag_vjp([x, y], g.fromdense(spark, cot))
    assert np.allclose(dense_of(first), cot[:4, :3] * (a != 0)) and np.allclose(dense_of(second), cot[4:, 3:] * (b != 0))
    grid = D.block_array_vjp([[x, None], [None, y]], g.fromdense(spark, cot))
    assert np.allclose(dense_of(grid[1][1]), dense_of(second)) and grid[0][1] is None
    assert np.allclose(dense_of(D.hstack_vjp([x, x], g.fromdense(spark, cot[:4, :6]))[1]), cot[:4, 3:6] * (a != 0))
    assert np.allclose(dense_of(D.vstack_vjp([x, x], g.fromdense(spark, np.vstack([cot[:4, :3], cot[:4, 4:7]])))[1]), cot[:4, 4:7] * (a != 0))
    down, up = D.diags_vjp([-1, 2], [6, 5], g.fromdense(spark, cot[:7, :7]))
    assert np.allclose(down.collect(), np.diagonal(cot[:7, :7], -1)) and np.allclose(up.collect(), np.diagonal(cot[:7, :7], 2))


def test_batched_derivatives_and_mapped_axes(spark):
    rng = np.random.default_rng(22)
    m = sparse(rng, 5, 4)
    a, a_dot = g.fromdense(spark, m), 3 * g.fromdense(spark, m)
    x, y_bar = rng.standard_normal((2, 4, 3)), rng.standard_normal((2, 5, 3))
    X, Y = g.dense(spark, x), g.dense(spark, y_bar)
    assert np.allclose(D.batched_data_vjp(a, X, Y).todense().collect(), np.einsum("bik,bjk->ij", y_bar, x) * (m != 0))
    assert np.allclose(D.rhs_vjp(a, Y).collect(), np.einsum("ij,bik->bjk", m, y_bar))
    assert np.allclose(D.batched_jvp(a, a_dot, X, X).collect(), 4 * m @ x) and np.allclose(D.product_jvp(a, None, X, X).collect(), m @ x)
    v, w = rng.standard_normal((2, 4)), rng.standard_normal((2, 5))
    assert np.allclose(D.batched_data_vjp(a, g.dense(spark, v, True), g.dense(spark, w, True)).todense().collect(), np.einsum("bi,bj->ij", w, v) * (m != 0))
    assert np.allclose(D.transpose_jvp(a, a_dot, g.dense(spark, w[0]), g.dense(spark, w[0])).collect(), 4 * m.T @ w[0]) and np.allclose(D.transpose_rhs_vjp(a, g.dense(spark, v[0])).collect(), m @ v[0])
    z = rng.standard_normal((4, 6))
    assert np.allclose(D.vmap(a.matvec, in_axis=1, out_axis=1)(z), m @ z) and np.allclose(D.vmap(a.matvec, in_axis=1)(z), (m @ z).T)
    u = rng.standard_normal((4, 3, 2))
    assert np.allclose(D.vmap(a.matmul, in_axis=2, out_axis=1)(u), np.einsum("ij,jkb->ibk", m, u)) and np.allclose(D.vmap(a.matmul)(X).collect(), m @ x)
    with pytest.raises(TypeError):
        D.vmap(lambda q: q)


@pytest.mark.parametrize("solver", ["cg", "bicgstab", "gmres", "minres"])
def test_distributed_steps_keep_what_they_need(spark, solver):
    """Vectors that a step replaces are deleted; the others, and the right-hand side, are still read."""
    m = np.diag([4.0, 3.0, 5.0]) + np.diag([1.0, 0.5], 1) + np.diag([1.0, 0.5], -1)
    a = g.fromdense(spark, m)
    b = a.matvec(np.array([1.0, 2.0, 3.0])).df
    b = g.vector(b, 3)
    for M in (None, P.jacobi(a)):
        x, info = getattr(L, solver)(a, b, rtol=1e-8, M=M, distributed=True, return_info=True)
        assert info.converged and np.allclose(x.collect(), [1, 2, 3], atol=1e-5)


def test_places_of_random_cells_are_counted_without_a_shuffle(spark):
    from gridloom.sources.random import numbers, permuted, random_array, runs

    for n in (1, 2, 37, 1000):
        assert (numbers(permuted(np.arange(n), n, 11), n, 11) == np.arange(n)).all()
    a = random_array(spark, (70, 90), density=0.5, rng=11)
    got = runs(a, 11).toPandas().sort_values("first")
    assert len(got) <= spark.sparkContext.defaultParallelism and (got["first"].to_numpy()[1:] > got["last"].to_numpy()[:-1]).all()
    assert got.n.sum() == got.distinct.sum() == 3150 and got.i.max() < 70 and got.least.min() >= 0
    assert "Exchange" not in runs(a, 11)._jdf.queryExecution().executedPlan().toString()
    twice = runs(a._like(a.df.union(a.df).repartition(2)), 11).toPandas()  # each place twice: runs overlap
    assert len(twice) == 2 and twice.n.sum() == 6300 and twice["first"].max() < twice["last"].min()
