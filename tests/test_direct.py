"""Distributed factorisations against numpy, with the matrix's cells never on one machine."""

import numpy as np
import pytest

from gridloom import linalg as L
from gridloom.config import config_context
from gridloom.linalg import tsqr
from gridloom.operators.dense import dense
from gridloom.operators.matrix import SparseMatrix
from gridloom.plans.lineage import cut
from gridloom.sources.construct import from_dense


def sparse_array(rng, m, n, share=0.4):
    return np.where(rng.random((m, n)) < share, rng.standard_normal((m, n)), 0.0)


# --- QR


@pytest.mark.parametrize("m,n,values", [(40, 6, 1 << 21), (300, 7, 60), (9, 9, 20), (50, 1, 7)])
def test_triangle_is_that_of_the_gram_matrix(spark, m, n, values):
    a = sparse_array(np.random.default_rng(m), m, n) + np.eye(m, n)
    r = tsqr.triangle(from_dense(spark, a).df, n, fan=2, block_values=values)
    assert np.allclose(r, np.triu(r)) and (np.diag(r) >= 0).all()
    assert np.allclose(r.T @ r, a.T @ a)


def test_factorized_tall_and_wide(spark):
    rng = np.random.default_rng(1)
    for shape in ((80, 5), (5, 80), (12, 12)):
        a, b = sparse_array(rng, *shape, 0.6) + np.eye(*shape), rng.standard_normal(shape[0])
        want = np.linalg.lstsq(a, b, rcond=None)[0]
        with config_context(factor_rows=4, local_rows=4, local_cells=4):  # the cells fit no machine
            for method in ("qr", "cholesky_ata"):
                f = L.factorized(from_dense(spark, a), method=method)
                assert f.distributed and np.allclose(f.solve(b).collect(), want)
                assert np.allclose(f(dense(spark, 2 * b)).collect(), 2 * want)


def test_correction_keeps_digits(spark):
    """Columns of very different size: the normal equations alone would lose them."""
    rng = np.random.default_rng(2)
    a = rng.standard_normal((200, 5)) * 10.0 ** np.array([0, -2, 3, 4, -3])
    x = np.arange(1.0, 6.0)
    got = L.factorized(from_dense(spark, a), method="qr", distributed=True).solve(a @ x).collect()
    assert np.allclose(got, x, rtol=1e-9)


def test_orthogonal_factor(spark):
    a = sparse_array(np.random.default_rng(3), 60, 4) + np.eye(60, 4)
    f = L.TallQR(from_dense(spark, a))
    q = f.Q.collect()
    assert np.allclose(q.T @ q, np.eye(4)) and np.allclose(q @ f.R, a)


def test_least_squares_in_one_pass(spark):
    rng = np.random.default_rng(4)
    a, b = sparse_array(rng, 90, 6) + np.eye(90, 6), rng.standard_normal((90, 2))
    x, norms = L.least_squares(from_dense(spark, a), dense(spark, b))
    assert np.allclose(x, np.linalg.lstsq(a, b, rcond=None)[0]) and np.allclose(norms, np.linalg.norm(a @ x - b, axis=0))
    one, norm = L.least_squares(from_dense(spark, a), dense(spark, b[:, 0]))
    assert np.allclose(one, x[:, 0]) and np.isclose(norm, norms[0])


def test_refusals(spark):
    a = np.ones((6, 2))
    with pytest.raises(RuntimeError, match="column 1"):
        L.factorized(from_dense(spark, a), method="qr", distributed=True)
    with pytest.raises(RuntimeError):
        L.factorized(from_dense(spark, a * 3), method="cholesky_ata", distributed=True)
    with config_context(panel_columns=1), pytest.raises(ValueError, match="panel_columns"):
        L.factorized(from_dense(spark, a), method="qr", distributed=True)
    with pytest.raises(ValueError, match="rows"):
        L.TallQR(from_dense(spark, a.T))
    with pytest.raises(ValueError, match="rows"):
        L.least_squares(from_dense(spark, a), np.ones(3))
    with pytest.raises(RuntimeError):
        L.TallQR(from_dense(spark, np.zeros((4, 2))))


# --- triangles by blocks


def triangle_of(rng, n, share, band=None):
    a = np.tril(sparse_array(rng, n, n, share))
    if band:
        a = np.triu(a, -band)
    np.fill_diagonal(a, 1 + rng.random(n))
    return a


@pytest.mark.parametrize("n,share,band,block", [(50, 0.2, None, 12), (30, 0.9, 1, 8), (23, 0.5, 3, 100)])
@pytest.mark.parametrize("lower", [True, False])
def test_blocks_solve_triangles(spark, n, share, band, block, lower):
    rng = np.random.default_rng(n)
    a = triangle_of(rng, n, share, band)
    a = a if lower else a.T
    b = rng.standard_normal(n)
    solver = L.BlockTriangular(from_dense(spark, a), lower=lower, block=block)
    assert np.allclose(solver.solve(b).collect(), np.linalg.solve(a, b))
    solver.release()
    unit = a - np.diag(np.diag(a)) + np.eye(n)
    assert np.allclose(L.BlockTriangular(from_dense(spark, a), lower=lower, unit_diagonal=True, block=block).solve(b).collect(), np.linalg.solve(unit, b))


def test_levels_of_blocks(spark):
    a = np.eye(24)
    a[8:12, 0:4] = a[16:20, 8:12] = a[20:24, 4:8] = 0.5
    solver = L.BlockTriangular(from_dense(spark, a), block=4)
    assert solver.level.tolist() == [0, 0, 1, 0, 2, 1] and solver.needs == [set(), {0}, {1}]


def test_a_long_chain_takes_as_many_rounds_as_blocks(spark):
    n = 20_000
    i = spark.range(n).selectExpr("id AS i")
    cells = i.selectExpr("i", "i AS j", "2.0D AS v").union(i.filter("i > 0").selectExpr("i", "i - 1 AS j", "-1.0D AS v"))
    from gridloom.sources.construct import coo_array

    solver = L.BlockTriangular(coo_array(cells, (n, n)), block=5_000)
    assert solver.rounds == 4
    x = solver.solve(dense(spark, np.ones(n))).df.selectExpr("min(x) AS low", "max(x) AS high", "count(*) AS n").first()
    assert x.low == 0.5 and x.high == 1.0 and x.n == n


def test_triangular_refusals_and_analysis(spark):
    a = np.array([[1.0, 0.0], [1.0, 2.0]])
    with pytest.raises(ValueError, match="other side"):
        L.spsolve_triangular(from_dense(spark, a.T), np.ones(2), distributed=True)
    with pytest.raises(RuntimeError, match="diagonal"):
        L.spsolve_triangular(from_dense(spark, np.array([[0.0, 0.0], [1.0, 2.0]])), np.ones(2), distributed=True)
    with pytest.raises(ValueError, match="square"):
        L.BlockTriangular(from_dense(spark, np.ones((2, 3))))
    known = L.analyze_triangular(from_dense(spark, a), distributed=True)
    assert np.allclose(L.spsolve_triangular(from_dense(spark, a), np.array([1.0, 3.0]), analyzed=known).collect(), [1, 1])
    with pytest.raises(ValueError, match="diagonal"):
        L.spsolve_triangular(from_dense(spark, a), np.ones(2), analyzed=known, unit_diagonal=True)
    with pytest.raises(ValueError, match="vector of 2"):
        known.solve(np.ones(3))


# --- incomplete factors by sweeps


def plain_ilu0(a):
    a, pattern = a.copy(), a != 0
    n = len(a)
    for i in range(1, n):
        for k in np.flatnonzero(pattern[i, :i]):
            a[i, k] /= a[k, k]
            cols = np.flatnonzero(pattern[i, k + 1 :]) + k + 1
            a[i, cols] -= a[i, k] * a[k, cols]
    return np.tril(a, -1) + np.eye(n), np.triu(a)


def heavy(rng, n, share, symmetric=False):
    a = sparse_array(rng, n, n, share)
    a = a + a.T if symmetric else a
    np.fill_diagonal(a, 0)
    return a + np.diag((abs(a).sum(1) + 1) * (1 if symmetric else np.where(np.arange(n) % 3, 1, -1)))


def test_sweeps_give_incomplete_lu(spark):
    a = heavy(np.random.default_rng(7), 40, 0.15) * 1000
    found = L.preconditioners.ilu0(from_dense(spark, a), distributed=True)
    low, up = plain_ilu0(a)
    assert np.allclose(found.L.todense().collect(), low) and np.allclose(found.U.todense().collect(), up)
    r = np.arange(40.0)
    want = np.linalg.solve(up, np.linalg.solve(low, r))
    assert np.allclose(found.solve(dense(spark, r)).collect(), want) and np.allclose(found.solve(r), want)
    assert found.setup_info["sweeps"] < 40 and found.setup_info["change"] <= 1e-9


def test_sweeps_give_incomplete_cholesky(spark):
    a = heavy(np.random.default_rng(8), 30, 0.2, symmetric=True)
    found = L.preconditioners.ichol0(from_dense(spark, a), distributed=True)
    local = L.preconditioners.ichol0(from_dense(spark, a), distributed=False)
    r = np.arange(30.0)
    assert np.allclose(found.solve(r), local.solve(r))
    with pytest.raises(ValueError, match="symmetric"):
        L.preconditioners.ichol0(from_dense(spark, a + np.triu(a, 1)), distributed=True)
    with pytest.raises(RuntimeError, match="positive"):
        L.preconditioners.ichol0(from_dense(spark, -a), distributed=True)


@pytest.mark.parametrize("sent", [1e9, 0])
def test_sweeps_over_tiles_and_by_products(spark, monkeypatch, sent):
    """Several tiles, dense and sparse ones; a table of all products, cubic in a dense block, is not made on either way."""
    from gridloom.linalg import incomplete

    monkeypatch.setattr(incomplete, "SENT", sent)
    monkeypatch.setattr(incomplete.SparseMatrix, "_split_join", None)
    monkeypatch.setattr(incomplete._Tiles.__init__, "__defaults__", (8,))
    a = heavy(np.random.default_rng(11), 30, 0.2)
    a[:12, :12] += np.random.default_rng(12).random((12, 12))
    a += np.diag(np.sign(np.diag(a)) * abs(a).sum(1))
    found = incomplete.Incomplete(from_dense(spark, a))
    low, up = plain_ilu0(a)
    assert np.allclose(found.L.todense().collect(), low) and np.allclose(found.U.todense().collect(), up)


def test_sweeps_that_do_not_settle(spark):
    light = np.array([[1.0, 5, 5], [5, 1, 5], [5, 5, 1]])
    full = L.preconditioners.ilu0(from_dense(spark, light), distributed=True)  # three rows are exact after a few sweeps
    assert np.allclose(full.L.todense().collect() @ full.U.todense().collect(), light)
    with pytest.raises(RuntimeError, match="sweeps"):
        from gridloom.linalg.incomplete import Incomplete

        Incomplete(from_dense(spark, heavy(np.random.default_rng(1), 20, 0.5)), sweeps=1)
    with pytest.raises(ValueError, match="diagonal"):
        L.preconditioners.ilu0(from_dense(spark, np.array([[0.0, 1], [1, 0]])), distributed=True)


def test_solvers_with_sweeps_as_frames_only(spark):
    """Conjugate gradients; the queries run the other solvers."""
    rng = np.random.default_rng(9)
    s, x = heavy(rng, 30, 0.1, symmetric=True), rng.standard_normal(30)
    with config_context(local_rows=4, local_cells=4):
        m = from_dense(spark, s)
        got, info = L.cg(m, dense(spark, s @ x), rtol=1e-7, M=L.preconditioners.ichol0(m), return_info=True)
        assert info.converged and np.allclose(got.collect(), x)


# --- factors by fronts


def arrow_of_bands(n, symmetric=True):
    """Bands, far cells and a heavy last row: chains, leaves and a root in the tree of blocks."""
    rng = np.random.default_rng(n)
    a = np.zeros((n, n))
    for k in (1, 2):
        a += np.diag(rng.standard_normal(n - k), -k)
    a[n - 1, : n - 1] = rng.standard_normal(n - 1) * (rng.random(n - 1) < 0.4)
    a[n // 2, 0] = a[n // 3, 1] = 1.0
    a = a + a.T if symmetric else a + np.triu(rng.standard_normal((n, n)) * (rng.random((n, n)) < 0.05), 1)
    return a + np.diag(abs(a).sum(0) + abs(a).sum(1) + 1)


@pytest.mark.parametrize("n,block", [(30, 4), (41, 7), (12, 50)])
def test_fronts_give_cholesky(spark, n, block):
    a = arrow_of_bands(n)
    f = L.FrontalCholesky(from_dense(spark, np.tril(a)), block=block)
    assert np.allclose(f.L.todense().collect(), np.linalg.cholesky(a))
    b = np.arange(float(n))
    assert np.allclose(f.solve(b).collect(), np.linalg.solve(a, b))


@pytest.mark.parametrize("n,block", [(30, 4), (25, 9)])
def test_fronts_give_lu(spark, n, block):
    a = arrow_of_bands(n, symmetric=False)
    a[0:4:2] = a[[1, 0, 3, 2]][0:4:2] * 1.0 + a[0:4:2] * 1e-3  # inside a block the rows must change places
    f = L.FrontalLU(from_dense(spark, a), block=block)
    low, up, perm = f.L.todense().collect(), f.U.todense().collect(), f.perm
    assert np.allclose(low, np.tril(low)) and np.allclose(np.diag(low), 1) and np.allclose(up, np.triu(up))
    assert sorted(perm.tolist()) == list(range(n)) and np.allclose(low @ up, a[perm])
    b = np.arange(float(n))
    assert np.allclose(f.solve(b).collect(), np.linalg.solve(a, b))


def test_tree_of_blocks():
    from gridloom.linalg.multifrontal import _Tree

    # 0 and 1 are leaves of 2, 3 stands alone, 2 reaches 4 by way of 0
    tree = _Tree(5, {(0, 0), (2, 0), (4, 0), (2, 1), (3, 3), (4, 4)}, 10)
    assert tree.parent == [2, 2, 4, -1, -1] and tree.level == [0, 0, 1, 0, 2]
    assert tree.rounds == 3 and tree.tiles == 3 + 2 + 2 + 1 + 1 and tree.largest == 30


def test_fronts_beyond_one_machine(spark):
    a = arrow_of_bands(30)
    x = np.arange(30.0) - 7
    with config_context(factor_rows=4, local_rows=4, local_cells=4):
        m = from_dense(spark, a)
        assert isinstance(L.cholesky(m), L.FrontalCholesky) and isinstance(L.splu(m), L.FrontalLU)
        assert np.allclose(L.spsolve(m, dense(spark, a @ x)).collect(), x)
        assert np.allclose(L.preconditioners.exact(m, method="cholesky").solve(dense(spark, a @ x)).collect(), x)


def test_fronts_refuse(spark):
    with pytest.raises(RuntimeError, match="positive"):
        L.FrontalCholesky(from_dense(spark, np.diag([1.0, 2, -3, 4])), block=2)
    with pytest.raises(RuntimeError, match="singular"):
        L.FrontalLU(from_dense(spark, np.array([[1.0, 1, 0], [1, 1, 0], [0, 0, 1]])), block=3)
    with pytest.raises(ValueError, match="square"):
        L.FrontalLU(from_dense(spark, np.ones((2, 3))))
    with config_context(front_rows=3), pytest.raises(ValueError, match="front_rows"):
        L.FrontalCholesky(from_dense(spark, np.ones((8, 8)) + 9 * np.eye(8)), block=2)


# --- options of a block


def test_a_block_of_options_is_one_threads():
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from gridloom.config import get_config, set_config

    inside, before = Barrier(2), get_config("front_rows")

    def run(n):
        with config_context(front_rows=n):
            inside.wait(10)
            got = get_config("front_rows")
            with config_context(front_rows=n + 1):
                set_config("front_rows", n + 2)
                more = get_config("front_rows")
            inside.wait(10)
            return got, more, get_config("front_rows")

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, (10, 20))) == [(10, 12, 10), (20, 22, 20)]
    assert get_config("front_rows") == before


def test_a_tall_gram_sends_cells_once(spark, monkeypatch):
    """A.T A of few columns is summed by tasks: no sparse product, whose tiles would send each cell for every strip."""
    monkeypatch.setattr(SparseMatrix, "matmat", None)
    monkeypatch.setattr(tsqr, "FAN", 2)
    monkeypatch.setattr(tsqr, "BLOCK_VALUES", 20)
    rng = np.random.default_rng(8)
    a = sparse_array(rng, 301, 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # rows go on over batches
    try:
        assert np.allclose(tsqr.gram(from_dense(spark, a).df, 6), a.T @ a)
        assert np.allclose(tsqr.TallQR(from_dense(spark, a), normal=True).R, np.linalg.cholesky(a.T @ a).T)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_blocks_in_a_chain_are_taken_together(spark):
    """Blocks of 3 rows that each need the one before: not a round for each."""
    n = 120
    a = np.tril(np.full((n, n), 0.01)) + np.eye(n)
    solver = L.BlockTriangular(from_dense(spark, a), block=3)
    assert solver.rounds <= 16 and solver.block % 3 == 0
    assert np.allclose(solver.solve(np.arange(n)).collect(), np.linalg.solve(a, np.arange(n)))
    own = L.BlockTriangular(from_dense(spark, np.eye(n)), block=3)  # side by side, they stay as they are
    assert own.rounds == 1 and own.block == 3


def test_a_round_reads_only_what_is_sent_to_it(spark):
    """In a chain each round reads the update before it, not the tables of all rounds; and a chain is few rounds."""
    from gridloom.linalg.multifrontal import _Tree

    tree = _Tree(40, {(p, p + 1) for p in range(39)}, 10)
    assert [tree.senders(t) for t in range(40)] == [[], *([t] for t in range(39))]
    a = np.diag(np.full(1200, 4.0)) + np.diag(np.ones(1199), 1) + np.diag(np.ones(1199), -1)
    f = L.FrontalCholesky(from_dense(spark, a).prune())
    assert f.tree.rounds <= 16
    low = f.L.todense().collect()
    assert np.allclose(low @ low.T, a)


def test_blocks_of_a_tall_matrix_are_small():
    """What a task of a reduction tree holds, whatever the number of rows: an eighth of what it held."""
    for width in (1, 25, 200, 1024):
        assert 2 * width <= tsqr._rows(width) and tsqr._rows(width) * width <= max(1 << 18, 2 * width * width)


def test_fronts_are_sent_in_few_bytes():
    """A cell of the matrix in at most eight bytes, an update of a symmetric matrix as its lower triangle."""
    from gridloom.linalg import multifrontal as MF

    n = 64
    a = np.arange(n * n).reshape(n, n) % 50 + 1.0
    a = np.tril(a) + np.tril(a, -1).T + 2000 * np.eye(n)
    i, j = (x.astype(np.int64) for x in np.nonzero(np.tril(a)))
    row = MF._row(0, 0, 0, i, j, a[i, j])
    assert sum(len(x) for x in row[3:]) <= 8 * len(i) and all((MF.widened(x, float) == y).all() for x, y in zip(row[3:], (i, j, a[i, j]), strict=True))
    out = [r for b in MF._fronts(32, n, [1, -1], [0, 1], True)(iter([MF._batch([row]).select(["p", "kind", "rows", "cols", "vals"])])) for r in b.to_pylist()]
    updates = [r for r in out if r["kind"] == 1]
    assert updates and all(len(MF.widened(r["cols"], int)) == MF.widened(r["rows"], int)[-1] - 31 for r in updates)
    low = np.linalg.cholesky(a)
    got = np.zeros((n, 32))
    for r in out:
        if r["kind"] == 2:
            got[MF.widened(r["rows"], int), MF.widened(r["cols"], int)] = MF.widened(r["vals"], float)
    assert np.allclose(got, low[:, :32])


def test_a_sweep_does_not_send_a_tile_to_itself(spark):
    """A tile on the diagonal needs no other, and a dense tile's places take next to nothing."""
    from gridloom.linalg import incomplete as I

    a = np.kron(np.eye(3), np.arange(64.0).reshape(8, 8) + 300 * np.eye(8))
    a[0, 9] = a[9, 0] = 1.0
    way = I._Tiles(from_dense(spark, a).df.selectExpr("i", "j", "v AS a"), 24, size=8)
    now = way.start()
    assert {tuple(r) for r in way.sends.select("fp", "fq", "p", "q").collect() if r.fp == r.p and r.fq == r.q} == set()
    assert max(len(r.at) for r in now.select("at").collect()) <= 9 + 64
    for _ in range(12):
        now = cut(way.sweep(now))
    got = np.zeros((24, 24))
    for i, j, f in way.values(now).collect():
        got[i, j] = f
    low, up = np.tril(got, -1) + np.eye(24), np.triu(got)
    assert np.allclose(np.where(a != 0, low @ up, 0), a)
