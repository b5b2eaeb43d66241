"""Products on a grid of tiles, the sizes that choose the grid, and the order of chains."""

import numpy as np
import pytest

import gridloom as g
from gridloom.operators import matrix as M
from gridloom.operators import products as T
from gridloom.plans import expression, sizes
from gridloom.sources.construct import from_dense


def sparse_array(rng, m, n, share):
    return np.where(rng.random((m, n)) < share, rng.integers(-3, 4, (m, n)) * 1.0, 0.0)


def cells_of(a):
    i, j = np.nonzero(a)
    return i, j, a[i, j]


@pytest.mark.parametrize("dense", [1 << 22, 1])
@pytest.mark.parametrize("at_once", [1 << 21, 7])
def test_a_tile(monkeypatch, dense, at_once):
    monkeypatch.setattr(T, "DENSE", dense)
    monkeypatch.setattr(T, "AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    for shape in ((9, 7, 8), (1, 30, 1), (20, 3, 20)):
        a, b = sparse_array(rng, *shape[:2], 0.4), sparse_array(rng, *shape[1:], 0.4)
        (ai, am, av), (bm, bj, bv) = cells_of(a), cells_of(b)
        out = np.zeros((shape[0], shape[2]))
        i, j, v = T.multiplied(ai + 100, am, av, bj + 200, bm, bv)
        np.add.at(out, (i - 100, j - 200), v)
        assert (out == a @ b).all() and len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i)
    none = np.zeros(0, np.int64)
    assert all(len(x) == 0 for x in T.multiplied(none, none, none * 1.0, none, none, none * 1.0))


@pytest.mark.parametrize("grid", [T.Grid(), T.Grid(3, 1, 1), T.Grid(1, 4, 1), T.Grid(2, 3, 1), T.Grid(1, 1, 5), T.Grid(2, 2, 2)])
def test_grids_give_one_product(spark, grid):
    rng = np.random.default_rng(2)
    a, b = sparse_array(rng, 30, 25, 0.3), sparse_array(rng, 25, 40, 0.3)
    a[:, 4], b[4, :], a[7, :] = 1, 2, 3  # an index, and a row, with all cells
    out = T.tiled(from_dense(spark, a).df, from_dense(spark, b).df, grid).toPandas()
    assert not out.duplicated(["i", "j"]).any() and (out.v != 0).all()
    got = np.zeros((30, 40))
    got[out.i, out.j] = out.v
    assert np.allclose(got, a @ b)


def test_what_is_shuffled_is_bounded_by_the_grid(spark):
    """Cells of A go out once for each strip of B; what comes back of several slabs is at most a cell for each slab."""
    rng = np.random.default_rng(3)
    a = sparse_array(rng, 40, 60, 0.5)
    left, right = from_dense(spark, a).df, from_dense(spark, a.T).df
    grid = T.Grid(3, 4, 2)
    sent = [df.mapInArrow(T._dealt(side, grid), "side int, strip int, slab int, at binary, m binary, v binary").selectExpr("sum(length(at)) / 8 AS n", "count(distinct strip) AS strips").first() for side, df in ((0, left), (1, right.selectExpr("j", "i", "v")))]
    assert [s.n for s in sent] == [np.count_nonzero(a)] * 2 and [s.strips for s in sent] == [3, 4]


@pytest.mark.parametrize("r", [T.Route(1, 1, 1), T.Route(3, 4, 2), T.Route(3, 4, 5, 30, 40), T.Route(7, 2, 1, 30, 0)])
def test_routes_give_one_product(spark, monkeypatch, r):
    monkeypatch.setattr(T, "AT_ONCE", 50)
    rng = np.random.default_rng(2)
    a, b = sparse_array(rng, 30, 25, 0.3), sparse_array(rng, 25, 40, 0.3)
    a[:, 4], b[4, :], a[7, :], a[:, 9] = 1, 2, 3, 0
    out = T.routed(from_dense(spark, a).df, from_dense(spark, b).df, r, 3).toPandas()
    assert not out.duplicated(["i", "j"]).any() and (out.v != 0).all()
    got = np.zeros((30, 40))
    got[out.i, out.j] = out.v
    assert np.allclose(got, a @ b)


def test_cells_of_blocks_go_to_few_tiles(spark, monkeypatch):
    """Of a matrix of 12 blocks on the diagonal, a grid sends each cell to all strips of the other side; the route to about one."""
    rng = np.random.default_rng(6)
    a = np.kron(np.eye(12), np.ones((5, 6))) * rng.integers(1, 9, (60, 72))
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(T, "CELLS", 60)
    monkeypatch.setattr(T, "PRODUCTS", 200)
    monkeypatch.setattr(T, "tiled", None)
    m = from_dense(spark, a).canonicalize().persist()
    facts = sizes.facts(m.df, m.T.df, 60, 60)
    assert facts.longest_inner == 10 and facts.a == 360
    r, sent = T.route(m.df, m.T.df, facts, 4)
    assert r.rows == r.cols == 12 and (r.n_rows, r.n_cols) == (60, 60) and sent == 720
    monkeypatch.setattr(M, "SENT", 2)
    assert np.allclose((m @ m.T).todense().collect(), a @ a.T)
    one = a * 0
    one[3] = 1  # all cells in one row: no ranges
    m = from_dense(spark, one).prune().canonicalize().persist()
    assert T.route(m.df, m.T.df, sizes.facts(m.df, m.T.df, 60, 60), 4)[0].n_cols == 0


def test_grid_follows_sizes():
    facts = lambda **x: sizes.Facts(**({"a": 10**7, "b": 10**7, "products": 10**9, "longest_row": 100, "longest_col": 100, "rows": 10**6, "cols": 10**6} | x))
    even = T.grid(facts(), 8)
    assert even.rows * even.cols >= 50 and abs(even.rows - even.cols) <= 2 and even.slabs == 1
    wide = T.grid(facts(b=10**5), 8)
    assert wide.rows < wide.cols or 10**7 / wide.rows + 10**5 / wide.cols <= T.CELLS
    assert T.grid(facts(products=10, a=10, b=10), 8) == T.Grid(1, 1, 1)
    assert T.grid(facts(longest_row=10 * T.CELLS), 8).slabs == 10
    # a small result is summed from slabs, a large one made in strips
    small, large = T.grid(facts(), 8, cells=10**4), T.grid(facts(), 8, cells=10**9)
    assert small.slabs > 1 and small.rows == small.cols == 1 and large == even


def test_large_products_are_tiled(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a, b = sparse_array(rng, 50, 40, 0.3), sparse_array(rng, 40, 30, 0.3)
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    for products, cells, sent in ((20, 50, 1), (200, 400, 1), (200, 400, 100)):
        monkeypatch.setattr(T, "PRODUCTS", products)
        monkeypatch.setattr(T, "CELLS", cells)
        monkeypatch.setattr(M, "SENT", sent)
        p = from_dense(spark, a) @ from_dense(spark, b)
        assert p.canonical and np.allclose(p.todense().collect(), a @ b)


def test_sizes(spark):
    rng = np.random.default_rng(5)
    a, b = sparse_array(rng, 60, 50, 0.1), sparse_array(rng, 50, 80, 0.1)
    x, y = from_dense(spark, a).df, from_dense(spark, b).df
    f = sizes.facts(x, y, 60, 80)
    p = (a != 0).astype(int) @ (b != 0).astype(int)
    assert (f.a, f.b, f.products) == (np.count_nonzero(a), np.count_nonzero(b), p.sum())
    assert f.longest_row == (a != 0).sum(1).max() and f.longest_col == (b != 0).sum(0).max()
    assert abs(sizes.product_cells(x, y) / np.count_nonzero(p) - 1) < 0.2
    n = dict(sizes.row_cells(sizes.sketched(y)).collect())
    assert abs(sum(n.values()) / np.count_nonzero(b) - 1) < 0.2
    none = from_dense(spark, np.zeros((3, 3))).df.filter("v != 0")
    assert sizes.product_cells(none, none) == 0 and sizes.facts(none, none, 3, 3).products == 0


def test_chain_order_sees_skew(spark, monkeypatch):
    """By numbers of cells alone A B seems cheap; but A's cells are in the column that is B's full row."""
    n = 40
    a, b, c = np.zeros((n, n)), np.zeros((n, n)), np.ones((n, 3))
    a[:, 0], b[0, :] = 1, 1
    chain = g.lazy(from_dense(spark, a)) @ from_dense(spark, b) @ from_dense(spark, c)
    monkeypatch.setattr(expression, "PRODUCTS", 0)
    assert chain.order() == (0, (1, 2)) and chain._counted()[0, 0, 1] == n * n
    assert (chain.evaluate().todense().collect() == a @ b @ c).all()
    assert (g.lazy(from_dense(spark, a)) @ from_dense(spark, b)).order() == (0, 1)


@pytest.mark.parametrize("x", [[], [5], [-3, 2**40], [-(2**63), 2**63 - 1], [2**62, -(2**62) - 1], [0.1, 2.0], [0.5, -0.25], [1e300, 1.0], [np.nan, np.inf], [-(2.0**53), 2.0**52], [-7.0, 300.0]])
def test_narrow_values_come_back(x):
    x = np.array(x, float if any(isinstance(y, float) for y in x) else np.int64)
    out = T.widened(T.narrow(x), x.dtype.type)
    assert out.dtype == x.dtype and np.array_equal(out, x, equal_nan=x.dtype == float)


def test_routed_cells_are_few_bytes():
    """Of far indices and small whole values, a cell that goes to a tile takes some bytes, not three numbers of eight."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    at, m = np.divmod(rng.choice(900 * 400, 40_000, replace=False), 400)
    at, m, v = at + 5_000_000, m * 37 + 9_000_000, rng.integers(1, 51, len(at)) * 1.0
    cells = pa.RecordBatch.from_arrays([pa.array(x) for x in (at, m, v)], names=["at", "m", "v"])
    r = T.Route(3, 3, 1)
    met = [b for side in (0, 1) for b in T._met(side, r.slabs)(iter([cells]))]
    sent = list(T._sent(r)(iter(met)))
    size = sum(len(x) for b in sent for name in ("at", "m", "v") for x in b.column(name).to_pylist())
    assert size < 2 * 3 * len(at) * 8
    by_tile = sorted((b for b in sent), key=lambda b: b.column("tile")[0].as_py())
    got = np.zeros((900, 900))
    for b in T._tiles(iter(by_tile), sent=True):
        i, j, x = (c.to_numpy() for c in b.columns)
        got[i - 5_000_000, j - 5_000_000] += x
    a = np.zeros((900, 400))
    a[at - 5_000_000, (m - 9_000_000) // 37] = v
    assert (got == a @ a.T).all()


def shuffled(spark):
    every = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(every.apply(k).totalShuffleWrite() for k in range(every.size()))


@pytest.mark.parametrize("cells,sent", [(1 << 21, 6), (90, 100), (90, 1)])
def test_a_gram_matrix_of_duplicates_and_odd_rows(spark, monkeypatch, cells, sent):
    """One tile, many of them, and sums of records; duplicates, rows and columns with all cells, empty ones, and exact zeros."""
    monkeypatch.setattr(T, "CELLS", cells)
    monkeypatch.setattr(T, "RECORD", 16)
    monkeypatch.setattr(M, "SENT", sent)
    a = sparse_array(np.random.default_rng(8), 45, 30, 0.2)
    a[:, 4], a[7, :20], a[9], a[11] = 1, 2, 0, 0
    a[9, 4], a[11, 4], a[9, 28], a[11, 29] = 1, 1, 0, 0
    df = from_dense(spark, a).df
    twice = g.coo_array(df.selectExpr("i", "j", "v / 4 AS v").union(df.selectExpr("i", "j", "v * 3 / 4 AS v")), a.shape)
    for out in (twice.gram().df, twice.gram(written=True).df, (twice @ twice.T).df, (twice.tocsc() @ twice.tocsc().T).df):
        out = out.toPandas()
        assert not out.duplicated(["i", "j"]).any() and (out.v != 0).all()
        got = np.zeros((45, 45))
        got[out.i, out.j] = out.v
        assert np.allclose(got, a @ a.T)
    back = (twice.T @ twice).todense().collect()
    assert np.allclose(back, a.T @ a)


def test_a_gram_matrix_of_blocks_sends_cells_once(spark):
    """A's cells are shuffled once to be summed and about once to tiles, in few bytes."""
    df = spark.range(500 * 600).selectExpr("id div 600 * 20 + id % 20 AS i", "id div 600 * 40 + id % 600 div 15 AS j", "cast(id % 50 + 1 AS double) AS v")
    a = g.coo_array(df, (10_000, 20_000))
    before = shuffled(spark)
    out = a.gram(written=True)
    assert shuffled(spark) - before < 10 * 500 * 600
    assert out.df.selectExpr("sum(v)").first()[0] == df.groupBy("j").sum("v").selectExpr("sum(`sum(v)` * `sum(v)`)").first()[0]


def test_a_column_with_very_many_cells_is_not_one_tasks(spark, monkeypatch):
    monkeypatch.setattr(T, "CELLS", 20)
    a = np.ones((60, 2))
    assert T.recorded(from_dense(spark, a).df) is None
    assert np.allclose(from_dense(spark, a).gram().todense().collect(), a @ a.T)
