"""Blocks of rows against numpy, and that products don't send them."""

import re

import numpy as np
import pytest

from gridloom.operators.dense import dense
from gridloom.sources.construct import from_dense
from gridloom.sources.row_blocks import RowBlocks


def sparse_array(rng, m, n, share=0.3):
    return np.where(rng.random((m, n)) < share, rng.standard_normal((m, n)), 0.0)


@pytest.fixture
def warehouse(spark):
    made = []
    yield lambda *a, **b: made.append(RowBlocks(*a, **b)) or made[-1]
    for x in made:
        x.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gridloom_blocks")]


def ran(df):
    """The plan that ran, and what it read and exchanged, from the bottom."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("cells", [20, 1000])
def test_products(spark, warehouse, cells):
    rng = np.random.default_rng(cells)
    a = sparse_array(rng, 60, 40)
    a[7] = rng.standard_normal(40)  # a long row
    a[9:12] = 0
    m = warehouse(from_dense(spark, a), cells=cells, buckets=3)
    assert m.split == (cells == 20)
    for _ in range(2):
        x = rng.standard_normal(40)
        for broadcast in (True, False, None):
            assert np.allclose(m.matvec(dense(spark, x), broadcast=broadcast).collect(), a @ x)
    assert np.allclose((m @ x).collect(), a @ x) and np.allclose(m.tocsr().todense().collect(), a)
    assert m.matvec(x).df.count() == 60
    assert spark.table(m.name).count() > 60 * 40 * 0.3 / cells / 3
    with pytest.raises(ValueError):
        m.matvec(np.ones(3))


def test_a_product_does_not_exchange_the_matrix(spark, warehouse):
    a = sparse_array(np.random.default_rng(1), 50, 50)
    m = warehouse(from_dense(spark, a), cells=100, buckets=3)
    x = dense(spark, np.arange(50.0))
    small = ran(m.matvec(x, broadcast=True).df)
    assert "Bucketed: true" in small and not re.search(r"Exchange hashpartitioning", small)
    m.matvec(x, broadcast=False).collect()  # makes the halo
    large = ran(m.matvec(x, broadcast=False).df)
    # the halo is joined with the vector and sent to the blocks; nothing is exchanged between the blocks' scan and the result
    above = [line for line in large.split("\n") if "vals" in line or "Exchange hashpartitioning" in line or "FileScan" in line]
    sent = [line for line in above if "Exchange hashpartitioning" in line]
    assert all("vals" not in line and "cols" not in line for line in sent), large
    blocks = next(k for k, line in enumerate(large.split("\n")) if "FileScan" in line and "vals" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    lines, at, path = large.split("\n"), blocks, []
    for k in range(blocks, -1, -1):  # the scan's ancestors
        if depth(lines[k]) < depth(lines[at]) or k == blocks:
            path.append(lines[k])
            at = k
    assert not any("Exchange hashpartitioning" in line for line in path), large


def test_odd_matrices(spark, warehouse):
    m = warehouse(from_dense(spark, np.zeros((4, 3))), buckets=2)
    assert (m.matvec(np.ones(3)).collect() == 0).all()
    with pytest.raises(TypeError):
        RowBlocks(from_dense(spark, np.ones((2, 2)) * 1j))


def test_a_block_with_most_cells_is_several_records(spark, warehouse):
    rng = np.random.default_rng(4)
    a = np.zeros((100, 1500))
    a[:10] = rng.integers(1, 9, (10, 1500))
    m = warehouse(from_dense(spark, a), cells=2000, buckets=2)
    assert not m.split and spark.table(m.name).selectExpr("max(size(vals))").first()[0] < 15_000
    x = rng.integers(0, 5, 1500) * 1.0
    for broadcast in (True, False):
        assert (m.matvec(x, broadcast=broadcast).collect() == a @ x).all()


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_records_hold_all_cells_in_order(size):
    import pyarrow as pa

    from gridloom.sources.row_blocks import _packed

    b = np.repeat([-5, 0, 1, 4], [1, 9, 20, 3])
    i = np.where(b < 0, 70, b * 10 + np.arange(len(b)) % 9)
    i = np.concatenate([np.sort(i[b == k]) for k in np.unique(b)])
    j, v = np.arange(len(b)) * 3, [None if k == 5 else k / 4 for k in range(len(b))]
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in (b, i, j)] + [pa.array(v, pa.float64())], names=["b", "i", "j", "v"])
    batches = [whole.slice(0, 0), *(whole.slice(s, size) for s in range(0, len(b), size))]
    rows = [row for batch in _packed(8)(iter(batches)) for row in batch.to_pylist()]
    assert [x for row in rows for x in row["vals"]] == v and [x for row in rows for x in row["cols"]] == j.tolist()
    assert [row["first"] + x for row in rows for x in row["rows"]] == i.tolist() and [row["b"] for row in rows for _ in row["rows"]] == b.tolist()
    assert max(len(row["rows"]) for row in rows) < 8 + size


@pytest.mark.parametrize("name", ["row_blocks_matvec", "row_blocks_matvec_halo"])
def test_the_queries_leave_no_tables(spark, name):
    import os

    from gridloom import queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the driver's tables are not here")
    tables = lambda: {t.name for t in spark.catalog.listTables()}
    before = tables()
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert tables() == before
