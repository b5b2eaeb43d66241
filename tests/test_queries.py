"""Every registered query of the matrix engine against its SQL in DuckDB, on the smallest tables."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from gridloom import queries as own

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.fixture(scope="module")
def results(spark):
    """Rows of every query by both engines; queries run side by side, as most of their time is Spark's start of small jobs."""

    def run(name):
        try:
            c = duckdb.connect()
            for t in TABLES:
                c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
            got = c.execute(own.oracle_sql()[name])
            names = [d[0] for d in got.description]
            order = sorted(range(len(names)), key=names.__getitem__)
            want = sorted(tuple(r[k] for k in order) for r in got.fetchall())
            df = own.queries()[name](spark, SF)
            return sorted(names), want, sorted(df.columns), sorted(tuple(r[n] for n in sorted(names)) for r in df.collect())
        except Exception as e:  # noqa: BLE001 - the test of this name reports it
            return e

    with ThreadPoolExecutor(6) as pool:
        return dict(zip(own.queries(), pool.map(run, own.queries()), strict=True))


@pytest.mark.parametrize("name", list(own.oracle_sql()))
def test_query(results, name):
    if isinstance(results[name], Exception):
        raise results[name]
    names, want, columns, rows = results[name]
    assert columns == names
    assert len(rows) == len(want) and all(same(x, y) for r, w in zip(rows, want, strict=True) for x, y in zip(r, w, strict=True))


def test_every_query_has_its_sql():
    assert set(own.oracle_sql()) == set(own.queries())
