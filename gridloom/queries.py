"""The registered queries of the matrix operators, each with the SQL that gives the same rows.

Matrices come from the driver's tables: QD is supplier by part with the quantities of lineitem (places repeat), Q the
same summed, A the quantities that nations ship to each other, E the embeddings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import linalg as L
from .config import capabilities, config_context, get_config, has_capability, is_available, runtime, use_cpu
from .linalg import preconditioners as P
from .linalg.preconditioners import gershgorin
from .operators import autodiff as D
from .operators import functional as fn
from .operators.assembly import add, block_array, block_diag, bmat, hstack, kron, kronsum, permute, subtract, vstack
from .operators.dense import Dense, dense
from .operators.matrix import COOArray, SparseMatrix, issparse
from .plans.expression import lazy
from .plans.lineage import cut, small
from .sources.construct import asarray, coo_array, csc_array, csr_array, diags, eye, from_dense, from_numpy, from_scipy, fromdense, identity
from .sources.random import rand, random, random_array, runs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# --- matrices


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _size(s: SparkSession, d: str, name: str, key: str) -> int:
    """One more than the greatest key; the keys of these tables count from 0."""
    return (_t(s, d, name).agg(F.max(key)).first()[0] or 0) + 1


def qd(s: SparkSession, d: str, layout: str = "coo") -> SparseMatrix:
    rows = _t(s, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    return coo_array(rows, (_size(s, d, "supplier", "s_suppkey"), _size(s, d, "part", "p_partkey"))).asformat(layout)


def a25(s: SparkSession, d: str, layout: str = "csr") -> SparseMatrix:
    line = _t(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    rows = (
        line.join(_t(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_t(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_t(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j"), F.col("l_quantity").alias("v"))
    )
    return coo_array(rows, (25, 25)).canonicalize().asformat(layout)


def _formula(s: SparkSession, n: int, f: Callable, dtype: str = "float64") -> Dense:
    return Dense(s.range(n).select(F.col("id").alias("i"), f(F.col("id")).cast("double").alias("x")), (n,), dtype)


def part_x(s: SparkSession, n: int) -> Dense:
    return _formula(s, n, lambda i: i % 7 + 1)


def supp_y(s: SparkSession, n: int) -> Dense:
    return _formula(s, n, lambda i: i % 3 + 1)


def matrix_x(s: SparkSession, n: int, k: int, batches: int | None = None) -> Dense:
    """x[i, k] = (i + 2 k) mod 5, or (b + i + 2 k) mod 5."""
    base = s.range(n * k * (batches or 1)).select(F.floor(F.col("id") / (n * k)).alias("b"), F.floor(F.col("id") % (n * k) / k).alias("i"), (F.col("id") % k).alias("k"))
    x = ((F.col("b") + F.col("i") + 2 * F.col("k")) % 5).cast("double").alias("x")
    return Dense(base.select("i", "k", x), (n, k)) if batches is None else Dense(base.select("b", "i", "k", x), (batches, n, k), batched=True)


def spd(s: SparkSession, d: str) -> SparseMatrix:
    """Symmetric and strictly diagonally dominant."""
    a = a25(s, d).persist()
    both = add(a, a.T)
    return add(both, _diagonal(both)).persist()


def general(s: SparkSession, d: str) -> SparseMatrix:
    a = a25(s, d).persist()
    return add(a, _diagonal(a)).persist()


def _diagonal(a: SparseMatrix) -> SparseMatrix:
    rows = a.row_sums().df.select("i", F.col("i").alias("j"), (F.col("x") + 1).alias("v"))
    return a._like(rows, canonical=True)


QD = "Qd AS (SELECT l_suppkey AS i, l_partkey AS j, l_quantity AS v FROM lineitem)"
Q = f"{QD}, Q AS (SELECT i, j, SUM(v) AS v FROM Qd GROUP BY i, j)"
A = "A AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, SUM(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
X = "X AS (SELECT p_partkey AS j, CAST(p_partkey % 7 + 1 AS DOUBLE) AS x FROM part)"
NAT = "N AS (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation)"
S2 = f"{A}, T AS (SELECT i, j, SUM(v) AS v FROM (SELECT * FROM A UNION ALL SELECT j, i, v FROM A) GROUP BY i, j), R AS (SELECT i, SUM(v) AS s FROM T GROUP BY i), S AS (SELECT i, j, SUM(v) AS v FROM (SELECT * FROM T UNION ALL SELECT i, i, s + 1 FROM R) GROUP BY i, j)"


def q(name: str, f: Query, sql: str | None) -> None:
    _QUERIES[name] = f
    if sql:
        _SQL[name] = sql


def _m(a: SparseMatrix) -> DataFrame:
    return a.df.select("i", "j", "v")


def _v(x: Dense) -> DataFrame:
    return x.df.select(*x.keys, "x")


# --- products
_MATVEC = f"WITH {QD}, {X}, Y AS (SELECT i, SUM(v * x) AS y FROM Qd JOIN X USING (j) GROUP BY i) SELECT s_suppkey AS i, COALESCE(y, 0.0) AS x FROM supplier LEFT JOIN Y ON s_suppkey = i"
_TVEC = f"WITH {QD}, Y AS (SELECT j, SUM(v * CAST(i % 3 + 1 AS DOUBLE)) AS y FROM Qd GROUP BY j) SELECT p_partkey AS i, COALESCE(y, 0.0) AS x FROM part LEFT JOIN Y ON p_partkey = j"
_K = "K AS (SELECT * FROM range(4) r(k))"
_MM = f"WITH {QD}, {_K}, Y AS (SELECT i, k, SUM(v * CAST((j + 2 * k) % 5 AS DOUBLE)) AS y FROM Qd, K GROUP BY i, k) SELECT s_suppkey AS i, K.k, COALESCE(y, 0.0) AS x FROM supplier CROSS JOIN K LEFT JOIN Y ON s_suppkey = i AND K.k = Y.k"
_BMM = f"WITH {QD}, {_K}, B AS (SELECT * FROM range(2) r(b)), Y AS (SELECT b, i, k, SUM(v * CAST((b + j + 2 * k) % 5 AS DOUBLE)) AS y FROM Qd, K, B GROUP BY b, i, k) SELECT B.b, s_suppkey AS i, K.k, COALESCE(y, 0.0) AS x FROM B CROSS JOIN supplier CROSS JOIN K LEFT JOIN Y ON s_suppkey = i AND K.k = Y.k AND B.b = Y.b"
_BMV = f"WITH {QD}, B AS (SELECT * FROM range(3) r(b)), Y AS (SELECT b, i, SUM(v * CAST((b + j) % 5 AS DOUBLE)) AS y FROM Qd, B GROUP BY b, i) SELECT B.b, s_suppkey AS i, COALESCE(y, 0.0) AS x FROM B CROSS JOIN supplier LEFT JOIN Y ON s_suppkey = i AND B.b = Y.b"
_GRAM = f"WITH {Q} SELECT a.i, b.i AS j, SUM(a.v * b.v) AS v FROM Q a JOIN Q b ON a.j = b.j GROUP BY a.i, b.i HAVING SUM(a.v * b.v) <> 0"


def _batched_x(s: SparkSession, n: int) -> Dense:
    base = s.range(3 * n).select(F.floor(F.col("id") / n).alias("b"), (F.col("id") % n).alias("i"))
    return Dense(base.select("b", "i", ((F.col("b") + F.col("i")) % 5).cast("double").alias("x")), (3, n), batched=True)


def _gram(s: SparkSession, d: str, layout: str) -> DataFrame:
    a = qd(s, d, layout)
    return _m(getattr(fn, f"{layout}_matmat")(a, a.T.asformat(layout)))


for _l in ("coo", "csr", "csc"):
    q(f"{_l}_matvec", lambda s, d, l=_l: _v(getattr(fn, f"{l}_matvec")(a := qd(s, d, l), part_x(s, a.n_cols))), _MATVEC)
    q(f"{_l}_matvec_transpose", lambda s, d, l=_l: _v(getattr(fn, f"{l}_matvec_transpose")(a := qd(s, d, l), supp_y(s, a.n_rows))), _TVEC)
    q(f"{_l}_matmul", lambda s, d, l=_l: _v(getattr(fn, f"{l}_matmul")(a := qd(s, d, l), matrix_x(s, a.n_cols, 4))), _MM)
    q(f"{_l}_batched_matvec", lambda s, d, l=_l: _v(getattr(fn, f"{l}_batched_matvec")(a := qd(s, d, l), _batched_x(s, a.n_cols))), _BMV)
    q(f"{_l}_batched_matmul", lambda s, d, l=_l: _v(getattr(fn, f"{l}_batched_matmul")(a := qd(s, d, l), matrix_x(s, a.n_cols, 4, 2))), _BMM)
    q(f"{_l}_matmat", lambda s, d, l=_l: _gram(s, d, l), _GRAM)

q(
    "matmul_transpose",
    lambda s, d: _v((a := qd(s, d, "csr")).matmul_transpose(matrix_x(s, a.n_rows, 4))),
    f"WITH {QD}, {_K}, Y AS (SELECT j, k, SUM(v * CAST((i + 2 * k) % 5 AS DOUBLE)) AS y FROM Qd, K GROUP BY j, k) SELECT p_partkey AS i, K.k, COALESCE(y, 0.0) AS x FROM part CROSS JOIN K LEFT JOIN Y ON p_partkey = j AND K.k = Y.k",
)
q("mixed_matmat", lambda s, d: _m(a25(s, d, "csc") @ a25(s, d, "coo")), f"WITH {A} SELECT a.i, b.j, SUM(a.v * b.v) AS v FROM A a JOIN A b ON a.j = b.i GROUP BY a.i, b.j HAVING SUM(a.v * b.v) <> 0")
q(
    "lazy_normal_matvec",
    lambda s, d: _v((lazy((a := qd(s, d)).T) @ a) @ part_x(s, a.n_cols)),
    f"WITH {QD}, {X}, Y AS (SELECT i, SUM(v * x) AS y FROM Qd JOIN X USING (j) GROUP BY i), Z AS (SELECT j, SUM(v * y) AS z FROM Qd JOIN Y USING (i) GROUP BY j) SELECT p_partkey AS i, COALESCE(z, 0.0) AS x FROM part LEFT JOIN Z ON p_partkey = j",
)
q("lazy_chain", lambda s, d: _m((lazy(a := a25(s, d)) @ a @ a.T).evaluate()), f"WITH {A}, B AS (SELECT a.i, b.j, SUM(a.v * b.v) AS v FROM A a JOIN A b ON a.j = b.i GROUP BY a.i, b.j) SELECT b.i, a.i AS j, SUM(b.v * a.v) AS v FROM B b JOIN A a ON b.j = a.j GROUP BY b.i, a.i HAVING SUM(b.v * a.v) <> 0")
q("dot", lambda s, d: fn.dot(a := a25(s, d), a.T), f"WITH {A} SELECT COALESCE(SUM(a.v * b.v), 0.0) AS x FROM A a JOIN A b ON a.i = b.j AND a.j = b.i")
q(
    "vdot_complex",
    lambda s, d: fn.vdot(_complex(s, d), _complex(s, d).T).select(F.col("x.re").alias("re"), F.col("x.im").alias("im")),
    f"WITH {A}, C AS (SELECT i, j, v AS re, CAST(i - j AS DOUBLE) AS im FROM A) SELECT SUM(a.re * b.re + a.im * b.im) AS re, SUM(a.re * b.im - a.im * b.re) AS im FROM C a JOIN C b ON a.i = b.j AND a.j = b.i",
)


def _complex(s: SparkSession, d: str) -> SparseMatrix:
    a = a25(s, d)
    return coo_array(a.df.select("i", "j", F.struct(F.col("v").alias("re"), (F.col("i") - F.col("j")).cast("double").alias("im")).alias("v")), a.shape, canonical=True)


q("hermitian", lambda s, d: _complex(s, d).H.df.select("i", "j", F.col("v.re").alias("re"), F.col("v.im").alias("im")), f"WITH {A} SELECT j AS i, i AS j, v AS re, -CAST(i - j AS DOUBLE) AS im FROM A")
q("conj", lambda s, d: _complex(s, d).conj().df.select("i", "j", F.col("v.re").alias("re"), F.col("v.im").alias("im")), f"WITH {A} SELECT i, j, v AS re, -CAST(i - j AS DOUBLE) AS im FROM A")
q(
    "complex_matvec",
    lambda s, d: (a := _complex(s, d)).matvec(Dense(s.range(25).select(F.col("id").alias("i"), F.struct((F.col("id") % 3).cast("double").alias("re"), F.lit(1.0).alias("im")).alias("x")), (25,), "complex64")).df.select("i", F.col("x.re").alias("re"), F.col("x.im").alias("im")),
    f"WITH {A}, {NAT}, Y AS (SELECT i, SUM(v * (j % 3) - (i - j)) AS re, SUM(v + (i - j) * (j % 3)) AS im FROM A GROUP BY i) SELECT n AS i, CAST(COALESCE(re, 0) AS DOUBLE) AS re, CAST(COALESCE(im, 0) AS DOUBLE) AS im FROM N LEFT JOIN Y ON n = i",
)

# --- sums and norms
for _l in ("coo", "csr", "csc"):
    q(f"{_l}_row_sums", lambda s, d, l=_l: _v(getattr(fn, f"{l}_row_sums")(qd(s, d, l))), f"WITH {QD}, Y AS (SELECT i, SUM(v) AS y FROM Qd GROUP BY i) SELECT s_suppkey AS i, COALESCE(y, 0.0) AS x FROM supplier LEFT JOIN Y ON s_suppkey = i")
    q(f"{_l}_col_sums", lambda s, d, l=_l: _v(getattr(fn, f"{l}_col_sums")(qd(s, d, l))), f"WITH {QD}, Y AS (SELECT j, SUM(v) AS y FROM Qd GROUP BY j) SELECT p_partkey AS i, COALESCE(y, 0.0) AS x FROM part LEFT JOIN Y ON p_partkey = j")
    q(f"{_l}_row_norms", lambda s, d, l=_l: _rounded(getattr(fn, f"{l}_row_norms")(qd(s, d, l))), f"WITH {Q}, Y AS (SELECT i, SQRT(SUM(v * v)) AS y FROM Q GROUP BY i) SELECT s_suppkey AS i, ROUND(COALESCE(y, 0.0), 4) AS x FROM supplier LEFT JOIN Y ON s_suppkey = i")
    q(f"{_l}_col_norms", lambda s, d, l=_l: _rounded(getattr(fn, f"{l}_col_norms")(qd(s, d, l))), f"WITH {Q}, Y AS (SELECT j, SQRT(SUM(v * v)) AS y FROM Q GROUP BY j) SELECT p_partkey AS i, ROUND(COALESCE(y, 0.0), 4) AS x FROM part LEFT JOIN Y ON p_partkey = j")
    q(f"{_l}_diagonal", lambda s, d, l=_l: _v(getattr(fn, f"{l}_diagonal")(qd(s, d, l))), f"WITH {QD}, Y AS (SELECT i, SUM(v) AS y FROM Qd WHERE i = j GROUP BY i) SELECT s_suppkey AS i, COALESCE(y, 0.0) AS x FROM supplier LEFT JOIN Y ON s_suppkey = i")
    q(f"{_l}_trace", lambda s, d, l=_l: getattr(fn, f"{l}_trace")(qd(s, d, l)), f"WITH {QD} SELECT COALESCE(SUM(v), 0.0) AS x FROM Qd WHERE i = j")
    q(f"{_l}_todense", lambda s, d, l=_l: _v(a25(s, d, l).todense()), f"WITH {A}, {NAT} SELECT r.n AS i, c.n AS k, COALESCE(v, 0.0) AS x FROM N r CROSS JOIN N c LEFT JOIN A ON i = r.n AND j = c.n")


def _rounded(x: Dense, digits: int = 4) -> DataFrame:
    return x.df.select(*x.keys, F.round("x", digits).alias("x"))


q("sum_all", lambda s, d: qd(s, d).sum(), "SELECT SUM(l_quantity) AS x FROM lineitem")
q("nnz", lambda s, d: s.createDataFrame([(qd(s, d).nnz, qd(s, d).canonicalize().nnz)], "stored long, canonical long"), f"WITH {Q} SELECT (SELECT COUNT(*) FROM Qd) AS stored, (SELECT COUNT(*) FROM Q) AS canonical")
q("canonicalize", lambda s, d: _m(qd(s, d).canonicalize()), f"WITH {Q} SELECT * FROM Q")
q(
    "sum_duplicates_keep_zero",
    lambda s, d: _m((a := qd(s, d))._like(a.df.union(a.df.select("i", "j", (-F.col("v")).alias("v")))).sum_duplicates()),
    f"WITH {QD} SELECT i, j, SUM(v) AS v FROM (SELECT * FROM Qd UNION ALL SELECT i, j, -v FROM Qd) GROUP BY i, j",
)

# --- projections, filters, layouts
q("scalar_mul", lambda s, d: _m(2.5 * qd(s, d)), f"WITH {QD} SELECT i, j, 2.5::DOUBLE * v AS v FROM Qd")
q("transpose", lambda s, d: _m(qd(s, d).T), f"WITH {QD} SELECT j AS i, i AS j, v FROM Qd")
q("tril", lambda s, d: _m(fn.tril(a25(s, d), 1)), f"WITH {A} SELECT * FROM A WHERE j - i <= 1")
q("triu", lambda s, d: _m(fn.triu(a25(s, d), 1)), f"WITH {A} SELECT * FROM A WHERE j - i >= 1")
_PTR = "SELECT {key} AS place, CAST(SUM(c) OVER (ORDER BY {key}) - c AS BIGINT) AS start, CAST(SUM(c) OVER (ORDER BY {key}) AS BIGINT) AS stop FROM (SELECT {key}, COUNT(v) AS c FROM {table} LEFT JOIN Qd ON {key} = {axis} GROUP BY {key})"
q("tocsr_indptr", lambda s, d: qd(s, d).tocsr().indptr(), f"WITH {QD} " + _PTR.format(key="s_suppkey", table="supplier", axis="i"))
q("tocsc_indptr", lambda s, d: qd(s, d).tocsc().indptr(), f"WITH {QD} " + _PTR.format(key="p_partkey", table="part", axis="j"))
_PACKED = "SELECT {a}, COUNT(*) AS n, SUM({b} * v) AS s FROM Q GROUP BY {a}"
q("csr_packed", lambda s, d: _unpacked(qd(s, d).canonicalize().tocsr().packed(), "i", "j"), f"WITH {Q} " + _PACKED.format(a="i", b="j"))
q("csc_packed", lambda s, d: _unpacked(qd(s, d).canonicalize().tocsc().packed(), "j", "i"), f"WITH {Q} " + _PACKED.format(a="j", b="i"))


def _unpacked(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(a, F.size("cells").cast("long").alias("n"), F.aggregate("cells", F.lit(0.0), lambda t, c: t + c[b] * c["v"]).alias("s"))


q("sort_indices", lambda s, d: _m(qd(s, d, "csr").sort_indices()), f"WITH {QD} SELECT * FROM Qd")
q("csr_array_from_packed", lambda s, d: _m(csr_array((a := qd(s, d)).tocsr().packed(), a.shape)), f"WITH {QD} SELECT * FROM Qd")
q("csc_array_from_packed", lambda s, d: _m(csc_array((a := qd(s, d)).tocsc().packed(), a.shape)), f"WITH {QD} SELECT * FROM Qd")
q("asarray", lambda s, d: _m(asarray(s, qd(s, d))), f"WITH {Q} SELECT * FROM Q")
q(
    "permute",
    lambda s, d: _v(permute(part_x(s, n := _size(s, d, "part", "p_partkey")), _formula(s, n, lambda i: n - 1 - i))),
    "SELECT p_partkey AS i, CAST(((SELECT MAX(p_partkey) FROM part) - p_partkey) % 7 + 1 AS DOUBLE) AS x FROM part",
)

# --- constructors
q("fromdense", lambda s, d: _m(fromdense(s, _t(s, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("row")), threshold=0.1)), "SELECT vec_id AS i, CAST(p - 1 AS BIGINT) AS j, CAST(embedding[p] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS p FROM embeddings) WHERE abs(CAST(embedding[p] AS DOUBLE)) > 0.1")
q("eye", lambda s, d: _m(eye(s, 40, 50, k=3)), "SELECT i, i + 3 AS j, 1.0::DOUBLE AS v FROM range(40) r(i)")
q("identity", lambda s, d: _m(identity(s, _size(s, d, "part", "p_partkey"))), "SELECT p_partkey AS i, p_partkey AS j, 1.0::DOUBLE AS v FROM part")
q("diags", lambda s, d: _m(diags(s, [np.arange(1.0, 30), np.full(30, 4.0), np.arange(2.0, 31)], [-1, 0, 1])), "SELECT i + 1 AS i, i AS j, CAST(i + 1 AS DOUBLE) AS v FROM range(29) r(i) UNION ALL SELECT i, i, 4.0 FROM range(30) r(i) UNION ALL SELECT i, i + 1, CAST(i + 2 AS DOUBLE) FROM range(29) r(i)")


def _random_facts(a: COOArray) -> DataFrame:
    return a.df.agg(F.count("*").alias("n"), F.count_distinct("i", "j").alias("places"), (F.min("v") >= 0).alias("low"), (F.max("v") < 1).alias("high"), ((F.max("i") < a.n_rows) & (F.max("j") < a.n_cols)).alias("inside"))


def _random_parts(s: SparkSession, d: str) -> DataFrame:
    """The same facts of cells that are too many to be shuffled by place."""
    a = random_array(s, (_size(s, d, "supplier", "s_suppkey"), _size(s, d, "part", "p_partkey")), density=0.05, rng=11, dtype="float32")
    # runs are about as many as tasks, so one window holds them; if two overlap, places are counted one by one
    met = runs(a, 11).withColumn("apart", F.col("first") > F.coalesce(F.max("last").over(W.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(-1)))
    got = cut(met.agg(F.sum("n").alias("n"), F.sum("distinct").alias("places"), (F.min("least") >= 0).alias("low"), (F.max("most") < 1).alias("high"), ((F.max("i") < a.n_rows) & (F.max("j") < a.n_cols)).alias("inside"), F.min("apart").alias("apart")), "facts")
    return got.drop("apart") if got.first().apart is not False else _random_facts(a)


for _name, _f in (("random_array", lambda s: random_array(s, (300, 500), density=0.02, random_state=7)), ("random", lambda s: random(s, 300, 500, 0.02, random_state=8)), ("rand", lambda s: rand(s, 300, 500, 0.02, random_state=9))):
    q(_name, lambda s, d, f=_f: _random_facts(f(s)), "SELECT CAST(3000 AS BIGINT) AS n, CAST(3000 AS BIGINT) AS places, true AS low, true AS high, true AS inside")

# --- sums of matrices and blocks
q("add", lambda s, d: _m(add(a := a25(s, d), a.T)), f"WITH {A} SELECT i, j, SUM(v) AS v FROM (SELECT * FROM A UNION ALL SELECT j, i, v FROM A) GROUP BY i, j HAVING SUM(v) <> 0")
q(
    "subtract",  # half of the cells cancel
    lambda s, d: _m(subtract(a := qd(s, d), a._like(a.df.withColumn("v", F.col("v") + F.col("j") % 2)))),
    f"WITH {QD} SELECT i, j, SUM(v) AS v FROM (SELECT * FROM Qd UNION ALL SELECT i, j, -(v + j % 2) FROM Qd) GROUP BY i, j HAVING SUM(v) <> 0",
)
P5 = "P AS (SELECT i // 5 AS i, j // 5 AS j, SUM(v) AS v FROM A GROUP BY 1, 2)"


def _coarse(a: SparseMatrix) -> SparseMatrix:
    """The matrix between groups of five nations."""
    return a._like(a.df.groupBy(F.floor(F.col("i") / 5).alias("i"), F.floor(F.col("j") / 5).alias("j")).agg(F.sum("v").alias("v")), (5, 5))


q("kron", lambda s, d: _m(kron(a := a25(s, d), _coarse(a))), f"WITH {A}, {P5} SELECT A.i * 5 + P.i AS i, A.j * 5 + P.j AS j, A.v * P.v AS v FROM A CROSS JOIN P")
q(
    "kronsum",
    lambda s, d: _m(kronsum(a := a25(s, d), _coarse(a))),
    f"WITH {A}, {P5} SELECT i, j, SUM(v) AS v FROM (SELECT e * 25 + i AS i, e * 25 + j AS j, v FROM A, range(5) r(e) UNION ALL SELECT i * 25 + e, j * 25 + e, v FROM P, range(25) r(e)) GROUP BY i, j HAVING SUM(v) <> 0",
)
for _name, _f in (("block_array", block_array), ("bmat", bmat)):
    q(_name, lambda s, d, f=_f: _m(f([[a := a25(s, d), None], [a.T, a]])), f"WITH {A} SELECT * FROM A UNION ALL SELECT j + 25, i, v FROM A UNION ALL SELECT i + 25, j + 25, v FROM A")
q("block_diag", lambda s, d: _m(block_diag([a := a25(s, d), a.T])), f"WITH {A} SELECT * FROM A UNION ALL SELECT j + 25, i + 25, v FROM A")
q("vstack", lambda s, d: _m(vstack([a := a25(s, d), a])), f"WITH {A} SELECT * FROM A UNION ALL SELECT i + 25, j, v FROM A")
q("hstack", lambda s, d: _m(hstack([a := a25(s, d), a])), f"WITH {A} SELECT * FROM A UNION ALL SELECT i, j + 25, v FROM A")

# --- derivatives
q("data_vjp_matvec", lambda s, d: _m(D.matvec_data_vjp(a := qd(s, d).canonicalize(), part_x(s, a.n_cols), supp_y(s, a.n_rows))), f"WITH {Q}, {X} SELECT Q.i, Q.j, CAST(Q.i % 3 + 1 AS DOUBLE) * x AS v FROM Q JOIN X USING (j)")
q("data_vjp_matmul", lambda s, d: _m(D.matmul_data_vjp(a := qd(s, d).canonicalize(), matrix_x(s, a.n_cols, 4), matrix_x(s, a.n_rows, 4))), f"WITH {Q}, {_K} SELECT i, j, SUM(CAST((i + 2 * k) % 5 AS DOUBLE) * CAST((j + 2 * k) % 5 AS DOUBLE)) AS v FROM Q, K GROUP BY i, j")
q("rhs_vjp", lambda s, d: _v(D.rhs_vjp(a := qd(s, d), supp_y(s, a.n_rows))), _TVEC)
q("matvec_jvp", lambda s, d: _v(D.matvec_jvp(a := qd(s, d), a, part_x(s, a.n_cols), part_x(s, a.n_cols))), f"SELECT i, 2 * x AS x FROM ({_MATVEC})")
q("todense_vjp", lambda s, d: _m(D.todense_vjp(a := a25(s, d), matrix_x(s, 25, 25))), f"WITH {A} SELECT i, j, CAST((i + 2 * j) % 5 AS DOUBLE) AS v FROM A")
q("row_sums_vjp", lambda s, d: _m(D.row_sums_vjp(a := a25(s, d), supp_y(s, 25))), f"WITH {A} SELECT i, j, CAST(i % 3 + 1 AS DOUBLE) AS v FROM A")
q("col_sums_vjp", lambda s, d: _m(D.col_sums_vjp(a := a25(s, d), supp_y(s, 25))), f"WITH {A} SELECT i, j, CAST(j % 3 + 1 AS DOUBLE) AS v FROM A")
q("diagonal_vjp", lambda s, d: _m(D.diagonal_vjp(a := a25(s, d), supp_y(s, 25))), f"WITH {A} SELECT i, j, CASE WHEN i = j THEN CAST(i % 3 + 1 AS DOUBLE) ELSE 0.0 END AS v FROM A")
q("trace_vjp", lambda s, d: _m(D.trace_vjp(a25(s, d), 3.0)), f"WITH {A} SELECT i, j, CASE WHEN i = j THEN 3.0::DOUBLE ELSE 0.0 END AS v FROM A")

# --- preconditioners
q("jacobi_apply", lambda s, d: _rounded(P.jacobi(spd(s, d), omega=0.5).solve(part_x(s, 25)), 10), f"WITH {S2} SELECT i, ROUND(0.5 / v * CAST(i % 7 + 1 AS DOUBLE), 10) AS x FROM S WHERE i = j")
q("diagonal_apply", lambda s, d: _rounded(P.diagonal(s, spd(s, d).diagonal()).solve(part_x(s, 25)), 10), f"WITH {S2} SELECT i, ROUND(CAST(i % 7 + 1 AS DOUBLE) / v, 10) AS x FROM S WHERE i = j")
q("gershgorin", lambda s, d: _v(gershgorin(a25(s, d))), f"WITH {A}, {NAT}, G AS (SELECT i, SUM(CASE WHEN i = j THEN v ELSE 0 END) AS d, SUM(CASE WHEN i <> j THEN ABS(v) ELSE 0 END) AS o FROM A GROUP BY i) SELECT n AS i, CAST(k AS BIGINT) AS k, COALESCE(CASE WHEN k = 0 THEN d - o ELSE d + o END, 0.0) AS x FROM N CROSS JOIN range(2) r(k) LEFT JOIN G ON n = i")
q("chebyshev_bounds", lambda s, d: s.createDataFrame([(float(c.lo), float(c.hi))] if (c := P.chebyshev(spd(s, d))) else [], "lo double, hi double"), f"WITH {S2}, G AS (SELECT i, SUM(CASE WHEN i = j THEN v ELSE 0 END) AS d, SUM(CASE WHEN i <> j THEN ABS(v) ELSE 0 END) AS o FROM S GROUP BY i) SELECT MIN(d - o) AS lo, MAX(d + o) AS hi FROM G")

# --- solvers: the right-hand side is made from a known solution, (i mod 7) + 1
_KNOWN = "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS x FROM nation"


def _solved(make: Callable, solve: Callable) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        a = make(s, d)
        x = solve(a, a.matvec(part_x(s, 25)))
        return _rounded(x[0] if isinstance(x, tuple) else x)

    return run


q("cg", _solved(spd, lambda a, b: L.cg(a, b, rtol=1e-12)), _KNOWN)
q("cg_jacobi", _solved(spd, lambda a, b: L.cg(a, b, rtol=1e-12, M=P.jacobi(a))), _KNOWN)
q("cg_ichol0", _solved(spd, lambda a, b: L.cg(a, b, rtol=1e-12, M=P.ichol0(a))), _KNOWN)
q("cg_chebyshev", _solved(spd, lambda a, b: L.cg(a, b, rtol=1e-12, M=P.chebyshev(a))), _KNOWN)
q("cg_distributed", _solved(spd, lambda a, b: L.cg(a, b, rtol=1e-9, M=P.jacobi(a), distributed=True)), _KNOWN)
q("bicgstab", _solved(general, lambda a, b: L.bicgstab(a, b, rtol=1e-12)), _KNOWN)
q("bicgstab_ilu0", _solved(general, lambda a, b: L.bicgstab(a, b, rtol=1e-12, M=P.ilu0(a))), _KNOWN)
q("gmres", _solved(general, lambda a, b: L.gmres(a, b, rtol=1e-12)), _KNOWN)
q("gmres_exact", _solved(general, lambda a, b: L.gmres(a, b, rtol=1e-10, M=P.exact(a))), _KNOWN)
q("minres", _solved(spd, lambda a, b: L.minres(a, b, rtol=1e-12)), _KNOWN)
q("spsolve", _solved(general, L.spsolve), _KNOWN)
q("factorized_qr", _solved(general, lambda a, b: L.factorized(a, method="qr").solve(b)), _KNOWN)
q("factorized_ldlt", _solved(spd, lambda a, b: L.factorized(a, method="ldlt").solve(b)), _KNOWN)
q("spsolve_triangular", _solved(lambda s, d: spd(s, d).tril(), lambda a, b: L.spsolve_triangular(a, b)), _KNOWN)


def _local(a: SparseMatrix, b: Dense) -> Dense:
    return dense(a.spark, L.cg(L.aslinearoperator(a.todense().collect()), b.collect(), rtol=1e-12)[0])


q("cg_matrix_free", _solved(spd, _local), _KNOWN)


def _cholesky(s: SparkSession, d: str) -> DataFrame:
    low = L.cholesky(spd(s, d)).L
    return low.matmat(low.T).df.select("i", "j", F.round("v", 3).alias("v")).filter("v != 0")


def _lu(s: SparkSession, d: str) -> DataFrame:
    f = L.splu(general(s, d))
    out = f.L.matmat(f.U).df.select(F.col("i").alias("r"), "j", F.round("v", 3).alias("v")).join(f.perm_frame.select(F.col("i").alias("r"), F.col("src").alias("i")), "r")
    return out.filter("v != 0").select("i", "j", "v")


q("cholesky", _cholesky, f"WITH {S2} SELECT i, j, ROUND(v, 3) AS v FROM S")
q("lu", _lu, f"WITH {A}, R AS (SELECT i, SUM(v) AS s FROM A GROUP BY i) SELECT i, j, ROUND(SUM(v), 3) AS v FROM (SELECT * FROM A UNION ALL SELECT i, i, s + 1 FROM R) GROUP BY i, j")
q("triangular_levels", lambda s, d: L.triangular_levels(_bidiagonal(s, 9)).df.select("i", F.col("x").alias("level")), "SELECT i, i AS level FROM range(9) r(i)")


def _bidiagonal(s: SparkSession, n: int) -> SparseMatrix:
    return diags(s, [np.ones(n), np.ones(n - 1)], [0, -1])


def _path_laplacian(s: SparkSession, n: int = 24) -> SparseMatrix:
    main = np.full(n, 2.0)
    main[[0, -1]] = 1.0
    return diags(s, [main, -np.ones(n - 1), -np.ones(n - 1)], [0, 1, -1])


def _ranked(s: SparkSession, values: np.ndarray) -> DataFrame:
    return s.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(values)], "r long, x double")


def _three(sqrt: bool) -> str:
    x = "2 - 2 * cos(pi() * (23 - r) / 24)"
    return f"SELECT r, ROUND({f'sqrt({x})' if sqrt else x}, 6) AS x FROM range(3) t(r)"


q("eigsh", lambda s, d: _ranked(s, L.eigsh(_path_laplacian(s), 3, ncv=24, return_eigenvectors=False)), _three(False))
q("lanczos", lambda s, d: _lanczos(s), "SELECT 24::BIGINT AS steps, ROUND(SUM(2 - 2 * cos(pi() * k / 24)), 6) AS x FROM range(24) t(k)")
q("svds", lambda s, d: _ranked(s, L.svds(diags(s, [-np.ones(23), np.ones(23)], [0, 1], shape=(23, 24)), 3, ncv=24, return_singular_vectors=False)), _three(True))
q("eigs", lambda s, d: _ranked(s, np.round(L.eigs(diags(s, [np.arange(1.0, 9), np.full(7, 0.5)], [0, 1]), 3, ncv=8, return_eigenvectors=False).real, 4)), "SELECT r, CAST(8 - r AS DOUBLE) AS x FROM range(3) t(r)")


def _lanczos(s: SparkSession) -> DataFrame:
    alphas, _ = L.lanczos(_path_laplacian(s), 24, v0=np.random.default_rng(3).standard_normal(24), return_basis=False)
    return s.createDataFrame([(len(alphas), round(float(alphas.sum()), 6))], "steps long, x double")


def _traced(s: SparkSession, make: Callable) -> DataFrame:
    small = make(np.random.default_rng(3).standard_normal(24))
    return s.createDataFrame([(len(small), round(float(small.sum()), 6))], "steps long, x double")


q("arnoldi", lambda s, d: _traced(s, lambda v: np.diag(L.arnoldi(_path_laplacian(s), 24, v0=v)[0])), "SELECT 24::BIGINT AS steps, 46.0::DOUBLE AS x")
q("normal_lanczos", lambda s, d: _traced(s, lambda v: L.normal_lanczos(diags(s, [-np.ones(23), np.ones(23)], [0, 1], shape=(23, 24)), 24, v0=v)[0]), "SELECT 24::BIGINT AS steps, 46.0::DOUBLE AS x")
q("diagonal_positions", lambda s, d: L.diagonal_positions(a25(s, d)), f"WITH {A} SELECT i, CAST(r AS BIGINT) AS pos FROM (SELECT i, j, ROW_NUMBER() OVER (ORDER BY i, j) - 1 AS r FROM A) WHERE i = j")


def _pagerank(s: SparkSession, d: str) -> DataFrame:
    """Three steps, each weighted by the links' share of their column."""
    a = a25(s, d).persist()
    sums = a.col_sums().df.select(F.col("i").alias("c"), F.col("x").alias("s"))
    links = a._like(a.df.join(small(sums, a.n_cols), F.col("j") == F.col("c")).select("i", "j", (F.col("v") / F.col("s")).alias("v")))
    x = _formula(s, 25, lambda i: F.lit(1 / 25))
    for _ in range(3):
        y = links.matvec(x)
        x = Dense(y.df.select("i", (F.lit(0.85) * F.col("x") + F.lit(0.15 / 25)).alias("x")), (25,))
    return _rounded(x, 10)


def _step(of: str, name: str) -> str:
    return f"{name} AS (SELECT n AS i, 0.85 * COALESCE(SUM(w * p.x), 0.0) + 0.15 / 25 AS x FROM N LEFT JOIN W ON W.i = n LEFT JOIN {of} p ON p.i = W.j GROUP BY n)"


q("pagerank", _pagerank, f"WITH {A}, {NAT}, C AS (SELECT j, SUM(v) AS s FROM A GROUP BY j), W AS (SELECT A.i, A.j, A.v / C.s AS w FROM A JOIN C USING (j)), P0 AS (SELECT n AS i, CAST(1.0 / 25 AS DOUBLE) AS x FROM N), {_step('P0', 'P1')}, {_step('P1', 'P2')}, {_step('P2', 'P3')} SELECT i, ROUND(x, 10) AS x FROM P3")
q("laplacian_matvec", lambda s, d: _v(_path_laplacian(s).matvec(_formula(s, 24, lambda i: i * i))), "SELECT i, CAST((CASE WHEN i IN (0, 23) THEN 1 ELSE 2 END) * i * i - (CASE WHEN i > 0 THEN (i - 1) * (i - 1) ELSE 0 END) - (CASE WHEN i < 23 THEN (i + 1) * (i + 1) ELSE 0 END) AS DOUBLE) AS x FROM range(24) r(i)")
q("document_terms", lambda s, d: _document_terms(s, d), "SELECT doc_id AS i, CAST(COUNT(*) AS DOUBLE) AS x FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM documents WHERE text IS NOT NULL) GROUP BY doc_id")


def _document_terms(s: SparkSession, d: str) -> DataFrame:
    """Words of each document as a matrix with hashed columns, and its row sums where there are words."""
    words = _t(s, d, "documents").filter("text is not null").select(F.col("doc_id").alias("i"), F.explode(F.split("text", " ", -1)).alias("t"))
    cells = words.groupBy("i", "t").agg(F.count("*").cast("double").alias("v")).select("i", F.pmod(F.xxhash64("t"), F.lit(1 << 40)).alias("j"), "v")
    a = coo_array(cells, (_size(s, d, "documents", "doc_id"), 1 << 40))
    return a.row_sums().df.filter("x > 0")


# --- each operator of each layout by its own name


def _c(a: SparseMatrix) -> DataFrame:
    """The cells of a complex matrix."""
    return a.df.select("i", "j", F.col("v.re").alias("re"), F.col("v.im").alias("im"))


_CONJ = f"WITH {A} SELECT i, j, v AS re, -CAST(i - j AS DOUBLE) AS im FROM A"
_HERM = f"WITH {A} SELECT j AS i, i AS j, v AS re, -CAST(i - j AS DOUBLE) AS im FROM A"
_ROWS = f"WITH {QD}, Y AS (SELECT i, SUM(v) AS y FROM Qd GROUP BY i) SELECT s_suppkey AS i, COALESCE(y, 0.0) AS x FROM supplier LEFT JOIN Y ON s_suppkey = i"
_COLS = f"WITH {QD}, Y AS (SELECT j, SUM(v) AS y FROM Qd GROUP BY j) SELECT p_partkey AS i, COALESCE(y, 0.0) AS x FROM part LEFT JOIN Y ON p_partkey = j"
_COL_NORMS = f"WITH {Q}, Y AS (SELECT j, SQRT(SUM(v * v)) AS y FROM Q GROUP BY j) SELECT p_partkey AS i, ROUND(COALESCE(y, 0.0), 4) AS x FROM part LEFT JOIN Y ON p_partkey = j"
_TMM = f"WITH {QD}, {_K}, Y AS (SELECT j, k, SUM(v * CAST((i + 2 * k) % 5 AS DOUBLE)) AS y FROM Qd, K GROUP BY j, k) SELECT p_partkey AS i, K.k, COALESCE(y, 0.0) AS x FROM part CROSS JOIN K LEFT JOIN Y ON p_partkey = j AND K.k = Y.k"
_PLUS_T = f"WITH {A} SELECT i, j, SUM(v) AS v FROM (SELECT * FROM A UNION ALL SELECT j, i, v FROM A) GROUP BY i, j HAVING SUM(v) <> 0"
_LESS_T = f"WITH {A} SELECT i, j, SUM(v) AS v FROM (SELECT * FROM A UNION ALL SELECT j, i, -v FROM A) GROUP BY i, j HAVING SUM(v) <> 0"
_AA = f"WITH {A} SELECT * FROM A"
_NEG = f"WITH {A} SELECT i, j, -v AS v FROM A"
_VJP_V = f"WITH {Q}, {X} SELECT Q.i, Q.j, CAST(Q.i % 3 + 1 AS DOUBLE) * x AS v FROM Q JOIN X USING (j)"
_VJP_M = f"WITH {Q}, {_K} SELECT i, j, SUM(CAST((i + 2 * k) % 5 AS DOUBLE) * CAST((j + 2 * k) % 5 AS DOUBLE)) AS v FROM Q, K GROUP BY i, j"
for _l in ("coo", "csr", "csc"):
    q(f"{_l}_mul", lambda s, d, l=_l: _m(qd(s, d, l) * 2.5), f"WITH {QD} SELECT i, j, 2.5::DOUBLE * v AS v FROM Qd")
    q(f"{_l}_rmul", lambda s, d, l=_l: _m(2.5 * qd(s, d, l)), f"WITH {QD} SELECT i, j, 2.5::DOUBLE * v AS v FROM Qd")
    q(f"{_l}_conj", lambda s, d, l=_l: _c(_complex(s, d).asformat(l).conj()), _CONJ)
    q(f"{_l}_conjugate", lambda s, d, l=_l: _c(_complex(s, d).asformat(l).conjugate()), _CONJ)
    q(f"{_l}_transpose", lambda s, d, l=_l: _m(getattr(fn, f"{l}_transpose")(qd(s, d, l))), f"WITH {QD} SELECT j AS i, i AS j, v FROM Qd")
    q(f"{_l}_t", lambda s, d, l=_l: _m(qd(s, d, l).T), f"WITH {QD} SELECT j AS i, i AS j, v FROM Qd")
    q(f"{_l}_h", lambda s, d, l=_l: _c(_complex(s, d).asformat(l).H), _HERM)
    q(f"{_l}_column_sums", lambda s, d, l=_l: _v(getattr(fn, f"{l}_column_sums")(qd(s, d, l))), _COLS)
    q(f"{_l}_column_sums_method", lambda s, d, l=_l: _v(qd(s, d, l).column_sums()), _COLS)
    q(f"{_l}_column_norms", lambda s, d, l=_l: _rounded(getattr(fn, f"{l}_column_norms")(qd(s, d, l))), _COL_NORMS)
    q(f"{_l}_column_norms_method", lambda s, d, l=_l: _rounded(qd(s, d, l).column_norms()), _COL_NORMS)
    q(f"{_l}_sum", lambda s, d, l=_l: qd(s, d, l).sum(), "SELECT SUM(l_quantity) AS x FROM lineitem")
    q(f"{_l}_sum_rows", lambda s, d, l=_l: _v(qd(s, d, l).sum(axis=1)), _ROWS)
    q(f"{_l}_sum_columns", lambda s, d, l=_l: _v(qd(s, d, l).sum(axis=0)), _COLS)
    q(f"{_l}_nnz", lambda s, d, l=_l: s.createDataFrame([(qd(s, d, l).nnz,)], "n long"), "SELECT COUNT(*) AS n FROM lineitem")
    q(f"{_l}_sum_duplicates", lambda s, d, l=_l: _m(getattr(fn, f"{l}_sum_duplicates")(qd(s, d, l))), f"WITH {Q} SELECT * FROM Q")
    q(f"{_l}_canonicalize", lambda s, d, l=_l: _m(getattr(fn, f"{l}_canonicalize")(qd(s, d, l))), f"WITH {Q} SELECT * FROM Q")
    q(f"{_l}_sort_indices", lambda s, d, l=_l: _m(getattr(fn, f"{l}_sort_indices")(qd(s, d, l))), f"WITH {QD} SELECT * FROM Qd")
    for _to in ("coo", "csr", "csc"):
        if _to != _l:
            q(f"{_l}_to{_to}", lambda s, d, l=_l, to=_to: _m(getattr(qd(s, d, l), f"to{to}")(canonical=True)), f"WITH {Q} SELECT * FROM Q")
    q(f"{_l}_matmul_vector", lambda s, d, l=_l: _v((a := qd(s, d, l)) @ part_x(s, a.n_cols)), _MATVEC)
    q(f"{_l}_matmul_dense", lambda s, d, l=_l: _v((a := qd(s, d, l)) @ matrix_x(s, a.n_cols, 4)), _MM)
    q(f"{_l}_matmul_batch", lambda s, d, l=_l: _v((a := qd(s, d, l)) @ matrix_x(s, a.n_cols, 4, 2)), _BMM)
    q(f"{_l}_matmul_sparse", lambda s, d, l=_l: _m(a25(s, d, l) @ a25(s, d, l)), f"WITH {A} SELECT a.i, b.j, SUM(a.v * b.v) AS v FROM A a JOIN A b ON a.j = b.i GROUP BY a.i, b.j HAVING SUM(a.v * b.v) <> 0")
    q(f"{_l}_matmul_transpose", lambda s, d, l=_l: _v(getattr(fn, f"{l}_matmul_transpose")(a := qd(s, d, l), matrix_x(s, a.n_rows, 4))), _TMM)
    q(f"{_l}_add", lambda s, d, l=_l: _m((a := a25(s, d, l)) + a.T), _PLUS_T)
    q(f"{_l}_radd", lambda s, d, l=_l: _m(0 + a25(s, d, l)), _AA)
    q(f"{_l}_sub", lambda s, d, l=_l: _m((a := a25(s, d, l)) - a.T), _LESS_T)
    q(f"{_l}_rsub", lambda s, d, l=_l: _m(0 - a25(s, d, l)), _NEG)
    q(f"{_l}_neg", lambda s, d, l=_l: _m(-a25(s, d, l)), _NEG)
    q(f"{_l}_dot", lambda s, d, l=_l: (a := a25(s, d, l)).dot(a.T), f"WITH {A} SELECT COALESCE(SUM(a.v * b.v), 0.0) AS x FROM A a JOIN A b ON a.i = b.j AND a.j = b.i")
    q(f"{_l}_vdot", lambda s, d, l=_l: (c := _complex(s, d).asformat(l)).vdot(c.T).select(F.col("x.re").alias("re"), F.col("x.im").alias("im")), _SQL["vdot_complex"])
    q(f"{_l}_matvec_data_vjp", lambda s, d, l=_l: _m(D.matvec_data_vjp(a := qd(s, d, l).canonicalize(), part_x(s, a.n_cols), supp_y(s, a.n_rows))), _VJP_V)
    q(f"{_l}_matmul_data_vjp", lambda s, d, l=_l: _m(D.matmul_data_vjp(a := qd(s, d, l).canonicalize(), matrix_x(s, a.n_cols, 4), matrix_x(s, a.n_rows, 4))), _VJP_M)
    q(f"{_l}_rows_iterated", lambda s, d, l=_l: _unpacked(qd(s, d, l).tocsr(canonical=True).packed(), "i", "j"), f"WITH {Q} " + _PACKED.format(a="i", b="j"))
q("astype", lambda s, d: _c(a25(s, d).astype("complex64")), f"WITH {A} SELECT i, j, v AS re, 0.0::DOUBLE AS im FROM A")

# --- constructors and functions
_DENSE25 = f"WITH {A}, {NAT} SELECT r.n AS i, c.n AS k, COALESCE(v, 0.0) AS x FROM N r CROSS JOIN N c LEFT JOIN A ON i = r.n AND j = c.n"
_ABOVE = f"WITH {A} SELECT * FROM A WHERE v <> 0"


class _Triplets:
    """What other libraries give: shape, row, col and data."""

    def __init__(self, a: np.ndarray):
        self.shape, (self.row, self.col) = a.shape, np.nonzero(a)
        self.data = a[self.row, self.col]

    def tocoo(self) -> _Triplets:
        return self


q("from_dense", lambda s, d: _m(from_dense(s, a25(s, d).todense())), _ABOVE)
q("from_numpy", lambda s, d: _m(from_numpy(s, a25(s, d).todense().collect())), _ABOVE)
q("from_scipy", lambda s, d: _m(from_scipy(s, _Triplets(a25(s, d).todense().collect()))), _ABOVE)
q("asarray_dense", lambda s, d: _m(asarray(s, a25(s, d).todense().collect(), threshold=50.0)), f"WITH {A} SELECT * FROM A WHERE abs(v) > 50")
q("identity_like", lambda s, d: _m(fn.identity_like(a25(s, d))), _AA)
q("issparse", lambda s, d: s.createDataFrame([(issparse(a := a25(s, d)), issparse(a.todense()), issparse(3))], "matrix boolean, dense boolean, number boolean"), "SELECT true AS matrix, false AS dense, false AS number")
q("todense", lambda s, d: _v(fn.todense(a25(s, d))), _DENSE25)
q("diags_of_sums", lambda s, d: _m(diags(s, [a25(s, d).row_sums().collect(), np.ones(24)], [0, 1])), f"WITH {A}, {NAT}, R AS (SELECT i, SUM(v) AS s FROM A GROUP BY i) SELECT n AS i, n AS j, COALESCE(s, 0.0) AS v FROM N LEFT JOIN R ON n = i UNION ALL SELECT n, n + 1, 1.0 FROM N WHERE n < 24")
q("eye_of_parts", lambda s, d: _m(eye(s, n := _size(s, d, "part", "p_partkey"), n + 2, k=2)), "SELECT p_partkey AS i, p_partkey + 2 AS j, 1.0::DOUBLE AS v FROM part")
q("random_parts", _random_parts, "SELECT CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS places, true AS low, true AS high, true AS inside FROM (SELECT (SELECT COUNT(*) FROM supplier) * (SELECT COUNT(*) FROM part) // 20 AS n)")

# --- derivatives of batches, constructors and tangents
_BVJP = f"WITH {Q}, {_K}, B AS (SELECT * FROM range(2) r(b)) SELECT i, j, SUM(CAST((b + i + 2 * k) % 5 AS DOUBLE) * CAST((b + j + 2 * k) % 5 AS DOUBLE)) AS v FROM Q, K, B GROUP BY i, j"
q("batched_matmul_data_vjp", lambda s, d: _m(D.batched_data_vjp(a := qd(s, d).canonicalize(), matrix_x(s, a.n_cols, 4, 2), matrix_x(s, a.n_rows, 4, 2))), _BVJP)
q("batched_matvec_data_vjp", lambda s, d: _m(D.batched_data_vjp(a := qd(s, d).canonicalize(), _batched_x(s, a.n_cols), _batched_x(s, a.n_rows))), f"WITH {Q}, B AS (SELECT * FROM range(3) r(b)) SELECT i, j, SUM(CAST((b + i) % 5 AS DOUBLE) * CAST((b + j) % 5 AS DOUBLE)) AS v FROM Q, B GROUP BY i, j")
q("batched_rhs_vjp", lambda s, d: _v(D.rhs_vjp(a := qd(s, d), matrix_x(s, a.n_rows, 4, 2))), f"WITH {QD}, {_K}, B AS (SELECT * FROM range(2) r(b)), Y AS (SELECT b, j, k, SUM(v * CAST((b + i + 2 * k) % 5 AS DOUBLE)) AS y FROM Qd, K, B GROUP BY b, j, k) SELECT B.b, p_partkey AS i, K.k, COALESCE(y, 0.0) AS x FROM B CROSS JOIN part CROSS JOIN K LEFT JOIN Y ON p_partkey = j AND K.k = Y.k AND B.b = Y.b")
q("matmul_rhs_vjp", lambda s, d: _v(D.rhs_vjp(a := qd(s, d), matrix_x(s, a.n_rows, 4))), _TMM)
q("matmul_jvp", lambda s, d: _v(D.matmul_jvp(a := qd(s, d), 2 * a, x := matrix_x(s, a.n_cols, 4), x)), f"SELECT i, k, 3 * x AS x FROM ({_MM})")
q("batched_jvp", lambda s, d: _v(D.batched_jvp(a := qd(s, d), 2 * a, x := matrix_x(s, a.n_cols, 4, 2), x)), f"SELECT b, i, k, 3 * x AS x FROM ({_BMM})")
q("transpose_jvp", lambda s, d: _v(D.transpose_jvp(a := qd(s, d), 2 * a, y := supp_y(s, a.n_rows), y)), f"SELECT i, 3 * x AS x FROM ({_TVEC})")
q("todense_jvp", lambda s, d: _v(D.todense_jvp(a25(s, d))), _DENSE25)
q("row_sums_jvp", lambda s, d: _v(D.row_sums_jvp(qd(s, d))), _ROWS)
q("col_sums_jvp", lambda s, d: _v(D.col_sums_jvp(qd(s, d))), _COLS)
q("diagonal_jvp", lambda s, d: _v(D.diagonal_jvp(qd(s, d))), _SQL["coo_diagonal"])
q("trace_jvp", lambda s, d: D.trace_jvp(qd(s, d)), _SQL["coo_trace"])
_GRID = "{f} AS (SELECT i, j, CAST((i + 2 * j) % 5 AS DOUBLE) AS v FROM range({m}) r(i), range({n}) c(j))"


def _grid(s: SparkSession, m: int, n: int) -> SparseMatrix:
    """A full matrix, v = (i + 2 j) mod 5."""
    cells = s.range(m * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j")).withColumn("v", ((F.col("i") + 2 * F.col("j")) % 5).cast("double"))
    return coo_array(cells, (m, n), canonical=True)


q("kron_vjp_left", lambda s, d: _m(D.kron_vjp(a := a25(s, d), _coarse(a), _grid(s, 125, 125))[0]), f"WITH {A}, {P5} SELECT A.i, A.j, SUM(P.v * CAST((A.i * 5 + P.i + 2 * (A.j * 5 + P.j)) % 5 AS DOUBLE)) AS v FROM A, P GROUP BY A.i, A.j")
q("kron_vjp_right", lambda s, d: _m(D.kron_vjp(a := a25(s, d), _coarse(a), _grid(s, 125, 125))[1]), f"WITH {A}, {P5} SELECT P.i, P.j, SUM(A.v * CAST((A.i * 5 + P.i + 2 * (A.j * 5 + P.j)) % 5 AS DOUBLE)) AS v FROM A, P GROUP BY P.i, P.j")
q("kron_jvp", lambda s, d: _m(D.kron_jvp(a := a25(s, d), 2 * a, p := _coarse(a), p)), f"WITH {A}, {P5} SELECT A.i * 5 + P.i AS i, A.j * 5 + P.j AS j, 3 * A.v * P.v AS v FROM A CROSS JOIN P")
_PART = "SELECT i, j, CAST((i + {r} + 2 * (j + {c})) % 5 AS DOUBLE) AS v FROM A"
for _name, _f in (("block_array", D.block_array_vjp), ("bmat", D.bmat_vjp)):
    q(f"{_name}_vjp", lambda s, d, f=_f: _m(f([[a := a25(s, d), None], [None, a]], _grid(s, 50, 50))[1][1]), f"WITH {A} " + _PART.format(r=25, c=25))
    q(f"{_name}_jvp", lambda s, d, f=_f: _m(D.block_array_jvp([[a := a25(s, d), None], [a, None]])), f"WITH {A} SELECT * FROM A UNION ALL SELECT i + 25, j, v FROM A")
q("block_diag_vjp", lambda s, d: _m(D.block_diag_vjp([a := a25(s, d), a], _grid(s, 50, 50))[1]), f"WITH {A} " + _PART.format(r=25, c=25))
q("block_diag_jvp", lambda s, d: _m(D.block_diag_jvp([a := a25(s, d), a.T])), _SQL["block_diag"])
q("vstack_vjp", lambda s, d: _m(D.vstack_vjp([a := a25(s, d), a], _grid(s, 50, 25))[1]), f"WITH {A} " + _PART.format(r=25, c=0))
q("vstack_jvp", lambda s, d: _m(D.vstack_jvp([a := a25(s, d), a])), _SQL["vstack"])
q("hstack_vjp", lambda s, d: _m(D.hstack_vjp([a := a25(s, d), a], _grid(s, 25, 50))[1]), f"WITH {A} " + _PART.format(r=0, c=25))
q("hstack_jvp", lambda s, d: _m(D.hstack_jvp([a := a25(s, d), a])), _SQL["hstack"])
q("diags_vjp", lambda s, d: _v(D.diags_vjp([0, 2], [25, 23], a25(s, d))[1]), f"WITH {A}, {NAT} SELECT n AS i, COALESCE(v, 0.0) AS x FROM N LEFT JOIN A ON i = n AND j = n + 2 WHERE n < 23")
q("diags_jvp", lambda s, d: _m(D.diags_jvp(s, [a25(s, d).diagonal().collect()], [0])), f"WITH {A}, {NAT} SELECT n AS i, n AS j, COALESCE(v, 0.0) AS v FROM N LEFT JOIN A ON i = n AND j = n")
q("vmap_matvec", lambda s, d: _v(D.vmap((a := qd(s, d)).matvec)(_batched_x(s, a.n_cols))), _BMV)
q("vmap_matmul", lambda s, d: _v(D.vmap((a := qd(s, d)).matmul)(matrix_x(s, a.n_cols, 4, 2))), _BMM)

# --- operators without a matrix, preconditioners, reports


def _operator(s: SparkSession, d: str) -> L.LinearOperator:
    return L.aslinearoperator(qd(s, d).canonicalize().persist())


q("linear_operator_matvec", lambda s, d: _v((o := _operator(s, d)).matvec(part_x(s, o.shape[1]))), _MATVEC)
q("linear_operator_matmat", lambda s, d: _v((o := _operator(s, d)).matmat(matrix_x(s, o.shape[1], 4))), _MM)
q("linear_operator_rmatvec", lambda s, d: _v((o := _operator(s, d)).rmatvec(supp_y(s, o.shape[0]))), _TVEC)
q("linear_operator_matmul", lambda s, d: _v((o := _operator(s, d)) @ part_x(s, o.shape[1])), _MATVEC)
q("linear_operator_t", lambda s, d: _v((o := _operator(s, d)).T @ supp_y(s, o.shape[0])), _TVEC)
q("linear_operator_h", lambda s, d: _v((o := _operator(s, d)).H @ supp_y(s, o.shape[0])), _TVEC)


def _free(solver: Callable, make: Callable) -> Query:
    """The solver on a callable product only."""

    def run(s: SparkSession, d: str) -> DataFrame:
        a = make(s, d)
        m = a.todense().collect()
        b = m @ part_x(s, 25).collect()
        return _rounded(dense(s, solver(L.LinearOperator(m.shape, lambda x: m @ x), b, rtol=1e-12)[0]))

    return run


q("bicgstab_matrix_free", _free(L.bicgstab, general), _KNOWN)
q("gmres_matrix_free", _free(L.gmres, general), _KNOWN)


def _divide(a: SparseMatrix) -> Callable:
    """A user's inverse: by the diagonal."""
    diagonal = a.diagonal().collect()
    return lambda r: r / diagonal


q("cg_callable", _solved(spd, lambda a, b: L.cg(a, b, rtol=1e-12, M=_divide(a))), _KNOWN)
q("bicgstab_callable", _solved(general, lambda a, b: L.bicgstab(a, b, rtol=1e-12, M=_divide(a))), _KNOWN)
q("gmres_callable", _solved(general, lambda a, b: L.gmres(a, b, rtol=1e-12, M=_divide(a))), _KNOWN)
q("cg_identity", _solved(spd, lambda a, b: L.cg(a, b, rtol=1e-12, M=P.identity(a))), _KNOWN)
q("gmres_from_factorized", _solved(general, lambda a, b: L.gmres(a, b, rtol=1e-10, M=P.from_factorized(L.factorized(a)))), _KNOWN)
q("minres_jacobi", _solved(spd, lambda a, b: L.minres(a, b, rtol=1e-12, M=P.jacobi(a))), _KNOWN)
q("cholesky_solve", _solved(spd, lambda a, b: L.sparse_cholesky(a).solve(b)), _KNOWN)
q("lu_solve", _solved(general, lambda a, b: L.sparse_lu(a).solve(b)), _KNOWN)
q("spsolve_triangular_analyzed", _solved(lambda s, d: spd(s, d).tril(), lambda a, b: L.spsolve_triangular(a, b, analyzed=L.analyze_triangular(a))), _KNOWN)
q("spsolve_triangular_levels", _solved(lambda s, d: spd(s, d).tril(), lambda a, b: L.spsolve_triangular(a, b, distributed=True)), _KNOWN)
_PART_X = "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS x FROM nation"
q("identity_apply", lambda s, d: _v(P.identity(a25(s, d)).solve(part_x(s, 25))), _PART_X)
q("callable_apply", lambda s, d: _v(P.aspreconditioner(lambda r: dense(s, 2 * r.collect()), a25(s, d)).solve(part_x(s, 25))), f"SELECT i, 2 * x AS x FROM ({_PART_X})")


def _reported(s: SparkSession, d: str) -> DataFrame:
    a, heard = spd(s, d), []
    b = a.matvec(part_x(s, 25))
    _, info = L.cg(a, b, rtol=1e-10, return_info=True, callback=lambda x: heard.append(1))
    _, short = L.cg(a, b, rtol=1e-14, maxiter=1, return_info=True)
    _, bad = L.cg(-1.0 * a, b, return_info=True)
    return s.createDataFrame([(info.status, info.converged, info.residual_norm >= 0, len(heard), short.status, bad.status)], "status int, converged boolean, finite boolean, callbacks int, at_limit int, not_positive int")


q("solver_info", _reported, "SELECT 0 AS status, true AS converged, true AS finite, 1 AS callbacks, 1 AS at_limit, -2 AS not_positive")


def _options(s: SparkSession, d: str) -> DataFrame:
    """Options, devices and capabilities of the session, and what they are again after a block."""
    before = get_config("factor_rows")
    with config_context(factor_rows=7):
        inside = get_config("factor_rows")
    use_cpu()
    facts = (inside, get_config("factor_rows") == before, is_available(), has_capability("cpu"), capabilities.status("metal"), runtime.resolve_n_threads() > 0, runtime.info()["spark"] == s.version, runtime.resolve_spgemm_threads() == runtime.resolve_solver_threads())
    return s.createDataFrame([facts], "inside int, restored boolean, available boolean, cpu boolean, metal string, threads boolean, version boolean, equal_threads boolean")


q("config", _options, "SELECT 7 AS inside, true AS restored, true AS available, true AS cpu, 'not_built' AS metal, true AS threads, true AS version, true AS equal_threads")

# --- spectra of matrices from the tables: with as many steps as rows, what SQL can say of all values together


def _rounded_sums(s: SparkSession, values: np.ndarray, per: float) -> DataFrame:
    x = np.asarray(values, complex) / per
    return s.createDataFrame([(len(x), round(float(x.sum().real), 4), round(float((x**2).sum().real), 4))], "n long, total double, squares double")


def _quantity(s: SparkSession, d: str) -> float:
    return _t(s, d, "lineitem").agg(F.sum("l_quantity")).first()[0]


_ALL = "(SELECT SUM(l_quantity) FROM lineitem)"
_TRACE_S = f"WITH {S2} SELECT CAST(25 AS BIGINT) AS n, ROUND(SUM(CASE WHEN i = j THEN v ELSE 0 END) / {_ALL}, 4) AS total, ROUND(SUM(v * v) / {_ALL} / {_ALL}, 4) AS squares FROM S"
_NOISE = np.random.default_rng(5).standard_normal(25)
q("eigsh_nations", lambda s, d: _rounded_sums(s, L.eigsh(spd(s, d), 25, ncv=25, v0=_NOISE, return_eigenvectors=False), _quantity(s, d)), _TRACE_S)
q("lanczos_nations", lambda s, d: _rounded_sums(s, np.linalg.eigvalsh(_tridiagonal(*L.lanczos(spd(s, d), 25, v0=_NOISE, return_basis=False))), _quantity(s, d)), _TRACE_S)
q("arnoldi_nations", lambda s, d: _rounded_sums(s, np.linalg.eigvals(L.arnoldi(spd(s, d), 25, v0=_NOISE)[0]), _quantity(s, d)), _TRACE_S)
q("eigs_nations", lambda s, d: _rounded_sums(s, L.eigs(spd(s, d), 25, ncv=25, v0=_NOISE, return_eigenvectors=False), _quantity(s, d)), _TRACE_S)
q("svds_nations", lambda s, d: s.createDataFrame([(round(float((L.svds(a25(s, d).persist(), 25, ncv=25, v0=_NOISE, return_singular_vectors=False) ** 2).sum()) / _quantity(s, d) ** 2, 6),)], "squares double"), f"WITH {A} SELECT ROUND(SUM(v * v) / {_ALL} / {_ALL}, 6) AS squares FROM A")
q("normal_lanczos_nations", lambda s, d: s.createDataFrame([(round(float(L.normal_lanczos(a25(s, d).persist(), 25, v0=_NOISE)[0].sum()) / _quantity(s, d) ** 2, 6),)], "squares double"), f"WITH {A} SELECT ROUND(SUM(v * v) / {_ALL} / {_ALL}, 6) AS squares FROM A")


def _tridiagonal(alphas: np.ndarray, betas: np.ndarray) -> np.ndarray:
    n = len(alphas)
    return np.diag(alphas) + np.diag(betas[: n - 1], 1) + np.diag(betas[: n - 1], -1)


q("gram_leading", lambda s, d: _leading(s, d), f"WITH {A}, G AS (SELECT a.i, b.i AS j, SUM(a.v * b.v) AS v FROM A a JOIN A b ON a.j = b.j GROUP BY a.i, b.i) SELECT CAST(25 AS BIGINT) AS n, ROUND(SUM(CASE WHEN i = j THEN v ELSE 0 END) / {_ALL} / {_ALL}, 6) AS trace FROM G")


def _leading(s: SparkSession, d: str) -> DataFrame:
    g = a25(s, d).gram()
    return g.trace().select(F.lit(25).cast("long").alias("n"), F.round(F.col("x") / _quantity(s, d) ** 2, 6).alias("trace"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from . import queries_large  # noqa: E402, F401 - registers its own; needs the matrices above
