"""Queries of solvers whose matrix stays in tables and tasks: every limit of what one machine may hold is set below its size.

S is supplier by supplier: the products of the suppliers' quantities (Q Q.T) with a heavy diagonal. D is its lower
triangle with one more far cell a row, and P part by nation with the quantities that its suppliers ship, with one row
more for each nation so that its columns are independent."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linalg as L
from .config import ConfigManager, config, config_context, runtime, set_config, use_device, use_gpu
from .linalg import preconditioners as P
from .operators import tape
from .operators.assembly import add, vstack
from .operators.dense import Dense
from .operators.matrix import SparseMatrix
from .plans.lineage import cut, release
from .queries import A, Q, X, _m, _rounded, _size, _t, a25, general, part_x, q, qd
from .sources.construct import coo_array, identity
from .sources.row_blocks import RowBlocks

#: Far below every matrix here, so that none of them may be collected or factorised on one machine.
LIMITS = {"local_rows": 4, "local_cells": 4, "factor_rows": 4}


def suppliers(s: SparkSession, d: str) -> SparseMatrix:
    """Symmetric, strictly diagonally dominant."""
    g = qd(s, d).gram(written=True)
    heavy = g.row_sums().df.select("i", F.col("i").alias("j"), (F.col("x") + 1).alias("v"))
    # only the diagonal is summed and written: the other cells are read where the Gram matrix has them
    diagonal = add(g._like(g.df.filter("i = j")), g._like(heavy, canonical=True)).persist()
    cells = g.df.filter("i != j").select("i", "j", "v").union(diagonal.df.select("i", "j", "v"))
    out = diagonal._like(cells, canonical=True, stored=cells.count())
    out.files = (g.df, diagonal.df)
    return out


def shipped(s: SparkSession, d: str) -> SparseMatrix:
    """Part by nation, and below it the identity."""
    rows = _t(s, d, "lineitem").join(_t(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("i"), F.col("s_nationkey").alias("j"), F.col("l_quantity").alias("v"))
    return vstack([coo_array(rows, (_size(s, d, "part", "p_partkey"), 25)), identity(s, 25).tocoo()]).canonicalize().persist()


GRAM = f"{Q}, G AS (SELECT a.i, b.i AS j, SUM(a.v * b.v) AS v FROM Q a JOIN Q b ON a.j = b.j GROUP BY a.i, b.i), R AS (SELECT s_suppkey AS i, COALESCE(s, 0) + 1 AS s FROM supplier LEFT JOIN (SELECT i, SUM(v) AS s FROM G GROUP BY i) t ON s_suppkey = i), S AS (SELECT i, j, SUM(v) AS v FROM (SELECT * FROM G UNION ALL SELECT i, i, s FROM R) GROUP BY i, j)"
SHIPPED = "P AS (SELECT l_partkey AS i, CAST(s_nationkey AS BIGINT) AS j, SUM(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
_KNOWN = "SELECT s_suppkey AS i, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS x FROM supplier"
_KNOWN_P = "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS x FROM nation"


def limited(f: Callable) -> Callable:
    """The query with no matrix of its own fitting one machine."""

    def run(s: SparkSession, d: str) -> DataFrame:
        with config_context(**LIMITS):
            return f(s, d)

    return run


def _solved(make: Callable, solve: Callable) -> Callable:
    """The solution for a right-hand side that is made from a known one, (i mod 7) + 1."""

    def run(s: SparkSession, d: str) -> DataFrame:
        a = make(s, d)
        x = solve(a, a.matvec(part_x(s, a.n_cols)))
        x = x[0] if isinstance(x, tuple) else x
        return _rounded(x)

    return limited(run)


# --- QR by a reduction tree
_GRAM_P = f"WITH {SHIPPED} SELECT i, j, ROUND(SUM(v), 3) AS v FROM (SELECT a.j AS i, b.j, a.v * b.v AS v FROM P a JOIN P b ON a.i = b.i UNION ALL SELECT n_nationkey, n_nationkey, 1.0 FROM nation) GROUP BY i, j"


def _triangle(s: SparkSession, d: str) -> DataFrame:
    """R.T R, which must be the matrix's own."""
    r = L.factorized(shipped(s, d), method="qr").factor.R
    i, j = np.nonzero(r)
    m = coo_array(s.createDataFrame([(int(x), int(y), float(r[x, y])) for x, y in zip(i, j, strict=True)], "i long, j long, v double"), r.shape, canonical=True)
    return (m.T @ m).df.select("i", "j", F.round("v", 3).alias("v")).filter("v != 0")


q("tall_qr", limited(_triangle), _GRAM_P)
q("tall_qr_solve", _solved(shipped, lambda a, b: L.factorized(a, method="qr").solve(b)), _KNOWN_P)
q("tall_normal_solve", _solved(shipped, lambda a, b: L.factorized(a, method="cholesky_ata").solve(b)), _KNOWN_P)


def _orthogonal(s: SparkSession, d: str) -> DataFrame:
    """Q.T Q of the orthogonal factor, from its rows."""
    x = L.factorized(shipped(s, d), method="qr").factor.Q.df
    y = x.select("i", F.col("k").alias("j"), F.col("x").alias("y"))
    return x.join(y, "i").groupBy(F.col("k").alias("i"), "j").agg(F.abs(F.round(F.sum(F.col("x") * F.col("y")), 6)).alias("v"))


q("tall_orthogonal", limited(_orthogonal), "SELECT CAST(a.n_nationkey AS BIGINT) AS i, CAST(b.n_nationkey AS BIGINT) AS j, CASE WHEN a.n_nationkey = b.n_nationkey THEN 1.0 ELSE 0.0 END AS v FROM nation a CROSS JOIN nation b")


def _regressed(s: SparkSession, d: str) -> DataFrame:
    """Retail prices of parts by what nations ship: the residual must be orthogonal to every column."""
    a = shipped(s, d)
    n = a.n_rows - 25
    price = _t(s, d, "part").select(F.col("p_partkey").cast("long").alias("i"), F.col("p_retailprice").cast("double").alias("x")).union(s.range(25).select((F.col("id") + n).alias("i"), F.lit(0.0).alias("x")))
    b = Dense(price, (a.n_rows,))
    x, norm = L.least_squares(a, b)
    rest = b.df.select("i", "x").union(a.matvec(x).df.select("i", -F.col("x"))).groupBy("i").agg(F.sum("x").alias("x"))
    off = a.matvec_transpose(Dense(rest, b.shape)).df.agg(F.max(F.abs("x")).alias("off"))
    total = rest.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    scale = a.df.agg(F.max(F.abs("v")).alias("scale"))
    return off.crossJoin(total).crossJoin(scale).select((F.col("off") < 1e-9 * F.col("scale") * F.col("norm")).alias("orthogonal"), (F.abs(F.col("norm") - float(norm)) <= 1e-9 * F.col("norm")).alias("norm_is_that_of_r"), F.lit(n).cast("long").alias("parts"))


q("least_squares", limited(_regressed), "SELECT true AS orthogonal, true AS norm_is_that_of_r, COUNT(*) AS parts FROM part")

# --- factors by fronts
_S = f"WITH {GRAM} SELECT i, j, ROUND(v, 2) AS v FROM S"


def _again(s: SparkSession, d: str) -> DataFrame:
    a = suppliers(s, d)
    low = L.sparse_cholesky(a).L
    release(*a.files)  # the factor holds what is needed
    return low.gram().df.select("i", "j", F.round("v", 2).alias("v")).filter("v != 0")


def _again_lu(s: SparkSession, d: str) -> DataFrame:
    a = suppliers(s, d)
    f = L.sparse_lu(a)
    release(*a.files)
    rows = f.perm_frame.select(F.col("i").alias("at"), "src")
    return (f.L.persist() @ f.U.persist()).df.withColumnRenamed("i", "at").join(rows, "at").select(F.col("src").alias("i"), "j", F.round("v", 2).alias("v")).filter("v != 0")


q("front_cholesky", limited(_again), _S)
q("front_lu", limited(_again_lu), _S)
q("front_cholesky_solve", _solved(suppliers, lambda a, b: L.factorized(a, method="cholesky").solve(b)), _KNOWN)
q("front_spsolve", _solved(suppliers, L.spsolve), _KNOWN)
q("gmres_exact_fronts", _solved(suppliers, lambda a, b: L.gmres(a, b, rtol=1e-10, M=P.exact(a, method="cholesky"))), _KNOWN)

# --- incomplete factors by sweeps, triangles by blocks


def _on_pattern(s: SparkSession, d: str) -> DataFrame:
    """L U on the stored places, which must be the matrix."""
    a = suppliers(s, d)
    m = P.ilu0(a)
    return (m.L.persist() @ m.U.persist()).df.join(a.df.select("i", "j"), ["i", "j"]).select("i", "j", F.round("v", 2).alias("v"))


q("ilu0_sweeps", limited(_on_pattern), _S)
q("bicgstab_ilu0_sweeps", _solved(suppliers, lambda a, b: L.bicgstab(a, b, rtol=1e-10, M=P.ilu0(a))), _KNOWN)
q("cg_ichol0_sweeps", _solved(suppliers, lambda a, b: L.cg(a, b, rtol=1e-10, M=P.ichol0(a))), _KNOWN)
q("triangular_blocks", _solved(lambda s, d: suppliers(s, d).tril(), lambda a, b: L.BlockTriangular(a, block=16).solve(b)), _KNOWN)
q("triangular_blocks_upper", _solved(lambda s, d: suppliers(s, d).triu(), lambda a, b: L.spsolve_triangular(a, b, lower=False)), _KNOWN)


def _chain(s: SparkSession, d: str) -> DataFrame:
    """Each part's quantity less half of the solution at the part before: a bidiagonal system of all parts."""
    n = _size(s, d, "part", "p_partkey")
    own = s.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    before = s.range(1, n).select(F.col("id").alias("i"), (F.col("id") - 1).alias("j"), F.lit(0.5).alias("v"))
    return _rounded(L.spsolve_triangular(coo_array(own.union(before), (n, n), canonical=True), qd(s, d).col_sums()), 6)


_CHAIN = """WITH RECURSIVE B AS (SELECT p_partkey AS i, COALESCE(y, 0.0) AS b FROM part LEFT JOIN (SELECT l_partkey, SUM(l_quantity) AS y FROM lineitem GROUP BY 1) t ON l_partkey = p_partkey),
C AS (SELECT CAST(0 AS BIGINT) AS i, b AS x FROM B WHERE i = 0 UNION ALL SELECT B.i, B.b - 0.5 * C.x FROM C JOIN B ON B.i = C.i + 1) SELECT i, ROUND(x, 6) AS x FROM C"""
q("triangular_chain", limited(_chain), _CHAIN)

# --- spectra: the leading value is held against power iteration in SQL, every pair by its residual


def _power(matrix: str, steps: int, symmetric: bool = True) -> str:
    """The leading eigenvalue of the table of that name, by so many products."""
    xs = [f"X0 AS MATERIALIZED (SELECT DISTINCT i, CAST(1.0 AS DOUBLE) AS x FROM {matrix})"]
    xs += [f"X{t} AS MATERIALIZED (SELECT m.i, SUM(m.v * p.x) / 1e6 AS x FROM {matrix} m JOIN X{t - 1} p ON m.j = p.i GROUP BY m.i)" for t in range(1, steps + 1)]
    a, b = f"X{steps - 1}", f"X{steps}"
    ratio = f"(SELECT SUM(a.x * b.x) / SUM(a.x * a.x) FROM {a} a JOIN {b} b ON a.i = b.i)" if symmetric else f"(SELECT SUM(x) FROM {b}) / (SELECT SUM(x) FROM {a})"
    return ", ".join(xs) + f", L AS (SELECT 1e6 * {ratio} AS lead)"


def _spectrum(s: SparkSession, values: np.ndarray, off: float, most: float = 1e-6) -> DataFrame:
    """The first value, to eight digits of its size, how many there are, and whether all residuals are small."""
    lead = float(np.real(values[0]))
    digits = 8 - int(np.ceil(np.log10(abs(lead))))
    return s.createDataFrame([(round(lead, digits), len(values), bool(off < most))], "lead double, n long, settled boolean")


_ROUNDED = "ROUND(lead, CAST(8 - CEIL(LOG10(lead)) AS INTEGER)) AS lead"


def _quantities(s: SparkSession, d: str) -> SparseMatrix:
    return qd(s, d).canonicalize().persist()


def _eigsh(s: SparkSession, d: str) -> DataFrame:
    g = qd(s, d).gram(written=True)
    k = min(4, g.n_rows - 1)
    values, vectors = L.eigsh(g, k, ncv=min(g.n_rows, 10), tol=1e-9)
    v = vectors.collect()  # suppliers by four
    off = np.abs(g.matmul(v).collect() - v * values).max() / values[0]
    return _spectrum(s, values, off)


def _eigsh_frames(s: SparkSession, d: str) -> DataFrame:
    a = _quantities(s, d)
    ones = part_x(s, a.n_rows).df.select("i", F.lit(1.0).alias("x"))
    values = L.eigsh(L.gram_operator(a), 1, ncv=5, tol=1e-8, v0=Dense(ones, (a.n_rows,)), return_eigenvectors=False, distributed=True)
    return _spectrum(s, values, 0.0)


def _svds(s: SparkSession, d: str, sampled: bool) -> DataFrame:
    a = _quantities(s, d)
    if sampled:
        got = L.sampled_svds(a, min(4, a.n_rows - 1), power=3)
        left, sigma, right = got.left, got.values, got.right
    else:
        left, sigma, right = L.svds(a, min(4, a.n_rows - 1), ncv=min(a.n_rows, 10), tol=1e-9)
    # the leading triple, as frames: A v - sigma u
    of = lambda x: Dense(x.df.filter("k = 0").select("i", "x"), x.shape[:1])
    rest = a.matvec(of(right)).df.select("i", "x").union(of(left).df.select("i", F.lit(-float(sigma[0])) * F.col("x"))).groupBy("i").agg(F.sum("x").alias("x"))
    return _spectrum(s, sigma, rest.agg(F.max(F.abs("x"))).first()[0] / sigma[0], 1e-3 if sampled else 1e-6)


def _eigs(s: SparkSession, d: str) -> DataFrame:
    a = a25(s, d).persist()
    values, vectors = L.eigs(a, 2, ncv=9, tol=1e-9)
    off = np.abs(a.matmul(vectors.real).collect() + 1j * a.matmul(vectors.imag).collect() - vectors * values).max() / abs(values[0])
    return _spectrum(s, values, off)


_FOUR = "(SELECT LEAST(4, COUNT(*) - 1) FROM supplier) AS n, true AS settled FROM L"
_G = "G AS MATERIALIZED (SELECT a.i, b.i AS j, SUM(a.v * b.v) AS v FROM Q a JOIN Q b ON a.j = b.j GROUP BY a.i, b.i)"
_LEADING = f"WITH {Q}, {_G}, {_power('G', 12)} SELECT {_ROUNDED}, "
_SINGULAR = f"WITH {Q}, {_G}, {_power('G', 12).replace('SELECT 1e6 *', 'SELECT SQRT(1e6 *').replace('AS lead)', ') AS lead)')} SELECT {_ROUNDED}, "
q("eigsh_restarted", _eigsh, _LEADING + _FOUR)
q("eigsh_frames", limited(_eigsh_frames), _LEADING + "CAST(1 AS BIGINT) AS n, true AS settled FROM L")
q("svds_restarted", lambda s, d: _svds(s, d, False), _SINGULAR + _FOUR)
q("svds_sampled", limited(lambda s, d: _svds(s, d, True)), _SINGULAR + _FOUR)
q("eigs_restarted", _eigs, f"WITH {A}, {_power('A', 30, symmetric=False)} SELECT {_ROUNDED}, CAST(2 AS BIGINT) AS n, true AS settled FROM L")

# --- gradients of composed expressions


def _tape_norm(s: SparkSession, d: str) -> DataFrame:
    """|Q.T (Q x)|^2 by Q, which stands in both products, at its stored places."""
    a = tape.variable(_quantities(s, d))
    x = tape.variable(part_x(s, a.shape[1]))
    (g,) = tape.gradients((a.T @ (a @ x)).square(), [a])
    return _m(g)


_FORWARD = f"{Q}, {X}, Y AS MATERIALIZED (SELECT i, SUM(v * x) AS y FROM Q JOIN X USING (j) GROUP BY i), Z AS MATERIALIZED (SELECT j, 2 * SUM(v * y) AS z FROM Q JOIN Y USING (i) GROUP BY j), W AS MATERIALIZED (SELECT i, SUM(v * z) AS w FROM Q JOIN Z USING (j) GROUP BY i)"
q("tape_norm", _tape_norm, f"WITH {_FORWARD} SELECT i, j, y * z + w * x AS v FROM Q JOIN X USING (j) JOIN Y USING (i) JOIN Z USING (j) JOIN W USING (i)")


def _tape_stack(s: SparkSession, d: str) -> DataFrame:
    """The squares of A and A.T below each other times x, by x."""
    a = tape.variable(a25(s, d).persist())
    x = tape.variable(part_x(s, 25))
    (g,) = tape.gradients((tape.vstack([a, a.T]) @ x).square(), [x])
    return g.df.select("i", "x")


_N = "X25 AS (SELECT CAST(n_nationkey AS BIGINT) AS j, CAST(n_nationkey % 7 + 1 AS DOUBLE) AS x FROM nation)"
q("tape_stack", _tape_stack, f"""WITH {A}, {_N}, M AS (SELECT i, j, v FROM A UNION ALL SELECT j + 25, i, v FROM A), Y AS (SELECT i, 2 * SUM(v * x) AS y FROM M JOIN X25 USING (j) GROUP BY i),
G AS (SELECT j, SUM(v * y) AS g FROM M JOIN Y USING (i) GROUP BY j) SELECT X25.j AS i, COALESCE(g, 0.0) AS x FROM X25 LEFT JOIN G USING (j)""")

# --- blocks of rows: the second product of each, whose plan sends no cell
_ROW_SQL = f"WITH {Q}, {X}, Y AS (SELECT i, SUM(v * x) AS y FROM Q JOIN X USING (j) GROUP BY i) SELECT s_suppkey AS i, COALESCE(y, 0.0) AS x FROM supplier LEFT JOIN Y ON s_suppkey = i"


def _row_blocks(s: SparkSession, d: str, broadcast: bool) -> DataFrame:
    a = _quantities(s, d)
    m = RowBlocks(a, cells=4096)
    release(a.df)  # the blocks hold it
    x = part_x(s, m.shape[1])
    m.matvec(x, broadcast=broadcast).df.count()
    out = cut(m.matvec(x, broadcast=broadcast).df.select("i", "x"), "result")
    m.drop()
    return out


q("row_blocks_matvec", limited(lambda s, d: _row_blocks(s, d, True)), _ROW_SQL)
q("row_blocks_matvec_halo", limited(lambda s, d: _row_blocks(s, d, False)), _ROW_SQL)


def _configured(s: SparkSession, d: str) -> DataFrame:
    """One system factorised on one machine and by fronts, as options say, and what devices there are."""
    a = general(s, d)
    use_device("cpu")
    try:
        use_gpu()
        gpu = True
    except RuntimeError:
        gpu = False
    with runtime.context(factor_rows=1_000):
        near = L.splu(a)
        set_config("factor_rows", 4)
        far = L.splu(a)
        patched = config.get("factor_rows")
    x = far.solve(a.matvec(part_x(s, 25)))
    facts = {"near": isinstance(near, L.SparseLU), "far": isinstance(far, L.FrontalLU), "gpu": gpu, "patched": patched == 4, "restored": config.get("factor_rows") == ConfigManager().get("factor_rows")}
    return _rounded(x).select("i", "x", *(F.lit(v).alias(n) for n, v in facts.items()))


q("configured_solve", _configured, f"SELECT *, true AS near, true AS far, false AS gpu, true AS patched, true AS restored FROM ({_KNOWN_P})")
