"""Factorisations and triangular solves.

Small matrices are factorised on one machine (option factor_rows, checked), larger ones by fronts, row blocks or a
reduction tree as tasks. Many small systems are solved side by side by solve_many, one group of rows per system."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import config
from ..operators.dense import Dense, dense
from ..operators.matrix import COOArray, SparseMatrix
from ..plans.lineage import cut, release
from .blocks import BlockTriangular
from .multifrontal import FrontalCholesky, FrontalLU
from .spaces import collected, fits
from .tsqr import TallQR, WideQR

EPS = np.finfo(float).eps
ALIASES = {"chol": "cholesky", "spd": "cholesky", "posdef": "cholesky", "least_squares": "qr", "normal_equations": "cholesky_ata"}


def _array(a: SparseMatrix) -> np.ndarray:
    if max(a.shape) > config.get("factor_rows"):
        raise ValueError(f"{a.shape} is beyond the option factor_rows ({config.get('factor_rows')}); use an iterative solver")
    out = np.zeros(a.shape)
    i, j, v = collected(a)
    out[i, j] = v
    return out


def _sparse(spark: SparkSession, m: np.ndarray) -> COOArray:
    import pandas as pd

    i, j = np.nonzero(m)
    df = spark.createDataFrame(pd.DataFrame({"i": i.astype(np.int64), "j": j.astype(np.int64), "v": m[i, j]}), "i long, j long, v double")
    return COOArray(df, m.shape, canonical=True, stored=len(i))


def _rhs(b: object) -> np.ndarray:
    return b.collect() if isinstance(b, Dense) else np.asarray(b, float)


class _Factor:
    def solve(self, b: object) -> Dense:
        return dense(self.spark, self.solve_array(_rhs(b)))


def _forward(m: np.ndarray, b: np.ndarray, unit: bool = False, lower: bool = True) -> np.ndarray:
    """Substitution, one or many right-hand sides."""
    x = np.array(b, float)
    n = len(x)
    for i in range(n) if lower else range(n - 1, -1, -1):
        row = m[i, :i] @ x[:i] if lower else m[i, i + 1 :] @ x[i + 1 :]
        x[i] -= row
        if not unit:
            x[i] /= m[i, i]
    return x


class SparseCholesky(_Factor):
    """A = L L.T, from the lower triangle."""

    def __init__(self, a: SparseMatrix):
        self.spark, self.shape = a.spark, a.shape
        if a.shape[0] != a.shape[1]:
            raise ValueError(f"the matrix must be square, got {a.shape}")
        m = _array(a)
        low = np.tril(m)
        try:
            self.array = np.linalg.cholesky(low + np.tril(m, -1).T)
        except np.linalg.LinAlgError as e:
            raise RuntimeError("a pivot is not positive") from e
        self.L = _sparse(a.spark, self.array)

    def solve_array(self, b: np.ndarray) -> np.ndarray:
        return _forward(self.array.T, _forward(self.array, b), lower=False)


class SparseLU(_Factor):
    """P A = L U with partial pivoting; perm[i] is the row of A that is row i of L U."""

    def __init__(self, a: SparseMatrix):
        self.spark, self.shape = a.spark, a.shape
        if a.shape[0] != a.shape[1]:
            raise ValueError(f"the matrix must be square, got {a.shape}")
        m, n = _array(a), a.n_rows
        perm, scale = np.arange(n), max(abs(m).max(initial=0.0), np.finfo(float).tiny)
        for k in range(n):
            p = k + int(abs(m[k:, k]).argmax())
            if abs(m[p, k]) <= EPS * scale:
                raise RuntimeError(f"pivot {k} is zero: the matrix is singular")
            if p != k:
                m[[k, p]], perm[[k, p]] = m[[p, k]], perm[[p, k]]
            m[k + 1 :, k] /= m[k, k]
            rows = np.flatnonzero(m[k + 1 :, k]) + k + 1
            m[rows, k + 1 :] -= m[rows, k][:, None] * m[k, k + 1 :]
        self.array, self.perm = m, perm
        self.L, self.U = _sparse(a.spark, np.tril(m, -1) + np.eye(n)), _sparse(a.spark, np.triu(m))

    @property
    def perm_frame(self) -> DataFrame:
        import pandas as pd

        return self.spark.createDataFrame(pd.DataFrame({"i": np.arange(len(self.perm)), "src": self.perm}), "i long, src long")

    def solve_array(self, b: np.ndarray) -> np.ndarray:
        return _forward(self.array, _forward(self.array, b[self.perm], unit=True), lower=False)


class _Orthogonal(_Factor):
    """Least squares by QR, or by the normal equations."""

    def __init__(self, a: SparseMatrix, normal: bool):
        self.spark, self.shape, self.array = a.spark, a.shape, _array(a)
        self.normal = normal
        self.q, self.r = np.linalg.qr(self.array) if not normal else (None, np.linalg.cholesky(self.array.T @ self.array))

    def solve_array(self, b: np.ndarray) -> np.ndarray:
        if self.normal:
            return _forward(self.r.T, _forward(self.r, self.array.T @ b), lower=False)
        if self.shape[0] < self.shape[1]:
            return np.linalg.lstsq(self.array, b, rcond=None)[0]
        return _forward(self.r, self.q.T @ b, lower=False)


class _LDLT(_Factor):
    """A = L D L.T without pivoting, for symmetric matrices."""

    def __init__(self, a: SparseMatrix):
        self.spark, self.shape = a.spark, a.shape
        m = _array(a)
        n = len(m)
        low, d = np.eye(n), np.zeros(n)
        for k in range(n):
            d[k] = m[k, k] - (low[k, :k] ** 2) @ d[:k]
            if abs(d[k]) <= EPS * max(1.0, abs(m[k]).sum()):
                raise RuntimeError(f"pivot {k} is zero")
            low[k + 1 :, k] = (m[k + 1 :, k] - low[k + 1 :, :k] @ (d[:k] * low[k, :k])) / d[k]
        self.array, self.d = low, d

    def solve_array(self, b: np.ndarray) -> np.ndarray:
        y = _forward(self.array, b, unit=True)
        return _forward(self.array.T, (y.T / self.d).T, unit=True, lower=False)


def _by_fronts(a: SparseMatrix, distributed: bool | None) -> bool:
    return max(a.shape) > config.get("factor_rows") if distributed is None else distributed


def sparse_cholesky(a: SparseMatrix, *, upper: bool = False, distributed: bool | None = None) -> SparseCholesky | FrontalCholesky:
    """Beyond the option factor_rows by fronts, as tasks."""
    if upper:
        raise NotImplementedError("only lower factors are made")
    return (FrontalCholesky if _by_fronts(a, distributed) else SparseCholesky)(a)


cholesky = sparse_cholesky


def sparse_lu(a: SparseMatrix, *, distributed: bool | None = None) -> SparseLU | FrontalLU:
    """Beyond the option factor_rows by fronts, as tasks, with exchanges of rows inside blocks."""
    return (FrontalLU if _by_fronts(a, distributed) else SparseLU)(a)


splu = sparse_lu


class FactorizedSolve:
    """A factorisation, kept for many right-hand sides."""

    def __init__(self, a: SparseMatrix, method: str, distributed: bool | None = None):
        self.shape, self.method = a.shape, method
        frames = {"lu": FrontalLU, "cholesky": FrontalCholesky, "qr": TallQR if a.shape[0] >= a.shape[1] else WideQR}
        self.distributed = _by_fronts(a, distributed) and method in (*frames, "cholesky_ata")
        if self.distributed:
            self.factor = frames["qr"](a, normal=True) if method == "cholesky_ata" else frames[method](a)
            return
        make = {"lu": SparseLU, "cholesky": SparseCholesky, "ldlt": _LDLT, "qr": lambda x: _Orthogonal(x, False), "cholesky_ata": lambda x: _Orthogonal(x, True)}
        if method not in make:
            raise ValueError(f"unknown method {method!r}")
        self.factor = make[method](a)

    def solve_array(self, b: np.ndarray) -> np.ndarray:
        if b.shape[0] != self.shape[0]:
            raise ValueError(f"expected {self.shape[0]} rows, got {b.shape[0]}")
        return self.factor.solve(b).collect() if self.distributed else self.factor.solve_array(b)

    def solve(self, b: object) -> Dense:
        return self.factor.solve(b) if self.distributed else dense(self.factor.spark, self.solve_array(_rhs(b)))

    __call__ = solve


def factorized(a: SparseMatrix, *, method: str = "auto", distributed: bool | None = None) -> FactorizedSolve:
    """distributed: factors as tables and tasks instead of one machine's arrays; by default beyond the option factor_rows."""
    method = ALIASES.get(method, method)
    if method == "auto":
        method = "lu" if a.shape[0] == a.shape[1] else "qr"
    return FactorizedSolve(a, method, distributed)


def spsolve(a: SparseMatrix, b: object, *, distributed: bool | None = None) -> Dense:
    return factorized(a, method="lu", distributed=distributed).solve(b)


class TriangularAnalysis:
    """What many solves with one triangular matrix share: its cells in row order, checked."""

    def __init__(self, a: SparseMatrix, lower: bool = True):
        if a.shape[0] != a.shape[1]:
            raise ValueError(f"the matrix must be square, got {a.shape}")
        self.shape, self.lower = a.shape, lower
        self.i, self.j, self.v = collected(a)
        if not ((self.j <= self.i) if lower else (self.j >= self.i)).all():
            raise ValueError("the matrix has cells on the other side of the diagonal")
        self.edges = np.searchsorted(self.i, np.arange(a.n_rows + 1))

    def solve_array(self, b: np.ndarray, unit_diagonal: bool = False) -> np.ndarray:
        x, n = np.array(b, float), self.shape[0]
        for r in range(n) if self.lower else range(n - 1, -1, -1):
            cols, vals = self.j[self.edges[r] : self.edges[r + 1]], self.v[self.edges[r] : self.edges[r + 1]]
            off = cols != r
            x[r] -= vals[off] @ x[cols[off]]
            if not unit_diagonal:
                d = vals[~off]
                if not len(d) or abs(d[0]) <= EPS:
                    raise RuntimeError(f"row {r} has no diagonal")
                x[r] /= d[0]
        return x


def analyze_triangular(a: SparseMatrix, *, lower: bool = True, unit_diagonal: bool = False, distributed: bool | None = None) -> TriangularAnalysis | BlockTriangular:
    """What solves with this matrix share; in a distributed one, unit_diagonal is part of it."""
    if fits(a) if distributed is None else not distributed:
        return TriangularAnalysis(a, lower)
    return BlockTriangular(a, lower=lower, unit_diagonal=unit_diagonal)


def spsolve_triangular(a: SparseMatrix, b: object, *, lower: bool = True, unit_diagonal: bool = False, analyzed: TriangularAnalysis | BlockTriangular | None = None, distributed: bool | None = None) -> Dense:
    """Substitution: row by row on one machine where the matrix fits it, otherwise by blocks of rows.

    analyzed: analyze_triangular of this matrix, for many right-hand sides."""
    if analyzed is not None:
        if analyzed.shape != a.shape or analyzed.lower != lower:
            raise ValueError("the analysis is of another matrix")
        if isinstance(analyzed, BlockTriangular):
            if analyzed.unit != unit_diagonal:
                raise ValueError("the analysis is of another diagonal")
            return analyzed.solve(b)
        return dense(a.spark, analyzed.solve_array(_rhs(b), unit_diagonal))
    if a.shape[0] != a.shape[1]:
        raise ValueError(f"the matrix must be square, got {a.shape}")
    if fits(a) if distributed is None else not distributed:
        return dense(a.spark, TriangularAnalysis(a, lower).solve_array(_rhs(b), unit_diagonal))
    return BlockTriangular(a, lower=lower, unit_diagonal=unit_diagonal).solve(b)


def diagonal_positions(a: SparseMatrix) -> DataFrame:
    """(i, pos): where the diagonal cell of each row is in the row-ordered cells; rows without one are missing."""
    rows = a.canonicalize().tocsr()
    before = rows.df.groupBy("i").agg(F.sum((F.col("j") < F.col("i")).cast("long")).alias("before"), F.max(F.col("j") == F.col("i")).alias("has"))
    met = before.filter("has").join(rows.indptr().select(F.col("place").alias("i"), "start"), "i")
    return met.select("i", (F.col("start") + F.col("before")).alias("pos"))


def triangular_levels(a: SparseMatrix, *, lower: bool = True) -> Dense:
    """The level of each row in the order of substitution: 0, or one more than the highest level it needs. One round of joins per level."""
    need = cut(a.df.filter(F.col("j") < F.col("i") if lower else F.col("j") > F.col("i")).select("i", "j").distinct())
    level = cut(a.spark.range(a.n_rows).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("x")))
    while True:
        above = need.join(level.select(F.col("i").alias("j"), F.col("x").alias("l")), "j").groupBy("i").agg((F.max("l") + 1).alias("l"))
        new = cut(level.join(above, "i", "left").select("i", F.coalesce("l", F.lit(0)).cast("long").alias("x")))
        changed = not new.join(level.select("i", F.col("x").alias("old")), "i").filter("x != old").isEmpty()
        release(level)
        level = new
        if not changed:
            release(need)
            return Dense(level, (a.n_rows,))


def solve_many(cells: DataFrame, rhs: DataFrame) -> DataFrame:
    """(s, i, x) of the systems s: cells (s, i, j, v) and right-hand sides (s, i, b), a group of rows for each system."""
    import pandas as pd

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n = len(right)
        m = np.zeros((n, n))
        np.add.at(m, (left["i"].to_numpy(), left["j"].to_numpy()), left["v"].to_numpy())
        right = right.sort_values("i")
        return pd.DataFrame({"s": key[0], "i": right["i"], "x": np.linalg.solve(m, right["b"].to_numpy())})

    return cells.groupBy("s").cogroup(rhs.groupBy("s")).applyInPandas(run, "s long, i long, x double")
