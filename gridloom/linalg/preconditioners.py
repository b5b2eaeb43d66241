"""Preconditioners: approximations of the inverse, applied to a vector of a space."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from ..config import config
from ..operators.dense import Dense, dense
from ..operators.matrix import SparseMatrix
from ..plans.lineage import cut, release
from . import spaces
from .blocks import BlockTriangular
from .incomplete import Incomplete

EPS = np.finfo(float).eps


class Preconditioner:
    """kind, shape, and apply(space, r)."""

    kind = "identity"

    def __init__(self, shape: tuple[int, int], **setup: object):
        self.shape, self.setup_info = shape, setup

    def apply(self, s, r):
        return r

    def solve(self, r: object) -> object:
        """On a numpy array or a Dense vector."""
        if isinstance(r, Dense):
            s = object.__new__(spaces.Distributed)
            s.spark = r.df.sparkSession
            return self.apply(s, r)
        return self.apply(object.__new__(spaces.Local), np.asarray(r, float))

    __call__ = solve


class IdentityPreconditioner(Preconditioner):
    pass


class DiagonalPreconditioner(Preconditioner):
    """Holds the inverse diagonal as a Dense vector."""

    kind = "diagonal"

    def __init__(self, inverse: Dense, kind: str = "diagonal", **setup: object):
        super().__init__((inverse.shape[0],) * 2, **setup)
        self.inverse, self.kind, self._array = inverse, kind, None

    @property
    def positive(self) -> bool:
        """Whether every entry is above zero."""
        return self.inverse.df.filter(~(F.col("x") > 0)).isEmpty()

    def apply(self, s, r):
        if isinstance(s, spaces.Distributed):
            return s.times(self.inverse, r)
        if self._array is None:
            self._array = self.inverse.collect()
        return s.times(self._array, r)


class JacobiPreconditioner(DiagonalPreconditioner):
    pass


class CallablePreconditioner(Preconditioner):
    """A user's inverse; its result must be finite and keep the shape."""

    kind = "callable"

    def __init__(self, shape: tuple[int, int], f: Callable):
        super().__init__(shape)
        self.f = f

    def apply(self, s, r):
        out = self.f(r)
        if not isinstance(out, Dense):
            out = np.asarray(out, float)
            if out.shape != r.shape or not np.isfinite(out).all():
                raise ValueError("a preconditioner must keep the shape and return finite values")
        return out


class ExactFactorPreconditioner(Preconditioner):
    kind = "exact"

    def __init__(self, solver):
        super().__init__(solver.shape)
        self.solver = solver

    def apply(self, s, r):
        if isinstance(r, Dense):
            frames = getattr(self.solver, "distributed", not hasattr(self.solver, "solve_array"))
            return self.solver.solve(r) if frames else dense(r.df.sparkSession, self.solver.solve_array(r.collect()))
        return self.solver.solve_array(r) if hasattr(self.solver, "solve_array") else self.solver.solve(r).collect()


class _Triangles(Preconditioner):
    """lower (rows of columns and values) and upper factors, solved on the driver; the factors were checked to fit it."""

    def __init__(self, n: int, lower: list, upper: list, diagonal: np.ndarray, unit_lower: bool, kind: str, **setup: object):
        super().__init__((n, n), **setup)
        self.lower, self.upper, self.diagonal, self.unit_lower, self.kind = lower, upper, diagonal, unit_lower, kind

    @property
    def pattern(self) -> list[tuple[int, ...]]:
        """The columns of each row."""
        return [(*x.tolist(), i, *y.tolist()) for i, ((x, _), (y, _)) in enumerate(zip(self.lower, self.upper, strict=True))]

    def apply(self, s, r):
        x = (r.collect() if isinstance(r, Dense) else np.asarray(r, float)).copy()
        for i, (cols, vals) in enumerate(self.lower):
            x[i] -= vals @ x[cols]
            if not self.unit_lower:
                x[i] /= self.diagonal[i]
        for i in range(len(x) - 1, -1, -1):
            cols, vals = self.upper[i]
            x[i] = (x[i] - vals @ x[cols]) / self.diagonal[i]
        return dense(r.df.sparkSession, x) if isinstance(r, Dense) else x


class ILU0Preconditioner(_Triangles):
    pass


class IC0Preconditioner(_Triangles):
    pass


class FixedPointPreconditioner(Preconditioner):
    """Incomplete factors as relations, made by sweeps; an application is two solves by blocks of rows."""

    def __init__(self, found: Incomplete, kind: str, **setup: object):
        super().__init__(found.shape, sweeps=found.sweeps, change=found.change, **setup)
        self.kind, self.L, self.U = kind, found.L, found.U
        self._lower, self._upper = BlockTriangular(self.L, unit_diagonal=True, written=True), BlockTriangular(self.U, lower=False, written=True)

    def apply(self, s, r):
        half = self._lower.solve(r)
        x = self._upper.solve(half)
        if not isinstance(r, Dense):
            return x.collect()
        kept = Dense(cut(x.df), x.shape)
        release(half.df)
        return kept


class ChebyshevPreconditioner(Preconditioner):
    """A polynomial in A: degree - 1 products each time."""

    kind = "chebyshev"

    def __init__(self, a: SparseMatrix, degree: int, lo: float, hi: float):
        super().__init__(a.shape, degree=degree, lambda_min=lo, lambda_max=hi)
        self.a, self.degree, self.lo, self.hi, self._spaces = a, degree, lo, hi, {}

    def apply(self, s, r):
        if getattr(s, "a", None) is None or not isinstance(s.a, SparseMatrix):
            s = self._spaces.setdefault(type(s), type(s)(self.a))
        theta, delta = (self.hi + self.lo) / 2, (self.hi - self.lo) / 2
        d = s.combine((1 / theta, r))
        x, sigma = d, theta / delta if delta else np.inf
        rho, left = 1 / sigma, r
        for _ in range(self.degree - 1):
            left = s.combine((1.0, left), (-1.0, s.matvec(d)))
            if not delta:
                d = s.combine((1 / theta, left))
            else:
                new = 1 / (2 * sigma - rho)
                d, rho = s.combine((new * rho, d), (2 * new / delta, left)), new
            x = s.combine((1.0, x), (1.0, d))
        return x


def identity(a_or_shape: object) -> IdentityPreconditioner:
    return IdentityPreconditioner(a_or_shape.shape if isinstance(a_or_shape, SparseMatrix) else tuple(a_or_shape))


def _inverted(d: Dense, omega: float, shift: float, zero_atol: float, unit: bool) -> Dense:
    if d.shape[0] <= config.get("local_rows"):  # small enough for the driver: one job instead of a check and a written table
        values = d.collect() + shift
        vanish = abs(values) <= zero_atol
        if not unit and (vanish | np.isnan(values)).any():
            raise ValueError("the diagonal has an entry that is zero")
        return dense(d.df.sparkSession, np.where(vanish, omega, omega / np.where(vanish, 1.0, values)))
    x = F.col("x") + F.lit(float(shift))
    zero = F.abs(x) <= zero_atol
    if not unit and not d.df.filter(zero | F.isnan(x)).isEmpty():
        raise ValueError("the diagonal has an entry that is zero")
    return Dense(cut(d.df.select("i", F.when(zero, F.lit(float(omega))).otherwise(F.lit(float(omega)) / x).alias("x"))), d.shape)


def diagonal(spark, values: object, *, inverse: bool = False, zero_atol: float = 0.0) -> DiagonalPreconditioner:
    """From a diagonal, or from its inverse."""
    d = dense(spark, values)
    return DiagonalPreconditioner(d if inverse else _inverted(d, 1.0, 0.0, zero_atol, False))


def jacobi(a: SparseMatrix, *, omega: float = 1.0, shift: float = 0.0, zero_policy: str = "raise", zero_atol: float = 0.0, check: bool = False) -> JacobiPreconditioner:
    """omega / (diagonal + shift)."""
    if a.shape[0] != a.shape[1]:
        raise ValueError(f"the matrix must be square, got {a.shape}")
    if zero_policy not in ("raise", "unit"):
        raise ValueError("zero_policy must be 'raise' or 'unit'")
    d = a.diagonal()
    if check and (omega <= 0 or not d.df.filter(F.col("x") + shift <= zero_atol).isEmpty()):
        raise ValueError("omega and the diagonal must be positive")
    return JacobiPreconditioner(_inverted(d, omega, shift, zero_atol, zero_policy == "unit"), "jacobi", omega=omega, shift=shift)


def gershgorin(a: SparseMatrix) -> Dense:
    """Lower (k = 0) and upper (k = 1) ends of each row's disc, one aggregate."""
    on, off = F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(0.0), F.when(F.col("i") != F.col("j"), F.abs("v")).otherwise(0.0)
    zero = a.spark.range(a.n_rows).select(F.col("id").alias("i"), F.lit(0.0).alias("d"), F.lit(0.0).alias("o"))
    sums = a.canonicalize().df.select("i", on.alias("d"), off.alias("o")).union(zero).groupBy("i").agg(F.sum("d").alias("d"), F.sum("o").alias("o"))
    both = sums.select("i", F.posexplode(F.array(F.col("d") - F.col("o"), F.col("d") + F.col("o"))).alias("k", "x"))
    return Dense(both.select("i", F.col("k").cast("long").alias("k"), "x"), (a.n_rows, 2))


def chebyshev(a: SparseMatrix, *, degree: int = 2, lambda_min: float | None = None, lambda_max: float | None = None, estimate: bool = True) -> ChebyshevPreconditioner:
    """Bounds of the spectrum: given, by the rows' discs, or where those reach below zero by a short Lanczos run."""
    if degree < 1:
        raise ValueError("degree must be 1 or more")
    if lambda_min is None or lambda_max is None:
        if not estimate:
            raise ValueError("bounds are needed unless they may be estimated")
        ends = gershgorin(a).df.groupBy().agg(F.min(F.when(F.col("k") == 0, F.col("x"))), F.max(F.when(F.col("k") == 1, F.col("x")))).first()
        lo, hi = ends
        if lo <= 0:
            from .spectral import lanczos

            alphas, betas = lanczos(a, min(a.n_rows, 12), return_basis=False)
            n = len(alphas)
            values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[: n - 1], 1) + np.diag(betas[: n - 1], -1))
            # each Ritz value has an eigenvalue within its residual, which is the last beta times its vector's last component
            apart = (betas[n - 1] if len(betas) >= n else 0.0) * abs(vectors[-1])
            hi, lo = values[-1] + apart[-1], values[0] - apart[0]
            if lo <= 0:
                lo = hi / 30  # nothing is known of the lower end: damp the upper part of the spectrum, as a smoother does
        lambda_min, lambda_max = lo if lambda_min is None else lambda_min, hi if lambda_max is None else lambda_max
    if not 0 < lambda_min <= lambda_max:
        raise ValueError(f"bounds must be positive and in order, got {lambda_min} and {lambda_max}")
    return ChebyshevPreconditioner(a, degree, float(lambda_min), float(lambda_max))


def _rows(a: SparseMatrix, shift: float) -> list[dict[int, float]]:
    if a.shape[0] != a.shape[1]:
        raise ValueError(f"the matrix must be square, got {a.shape}")
    rows: list[dict[int, float]] = [{} for _ in range(a.n_rows)]
    for i, j, v in zip(*(x.tolist() for x in spaces.collected(a)), strict=True):
        rows[i][j] = v + (shift if i == j else 0.0)
    if any(i not in r for i, r in enumerate(rows)):
        raise ValueError("each row needs a stored diagonal cell")
    return rows


def _split(rows: list[dict[int, float]], like: _Triangles | None = None) -> tuple[list, list, np.ndarray]:
    """Lower and upper rows (columns, values) and the diagonal; the columns are those of like, if given."""
    at = [(np.array([j for j in sorted(r) if j < i], int), np.array([j for j in sorted(r) if j > i], int)) for i, r in enumerate(rows)] if like is None else list(zip((x for x, _ in like.lower), (x for x, _ in like.upper), strict=True))
    part = lambda side: [(cols[side], np.array([r[j] for j in cols[side].tolist()], float)) for cols, r in zip(at, rows, strict=True)]
    return part(0), part(1), np.array([r[i] for i, r in enumerate(rows)])


def ilu0(a: SparseMatrix, *, shift: float = 0.0, check: bool = True, reuse_analysis: ILU0Preconditioner | None = None, distributed: bool | None = None) -> ILU0Preconditioner | FixedPointPreconditioner:
    """LU on the pattern of A, in natural order: row by row where the matrix fits one machine, otherwise by sweeps over all cells.

    reuse_analysis: the preconditioner of a matrix with the same pattern, whose row structure is taken over (on one machine)."""
    if not spaces.fits(a) if distributed is None else distributed:
        if reuse_analysis is not None:
            raise ValueError("an analysis is of one machine; a distributed factorisation has none to take over")
        return FixedPointPreconditioner(Incomplete(a, shift=shift), "ilu0", shift=shift)
    rows = _rows(a, shift)
    if reuse_analysis is not None and reuse_analysis.pattern != [tuple(sorted(r)) for r in rows]:
        raise ValueError("the analysis is of another pattern")
    scale = [max(1.0, sum(abs(v) for v in r.values())) for r in rows]
    for i, r in enumerate(rows):
        for k in sorted(j for j in r if j < i):
            r[k] /= rows[k][k]
            for j, v in rows[k].items():
                if j > k and j in r:
                    r[j] -= r[k] * v
        if abs(r[i]) <= EPS * scale[i]:
            raise RuntimeError(f"pivot {i} is zero")
    return ILU0Preconditioner(len(rows), *_split(rows, reuse_analysis), True, "ilu0", shift=shift)


def _symmetric(a: SparseMatrix) -> bool:
    """Whether each cell equals its mirror image, to eight digits; the cells are summed at both places, so no cell is looked up."""
    cells = a.canonicalize().df
    low, high = F.least("i", "j"), F.greatest("i", "j")
    sign = F.when(F.col("i") > F.col("j"), 1.0).otherwise(-1.0)
    apart = cells.filter("i != j").groupBy(low.alias("i"), high.alias("j")).agg(F.sum(sign * F.col("v")).alias("d"), F.max(F.abs("v")).alias("m"), F.count("*").alias("n"))
    return apart.filter((F.abs("d") > 1e-8 * F.greatest(F.lit(1.0), F.col("m"))) | (F.col("n") < 2)).isEmpty()


def ichol0(a: SparseMatrix, *, shift: float = 0.0, check: bool = True, distributed: bool | None = None) -> IC0Preconditioner | FixedPointPreconditioner:
    """Cholesky on the pattern of A's lower triangle. By sweeps it comes as L D L.T, whose pivots D must be positive."""
    if shift < 0:
        raise ValueError("shift must not be negative")
    if not spaces.fits(a) if distributed is None else distributed:
        if check and not _symmetric(a):
            raise ValueError("the matrix is not symmetric")
        found = Incomplete(a, shift=shift)
        if found.least is not None and found.least <= 0:
            raise RuntimeError("a pivot is not positive")
        return FixedPointPreconditioner(found, "ichol0", shift=shift)
    rows = _rows(a, shift)
    if check and any(abs(rows[j].get(i, np.inf) - v) > 1e-8 * max(1.0, abs(v)) for i, r in enumerate(rows) for j, v in r.items()):
        raise ValueError("the matrix is not symmetric")
    low = [{j: v for j, v in r.items() if j <= i} for i, r in enumerate(rows)]
    for i, r in enumerate(low):
        for k in sorted(j for j in r if j < i):
            r[k] = (r[k] - sum(v * r[j] for j, v in low[k].items() if j < k and j in r)) / low[k][k]
        square = r[i] - sum(v * v for j, v in r.items() if j < i)
        if square <= EPS * max(1.0, abs(r[i])):
            raise RuntimeError(f"pivot {i} is not positive")
        r[i] = float(np.sqrt(square))
    lower, _, d = _split(low)
    upper: list[dict[int, float]] = [{} for _ in low]
    for i, r in enumerate(low):
        for j, v in r.items():
            upper[j][i] = v
    return IC0Preconditioner(len(low), lower, _split(upper)[1], d, False, "ichol0", shift=shift)


def from_factorized(solver) -> ExactFactorPreconditioner:
    return ExactFactorPreconditioner(solver)


def exact(a: SparseMatrix, *, method: str = "auto") -> ExactFactorPreconditioner:
    from .direct import factorized

    return ExactFactorPreconditioner(factorized(a, method=method))


def aspreconditioner(m: object, a: object = None, *, assume_inverse: bool = True) -> Preconditioner:
    if m is None:
        return IdentityPreconditioner(a.shape if a is not None else (0, 0))
    if isinstance(m, Preconditioner):
        if a is not None and m.shape != tuple(a.shape):
            raise ValueError(f"the preconditioner has shape {m.shape}, the matrix {a.shape}")
        return m
    if isinstance(m, SparseMatrix):
        raise TypeError("a sparse matrix is no preconditioner: it would have to be inverted")
    if hasattr(m, "solve_array"):
        return ExactFactorPreconditioner(m)
    if callable(m) and assume_inverse:
        return CallablePreconditioner(a.shape if a is not None else (0, 0), m)
    raise TypeError(f"can't make a preconditioner of {type(m).__name__}")
