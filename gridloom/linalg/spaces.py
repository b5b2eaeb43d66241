"""Vector spaces for the iterative methods: each method is written once, over one of these.

Local keeps vectors as numpy arrays on the driver and the matrix's cells beside them; it serves matrices whose cell
and row counts are checked to be small, for which a Spark job per step would cost far more than the step.
Distributed keeps vectors as frames: a step is a few joins and sums, written once to the shared folder.
Blocks keeps a bounded number of vectors as arrays of the driver, for matrices that are too large for it: a step is one pass
over the matrix for a whole block of vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from ..config import config
from ..functions import values as V
from ..operators.dense import Dense, dense
from ..operators.matrix import SparseMatrix
from ..operators.passes import Passes, passable
from ..plans.lineage import cut, release, small
from .interface import LinearOperator

#: Blocks of vectors that a restarted run keeps at most, and values of all of them that the driver holds.
BASIS, BASIS_VALUES = 6, 1 << 25


def fits(a: SparseMatrix) -> bool:
    return max(a.shape) <= config.get("local_rows") and a.nnz <= config.get("local_cells")


def collected(a: SparseMatrix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells, duplicates summed, in row order; only where fits(a)."""
    if not fits(a):
        raise ValueError(f"a {a.shape} matrix with {a.nnz} cells is too large for one machine; see the options local_rows and local_cells")
    t = a.canonicalize().df.select("i", "j", "v").toArrow()
    i, j, v = (t.column(n).to_numpy() for n in range(3))
    order = np.lexsort((j, i))
    return i[order], j[order], v[order]


class Local:
    def __init__(self, a: SparseMatrix | LinearOperator):
        self.a, self.shape = a, a.shape
        if isinstance(a, SparseMatrix):
            self.spark = a.spark
            self.i, self.j, self.v = collected(a)

    def vector(self, x: object, n: int) -> np.ndarray:
        x = x.collect() if isinstance(x, Dense) else np.asarray(x, float)
        if x.shape != (n,):
            raise ValueError(f"expected a vector of {n}, got shape {x.shape}")
        return x.astype(float)

    def matvec(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.i, self.v * x[self.j], self.shape[0]) if isinstance(self.a, SparseMatrix) else np.asarray(self.a.matvec(x), float)

    def rmatvec(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.j, self.v * x[self.i], self.shape[1]) if isinstance(self.a, SparseMatrix) else np.asarray(self.a.rmatvec(x), float)

    def dot(self, a: np.ndarray, b: np.ndarray) -> float:
        return float(a @ b)

    def dots(self, many: list[np.ndarray], b: np.ndarray) -> np.ndarray:
        return np.array([float(a @ b) for a in many])

    def combine(self, *terms: tuple[float, np.ndarray]) -> np.ndarray:
        return reduce(np.add, (c * x for c, x in terms))

    def norm(self, x: np.ndarray) -> float:
        return float(np.sqrt(x @ x))

    def times(self, d: np.ndarray, x: np.ndarray) -> np.ndarray:
        return d * x

    def constant(self, n: int, x: float) -> np.ndarray:
        return np.full(n, x)

    def retire(self, old: tuple, live: tuple) -> None:
        """Nothing to do: arrays are freed with their last use."""

    def result(self, x: np.ndarray) -> Dense | np.ndarray:
        return dense(self.spark, x) if isinstance(self.a, SparseMatrix) else x


class Blocks(Local):
    """normal: products with A A.T or A.T A, whichever has fewer rows, instead of A."""

    def __init__(self, a: SparseMatrix, normal: bool = False):
        self.a, self.shape, self.spark, self.back = a, a.shape, a.spark, normal
        self.left = normal and a.n_rows <= a.n_cols
        self.passes = Passes(a, "j" if self.left else "i")

    def product(self, x: np.ndarray) -> np.ndarray:
        return (self.passes.normal if self.back else self.passes.times)(x)


def blocks_fit(n: int, columns: int) -> bool:
    """Whether the driver may hold so many vectors of n values, and tasks a block of them."""
    return passable(n, columns) and n * columns * BASIS <= BASIS_VALUES


class Distributed:
    def __init__(self, a: SparseMatrix | LinearOperator):
        self.a, self.shape = a, a.shape
        if isinstance(a, SparseMatrix):
            self.a = a.canonicalize().persist()
            self.spark = a.spark

    def vector(self, x: object, n: int) -> Dense:
        if not isinstance(x, Dense):
            x = dense(self.spark, np.asarray(x, float))
        if x.shape != (n,):
            raise ValueError(f"expected a vector of {n}, got shape {x.shape}")
        self.spark = x.df.sparkSession
        return x

    def _kept(self, x: Dense) -> Dense:
        return Dense(cut(x.df.select("i", "x")), x.shape)

    def matvec(self, x: Dense) -> Dense:
        return self._kept(self.a.matvec(x))

    def rmatvec(self, x: Dense) -> Dense:
        return self._kept(self.a.matvec_transpose(x) if isinstance(self.a, SparseMatrix) else self.a.rmatvec(x))

    def dots(self, many: list[Dense], b: Dense) -> np.ndarray:
        """All products with b in one pass: vectors come as one frame, tagged."""
        if not many:
            return np.zeros(0)
        tagged = reduce(lambda p, q: p.union(q), (a.df.select(F.lit(k).alias("t"), "i", F.col("x").alias("a")) for k, a in enumerate(many)))
        side = small(b.df.select("i", F.col("x").alias("b")), b.shape[0])
        got = dict(tagged.join(side, "i").groupBy("t").agg(F.sum(F.col("a") * F.col("b"))).collect())
        return np.array([got.get(k, 0.0) for k in range(len(many))])

    def dot(self, a: Dense, b: Dense) -> float:
        return float(self.dots([a], b)[0])

    def combine(self, *terms: tuple[float, Dense]) -> Dense:
        rows = reduce(lambda p, q: p.union(q), (x.df.select("i", (F.lit(float(c)) * F.col("x")).alias("x")) for c, x in terms))
        return self._kept(Dense(rows.groupBy("i").agg(F.sum("x").alias("x")), terms[0][1].shape))

    def norm(self, x: Dense) -> float:
        return float(np.sqrt(self.dot(x, x)))

    def times(self, d: Dense, x: Dense) -> Dense:
        side = small(d.df.select("i", F.col("x").alias("d")), d.shape[0])
        return self._kept(Dense(x.df.join(side, "i").select("i", (F.col("d") * F.col("x")).alias("x")), x.shape))

    def constant(self, n: int, x: float) -> Dense:
        return Dense(self.spark.range(n).select(F.col("id").alias("i"), F.lit(float(x)).alias("x")), (n,))

    def retire(self, old: tuple, live: tuple) -> None:
        """Deletes the tables of vectors that a step has replaced, unless they are among the live ones."""
        for v in old:
            if isinstance(v, Dense) and not any(v is w for w in live):
                release(v.df)

    def result(self, x: Dense) -> Dense:
        return x


def space(a: SparseMatrix | LinearOperator, distributed: bool | None = None) -> Local | Distributed:
    if isinstance(a, SparseMatrix) and a.dtype == V.COMPLEX:
        raise TypeError("solvers take real matrices")
    if distributed is None:
        distributed = not (fits(a) if isinstance(a, SparseMatrix) else a.local)
    return (Distributed if distributed else Local)(a)
