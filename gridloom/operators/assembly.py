"""Sums, Kronecker products and block matrices: unions of shifted cells, summed where places can meet."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from numbers import Number

from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.lineage import small
from .dense import Dense
from .matrix import SparseMatrix, check_format


def _scalar(x: object) -> bool:
    return isinstance(x, Number) and not isinstance(x, bool)


def _both(a: object, b: object, name: str) -> None:
    for x in (a, b):
        if not isinstance(x, SparseMatrix):
            raise TypeError(f"{name} takes sparse matrices, got {type(x).__name__}")
    if a.shape != b.shape:
        raise ValueError(f"{name}: shapes differ: {a.shape} and {b.shape}")
    if a.dtype != b.dtype:
        raise TypeError(f"{name}: value types differ: {a.dtype} and {b.dtype}")


def _dense_result(name: str) -> NotImplementedError:
    return NotImplementedError(f"{name} with a non-zero number would make a dense matrix")


def add(a: object, b: object) -> SparseMatrix:
    """A + B: canonical, without exact zeros; CSR unless both are CSC. Adding 0 gives the matrix itself."""
    for x, y in ((a, b), (b, a)):
        if _scalar(x) and isinstance(y, SparseMatrix):
            if x != 0:
                raise _dense_result("add")
            return y
    _both(a, b, "add")
    both = a.df.select("i", "j", "v").union(b.df.select("i", "j", "v"))
    out = both.groupBy("i", "j").agg(V.total(a.dtype, F.col("v")).alias("v")).filter(V.nonzero(a.dtype, F.col("v")))
    return a._like(out, canonical=True, layout="csc" if a.layout == b.layout == "csc" else "csr")


def subtract(a: object, b: object) -> SparseMatrix:
    if _scalar(a) and isinstance(b, SparseMatrix):
        if a != 0:
            raise _dense_result("subtract")
        return -b
    if _scalar(b) and isinstance(a, SparseMatrix):
        if b != 0:
            raise _dense_result("subtract")
        return a
    _both(a, b, "subtract")
    return add(a, -b)


def kron(a: SparseMatrix, b: SparseMatrix, format: str | None = None) -> SparseMatrix:
    """The Kronecker product. Each cell of A meets each of B by definition; the smaller side is broadcast if it is small."""
    check_format(format)
    for x in (a, b):
        if not isinstance(x, SparseMatrix):
            raise TypeError(f"kron takes sparse matrices, got {type(x).__name__}")
    kind = V.promoted(a.dtype, b.dtype)
    left = a.df.select(F.col("i").alias("ai"), F.col("j").alias("aj"), V.cast(F.col("v"), a.dtype, kind).alias("av"))
    right = b.df.select(F.col("i").alias("bi"), F.col("j").alias("bj"), V.cast(F.col("v"), b.dtype, kind).alias("bv"))
    met = left.crossJoin(small(right, b.n_rows * b.n_cols))
    out = met.select((F.col("ai") * b.n_rows + F.col("bi")).alias("i"), (F.col("aj") * b.n_cols + F.col("bj")).alias("j"), V.mul(kind, F.col("av"), F.col("bv")).alias("v"))
    made = a._like(out, (a.n_rows * b.n_rows, a.n_cols * b.n_cols), canonical=a.canonical and b.canonical, layout="coo", dtype=kind)
    return made if format in (None, "coo") else made.canonicalize().asformat(format)


def kronsum(a: SparseMatrix, b: SparseMatrix, format: str | None = None) -> SparseMatrix:
    """kron(I, A) + kron(B, I) for square A and B."""
    for name, x in (("A", a), ("B", b)):
        if x.n_rows != x.n_cols:
            raise ValueError(f"kronsum: {name} must be square, got {x.shape}")
    m, n = a.n_rows, b.n_rows
    kind = V.promoted(a.dtype, b.dtype)

    def copies(x: SparseMatrix, k: int):
        """Each cell k times, numbered by e; no join."""
        return x.df.limit(0).withColumn("e", F.lit(0).cast("long")) if k == 0 else x.df.withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))

    first = copies(a, n).select((F.col("e") * m + F.col("i")).alias("i"), (F.col("e") * m + F.col("j")).alias("j"), V.cast(F.col("v"), a.dtype, kind).alias("v"))
    second = copies(b, m).select((F.col("i") * m + F.col("e")).alias("i"), (F.col("j") * m + F.col("e")).alias("j"), V.cast(F.col("v"), b.dtype, kind).alias("v"))
    out = first.union(second).groupBy("i", "j").agg(V.total(kind, F.col("v")).alias("v")).filter(V.nonzero(kind, F.col("v")))
    return a._like(out, (m * n, m * n), canonical=True, layout="coo", dtype=kind).asformat(format)


def block_array(blocks: Sequence[Sequence[object]], *, format: str | None = None, dtype: str | None = None) -> SparseMatrix:
    """A grid of sparse or dense blocks, or None; a row or column of only None has size 0. Duplicates stay."""
    from ..sources.construct import fromdense

    check_format(format)
    grid = [list(r) for r in blocks]
    if not grid or not grid[0] or any(len(r) != len(grid[0]) for r in grid):
        raise ValueError("blocks must be a non-empty rectangular grid")
    some = next((x for r in grid for x in r if isinstance(x, SparseMatrix)), None)
    if some is None:
        raise ValueError("at least one block must be a sparse matrix")
    grid = [[x if x is None or isinstance(x, SparseMatrix) else fromdense(some.spark, x) for x in r] for r in grid]
    heights, widths = [0] * len(grid), [0] * len(grid[0])
    seen_h, seen_w = set(), set()
    for r, row in enumerate(grid):
        for q, x in enumerate(row):
            if x is None:
                continue
            if r in seen_h and heights[r] != x.n_rows or q in seen_w and widths[q] != x.n_cols:
                raise ValueError(f"block ({r}, {q}) has shape {x.shape}, which does not fit its row or column")
            heights[r], widths[q] = x.n_rows, x.n_cols
            seen_h.add(r)
            seen_w.add(q)
    present = [(r, q, x) for r, row in enumerate(grid) for q, x in enumerate(row) if x is not None]
    kind = dtype or V.promoted(*(x.dtype for _, _, x in present))
    parts = [x.df.select((F.col("i") + sum(heights[:r])).alias("i"), (F.col("j") + sum(widths[:q])).alias("j"), V.cast(F.col("v"), x.dtype, kind).alias("v")) for r, q, x in present]
    out = some._like(reduce(lambda a, b: a.union(b), parts), (sum(heights), sum(widths)), canonical=all(x.canonical for _, _, x in present), layout="coo", dtype=kind)
    return out.asformat(format)


def bmat(blocks: Sequence[Sequence[object]], format: str | None = None, dtype: str | None = None) -> SparseMatrix:
    return block_array(blocks, format=format, dtype=dtype)


def block_diag(mats: Sequence[object], format: str | None = None, dtype: str | None = None) -> SparseMatrix:
    mats = list(mats)
    if not mats or any(m is None for m in mats):
        raise ValueError("block_diag takes one or more matrices, None is not one")
    return block_array([[m if r == q else None for q in range(len(mats))] for r, m in enumerate(mats)], format=format, dtype=dtype)


def vstack(blocks: Sequence[object], format: str | None = None, dtype: str | None = None) -> SparseMatrix:
    return block_array([[b] for b in blocks], format=format, dtype=dtype)


def hstack(blocks: Sequence[object], format: str | None = None, dtype: str | None = None) -> SparseMatrix:
    return block_array([list(blocks)], format=format, dtype=dtype)


def permute(x: Dense, order: Dense) -> Dense:
    """y[i] = x[order[i]]: order is a vector of places."""
    to = order.df.select("i", F.col("x").cast("long").alias("at"))
    out = to.join(x.df.select(F.col("i").alias("at"), "x"), "at").select("i", "x")
    return Dense(out, order.shape, x.dtype)
