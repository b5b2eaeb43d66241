"""Derivatives of products, reductions and constructors as relations: a sampled product keeps the cells of the matrix.

A vjp takes the cotangent of a result to that of an operand, a jvp the tangents of the operands to that of the result.
Sparse structure is fixed: cotangents of matrices are cells at the stored places, and only values have tangents. Operations
whose structure depends on values (fromdense, sums of duplicates, sparse products, triangles) have no derivatives."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.lineage import small
from ..sources.construct import diags
from .assembly import add, block_array, block_diag, hstack, kron, vstack
from .dense import Dense
from .matrix import WIDE, SparseMatrix, _rows


def matvec_data_vjp(a: SparseMatrix, x: Dense, y_bar: Dense) -> SparseMatrix:
    """The cotangent of each stored cell of A in A @ x: y_bar[i] * conj(x[j]). Two joins, no aggregate."""
    left = small(y_bar.df.select(F.col("i").alias("r"), F.col("x").alias("g")), _rows(y_bar))
    right = small(x.df.select(F.col("i").alias("c"), F.col("x").alias("x")), _rows(x))
    out = a.df.join(left, F.col("i") == F.col("r")).join(right, F.col("j") == F.col("c"))
    return a._like(out.select("i", "j", V.mul(a.dtype, F.col("g"), V.conj(a.dtype, F.col("x"))).alias("v")))


def _unbatched(x: Dense) -> Dense:
    """A batch as one dense matrix: the columns of all batches side by side. A batch of vectors has a column each."""
    k = x.shape[-1] if "k" in x.keys else 1
    column = (F.col("b") * k + (F.col("k") if "k" in x.keys else F.lit(0))).alias("k")
    return Dense(x.df.select("i", column, "x"), (x.shape[1], x.shape[0] * k), x.dtype)


def batched_data_vjp(a: SparseMatrix, x: Dense, y_bar: Dense) -> SparseMatrix:
    """The cotangent of each stored cell in a batched product: the sum over the batches."""
    return matmul_data_vjp(a, _unbatched(x), _unbatched(y_bar))


def _side_by_side(x: Dense, prefix: str) -> DataFrame:
    """A row per place (column prefix) with the columns of x as prefix0, prefix1, ..."""
    n = x.shape[1]
    df = x.df.groupBy(F.col("i").alias(prefix)).agg(*(F.sum(F.when(F.col("k") == t, F.col("x"))).alias(f"{prefix}{t}") for t in range(n)))
    return small(df, x.shape[0], 16 + 8 * n)


def matmul_data_vjp(a: SparseMatrix, x: Dense, y_bar: Dense) -> SparseMatrix:
    """The same for A @ X: summed over the columns, at the stored places (a dense product, sampled)."""
    if a.dtype != V.COMPLEX and 0 < x.shape[1] <= WIDE:
        left, right = (_side_by_side(d, p) for d, p in ((y_bar, "g"), (x, "x")))
        met = a.df.select("i", "j").join(left, F.col("i") == F.col("g")).join(right, F.col("j") == F.col("x"))
        return a._like(met.select("i", "j", reduce(lambda s, t: s + t, (F.col(f"g{k}") * F.col(f"x{k}") for k in range(x.shape[1]))).alias("v")))
    pattern = a.df.select("i", "j").distinct()
    left = y_bar.df.select(F.col("i").alias("r"), "k", F.col("x").alias("g"))
    right = x.df.select(F.col("i").alias("c"), F.col("k").alias("k2"), F.col("x").alias("x"))
    met = pattern.join(small(left, _rows(y_bar)), F.col("i") == F.col("r")).join(small(right, _rows(x)), (F.col("j") == F.col("c")) & (F.col("k") == F.col("k2")))
    out = met.groupBy("i", "j").agg(V.total(a.dtype, V.mul(a.dtype, F.col("g"), V.conj(a.dtype, F.col("x")))).alias("v"))
    if a.canonical:
        return a._like(out)
    return a._like(a.df.select("i", "j").join(out, ["i", "j"]))  # a cotangent for each stored cell, duplicates too


def rhs_vjp(a: SparseMatrix, y_bar: Dense) -> Dense:
    """The cotangent of x in A @ x, for vectors, matrices and batches of either."""
    return a.conj().matvec_transpose(y_bar) if "k" not in y_bar.keys else a.conj().matmul_transpose(y_bar)


def transpose_rhs_vjp(a: SparseMatrix, y_bar: Dense) -> Dense:
    """The cotangent of x in A.T @ x."""
    return a.conj() @ y_bar


def _plus(one: Dense, two: Dense) -> Dense:
    both = one.df.select(*one.keys, "x").union(two.df.select(*one.keys, "x"))
    return Dense(both.groupBy(*one.keys).agg(V.total(one.dtype, F.col("x")).alias("x")), one.shape, one.dtype, one.batched)


def product_jvp(a: SparseMatrix, a_dot: SparseMatrix | None, x: Dense, x_dot: Dense | None) -> Dense:
    """The tangent of A @ x for vectors, matrices and batches: A_dot @ x + A @ x_dot; None is no tangent."""
    if a_dot is None and x_dot is None:
        raise ValueError("one operand needs a tangent")
    if a_dot is None or x_dot is None:
        return a @ x_dot if a_dot is None else a_dot @ x
    return _plus(a_dot @ x, a @ x_dot)


matvec_jvp = matmul_jvp = batched_jvp = product_jvp


def transpose_jvp(a: SparseMatrix, a_dot: SparseMatrix, x: Dense, x_dot: Dense) -> Dense:
    """The tangent of A.T @ x."""
    return _plus(a_dot.matvec_transpose(x), a.matvec_transpose(x_dot))


# Reductions and layouts are linear in the values: a tangent goes through the same operation.


def todense_jvp(a_dot: SparseMatrix) -> Dense:
    return a_dot.todense()


def row_sums_jvp(a_dot: SparseMatrix) -> Dense:
    return a_dot.row_sums()


def col_sums_jvp(a_dot: SparseMatrix) -> Dense:
    return a_dot.col_sums()


def diagonal_jvp(a_dot: SparseMatrix) -> Dense:
    return a_dot.diagonal()


def trace_jvp(a_dot: SparseMatrix) -> DataFrame:
    return a_dot.trace()


def todense_vjp(a: SparseMatrix, cotangent: Dense) -> SparseMatrix:
    """The cotangent, read at the stored places."""
    at = cotangent.df.select("i", F.col("k").alias("j"), F.col("x").alias("v"))
    return a._like(a.df.select("i", "j").join(at, ["i", "j"]))


def row_sums_vjp(a: SparseMatrix, cotangent: Dense) -> SparseMatrix:
    g = small(cotangent.df.select("i", F.col("x").alias("v")), _rows(cotangent))
    return a._like(a.df.select("i", "j").join(g, "i").select("i", "j", "v"))


def col_sums_vjp(a: SparseMatrix, cotangent: Dense) -> SparseMatrix:
    g = small(cotangent.df.select(F.col("i").alias("j"), F.col("x").alias("v")), _rows(cotangent))
    return a._like(a.df.select("i", "j").join(g, "j").select("i", "j", "v"))


def diagonal_vjp(a: SparseMatrix, cotangent: Dense) -> SparseMatrix:
    """Zero off the diagonal."""
    g = small(cotangent.df.select("i", F.col("x").alias("g")), _rows(cotangent))
    met = a.df.select("i", "j").join(g, "i", "left")
    return a._like(met.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("g")).otherwise(V.lit(a.dtype, 0)).alias("v")))


def trace_vjp(a: SparseMatrix, cotangent: float) -> SparseMatrix:
    return a._like(a.df.select("i", "j", F.when(F.col("i") == F.col("j"), V.lit(a.dtype, cotangent)).otherwise(V.lit(a.dtype, 0)).alias("v")))


# --- constructors


def _at(a: SparseMatrix, cotangent: SparseMatrix, rows: int = 0, cols: int = 0) -> SparseMatrix:
    """The cotangent at the stored places of a, which stand rows down and cols to the right in it; 0 where it has no cell."""
    g = cotangent.canonicalize().df.select((F.col("i") - rows).alias("i"), (F.col("j") - cols).alias("j"), "v")
    inside = g.filter((F.col("i") >= 0) & (F.col("i") < a.n_rows) & (F.col("j") >= 0) & (F.col("j") < a.n_cols))
    met = a.df.select("i", "j").join(inside, ["i", "j"], "left")
    return a._like(met.select("i", "j", F.coalesce("v", V.lit(cotangent.dtype, 0)).alias("v")), dtype=cotangent.dtype)


def diags_vjp(offsets: Sequence[int], lengths: Sequence[int], cotangent: SparseMatrix) -> list[Dense]:
    """The cotangents of the diagonals that diags was given: vectors of those lengths."""
    out = []
    for k, n in zip(offsets, lengths, strict=True):
        rows = cotangent.df.filter(F.col("j") - F.col("i") == k).select((F.col("i") - max(0, -k)).alias("i"), F.col("v").alias("x")).filter(F.col("i") < n)
        out.append(cotangent._filled(rows, ["i"], cotangent._places(n), (n,)))
    return out


def diags_jvp(spark: SparkSession, tangents: object, offsets: int | Sequence[int] = 0, *, shape: Sequence[int] | None = None) -> SparseMatrix:
    return diags(spark, tangents, offsets, shape=shape)


def kron_vjp(a: SparseMatrix, b: SparseMatrix, cotangent: SparseMatrix) -> tuple[SparseMatrix, SparseMatrix]:
    """The cotangents of both factors: for a cell of A the sum over B's cells of the cotangent times B's conjugate, and the other way round."""
    kind, (p, q) = cotangent.dtype, b.shape
    g = cotangent.canonicalize().df.select(F.floor(F.col("i") / p).alias("ai"), F.floor(F.col("j") / q).alias("aj"), (F.col("i") % p).alias("bi"), (F.col("j") % q).alias("bj"), F.col("v").alias("g"))

    def of(own: SparseMatrix, mine: tuple[str, str], other: SparseMatrix, its: tuple[str, str]) -> SparseMatrix:
        side = other.df.select(F.col("i").alias(its[0]), F.col("j").alias(its[1]), V.conj(kind, V.cast(F.col("v"), other.dtype, kind)).alias("w"))
        sums = g.join(side, list(its)).groupBy(*mine).agg(V.total(kind, V.mul(kind, F.col("g"), F.col("w"))).alias("v"))
        return _at(own, own._like(sums.select(F.col(mine[0]).alias("i"), F.col(mine[1]).alias("j"), "v"), canonical=True, dtype=kind))

    return of(a, ("ai", "aj"), b, ("bi", "bj")), of(b, ("bi", "bj"), a, ("ai", "aj"))


def kron_jvp(a: SparseMatrix, a_dot: SparseMatrix, b: SparseMatrix, b_dot: SparseMatrix) -> SparseMatrix:
    return add(kron(a_dot, b), kron(a, b_dot))


def block_array_vjp(blocks: Sequence[Sequence[SparseMatrix | None]], cotangent: SparseMatrix) -> list[list[SparseMatrix | None]]:
    """The cotangent of each block, None where there is none."""
    grid = [list(r) for r in blocks]
    heights = [next((x.n_rows for x in r if x is not None), 0) for r in grid]
    widths = [next((r[q].n_cols for r in grid if r[q] is not None), 0) for q in range(len(grid[0]))]
    return [[None if x is None else _at(x, cotangent, sum(heights[:r]), sum(widths[:q])) for q, x in enumerate(row)] for r, row in enumerate(grid)]


def block_array_jvp(tangents: Sequence[Sequence[SparseMatrix | None]]) -> SparseMatrix:
    return block_array(tangents)


bmat_vjp, bmat_jvp = block_array_vjp, block_array_jvp


def block_diag_vjp(mats: Sequence[SparseMatrix], cotangent: SparseMatrix) -> list[SparseMatrix]:
    rows = cols = 0
    out = []
    for m in mats:
        out.append(_at(m, cotangent, rows, cols))
        rows, cols = rows + m.n_rows, cols + m.n_cols
    return out


def block_diag_jvp(tangents: Sequence[SparseMatrix]) -> SparseMatrix:
    return block_diag(tangents)


def vstack_vjp(blocks: Sequence[SparseMatrix], cotangent: SparseMatrix) -> list[SparseMatrix]:
    return [row[0] for row in block_array_vjp([[x] for x in blocks], cotangent)]


def vstack_jvp(tangents: Sequence[SparseMatrix]) -> SparseMatrix:
    return vstack(tangents)


def hstack_vjp(blocks: Sequence[SparseMatrix], cotangent: SparseMatrix) -> list[SparseMatrix]:
    return block_array_vjp([list(blocks)], cotangent)[0]


def hstack_jvp(tangents: Sequence[SparseMatrix]) -> SparseMatrix:
    return hstack(tangents)


# --- mapped axes


def vmap(product: Callable[[Dense], Dense], in_axis: int = 0, out_axis: int = 0) -> Callable[[Dense | np.ndarray], Dense | np.ndarray]:
    """A product (such as a.matvec or a.matmul) over one more axis of its dense operand, all of it in one batched product.

    Arrays are mapped along in_axis, and the results stand along out_axis; a batched Dense along its batches."""
    a = getattr(product, "__self__", None)
    if not isinstance(a, SparseMatrix) or product.__name__ not in ("matvec", "matmul", "batched_matvec", "batched_matmul"):
        raise TypeError("vmap takes a product of a sparse matrix; its values and structure are not mapped")
    batched = a.batched_matvec if product.__name__.endswith("matvec") else a.batched_matmul

    def run(x: Dense | np.ndarray) -> Dense | np.ndarray:
        if isinstance(x, Dense):
            return batched(x)
        moved = np.moveaxis(np.asarray(x), in_axis, 0)
        return np.moveaxis(batched(moved).collect().reshape(*moved.shape[: -1 if product.__name__.endswith("matvec") else -2], a.n_rows, *([] if product.__name__.endswith("matvec") else moved.shape[-1:])), 0, out_axis)

    return run
