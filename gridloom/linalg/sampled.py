"""Singular values of large matrices by random sampling.

A times a few random columns spans, but for a small rest, what A's leading singular vectors span. The sampled columns are
made orthonormal by a tall QR (reduction trees, linalg.tsqr), A.T times them is reduced to a small triangle the same way,
and the triangle's singular values are A's. Each pass over A is one product with a block of columns, so the number of jobs
doesn't depend on the matrix; more passes (power) separate values that lie close together. The rest is measured by what
the orthonormal columns miss of A times other random columns, which bounds the error with a stated probability.

Where one side is short enough for its columns to be sent to tasks, a product with A and A.T is one pass over records of the
cells, none of which is sent (operators.passes); only A.T Q, or A Q, of the longer side is a frame."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from ..operators.dense import Dense, dense
from ..operators.matrix import COOArray, SparseMatrix
from ..operators.passes import Passes, passable
from ..plans.lineage import cut, release
from .spaces import BASIS_VALUES
from .tsqr import substituted, triangle

#: Columns besides those that are asked for, and columns that measure the rest: the bound fails with a chance of 10 ** -PROBES.
MORE, PROBES = 10, 6


@dataclass
class Sampled:
    """Singular values, their vectors as Dense matrices, and a bound of |A - U S V.T| that holds with probability 1 - 10 ** -PROBES, before truncation to k."""

    values: np.ndarray
    left: Dense
    right: Dense
    bound: float


def _block(x: Dense) -> COOArray:
    """A dense matrix of few columns as cells."""
    return COOArray(x.df.select("i", F.col("k").alias("j"), F.col("x").alias("v")), x.shape, canonical=True)


def _normal(a: SparseMatrix, n: int, columns: int, seed: int) -> Dense:
    """Random columns: a value belongs to its place and the seed, so lost tasks make the same again."""
    place = a.spark.range(n * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("k"))
    u = lambda t: (F.shiftrightunsigned(F.xxhash64(F.lit(seed * 2 + t), "i", "k"), 11) + 0.5) / float(2**53)
    return Dense(place.select("i", "k", (F.sqrt(-2 * F.log(u(0))) * F.cos(2 * np.pi * u(1))).alias("x")), (n, columns))


def _orthonormal(x: Dense, twice: bool) -> Dense:
    """Columns that span those of x, written; columns that add nothing are left out.

    twice: a second pass takes out the error that the columns' condition leaves; a basis that is multiplied on does without."""
    kept = Dense(cut(x.df.select("i", "k", "x"), "block"), x.shape)
    r = triangle(_block(kept).df, x.shape[1])
    u, sv, vt = np.linalg.svd(r)
    some = sv > 1e-13 * max(sv.max(initial=0.0), 1e-300)
    turn = vt[some].T / sv[some]
    out = _block(kept).matmul(dense(kept.df.sparkSession, turn)) if some.any() else None
    if out is None:
        raise RuntimeError("the matrix has no cells that are not zero")
    q = Dense(cut(out.df.select("i", "k", "x"), "block"), out.shape)
    release(kept.df)
    if not twice:
        return q
    again = substituted(triangle(_block(q).df, q.shape[1]), np.eye(q.shape[1]))
    done = _block(q).matmul(dense(q.df.sparkSession, again))
    final = Dense(cut(done.df.select("i", "k", "x"), "block"), done.shape)
    release(q.df)
    return final


def sampled_svds(a: SparseMatrix, k: int = 6, *, power: int = 2, more: int = MORE, seed: int = 0) -> Sampled:
    """The k leading singular values and vectors. power: passes by A.T and A before the basis is taken."""
    if not 0 < k <= min(a.shape):
        raise ValueError(f"k must be between 1 and {min(a.shape)}")
    if power < 0 or more < 0:
        raise ValueError("power and more must not be negative")
    a = a if a._written else a.canonicalize().persist()
    columns = min(k + more, *a.shape)
    if passable(min(a.shape), columns):
        return _passed(a, k, columns, power, seed)
    q = _orthonormal(a.matmul(_normal(a, a.n_cols, columns, seed)), not power)
    for t in range(power):
        z = _orthonormal(a.matmul_transpose(q), False)
        release(q.df)
        q = _orthonormal(a.matmul(z), t == power - 1)
        release(z.df)
    across = a.matmul_transpose(q)  # A.T Q
    b = Dense(cut(across.df.select("i", "k", "x"), "block"), across.shape)
    r = triangle(_block(b).df, b.shape[1])  # A.T Q = Z R, so Q.T A = R.T Z.T
    u, values, _ = np.linalg.svd(r.T)
    some = min(k, len(values))
    left = _block(q).matmul(dense(a.spark, u[:, :some]))
    scale = np.where(values[:some] > 0, values[:some], 1.0)
    right = _block(b).matmul(dense(a.spark, u[:, :some] / scale))
    # what Q misses of A times random columns
    y = Dense(cut(a.matmul(_normal(a, a.n_cols, PROBES, seed + 1)).df.select("i", "k", "x"), "block"), (a.n_rows, PROBES))
    seen = _block(q).matmul(_block(q).matmul_transpose(y).collect())
    missed = y.df.select("i", "k", "x").union(seen.df.select("i", "k", -F.col("x"))).groupBy("i", "k").agg(F.sum("x").alias("x")).groupBy("k").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    bound = 10 * np.sqrt(2 / np.pi) * float(np.sqrt(missed.agg(F.max("s")).first()[0] or 0.0))
    return Sampled(values[:some], left, right, bound)


def _passed(a: SparseMatrix, k: int, columns: int, power: int, seed: int) -> Sampled:
    """The same with the columns of the shorter side as an array, which is sent to tasks."""
    left_short, n, long = a.n_rows <= a.n_cols, min(a.shape), max(a.shape)
    passes = Passes(a, "j" if left_short else "i")

    def orthonormal(x: np.ndarray) -> np.ndarray:
        u, sv, _ = np.linalg.svd(x, full_matrices=False)
        if not sv.max(initial=0.0) > 0:
            raise RuntimeError("the matrix has no cells that are not zero")
        return u[:, sv > 1e-13 * sv.max()]

    q = orthonormal(passes.random(columns, seed))
    if power and n * columns * (power + 1) <= BASIS_VALUES:
        # the best columns of what all passes give, not of the last one alone: where a value comes often, columns share it with more of the rest
        v, av = q, passes.normal(q)
        for _ in range(power):
            z = av[:, -q.shape[1] :]
            w = z - v @ (v.T @ z)
            u, sv, _ = np.linalg.svd(w, full_matrices=False)
            q = u[:, sv > 1e-10 * np.linalg.norm(z)]
            if not q.shape[1]:
                break
            q = np.linalg.qr(q - v @ (v.T @ q))[0]
            v, av = np.hstack([v, q]), np.hstack([av, passes.normal(q)])
        small = v.T @ av
        q = orthonormal(v @ np.linalg.eigh((small + small.T) / 2)[1][:, ::-1][:, :columns])
    else:
        for _ in range(power):
            q = orthonormal(passes.normal(q))
    b = Dense(passes.frame(q), (long, q.shape[1]))
    u, values, _ = np.linalg.svd(triangle(_block(b).df, b.shape[1]).T)  # as above
    some = min(k, len(values))
    near = dense(a.spark, q @ u[:, :some])
    far = _block(b).matmul(dense(a.spark, u[:, :some] / np.where(values[:some] > 0, values[:some], 1.0)))
    y = passes.random(PROBES, seed + 1)
    missed = y - q @ (q.T @ y)
    passes.release()
    bound = 10 * np.sqrt(2 / np.pi) * float(np.sqrt((missed**2).sum(0).max(initial=0.0)))
    return Sampled(values[:some], near if left_short else far, far if left_short else near, bound)
