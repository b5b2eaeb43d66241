"""Lanczos and Arnoldi, and the eigenvalues and singular values read from them.

Without tol and maxiter, values are those of one run of ncv steps. With either, runs are restarted until each wanted
pair's residual is below tol times its value: a restart keeps the wanted directions (an invariant subspace of the small
matrix, turned into as many vectors) and one more vector, in which the small matrix is coupled to the rest. For symmetric
matrices that is thick-restart Lanczos, for others Krylov-Schur; what is kept in vectors never exceeds ncv + 1.

A symmetric matrix that is too large for the driver takes a job a step, so restarted runs go on with ncv vectors at once
there: block Lanczos, of BASIS blocks at most, whose steps are as many as ncv vectors together need, and which finds a value
as often as it occurs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions import values as V
from ..operators.dense import Dense, dense
from ..operators.matrix import DENSE_CELLS, SparseMatrix
from ..operators.passes import Passes, passable
from ..plans.lineage import cut, release
from .interface import LinearOperator
from .spaces import BASIS, Blocks, Local, blocks_fit, fits, space

EPS = np.finfo(float).eps
WHICH = ("LM", "SM", "LA", "SA", "LR", "SR")


@dataclass
class Basis:
    """alphas and betas (Lanczos) or h (Arnoldi), and the orthonormal vectors, in the space they were made in."""

    small: np.ndarray
    betas: np.ndarray
    vectors: list
    space: object

    def combined(self, y: np.ndarray) -> list:
        return [self.space.combine(*((float(c), q) for c, q in zip(col, self.vectors, strict=False))) for col in y.T]


def _seeded(n: int, round_: int) -> np.ndarray:
    return np.random.default_rng(20240 + round_).standard_normal(n)


def _krylov(s, op, n: int, k: int, v0: object, symmetric: bool, restart: bool = True, whole: bool = True) -> Basis:
    """k steps, each vector orthogonal to all before it, or if not whole only to the last two, as three terms give in exact arithmetic; where the space closes early, a seeded vector orthogonal to it goes on, so all k vectors are there."""
    k = min(k, n)
    q = s.vector(np.ones(n) if v0 is None else v0, n)
    size = s.norm(q)
    if not np.isfinite(size) or size <= 0:
        raise ValueError("the start vector must be finite and not zero")
    basis, h, betas = [s.combine((1 / size, q))], np.zeros((k, k)), []
    for m in range(k):
        w = op(basis[m])
        scale = s.norm(w)
        lo = 0 if whole else max(0, m - 1)
        for _ in range(2 if whole else 1):
            c = s.dots(basis[lo:], w)
            h[lo : m + 1, m] += c
            w = s.combine((1.0, w), *((-ck, u) for ck, u in zip(c, basis[lo:], strict=True)))
        beta = s.norm(w)
        closed = beta <= 100 * EPS * max(scale, abs(h).max(), 1e-300)
        betas.append(0.0 if closed else beta)
        if m + 1 == k:
            break
        tries = 0
        while closed and restart:
            w = s.vector(_seeded(n, m + 100 * tries), n)
            for _ in range(2):
                c = s.dots(basis, w)
                w = s.combine((1.0, w), *((-ck, u) for ck, u in zip(c, basis, strict=True)))
            beta, tries = s.norm(w), tries + 1
            if beta > 1e-8 or tries > 5:
                break
        if closed and (not restart or beta <= 1e-8):
            h, betas = h[: m + 1, : m + 1], betas[: m + 1]
            break
        h[m + 1, m] = betas[-1]
        basis.append(s.combine((1 / beta, w)))
    if symmetric:
        h = (h + h.T) / 2
    return Basis(h, np.array(betas), basis, s)


def lanczos(a: SparseMatrix, k: int, *, v0: object = None, reorthogonalize: bool = True, return_basis: bool = True, distributed: bool | None = None):
    """alphas, betas and, if asked for, the basis as a dense matrix of k columns; stops early where the space closes."""
    _square(a)
    if not 0 < k <= a.shape[0]:
        raise ValueError(f"k must be between 1 and {a.shape[0]}")
    s = space(a, distributed)
    got = _krylov(s, s.matvec, a.shape[0], k, v0, True, restart=False, whole=reorthogonalize)
    alphas = np.diag(got.small).copy()
    return (alphas, got.betas, _columns(s, got.vectors)) if return_basis else (alphas, got.betas)


def arnoldi(a: SparseMatrix | LinearOperator, k: int, *, v0: object = None, distributed: bool | None = None):
    """The k by k Hessenberg matrix of k Arnoldi steps, and the basis."""
    _square(a)
    if not 0 < k <= a.shape[0]:
        raise ValueError(f"k must be between 1 and {a.shape[0]}")
    s = space(a, distributed)
    got = _krylov(s, s.matvec, a.shape[0], k, v0, False, restart=False)
    return got.small, _columns(s, got.vectors)


def normal_lanczos(a: SparseMatrix | LinearOperator, k: int, *, v0: object = None, distributed: bool | None = None):
    """alphas, betas and basis of Lanczos on A.T A: two products a step, A.T A is never formed."""
    if not 0 < k <= a.shape[1]:
        raise ValueError(f"k must be between 1 and {a.shape[1]}")
    s = space(a, distributed)
    got = _krylov(s, lambda x: s.rmatvec(s.matvec(x)), a.shape[1], k, v0, True, restart=False)
    return np.diag(got.small).copy(), got.betas, _columns(s, got.vectors)


def _square(a: object) -> None:
    if not isinstance(a, (SparseMatrix, LinearOperator)):
        raise TypeError(f"expected a sparse matrix or an operator, got {type(a).__name__}")
    if a.shape[0] != a.shape[1]:
        raise ValueError(f"the matrix must be square, got {a.shape}")


def _columns(s, vectors: list) -> Dense | np.ndarray:
    from functools import reduce

    from pyspark.sql import functions as F

    if isinstance(s, Local):
        stacked = np.stack(vectors, 1)
        return dense(s.spark, stacked) if isinstance(s.a, SparseMatrix) else stacked
    df = reduce(lambda p, q: p.union(q), (v.df.select("i", F.lit(k).cast("long").alias("k"), "x") for k, v in enumerate(vectors)))
    return Dense(df, (vectors[0].shape[0], len(vectors)))


def _chosen(values: np.ndarray, k: int, which: str) -> np.ndarray:
    if which not in WHICH:
        raise ValueError(f"which must be one of {WHICH}, got {which!r}")
    key = {"LM": -abs(values), "SM": abs(values), "LA": -values.real, "LR": -values.real, "SA": values.real, "SR": values.real}[which]
    return np.argsort(key, kind="stable")[:k]


def _size(n: int, k: int, ncv: int | None) -> int:
    if not 0 < k <= n:
        raise ValueError(f"k must be between 1 and {n}")
    size = min(n, max(k + 1, 2 * k + 1)) if ncv is None else ncv
    if not k <= size <= n:
        raise ValueError(f"ncv must be between k and {n}")
    return size


#: Restarts if none are given, and the least relative residual that can be asked for.
RESTARTS, FINEST = 300, 1e-12


def _directions(h: np.ndarray, order: np.ndarray, values: np.ndarray, y: np.ndarray, p: int, symmetric: bool) -> np.ndarray:
    """Orthonormal columns that span the first p eigenvectors, conjugate pairs together."""
    if symmetric:
        return y[:, order[:p]]
    cols, seen = [], set()
    for t in order:
        if len(cols) >= p:
            break
        if t in seen:
            continue
        if abs(values[t].imag) > 1e-14 * max(abs(values[t]), 1e-300):
            seen.add(int(np.argmin(abs(values - values[t].conj()))))
            cols += [y[:, t].real, y[:, t].imag]
        else:
            cols.append(y[:, t].real)
        seen.add(int(t))
    return np.linalg.qr(np.stack(cols, 1))[0]


def _restarted(s, op, n: int, k: int, ncv: int, which: str, v0: object, symmetric: bool, tol: float, maxiter: int | None) -> tuple[np.ndarray, np.ndarray, list]:
    """(values, small vectors, basis) of k wanted eigenpairs, all of them with a residual of at most tol times the value."""
    m = min(n, max(ncv, k + 2))
    tol = max(tol, FINEST)
    q = s.vector(np.ones(n) if v0 is None else v0, n)
    size = s.norm(q)
    if not np.isfinite(size) or size <= 0:
        raise ValueError("the start vector must be finite and not zero")
    basis, h, fresh, before = [s.combine((1 / size, q))], np.zeros((m, m)), 0, None
    for _ in range(RESTARTS if maxiter is None else maxiter):
        beta, w = 0.0, None
        for j in range(len(basis) - 1, m):
            w = op(basis[j])
            scale = s.norm(w)
            col = np.zeros(j + 1)
            for _ in range(2):
                c = s.dots(basis, w)
                col += c
                w = s.combine((1.0, w), *((-float(x), u) for x, u in zip(c, basis, strict=True)))
            h[: j + 1, j] = col
            beta = s.norm(w)
            closed = beta <= 100 * EPS * max(scale, abs(h).max(), 1e-300)
            if closed and len(basis) < n:  # the space is invariant: a vector outside goes on, with nothing to couple it
                beta = 0.0
                for fresh in range(fresh + 1, fresh + 7):
                    w = s.vector(_seeded(n, fresh), n)
                    for _ in range(2):
                        c = s.dots(basis, w)
                        w = s.combine((1.0, w), *((-float(x), u) for x, u in zip(c, basis, strict=True)))
                    if (length := s.norm(w)) > 1e-8:
                        break
                w = s.combine((1 / length, w))
            elif not closed:
                w = s.combine((1 / beta, w))
            else:
                beta, w = 0.0, None
            if j + 1 < m and w is not None:
                h[j + 1, j] = beta
                basis.append(w)
            elif w is None:
                break
        size = len(basis)
        small = h[:size, :size].copy()
        if symmetric:
            small = (small + small.T) / 2
        values, y = (np.linalg.eigh if symmetric else np.linalg.eig)(small)
        order = _chosen(values, size, which)
        at = order[:k]
        if (beta * abs(y[-1, at]) <= tol * np.maximum(abs(values[at]), EPS * abs(values).max(initial=0.0))).all():
            # a space that closed may lack copies of a value: one more round, from outside it, must find the same ones
            if not fresh or size == n or before is not None and np.allclose(before, values[at], rtol=max(tol, 1e-9)):
                return values[at], y[:, at], basis
            before = values[at]
        turn = _directions(small, order, values, y, min(size - 2, k + (size - k) // 2), symmetric)  # a conjugate pair may add one
        p = turn.shape[1]
        kept = [s.combine(*((float(x), u) for x, u in zip(col, basis, strict=True))) for col in turn.T]
        h[:] = 0
        h[:p, :p] = turn.T @ small @ turn
        h[p, :p] = beta * turn[-1]
        old, basis = basis, [*kept, w]
        s.retire(tuple(old), tuple(basis))
    raise RuntimeError(f"{k} pairs have not settled to {tol:.1e} in {RESTARTS if maxiter is None else maxiter} restarts of {m} vectors")


def _blocked(op, n: int, k: int, b: int, which: str, v0: object, tol: float, maxiter: int | None) -> tuple[np.ndarray, np.ndarray, list]:
    """The same as _restarted for a symmetric op that takes b columns at once; they are arrays, BASIS blocks of them at most."""
    b, tol = min(n, max(b, k + 2)), max(tol, FINEST)
    most = min(n, BASIS * b)
    keep = min(2 * b, most - 1)
    rng = np.random.default_rng(20240)
    x = rng.standard_normal((n, b))
    if v0 is not None:
        x[:, 0] = v0.collect() if isinstance(v0, Dense) else np.asarray(v0, float)
        if not np.isfinite(x[:, 0]).all() or not x[:, 0].any():
            raise ValueError("the start vector must be finite and not zero")
    v = np.linalg.qr(x)[0]
    av, rest = op(v), None
    for _ in range(RESTARTS if maxiter is None else maxiter):
        while True:
            if rest is None:  # what the last products add to the space
                rest = av[:, -b:]
            if v.shape[1] < most:
                w = rest[:, : most - v.shape[1]]
                for _ in range(3):  # columns that add nothing are noise at first, and orthogonal in the end
                    w = np.linalg.qr(w - v @ (v.T @ w))[0]
                v, av = np.hstack([v, w]), np.hstack([av, op(w)])
            rest = None
            if v.shape[1] == most:
                break
        small = v.T @ av
        values, y = np.linalg.eigh((small + small.T) / 2)
        order = _chosen(values, len(values), which)
        at = order[:k]
        off = av @ y[:, order[:b]] - (v @ y[:, order[:b]]) * values[order[:b]]
        if most == n or (np.linalg.norm(off[:, :k], axis=0) <= tol * np.maximum(abs(values[at]), EPS * abs(values).max(initial=0.0))).all():
            return values[at], y[:, at], list(v.T)
        turn = y[:, order[:keep]]
        v, av, rest = v @ turn, av @ turn, off
    raise RuntimeError(f"{k} pairs have not settled to {tol:.1e} in {RESTARTS if maxiter is None else maxiter} restarts of {b} columns")


def _blocks(a: object, n: int, k: int, ncv: int | None, tol: float, maxiter: int | None, distributed: bool | None, normal: bool) -> Blocks | None:
    """The space of a restarted run that takes a block of vectors at once: of a matrix that is too large for the driver, whose vectors are not."""
    if distributed is not None or not isinstance(a, SparseMatrix) or a.dtype == V.COMPLEX or not (tol > 0 or maxiter is not None) or fits(a):
        return None
    return Blocks(a, normal) if blocks_fit(n, _columns_at_once(n, k, ncv)) else None


def _columns_at_once(n: int, k: int, ncv: int | None) -> int:
    return _size(n, k, ncv) if ncv is not None else min(n, max(2 * k + 1, 20))


def gram_operator(a: SparseMatrix) -> LinearOperator:
    """A A.T as an operator on vectors of frames, which is never formed: a pass over A for each product where its vectors may be sent to tasks."""
    a = a if a._written else a.canonicalize().persist()
    n = a.n_rows
    if passable(n, 1):
        passes = Passes(a, "j")
        f = lambda x: dense(a.spark, passes.normal(x.collect()[:, None])[:, 0])
    else:

        def f(x: Dense) -> Dense:
            z = Dense(cut(a.matvec_transpose(x).df.select("i", "x")), (a.n_cols,))
            y = Dense(cut(a.matvec(z).df.select("i", "x")), (n,))
            release(z.df)
            return y

    return LinearOperator((n, n), f, f, local=False)


def _pairs(s, op, n: int, k: int, ncv: int | None, which: str, v0: object, symmetric: bool, tol: float, maxiter: int | None) -> tuple[np.ndarray, np.ndarray, Basis]:
    """Values, small vectors and the basis that they combine."""
    if maxiter is not None and maxiter < 1 or tol < 0:
        raise ValueError("tol must not be negative and maxiter must be 1 or more")
    if tol or maxiter is not None:
        size = _columns_at_once(n, k, ncv)
        if isinstance(s, Blocks):
            values, y, vectors = _blocked(s.product, n, k, size, which, v0, tol, maxiter)
            return values, y, Basis(np.zeros((0, 0)), np.zeros(0), vectors, s)
        values, y, vectors = _restarted(s, op, n, k, size, which, v0, symmetric, tol, maxiter)
        return values, y, Basis(np.zeros((0, 0)), np.zeros(0), vectors, s)
    got = _krylov(s, op, n, _size(n, k, ncv), v0, symmetric)
    values, y = (np.linalg.eigh if symmetric else np.linalg.eig)(got.small)
    if len(values) < k:
        raise RuntimeError(f"only {len(values)} eigenvalues were found")
    at = _chosen(values, k, which)
    return values[at], y[:, at], got


def eigsh(a, k: int = 6, *, which: str = "LM", v0: object = None, ncv: int | None = None, maxiter: int | None = None, tol: float = 0.0, return_eigenvectors: bool = True, distributed: bool | None = None):
    """Eigenpairs of a symmetric matrix, from one Lanczos run of ncv steps or, with tol or maxiter, from restarted ones."""
    _square(a)
    s = _blocks(a, a.shape[0], k, ncv, tol, maxiter, distributed, False) or space(a, distributed)
    values, y, got = _pairs(s, s.matvec, a.shape[0], k, ncv, which, v0, True, tol, maxiter)
    return (values, _columns(s, got.combined(y))) if return_eigenvectors else values


def eigs(a, k: int = 6, *, which: str = "LM", v0: object = None, ncv: int | None = None, maxiter: int | None = None, tol: float = 0.0, return_eigenvectors: bool = True, distributed: bool | None = None):
    """Eigenpairs of a general matrix, from one Arnoldi run or restarted ones; values and vectors may be complex (numpy arrays)."""
    _square(a)
    s = space(a, distributed)
    values, y, got = _pairs(s, s.matvec, a.shape[0], k, ncv, which, v0, False, tol, maxiter)
    if not return_eigenvectors:
        return values
    if a.shape[0] * k > DENSE_CELLS:
        raise ValueError(f"{k} vectors of {a.shape[0]} are more than {DENSE_CELLS} values for the driver; ask for the values alone")
    real, imag = (got.combined(part) for part in (y.real, y.imag))
    as_array = lambda v: v if isinstance(v, np.ndarray) else v.collect()
    return values, np.stack([as_array(p) + 1j * as_array(q) for p, q in zip(real, imag, strict=True)], 1)


def _svds_blocked(s: Blocks, k: int, ncv: int | None, tol: float, maxiter: int | None, wanted: bool | str):
    """Singular triples from the smaller of A A.T and A.T A; the vectors of the larger side are one product, and stay a frame."""
    a, n = s.a, min(s.shape)
    values, y, got = _pairs(s, None, n, k, ncv, "LM", None, True, tol, maxiter)
    sigma = np.sqrt(np.maximum(values, 0))
    if wanted is False:
        return sigma
    own = np.stack(got.combined(y), 1)
    near = dense(a.spark, own)
    if wanted == ("u" if s.left else "vh"):
        return (near, sigma, None) if s.left else (None, sigma, near)
    scaled = own / np.where(sigma > EPS, sigma, np.inf)
    far = Dense(s.passes.frame(scaled), (max(s.shape) if s.left else a.n_rows, k))
    left, right = (near, far) if s.left else (far, near)
    return left if wanted != "vh" else None, sigma, right if wanted != "u" else None


def svds(a, k: int = 6, *, which: str = "LM", v0: object = None, ncv: int | None = None, maxiter: int | None = None, tol: float = 0.0, return_singular_vectors: bool | str = True, distributed: bool | None = None):
    """Singular values and vectors from Lanczos on A.T A, whose product is never formed; with tol or maxiter, restarted."""
    if which not in ("LM", "SM"):
        raise ValueError("which must be 'LM' or 'SM'")
    if return_singular_vectors not in (True, False, "u", "vh"):
        raise ValueError("return_singular_vectors must be True, False, 'u' or 'vh'")
    if not 0 < k <= min(a.shape):
        raise ValueError(f"k must be between 1 and {min(a.shape)}")
    if (blocks := _blocks(a, min(a.shape), k, ncv, tol, maxiter, distributed, True) if which == "LM" and v0 is None else None) is not None:
        return _svds_blocked(blocks, k, ncv, tol, maxiter, return_singular_vectors)
    s, n = space(a, distributed), a.shape[1]
    values, y, got = _pairs(s, lambda x: s.rmatvec(s.matvec(x)), n, k, ncv, which, v0, True, tol, maxiter)
    sigma = np.sqrt(np.maximum(values, 0))
    if return_singular_vectors is False:
        return sigma
    v = got.combined(y)
    u = []
    if return_singular_vectors != "vh":
        for x, sg in zip(v, sigma, strict=True):
            u.append(s.combine((1 / sg if sg > EPS else 0.0, s.matvec(x))))
    left = _columns(s, u) if u else None
    right = _columns(s, v) if return_singular_vectors != "u" else None
    return left, sigma, right
