"""Krylov solvers, each written once over a vector space."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..operators.matrix import SparseMatrix
from . import preconditioners as P
from .info import BREAKDOWN, CONVERGED, NOT_FINITE, NOT_POSITIVE, SolverInfo, finish
from .interface import LinearOperator
from .spaces import space

TINY, EPS = np.finfo(float).tiny, np.finfo(float).eps


def _start(a: object, b: object, x0: object, maxiter: int | None, distributed: bool | None):
    if not isinstance(a, (SparseMatrix, LinearOperator)):
        raise TypeError(f"expected a sparse matrix or an operator, got {type(a).__name__}")
    if a.shape[0] != a.shape[1]:
        raise ValueError(f"the matrix must be square, got {a.shape}")
    s, n = space(a, distributed), a.shape[0]
    b = s.vector(b, n)
    x = s.constant(n, 0.0) if x0 is None else s.vector(x0, n)
    r = b if x0 is None else s.combine((1.0, b), (-1.0, s.matvec(x)))
    return s, b, x, r, 10 * n if maxiter is None else maxiter


def _true(s, b, x) -> float:
    return s.norm(s.combine((1.0, b), (-1.0, s.matvec(x))))


def _limit(iterations: int) -> int:
    return max(1, iterations)


def cg(a, b, *, x0=None, rtol: float = 1e-5, atol: float = 0.0, maxiter: int | None = None, M=None, callback: Callable | None = None, return_info: bool = False, distributed: bool | None = None):
    """Preconditioned conjugate gradients; success is confirmed with the true residual."""
    s, b, x, r, most = _start(a, b, x0, maxiter, distributed)
    m = P.aspreconditioner(M, a)
    goal = max(atol, rtol * s.norm(b))
    done = lambda status, k: finish(s.result(x), SolverInfo(status, norm, k, rtol, atol), callback, return_info)
    norm = s.norm(r)
    if not np.isfinite(norm):
        return done(NOT_FINITE, 0)
    if norm <= goal:
        return done(CONVERGED, 0)
    z = m.apply(s, r)
    p, rz = z, s.dot(r, z)
    for k in range(1, most + 1):
        q = s.matvec(p)
        pq = s.dot(p, q)
        if not np.isfinite(pq) or not np.isfinite(rz):
            return done(NOT_FINITE, k - 1)
        if pq <= 0 or rz <= 0:
            return done(NOT_POSITIVE, k - 1)
        alpha, old = rz / pq, (x, r, z, p, q)
        x, r = s.combine((1.0, x), (alpha, p)), s.combine((1.0, r), (-alpha, q))
        z = m.apply(s, r)
        square, new = s.dots([r, z], r)  # both in one pass
        norm = float(np.sqrt(square))
        if norm <= goal:
            norm = _true(s, b, x)
            if norm <= goal:
                return done(CONVERGED, k)
            r = s.combine((1.0, b), (-1.0, s.matvec(x)))
            z = m.apply(s, r)
            new = s.dot(r, z)
        p, rz = s.combine((1.0, z), (new / rz, p)), new
        s.retire(old, (x, r, z, p, b))
    norm = _true(s, b, x)
    return done(CONVERGED if norm <= goal else _limit(most), most)


def bicgstab(a, b, x0=None, *, rtol: float | None = None, atol: float = 0.0, tol: float | None = None, maxiter: int | None = None, M=None, callback: Callable | None = None, return_info: bool = False, distributed: bool | None = None):
    """Stabilised bi-conjugate gradients for general matrices; tol is another name of rtol."""
    if tol is not None and rtol is not None and tol != rtol:
        raise ValueError("rtol and tol differ")
    rtol = 1e-5 if (rtol is None and tol is None) else (rtol if rtol is not None else tol)
    s, b, x, r, most = _start(a, b, x0, maxiter, distributed)
    m = P.aspreconditioner(M, a)
    goal = max(atol, rtol * s.norm(b))
    done = lambda status, k: finish(s.result(x), SolverInfo(status, norm, k, rtol, atol), callback, return_info)
    norm = s.norm(r)
    if norm <= goal:
        return done(CONVERGED, 0)
    shadow, p, v, rho, alpha, omega = r, None, None, 1.0, 1.0, 1.0
    for k in range(1, most + 1):
        new = s.dot(shadow, r)
        if not np.isfinite(new):
            return done(NOT_FINITE, k - 1)
        if abs(new) <= TINY:
            return done(BREAKDOWN, k - 1)
        old = (p, v)
        p = r if p is None else s.combine((1.0, r), (new / rho * alpha / omega, p), (-new / rho * alpha, v))
        s.retire(old, (p, r, x, b, shadow))
        rho = new
        p_hat = m.apply(s, p)
        v = s.matvec(p_hat)
        down = s.dot(shadow, v)
        if abs(down) <= TINY:
            return done(BREAKDOWN, k - 1)
        alpha = rho / down
        half = s.combine((1.0, r), (-alpha, v))
        if s.norm(half) <= goal:
            x = s.combine((1.0, x), (alpha, p_hat))
            norm = _true(s, b, x)
            if norm <= goal:
                return done(CONVERGED, k)
            r, p = s.combine((1.0, b), (-1.0, s.matvec(x))), None
            shadow = r
            continue
        h_hat = m.apply(s, half)
        t = s.matvec(h_hat)
        tt = s.dot(t, t)
        if tt <= TINY:
            return done(BREAKDOWN, k)
        omega, old = s.dot(t, half) / tt, (x, r, half, p_hat, h_hat, t)
        x = s.combine((1.0, x), (alpha, p_hat), (omega, h_hat))
        r = s.combine((1.0, half), (-omega, t))
        s.retire(old, (x, r, p, v, b, shadow))
        norm = s.norm(r)
        if norm <= goal:
            norm = _true(s, b, x)
            if norm <= goal:
                return done(CONVERGED, k)
        if abs(omega) <= TINY:
            return done(BREAKDOWN, k)
    norm = _true(s, b, x)
    return done(CONVERGED if norm <= goal else _limit(most), most)


def gmres(a, b, *, x0=None, rtol: float = 1e-5, atol: float = 0.0, restart: int | None = None, maxiter: int | None = None, M=None, callback: Callable | None = None, callback_type: str = "x", return_info: bool = False, distributed: bool | None = None):
    """Restarted GMRES, preconditioned from the left; maxiter counts products, and each restart tests the true residual."""
    if callback_type not in ("x", "pr_norm", "legacy"):
        raise ValueError(f"unknown callback type {callback_type!r}")
    s, b, x, r, most = _start(a, b, x0, maxiter, distributed)
    m, n = P.aspreconditioner(M, a), a.shape[0]
    restart = min(20 if restart is None else restart, n) or 1
    goal = max(atol, rtol * s.norm(b))
    done = lambda status, k: finish(s.result(x), SolverInfo(status, norm, k, rtol, atol), callback, return_info, "x" if callback_type == "x" else "norm")
    used, norm = 0, s.norm(r)
    while True:
        if not np.isfinite(norm):
            return done(NOT_FINITE, used)
        if norm <= goal:
            return done(CONVERGED, used)
        if used >= most:
            return done(_limit(used), used)
        z = m.apply(s, r)
        beta = s.norm(z)
        if beta <= TINY:
            return done(BREAKDOWN, used)
        small_goal = 0.5 * goal * beta / norm
        basis, h = [s.combine((1 / beta, z))], np.zeros((restart + 1, restart))
        y = np.zeros(0)
        for k in range(restart):
            w = m.apply(s, s.matvec(basis[k]))
            used += 1
            size = s.norm(w)
            for _ in range(2):  # twice is enough for orthogonality
                c = s.dots(basis, w)
                h[: k + 1, k] += c
                w = s.combine((1.0, w), *((-ck, q) for ck, q in zip(c, basis, strict=True)))
            h[k + 1, k] = s.norm(w)
            rhs = np.zeros(k + 2)
            rhs[0] = beta
            y, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], rhs, rcond=None)
            left = np.linalg.norm(rhs - h[: k + 2, : k + 1] @ y)
            if left <= small_goal or used >= most or h[k + 1, k] <= 1e-14 * max(size, TINY):
                break
            if k + 1 < restart:
                basis.append(s.combine((1 / h[k + 1, k], w)))
        old = (x, r, z, *basis)
        x = s.combine((1.0, x), *((yk, q) for yk, q in zip(y, basis, strict=False)))
        r = s.combine((1.0, b), (-1.0, s.matvec(x)))
        s.retire(old, (x, r, b))
        before, norm = norm, s.norm(r)
        if norm > goal and norm >= before * (1 - 1e-12):
            return done(BREAKDOWN if used < most else _limit(used), used)


def minres(a, b, *, x0=None, rtol: float = 1e-5, atol: float = 0.0, shift: float = 0.0, maxiter: int | None = None, M=None, check_preconditioner: bool = True, callback: Callable | None = None, return_info: bool = False, distributed: bool | None = None):
    """Minimal residuals for symmetric, perhaps indefinite, A - shift I (Paige and Saunders 1975).

    Lanczos makes a tridiagonal matrix column by column; plane rotations turn each new column into one of an upper
    triangular matrix with two diagonals above its own, and x moves along the column of the basis times its inverse.
    check_preconditioner: a preconditioner with an entry that isn't positive is reported before the first step."""
    s, b, x, r, most = _start(a, b, x0, maxiter, distributed)
    m = P.aspreconditioner(M, a)
    if m.kind not in ("identity", "diagonal", "jacobi"):
        raise TypeError("minres takes identity, diagonal or jacobi preconditioners")
    op = (lambda v: s.combine((1.0, s.matvec(v)), (-shift, v))) if shift else s.matvec
    residual = lambda: s.norm(s.combine((1.0, b), (-1.0, op(x))))
    goal = max(atol, rtol * s.norm(b))
    done = lambda status, k: finish(s.result(x), SolverInfo(status, norm, k, rtol, atol), callback, return_info)
    if x0 is not None and shift:
        r = s.combine((1.0, b), (-1.0, op(x)))
    norm = s.norm(r)
    if check_preconditioner and isinstance(m, P.DiagonalPreconditioner) and not m.positive:
        return done(NOT_POSITIVE, 0)
    if norm <= goal:
        return done(CONVERGED, 0)
    z = m.apply(s, r)
    length = s.dot(r, z)
    if length <= 0:
        return done(NOT_POSITIVE, 0)
    above = np.sqrt(length)  # the matrix's entry above the diagonal, here that of no column
    first, before = above, None
    here, there = s.combine((1 / above, r)), s.combine((1 / above, z))  # the basis vector, and the preconditioner times it
    turns = [(1.0, 0.0), (1.0, 0.0)]  # cosine and sine of the last two rotations
    ways: list = []  # the last two directions
    left = first  # what the rotations have left of the right-hand side
    for k in range(1, most + 1):
        w = op(there)
        middle = s.dot(there, w)
        w = s.combine((1.0, w), (-middle, here), *([(-above, before)] if before is not None else []))
        z = m.apply(s, w)
        length = s.dot(w, z)
        if not np.isfinite(length):
            return done(NOT_FINITE, k)
        if length < -1e-12 * above * above:
            return done(NOT_POSITIVE, k)
        below = np.sqrt(max(length, 0.0))
        # the column (above, middle, below) under the last two rotations, and then its own
        entry = above if before is not None else 0.0
        (c2, s2), (c1, s1) = turns
        second, entry = s2 * entry, c2 * entry
        one, pivot = c1 * entry + s1 * middle, c1 * middle - s1 * entry
        size = max(np.hypot(pivot, below), EPS)
        turns = [(c1, s1), (pivot / size, below / size)]
        known = zip((second, one), [None] * (2 - len(ways)) + ways, strict=True)
        way = s.combine((1 / size, there), *((-entry_of / size, u) for entry_of, u in known if u is not None))
        old, ways = (x, before, *ways), [*ways[-1:], way]
        x = s.combine((1.0, x), (pivot / size * left, way))
        s.retire(old, (x, b, r, here, there, w, z, *ways))
        left *= -below / size
        norm = residual()
        if norm <= goal:
            return done(CONVERGED, k)
        if below <= 1e-14 * above:
            return done(BREAKDOWN, k)
        before, here, there, above = here, s.combine((1 / below, w)), s.combine((1 / below, z)), below
    return done(_limit(most), most)
