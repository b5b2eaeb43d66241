"""Matrix-free operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..operators.dense import Dense
from ..operators.matrix import SparseMatrix


class LinearOperator:
    """Products given as callables. local: they take and return numpy arrays; otherwise Dense vectors."""

    def __init__(self, shape: tuple[int, int], matvec: Callable, rmatvec: Callable | None = None, matmat: Callable | None = None, *, local: bool = True):
        if len(shape) != 2:
            raise ValueError("shape must have two dimensions")
        self.shape, self.local = tuple(shape), local
        self._matvec, self._rmatvec, self._matmat = matvec, rmatvec, matmat

    def _checked(self, x: object, n: int, rank: int) -> object:
        shape = x.shape if isinstance(x, Dense) else np.shape(x)
        if len(shape) != rank or shape[0] != n:
            raise ValueError(f"expected rank {rank} with {n} rows, got shape {shape}")
        return x

    def matvec(self, x: object) -> object:
        return self._checked(self._matvec(self._checked(x, self.shape[1], 1)), self.shape[0], 1)

    def rmatvec(self, x: object) -> object:
        if self._rmatvec is None:
            raise NotImplementedError("the operator has no rmatvec")
        return self._checked(self._rmatvec(self._checked(x, self.shape[0], 1)), self.shape[1], 1)

    def matmat(self, x: object) -> object:
        if self._matmat is None:
            raise NotImplementedError("the operator has no matmat")
        return self._matmat(self._checked(x, self.shape[1], 2))

    def __matmul__(self, x: object) -> object:
        rank = len(x.shape if isinstance(x, Dense) else np.shape(x))
        return self.matvec(x) if rank == 1 else self.matmat(x)

    @property
    def H(self) -> LinearOperator:
        return LinearOperator(self.shape[::-1], self.rmatvec, self.matvec, local=self.local)

    @property
    def T(self) -> LinearOperator:
        if not self.local:
            return self.H  # vectors of frames are real
        return LinearOperator(self.shape[::-1], lambda x: np.conj(self.rmatvec(np.conj(x))), lambda x: np.conj(self.matvec(np.conj(x))), local=True)


def aslinearoperator(a: object) -> LinearOperator:
    if isinstance(a, LinearOperator):
        return a
    if isinstance(a, SparseMatrix):
        return LinearOperator(a.shape, a.matvec, a.rmatvec, a.matmul, local=False)
    if isinstance(a, tuple) and len(a) in (2, 3):
        return LinearOperator(a[0], a[1], matmat=a[2] if len(a) == 3 else None)
    if hasattr(a, "shape") and hasattr(a, "__matmul__"):
        m = np.asarray(a)
        return LinearOperator(m.shape, lambda x: m @ x, lambda x: m.conj().T @ x, lambda x: m @ x)
    raise TypeError(f"can't make an operator of {type(a).__name__}")
