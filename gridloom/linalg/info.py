"""What a solver reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

CONVERGED, BREAKDOWN, NOT_POSITIVE, NOT_FINITE = 0, -1, -2, -3
_TEXT = {CONVERGED: "the residual meets the tolerance", BREAKDOWN: "a divisor vanished", NOT_POSITIVE: "operator or preconditioner is not positive definite", NOT_FINITE: "a value is not finite"}


@dataclass(frozen=True)
class SolverInfo:
    """status: 0 converged, above 0 the iterations at the limit, below 0 a failure."""

    status: int
    residual_norm: float
    iterations: int
    rtol: float = 0.0
    atol: float = 0.0

    @property
    def converged(self) -> bool:
        return self.status == CONVERGED

    @property
    def info(self) -> int:
        return self.status

    @property
    def reason(self) -> str:
        return _TEXT.get(self.status, "the iteration limit was reached")

    def __int__(self) -> int:
        return self.status


def finish(x: object, info: SolverInfo, callback: Callable | None, return_info: bool, callback_type: str = "x") -> tuple[object, object]:
    """Calls the callback once, after the solve."""
    if callback is not None:
        callback(x if callback_type == "x" else info.residual_norm)
    return x, info if return_info else int(info)
