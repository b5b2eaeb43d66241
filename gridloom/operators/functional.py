"""The operators as functions, by layout: csr_matvec(A, x) is A.matvec(x) for a CSR matrix, and refuses others."""

from __future__ import annotations

from . import matrix as M

_METHODS = (
    "matvec", "batched_matvec", "matmul", "batched_matmul", "matmat", "matvec_transpose", "matmul_transpose", "diagonal",
    "row_sums", "col_sums", "column_sums", "row_norms", "col_norms", "column_norms", "trace", "todense", "sort_indices",
    "sum_duplicates", "canonicalize", "transpose", "tril", "triu",
)


def _function(layout: str, method: str):
    kind = M.LAYOUTS[layout]

    def run(a, *args, **kwargs):
        if not isinstance(a, kind):
            raise TypeError(f"{layout}_{method} takes a {kind.__name__}, got {type(a).__name__}")
        if method == "matmat" and not isinstance(args[0], kind):
            raise TypeError(f"{layout}_{method} takes a {kind.__name__}, got {type(args[0]).__name__}")
        return getattr(a, method)(*args, **kwargs)

    run.__name__ = run.__qualname__ = f"{layout}_{method}"
    run.__doc__ = getattr(kind, method).__doc__
    return run


for _layout in M.LAYOUTS:
    for _method in _METHODS:
        globals()[f"{_layout}_{_method}"] = _function(_layout, _method)

__all__ = [f"{layout}_{method}" for layout in M.LAYOUTS for method in _METHODS]


def tril(a, k=0, format=None):
    return a.tril(k).asformat(format or "coo")


def triu(a, k=0, format=None):
    return a.triu(k).asformat(format or "coo")


def todense(a):
    if not M.issparse(a):
        raise TypeError(f"todense takes a sparse matrix, got {type(a).__name__}")
    return a.todense()


def dot(a, b):
    return a.dot(b)


def vdot(a, b):
    return a.vdot(b)


def identity_like(x):
    return x


__all__ += ["tril", "triu", "todense", "dot", "vdot", "identity_like"]
