"""Solvers, factorisations and spectra."""

from ..operators.functional import dot, vdot
from . import preconditioners
from .blocks import BlockTriangular
from .direct import FactorizedSolve, SparseCholesky, SparseLU, TriangularAnalysis, analyze_triangular, cholesky, diagonal_positions, factorized, solve_many, sparse_cholesky, sparse_lu, splu, spsolve, spsolve_triangular, triangular_levels
from .info import SolverInfo
from .interface import LinearOperator, aslinearoperator
from .iterative import bicgstab, cg, gmres, minres
from .multifrontal import FrontalCholesky, FrontalLU
from .sampled import sampled_svds
from .spectral import arnoldi, eigs, eigsh, gram_operator, lanczos, normal_lanczos, svds
from .tsqr import TallQR, WideQR, least_squares

__all__ = [
    "BlockTriangular", "FrontalCholesky", "FrontalLU", "FactorizedSolve", "LinearOperator", "SolverInfo", "SparseCholesky", "SparseLU", "TallQR", "TriangularAnalysis", "WideQR", "analyze_triangular", "arnoldi", "aslinearoperator", "bicgstab", "cg", "cholesky", "diagonal_positions", "dot", "eigs", "eigsh",
    "factorized", "gmres", "gram_operator", "lanczos", "least_squares", "minres", "normal_lanczos", "preconditioners", "sampled_svds", "solve_many", "sparse_cholesky", "sparse_lu", "splu", "spsolve", "spsolve_triangular", "svds", "triangular_levels", "vdot",
]
