"""gridloom: sparse matrices as relations on Spark."""

from . import linalg
from .config import ConfigManager, capabilities, config, config_context, get_config, has_capability, is_available, runtime, set_config, use_cpu, use_device, use_gpu
from .operators import functional as _functional
from .operators.assembly import add, block_array, block_diag, bmat, hstack, kron, kronsum, permute, subtract, vstack
from .operators.dense import Dense, dense, vector
from .operators.functional import *  # noqa: F403
from .operators.matrix import COOArray, CSCArray, CSRArray, SparseMatrix, issparse
from .plans.expression import Lazy, lazy
from .sources.construct import asarray, coo_array, csc_array, csr_array, diags, eye, from_dense, from_numpy, from_scipy, fromdense, identity
from .sources.matrix_market import read_matrix_market, read_parquet, write_parquet
from .sources.random import rand, random, random_array

__all__ = [
    "COOArray", "CSCArray", "CSRArray", "ConfigManager", "Dense", "Lazy", "SparseMatrix", "add", "asarray", "block_array", "block_diag", "bmat", "capabilities", "config", "config_context",
    "coo_array", "csc_array", "csr_array", "dense", "diags", "eye", "from_dense", "from_numpy", "from_scipy", "fromdense", "get_config", "has_capability", "hstack", "identity",
    "is_available", "issparse", "kron", "kronsum", "lazy", "linalg", "permute", "rand", "random", "random_array", "read_matrix_market", "read_parquet", "runtime", "set_config",
    "subtract", "use_cpu", "use_device", "use_gpu", "vector", "vstack", "write_parquet", *_functional.__all__,
]
