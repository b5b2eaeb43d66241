"""Reverse mode over whole expressions: a tape of products, sums, elementwise functions and constructors.

An operation on variables gives a variable that remembers its operands and how a cotangent of its result becomes theirs;
gradients() replays this backwards, each variable once, after all that depend on it. What comes to a variable from
several places is summed in one aggregate. A value or a cotangent that more than one plan reads is written once, so plans
stay as long as one operation whatever the expression; what leads to none of the wanted variables isn't computed.
Sparse variables have fixed places: their gradients are cells at just these, for sums of matrices too."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.lineage import cut, small
from . import assembly as A
from . import autodiff as D
from .dense import Dense
from .matrix import SparseMatrix

Value = Dense | SparseMatrix


def _written(x: Value) -> Value:
    """The value as a table."""
    if isinstance(x, Dense):
        return Dense(cut(x.df.select(*x.keys, "x")), x.shape, x.dtype, x.batched)
    return x if x._written else x.persist()


def _sum(parts: list[Value]) -> Value:
    if len(parts) == 1:
        return parts[0]
    one = parts[0]
    keys = one.keys if isinstance(one, Dense) else ["i", "j"]
    name = "x" if isinstance(one, Dense) else "v"
    df = reduce(DataFrame.union, (p.df.select(*keys, name) for p in parts)).groupBy(*keys).agg(V.total(one.dtype, F.col(name)).alias(name))
    return Dense(df, one.shape, one.dtype, one.batched) if isinstance(one, Dense) else one._like(df, canonical=True)


def _sampled(g: SparseMatrix, at: SparseMatrix) -> SparseMatrix:
    """g at the places of another matrix, zero where it has no cell."""
    met = at.df.select("i", "j").join(g.df.select("i", "j", "v"), ["i", "j"], "left")
    return at._like(met.select("i", "j", F.coalesce("v", V.lit(at.dtype, 0)).alias("v")))


class Var:
    """A value with its operands and their pulls: functions from its cotangent to theirs."""

    def __init__(self, value: Value, operands: Sequence[tuple[Var, Callable[[Value], Value]]] = ()):
        self._value, self.operands, self._kept = value, tuple(operands), False

    @property
    def value(self) -> Value:
        return self._value

    def kept(self) -> Value:
        """The value for one more plan: a result is written when this is first asked for."""
        if self.operands and not self._kept:
            self._value, self._kept = _written(self._value), True
        return self._value

    @property
    def sparse(self) -> bool:
        return isinstance(self._value, SparseMatrix)

    @property
    def shape(self) -> tuple[int, ...]:
        return self._value.shape

    # --- products
    def __matmul__(self, other: object) -> Var:
        if not self.sparse:
            raise TypeError("the left operand of a product is a sparse matrix")
        other = variable(other, like=self)
        if other.sparse:
            raise TypeError("the places of a sparse product depend on values; chain products with dense operands instead")
        a, x = self.kept(), other.kept()
        data = D.matvec_data_vjp if x.keys == ["i"] else D.batched_data_vjp if x.batched else D.matmul_data_vjp
        return Var(a @ x, [(self, lambda g: data(a, x, g)), (other, lambda g: D.rhs_vjp(a, g))])

    @property
    def T(self) -> Var:
        if not self.sparse:
            raise TypeError("only sparse matrices are transposed")
        return Var(self.value.T, [(self, lambda g: g.T.asformat(self.value.layout))])

    # --- sums and scaling
    def __add__(self, other: object) -> Var:
        other = variable(other, like=self)
        if self.sparse != other.sparse or self.shape != other.shape:
            raise ValueError(f"operands of a sum have one kind and shape, got {self.shape} and {other.shape}")
        if self.sparse:
            a, b = self.kept(), other.kept()
            # places where values cancel stay: what depends on values has no derivative
            both = a.df.select("i", "j", "v").union(b.df.select("i", "j", "v")).groupBy("i", "j").agg(V.total(a.dtype, F.col("v")).alias("v"))
            return Var(a._like(both, canonical=True), [(self, lambda g: _sampled(g, a)), (other, lambda g: _sampled(g, b))])
        return Var(_sum([self.value, other.value]), [(self, lambda g: g), (other, lambda g: g)])

    def __sub__(self, other: object) -> Var:
        return self + -1.0 * variable(other, like=self)

    def __rmul__(self, c: float) -> Var:
        c = float(c)
        return Var(_scaled(self.value, c), [(self, lambda g: _scaled(g, c))])

    def __neg__(self) -> Var:
        return -1.0 * self

    def __mul__(self, other: object) -> Var:
        """By a number, or element by element for dense values."""
        if not isinstance(other, Var | Dense):
            return float(other) * self
        other = variable(other, like=self)
        if self.sparse or other.sparse or self.shape != other.shape:
            raise ValueError("element by element, both are dense and of one shape")
        a, b = self.kept(), other.kept()
        return Var(_times(a, b), [(self, lambda g: _times(g, b)), (other, lambda g: _times(g, a))])

    def map(self, f: Callable[[Column], Column], derivative: Callable[[Column], Column]) -> Var:
        """A function of each value, as column expressions of it and of its derivative; of stored cells, for a sparse matrix."""
        name = "v" if self.sparse else "x"
        at = self.kept()
        slope = at._like(at.df.withColumn("v", derivative(F.col("v")))) if self.sparse else Dense(at.df.withColumn("x", derivative(F.col("x"))), at.shape, at.dtype, at.batched)
        out = at.df.withColumn(name, f(F.col(name)))
        return Var(at._like(out) if self.sparse else Dense(out, at.shape, at.dtype, at.batched), [(self, lambda g: _times_cells(g, slope) if self.sparse else _times(g, slope))])

    def square(self) -> Var:
        return self.map(lambda x: x * x, lambda x: 2 * x)

    # --- reductions of sparse matrices
    def row_sums(self) -> Var:
        a = self.kept()
        return Var(a.row_sums(), [(self, lambda g: D.row_sums_vjp(a, g))])

    def col_sums(self) -> Var:
        a = self.kept()
        return Var(a.col_sums(), [(self, lambda g: D.col_sums_vjp(a, g))])

    def diagonal(self) -> Var:
        a = self.kept()
        return Var(a.diagonal(), [(self, lambda g: D.diagonal_vjp(a, g))])


def variable(x: object, like: Var | None = None) -> Var:
    """A leaf: a sparse matrix (its duplicates summed), a Dense, or an array."""
    if isinstance(x, Var):
        return x
    if getattr(x, "dtype", None) == V.COMPLEX:
        raise TypeError("gradients are of real values")
    if isinstance(x, SparseMatrix):
        return Var(x.canonicalize())
    if not isinstance(x, Dense):
        from .dense import dense

        if like is None:
            raise TypeError("an array becomes a variable as an operand of one, or as a Dense")
        x = dense(like.value.df.sparkSession, x)
    return Var(x)


def _scaled(x: Value, c: float) -> Value:
    return c * x if isinstance(x, SparseMatrix) else Dense(x.df.withColumn("x", V.mul(x.dtype, F.col("x"), V.lit(x.dtype, c))), x.shape, x.dtype, x.batched)


def _times(a: Dense, b: Dense) -> Dense:
    n = 1
    for s in b.shape:
        n *= s
    side = small(b.df.select(*b.keys, F.col("x").alias("y")), n)
    return Dense(a.df.join(side, a.keys).select(*a.keys, V.mul(a.dtype, F.col("x"), F.col("y")).alias("x")), a.shape, a.dtype, a.batched)


def _times_cells(a: SparseMatrix, b: SparseMatrix) -> SparseMatrix:
    met = a.df.select("i", "j", "v").join(b.df.select("i", "j", F.col("v").alias("w")), ["i", "j"])
    return b._like(met.select("i", "j", V.mul(a.dtype, F.col("v"), F.col("w")).alias("v")))


# --- constructors
def _assembled(make: Callable, pull: Callable, parts: Sequence[Var]) -> Var:
    values = [p.kept() for p in parts]
    return Var(make(values).canonicalize(), [(p, lambda g, k=k: pull(values, g)[k]) for k, p in enumerate(parts)])


def vstack(parts: Sequence[Var]) -> Var:
    return _assembled(A.vstack, D.vstack_vjp, parts)


def hstack(parts: Sequence[Var]) -> Var:
    return _assembled(A.hstack, D.hstack_vjp, parts)


def block_diag(parts: Sequence[Var]) -> Var:
    return _assembled(A.block_diag, D.block_diag_vjp, parts)


# --- backwards
def gradients(out: Var, wrt: Sequence[Var], seed: Value | None = None) -> list[Value | None]:
    """The gradient of the sum of out's values (or of their products with seed) for each of wrt; None where out doesn't depend on it."""
    order: list[Var] = []
    needed: dict[int, bool] = {}
    wanted = {id(w) for w in wrt}
    # operands before what is made of them; a stack instead of recursion, as expressions may be deep
    stack: list[tuple[Var, bool]] = [(out, False)]
    while stack:
        v, done = stack.pop()
        if done:
            needed[id(v)] = id(v) in wanted or any(needed[id(o)] for o, _ in v.operands)
            order.append(v)
        elif id(v) not in needed:
            needed[id(v)] = False
            stack.append((v, True))
            stack += [(o, False) for o, _ in v.operands if id(o) not in needed]
    if seed is None:
        value = out.value
        one = V.lit(value.dtype, 1)
        seed = value._like(value.df.withColumn("v", one)) if out.sparse else Dense(value.df.withColumn("x", one), value.shape, value.dtype, value.batched)
    parts: dict[int, list[Value]] = {id(out): [seed]}
    found: dict[int, Value] = {}
    for v in reversed(order):
        if not needed[id(v)] or id(v) not in parts:
            continue
        pulls = [(o, pull) for o, pull in v.operands if needed[id(o)]]
        own = parts.pop(id(v))
        cotangent = _sum(own)
        if len(own) > 1 or len(pulls) > 1 or v.operands and any(len(o.operands) for o, _ in pulls):
            cotangent = _written(cotangent)
        if id(v) in wanted:
            found[id(v)] = cotangent
        for o, pull in pulls:
            parts.setdefault(id(o), []).append(pull(cotangent))
    return [found.get(id(w)) for w in wrt]
