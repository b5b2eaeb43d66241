"""Gradients of composed expressions against numpy, by differences along random directions and in closed form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import tape
from gridloom.operators.dense import dense
from gridloom.sources.construct import from_dense


def sparse_array(rng, m, n):
    return np.where(rng.random((m, n)) < 0.5, rng.standard_normal((m, n)), 0.0)


def test_norm_of_a_chain(spark):
    """|A (B x)|^2: by A, B and x."""
    rng = np.random.default_rng(1)
    a, b, x = sparse_array(rng, 5, 7), sparse_array(rng, 7, 6), rng.standard_normal(6)
    va, vb, vx = (tape.variable(v) for v in (from_dense(spark, a), from_dense(spark, b), dense(spark, x)))
    out = (va @ (vb @ vx)).square()
    ga, gb, gx = tape.gradients(out, [va, vb, vx])
    z = 2 * a @ b @ x
    assert np.allclose(gx.collect(), b.T @ a.T @ z)
    assert np.allclose(ga.todense().collect(), np.outer(z, b @ x) * (a != 0)) and np.allclose(gb.todense().collect(), np.outer(a.T @ z, x) * (b != 0))
    assert ga.nnz == np.count_nonzero(a)


def test_one_matrix_in_many_places(spark):
    """A variable that is used transposed, scaled, and in a sum with another; a direction of it at a time."""
    rng = np.random.default_rng(2)
    a, c, x = sparse_array(rng, 6, 6), sparse_array(rng, 6, 6), rng.standard_normal((6, 3))
    a[0, 0], c[0, 0] = 2.0, -1.0  # 2 A.T + C cancels... at (0, 0) of A.T + 2 C
    step = sparse_array(rng, 6, 6) * (a != 0)

    def f(m, lib):
        y = (m.T + 2.0 * lib["c"]) @ (m @ lib["x"])
        return (lib["tanh"](y) * lib["x"]) - 0.5 * y

    def plain(m):
        return f(m, {"c": c, "x": x, "tanh": np.tanh}).sum()

    va, vc, vx = tape.variable(from_dense(spark, a)), tape.variable(from_dense(spark, c)), tape.variable(dense(spark, x))
    out = f(va, {"c": vc, "x": vx, "tanh": lambda y: y.map(F.tanh, lambda v: 1 - F.tanh(v) * F.tanh(v))})
    assert np.isclose(out.value.collect().sum(), plain(a))
    ga, gc = tape.gradients(out, [va, vc])
    t = 1e-6
    assert np.isclose((ga.todense().collect() * step).sum(), (plain(a + t * step) - plain(a - t * step)) / (2 * t), rtol=1e-5)
    assert ga.nnz == np.count_nonzero(a) and gc.nnz == np.count_nonzero(c)


def test_constructors_reductions_and_seeds(spark):
    rng = np.random.default_rng(3)
    a, b, x, s = sparse_array(rng, 4, 5), sparse_array(rng, 3, 5), rng.standard_normal(5), rng.standard_normal(7)
    va, vb, vx = tape.variable(from_dense(spark, a)), tape.variable(from_dense(spark, b)), tape.variable(dense(spark, x))
    ga, gb, gx = tape.gradients(tape.vstack([va, vb]) @ vx, [va, vb, vx], seed=dense(spark, s))
    assert np.allclose(ga.todense().collect(), np.outer(s[:4], x) * (a != 0)) and np.allclose(gb.todense().collect(), np.outer(s[4:], x) * (b != 0)) and np.allclose(gx.collect(), np.vstack([a, b]).T @ s)
    (g,) = tape.gradients(va.square().row_sums(), [va])
    assert np.allclose(g.todense().collect(), 2 * a)
    (g,) = tape.gradients(va.col_sums() * vx, [va])
    assert np.allclose(g.todense().collect(), np.tile(x, (4, 1)) * (a != 0))
    (g,) = tape.gradients(tape.hstack([va, -va]) @ np.arange(10.0), [va])
    assert np.allclose(g.todense().collect(), -5 * (a != 0))
    (g,) = tape.gradients(tape.block_diag([va, va]).diagonal(), [va])
    assert (g.todense().collect() == (a != 0) * (np.eye(4, 5) + np.eye(4, 5, -1))).all()  # the second block lies a column off


def test_batches(spark):
    rng = np.random.default_rng(4)
    a, x = sparse_array(rng, 4, 5), rng.standard_normal((2, 5, 3))
    va, vx = tape.variable(from_dense(spark, a)), tape.variable(dense(spark, x))
    ga, gx = tape.gradients((va @ vx).square(), [va, vx])
    y = 2 * a @ x
    assert np.allclose(gx.collect(), a.T @ y) and np.allclose(ga.todense().collect(), np.einsum("bik,bjk->ij", y, x) * (a != 0))


def test_deep_tape_and_what_is_not_needed(spark):
    a = np.diag(np.arange(1.0, 4.0)) / 3
    va, other = tape.variable(from_dense(spark, a)), tape.variable(from_dense(spark, a))
    x = tape.variable(dense(spark, np.ones(3)))
    y = x
    for _ in range(6):
        y = va @ y
    g, none = tape.gradients(y, [x, other])
    assert np.allclose(g.collect(), np.diag(a) ** 6) and none is None
    (itself,) = tape.gradients(x, [x])
    assert (itself.collect() == 1).all()


def test_refusals(spark):
    m, x = tape.variable(from_dense(spark, np.eye(3))), tape.variable(dense(spark, np.ones(3)))
    for wrong in (lambda: m @ m, lambda: x @ x, lambda: x.T):
        with pytest.raises(TypeError):
            wrong()
    for wrong in (lambda: m + x, lambda: m * x, lambda: x * dense(spark, np.ones(4))):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(TypeError):
        tape.variable(np.ones(3))
    with pytest.raises(TypeError):
        tape.variable(dense(spark, np.ones(3) * 1j))
