"""Scalar and vector functions as built-in expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Saturation of the sigmoid, its grid, tolerances.
SIGMOID_LIMIT = 11.0
GRID = 1000
NEAR_FLOAT, NEAR_DOUBLE = 1e-4, 1e-8


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uniform(*key) -> Column:
    """A draw from [0, 1) that depends on the key alone, so it survives any repartitioning and SQL can repeat it."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(k) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sigmoid(x) -> Column:
    x = c(x).cast("double")
    return F.when(x > SIGMOID_LIMIT, F.lit(1.0)).when(x < -SIGMOID_LIMIT, F.lit(0.0)).otherwise(1 / (1 + F.exp(-x)))


def fast_sigmoid(x, grid: int = GRID) -> Column:
    """The sigmoid at the grid point at or toward zero of ``x``; 0 and 1 outside the grid."""
    i = ((grid - 1) * ((c(x).cast("double") / SIGMOID_LIMIT) + 1) / 2).cast("long")
    return F.when(i < 0, F.lit(0.0)).when(i >= grid, F.lit(1.0)).otherwise(1 / (1 + F.exp(-(SIGMOID_LIMIT * (i / (grid - 1) - 0.5) * 2))))


def _grid_values(grid: int) -> np.ndarray:
    """0 for below the grid, its values, 1 for above."""
    return np.concatenate([[0.0], 1 / (1 + np.exp(-SIGMOID_LIMIT * (np.arange(grid) / (grid - 1) - 0.5) * 2)), [1.0]])


_GRIDS = {GRID: _grid_values(GRID)}


def fast_sigmoid_array(x: np.ndarray, grid: int = GRID) -> np.ndarray:
    if grid not in _GRIDS:
        _GRIDS[grid] = _grid_values(grid)
    i = ((grid - 1) / 2 * (x / SIGMOID_LIMIT + 1)).clip(-1, grid).astype(np.int64)  # toward zero
    return _GRIDS[grid][i + 1]


def strided(v, step: int) -> Column:
    """Every ``step``-th element."""
    return c(v) if step == 1 else F.filter(c(v), lambda _, i: i % step == 0)


def _double(v) -> Column:
    return F.transform(c(v), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def axpy(alpha: float, x, y, step: int = 1) -> Column:
    """``y + alpha x``; with ``step``, only every ``step``-th slot of both changes."""
    if step == 1:
        return F.zip_with(_double(y), _double(x), lambda b, a: b + alpha * a)
    at = F.sequence(F.lit(0), F.size(c(y)) - 1)
    return F.zip_with(at, F.zip_with(_double(y), _double(x), lambda b, a: F.struct(b.alias("b"), a.alias("a"))), lambda i, p: F.when(i % step == 0, p["b"] + alpha * p["a"]).otherwise(p["b"]))


def scal(alpha: float, v, step: int = 1) -> Column:
    return F.transform(_double(v), lambda x, i: F.when(i % step == 0, x * alpha).otherwise(x))


def cosine(a, b) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(v) -> Column:
    n = norm(v)
    return F.transform(_double(v), lambda x: F.try_divide(x, n))


def near(a, b, eps: float = NEAR_FLOAT) -> Column:
    return F.abs(c(a).cast("double") - c(b).cast("double")) < eps


def near_vectors(a, b, eps: float = NEAR_FLOAT) -> Column:
    """Same size, and near in every slot."""
    return (F.size(c(a)) == F.size(c(b))) & F.forall(F.zip_with(_double(a), _double(b), lambda x, y: F.coalesce(F.abs(x - y) < eps, F.lit(False))), lambda x: x)


def learning_rate(t, tau: float, kappa: float, floor: float) -> Column:
    """A word's rate after ``t`` steps."""
    if tau <= 0:
        raise ValueError("tau must be positive")
    return F.greatest(F.lit(float(floor)), F.lit(float(kappa)) * (1 - c(t) / float(tau)))


def gradient_coefficient(w, ctx, negative: bool = False) -> Column:
    return F.lit(0.0 if negative else 1.0) - fast_sigmoid(dot(w, ctx))
