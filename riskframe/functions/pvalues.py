"""p-values as Arrow-batched pandas UDFs.

They run on one row per tested feature (tiny inputs), after Spark has done
all the data work. Each reference density is written, by a change of
variable, as exp(g) with a concave g whose maximum 0 lies at 0; a p-value is
then the ratio of two integrals of exp(g). No normalising constant is
needed, so large degrees of freedom lose no digits: the t law tends to the
normal one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

PANELS, NODES = 48, 24
DROP = 60.0  # exp(-60) of the largest value is left out at either end


def _reach(g: Callable, start: float, sign: int) -> float:
    """A distance from ``start`` at which g has fallen by at least DROP, found by doubling."""
    low = float(g(np.array(start))) - DROP
    step = 1e-9
    while float(g(np.array(start + sign * step))) > low:
        step *= 2.0
    return start + sign * step


def _integral(g: Callable, a: float, b: float, offset: float) -> float:
    x, w = np.polynomial.legendre.leggauss(NODES)
    edges = np.linspace(a, b, PANELS + 1)
    half = np.diff(edges)[:, None] / 2.0
    at = (edges[:-1, None] + half) + half * x
    return float((np.exp(g(at) - offset) * half * w).sum())


def _upper_share(g: Callable, at: float, symmetric: bool = False) -> float:
    """The share of exp(g) above ``at``; of a symmetric one, of its upper half."""
    with np.errstate(over="ignore"):
        low = 0.0 if symmetric else _reach(g, 0.0, -1)
        total = _integral(g, low, 0.0, 0.0) + _integral(g, 0.0, _reach(g, 0.0, 1), 0.0)
        if at <= 0.0:
            return 1.0 - _integral(g, low, max(at, low), 0.0) / total if at > low else 1.0
        top = float(g(np.array(at)))
        return math.exp(top) * _integral(g, at, _reach(g, at, 1), top) / total


def _missing(*values) -> bool:
    return any(v is None or math.isnan(v) for v in values)


def norm_two_sided(z: float) -> float:
    """P(|Z| >= z) for a z already made non-negative by the caller."""
    return math.nan if _missing(z) else min(1.0, math.erfc(z / math.sqrt(2.0)))


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= t): with t = sqrt(dof) sinh(w) the density is cosh(w) ** -dof."""
    if _missing(t, dof) or dof <= 0:
        return math.nan
    return _upper_share(lambda w: -0.5 * dof * np.log1p(np.sinh(w) ** 2), math.asinh(abs(t) / math.sqrt(dof)), symmetric=True)


def chi2_sf(x: float, dof: float) -> float:
    """P(X >= x): in v = log(x / dof) the log density is dof / 2 (v - expm1(v))."""
    if _missing(x, dof) or dof <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    return _upper_share(lambda v: 0.5 * dof * (v - np.expm1(v)), math.log(x / dof))


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(X >= f): in y = log(f) the log density is d1/2 y - (d1+d2)/2 log1p(d1 expm1(y) / (d1+d2))."""
    if _missing(f, d1, d2) or d1 <= 0 or d2 <= 0:
        return math.nan
    if f <= 0:
        return 1.0
    n = d1 + d2
    return _upper_share(lambda y: 0.5 * d1 * y - 0.5 * n * np.log1p(d1 * np.expm1(y) / n), math.log(f))


@F.pandas_udf(DoubleType())
def _norm_p_udf(z: pd.Series) -> pd.Series:
    return pd.Series([norm_two_sided(v) for v in z], dtype="float64")


@F.pandas_udf(DoubleType())
def _t_p_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def _chi2_p_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) for a, b in zip(x, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def _f_p_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_sf(a, b, c) for a, b, c in zip(f, d1, d2)], dtype="float64")


def _double(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("double")


def normal_p(z) -> Column:
    """Two-sided normal p-value of a non-negative z column."""
    return _norm_p_udf(_double(z))


def t_p(t, dof) -> Column:
    return _t_p_udf(_double(t), _double(dof))


def chi2_p(x, dof) -> Column:
    return _chi2_p_udf(_double(x), _double(dof))


def f_p(f, d1, d2) -> Column:
    return _f_p_udf(_double(f), _double(d1), _double(d2))
