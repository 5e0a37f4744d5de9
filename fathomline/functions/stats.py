"""Statistics of aggregated rows, as column expressions where a closed form exists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Normal quantiles of one-sided and two-sided 95 % bounds.
Z_ONE, Z_TWO = 1.6448536269514722, 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or nothing."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, F.lit(0.0)).otherwise(a / b)


def wilson(successes: Column, total: Column, z: float = Z_ONE) -> tuple[Column, Column]:
    """Wilson's interval, [0, 1] where there is nothing."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (middle - spread) / (1 + z * z / n), (middle + spread) / (1 + z * z / n)
    return F.coalesce(F.greatest(low, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(high, F.lit(1.0)), F.lit(1.0))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after the recurrence has lifted small arguments to ten or more."""
    lift, x = np.zeros_like(x), x.copy()
    while (small := x < 10).any():
        lift[small] += np.log(x[small])
        x[small] += 1
    square = 1 / (x * x)
    series = (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - lift


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, evaluated by Lentz's method for all at once."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 2000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / away(1 + top * d), away(1 + top / c)
            out *= c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    return out


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, P(Beta(a, b) <= x), for 0 < x < 1."""
    front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    left = x < (a + 1) / (a + b + 2)
    p, q, y = np.where(left, a, b), np.where(left, b, a), np.where(left, x, 1 - x)
    part = front * _beta_fraction(p, q, y) / p
    return np.where(left, part, 1 - part)


def exact_lower_bounds(successes, total, level: float = 0.05) -> np.ndarray:
    """Clopper and Pearson's one-sided lower bounds: the p at which `successes` or more have that chance, which
    is P(Beta(k, n - k + 1) <= p), found by halving for all rows together."""
    k, n = np.asarray(successes, float), np.asarray(total, float)
    out = np.where(k == n, level ** (1 / np.maximum(n, 1)), 0.0)
    out[(k == 0) | (n == 0)] = 0.0
    at = np.flatnonzero((k > 0) & (k < n))
    low, high = np.zeros(len(at)), k[at] / n[at]
    for _ in range(80 if len(at) else 0):
        middle = (low + high) / 2
        short = incomplete_beta(k[at], n[at] - k[at] + 1, middle) < level
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    out[at] = (low + high) / 2
    return out


def exact_lower_bound(successes: int, total: int, level: float = 0.05) -> float:
    return float(exact_lower_bounds([successes], [total], level)[0])


@F.pandas_udf(T.DoubleType())
def clopper_pearson_lower(successes: pd.Series, total: pd.Series) -> pd.Series:
    """For aggregated rows, of which there are few."""
    return pd.Series(exact_lower_bounds(successes, total))
