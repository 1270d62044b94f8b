"""Statistics that Spark has no function for, vectorised."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation r of n pairs under no correlation; 1 under three pairs without one."""
    if n < 2 or r is None or math.isnan(r):
        return 1.0
    if n == 2:
        return 1.0 if r == 0 else 0.0
    df = n - 2
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def p_value_udf():
    @F.pandas_udf("double")
    def f(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_value(float(a) if a == a else np.nan, int(b)) for a, b in zip(r, n, strict=True)])

    return f
