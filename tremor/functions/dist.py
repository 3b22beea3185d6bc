"""p-values. The only Python column function here; it runs on result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def student_p(t: float, dof: float) -> float:
    """Two-sided Student t tail probability."""
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) if 0.0 < x < 1.0 else 0.0
    if x >= 1.0:
        return 1.0
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def two_sided_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Student t when dof is positive, else standard normal; null in, null out."""
    out = []
    for s, d in zip(stat.to_numpy(float), dof.to_numpy(float)):
        if not np.isfinite(s):
            out.append(None)
        elif np.isfinite(d) and d > 0:
            out.append(student_p(float(s), float(d)))
        else:
            out.append(math.erfc(abs(float(s)) / math.sqrt(2.0)))
    return pd.Series(out, dtype="float64")
