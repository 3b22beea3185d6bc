"""Scalar column functions. All are built-in expressions, so they stay in codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, digits: int = 6) -> Column:
    """Rounded for output; adding 0.0 turns a negative zero into a plain zero."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def finite(c) -> Column:
    """NaN and infinities become null, the only missing marker used here."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(num, den) -> Column:
    """Null instead of infinity when the denominator is zero."""
    return col(num) / F.nullif(col(den), F.lit(0.0))


def safe_ln(c) -> Column:
    return F.when(col(c) > 0, F.log(col(c)))


def log1p_clipped(c) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def logit(p) -> Column:
    p = col(p)
    return F.when((p > 0) & (p < 1), F.log(p / (1 - p)))


def log_ratio_pct(y) -> Column:
    """A log ratio as a percentage deviation."""
    return F.lit(100.0) * F.expm1(col(y))


def normalised_key(c) -> Column:
    """Lower case, letters and digits only; used to match headers and labels."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]", "")


def flag_interaction(flag, value) -> Column:
    """value where the flag is set, else 0; a missing value matters only inside the flag."""
    return F.when(col(flag) == 1, col(value)).otherwise(F.lit(0.0))


def all_present(*cols) -> Column:
    return reduce(lambda a, b: a & b, [col(c).isNotNull() for c in cols]).cast("double")


def safe_date(y, m, d) -> Column:
    """Date from parts with missing month and day taken as 1; null when not a date."""
    text = F.format_string(
        "%04d-%02d-%02d",
        col(y).cast("int"),
        F.coalesce(col(m).cast("int"), F.lit(1)),
        F.coalesce(col(d).cast("int"), F.lit(1)),
    )
    return F.when(col(y).isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def years_between(start, end) -> Column:
    return F.datediff(col(end), col(start)) / F.lit(365.25)


def clip(c, low=None, high=None) -> Column:
    """Null-safe clip: least/greatest skip nulls, so guard the value itself."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def wilson(k, n, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score bounds of k successes in n."""
    n = F.nullif(col(n).cast("double"), F.lit(0.0))
    p = col(k) / n
    z2 = z * z
    spread = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    scale = 1 + z2 / n
    mid = p + z2 / (2 * n)
    low = (mid - spread) / scale
    high = (mid + spread) / scale
    return (
        F.when(low.isNotNull(), F.greatest(low, F.lit(0.0))),
        F.when(high.isNotNull(), F.least(high, F.lit(1.0))),
    )


def hanley_mcneil(auc, n_pos, n_neg, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of an AUC from its Hanley-McNeil standard error."""
    a = col(auc)
    np_, nn = col(n_pos).cast("double"), col(n_neg).cast("double")
    both = a / (2 - a) - a * a, 2 * a * a / (1 + a) - a * a
    var = (a * (1 - a) + (np_ - 1) * both[0] + (nn - 1) * both[1]) / F.nullif(
        np_ * nn, F.lit(0.0)
    )
    half = z * F.sqrt(var)
    return (
        F.when(half.isNotNull(), F.greatest(a - half, F.lit(0.0))),
        F.when(half.isNotNull(), F.least(a + half, F.lit(1.0))),
    )


# Two-sided normal quantiles by level.
NORMAL_Z = {0.05: 1.959964, 0.01: 2.575829, 0.10: 1.644854}


def critical_r(n, alpha: float = 0.05) -> Column:
    """Smallest absolute correlation significant at ``alpha`` with n pairs (Fisher z)."""
    n = col(n)
    return F.when(n > 3, F.tanh(F.lit(NORMAL_Z[alpha]) / F.sqrt(n - 3)))


def skill(model_error, reference_error) -> Column:
    return F.lit(1.0) - ratio(model_error, reference_error)
