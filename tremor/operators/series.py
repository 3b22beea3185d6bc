"""Window features over each series. Frames end at the session before the row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.scalars import ratio, safe_ln

def w_series():
    """Window over one series in date order; built on use, as it needs a session."""
    return W.partitionBy("series_id").orderBy("date")



def _prior(w: int):
    return w_series().rowsBetween(-w, -1)


def log_return(price: str = "close") -> Column:
    return F.log(F.col(price) / F.lag(price).over(w_series()))


def full_mean(c: str, w: int) -> Column:
    """Mean of the w rows before this one; null unless all w are present."""
    return F.when(F.count(c).over(_prior(w)) == w, F.avg(c).over(_prior(w)))


def full_std(c: str, w: int) -> Column:
    return F.when(F.count(c).over(_prior(w)) == w, F.stddev_samp(c).over(_prior(w)))


def ema_depth(span: int) -> int:
    """Rows beyond which a weight is below 1e-17, so cutting there keeps double precision."""
    return math.ceil(math.log(1e-17) / math.log(1.0 - 2.0 / (span + 1.0)))


def ema(history: str, span: int) -> Column:
    """Exponential mean of an array of prior values (oldest first), seeded by the oldest used."""
    a = 2.0 / (span + 1.0)
    depth = ema_depth(span)
    size = F.size(history)
    used = F.slice(history, F.greatest(size - depth + 1, F.lit(1)), F.lit(depth))
    value = F.aggregate(F.slice(used, 2, depth), F.element_at(used, 1), lambda acc, x: acc * (1.0 - a) + x * a)
    return F.when(size >= span, value)


def market_features(sessions: DataFrame) -> DataFrame:
    """Return lags, moving means, volatility and the volume block, per session."""
    deepest = max(ema_depth(w) for w in (5, 10, 20))
    df = sessions.withColumn("log_return", log_return()).withColumn("_hist", F.collect_list("close").over(_prior(deepest)))
    lags = [F.lag("log_return", k).over(w_series()).alias(f"lag_return_{k}") for k in (1, 2, 3, 5)]
    df = df.select(
        "*",
        *lags,
        F.lag("close").over(w_series()).alias("_p"),
        F.lag("volume").over(w_series()).alias("_v"),
        F.lag("volume", 2).over(w_series()).alias("_v2"),
        *[full_mean("close", w).alias(f"sma_{w}") for w in (5, 10, 20)],
        *[ema("_hist", w).alias(f"ema_{w}") for w in (5, 10, 20)],
        *[full_std("log_return", w).alias(f"rolling_std_{w}") for w in (5, 10, 20, 30)],
        (F.col("log_return") * F.col("log_return")).alias("squared_return"),
        *[full_mean("volume", w).alias(f"_vm{w}") for w in (5, 10, 30)],
        full_std("volume", 30).alias("_vs30"),
    )
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        *[(F.col("_p") / F.col(f"sma_{w}") - 1).alias(f"price_to_sma_{w}") for w in (5, 10, 20)],
        *[(F.col("_p") / F.col(f"ema_{w}") - 1).alias(f"price_to_ema_{w}") for w in (5, 10, 20)],
        (ratio("_v", "_vm30") - 1).alias("vol_ratio_1_30"),
        (ratio("_vm5", "_vm30") - 1).alias("vol_ratio_5_30"),
        (ratio("_vm10", "_vm30") - 1).alias("vol_ratio_10_30"),
        ratio("_vs30", "_vm30").alias("vol_cv_30"),
        safe_ln(ratio("_v", "_v2")).alias("log_vol_change_1"),
    )


def forward_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    w = w_series().rowsBetween(W.unboundedPreceding, 0)
    return df.select(
        *[c for c in df.columns if c not in cols],
        *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols],
    )


def realised_volatility(c: str = "log_return", w: int = 20, least: int = 5) -> Column:
    """Sample deviation of up to w prior rows; needs ``least`` rows, none of them null."""
    f = _prior(w)
    n = F.count(F.lit(1)).over(f)
    return F.when((n >= least) & (F.count(c).over(f) == n), F.stddev_samp(c).over(f))


def regime_features(sessions: DataFrame) -> DataFrame:
    """Momentum, 20-session drawdown and volume ratio at the close before each session."""
    last = F.lag("close").over(w_series())
    closes = F.collect_list("close").over(_prior(20))
    # running peak and worst drop from it, in one pass over at most 20 values
    worst = F.aggregate(
        closes,
        F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("drop")),
        lambda s, x: F.struct(
            F.greatest(s["peak"], x).alias("peak"),
            F.least(s["drop"], x / F.greatest(s["peak"], x) - 1.0).alias("drop"),
        ),
        lambda s: s["drop"],
    )
    return sessions.select(
        "series_id",
        "date",
        "session_idx",
        *[
            (last / F.lag("close", k + 1).over(w_series()) - 1).alias(f"momentum_{k}")
            for k in (5, 10, 20)
        ],
        F.when(F.count("close").over(_prior(20)) == 20, worst).alias("max_drawdown_20"),
        (ratio(full_mean("volume", 5), full_mean("volume", 20))).alias("vol_ratio_5_20"),
    )


def market_model(df: DataFrame, y: str, x: str, window: int = 250, least: int = 60) -> DataFrame:
    """Single-factor fit on the ``window`` sessions before each session.

    The frame is counted in rows; rows with a missing side are then skipped. Window
    moments are differences of running sums of values centred on the series mean, so
    the cost per row does not depend on the window. Adds fit_alpha, fit_beta,
    fit_sigma (ddof 2), fit_n, factor_mean, factor_ss.
    """
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    whole = W.partitionBy("series_id")
    df = df.withColumn("_my", F.avg(F.when(both, F.col(y))).over(whole)).withColumn("_mx", F.avg(F.when(both, F.col(x))).over(whole))
    cy, cx = F.when(both, F.col(y) - F.col("_my")), F.when(both, F.col(x) - F.col("_mx"))
    upto = w_series().rowsBetween(W.unboundedPreceding, -1)
    parts = {"n": F.when(both, F.lit(1.0)), "y": cy, "x": cx, "yy": cy * cy, "xx": cx * cx, "xy": cx * cy}
    df = df.select("*", *[F.coalesce(F.sum(e).over(upto), F.lit(0.0)).alias(f"_r{k}") for k, e in parts.items()])
    df = df.select("*", *[(F.col(f"_r{k}") - F.coalesce(F.lag(f"_r{k}", window).over(w_series()), F.lit(0.0))).alias(f"_w{k}") for k in parts])
    n = F.nullif(F.col("_wn"), F.lit(0.0))
    mx, my = F.col("_wx") / n, F.col("_wy") / n
    sxx, sxy, syy = F.col("_wxx") - n * mx * mx, F.col("_wxy") - n * mx * my, F.col("_wyy") - n * my * my
    ok = (n >= least) & (sxx > 1e-12 * F.col("_wxx"))  # any spread beyond rounding, in whatever units
    beta = sxy / F.when(ok, sxx)
    sse = F.greatest(syy - beta * sxy, F.lit(0.0))
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        F.when(ok, my + F.col("_my") - beta * (mx + F.col("_mx"))).alias("fit_alpha"),
        F.when(ok, beta).alias("fit_beta"),
        F.when(ok, F.sqrt(sse / F.greatest(n - 2, F.lit(1.0)))).alias("fit_sigma"),
        F.when(ok, n).cast("long").alias("fit_n"),
        F.when(ok, mx + F.col("_mx")).alias("factor_mean"),
        F.when(ok, sxx).alias("factor_ss"),
    )


def mean_model(df: DataFrame, y: str, window: int = 250, least: int = 60) -> DataFrame:
    """Mean-adjusted fit: alpha is the prior mean, beta 0, sigma with ddof 1."""
    f = _prior(window)
    n = F.count(y).over(f)
    df = df.select("*", n.alias("_n"), F.avg(y).over(f).alias("_m"), F.stddev_samp(y).over(f).alias("_s"))
    ok = F.col("_n") >= least
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        F.when(ok, F.col("_m")).alias("fit_alpha"),
        F.when(ok, F.lit(0.0)).alias("fit_beta"),
        F.when(ok, F.col("_s")).alias("fit_sigma"),
        F.when(ok, F.col("_n")).cast("long").alias("fit_n"),
        F.when(ok, F.lit(0.0)).alias("factor_mean"),
        F.when(ok, F.lit(0.0)).alias("factor_ss"),
    )


def zero_model(df: DataFrame, y: str, window: int = 250, least: int = 60) -> DataFrame:
    """Zero expected value: alpha and beta 0, sigma the root mean square before (ddof 1)."""
    f = _prior(window)
    n = F.count(y).over(f)
    df = df.select("*", n.alias("_n"), F.sum(F.col(y) * F.col(y)).over(f).alias("_ss"))
    ok = F.col("_n") >= least
    zero = F.when(ok, F.lit(0.0))
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        zero.alias("fit_alpha"),
        zero.alias("fit_beta"),
        F.when(ok, F.sqrt(F.col("_ss") / F.greatest(F.col("_n") - 1, F.lit(1)))).alias("fit_sigma"),
        F.when(ok, F.col("_n")).cast("long").alias("fit_n"),
        zero.alias("factor_mean"),
        zero.alias("factor_ss"),
    )
