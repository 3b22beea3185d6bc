"""Event-study inference on weighted origins.

Every statistic of an event depends only on its origin session, so events are first
counted per (series, origin). Panels, ranks and tests run on those bounded rows with
the count as a weight; results equal the per-event computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.dist import two_sided_p

# Event window, estimation window, smallest usable window.
EVENT_WINDOW = (-5, 20)
ESTIMATION = 250
MIN_ESTIMATION = 60
MIN_OVERLAP = 10

KEY = ["series_id", "origin"]


def weighted_origins(days: DataFrame) -> DataFrame:
    """(series_id, origin, weight) from aligned event days."""
    return (
        days.where(F.col("session_idx") > 1)
        .groupBy("series_id", F.col("session_idx").alias("origin"))
        .agg(F.sum("n_events").alias("weight"))
    )


def abnormal_panel(fitted: DataFrame, origins: DataFrame, value: str = "log_return", factor: str = "factor_ret",
                   window=EVENT_WINDOW) -> DataFrame:
    """(series_id, origin, weight, k, ar, factor_dev, fit columns) for usable origins."""
    fits = fitted.where(F.col("fit_alpha").isNotNull()).select(
        "series_id", F.col("session_idx").alias("origin"),
        "fit_alpha", "fit_beta", "fit_sigma", "fit_n", "factor_mean", "factor_ss",
    )
    spans = origins.join(fits, KEY).withColumn("k", F.explode(F.sequence(F.lit(window[0]), F.lit(window[1]))))
    rows = fitted.select("series_id", F.col("session_idx").alias("_row"), F.col(value).alias("_v"), F.col(factor).alias("_f"))
    return (
        spans.withColumn("_row", F.col("origin") + F.col("k") - 1)
        .join(rows, ["series_id", "_row"], "left")
        .select(
            *KEY, "weight", "k",
            (F.col("_v") - F.col("fit_alpha") - F.col("fit_beta") * F.coalesce("_f", F.when(F.col("fit_beta") == 0, F.lit(0.0)))).alias("ar"),
            (F.col("_f") - F.col("factor_mean")).alias("factor_dev"),
            "fit_sigma", "fit_n", "factor_ss",
        )
    )


def cumulated(panel: DataFrame, start: int) -> DataFrame:
    """Adds car and cumulative factor deviation from ``start``; missing adds nothing."""
    w = W.partitionBy(*KEY).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    return panel.where(F.col("k") >= start).select(
        "*",
        F.sum(F.coalesce("ar", F.lit(0.0))).over(w).alias("car"),
        F.sum(F.coalesce("factor_dev", F.lit(0.0))).over(w).alias("cum_dev"),
    )


def _w_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.sum(F.when(x.isNotNull(), w))


def standardised(cum: DataFrame, start: int) -> DataFrame:
    """Adds scar: car over its forecast standard error."""
    days = (F.col("k") - start + 1).cast("double")
    infl = days + days * days / F.col("fit_n") + F.coalesce(
        F.col("cum_dev") * F.col("cum_dev") / F.when(F.col("factor_ss") > 0, F.col("factor_ss")), F.lit(0.0)
    )
    se = F.col("fit_sigma") * F.sqrt(infl)
    return cum.withColumn("scar", F.when(se > 0, F.col("car") / se))


def cross_section(scars: DataFrame, by: list[str]) -> DataFrame:
    """Mean, interval, cross-sectional t and standardised t per (by, k).

    Weighted sums of a centred value keep the variance stable.
    """
    w = F.col("weight").cast("double")
    stats = scars.groupBy(*by, "k").agg(
        F.sum(F.when(F.col("car").isNotNull(), F.col("weight"))).alias("n_events"),
        _w_mean(F.col("car"), w).alias("caar"),
        F.sum(F.when(F.col("scar").isNotNull(), F.col("weight"))).alias("n_scar"),
        _w_mean(F.col("scar"), w).alias("scar_mean"),
    )
    spread = scars.join(stats.select(*by, "k", "caar", "scar_mean"), [*by, "k"]).groupBy(*by, "k").agg(
        F.sum(w * F.pow(F.col("car") - F.col("caar"), 2)).alias("_ss_car"),
        F.sum(w * F.pow(F.col("scar") - F.col("scar_mean"), 2)).alias("_ss_scar"),
    )
    out = stats.join(spread, [*by, "k"])
    n, m = F.col("n_events").cast("double"), F.col("n_scar").cast("double")
    sd = F.sqrt(F.col("_ss_car") / F.when(n > 1, n - 1))
    sds = F.sqrt(F.col("_ss_scar") / F.when(m > 1, m - 1))
    se = sd / F.sqrt(n)
    return out.select(
        *by, "k", "n_events", "caar",
        (F.col("caar") - 1.96 * se).alias("ci_low"),
        (F.col("caar") + 1.96 * se).alias("ci_high"),
        F.when(sd > 0, F.col("caar") / se).alias("t_cross"),
        F.when(sds > 0, F.sqrt(m) * F.col("scar_mean") / sds).alias("t_bmp"),
    )


def estimation_long(fitted: DataFrame, origins: DataFrame, value: str, factor: str, window: int = ESTIMATION) -> DataFrame:
    """(series_id, origin, weight, row, resid) over each origin's usable estimation rows."""
    fits = fitted.where(F.col("fit_alpha").isNotNull()).select(
        "series_id", F.col("session_idx").alias("origin"), "fit_alpha", "fit_beta"
    )
    rows = fitted.where(F.col(value).isNotNull() & (F.col(factor).isNotNull() | F.lit(False))).select(
        "series_id", F.col("session_idx").alias("row"), F.col(value).alias("_v"), F.col(factor).alias("_f")
    )
    spans = origins.join(fits, KEY).withColumn(
        "row", F.explode(F.sequence(F.greatest(F.col("origin") - window, F.lit(1).cast("long")), F.col("origin") - 1))
    )
    return spans.join(rows, ["series_id", "row"]).select(
        *KEY, "weight", "row", (F.col("_v") - F.col("fit_alpha") - F.col("fit_beta") * F.col("_f")).alias("resid")
    )


def rank_deviation(estimation: DataFrame, panel: DataFrame) -> DataFrame:
    """Event-window rank minus its expectation, per origin and k (average ties)."""
    obs = estimation.select(*KEY, "weight", F.lit(None).cast("int").alias("k"), F.col("resid").alias("v")).unionByName(
        panel.where(F.col("ar").isNotNull()).select(*KEY, "weight", "k", F.col("ar").alias("v"))
    )
    order = W.partitionBy(*KEY).orderBy("v")
    same = W.partitionBy(*KEY, "v")
    group = W.partitionBy(*KEY)
    return obs.select(
        *KEY, "weight", "k",
        (
            F.rank().over(order) + (F.count("*").over(same) - 1) / 2.0 - (F.count("*").over(group) + 1) / 2.0
        ).alias("dev"),
    ).where(F.col("k").isNotNull())


def rank_test(devs: DataFrame, start: int, by: list[str]) -> DataFrame:
    """Rank t cumulated from ``start`` to each k; its scale uses the whole window."""
    w = F.col("weight").cast("double")
    daily = devs.groupBy(*by, "k").agg((F.sum(w * F.col("dev")) / F.sum(w)).alias("m"))
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit("all"))
    upto = whole.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    scaled = daily.withColumn("_sigma", F.sqrt(F.avg(F.col("m") * F.col("m")).over(whole)))
    return scaled.where(F.col("k") >= start).select(
        *by, "k", (F.sum("m").over(upto) / (F.sqrt(F.count("*").over(upto)) * F.nullif(F.col("_sigma"), F.lit(0.0)))).alias("t_rank")
    )


def pair_correlations(fitted: DataFrame, origins: DataFrame, value: str, factor: str,
                      window: int = ESTIMATION, least: int = MIN_OVERLAP) -> DataFrame:
    """Residual correlation of origin pairs of one series whose windows overlap.

    A residual is v - alpha - beta f, so its moments over the shared rows follow from
    differences of five running sums. Each pair costs one row: no residuals are
    joined, and pairs further apart than the window never meet.

    Columns: series_id, origin, lag, n, r, pair_weight (event pairs it stands for).
    """
    w = W.partitionBy("series_id").orderBy("session_idx").rowsBetween(W.unboundedPreceding, 0)
    ok = F.col(value).isNotNull() & F.col(factor).isNotNull()
    v, f = F.when(ok, F.col(value)), F.when(ok, F.col(factor))
    run = fitted.select(
        "series_id", F.col("session_idx").alias("row"),
        *[
            F.coalesce(F.sum(e).over(w), F.lit(0.0)).alias(n)
            for n, e in {
                "c_n": F.when(ok, F.lit(1.0)), "c_v": v, "c_f": f, "c_vv": v * v, "c_ff": f * f, "c_vf": v * f,
            }.items()
        ],
    )
    fits = fitted.where(F.col("fit_alpha").isNotNull()).select(
        "series_id", F.col("session_idx").alias("origin"), "fit_beta"
    )
    known = origins.join(fits, KEY)
    sums = ["c_n", "c_v", "c_f", "c_vv", "c_ff", "c_vf"]
    # shared rows of origins i < j: (j - window) .. (i - 1), so sums at i-1 minus at j-window-1
    at_end = run.select("series_id", (F.col("row") + 1).alias("origin"), *[F.col(s).alias(f"e{s}") for s in sums])
    at_start = run.select("series_id", (F.col("row") + window + 1).alias("other"), *[F.col(s).alias(f"s{s}") for s in sums])
    left = known.join(at_end, KEY)
    right = known.select("series_id", F.col("origin").alias("other"), F.col("weight").alias("w2"), F.col("fit_beta").alias("b2")).join(
        at_start, ["series_id", "other"], "left"
    )
    pairs = left.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(window - least)))).withColumn(
        "other", F.col("origin") + F.col("lag")
    ).join(right, ["series_id", "other"])
    d = {s: F.col(f"e{s}") - F.coalesce(F.col(f"s{s}"), F.lit(0.0)) for s in sums}
    n = d["c_n"]
    svv = d["c_vv"] - d["c_v"] * d["c_v"] / n
    sff = d["c_ff"] - d["c_f"] * d["c_f"] / n
    svf = d["c_vf"] - d["c_v"] * d["c_f"] / n
    b1, b2 = F.col("fit_beta"), F.col("b2")
    cov = svv - (b1 + b2) * svf + b1 * b2 * sff
    va = svv - 2 * b1 * svf + b1 * b1 * sff
    vb = svv - 2 * b2 * svf + b2 * b2 * sff
    weight = F.when(F.col("lag") == 0, F.col("weight") * (F.col("weight") - 1) / 2).otherwise(F.col("weight") * F.col("w2"))
    return (
        pairs.where(n >= least)
        .select("series_id", "origin", "lag", n.cast("long").alias("n"),
                F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("r"), weight.cast("double").alias("pair_weight"))
        .where(F.col("r").isNotNull() & (F.col("pair_weight") > 0))
    )


def mean_correlation(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(
        F.sum("pair_weight").cast("long").alias("n_pairs"),
        (F.sum(F.col("pair_weight") * F.col("r")) / F.sum("pair_weight")).alias("mean_corr"),
    )


def corrected_t(t: Column, n: Column, corr: Column) -> Column:
    """Cross-correlation correction of a standardised t."""
    den = 1 + (n - 1) * corr
    return F.when((n >= 2) & (den > 0) & (corr <= 1), t * F.sqrt((1 - corr) / den))


def with_p_values(table: DataFrame) -> DataFrame:
    dof = (F.col("n_events") - 1).cast("double")
    return table.select(
        "*",
        two_sided_p(F.col("t_cross"), dof).alias("p_cross"),
        two_sided_p(F.col("t_bmp"), dof).alias("p_bmp"),
        two_sided_p(F.col("t_rank"), F.lit(-1.0)).alias("p_rank"),
        two_sided_p(F.col("t_kp"), dof).alias("p_kp"),
    )


def event_study_table(fitted: DataFrame, origins: DataFrame, by: list[str], start: int = EVENT_WINDOW[0],
                      value: str = "log_return", factor: str = "factor_ret", corr: DataFrame | None = None) -> DataFrame:
    """CAAR with interval and all tests per (by, k).

    ``corr`` holds mean_corr per ``by``, by default that of pairs within a series; over several series
    pass cross_corr.pair_correlation_summary, which has the pairs across them too.
    """
    panel = abnormal_panel(fitted, origins, value, factor)
    tests = cross_section(standardised(cumulated(panel, start), start), by)
    ranks = rank_test(rank_deviation(estimation_long(fitted, origins, value, factor), panel), start, by)
    corr = mean_correlation(pair_correlations(fitted, origins, value, factor), by) if corr is None else corr
    joined = tests.join(ranks, [*by, "k"], "left")
    joined = joined.join(corr, by, "left") if by else joined.withColumn("_k", F.lit(1)).join(corr.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    corr_or_zero = F.coalesce("mean_corr", F.lit(0.0))
    return joined.withColumn("mean_corr", corr_or_zero).withColumn(
        "t_kp", corrected_t(F.col("t_bmp"), F.col("n_events").cast("double"), F.col("mean_corr"))
    )
