"""Forward outcomes of an event, computed once per session and read at the origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.ordered import exact_quantiles
from tremor.functions.scalars import log_ratio_pct
from tremor.operators.calendar import event_days, sessions_to_next, usable_origins
from tremor.operators.series import w_series

# Protocol horizons and windows, in sessions.
RETURN_HORIZONS = (1, 5, 10, 15, 20)
VOLUME_WINDOWS = (1, 5, 10, 20)
BASELINE = 30
GATE = 5
CAP = 90
WINSOR = (0.05, 0.95)


def forward_return(h: int) -> Column:
    """100 ln(P_h / P_0), null when the window runs off the series or a price is not positive."""
    end, base = F.lead("close", h - 1).over(w_series()), F.lag("close").over(w_series())
    return F.when((end > 0) & (base > 0), 100.0 * F.log(end / base))


def forward_return_end(h: int) -> Column:
    return F.when(forward_return(h).isNotNull(), F.lead("date", h - 1).over(w_series()))


def volume_base() -> Column:
    f = w_series().rowsBetween(-BASELINE, -1)
    mean = F.avg("volume").over(f)
    return F.when((F.count("volume").over(f) == BASELINE) & (mean > 0), mean)


def volume_future(w: int) -> Column:
    f = w_series().rowsBetween(0, w - 1)
    mean = F.avg("volume").over(f)
    return F.when((F.count("volume").over(f) == w) & (mean > 0), mean)


def recovery_scan() -> list[Column]:
    """P0, the drawdown gate and the recovery session, if any, inside the cap.

    The next CAP closes are one bounded array per session: first the position of a
    close below P0, then of a close at or above P0 after it.
    """
    base = F.lag("close").over(w_series())
    ahead = F.collect_list(F.struct("close")).over(w_series().rowsBetween(0, CAP - 1))
    gate = F.min("close").over(w_series().rowsBetween(0, GATE - 1))
    return [base.alias("p0"), gate.alias("_gate"), ahead.alias("_ahead")]


def session_outcomes(
    sessions: DataFrame,
    horizons=RETURN_HORIZONS,
    windows=VOLUME_WINDOWS,
) -> DataFrame:
    """All outcomes that depend on the origin session alone."""
    df = sessions.select(
        "series_id",
        "date",
        "session_idx",
        *[forward_return(h).alias(f"y1_{h}") for h in horizons],
        *[forward_return_end(h).alias(f"y1_{h}_end") for h in horizons],
        volume_base().alias("v_base"),
        *[volume_future(w).alias(f"_vf{w}") for w in windows],
        *[F.lead("date", w - 1).over(w_series()).alias(f"_vd{w}") for w in windows],
        *recovery_scan(),
        F.max("session_idx").over(W.partitionBy("series_id")).alias("last_idx"),
    )
    for w in windows:
        value = F.log(F.col(f"_vf{w}") / F.col("v_base"))
        df = df.withColumn(f"y2_{w}", value).withColumn(
            f"y2_{w}_end", F.when(value.isNotNull(), F.col(f"_vd{w}"))
        )
    dip = F.array_position(F.transform("_ahead", lambda s: s["close"] < F.col("p0")), True)
    df = df.withColumn("_dip", F.when(F.col("p0") > 0, dip))
    after = F.array_position(
        F.transform(
            F.slice("_ahead", F.col("_dip").cast("int") + 1, CAP), lambda s: s["close"] >= F.col("p0")
        ),
        True,
    )
    rec = F.when(F.col("_dip") > 0, after)
    return df.select(
        "*",
        F.coalesce((F.col("_gate") < F.col("p0")) & (F.col("p0") > 0), F.lit(False)).alias("drawdown"),
        ((F.col("p0") > 0) & F.col("_gate").isNotNull()).alias("_has_base"),
        F.when(rec > 0, F.col("_dip") + rec).alias("t_rec"),
        (F.col("session_idx") + CAP - 1 > F.col("last_idx")).alias("series_truncated"),
        F.col("_vf5").alias("v_future5") if 5 in windows else F.lit(None).cast("double").alias("v_future5"),
    ).drop("_gate", "_ahead", "_dip", *[f"_vf{w}" for w in windows], *[f"_vd{w}" for w in windows])


def recovery_state(df: DataFrame) -> DataFrame:
    """Duration, observed flag and censoring reason from t_rec, t_next and the gate.

    With no recovery the next event censors only before the cap; with a recovery
    that comes too late it also censors on the cap itself.
    """
    cap, nxt, rec = F.lit(CAP).cast("long"), F.col("t_next"), F.col("t_rec")
    ends = F.least(cap, nxt)  # least skips a missing next event
    recovered = rec.isNotNull() & (nxt.isNull() | (rec < nxt)) & (rec <= cap)
    by_next = F.when(rec.isNull(), nxt < cap).otherwise(nxt <= cap)
    reason = (
        F.when(~F.coalesce(F.col("_has_base"), F.lit(False)), "no_baseline")
        .when(~F.col("drawdown"), "no_drawdown")
        .when(recovered, "recovered")
        .when(F.coalesce(by_next, F.lit(False)), "next_disaster")
        .otherwise("90_day_cap")
    )
    duration = (
        F.when(reason == "no_baseline", F.lit(None))
        .when(reason == "no_drawdown", F.lit(0))
        .when(reason == "recovered", rec)
        .otherwise(ends)
    ).cast("double")
    return df.select(
        *[c for c in df.columns if c != "_has_base"],
        duration.alias("duration"),
        (reason == "recovered").cast("int").alias("event_observed"),
        (reason != "recovered").alias("censored"),
        reason.alias("reason"),
    )


def event_outcomes(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per alignable event with every outcome and label-end date.

    Everything heavy runs per (series, day); events then join that bounded table once.
    """
    days = usable_origins(event_days(events, sessions))
    per_day = days.join(
        session_outcomes(sessions).drop("date"), ["series_id", "session_idx"]
    )
    rows = recovery_state(
        sessions_to_next(events.join(per_day.drop("n_events"), ["series_id", "event_date"]))
    )
    # label end of the recovery outcome: the session the duration ends on
    end_idx = F.least(
        F.col("session_idx") + F.greatest(F.coalesce(F.col("duration"), F.lit(0.0)).cast("long") - 1, F.lit(0)),
        F.col("last_idx"),
    )
    dates = sessions.select("series_id", F.col("session_idx").alias("_end"), F.col("date").alias("y3_end"))
    return (
        rows.withColumn("_end", end_idx)
        .join(dates, ["series_id", "_end"], "left")
        .drop("_end", "last_id", "next_origin", "last_idx")
        .withColumn("y2_5_pct", log_ratio_pct("y2_5"))
    )


def winsorised(df: DataFrame, value: str, out: str, quantiles=WINSOR) -> DataFrame:
    """Clip to quantiles of the observed values; nulls stay null."""
    cuts = exact_quantiles(df.withColumn("_k", F.lit(1)), ["_k"], value, {"_lo": quantiles[0], "_hi": quantiles[1]})
    cuts = cuts.select("_k", "_lo", "_hi")
    v = F.col(value)
    return (
        df.withColumn("_k", F.lit(1))
        .join(F.broadcast(cuts), "_k", "left")  # one row
        .withColumn(out, F.when(v.isNotNull(), F.greatest(F.least(v, F.col("_hi")), F.col("_lo"))))
        .drop("_k", "_lo", "_hi")
    )


def expected_return(h: int) -> Column:
    """100 (h alpha + beta sum of the factor over the window), null on any missing factor."""
    f = w_series().rowsBetween(0, h - 1)
    total = F.sum("factor_ret").over(f)
    return F.when(
        F.count("factor_ret").over(f) == h,
        100.0 * (h * F.col("fit_alpha") + F.col("fit_beta") * total),
    )


def abnormal_returns(fitted: DataFrame, horizons=RETURN_HORIZONS) -> DataFrame:
    """Forward return minus the fitted expectation, per session, with the fit beside it."""
    cols = []
    for h in horizons:
        value = forward_return(h) - expected_return(h)
        cols += [
            value.alias(f"ab_{h}"),
            F.when(value.isNotNull(), F.lead("date", h - 1).over(w_series())).alias(f"ab_{h}_end"),
        ]
    return fitted.select(
        "series_id", "date", "session_idx", "fit_alpha", "fit_beta", "fit_sigma",
        F.coalesce("fit_n", F.lit(0).cast("long")).alias("fit_n"), *cols,
    )


def series_panel(sessions: DataFrame, events: DataFrame, least: int = 60) -> DataFrame:
    """Outcomes of every event day on every series long enough.

    Each session covers the days since the one before it, so joining the distinct
    event days on the calendar day alone yields one row per (day, series).
    """
    size = W.partitionBy("series_id")
    kept = sessions.withColumn("_n", F.count("*").over(size)).where(F.col("_n") >= least).drop("_n")
    by_day = W.partitionBy(F.lit("days")).orderBy("event_date")  # one row per calendar day
    days = events.select("event_date").distinct().withColumn(
        "event_code", (F.row_number().over(by_day) - 1).cast("long")
    )
    w = W.partitionBy("series_id").orderBy("date")
    covered = kept.select(
        "series_id",
        "session_idx",
        "date",
        F.coalesce(F.date_add(F.lag("date").over(w), 1), F.col("date")).alias("_from"),
    ).select("series_id", "session_idx", F.explode(F.sequence("_from", "date")).alias("event_date"))
    return (
        covered.join(days, "event_date")
        .where(F.col("session_idx") > 1)
        .join(session_outcomes(kept), ["series_id", "session_idx"])
    )
