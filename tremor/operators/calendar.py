"""Alignment of events to sessions as equi-joins on calendar days.

Each right-hand row is expanded to the days it covers (forward: the days since the
previous row; backward: the days until the next row). The expansion is bounded by
the calendar, not by the number of events, so as-of joins become plain equi-joins
on (series, day): no range join, no window over the event table, and AQE can split
a hot (series, day) like any other join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _day_bounds(left: DataFrame, by: list[str], day: str) -> DataFrame:
    return left.groupBy(*by).agg(F.min(day).alias("_min_day"), F.max(day).alias("_max_day"))


def forward_days(right: DataFrame, left: DataFrame, by: list[str], date: str, day: str) -> DataFrame:
    """(by, day, right columns): for each day, the first right row dated on or after it."""
    w = W.partitionBy(*by).orderBy(date)
    bounds = _day_bounds(left, by, day)
    spans = right.join(bounds, by, "left").withColumn(
        "_from",
        F.coalesce(F.date_add(F.lag(date).over(w), 1), F.least(F.col(date), F.col("_min_day"))),
    )
    return spans.withColumn(day, F.explode(F.sequence("_from", date))).drop(
        "_from", "_min_day", "_max_day"
    )


def backward_days(right: DataFrame, left: DataFrame, by: list[str], date: str, day: str) -> DataFrame:
    """(by, day, right columns): for each day, the last right row dated on or before it."""
    w = W.partitionBy(*by).orderBy(date)
    bounds = _day_bounds(left, by, day)
    spans = right.join(bounds, by, "left").withColumn(
        "_to",
        F.coalesce(F.date_sub(F.lead(date).over(w), 1), F.greatest(F.col(date), F.col("_max_day"))),
    )
    return spans.withColumn(day, F.explode(F.sequence(date, "_to"))).drop(
        "_to", "_min_day", "_max_day"
    )


def asof_forward(left, right, by, day, date):
    """Left join of the first right row on or after ``day`` (right unique per by, date)."""
    return left.join(forward_days(right, left, by, date, day), [*by, day], "left")


def asof_backward(left, right, by, day, date):
    """Left join of the last right row on or before ``day`` (inclusive)."""
    return left.join(backward_days(right, left, by, date, day), [*by, day], "left")


def nearest(left: DataFrame, right: DataFrame, by: list[str], day: str, date: str, out: str) -> DataFrame:
    """Signed day gap to the nearest right row (positive: it lies ahead); ties take the earlier."""
    slim = right.select(*by, date).distinct()
    back = backward_days(slim, left, by, date, day).withColumnRenamed(date, "_before")
    ahead = forward_days(slim, left, by, date, day).withColumnRenamed(date, "_after")
    gap_b = F.datediff("_before", F.col(day))
    gap_a = F.datediff("_after", F.col(day))
    pick = (
        F.when(gap_a.isNull() | (-gap_b <= gap_a), gap_b).otherwise(gap_a)
    )
    return (
        left.join(back, [*by, day], "left")
        .join(ahead, [*by, day], "left")
        .withColumn(out, F.coalesce(pick, gap_a))
        .drop("_before", "_after")
    )


def event_days(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per (series, event day) with its origin session and the next event's.

    Columns: series_id, event_date, n_events, last_id, session_idx, origin_date,
    next_origin (origin of the next event in (date, id) order for the day's last
    event; earlier events of the day have the same day's origin as their next).
    Outcomes depend on the day only, so everything heavy runs on this bounded table.
    """
    days = events.groupBy("series_id", "event_date").agg(
        F.count("*").alias("n_events"), F.max("event_id").alias("last_id")
    )
    cal = forward_days(
        sessions.select("series_id", "date", "session_idx"), days, ["series_id"], "date", "event_date"
    )
    aligned = days.join(cal, ["series_id", "event_date"], "left").withColumnRenamed("date", "origin_date")
    w = W.partitionBy("series_id").orderBy("event_date")
    return aligned.withColumn("next_origin", F.lead("session_idx").over(w))


def usable_origins(days: DataFrame) -> DataFrame:
    """Days whose origin has a session before it."""
    return days.where(F.col("session_idx") > 1)


def sessions_to_next(days_joined: DataFrame) -> DataFrame:
    """Adds t_next, the session offset of the next event, null when there is none."""
    own_next = F.when(F.col("event_id") < F.col("last_id"), F.col("session_idx")).otherwise(
        F.col("next_origin")
    )
    gap = own_next - F.col("session_idx") + 1
    # greatest() skips nulls, so a missing next event needs its own branch
    return days_joined.withColumn("t_next", F.when(gap.isNotNull(), F.greatest(F.lit(0).cast("long"), gap)))


def align_factor(sessions: DataFrame, factor: DataFrame) -> DataFrame:
    """Factor return re-expressed on each series' sessions.

    The factor is cumulated on its own calendar, carried to each session, and
    differenced, so a session holds the factor's move since the previous session.
    """
    fw = W.partitionBy(F.lit("factor")).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    level = factor.where(F.col("ret").isNotNull()).select(
        F.col("date").alias("_fdate"), F.sum("ret").over(fw).alias("_level")
    )
    keyed = level.withColumn("_k", F.lit(1))
    left = sessions.withColumn("_k", F.lit(1))
    days = backward_days(keyed, left.select("_k", "date"), ["_k"], "_fdate", "date").drop("_k", "_fdate")
    w = W.partitionBy("series_id").orderBy("date")
    return (
        sessions.join(days, "date", "left")
        .withColumn("factor_ret", F.col("_level") - F.lag("_level").over(w))
        .drop("_level")
    )


def window_days(events: DataFrame, day: str, low: int, high: int, out: str) -> DataFrame:
    """Distinct event days expanded to every calendar day in [low, high] around them."""
    return events.select(day).distinct().withColumn(
        out, F.explode(F.sequence(F.date_add(F.col(day), low), F.date_add(F.col(day), high)))
    )


def splice_after(base: DataFrame, extension: DataFrame, by: list[str], date: str) -> DataFrame:
    """Base rows plus only those extension rows dated after the base's last date per group."""
    last = base.groupBy(*by).agg(F.max(date).alias("_last"))
    tail = (
        extension.join(last, by, "left")
        .where(F.col("_last").isNull() | (F.col(date) > F.col("_last")))
        .drop("_last")
    )
    return base.unionByName(tail, allowMissingColumns=True)


def overlap_check(a: DataFrame, b: DataFrame, by: list[str], a_val: str, b_val: str) -> DataFrame:
    """Agreement of two sources on their shared keys: n, exact matches, max and mean gap."""
    gap = F.abs(F.col(a_val) - F.col(b_val))
    return a.join(b, by).agg(
        F.count("*").alias("n_overlap"),
        F.sum((gap == 0).cast("long")).alias("n_exact"),
        F.max(gap).alias("max_abs_diff"),
        F.avg(gap).alias("mean_abs_diff"),
    )


def assert_overlap(check: DataFrame, tolerance: float) -> None:
    row = check.first()
    if row["max_abs_diff"] is not None and row["max_abs_diff"] >= tolerance:
        raise ValueError(f"sources disagree by up to {row['max_abs_diff']}")


def unblocked_sessions(sessions: DataFrame, days: DataFrame, low: int = -5, high: int = 20) -> DataFrame:
    """Sessions outside every event's [low, high] session window."""
    blocked = (
        days.where(F.col("session_idx").isNotNull())
        .select("series_id", F.explode(F.sequence(F.col("session_idx") + low, F.col("session_idx") + high)).alias("session_idx"))
        .distinct()
    )
    return sessions.join(blocked, ["series_id", "session_idx"], "left_anti")


def truncate_series(sessions: DataFrame, events: DataFrame, tail: int) -> DataFrame:
    """Each series cut ``tail`` sessions after the origin of its last event."""
    last = events.groupBy("series_id").agg(F.max("event_date").alias("event_date"))
    bound = asof_forward(
        last, sessions.select("series_id", "date", "session_idx"), ["series_id"], "event_date", "date"
    ).select("series_id", (F.col("session_idx") + tail - 1).alias("_bound"))
    return sessions.join(bound, "series_id").where(F.col("session_idx") <= F.col("_bound")).drop("_bound")


def assert_within(df: DataFrame, day: str, end: str) -> None:
    """Raise with a few offending dates when a row lies past the study end."""
    late = df.where(F.col(day) > F.lit(end).cast("date")).select(day).limit(5).collect()
    if late:
        raise ValueError(f"dates past {end}: {[str(r[0]) for r in late]}")
