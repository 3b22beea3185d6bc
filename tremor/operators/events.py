"""Event-table operators: inclusion, pooling, episodes, recency, sample flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.scalars import log1p_clipped

# Recency when no event came before, and the episode gap in days.
NO_PRIOR_DAYS = 3650
EPISODE_GAP = 14
RARE_COUNT = 3


def included(events: DataFrame, type_col: str, affected: str, excluded: list[str], least: float) -> DataFrame:
    """Drop excluded types and small events; a missing affected count is dropped too."""
    clean = F.lower(F.trim(F.col(type_col)))
    return events.where(~F.coalesce(clean, F.lit("")).isin(excluded) & (F.col(affected) >= least))


def pooled_types(events: DataFrame, type_col: str, least: int = RARE_COUNT, other: str = "Other") -> DataFrame:
    """Types seen fewer than ``least`` times become one pooled type."""
    counts = events.groupBy(type_col).agg(F.count("*").alias("_n"))
    return (
        events.join(counts, type_col)
        .withColumn(type_col, F.when(F.col("_n") < least, F.lit(other)).otherwise(F.col(type_col)))
        .drop("_n")
    )


def one_hot(df: DataFrame, c: str, values: list[str], prefix: str) -> DataFrame:
    """One 0/1 column per listed value; the list is a declared, bounded category set."""
    return df.select("*", *[F.when(F.col(c) == v, 1.0).otherwise(0.0).alias(f"{prefix}_{v}") for v in values])


def episode_days(events: DataFrame, by: list[str], day: str, gap: int = EPISODE_GAP) -> DataFrame:
    """(by, day, episode): days more than ``gap`` apart start a new episode.

    Runs on distinct days, so its windows are bounded by the calendar.
    """
    days = events.select(*by, day).distinct()
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit("all"))).orderBy(day)
    starts = (F.datediff(F.col(day), F.lag(day).over(w)) > gap).cast("int")
    return days.withColumn("_s", F.coalesce(starts, F.lit(0))).select(
        *by, day, F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long").alias("episode")
    )


def with_episodes(events: DataFrame, by: list[str], day: str, gap: int = EPISODE_GAP) -> DataFrame:
    return events.join(episode_days(events, by, day, gap), [*by, day])


def episode_table(events: DataFrame, by: list[str], day: str, key: str) -> DataFrame:
    """Size, first and last day and span of each episode, from day-level counts."""
    return (
        with_episodes(events, by, day)
        .groupBy(*by, "episode")
        .agg(
            F.count("*").alias("n_events"),
            F.min(day).alias("first_date"),
            F.max(day).alias("last_date"),
            F.datediff(F.max(day), F.min(day)).alias("span_days"),
            F.min(key).alias("first_id"),
            F.max(key).alias("last_id"),
        )
    )


def episode_members(events: DataFrame, by: list[str], day: str, key: str, width: int = 4096) -> DataFrame:
    """Ordered member lists in blocks: one row per episode and block of ids.

    An episode can hold any share of all events; a block holds at most ``width`` ids.
    """
    return (
        with_episodes(events, by, day)
        .groupBy(*by, "episode", F.floor(F.col(key) / width).alias("block"))
        .agg(F.sort_array(F.collect_list(key)).alias("members"))
    )


def day_recency(events: DataFrame, by: list[str], day: str, trailing: int = 365) -> DataFrame:
    """Per day: days since the previous event day and events in the trailing window.

    The trailing window is exclusive at both ends.
    """
    days = events.groupBy(*by, day).agg(F.count("*").alias("n_day"))
    numbered = days.withColumn("_d", F.datediff(F.col(day), F.lit("1970-01-01").cast("date")))
    w = W.partitionBy(*by).orderBy("_d")
    return numbered.select(
        *by,
        day,
        "n_day",
        F.datediff(F.col(day), F.lag(day).over(w)).alias("gap_prev_day"),
        F.coalesce(F.sum("n_day").over(w.rangeBetween(-(trailing - 1), -1)), F.lit(0)).alias("trailing_count"),
    )


def with_recency(events: DataFrame, by: list[str], day: str, key: str) -> DataFrame:
    """Days since the previous event in (day, key) order: 0 unless the day's first event."""
    firsts = events.groupBy(*by, day).agg(F.min(key).alias("_first"))
    rec = day_recency(events, by, day)
    first_gap = F.coalesce(F.col("gap_prev_day"), F.lit(NO_PRIOR_DAYS))
    return (
        events.join(rec, [*by, day])
        .join(firsts, [*by, day])
        .withColumn("days_since_prev", F.when(F.col(key) == F.col("_first"), first_gap).otherwise(F.lit(0)))
        .drop("_first", "gap_prev_day", "n_day")
    )


def truncated_windows(events: DataFrame, by: list[str], day: str, horizon: int) -> DataFrame:
    """End of each day's window: horizon days on, or the day before the next event day."""
    days = events.select(*by, day).distinct()
    w = W.partitionBy(*by).orderBy(day)
    nxt = F.lead(day).over(w)
    full = F.date_add(F.col(day), horizon)
    return days.withColumn("window_end", F.when(nxt <= full, F.date_sub(nxt, 1)).otherwise(full))


def severity_features(severity: str, affected: str) -> list[Column]:
    return [log1p_clipped(severity).alias(f"log_{severity}"), log1p_clipped(affected).alias(f"log_{affected}")]


def sample_flow(df: DataFrame, criteria: list[tuple[str, Column]]) -> DataFrame:
    """Waterfall of exclusions: rows removed by each criterion in order, and rows left.

    One pass finds each row's first failed criterion; the running difference is over
    the handful of criteria.
    """
    failed = F.lit(len(criteria))
    for i in range(len(criteria) - 1, -1, -1):
        failed = F.when(~F.coalesce(criteria[i][1], F.lit(False)), F.lit(i)).otherwise(failed)
    stages = df.groupBy(failed.alias("_at")).agg(F.count("*").alias("_n"))
    names = F.array(F.lit("raw"), *[F.lit(n) for n, _ in criteria])
    frame = df.sparkSession.range(1).select(F.posexplode(names).alias("step", "stage"))
    w = W.partitionBy(F.lit("flow")).orderBy("step")
    total = F.sum("_n").over(W.partitionBy(F.lit("flow")))
    # rows that pass everything carry _at = len(criteria): keep them in the total only
    full = frame.select("step", "stage", (F.col("step") - 1).alias("_at")).join(stages, "_at", "full_outer")
    full = full.withColumn("_n", F.coalesce("_n", F.lit(0)))
    removed = F.when(F.col("step") >= 1, F.col("_n")).otherwise(F.lit(0))
    return (
        full.withColumn("_total", total)
        .where(F.col("step").isNotNull())
        .withColumn("n_removed", removed.cast("long"))
        .withColumn("n_remaining", (F.col("_total") - F.sum("n_removed").over(w)).cast("long"))
        .select("step", "stage", "n_removed", "n_remaining")
    )
