"""Side-series features around an event day, computed per distinct day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.operators.calendar import backward_days, window_days

# Hazard window and baseline, loss window, FX needs, wet-day threshold.
RAIN = (-2, 0)
RAIN_BASE = (-33, -3)
LOSS = (-7, 14)
FX_MIN_ROWS = 32
FX_STD_ROWS = 30
HEAVY_RAIN = 100.0

# Natural hazards among the loss record types.
NATURAL_EVENTS = [
    "FLOOD", "STRONG WIND", "DROUGHT", "HEAVY RAINS", "LANDSLIDE", "CYCLONE", "GALE",
    "TSUNAMI", "STORM", "HIGH WIND", "ROCK FALL", "LAND SUBSIDENCE", "TORNADO",
    "SEA SURGE", "FOREST FIRE", "HAIL STORM", "COASTAL EROSION",
]


def loss_features(events: DataFrame, day: str, losses: DataFrame, measures: list[str], natural: list[str]) -> DataFrame:
    """Per event day: districts hit, log sums, records and an availability flag.

    Records are first collapsed per (day, district), so the window join sees a
    bounded table whatever the record count.
    """
    daily = (
        losses.where(F.col("kind").isin(natural))
        .groupBy("date", "district")
        .agg(F.count("*").alias("_n"), *[F.sum(m).alias(m) for m in measures])
    )
    span = window_days(events, day, *LOSS, "date")
    got = span.join(daily, "date").groupBy(day).agg(
        F.countDistinct("district").cast("double").alias("districts_hit"),
        F.sum("_n").cast("double").alias("records"),
        *[F.sum(m).alias(f"_{m}") for m in measures],
    )
    base = events.select(day).distinct().join(got, day, "left")
    zero = F.lit(0.0)
    return base.select(
        day,
        F.coalesce("districts_hit", zero).alias("districts_hit"),
        *[F.log1p(F.coalesce(f"_{m}", zero)).alias(f"{m}_log") for m in measures],
        F.coalesce("records", zero).alias("records"),
        (F.coalesce("records", zero) > 0).cast("double").alias("available"),
    )


def hazard_features(events: DataFrame, day: str, stations: DataFrame, heavy: float = HEAVY_RAIN) -> DataFrame:
    """Per event day: 3-day rain per station summarised, peak wind, anomaly vs baseline."""
    cells = stations.groupBy("date", "station").agg(F.avg("rain").alias("rain"), F.avg("wind").alias("wind"))
    near = window_days(events, day, *RAIN, "date").join(cells, "date")
    per_station = near.groupBy(day, "station").agg(F.sum("rain").alias("r3"), F.max("wind").alias("w"))
    window = per_station.groupBy(day).agg(
        F.max("r3").alias("rain_max3d"), F.avg("r3").alias("rain_mean3d"), F.stddev_samp("r3").alias("rain_spread3d"),
        F.sum((F.coalesce(F.col("r3"), F.lit(0.0)) > heavy).cast("double")).alias("stations_wet"), F.max("w").alias("wind_max3d"),
    )
    base = (
        window_days(events, day, *RAIN_BASE, "date").join(cells, "date")
        .groupBy(day, "station").agg(F.avg("rain").alias("m"))
        .groupBy(day).agg((3.0 * F.avg("m")).alias("_base"))
    )
    return (
        events.select(day).distinct().join(window, day, "left").join(base, day, "left")
        .withColumn("rain_anomaly", F.when(F.col("_base") > 0, F.col("rain_mean3d") / F.col("_base") - 1))
        .drop("_base")
    )


def fx_features(events: DataFrame, day: str, fx: DataFrame) -> DataFrame:
    """Per event day: 1- and 5-step log returns and 30-return volatility strictly before it."""
    w = W.partitionBy(F.lit("fx")).orderBy("date")  # one row per calendar day
    steps = fx.withColumn("ret", F.log(F.col("rate") / F.lag("rate").over(w))).select(
        "date",
        F.row_number().over(w).alias("_seen"),
        F.log(F.col("rate") / F.lag("rate").over(w)).alias("fx_logret_1"),
        F.log(F.col("rate") / F.lag("rate", 5).over(w)).alias("fx_logret_5"),
        F.stddev_samp("ret").over(w.rowsBetween(-(FX_STD_ROWS - 1), 0)).alias("fx_vol_30"),
    )
    days = events.select(day).distinct().select(day, F.date_sub(F.col(day), 1).alias("_asof"), F.lit(1).alias("_k"))
    carried = backward_days(steps.withColumn("_k", F.lit(1)), days, ["_k"], "date", "_asof").drop("date")
    enough = F.col("_seen") >= FX_MIN_ROWS
    return days.join(carried, ["_k", "_asof"], "left").select(
        day, *[F.when(enough, F.col(c)).alias(c) for c in ("fx_logret_1", "fx_logret_5", "fx_vol_30")]
    )


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Fail when a key appears twice, before a one-to-one join."""
    dup = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if dup:
        raise ValueError(f"duplicate keys, for example {[tuple(r)[:-1] for r in dup]}")
