"""Placebo origins: candidate pools, nearest-volatility matches and randomisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.draws import hash_unit
from tremor.operators.calendar import unblocked_sessions
from tremor.operators.outcomes import expected_return, forward_return
from tremor.operators.series import log_return, realised_volatility
from tremor.session import stage

# Estimation history, forward need, volatility ratio, smallest matched pool.
HISTORY = 250
AHEAD = 20
VOL_RATIO = 3.0
MIN_POOL = 10
CAR_HORIZONS = (1, 5, 10, 20)


def session_context(sessions: DataFrame) -> DataFrame:
    """Sessions with realised volatility, month and year."""
    df = sessions.withColumn("log_return", log_return())
    return df.select(
        "series_id", "session_idx", "date", realised_volatility().alias("vol"), F.month("date").alias("month"), F.year("date").alias("year"),
        F.max("session_idx").over(W.partitionBy("series_id")).alias("last_idx"),
    )


def candidates(context: DataFrame, days: DataFrame) -> DataFrame:
    """Sessions outside every event window with enough history and future."""
    free = unblocked_sessions(context, days)
    return free.where((F.col("session_idx") > HISTORY) & (F.col("session_idx") <= F.col("last_idx") - AHEAD))


def nearest_by_value(left: DataFrame, right: DataFrame, by: list[str], value: str, key: str, out: str) -> DataFrame:
    """Key of the right row whose value is closest, ties to the lowest key.

    One ordered pass per group over both sides: the closest row is the last one at
    or below or the first one at or above, so no pair is formed. Equal right values
    are reduced to their lowest key first.
    """
    r = right.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(key).alias("_rk")).withColumn("_rv", F.col(value))
    both = left.withColumn("_left", F.lit(1)).unionByName(r, allowMissingColumns=True)
    up = W.partitionBy(*by).orderBy(F.col(value)).rangeBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy(*by).orderBy(F.col(value)).rangeBetween(W.currentRow, W.unboundedFollowing)
    hit = F.when(F.col("_rk").isNotNull(), F.struct("_rv", "_rk"))
    near = both.withColumn("_lo", F.max(hit).over(up)).withColumn("_hi", F.min(hit).over(down)).where("_left = 1")
    dl, dh = F.col(value) - F.col("_lo._rv"), F.col("_hi._rv") - F.col(value)
    pick = (
        F.when(F.col("_lo").isNull(), F.col("_hi._rk")).when(F.col("_hi").isNull(), F.col("_lo._rk"))
        .when(dl < dh, F.col("_lo._rk")).when(dh < dl, F.col("_hi._rk")).otherwise(F.least("_lo._rk", "_hi._rk"))
    )
    return near.withColumn(out, pick).select(*left.columns, out)


def matched_placebos(origins: DataFrame, cands: DataFrame) -> DataFrame:
    """(series_id, origin, placebo): same month, nearest volatility; any month when the month has none."""
    left = origins.where(F.col("vol").isNotNull())
    first = nearest_by_value(left, cands.select("series_id", "month", "vol", "session_idx"), ["series_id", "month"], "vol", "session_idx", "_m")
    both = nearest_by_value(first, cands.select("series_id", "vol", "session_idx"), ["series_id"], "vol", "session_idx", "_a")
    return both.withColumn("placebo", F.coalesce("_m", "_a")).drop("_m", "_a").where(F.col("placebo").isNotNull())


def session_car(fitted: DataFrame, horizons=CAR_HORIZONS) -> DataFrame:
    """Cumulative abnormal return from each session over each horizon, null on any missing day.

    ``fitted`` carries its own smallest window (50 rows for the randomisation test).
    """
    return fitted.select("series_id", "session_idx", *[((forward_return(h) - expected_return(h)) / 100.0).alias(f"car_{h}") for h in horizons])


def pools(origins: DataFrame, cands: DataFrame, cars: DataFrame, horizons=CAR_HORIZONS) -> DataFrame:
    """(series_id, origin, pool): candidates of the origin's month, tiered, with their CARs.

    A month's candidates are one array per (series, month), bounded by the calendar:
    first other years with a volatility ratio within bounds (if at least MIN_POOL),
    then other years, then the whole month, then any session of the series.
    """
    joined = cands.join(cars, ["series_id", "session_idx"])
    item = F.struct(F.col("session_idx").alias("idx"), "year", "vol", *[f"car_{h}" for h in horizons])
    month = joined.groupBy("series_id", "month").agg(F.sort_array(F.collect_list(item)).alias("_month"))
    whole = joined.groupBy("series_id").agg(F.sort_array(F.collect_list(item)).alias("_all"))
    o = origins.join(month, ["series_id", "month"], "left").join(whole, "series_id", "left")
    other = F.filter("_month", lambda c: c["year"] != F.col("year"))
    close = F.filter(other, lambda c: (c["vol"] > 0) & (F.greatest(c["vol"] / F.col("vol"), F.col("vol") / c["vol"]) <= VOL_RATIO))
    pool = (
        F.when((F.size(close) >= MIN_POOL) & (F.col("vol") > 0), close).when(F.size(other) > 0, other)
        .when(F.size("_month") > 0, F.col("_month")).otherwise(F.col("_all"))
    )
    return o.withColumn("pool", pool).where(F.size("pool") > 0).drop("_month", "_all")


def randomisation(events: DataFrame, pooled: DataFrame, cars: DataFrame, n_draws: int, horizons=CAR_HORIZONS, seed: int = 42) -> DataFrame:
    """Observed mean CAR against the means of one hashed placebo per event and draw.

    Candidates are numbered in a table of their own, so a draw carries the pool's size and a slot,
    and meets the picked candidate in an equi-join.
    """
    pooled = stage(pooled.select("series_id", "origin", "pool"), "pools")
    slots = pooled.select("series_id", "origin", F.posexplode("pool").alias("slot", "_c"))
    live = events.join(pooled.select("series_id", "origin", F.size("pool").alias("_size")), ["series_id", "origin"])
    obs = live.join(cars.withColumnRenamed("session_idx", "origin"), ["series_id", "origin"]).agg(*[F.avg(f"car_{h}").alias(f"o_{h}") for h in horizons])
    drawn = live.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).select(
        "series_id", "origin", "b", F.floor(hash_unit(seed, F.col("event_id").cast("string"), "b") * F.col("_size")).cast("int").alias("slot"))
    draws = drawn.join(slots, ["series_id", "origin", "slot"])
    dist = draws.groupBy("b").agg(*[F.avg(F.col(f"_c.car_{h}")).alias(f"d_{h}") for h in horizons])
    long = dist.withColumn("_k", F.lit(1)).join(obs.withColumn("_k", F.lit(1)), "_k").select(
        F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"d_{h}").alias("d"), F.col(f"o_{h}").alias("o")) for h in horizons])).alias("_x")).select("_x.*")
    return long.groupBy("horizon").agg(
        F.max("o").alias("observed"), F.avg("d").alias("placebo_mean"), F.stddev_samp("d").alias("placebo_sd"), F.percentile("d", 0.025).alias("placebo_low"),
        F.percentile("d", 0.975).alias("placebo_high"), ((1 + F.sum((F.abs("d") >= F.abs("o")).cast("long"))) / (1 + F.count("*"))).alias("p_value"))
