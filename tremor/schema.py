"""Declared schemas, feature metadata and the outcome-leak guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SESSIONS = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("date", T.DateType()),
    T.StructField("close", T.DoubleType()), T.StructField("volume", T.DoubleType()), T.StructField("session_idx", T.LongType()),
])
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("series_id", T.StringType()), T.StructField("event_date", T.DateType()),
    T.StructField("type", T.StringType()), T.StructField("severity", T.DoubleType()), T.StructField("affected", T.DoubleType()),
    T.StructField("status", T.StringType()),
])

# Outcome names start with these and never enter a feature set.
OUTCOME_PREFIXES = ("y1_", "y2_", "y3_", "ab_", "duration", "event_observed", "censored", "reason", "drawdown", "v_future", "t_rec", "t_next")

# Ordered patterns, first match decides (block, availability, depth).
FEATURE_RULES = [
    (r"^(log_return|lag_return_\d+)$", "return", "real_time", 0),
    (r"^squared_return$", "return", "real_time", 1),
    (r"^(sma|ema)_\d+$", "level", "real_time", 0),
    (r"^price_to_(sma|ema)_\d+$", "momentum", "real_time", 1),
    (r"^(rolling_std|realised_vol)", "volatility", "real_time", 0),
    (r"^(vol_ratio|vol_cv|log_vol)", "volume", "real_time", 0),
    (r"^(momentum|max_drawdown)", "regime", "real_time", 1),
    (r"^(severity|affected|damage)$", "severity", "ex_post", 0),
    (r"^log_(severity|affected|damage)", "severity", "ex_post", 1),
    (r"^(districts_hit|records|.*_log)$", "loss", "ex_post", 0),
    (r"^(rain|wind|stations)", "hazard", "real_time", 0),
    (r"^fx_", "fx", "real_time", 0),
    (r"^type_", "type", "real_time", 0),
    (r".*_available$", "flag", "ex_post", 0),
]


def is_outcome(name: str) -> bool:
    return name.startswith(OUTCOME_PREFIXES)


def assert_no_leak(columns: list[str]) -> None:
    """Refuse a feature list that names an outcome."""
    bad = sorted(c for c in columns if is_outcome(c))
    if bad:
        raise ValueError(f"outcome columns in the feature set: {bad}")


def classify(names: DataFrame, column: str = "feature") -> DataFrame:
    """Adds block, availability and depth by the first matching rule."""
    c = F.col(column)
    out = names
    for i, (name, default) in enumerate((("block", "unassigned"), ("availability", "unassigned"))):
        expr = None
        for rule in FEATURE_RULES:
            expr = F.when(c.rlike(rule[0]), rule[1 + i]) if expr is None else expr.when(c.rlike(rule[0]), rule[1 + i])
        out = out.withColumn(name, expr.otherwise(default))
    depth = None
    for rule in FEATURE_RULES:
        depth = F.when(c.rlike(rule[0]), rule[3]) if depth is None else depth.when(c.rlike(rule[0]), rule[3])
    return out.withColumn("depth", depth.otherwise(99))


def feature_spec(spark: SparkSession, columns: list[str]) -> DataFrame:
    names = spark.createDataFrame([(c,) for c in columns], "feature string")
    return classify(names)


def information_sets(spec: DataFrame) -> dict[str, list[str]]:
    """Feature lists per availability class; unassigned names raise."""
    rows = spec.select("feature", "availability").collect()  # the feature list is bounded
    lost = sorted(r.feature for r in rows if r.availability == "unassigned")
    if lost:
        raise ValueError(f"features without an availability class: {lost}")
    real = sorted(r.feature for r in rows if r.availability == "real_time")
    return {"real_time": real, "ex_post": sorted(r.feature for r in rows)}
