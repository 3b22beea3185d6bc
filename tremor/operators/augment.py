"""Time-aware neighbour interpolation of minority train rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.draws import hash_unit
from tremor.operators.neighbours import WINDOW_DAYS, nearest_in_group

# Fixed value: largest synthetic share.
MAX_SHARE = 0.25

__all__ = ["MAX_SHARE", "WINDOW_DAYS", "interpolated", "minority_pairs", "nearest_in_group", "pair_report", "scaled"]


def scaled(minority: DataFrame, fold: list[str], columns: list[str], prefix: str = "z_") -> DataFrame:
    """Adds z-scores of ``columns`` over the minority rows of each fold; a column without spread counts as spread 1."""
    spread = minority.groupBy(*fold).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_samp(c).alias(f"_s_{c}") for c in columns))
    out = minority.join(F.broadcast(spread), fold)  # one row per fold
    unit = lambda c: F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0))
    return out.select(*minority.columns, *(((F.col(c) - F.col(f"_m_{c}")) / unit(c)).alias(f"{prefix}{c}") for c in columns))


def minority_pairs(minority: DataFrame, by: list[str], columns: tuple[str, ...]) -> DataFrame:
    """(by, event_id, neighbour, in_window): the nearest row of the type in the window, or else at any date."""
    near = nearest_in_group(minority, by, True, columns).where("neighbour IS NOT NULL")
    lost = minority.join(near.select(*by, "event_id"), [*by, "event_id"], "left_anti")
    # a fallback looks at all rows of the group, but keeps only the answers of those left over
    wide = nearest_in_group(minority, by, False, columns).where("neighbour IS NOT NULL").join(lost.select(*by, "event_id"), [*by, "event_id"], "left_semi")
    return near.withColumn("in_window", F.lit(True)).unionByName(wide.withColumn("in_window", F.lit(False)))


def pair_report(minority: DataFrame, synthetic: DataFrame, fold: list[str]) -> DataFrame:
    """Per fold: minority rows, pairs inside the window and beyond it, rows without a partner, synthetic rows."""
    n = minority.groupBy(*fold).agg(F.count("*").alias("n_minority"))
    one = synthetic.where("copy = 0").groupBy(*fold).agg(F.count_if("in_window").alias("pairs_in_window"), F.count_if(~F.col("in_window")).alias("pairs_window_relaxed"))
    made = synthetic.groupBy(*fold).agg(F.count("*").alias("n_synthetic"))
    j = n.join(one, fold, "left").join(made, fold, "left").fillna(0, ["pairs_in_window", "pairs_window_relaxed", "n_synthetic"])
    return j.withColumn("skipped_no_partner", F.col("n_minority") - F.col("pairs_in_window") - F.col("pairs_window_relaxed"))


def interpolated(train: DataFrame, minority: DataFrame, by: list[str], xs: list[str], y: str | list[str], copies: int = 1, seed: int = 42,
                 max_share: float = MAX_SHARE, columns: tuple[str, ...] = ("z1", "z2"), derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Synthetic rows between each minority row and its nearest same-type neighbour.

    ``minority`` carries the scaled distance ``columns`` and a type among ``by``; rows without a partner
    in the five-year window fall back to any date, singletons yield nothing. ``xs`` and ``y`` are
    interpolated, the type is copied, and ``derive`` recomputes what follows from them, so identities
    that hold on real rows hold on synthetic ones. Raises when a fold's synthetic share would pass the cap.
    """
    mixed = [*xs, *([y] if isinstance(y, str) else y)]
    pairs = minority_pairs(minority, by, columns)
    a = minority.select(*by, "event_id", *mixed)
    b = minority.select(*by, F.col("event_id").alias("neighbour"), *[F.col(c).alias(f"_b_{c}") for c in mixed])
    syn = pairs.join(a, [*by, "event_id"]).join(b, [*by, "neighbour"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    syn = syn.withColumn("r", hash_unit(seed, F.col("event_id").cast("string"), "copy"))
    syn = syn.select(*by, "event_id", "neighbour", "copy", "in_window", "r", *[(F.col(c) + F.col("r") * (F.col(f"_b_{c}") - F.col(c))).alias(c) for c in mixed])
    if max_share < 1.0:
        n_syn, n_real = syn.groupBy("fold").agg(F.count("*").alias("s")), train.groupBy("fold").agg(F.count("*").alias("n"))
        over = n_real.join(n_syn, "fold").where(F.col("s") > F.floor(F.lit(max_share / (1 - max_share)) * F.col("n"))).collect()  # one row per fold
        if over:
            raise ValueError(f"synthetic rows pass the share cap in folds {[o.fold for o in over]}")
    return derive(syn) if derive else syn
