"""Seeded resampling draws that do not depend on partitioning."""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def hash_unit(seed: int, *parts) -> Column:
    """Uniform in [0, 1) from the first 32 bits of an md5 over the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(
        4294967296.0
    )


def numbered_clusters(clusters: DataFrame, by: list[str], cluster: str) -> DataFrame:
    """(by, cluster, _no): the place of each cluster within ``by``, from 0, by name as text."""
    # numbered by (prefix, name as text), the same order as by name, one window per prefix
    named = clusters.withColumn("_pre", F.substring(F.col(cluster).cast("string"), 1, 7))
    prefixes = named.groupBy(*by, "_pre").agg(F.count("*").alias("_np"))
    before = (W.partitionBy(*by) if by else W.partitionBy(F.lit("all"))).orderBy("_pre").rowsBetween(W.unboundedPreceding, -1)
    offsets = prefixes.select(*by, "_pre", F.coalesce(F.sum("_np").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*by, "_pre").orderBy(F.col(cluster).cast("string"))
    return named.join(offsets, [*by, "_pre"]).select(
        *by, cluster, (F.col("_off") + F.row_number().over(inside) - 1).cast("long").alias("_no"))


def pick_units(seed: int, b: int, most: int) -> np.ndarray:
    """The first ``most`` picks of draw ``b`` in [0, 1), the same as those of ``cluster_draws``."""
    head = f"{seed}:{b}:"
    raw = b"".join([md5(f"{head}{q}".encode()).digest() for q in range((most + 3) // 4)])
    halves = np.frombuffer(raw, ">u8").astype(np.uint64) >> np.uint64(4)
    four = np.stack([halves & np.uint64((1 << 30) - 1), halves >> np.uint64(30)], axis=1)
    return four.ravel()[:most] / float(1 << 30)


def pick_counts(units: np.ndarray, size: int) -> np.ndarray:
    """How often a draw with these picks takes each of ``size`` clusters."""
    return np.bincount((units[:size] * size).astype(np.int64), minlength=size)


def cluster_draws(clusters: DataFrame, by: list[str], cluster: str, n_boot: int, seed: int = 42) -> DataFrame:
    """Weights of each cluster in each bootstrap draw: (by, b, cluster, w).

    ``clusters`` has one row per (by, cluster). Draw b takes as many picks as there
    are clusters; the picks are expanded after a shuffle on (by, b), so the work is
    spread over tasks even for a single group.
    """
    numbered = numbered_clusters(clusters, by, cluster)
    sizes = numbered.groupBy(*by).agg(F.count("*").alias("_c"))
    # four picks of 30 bits from each md5
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "b", "_q").cast("binary"))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 17)]
    parts = [x for h in halves for x in (h.bitwiseAND(F.lit((1 << 30) - 1)), F.shiftright(h, 30))]
    picks = (
        sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
        .repartition(*[F.col(c) for c in by], F.col("b"))
        .withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / 4))))
        .withColumn("_four", F.array(*parts))
        .select(*by, "_c", "b", F.explode(F.slice("_four", F.lit(1), F.least(F.lit(4), F.col("_c") - 4 * F.col("_q")).cast("int"))).alias("_u"))
        .withColumn("_no", F.floor(F.col("_u") / F.lit(float(1 << 30)) * F.col("_c")).cast("long"))
        .groupBy(*by, "b", "_no")
        .agg(F.count("*").alias("w"))
    )
    return picks.join(numbered, [*by, "_no"]).select(*by, "b", cluster, "w")
