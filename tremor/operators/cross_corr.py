"""Residual correlation of all pairs of events, within and across series.

The residual of an event is v - alpha - beta f over its estimation window, so the moments of two
residuals over the dates both windows share follow from running sums of products along the shared
dates of the two series, differenced at the ends of the overlap. The sums are made once for a pair of
series; a pair of origins costs two look-ups. Series meet as packed rows, bounded by the calendar, and
a task gives counts per cell of r, never pairs. The median is found exactly by reading the pairs of its
cell once more.

The number of series pairs grows with the square of the series. For many series ``date_sum_correlation``
estimates the same quantity from one sum for each date.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tremor.functions.ordered import running_sums
from tremor.operators.study import ESTIMATION, KEY, MIN_OVERLAP, estimation_long
from tremor.session import stage

#: Cells of r in [-1, 1], origins of one series handled at once, keys that series are dealt to.
CELLS, ROWS, DEALT = 4096, 256, 16

CELL_COUNTS = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("other_id", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType()), T.StructField("n_pairs", T.DoubleType()), T.StructField("sum_r", T.DoubleType())])


def packed_series(fitted: DataFrame, origins: DataFrame, value: str, factor: str, window: int = ESTIMATION) -> DataFrame:
    """One row for each series: its sessions in order, and what origins there are on them.

    Values are centred on the series mean, which leaves residual moments as they are.
    """
    at = origins.groupBy("series_id", F.col("origin").alias("session_idx")).agg(F.sum("weight").cast("double").alias("weight"))
    mean = W.partitionBy("series_id")
    rows = fitted.select(
        F.col("series_id").cast("string").alias("series_id"), "session_idx", F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"),
        (F.col(value) - F.avg(value).over(mean)).alias("v"), (F.col(factor) - F.avg(factor).over(mean)).alias("f"),
        F.when(F.col("fit_alpha").isNotNull(), F.col("fit_beta")).alias("beta"),
    ).join(at, ["series_id", "session_idx"], "left")
    row = F.struct("session_idx", "day", *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("v", "f", "beta", "weight")))
    return rows.groupBy("series_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).withColumn("window", F.lit(window))


class _Series:
    """Sessions of one series, and for each origin the days and slope of its window."""

    def __init__(self, rows: pa.StructScalar, window: int):
        session, self.day, v, f, beta, weight = (rows.values.field(k).to_numpy(zero_copy_only=False) for k in range(6))
        self.ok = np.isfinite(v) & np.isfinite(f)
        self.v, self.f = v, f
        used = np.flatnonzero(np.isfinite(beta) & (weight > 0))
        # the window is the sessions origin - window to origin - 1, as far as they exist
        start = np.searchsorted(session, session[used] - window)
        used, start = used[start < used], start[start < used]
        self.first, self.last = self.day[start], self.day[used - 1]
        self.beta, self.weight, self.session = beta[used], weight[used], session[used]


def _pair_values(a: _Series, b: _Series, same: bool, least: int):
    """(r, weight) arrays of all pairs of origins with ``least`` shared dates, ROWS origins of ``a`` at a time."""
    days, i, j = np.intersect1d(a.day[a.ok], b.day[b.ok], assume_unique=True, return_indices=True)
    if len(days) < least:
        return
    va, fa, vb, fb = a.v[a.ok][i], a.f[a.ok][i], b.v[b.ok][j], b.f[b.ok][j]
    run = {k: np.r_[0.0, np.cumsum(x)] for k, x in {"va": va, "fa": fa, "vb": vb, "fb": fb, "vavb": va * vb, "vafb": va * fb, "favb": fa * vb, "fafb": fa * fb, "vava": va * va, "vafa": va * fa, "fafa": fa * fa, "vbvb": vb * vb, "vbfb": vb * fb, "fbfb": fb * fb}.items()}
    lo_b, hi_b = np.searchsorted(days, b.first), np.searchsorted(days, b.last, "right")
    for at in range(0, len(a.session), ROWS):
        s = slice(at, at + ROWS)
        lo = np.maximum(np.searchsorted(days, a.first[s])[:, None], lo_b)
        hi = np.minimum(np.searchsorted(days, a.last[s], "right")[:, None], hi_b)
        met = hi - lo >= least
        if same:  # each pair once; events of one origin are pairs too
            met &= a.session[s][:, None] <= b.session
        x, y = np.nonzero(met)
        lo, hi, n = lo[x, y], hi[x, y], (hi - lo)[x, y].astype(float)
        d = {k: c[hi] - c[lo] for k, c in run.items()}
        m = lambda p, q: d[p + q] - d[p] * d[q] / n
        ba, bb = a.beta[s][x], b.beta[y]
        cov = m("va", "vb") - bb * m("va", "fb") - ba * m("fa", "vb") + ba * bb * m("fa", "fb")
        var_a = m("va", "va") - 2 * ba * m("va", "fa") + ba * ba * m("fa", "fa")
        var_b = m("vb", "vb") - 2 * bb * m("vb", "fb") + bb * bb * m("fb", "fb")
        wa, wb = a.weight[s][x], b.weight[y]
        weight = np.where(a.session[s][x] == b.session[y], wa * (wa - 1) / 2, wa * wb) if same else wa * wb
        # a spread of rounding size is a constant residual
        fine = (weight > 0) & (var_a > 1e-12 * np.maximum(d["vava"], 1e-300)) & (var_b > 1e-12 * np.maximum(d["vbvb"], 1e-300))
        yield np.clip(cov[fine] / np.sqrt(var_a[fine] * var_b[fine]), -1, 1), weight[fine]


def _cell(r: np.ndarray) -> np.ndarray:
    return np.minimum(((r + 1) * (CELLS / 2)).astype(np.int64), CELLS - 1)


def _met_batches(batches, least: int, only: tuple[int, ...]):
    """Of each pair of series: counts and sums for each cell of r, or the values of the cells ``only``."""
    for batch in batches:
        for k in range(len(batch)):
            name, other, window = (batch.column(c)[k].as_py() for c in (0, 1, 4))
            a, b = (_Series(batch.column(c)[k], window) for c in (2, 3))
            n, s = np.zeros(CELLS), np.zeros(CELLS)
            for r, w in _pair_values(a, b, name == other, least):
                cell = _cell(r)
                if only:
                    held = np.isin(cell, only)
                    value, at = np.unique(r[held], return_inverse=True)
                    cells, counts = _cell(value), np.bincount(at, w[held], len(value))
                    yield _rows(name, other, cells, value, counts, value * counts)
                else:
                    n += np.bincount(cell, w, CELLS)
                    s += np.bincount(cell, w * r, CELLS)
            if not only:
                cells = np.flatnonzero(n)
                yield _rows(name, other, cells, np.full(len(cells), np.nan), n[cells], s[cells])


def _rows(name: str, other: str, cells, r, n, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array([other] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(r, pa.float64()), pa.array(n, pa.float64()), pa.array(s, pa.float64())], names=CELL_COUNTS.names)


def series_pairs(packed: DataFrame) -> DataFrame:
    """Every pair of series once, each with itself too, by an equi-join on pairs of keys they are dealt to.

    Rows are few and a pair is heavy, so both sides are dealt to a fixed number of partitions: a broadcast
    or partitions joined by their bytes would put all pairs into one task.
    """
    key = F.pmod(F.xxhash64("series_id"), F.lit(DEALT)).cast("int")
    keyed = packed.withColumn("own", key).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    keyed = keyed.select("series_id", "rows", "window", "own", F.least("own", "k").alias("x"), F.greatest("own", "k").alias("y"))
    keyed = keyed.repartition(DEALT * DEALT, "x", "y")
    a, b = keyed.alias("a"), keyed.select("series_id", "rows", "own", "x", "y").alias("b")
    met = a.join(b.hint("shuffle_hash"), (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.series_id") <= F.col("b.series_id")))
    met = met.where((F.col("a.x") == F.least("a.own", "b.own")) & (F.col("a.y") == F.greatest("a.own", "b.own")))
    return met.select(F.col("a.series_id").alias("series_id"), F.col("b.series_id").alias("other_id"), F.col("a.rows").alias("rows"), F.col("b.rows").alias("other_rows"), F.col("a.window").alias("window"))


def correlation_cells(pairs: DataFrame, least: int = MIN_OVERLAP, only: tuple[int, ...] = ()) -> DataFrame:
    """(series_id, other_id, cell, r, n_pairs, sum_r); ``pairs`` comes from series_pairs."""
    return pairs.mapInArrow(lambda batches: _met_batches(batches, least, only), CELL_COUNTS)


def pair_correlation_summary(fitted: DataFrame, origins: DataFrame, value: str = "log_return", factor: str = "factor_ret",
                             window: int = ESTIMATION, least: int = MIN_OVERLAP, median: bool = True) -> DataFrame:
    """One row over all pairs of events: n_pairs, mean_corr, median_corr, n_pairs_total; without ``median`` the first two.

    A pair counts where both windows share ``least`` dates and neither residual is constant on them;
    ``n_pairs_total`` counts all pairs of events with a fit. Without pairs the mean and median are null.
    """
    packed = stage(packed_series(fitted, origins, value, factor, window), "corr-packed")
    pairs = series_pairs(packed)
    cells = stage(correlation_cells(pairs, least), "corr-cells")
    total = cells.agg(F.coalesce(F.sum("n_pairs"), F.lit(0.0)).alias("n_pairs"), (F.sum("sum_r") / F.sum("n_pairs")).alias("mean_corr"))
    if not median:
        return total.select(F.col("n_pairs").cast("long").alias("n_pairs"), "mean_corr")
    # the two middle pairs; CELLS rows at most are looked at
    upto = cells.groupBy("cell").agg(F.sum("n_pairs").alias("n")).withColumn("upto", F.sum("n").over(W.orderBy("cell")))
    n_all = F.col("n_pairs")
    middle = upto.crossJoin(total).where((F.col("upto") > F.floor((n_all - 1) / 2)) & (F.col("upto") - F.col("n") <= F.ceil((n_all - 1) / 2)))
    held = [(r.cell, r.upto - r.n, r.n_pairs) for r in middle.orderBy("cell").collect()]  # one or two cells with pairs
    if not held:
        return total.select(F.col("n_pairs").cast("long").alias("n_pairs"), "mean_corr", F.lit(None).cast("double").alias("median_corr"), F.lit(0).cast("long").alias("n_pairs_total"))
    values = correlation_cells(pairs, least, tuple(c for c, _, _ in held)).groupBy("r").agg(F.sum("n_pairs").alias("n"))
    ranked = running_sums(values, [], "r", ["n"]).withColumn("upto", F.col("n_upto") + F.lit(held[0][1]))
    n_all = F.lit(held[0][2])
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("r")))
    mid = ranked.agg(((at(F.floor((n_all - 1) / 2)) + at(F.ceil((n_all - 1) / 2))) / 2).alias("median_corr"))
    known = packed.select(F.aggregate("rows", F.lit(0.0), lambda s, x: s + F.when(~F.isnan(x["beta"]) & ~F.isnan(x["weight"]), x["weight"]).otherwise(F.lit(0.0))).alias("w"))
    events = known.agg(F.sum("w").alias("w")).select((F.col("w") * (F.col("w") - 1) / 2).cast("long").alias("n_pairs_total"))
    return total.crossJoin(mid).crossJoin(events).select(F.col("n_pairs").cast("long").alias("n_pairs"), "mean_corr", "median_corr", "n_pairs_total")


def date_sum_correlation(fitted: DataFrame, origins: DataFrame, value: str = "log_return", factor: str = "factor_ret", window: int = ESTIMATION) -> DataFrame:
    """(date_sum_corr, n_date_pairs): the mean product of standardised residuals over all (pair, shared date).

    Of a date with residuals z and weights w, the sum over pairs is ((sum w z)^2 - sum w z^2) / 2, so any
    number of series costs one aggregation by date. Pairs count by the dates they share, not once each,
    and residuals are standardised over their whole windows; that is what sets it apart from the mean of
    pair correlations.
    """
    held = estimation_long(fitted, origins, value, factor, window).join(fitted.select("series_id", F.col("session_idx").alias("row"), "date"), ["series_id", "row"])
    whole = W.partitionBy(*KEY)
    z = held.withColumn("_sd", F.stddev_pop("resid").over(whole)).withColumn("_m", F.avg("resid").over(whole))
    z = z.where(F.col("_sd") > 0).select("date", F.col("weight").cast("double").alias("w"), ((F.col("resid") - F.col("_m")) / F.col("_sd")).alias("z"))
    daily = z.groupBy("date").agg(F.sum(F.col("w") * F.col("z")).alias("s"), F.sum(F.col("w") * F.col("z") * F.col("z")).alias("q"), F.sum("w").alias("n"))
    return daily.agg((F.sum(F.col("s") * F.col("s") - F.col("q")) / F.sum(F.col("n") * (F.col("n") - 1))).alias("date_sum_corr"), (F.sum(F.col("n") * (F.col("n") - 1)) / 2).cast("long").alias("n_date_pairs"))
