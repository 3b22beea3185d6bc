"""Ranks, running sums and exact quantiles over whole tables, without one giant window.

A global ``ORDER BY`` window puts every row into one task. These functions first
collapse equal values to one row each (partial aggregation), cut the value range
into buckets, and combine a short per-bucket offset with a window inside each
bucket. Any cut points give the same exact answer; they only balance the load.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.session import stage

INF = float("inf")


def cut_points(df: DataFrame, value: str, buckets: int) -> list[float]:
    """At most ``buckets - 1`` increasing cut points, a bounded list."""
    if buckets <= 1:
        return [-INF, INF]
    probs = [i / buckets for i in range(1, buckets)]
    inner = sorted(set(df.approxQuantile(value, probs, 0.5 / buckets)))
    return [-INF, *inner, INF]


def with_bucket(df: DataFrame, value: str, buckets: int) -> DataFrame:
    splits = cut_points(df, value, buckets)
    if len(splits) < 3:
        return df.withColumn("_bucket", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=value, outputCol="_bucket").transform(df)


#: Rows that one bucket of running sums is meant to hold, and buckets at least and at most.
BUCKET_ROWS, FEWEST, MOST = 100_000, 16, 4096


def running_sums(
    df: DataFrame, by: list[str], value: str, sums: list[str], buckets: int | None = None
) -> DataFrame:
    """Adds ``<s>_upto`` (inclusive running sum by ascending value) and ``<s>_total``.

    ``df`` holds one row per (by, value). The offset window sees at most ``buckets``
    rows per group; the inner window sees one bucket of one group. The number of buckets
    follows the rows unless given; it never changes the result.
    """
    # computed once: the cut points and both passes below read the same table
    df = stage(df.where(F.col(value).isNotNull()), "runs")
    if buckets is None:
        buckets = max(FEWEST, min(MOST, df.count() // BUCKET_ROWS))
    parted = with_bucket(df, value, buckets)
    per_bucket = parted.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    offsets = per_bucket.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}_before") for s in sums],
        *[F.sum(f"_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return (
        parted.join(offsets, [*by, "_bucket"])
        .select(
            *[c for c in df.columns],
            *[(F.col(f"_{s}_before") + F.sum(s).over(inside)).alias(f"{s}_upto") for s in sums],
            *[f"{s}_total" for s in sums],
        )
    )


def value_ranks(df: DataFrame, by: list[str], value: str, buckets: int | None = None) -> DataFrame:
    """One row per (by, value): count ``n``, average-tie rank ``rank``, group size ``n_total``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ran = running_sums(counts, by, value, ["n"], buckets)
    return ran.withColumn("rank", F.col("n_upto") - (F.col("n") - 1) / 2.0)


def _whole_quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], buckets: int | None = None, times: str | None = None
) -> DataFrame:
    """The quantiles of ``exact_quantiles`` from running sums over all values; a row counts ``times`` times."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.count("*") if times is None else F.sum(times)).alias("n"))
    ran = running_sums(counts, by, value, ["n"], buckets)
    first = F.col("n_upto") - F.col("n")
    picks = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n_total") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        v = F.col(value)
        picks += [
            F.max(F.when((first <= low) & (low < F.col("n_upto")), v)).alias(f"_{name}_lo"),
            F.max(F.when((first <= high) & (high < F.col("n_upto")), v)).alias(f"_{name}_hi"),
        ]
    out = ran.groupBy(*by).agg(F.max("n_total").alias("n_total"), *picks)
    cols = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n_total") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*by, F.col("n_total"), *cols)


#: Ranks within n / SKETCH of a quantile are looked at one by one; a sketch says where they lie.
SKETCH = 500


def _bracketed(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> tuple[DataFrame, DataFrame]:
    """All groups, and (by, _name, _p, _n, _lo, _hi): non-null values and those around each wanted quantile, null where the sketch missed one.

    A sketch of each column gives two values around the quantile. Only values between them are counted
    one by one and shuffled; of those below, the number is enough.
    """
    near = 2.0 / SKETCH
    ends, entries = [], []
    for k, (name, (c, p)) in enumerate(wanted.items()):
        v = F.col(c).cast("double")
        ends += [F.count(c).alias(f"_n{k}"), F.percentile_approx(v, [max(0.0, p - near), min(1.0, p + near)], F.lit(SKETCH)).alias(f"_e{k}")]
        low = F.lit(-INF) if p <= near else F.col(f"_e{k}")[0]
        high = F.lit(INF) if p >= 1 - near else F.col(f"_e{k}")[1]
        entries.append(F.struct(F.lit(name).alias("_name"), F.when(v >= low, v).alias("_v"), F.when(v <= high, F.lit(p)).alias("_p"), F.col(f"_n{k}").alias("_n")))
    groups = stage(df.groupBy(*by).agg(*ends), "quantile-ends")
    at = groups.select(*(F.col(c).alias(f"_b_{c}") for c in by), *(f"_{x}{k}" for k in range(len(wanted)) for x in "ne"))
    same = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by]
    tall = df.select(*by, *dict.fromkeys(c for c, _ in wanted.values() if c not in by)).join(at, same)
    tall = tall.select(*by, F.explode(F.array(*entries)).alias("_x")).select(*by, "_x.*").where("_p IS NOT NULL")
    counts = tall.groupBy(*by, "_name", "_p", "_n", "_v").agg(F.count("*").alias("_c"))
    # values below the bracket are one row without a value, which comes first
    upto = F.sum("_c").over(W.partitionBy(*by, "_name").orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0))
    pos = F.col("_p") * (F.col("_n") - 1)
    at_place = lambda place: F.max(F.when((F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto")), F.col("_v")))
    found = counts.withColumn("_upto", upto).groupBy(*by, "_name", "_p", "_n").agg(at_place(F.floor(pos)).alias("_lo"), at_place(F.ceil(pos)).alias("_hi"))
    return groups.select(*by), stage(found, "quantiles")


def exact_quantiles_of(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Linear-interpolated quantiles of several columns, one row per group: ``wanted`` maps a name to (column, probability).

    Exact whatever the sketch says: should a place fall outside its bracket, that quantile is made again from all values.
    """
    groups, found = _bracketed(df, by, wanted)
    missed = [r["_name"] for r in found.where("_lo IS NULL OR _hi IS NULL").select("_name").distinct().collect()]
    pos = F.col("_p") * (F.col("_n") - 1)
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos))
    parts = [found.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == name, value)).alias(name) for name in wanted))]
    parts += [_whole_quantiles(df, by, wanted[name][0], {name: wanted[name][1]}).drop("n_total") for name in missed]
    out = groups
    for part in parts:
        held = [name for name in wanted if name in part.columns and (part is not parts[0] or name not in missed)]
        part = part.select(*(F.col(c).alias(f"_b_{c}") for c in by), *held)
        out = out.join(part, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by], "left").select(*out.columns, *held)
    return out


def exact_quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], buckets: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles, one row per group, one column per entry of ``probs``.

    With ``buckets`` they come from running sums over all values, as they do for a place that a sketch misses.
    """
    if buckets is not None:
        return _whole_quantiles(df, by, value, probs, buckets)
    live = df.where(F.col(value).isNotNull()).select(*by, value)
    _, found = _bracketed(live, by, {name: (value, p) for name, p in probs.items()})
    if found.where("_lo IS NULL OR _hi IS NULL").limit(1).count():
        return _whole_quantiles(df, by, value, probs)
    pos = F.col("_p") * (F.col("_n") - 1)
    whole = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos))
    return found.groupBy(*by).agg(F.max("_n").alias("n_total"), *(F.max(F.when(F.col("_name") == name, whole)).alias(name) for name in probs))


def counted_quantiles(df: DataFrame, by: list[str], value: str, times: str, probs: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` of rows that stand for ``times`` equal rows each."""
    return _whole_quantiles(df, by, value, probs, times=times)


def order_index(
    df: DataFrame, date: str, key: str, out: str = "ord", width: int = 1 << 20, by: list[str] | None = None
) -> DataFrame:
    """0-based position of each row by (date, key) within ``by``, key being a unique integer.

    Offsets come from counts per date and per key block inside a date, so no window
    ever holds more than one key block of one date, however hot the date is.
    """
    by = by or []
    blocked = df.withColumn("_block", F.floor(F.col(key) / width))
    per_block = blocked.groupBy(*by, date, "_block").agg(F.count("*").alias("_n"))
    per_date = per_block.groupBy(*by, date).agg(F.sum("_n").alias("_nd"))
    days = W.partitionBy(*by) if by else W.partitionBy(F.lit("days"))  # one row per calendar day
    prior_dates = days.orderBy(date).rowsBetween(W.unboundedPreceding, -1)
    date_offset = per_date.select(*by, date, F.coalesce(F.sum("_nd").over(prior_dates), F.lit(0)).alias("_d0"))
    prior_blocks = W.partitionBy(*by, date).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        per_block.withColumn("_b0", F.coalesce(F.sum("_n").over(prior_blocks), F.lit(0)))
        .join(date_offset, [*by, date])
        .select(*by, date, "_block", (F.col("_d0") + F.col("_b0")).alias("_start"))
    )
    inside = W.partitionBy(*by, date, "_block").orderBy(key)
    return (
        blocked.join(offsets, [*by, date, "_block"])
        .withColumn(out, (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_block", "_start")
    )
