"""Chronological walk-forward folds as a long membership table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.ordered import exact_quantiles, exact_quantiles_of, order_index
from tremor.session import stage

# The reference geometry, in units of the position column.
TRAIN, TEST, STEP = 30, 10, 10


@dataclass(frozen=True)
class Geometry:
    """Fold lengths in units of the position (rows, days or months); ``n`` positions only say how many folds fit."""

    n: int
    train: int = TRAIN
    test: int = TEST
    step: int = STEP

    @property
    def n_folds(self) -> int:
        spare = self.n - self.train - self.test
        return 0 if spare < 0 else spare // self.step + 1


def month_positions(df: DataFrame, date: str, train: int = TRAIN, test: int = TEST, step: int = STEP) -> tuple[DataFrame, Geometry]:
    """Adds ``pos``, months since the first one, and the geometry in months.

    Folds follow from the calendar alone: more rows make folds fuller and later rows add folds, but
    no earlier fold changes. Rows of one day never split between roles.
    """
    month = (F.year(date) * 12 + F.month(date)).cast("long")
    first, last = df.agg(F.min(month), F.max(month)).first()  # two numbers
    first, last = (0, -1) if first is None else (first, last)
    return df.withColumn("pos", month - F.lit(first)), Geometry(last - first + 1, train, test, step)


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(float(b))).cast("long")


def fold_membership(ordered: DataFrame, geo: Geometry, ord_col: str = "pos", mode: str = "sliding") -> DataFrame:
    """Adds (fold, role) by arithmetic on the position; a row is in at most
    (train + test) / step folds, or in every later one when expanding."""
    if mode not in ("sliding", "expanding"):
        raise ValueError(f"unknown mode {mode!r}")
    o, last = F.col(ord_col), F.lit(geo.n_folds - 1).cast("long")
    zero = F.lit(0).cast("long")
    test_from = F.greatest(_ceil_div(o - geo.train - geo.test + 1, geo.step), zero)
    test_to = F.least(F.floor((o - geo.train) / float(geo.step)), last)
    train_from = F.greatest(_ceil_div(o - geo.train + 1, geo.step), zero)
    train_to = last if mode == "expanding" else F.least(F.floor(o / float(geo.step)), last)

    def span(a, b):
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    roles = F.concat(
        F.transform(span(train_from, train_to), lambda f: F.struct(f.alias("fold"), F.lit("train").alias("role"))),
        F.transform(span(test_from, test_to), lambda f: F.struct(f.alias("fold"), F.lit("test").alias("role"))),
    )
    return ordered.withColumn("_m", F.explode(roles)).select("*", "_m.fold", "_m.role").drop("_m")


def first_test_dates(members: DataFrame, date: str, by: tuple = ("fold",)) -> DataFrame:
    return members.where("role = 'test'").groupBy(*by).agg(F.min(date).alias("first_test"))


def purge(members: DataFrame, date: str, label_end: str, by: tuple = ("fold",)) -> DataFrame:
    """Drop train rows whose label reaches the fold's first test date; unknown ends stay."""
    first = first_test_dates(members, date, by)
    # one row per fold (and configuration): bounded by the geometry
    keep = (F.col("role") == "test") | F.col(label_end).isNull() | (F.col(label_end) < F.col("first_test"))
    return members.join(F.broadcast(first), [*by]).where(keep)


def grouped_order(df: DataFrame, date: str) -> DataFrame:
    """Position by distinct day, so rows of one day never split between roles."""
    days = df.select(date).distinct()
    w = W.partitionBy(F.lit("days")).orderBy(date)  # one row per calendar day
    return df.join(days.withColumn("pos", (F.row_number().over(w) - 1).cast("long")), date)


def train_medians(members: DataFrame, cols: list[str], by: tuple = ("fold",)) -> DataFrame:
    """Per fold, the train median of each column, 0 when all are missing."""
    train = members.where("role = 'train'")
    out = exact_quantiles_of(train, [*by], {f"_med_{c}": (c, 0.5) for c in cols})
    return out.select(*by, *[F.coalesce(F.col(f"_med_{c}"), F.lit(0.0)).alias(f"_med_{c}") for c in cols])


def median_imputed(members: DataFrame, cols: list[str], by: tuple = ("fold",)) -> DataFrame:
    meds = F.broadcast(train_medians(members, cols, by))  # one row per fold (and configuration)
    out = members.join(meds, [*by])
    return out.select(
        *[c for c in members.columns if c not in cols],
        *[F.coalesce(F.col(c), F.col(f"_med_{c}")).alias(c) for c in cols],
    )


def inner_membership(train_rows: DataFrame, by: list[str], pos: str, count: str, date: str, label_end: str, k: int = 3,
                     least: int = 1) -> DataFrame:
    """Purged inner splits of every outer fold: (.., split, inner_role).

    Split sizes follow from each fold's train count by integer arithmetic; the purge
    compares label ends with the split's first validation date.
    """
    n, p = F.col(count), F.col(pos)
    size = F.floor(n / F.lit(float(k + 1)))
    split = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    df = train_rows.withColumn("split", split)
    start = n - (F.lit(k) - F.col("split")) * size
    role = F.when(p < start, "train").when(p < start + size, "validation")
    df = df.withColumn("inner_role", role).where(F.col("inner_role").isNotNull())
    first = df.where("inner_role = 'validation'").groupBy(*by, "split").agg(F.min(date).alias("_fv"))
    keep = (F.col("inner_role") == "validation") | F.col(label_end).isNull() | (F.col(label_end) < F.col("_fv"))
    kept = df.join(F.broadcast(first), [*by, "split"]).where(keep).drop("_fv")  # one row per fold and split
    return kept


def split_bits(train: DataFrame, by: list[str], date: str, key: str, label_end: str, ks) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Adds ``_bits``, the roles of a row in the purged inner splits made ``ks`` at a time, and lists the splits (k, split).

    Two bits for each split: 1 train, 2 validation, 0 neither; the splits are those of ``inner_membership``.
    Only the first row of each validation part is looked up, by counts per day and a rank within its
    day, and rows are compared with it by (date, key), so rows are not shuffled.
    """
    parts = [(k, j) for k in ks for j in range(k)]
    per = W.partitionBy(*by)  # one row per calendar day
    days = train.groupBy(*by, date).agg(F.count("*").alias("_nd"))
    days = days.withColumn("_first", F.coalesce(F.sum("_nd").over(per.orderBy(date).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_nd").over(per))
    places = F.array(*(F.struct(F.lit(i).alias("_e"), (F.col("_n") - F.lit(k - j) * F.floor(F.col("_n") / F.lit(float(k + 1)))).cast("long").alias("_place")) for i, (k, j) in enumerate(parts)))
    edges = days.select("*", F.explode(places).alias("_x")).select("*", "_x.*").where((F.col("_first") <= F.col("_place")) & (F.col("_place") < F.col("_first") + F.col("_nd")))
    edges = stage(edges.select(*by, date, "_e", (F.col("_place") - F.col("_first")).alias("_at")), "split-edges")  # one row per fold and split
    near = train.select(*by, date, key).join(F.broadcast(edges.select(*by, date).distinct()), [*by, date]).withColumn("_day", F.col(date))
    rank = order_index(stage(near, "split-days"), date, key, "_at", by=[*by, "_day"]).drop("_day")
    first = edges.join(rank, [*by, date, "_at"]).groupBy(*by).agg(
        *(F.max(F.when(F.col("_e") == i, F.struct(F.col(date).alias("date"), F.col(key).alias("key")))).alias(f"_e{i}") for i in range(len(parts))))
    marked = train.join(F.broadcast(stage(first, "split-firsts")), by, "left")  # one row per fold
    d, n = F.col(date), F.col(key)
    before = [F.coalesce((d < F.col(f"_e{i}.date")) | ((d == F.col(f"_e{i}.date")) & (n < F.col(f"_e{i}.key"))), F.lit(True)) for i in range(len(parts))]
    bits = F.lit(0).cast("long")
    for i, (k, j) in enumerate(parts):
        kept = F.col(f"_e{i}").isNotNull() & (F.col(label_end).isNull() | (F.col(label_end) < F.col(f"_e{i}.date")))
        until = before[i + 1] if j + 1 < k else F.lit(True)
        bits = bits + F.when(before[i], F.when(kept, F.lit(1 << 2 * i)).otherwise(0)).when(until, F.lit(2 << 2 * i)).otherwise(0)
    return marked.withColumn("_bits", bits).select(*train.columns, "_bits"), parts


def split_roles(parts: list[tuple[int, int]]) -> Column:
    """(k, split, inner_role) of each split that ``_bits`` has a role in."""
    role = lambda i: F.when(F.shiftright("_bits", 2 * i).bitwiseAND(F.lit(3)) == 1, "train").otherwise("validation")
    held = [F.when(F.shiftright("_bits", 2 * i).bitwiseAND(F.lit(3)) > 0, F.struct(F.lit(k).alias("k"), F.lit(j).alias("split"), role(i).alias("inner_role"))) for i, (k, j) in enumerate(parts)]
    return F.array_compact(F.array(*held))


def surviving_splits(inner: DataFrame, by: list[str], least: int = 5) -> DataFrame:
    """Inner train size per split and whether it survives the purge."""
    return inner.groupBy(*by, "split").agg(
        F.sum((F.col("inner_role") == "train").cast("long")).alias("n_train"),
        F.sum((F.col("inner_role") == "validation").cast("long")).alias("n_validation"),
    ).withColumn("usable", F.col("n_train") >= least)


def leakage_audit(members: DataFrame, date: str, label_end: str) -> DataFrame:
    """Per fold: last train label end against the first test date, before purging."""
    first = first_test_dates(members, date)
    train = members.where("role = 'train'").join(F.broadcast(first), "fold")
    return train.groupBy("fold", "first_test").agg(
        F.max(label_end).alias("last_label_end"),
        F.sum((F.col(label_end) >= F.col("first_test")).cast("long")).alias("n_overlapping"),
        F.count("*").alias("n_train"),
    ).withColumn("leaks", F.col("n_overlapping") > 0)


def baselines(members: DataFrame, target: str) -> DataFrame:
    """Per fold constants from train rows: zero, mean, median."""
    train = members.where((F.col("role") == "train") & F.col(target).isNotNull())
    means = train.groupBy("fold").agg(F.lit(0.0).alias("zero"), F.avg(target).alias("train_mean"), F.count("*").alias("n_train"))
    return means.join(exact_quantiles(train, ["fold"], target, {"train_median": 0.5}).drop("n_total"), "fold")


def ordered_events(df: DataFrame) -> tuple[DataFrame, Geometry]:
    return month_positions(order_index(df, "event_date", "event_id"), "event_date")


def span_table(members: DataFrame, date: str, key: str) -> DataFrame:
    """First and last day, size and span in years per fold and role."""
    return members.groupBy("fold", "role").agg(
        F.count("*").alias("n_rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        (F.datediff(F.max(date), F.min(date)) / 365.25).alias("span_years"),
    )
