"""Data diagnostics: correlation, redundancy, stationarity, missingness, shape."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.ordered import exact_quantiles, with_bucket
from tremor.operators.metrics import spearman

# Redundancy threshold, outlier rules, 5 % critical values.
REDUNDANT = 0.95
IQR_K = 1.5
MAD_Z = 3.5
MAD_SCALE = 0.6745
ADF_CRITICAL = -2.86
KPSS_CRITICAL = 0.463


def pearson_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, rho) for every column pair, pairwise complete, in one scan."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("_p")).select("_p.a", "_p.b", "_p.rho")


def spearman_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, n, rho) by ranks among the rows where both are present."""
    pairs = list(combinations(cols, 2))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    structs = F.array(*[
        F.when(both(a, b), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")))
        for a, b in pairs
    ])
    long = df.select(F.explode(structs).alias("_p")).where("_p IS NOT NULL").select("_p.*")
    n = long.groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.join(spearman(long, ["a", "b"], "x", "y"), ["a", "b"]).withColumnRenamed("spearman", "rho")


def vector_pearson(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, rho) of the coordinates of a complete array column.

    The moments are one tree aggregation; only the size x size result reaches the driver.
    """
    m = Correlation.corr(df.select(array_to_vector(vector).alias("_v")), "_v").first()[0].toArray()
    rows = [(i, j, float(m[i, j])) for i in range(len(m)) for j in range(i + 1, len(m))]
    return df.sparkSession.createDataFrame(rows, "i int, j int, rho double")


def correlation_matrix(pairs: DataFrame, cols: list[str]) -> np.ndarray:
    """Small p x p matrix from the pair table; p is the feature count."""
    at = {c: i for i, c in enumerate(cols)}
    m = np.eye(len(cols))
    for row in pairs.collect():
        m[at[row.a], at[row.b]] = m[at[row.b], at[row.a]] = row.rho
    return m


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation from the inverse correlation matrix; singular gives infinity."""
    m = correlation_matrix(pearson_pairs(df, cols), cols)
    try:
        diag = np.diag(np.linalg.inv(m))
    except np.linalg.LinAlgError:
        diag = np.full(len(cols), np.inf)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, diag)], "feature string, vif double")


def condition_indices(df: DataFrame, cols: list[str]) -> DataFrame:
    m = correlation_matrix(pearson_pairs(df, cols), cols)
    eig = np.clip(np.linalg.eigvalsh(m), np.finfo(float).tiny, None)[::-1]
    rows = [(i, float(np.sqrt(eig[0] / e))) for i, e in enumerate(eig)]
    return df.sparkSession.createDataFrame(rows, "position int, condition_index double")


def redundant_features(pairs: DataFrame, spec: DataFrame, threshold: float = REDUNDANT) -> DataFrame:
    """(dropped, kept): components of strongly correlated features, least derived one kept.

    Labels spread over the edge table until they settle; it has one row per feature
    pair, so a pass is a tiny job and the pass count is at most the feature count.
    """
    edges = pairs.where(F.abs("rho") >= threshold).select("a", "b")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).collect()
    label = {r.a: r.a for r in both}
    changed = True
    while changed:
        changed = False
        for r in both:
            low = min(label[r.a], label[r.b])
            if label[r.a] != low or label[r.b] != low:
                label[r.a] = label[r.b] = low
                changed = True
    spark = pairs.sparkSession
    if not label:
        return spark.createDataFrame([], "dropped string, kept string")
    comp = spark.createDataFrame(list(label.items()), "feature string, component string").join(spec.select("feature", "depth"), "feature")
    kept = comp.groupBy("component").agg(F.min_by("feature", F.struct("depth", "feature")).alias("kept"))
    return comp.join(kept, "component").where("feature <> kept").select(F.col("feature").alias("dropped"), "kept")


def adf_statistic(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """t of the lagged level in  dy = a + b y[-1] + c dy[-1], per group, from grouped moments."""
    w = W.partitionBy(*by).orderBy(order)
    y1 = F.lag(value).over(w)
    rows = df.select(*by, (F.col(value) - y1).alias("dy"), y1.alias("u"), (y1 - F.lag(value, 2).over(w)).alias("v")).where(
        "dy IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL")
    g = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.var_pop("u").alias("suu"), F.var_pop("v").alias("svv"), F.var_pop("dy").alias("syy"),
        F.covar_pop("u", "v").alias("suv"), F.covar_pop("u", "dy").alias("suy"), F.covar_pop("v", "dy").alias("svy"))
    det = F.col("suu") * F.col("svv") - F.col("suv") * F.col("suv")
    b = (F.col("svv") * F.col("suy") - F.col("suv") * F.col("svy")) / det
    c = (F.col("suu") * F.col("svy") - F.col("suv") * F.col("suy")) / det
    rss = F.col("syy") - b * F.col("suy") - c * F.col("svy")  # per row
    se = F.sqrt(rss / (F.col("n") - 3) * F.col("svv") / det)
    return g.where((det > 0) & (F.col("n") > 3)).select(*by, "n", (b / se).alias("adf_t"))


def kpss_statistic(df: DataFrame, by: list[str], order: str, value: str, lags: int = 4) -> DataFrame:
    """Level stationarity: scaled squared partial sums over a Newey-West variance."""
    w = W.partitionBy(*by).orderBy(order)
    clean = df.where(F.col(value).isNotNull())
    e = clean.withColumn("_e", F.col(value) - F.avg(value).over(W.partitionBy(*by)))
    rows = e.select(
        *by, "_e", F.sum("_e").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_s"),
        *[F.lag("_e", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    n = F.count("*").cast("double")
    lrv = F.sum(F.col("_e") * F.col("_e")) / n
    for k in range(1, lags + 1):
        lrv = lrv + 2.0 * (1 - k / (lags + 1.0)) * F.sum(F.col("_e") * F.col(f"_l{k}")) / n
    return rows.groupBy(*by).agg((F.sum(F.col("_s") * F.col("_s")) / (n * n) / F.nullif(lrv, F.lit(0.0))).alias("kpss"))


def stationarity(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    a, k = adf_statistic(df, by, order, value), kpss_statistic(df, by, order, value)
    verdict = (F.col("adf_t") < ADF_CRITICAL) & (F.col("kpss") < KPSS_CRITICAL)
    return a.join(k, by).withColumn("stationary", verdict)


def missingness(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, n, n_missing, share) in one scan."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("_n").alias("n"), (F.col("_n") - F.col(f"_c{i}")).alias("n_missing")) for i, c in enumerate(cols)])
    return one.select(F.explode(rows).alias("_x")).select("_x.*").withColumn("share_missing", F.col("n_missing") / F.col("n"))


def value_states(df: DataFrame, key: str, rules: dict[str, Column | None]) -> DataFrame:
    """Counts per (feature, state): observed, zero_filled when its rule holds, missing."""
    cells = [
        F.struct(F.lit(c).alias("feature"),
                 F.when(F.coalesce(rule, F.lit(False)) if rule is not None else F.lit(False), "zero_filled")
                 .when(F.col(c).isNull(), "missing").otherwise("observed").alias("state"))
        for c, rule in rules.items()
    ]
    return df.select(F.explode(F.array(*cells)).alias("_x")).groupBy("_x.feature", "_x.state").agg(F.count("*").alias("n"))


def outliers(df: DataFrame, by: list[str], value: str, iqr_k: float = IQR_K, mad_z: float = MAD_Z) -> DataFrame:
    """Quartile fences and robust z counts per group, with exact quantiles."""
    q = exact_quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    j = df.where(F.col(value).isNotNull()).join(q, by)
    mad = exact_quantiles(j.select(*by, F.abs(F.col(value) - F.col("median")).alias("_d")), by, "_d", {"mad": 0.5}).drop("n_total")
    lo = F.col("q1") - iqr_k * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + iqr_k * (F.col("q3") - F.col("q1"))
    z = MAD_SCALE * F.abs(F.col(value) - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0))
    return j.join(mad, by).groupBy(*by, "q1", "median", "q3", "mad").agg(
        F.count("*").alias("n"), F.max(lo).alias("iqr_low"), F.max(hi).alias("iqr_high"),
        F.sum(((F.col(value) < lo) | (F.col(value) > hi)).cast("long")).alias("n_iqr"), F.sum(F.coalesce(z > mad_z, F.lit(False)).cast("long")).alias("n_mad"))


def shape(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                               F.skewness(value).alias("skew"), F.kurtosis(value).alias("excess_kurtosis"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    b = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    return df.where(F.col(value).isNotNull()).groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def ecdf(df: DataFrame, by: list[str], value: str) -> DataFrame:
    from tremor.functions.ordered import value_ranks

    return value_ranks(df, by, value).select(*by, value, (F.col("n_upto") / F.col("n_total")).alias("ecdf"))


def coverage_by(df: DataFrame, cols: list[str], dims: list[str]) -> DataFrame:
    """Observed share per column: overall, per first dimension and per second, in one grouping-sets pass."""
    long = df.select(*dims, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).isNotNull().cast("double").alias("seen")) for c in cols])).alias("_x")).select(*dims, "_x.*")
    cells = long.groupBy("variable", *dims).agg(F.sum("seen").alias("_s"), F.count("*").alias("_n"))
    sets = [[F.col("variable")], *[[F.col("variable"), F.col(d)] for d in dims]]
    return cells.groupingSets(sets, F.col("variable"), *[F.col(d) for d in dims]).agg(
        (F.sum("_s") / F.sum("_n")).alias("coverage"), F.sum("_n").alias("n"))
