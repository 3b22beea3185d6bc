"""Forecast metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.ordered import exact_quantiles, running_sums, value_ranks
from tremor.functions.scalars import ratio


def regression_aggs(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    e = F.col(p) - F.col(y)
    n = F.count(F.lit(1))
    return [
        n.alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / F.nullif(n * F.var_pop(y), F.lit(0.0))).alias("r2"),
    ]


def regression_metrics(oof: DataFrame, by: list[str]) -> DataFrame:
    return oof.groupBy(*by).agg(*regression_aggs())


def extended_metrics(oof: DataFrame, by: list[str]) -> DataFrame:
    """Median absolute error, directional accuracy, Pearson, Spearman, normalised RMSE."""
    e = F.col("y_pred") - F.col("y_true")
    base = oof.groupBy(*by).agg(
        F.avg((F.signum("y_true") == F.signum("y_pred")).cast("double")).alias("directional_accuracy"),
        F.corr("y_true", "y_pred").alias("pearson"),
        (F.sqrt(F.avg(e * e)) / F.nullif(F.stddev_pop("y_true"), F.lit(0.0))).alias("rmse_normalised"),
    )
    med = exact_quantiles(oof.select(*by, F.abs(e).alias("_ae")), by, "_ae", {"median_abs_error": 0.5}).drop("n_total")
    return base.join(med, by).join(spearman(oof, by, "y_true", "y_pred"), by, "left")


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Correlation of average-tie ranks, from distinct value pairs."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count("*").alias("_c"))
    flat = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ra = value_ranks(flat, by, a).select(*by, a, F.col("rank").alias("_ra"), F.col("n_total").alias("_n"))
    rb = value_ranks(flat, by, b).select(*by, b, F.col("rank").alias("_rb"))
    m = (F.col("_n") + 1) / 2.0
    x, y, c = F.col("_ra") - m, F.col("_rb") - m, F.col("_c")
    den = F.sqrt(F.sum(c * x * x)) * F.sqrt(F.sum(c * y * y))
    return pairs.join(ra, [*by, a]).join(rb, [*by, b]).groupBy(*by).agg(
        (F.sum(c * x * y) / F.nullif(den, F.lit(0.0))).alias("spearman")
    )


def classification_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "prob", cut: float = 0.5) -> DataFrame:
    """Confusion counts and the usual rates; an undefined ratio is 0."""
    hit, pos = F.col(p) >= cut, F.col(y) == 1
    count = lambda c: F.sum(c.cast("long"))
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), count(hit & pos).alias("tp"), count(hit & ~pos).alias("fp"),
        count(~hit & ~pos).alias("tn"), count(~hit & pos).alias("fn"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"),
    )
    tp, fp, tn, fn, n = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn", "n"))
    zero = F.lit(0.0)
    div = lambda a, b: F.coalesce(a / F.nullif(b, zero), zero)
    precision, recall, spec = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fp)
    majority = F.greatest(tp + fn, tn + fp) / n
    acc = (tp + tn) / n
    mcc_den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return g.select(
        *by, "n", "tp", "fp", "tn", "fn", "brier", acc.alias("accuracy"), ((recall + spec) / 2).alias("balanced_accuracy"),
        div(tp * tn - fp * fn, mcc_den).alias("mcc"), precision.alias("precision"), recall.alias("recall"), spec.alias("specificity"),
        div(2 * precision * recall, precision + recall).alias("f1"), majority.alias("majority_baseline"),
        (acc > majority).alias("beats_majority"),
    )


def score_counts(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg")
    )


def roc_auc(df: DataFrame, by: list[str], y: str = "y", score: str = "prob") -> DataFrame:
    """AUC with ties at half; null when one class is missing. Runs on distinct scores."""
    ran = running_sums(score_counts(df, by, y, score), by, score, ["pos", "neg"])
    below = F.col("neg_upto") - F.col("neg") / 2.0
    return ran.groupBy(*by).agg(
        F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"),
        (F.sum(F.col("pos") * below) / F.nullif(F.max("pos_total") * F.max("neg_total") * F.lit(1.0), F.lit(0.0))).alias("auc"),
    )


def average_precision(df: DataFrame, by: list[str], y: str = "y", score: str = "prob") -> DataFrame:
    """Sum of recall steps times precision over descending distinct thresholds."""
    ran = running_sums(score_counts(df, by, y, score), by, score, ["pos", "neg"])
    tp = F.col("pos_total") - F.col("pos_upto") + F.col("pos")
    fp = F.col("neg_total") - F.col("neg_upto") + F.col("neg")
    return ran.groupBy(*by).agg((F.sum(F.col("pos") * tp / (tp + fp)) / F.nullif(F.max("pos_total"), F.lit(0))).alias("average_precision"))


def calibration_line(df: DataFrame, by: list[str], y: str = "y", p: str = "prob", least: int = 5) -> DataFrame:
    x = F.when((F.col(p) > 0) & (F.col(p) < 1), F.log(F.col(p) / (1 - F.col(p))))
    g = df.withColumn("_x", x).where(F.col("_x").isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(F.col(y).cast("double"), F.col("_x")).alias("_s"),
        F.regr_intercept(F.col(y).cast("double"), F.col("_x")).alias("_i"),
    )
    ok = F.col("n") >= least
    return g.select(*by, F.when(ok, F.col("_s")).alias("calibration_slope"), F.when(ok, F.col("_i")).alias("calibration_intercept"))


def fold_stability(oof: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(per fold metrics with skill against zero, mean and spread across folds and best fold)."""
    per = oof.groupBy(*by, "fold").agg(
        *regression_aggs(), F.sqrt(F.avg(F.col("y_true") * F.col("y_true"))).alias("zero_rmse"),
        F.avg((F.signum("y_true") == F.signum("y_pred")).cast("double")).alias("directional_accuracy"),
    ).withColumn("skill", 1 - ratio("rmse", "zero_rmse"))
    cols = ["rmse", "mae", "r2", "skill", "directional_accuracy"]
    across = per.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_samp(c).alias(f"{c}_std") for c in cols],
        F.max_by("fold", F.struct("skill", -F.col("fold"))).alias("best_fold"),
    )
    return per, across


def spread_diagnostics(oof: DataFrame, by: list[str]) -> DataFrame:
    """Prediction over outcome spread, IQRs and a verdict on collapse."""
    base = oof.groupBy(*by).agg(F.stddev_pop("y_true").alias("sd_true"), F.stddev_pop("y_pred").alias("sd_pred"))
    q = {"lo": 0.25, "hi": 0.75}
    qt = exact_quantiles(oof, by, "y_true", q).select(*by, (F.col("hi") - F.col("lo")).alias("iqr_true"))
    qp = exact_quantiles(oof, by, "y_pred", q).select(*by, (F.col("hi") - F.col("lo")).alias("iqr_pred"))
    r = ratio("sd_pred", "sd_true")
    verdict = F.when(r < 0.3, "collapsing").when(r > 1.5, "excessive").otherwise("reasonable")
    return base.join(qt, by).join(qp, by).select("*", r.alias("spread_ratio"), verdict.alias("verdict"))


def leave_one_out(oof: DataFrame, by: list[str], key: str) -> DataFrame:
    """R2 without each row, from group totals minus the row's own terms.

    Totals are aggregated first and joined back on the group, so no window holds a
    whole group; the totals have one row per group.
    """
    tot = oof.groupBy(*by).agg(
        F.count("*").alias("_n"), F.avg("y_true").alias("_m"), F.var_pop("y_true").alias("_v"),
        F.sum(F.pow(F.col("y_pred") - F.col("y_true"), 2)).alias("_sse"),
    )
    n, d = F.col("_n").cast("double"), F.col("y_true") - F.col("_m")
    sst = n * F.col("_v")
    e2 = F.pow(F.col("y_pred") - F.col("y_true"), 2)
    full = 1 - F.col("_sse") / F.nullif(sst, F.lit(0.0))
    # removing one value from a mean shrinks the sum of squares by d^2 n / (n - 1)
    part = 1 - (F.col("_sse") - e2) / F.nullif(sst - d * d * n / (n - 1), F.lit(0.0))
    return oof.join(tot, by).select(
        *by, key, full.alias("full_r2"), part.alias("loo_r2"), (full - part).alias("influence")
    )


def conformal(oof: DataFrame, by: list[str], alpha: float = 0.2) -> DataFrame:
    """Rolling interval from prior folds' absolute residuals: half-width per fold and coverage.

    Rows fan out to the later folds (bounded by the fold count); the order statistic
    comes from running counts of distinct residuals.
    """
    folds = oof.select(*by, "fold").distinct()
    later = folds.select(*by, F.col("fold").alias("at"))
    prior = (
        oof.select(*by, F.col("fold").alias("_f"), F.abs(F.col("y_true") - F.col("y_pred")).alias("_r"))
        .join(later, by)
        .where(F.col("_f") < F.col("at"))
    )
    ran = value_ranks(prior, [*by, "at"], "_r")
    k = F.least(F.ceil((F.col("n_total") + 1) * F.lit(1 - alpha)), F.col("n_total"))
    q = ran.where(F.col("n_upto") >= k).groupBy(*by, "at").agg(F.min("_r").alias("half_width")).withColumnRenamed("at", "fold")
    inside = F.abs(F.col("y_true") - F.col("y_pred")) <= F.col("half_width")
    return oof.join(q, [*by, "fold"]).groupBy(*by, "fold").agg(
        F.count("*").alias("n"), F.sum(inside.cast("long")).alias("covered"), F.max("half_width").alias("half_width")
    )


def paired(oof: DataFrame, keys: list[str], baseline: str) -> DataFrame:
    """Each model row with the baseline's prediction for the same fold and event."""
    base = oof.where(F.col("model") == baseline).select(*keys, F.col("y_pred").alias("y_base"))
    return oof.where(F.col("model") != baseline).join(base, keys).where(F.col("y_base").isNotNull())
