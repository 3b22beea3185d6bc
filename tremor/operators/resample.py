"""Bootstraps, permutation and multiplicity on sufficient statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.draws import cluster_draws, hash_unit, numbered_clusters, pick_counts, pick_units
from tremor.functions.ordered import value_ranks, with_bucket
from tremor.session import stage

MIN_ROWS = 8
MIN_DRAWS = 100
#: Cells of a packed row and (about) of a range of scores, and draws that a task makes of a range.
PACK_CELLS, RANGE_CELLS, TASK_DRAWS = 1 << 16, 1 << 21, 32


def error_terms(pairs: DataFrame, by: list[str], cluster: str) -> DataFrame:
    """Per cluster: squared and absolute error sums of model and baseline, and rows."""
    em, eb = F.col("y_pred") - F.col("y_true"), F.col("y_base") - F.col("y_true")
    return pairs.groupBy(*by, cluster).agg(
        F.sum(em * em).alias("sm"), F.sum(eb * eb).alias("sb"),
        F.sum(F.abs(em)).alias("am"), F.sum(F.abs(eb)).alias("ab"), F.count("*").alias("nr"),
    )


def _delta(metric: str, w: Column | None = None) -> Column:
    s = lambda c: F.sum(F.col(c) if w is None else w * F.col(c))
    if metric == "rmse":
        return F.sqrt(s("sb") / s("nr")) - F.sqrt(s("sm") / s("nr"))
    if metric == "mae":
        return s("ab") / s("nr") - s("am") / s("nr")
    raise ValueError("metric must be 'rmse' or 'mae'")


def paired_bootstrap(terms: DataFrame, by: list[str], cluster: str, n_boot: int, metric: str = "rmse",
                     seed: int = 42, alpha: float = 0.05, draws: DataFrame | None = None) -> DataFrame:
    """Clustered bootstrap of baseline error minus model error per group.

    Only cluster sums are resampled: the work is draws x clusters, whatever the row
    count. Fewer than MIN_ROWS rows leave the interval null.
    """
    if draws is None:
        draws = cluster_draws(terms.select(*by, cluster), by, cluster, n_boot, seed)
    keys = [c for c in draws.columns if c not in ("b", "w")]
    dist = terms.join(draws, keys).groupBy(*by, "b").agg(_delta(metric, F.col("w")).alias("_d"))
    ci = dist.groupBy(*by).agg(
        F.percentile("_d", alpha / 2).alias("_lo"), F.percentile("_d", 1 - alpha / 2).alias("_hi"),
        F.avg((F.col("_d") <= 0).cast("double")).alias("_p"),
    )
    point = terms.groupBy(*by).agg(F.sum("nr").alias("n"), F.count("*").alias("n_clusters"), _delta(metric).alias("delta"))
    ok = F.col("n") >= MIN_ROWS
    joined = point.join(ci, by) if by else point.withColumn("_k", F.lit(1)).join(ci.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return joined.select(
        *by, "n", "n_clusters", "delta", F.when(ok, F.col("_lo")).alias("ci_low"), F.when(ok, F.col("_hi")).alias("ci_high"),
        F.when(ok, F.col("_p")).alias("p_worse"), F.coalesce(ok & (F.col("_lo") > 0), F.lit(False)).alias("significant"),
    )


def metric_bootstrap(df: DataFrame, by: list[str], cluster: str, terms: dict[str, Column], metric, n_boot: int,
                     seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Interval of any metric given as additive row terms and a function of their totals.

    ``metric`` maps a lookup of total columns to a column, so the whole bootstrap is
    one aggregation over cluster sums.
    """
    per = df.groupBy(*by, cluster).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{k}") for k, c in terms.items()])
    draws = cluster_draws(per.select(*by, cluster), by, cluster, n_boot, seed)
    total = lambda w: lambda k: F.sum(F.col(f"_t_{k}") if w is None else w * F.col(f"_t_{k}"))
    dist = per.join(draws, [*by, cluster]).groupBy(*by, "b").agg(metric(total(F.col("w"))).alias("_v")).where(F.col("_v").isNotNull())
    ci = dist.groupBy(*by).agg(F.percentile("_v", alpha / 2).alias("_l"), F.percentile("_v", 1 - alpha / 2).alias("_h"))
    point = per.groupBy(*by).agg(F.sum("_n").alias("n"), metric(total(None)).alias("value"))
    ok = F.col("n") >= MIN_ROWS
    return point.join(ci, by).select(*by, "n", "value", F.when(ok, F.col("_l")).alias("ci_low"), F.when(ok, F.col("_h")).alias("ci_high"))


def holm(df: DataFrame, family: list[str], p: str, key: list[str], out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p per family; a missing p counts as 1. Families are comparisons, not rows of data."""
    x = F.coalesce(F.col(p), F.lit(1.0))
    w = W.partitionBy(*family).orderBy(x, *key)
    m = F.count("*").over(W.partitionBy(*family))
    step = df.withColumn("_a", (m - F.row_number().over(w) + 1) * x)
    return step.withColumn(out, F.least(F.lit(1.0), F.max("_a").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_a")


def diebold_mariano(pairs: DataFrame, by: list[str], h: int = 1, ord_col: str = "ord") -> DataFrame:
    """Loss-differential statistic with Newey-West lags and the small-sample factor.

    Lag products come from a self-join on the row position, so no ordered window
    spans the whole table. ``ord_col`` must be dense within each group.
    """
    d = F.pow(F.col("y_base") - F.col("y_true"), 2) - F.pow(F.col("y_pred") - F.col("y_true"), 2)
    loss = pairs.select(*by, *([ord_col] if h > 1 else []), d.alias("d"))
    base = loss.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("d_bar"), F.var_pop("d").alias("gamma0"))
    lrv = F.col("gamma0")
    if h > 1:
        a = loss.join(F.broadcast(base.select(*by, "d_bar")), by)  # one row per comparison
        ahead = a.select(*by, F.explode(F.sequence(F.lit(1), F.lit(h - 1))).alias("lag"), (F.col(ord_col) + F.col("lag")).alias("_o"),
                         (F.col("d") - F.col("d_bar")).alias("_x"))
        prod = ahead.join(a.select(*by, F.col(ord_col).alias("_o"), (F.col("d") - F.col("d_bar")).alias("_y")), [*by, "_o"])
        cov = prod.groupBy(*by, "lag").agg(F.avg(F.col("_x") * F.col("_y")).alias("_c"))
        extra = cov.groupBy(*by).agg(F.sum(2.0 * (1 - F.col("lag") / float(h)) * F.col("_c")).alias("_extra"))
        base = base.join(extra, by, "left")
        lrv = lrv + F.coalesce("_extra", F.lit(0.0))
    n = F.col("n").cast("double")
    hln = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    ok = (n >= MIN_ROWS) & (lrv > 0)
    return base.select(*by, "n", F.when(ok, hln * F.col("d_bar") / F.sqrt(lrv / n)).alias("dm_stat"), "d_bar")


def permutation_auc(df: DataFrame, by: list[str], cluster: str, key: str, y: str, score: str, n_perm: int, seed: int = 42) -> DataFrame:
    """Cluster-level label permutation with fixed predictions.

    Ranks never change, so a permuted AUC needs only each cluster's rank sum and
    size: permuting costs draws x clusters, one window per draw. A cluster's label is
    its first row's.
    """
    ranks = value_ranks(df, by, score).select(*by, score, "rank")
    cells = df.groupBy(*by, cluster, score).agg(F.count("*").alias("_c"), F.min(F.struct(key, y)).alias("_first"))
    stats = cells.join(ranks, [*by, score]).groupBy(*by, cluster).agg(
        F.sum(F.col("rank") * F.col("_c")).alias("rs"), F.sum("_c").alias("nr"), F.min("_first").alias("_first")
    ).withColumn("label", F.col(f"_first.{y}")).drop("_first")
    # a permutation gives the positive labels to the clusters that come first in a hashed order
    positives = stats.groupBy(*by).agg(F.sum("label").alias("_k"))
    order = W.partitionBy(*by, "b").orderBy(hash_unit(seed, "b", F.col(cluster).cast("string")), cluster)
    shuffled = (
        stats.join(F.broadcast(positives), by).drop("label")  # one row per model
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))))
        .withColumn("label", (F.row_number().over(order) <= F.col("_k")).cast("int"))
    )

    def auc(d, keys):
        g = d.groupBy(*keys).agg(
            F.sum(F.when(F.col("label") == 1, F.col("rs"))).alias("_r"),
            F.sum(F.when(F.col("label") == 1, F.col("nr"))).alias("_p"),
            F.sum("nr").alias("_n"),
        )
        p, q = F.col("_p").cast("double"), (F.col("_n") - F.col("_p")).cast("double")
        return g.select(*keys, F.coalesce((F.col("_r") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0.0)), F.lit(0.5)).alias("auc"))

    observed = auc(stats, by)
    drawn = auc(shuffled, [*by, "b"]).withColumnRenamed("auc", "perm")
    return drawn.join(observed, by).groupBy(*by, F.col("auc").alias("observed_auc")).agg(
        F.avg("perm").alias("perm_mean"), F.stddev_pop("perm").alias("perm_sd"), F.percentile("perm", 0.95).alias("perm_p95"),
        ((1 + F.sum((F.col("perm") >= F.col("auc")).cast("long"))) / (1 + F.count("*"))).alias("p_value"),
    )


def refit_permutation_auc(df: DataFrame, cluster: str, label: str, x: str, n_perm: int, seed: int = 42) -> DataFrame:
    """Cluster labels (0 or 1) permuted, a line of label on ``x`` refitted per draw and fold, AUC of the test rows per draw.

    ``df`` has fold, role, cluster, label and x. A line needs only the moments of each (fold, cluster) and the
    clusters that a draw makes positive; the AUC has one running sum per draw over the distinct test cells.
    """
    live = df.where(F.col(x).isNotNull())
    labels = df.select(cluster, label).distinct()
    order = W.partitionBy("b").orderBy(hash_unit(seed, "b", F.col(cluster).cast("string")), cluster)
    drawn = (
        labels.crossJoin(F.broadcast(labels.agg(F.sum(label).alias("_k")))).drop(label)  # one row
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1)))).repartition("b")
        .select("b", cluster, (F.row_number().over(order) <= F.col("_k")).cast("int").alias("_y"))
    )
    drawn = stage(drawn.unionByName(labels.select(F.lit(-1).alias("b"), cluster, F.col(label).cast("int").alias("_y"))), "refit-draws")
    train = live.where("role = 'train'")
    folds = train.groupBy("fold").agg(F.avg(x).alias("_m"), F.count("*").alias("_n"))
    centred = train.join(F.broadcast(folds), "fold").withColumn("_x", F.col(x) - F.col("_m"))  # one row per fold
    moments = centred.groupBy("fold", cluster).agg(F.count("*").alias("_c"), F.sum("_x").alias("_sx"), F.sum(F.col("_x") * F.col("_x")).alias("_sxx"))
    folds = folds.join(moments.groupBy("fold").agg(F.sum("_sxx").alias("_sxx")), "fold")
    sums = moments.select("fold", cluster, "_c", "_sx").join(drawn, cluster).groupBy("b", "fold").agg(F.sum(F.col("_y") * F.col("_sx")).alias("_sxy"), F.sum(F.col("_y") * F.col("_c")).alias("_sy"))
    slope = F.col("_sxy") / F.nullif(F.col("_sxx"), F.lit(0.0))
    lines = sums.join(F.broadcast(folds), "fold").select("b", "fold", slope.alias("_s"), (F.col("_sy") / F.col("_n") - slope * F.col("_m")).alias("_i"))
    cells = live.where("role = 'test'").groupBy("fold", cluster, x).agg(F.count("*").alias("_w"))
    scored = cells.join(drawn, cluster).join(lines, ["b", "fold"]).where("_s IS NOT NULL").select("b", "_y", "_w", (F.col("_i") + F.col("_s") * F.col(x)).alias("_prob"))
    auc = stage(weighted_auc(scored.repartition("b"), ["b"], "_y", "_prob", "_w"), "refit-auc")
    observed = auc.where("b = -1").select(F.col("auc").alias("observed_auc"))
    reached = (F.col("auc") >= F.col("observed_auc")).cast("long")
    return auc.where("b >= 0").crossJoin(F.broadcast(observed)).groupBy("observed_auc").agg(  # one row
        F.count("*").alias("n_draws"), F.avg("auc").alias("perm_mean"), ((1 + F.sum(reached)) / (1 + F.count("*"))).alias("p_value"))


def weighted_auc(df: DataFrame, by: list[str], y: str, score: str, w: str) -> DataFrame:
    """(by, auc) of rows with weights, ties half: one running sum over each group's distinct scores."""
    cells = df.groupBy(*by, score).agg(F.sum(F.when(F.col(y) == 1, F.col(w)).otherwise(0)).alias("_p"), F.sum(F.when(F.col(y) == 0, F.col(w)).otherwise(0)).alias("_q"))
    upto = W.partitionBy(*by).orderBy(score)
    below = cells.withColumn("_below", F.sum("_q").over(upto) - F.col("_q") / 2.0)
    return below.groupBy(*by).agg((F.sum(F.col("_p") * F.col("_below")) / F.nullif(F.sum("_p") * F.sum("_q") * F.lit(1.0), F.lit(0.0))).alias("auc"))


def _pack(keys: list[str]):
    """Cells of one group as one row of arrays."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {**{k: pdf[k].iloc[0] for k in keys}, "_size": pdf["_size"].iloc[0]}
        blobs = {"_nos": ("_no", "<i8"), "_scores": ("_score", "<f8"), "_ones": ("_p", "<i8"), "_zeros": ("_q", "<i8")}
        return pd.DataFrame([{**row, **{k: pdf[c].to_numpy(t).tobytes() for k, (c, t) in blobs.items()}}])

    return pack


def _draw_range(keys: list[str], seed: int, n_boot: int):
    """Sums of one range of scores under each draw of a task: positives, negatives, and pairs inside the range in order."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        part = lambda c, t: [np.frombuffer(v, t) for v in pdf[c]]
        nos, strata = part("_nos", "<i8"), pdf["_stratum"].to_numpy()
        score, ones, zeros = (np.concatenate(part(c, t)) for c, t in (("_scores", "<f8"), ("_ones", "<i8"), ("_zeros", "<i8")))
        order = np.argsort(score, kind="stable")
        score, ones, zeros = score[order], ones[order], zeros[order]
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        sizes = dict(zip(strata, pdf["_size"], strict=True))
        out = []
        for b in range(int(pdf["_draws"].iloc[0]) * TASK_DRAWS, min(n_boot, (int(pdf["_draws"].iloc[0]) + 1) * TASK_DRAWS)):
            units = pick_units(seed, b, max(sizes.values()))
            counts = {s: pick_counts(units, n) for s, n in sizes.items()}
            w = np.concatenate([counts[s][no] for s, no in zip(strata, nos, strict=True)])[order]
            p, q = np.add.reduceat(w * ones, starts), np.add.reduceat(w * zeros, starts)
            out.append((b, int(p.sum()), int(q.sum()), float(p @ (np.cumsum(q) - q / 2.0))))
        made = pd.DataFrame(out, columns=["b", "_p", "_q", "_in"])
        for k in keys:
            made[k] = pdf[k].iloc[0]
        return made[[*keys, "b", "_p", "_q", "_in"]]

    return draw


def drawn_auc(cells: DataFrame, by: list[str], within: list[str], cluster: str, score: str, n_boot: int, seed: int = 42) -> DataFrame:
    """(by, b, auc): AUC under each draw of clusters, of cells (by, within, cluster, score, _p, _q) of ones and zeros.

    Cells are numbered by cluster, cut into ranges of scores and packed; a task makes some draws of one range, so
    what is shuffled is a copy of the cells for each TASK_DRAWS draws, and a row for each draw and range comes back.
    The picks of a draw are made anew for each range. A score is never split over ranges.
    """
    keys = [*by, *within]
    numbered = numbered_clusters(cells.select(*keys, cluster).distinct(), keys, cluster)
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("_size"))
    stratum = F.concat_ws(":", *[F.col(c).cast("string") for c in within]) if within else F.lit("")
    rows = cells.join(numbered, [*keys, cluster]).join(sizes, keys) if keys else cells.join(numbered, cluster).crossJoin(F.broadcast(sizes))  # one row
    rows = rows.select(*by, stratum.alias("_stratum"), "_size", "_no", F.col(score).cast("double").alias("_score"), "_p", "_q")
    rows = stage(rows, "auc-cells")
    total = rows.count()
    ranged = with_bucket(rows, "_score", -(-total // RANGE_CELLS) if total else 1)
    ranged = ranged.withColumn("_chunk", F.pmod(F.xxhash64("_no", "_score"), F.lit(max(1, total // PACK_CELLS))))
    group = [*by, "_bucket", "_stratum"]
    types = {f.name: f.dataType.simpleString() for f in ranged.schema}
    named = lambda cs: ", ".join(f"{c} {types[c]}" for c in cs)
    packed = stage(ranged.groupBy(*group, "_chunk").applyInPandas(
        _pack([*group, "_chunk"]), f"{named([*group, '_chunk'])}, _size long, _nos binary, _scores binary, _ones binary, _zeros binary"), "auc-packed")
    tasks = -(-n_boot // TASK_DRAWS)
    spread = packed.drop("_chunk").withColumn("_draws", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    # one partition for each few groups: they are few and heavy, so hashing alone may put many into one
    drawn = spread.repartition(tasks, *by, "_bucket", "_draws").groupBy(*by, "_bucket", "_draws").applyInPandas(
        _draw_range([*by, "_bucket"], seed, n_boot), f"{named([*by, '_bucket'])}, b int, _p long, _q long, _in double")
    before = W.partitionBy(*by, "b").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = stage(drawn, "auc-ranges").withColumn("_before", F.coalesce(F.sum("_q").over(before), F.lit(0)))
    pairs = F.sum("_p") * F.sum("_q") * F.lit(1.0)
    return placed.groupBy(*by, "b").agg((F.sum(F.col("_in") + F.col("_p") * F.col("_before")) / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def auc_bootstrap(df: DataFrame, by: list[str], cluster: str, y: str, score: str, n_boot: int, within: list[str] | None = None,
                  seed: int = 42, against: float | None = None) -> DataFrame:
    """AUC with the percentile interval of cluster draws: (by, value, n_draws, ci_low, ci_high).

    With ``against`` also p_one_sided, the share of draws at or below it.

    Clusters are drawn within ``within`` (the class, for a stratified row bootstrap) as well as
    ``by``. Rows are counted per (cluster, class, score) first, so the work is draws x those cells
    however many clusters there are. Draws without both classes drop out.
    """
    live = df.where(F.col(y).isNotNull() & F.col(score).isNotNull())
    keys = [*by, *(within or [])]
    cells = live.groupBy(*dict.fromkeys([*keys, cluster, score])).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("_p"), F.sum((F.col(y) == 0).cast("long")).alias("_q"))
    cells = stage(cells, "auc-counts")
    dist = drawn_auc(cells, by, within or [], cluster, score, n_boot, seed).where(F.col("auc").isNotNull())
    point = live.select(*by, score, y, F.lit(1).alias("_c"))
    point = weighted_auc(point, by, y, score, "_c").withColumnRenamed("auc", "value")
    ok = F.col("n_draws") >= MIN_DRAWS
    ci = dist.groupBy(*by).agg(F.count("*").alias("n_draws"), F.percentile("auc", 0.025).alias("_l"), F.percentile("auc", 0.975).alias("_h"), F.avg((F.col("auc") <= F.lit(0.5 if against is None else against)).cast("double")).alias("_p"))
    below = [] if against is None else [F.when(ok, F.col("_p")).alias("p_one_sided")]
    return point.join(ci, by, "left").select(*by, "value", "n_draws", F.when(ok, F.col("_l")).alias("ci_low"), F.when(ok, F.col("_h")).alias("ci_high"), *below)


def concordance_bootstrap(conc: DataFrame, by: list[str], clusters: DataFrame, n_boot: int, seed: int = 42) -> DataFrame:
    """Percentile interval of wins / pairs under cluster weights; draws without both classes drop out."""
    draws = cluster_draws(clusters, by, "cluster", n_boot, seed)
    wi = draws.select(*by, "b", F.col("cluster").alias("ci"), F.col("w").alias("wi"))
    wj = draws.select(*by, "b", F.col("cluster").alias("cj"), F.col("w").alias("wj"))
    w = F.col("wi") * F.col("wj")
    dist = conc.join(wi, [*by, "ci"]).join(wj, [*by, "cj", "b"]).groupBy(*by, "b").agg(
        (F.sum(w * F.col("wins")) / F.nullif(F.sum(w * F.col("pairs")) * F.lit(1.0), F.lit(0.0))).alias("_s")
    ).where(F.col("_s").isNotNull())
    point = conc.groupBy(*by).agg((F.sum("wins") / F.nullif(F.sum("pairs") * F.lit(1.0), F.lit(0.0))).alias("value"))
    ok = F.col("n_draws") >= MIN_DRAWS
    ci = dist.groupBy(*by).agg(F.count("*").alias("n_draws"), F.percentile("_s", 0.025).alias("_l"), F.percentile("_s", 0.975).alias("_h"))
    return point.join(ci, by).select(*by, "value", "n_draws", F.when(ok, F.col("_l")).alias("ci_low"), F.when(ok, F.col("_h")).alias("ci_high"))
