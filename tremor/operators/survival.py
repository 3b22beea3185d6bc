"""Survival estimation and scoring with censoring and a competing event.

Durations are whole sessions inside a fixed cap, so every curve is a small table
keyed by (group, duration) and rows are collapsed to it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.ordered import exact_quantiles, running_sums

# Probability times and the duration cap, in sessions.
PROB_TIMES = (10, 20, 30, 60, 90)
CAP = 90
#: Decimals to which scores tie in the concordance.
TIED = 9
FLOOR_MEAN = 1e-3  # weight floor of the mean-of-times score
FLOOR_TRAPEZOID = 1e-9  # weight floor of the trapezoid score

RECOVERY, COMPETING, CENSORED = 1, 2, 0


def risk_code(reason: str = "reason") -> Column:
    """1 recovered, 2 overtaken by the next event, 0 otherwise censored."""
    return F.when(F.col(reason) == "recovered", RECOVERY).when(F.col(reason) == "next_disaster", COMPETING).otherwise(CENSORED)


def _part(by):
    return W.partitionBy(*by) if by else W.partitionBy(F.lit("all"))


def risk_table(df: DataFrame, by: list[str], t: str, events: dict[str, Column]) -> DataFrame:
    """(by, t, counts, at_risk): one row per distinct duration."""
    counts = df.groupBy(*by, F.col(t).alias("t")).agg(
        F.count("*").alias("n_rows"), *[F.sum(c.cast("long")).alias(n) for n, c in events.items()]
    )
    later = _part(by).orderBy(F.col("t").desc()).rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("at_risk", F.sum("n_rows").over(later))


def km_curve(df: DataFrame, by: list[str], t: str = "duration", event: Column | str = "event_observed") -> DataFrame:
    """Kaplan-Meier with Greenwood's sum: (by, t, at_risk, d, surv, gw)."""
    e = F.col(event) == 1 if isinstance(event, str) else event
    risk = risk_table(df, by, t, {"d": e})
    upto = _part(by).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    n, d = F.col("at_risk").cast("double"), F.col("d").cast("double")
    gone = F.max((F.col("d") == F.col("at_risk")).cast("int")).over(upto) == 1
    log_s = F.sum(F.when(d < n, F.log(1 - d / n))).over(upto)
    return risk.select(
        *by, "t", "n_rows", "at_risk", "d",
        F.when(gone, F.lit(0.0)).otherwise(F.exp(F.coalesce(log_s, F.lit(0.0)))).alias("surv"),
        F.coalesce(F.sum(F.when(d < n, d / (n * (n - d)))).over(upto), F.lit(0.0)).alias("gw"),
    )


def at_times(curve: DataFrame, by: list[str], times, values: dict[str, float], t: str = "t") -> DataFrame:
    """Step lookup: last curve row at or before each time; before the first row the default."""
    grid = F.explode(F.array(*[F.lit(float(x)) for x in times]))
    hit = F.col(t) <= F.col("horizon")
    return curve.withColumn("horizon", grid).groupBy(*by, "horizon").agg(
        *[
            F.coalesce(F.max_by(F.when(hit, F.col(v)), F.when(hit, F.col(t))), F.lit(default)).alias(v)
            for v, default in values.items()
        ]
    )


def plain_interval(s: Column, gw: Column, z: float = 1.96) -> tuple[Column, Column]:
    half = z * s * F.sqrt(gw)
    return F.greatest(s - half, F.lit(0.0)), F.least(s + half, F.lit(1.0))


def loglog_interval(s: Column, gw: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    inner = (s > 0) & (s < 1)
    width = z * F.sqrt(gw) / F.abs(F.log(s))
    a, b = F.pow(s, F.exp(width)), F.pow(s, F.exp(-width))
    return F.when(inner, F.least(a, b)).otherwise(s), F.when(inner, F.greatest(a, b)).otherwise(s)


def incidence_curve(df: DataFrame, by: list[str], t: str, code: Column) -> DataFrame:
    """Aalen-Johansen cumulative incidence of recovery: (by, t, cif)."""
    risk = risk_table(df, by, t, {"d1": code == RECOVERY, "d2": code == COMPETING})
    part = _part(by).orderBy("t")
    n = F.col("at_risk").cast("double")
    both = (F.col("d1") + F.col("d2")).cast("double")
    before = part.rowsBetween(W.unboundedPreceding, -1)
    gone = F.coalesce(F.max((both >= n).cast("int")).over(before), F.lit(0)) == 1
    s_prev = F.when(gone, F.lit(0.0)).otherwise(
        F.exp(F.coalesce(F.sum(F.when(both < n, F.log(1 - both / n))).over(before), F.lit(0.0)))
    )
    step = risk.withColumn("_inc", s_prev * F.col("d1") / n)
    return step.select(*by, "t", F.sum("_inc").over(part.rowsBetween(W.unboundedPreceding, 0)).alias("cif"))


def median_time(curve: DataFrame, by: list[str], cap: float = CAP) -> DataFrame:
    """First time with survival at or below one half, else the cap."""
    return curve.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("surv") <= 0.5, F.col("t"))), F.lit(float(cap))).alias("median"))


def concordance_by_time(df: DataFrame, by: list[str], t: str, event: str, score: str, censored_ties: bool) -> DataFrame:
    """(by, d, wins, pairs): event rows at duration d against rows that outlast d.

    A row that lasted D outlasts every earlier d, so each distinct (score, D) cell is
    counted at d < D (at most the cap); pairs are then counted by running sums over
    the score inside each d. With ``censored_ties`` a row censored at d outlasts it.
    """
    cells = df.where(F.col(score).isNotNull() & F.col(t).isNotNull()).groupBy(*by, F.col(t).cast("int").alias("_D"), score).agg(
        F.sum((F.col(event) == 1).cast("long")).alias("_e"), F.sum((F.col(event) == 0).cast("long")).alias("_c")
    )
    times = cells.where("_e > 0").select(*by, F.col("_D").alias("d")).distinct()
    outlast = cells.where("_D > 0").select(
        *by, F.explode(F.sequence(F.lit(0), F.col("_D") - 1)).alias("d"), score, F.lit(0).cast("long").alias("ev"), (F.col("_e") + F.col("_c")).alias("lo")
    )
    own = cells.select(*by, F.col("_D").alias("d"), score, F.col("_e").alias("ev"), (F.col("_c") if censored_ties else F.lit(0).cast("long")).alias("lo"))
    rows = outlast.unionByName(own).join(times, [*by, "d"], "left_semi").groupBy(*by, "d", score).agg(F.sum("ev").alias("ev"), F.sum("lo").alias("lo"))
    ran = running_sums(rows, [*by, "d"], score, ["lo"])
    above = F.col("lo_total") - F.col("lo_upto") + F.col("lo") / 2.0
    return ran.groupBy(*by, "d").agg(F.sum(F.col("ev") * above).alias("wins"), F.sum(F.col("ev") * F.col("lo_total")).alias("pairs"))


def tied_scores(df: DataFrame, score: str) -> DataFrame:
    """Scores to TIED decimals: sums made in another order differ in their last bits, which must not break a tie."""
    return df.withColumn(score, F.round(F.col(score).cast("double"), TIED))


def harrell_c(df: DataFrame, by: list[str], t: str, event: str, score: str) -> DataFrame:
    """C for a time-like score, ties (to TIED decimals) half; null below 2 distinct scores or 2 events."""
    df = tied_scores(df, score)
    g = concordance_by_time(df, by, t, event, score, True).groupBy(*by).agg(F.sum("wins").alias("_w"), F.sum("pairs").alias("_p"))
    guard = df.groupBy(*by).agg(
        F.sum((F.col(event) == 1).cast("long")).alias("n_events"), F.count("*").alias("n"), (F.min(score) < F.max(score)).alias("_varied")
    )
    ok = F.col("_varied") & (F.col("n_events") >= 2)
    return guard.join(g, by, "left").select(*by, "n", "n_events", F.when(ok, F.col("_w") / F.nullif(F.col("_p") * 1.0, F.lit(0.0))).alias("c_index"))


def censoring_curve(df: DataFrame, by: list[str], t: str, event: str) -> DataFrame:
    """G(t): Kaplan-Meier of the censoring time."""
    return km_curve(df, by, t, F.col(event) == 0).select(*by, "t", F.col("surv").alias("cens_surv"))


def uno_c(df: DataFrame, by: list[str], t: str, event: str, score: str) -> DataFrame:
    """C weighted by the squared inverse censoring survival at the event time."""
    per = concordance_by_time(df, by, t, event, score, False)
    g = censoring_curve(df, by, t, event).withColumn("d", F.col("t").cast("int")).drop("t")
    w = F.pow(1.0 / F.greatest(F.col("cens_surv"), F.lit(FLOOR_TRAPEZOID)), 2)
    return per.join(g, [*by, "d"]).groupBy(*by).agg(
        (F.sum(w * F.col("wins")) / F.nullif(F.sum(w * F.col("pairs")), F.lit(0.0))).alias("uno_c")
    )


def brier_by_time(df: DataFrame, by: list[str], t: str, event: str, probs: dict[int, str], floor: float) -> DataFrame:
    """Censoring-weighted Brier score of P(T <= time) per (by, time)."""
    g = censoring_curve(df, by, t, event)
    g_at = at_times(g, by, probs.keys(), {"cens_surv": 1.0}).withColumnRenamed("cens_surv", "g_at")
    own = g.select(*by, F.col("t").alias(t), F.col("cens_surv").alias("_g"))  # at most the cap's rows per group
    long = df.select(
        *by, t, event,
        F.explode(F.array(*[F.struct(F.lit(float(k)).alias("horizon"), F.col(c).alias("p")) for k, c in probs.items()])).alias("_x"),
    ).select(*by, t, event, "_x.horizon", "_x.p")
    j = long.join(own, [*by, t]).join(g_at, [*by, "horizon"])
    hit = (F.col(event) == 1) & (F.col(t) <= F.col("horizon"))
    risk = F.col(t) > F.col("horizon")
    low = F.lit(floor)
    w = F.when(hit, 1.0 / F.greatest(F.col("_g"), low)).when(risk, 1.0 / F.greatest(F.col("g_at"), low)).otherwise(F.lit(0.0))
    target = hit.cast("double")
    return j.groupBy(*by, "horizon").agg(F.avg(w * F.pow(F.col("p") - target, 2)).alias("brier"))


def brier_mean(brier: DataFrame, by: list[str]) -> DataFrame:
    return brier.groupBy(*by).agg(F.avg("brier").alias("ibs_mean"))


def brier_trapezoid(brier: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoid over the score times, divided by their span."""
    w = W.partitionBy(*by).orderBy("horizon")
    area = brier.withColumn("_a", (F.col("horizon") - F.lag("horizon").over(w)) * (F.col("brier") + F.lag("brier").over(w)) / 2)
    return area.groupBy(*by).agg((F.sum("_a") / (F.max("horizon") - F.min("horizon") + 1e-9)).alias("ibs_trapezoid"))


def calibration(df: DataFrame, by: list[str], t: str, event: str, probs: dict[int, str]) -> DataFrame:
    """Mean predicted against observed P(T <= time), with log-log Greenwood bounds."""
    pred = df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in probs.values()])
    long = pred.select(*by, F.explode(F.array(*[F.struct(F.lit(float(k)).alias("horizon"), F.col(c).alias("predicted")) for k, c in probs.items()])).alias("_x")).select(*by, "_x.*")
    obs = at_times(km_curve(df, by, t, event), by, probs.keys(), {"surv": 1.0, "gw": 0.0})
    lo, hi = loglog_interval(F.col("surv"), F.col("gw"))
    return long.join(obs, [*by, "horizon"]).select(
        *by, "horizon", "predicted", (1 - F.col("surv")).alias("observed"), (F.col("predicted") - (1 - F.col("surv"))).alias("gap"),
        (1 - hi).alias("ci_low"), (1 - lo).alias("ci_high"),
    )


def point_errors(df: DataFrame, by: list[str], t: str, event: str, pred: str) -> DataFrame:
    """Errors over observed recoveries only."""
    seen = df.where(F.col(event) == 1).withColumn("_ae", F.abs(F.col(pred) - F.col(t)))
    med = exact_quantiles(seen, by, "_ae", {"median_abs_error": 0.5}).drop("n_total")
    return seen.groupBy(*by).agg(
        F.count("*").alias("n_uncensored"), F.avg("_ae").alias("mae"), F.sqrt(F.avg(F.col("_ae") * F.col("_ae"))).alias("rmse")
    ).join(med, by)


def tercile_calibration(df: DataFrame, by: list[str], actual: str, pred: str) -> DataFrame:
    """Mean actual and predicted per third of the predictions."""
    cuts = exact_quantiles(df, by, pred, {"_q1": 1 / 3, "_q2": 2 / 3}).drop("n_total")
    j = df.join(cuts, by)
    bucket = F.when(F.col(pred) <= F.col("_q1"), "low").when(F.col(pred) <= F.col("_q2"), "mid").otherwise("high")
    return j.groupBy(*by, bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(actual).alias("actual"), F.avg(pred).alias("predicted"))


def cluster_concordance(df: DataFrame, by: list[str], cluster: str, clusters: list[str], t: str, event: str, score: str) -> DataFrame:
    """(by, ci, cj, wins, pairs): concordance of ci's event rows with cj's rows, per cluster pair.

    The same per-duration running sums as the pooled index, with one count column
    per cluster of the bounded list. Scores tie to TIED decimals.
    """
    idx = range(len(clusters))
    live = tied_scores(df, score).where(F.col(score).isNotNull() & F.col(t).isNotNull())
    cells = live.groupBy(*by, F.col(t).cast("int").alias("_D"), score, cluster).agg(
        F.sum((F.col(event) == 1).cast("long")).alias("_e"), F.sum((F.col(event) == 0).cast("long")).alias("_c"))
    times = cells.where("_e > 0").select(*by, F.col("_D").alias("d")).distinct()
    outlast = cells.where("_D > 0").select(*by, F.explode(F.sequence(F.lit(0), F.col("_D") - 1)).alias("d"), score, cluster, (F.col("_e") + F.col("_c")).alias("lo"))
    own = cells.select(*by, F.col("_D").alias("d"), score, cluster, F.col("_c").alias("lo"))
    wide = outlast.unionByName(own).join(times, [*by, "d"], "left_semi").groupBy(*by, "d", score).agg(
        *[F.sum(F.when(F.col(cluster) == c, F.col("lo")).otherwise(0)).alias(f"g{i}") for i, c in enumerate(clusters)])
    ran = running_sums(wide, [*by, "d"], score, [f"g{i}" for i in idx])
    above = F.array(*[
        F.struct(F.lit(c).alias("cj"), (F.col(f"g{i}_total") - F.col(f"g{i}_upto") + F.col(f"g{i}") / 2.0).alias("a"), F.col(f"g{i}_total").alias("t"))
        for i, c in enumerate(clusters)])
    # every (d, score) with an event also has a row here: own cells are part of the union
    ev = cells.where("_e > 0").select(*by, F.col("_D").alias("d"), score, F.col(cluster).alias("ci"), F.col("_e").alias("ne"))
    return (
        ev.join(ran.select(*by, "d", score, above.alias("_a")), [*by, "d", score])
        .select(*by, "ci", "ne", F.explode("_a").alias("_s"))
        .groupBy(*by, "ci", F.col("_s.cj").alias("cj"))
        .agg(F.sum(F.col("ne") * F.col("_s.a")).alias("wins"), F.sum(F.col("ne") * F.col("_s.t")).alias("pairs"))
    )
