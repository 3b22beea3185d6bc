"""Recovery durations: curves, incidence, concordance, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions import scalars as sc
from tremor.functions.scalars import rnd
from tremor.operators import folds as fd
from tremor.operators import metrics as mt
from tremor.operators import resample as rs
from tremor.operators import survival as sv
from tremor.plans.forecast_queries import NB, SQL_MEM, _draw_sql, members
from tremor.plans.outcome_queries import SQL_OUT, outcomes
from tremor.plans.registry import ctes, query, r
from tremor.session import staged_once

PROBS = {k: f"p_{k}" for k in sv.PROB_TIMES}


def durations(spark, sf_dir):
    return outcomes(spark, sf_dir).where("duration IS NOT NULL").select(
        "event_id", "series_id", "type", "event_date", "duration", "event_observed", "drawdown", "reason")


def predictions(spark, sf_dir):
    """Held-out survival predictions: train curve, its median step, and a one-feature line."""

    def build():
        m = fd.purge(members(spark, sf_dir).where("duration IS NOT NULL"), "event_date", "y3_end")
        m = fd.median_imputed(m, ["x1"])
        train, test = m.where("role = 'train'"), m.where("role = 'test'")
        curve = sv.km_curve(train, ["fold"])
        steps = sv.at_times(curve, ["fold"], sv.PROB_TIMES, {"surv": 1.0}).groupBy("fold").pivot("horizon", [float(k) for k in sv.PROB_TIMES]).agg(F.first("surv"))
        steps = steps.select("fold", *[(1 - F.col(f"`{float(k)}`")).alias(f"p_{k}") for k in sv.PROB_TIMES])
        med = sv.median_time(curve, ["fold"])
        line = train.groupBy("fold").agg(F.regr_slope("duration", "x1").alias("_b"), F.regr_intercept("duration", "x1").alias("_a"))
        per_fold = steps.join(med, "fold").join(line, "fold")  # one row per fold
        t = test.join(F.broadcast(per_fold), "fold").withColumn("_l", sc.clip(F.col("_a") + F.col("_b") * F.col("x1"), 0.0, 90.0))
        km = F.struct(F.lit("km_train").alias("model"), F.col("median").alias("pred_median"), *[F.col(c).alias(c) for c in PROBS.values()])
        step = F.struct(F.lit("median_step").alias("model"), F.col("median").alias("pred_median"), *[(F.col("median") <= float(k)).cast("double").alias(c) for k, c in PROBS.items()])
        lin = F.struct(F.lit("line").alias("model"), F.col("_l").alias("pred_median"), *[(1 / (1 + F.exp((F.col("_l") - float(k)) / 20))).alias(c) for k, c in PROBS.items()])
        return t.withColumn("_m", F.explode(F.array(km, step, lin))).select(
            "fold", "event_id", "series_id", "event_date", "duration", "event_observed", "drawdown", "reason", "_m.*")

    return staged_once(spark, sf_dir, "survival_predictions", build)


SQL_KM = """
rt AS (SELECT duration AS t, count(*) AS n, sum(event_observed) AS d FROM outc GROUP BY 1),
ar AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS risk FROM rt),
km AS (SELECT t, risk, d, CASE WHEN max((d = risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < risk THEN ln(1 - d / risk::DOUBLE) END) OVER w) END AS s,
 coalesce(sum(CASE WHEN d < risk THEN d / (risk::DOUBLE * (risk - d)) END) OVER w, 0) AS gw FROM ar WINDOW w AS (ORDER BY t))"""


@query("d01_kaplan_meier", ctes(SQL_OUT, SQL_KM) + f"""
SELECT t, risk::BIGINT AS at_risk, d::BIGINT AS d, {r("s", name="surv")} FROM km""")
def d01_kaplan_meier(spark, sf_dir):
    return sv.km_curve(durations(spark, sf_dir), []).select("t", "at_risk", "d", rnd("surv").alias("surv"))


SQL_AT = """
ts AS (SELECT unnest([10.0, 20.0, 30.0, 60.0, 90.0])::DOUBLE AS horizon)"""


@query("d02_greenwood_intervals", ctes(SQL_OUT, SQL_KM, SQL_AT, """
k AS (SELECT horizon, max_by(s, t) AS s, max_by(gw, t) AS gw FROM ts JOIN km ON t <= horizon GROUP BY 1)""") + f"""
SELECT horizon, {r("s", name="surv")}, {r("greatest(s - 1.96 * s * sqrt(gw), 0)", name="plain_low")}, {r("least(s + 1.96 * s * sqrt(gw), 1)", name="plain_high")},
 {r("s ** exp(1.959963984540054 * sqrt(gw) / abs(ln(s)))", name="loglog_low")}, {r("s ** exp(-1.959963984540054 * sqrt(gw) / abs(ln(s)))", name="loglog_high")} FROM k""")
def d02_greenwood_intervals(spark, sf_dir):
    k = sv.at_times(sv.km_curve(durations(spark, sf_dir), []), [], sv.PROB_TIMES, {"surv": 1.0, "gw": 0.0})
    a, b = sv.plain_interval(F.col("surv"), F.col("gw"))
    c, d = sv.loglog_interval(F.col("surv"), F.col("gw"))
    return k.select("horizon", rnd("surv").alias("surv"), rnd(a).alias("plain_low"), rnd(b).alias("plain_high"), rnd(c).alias("loglog_low"), rnd(d).alias("loglog_high"))


@query("d03_cumulative_incidence", ctes(SQL_OUT, """
rt AS (SELECT duration AS t, count(*) AS n, sum((reason = 'recovered')::INT) AS d1, sum((reason = 'next_disaster')::INT) AS d2 FROM outc GROUP BY 1),
ar AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS risk FROM rt),
sp AS (SELECT *, coalesce(CASE WHEN max((d1 + d2 >= risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d1 + d2 < risk THEN ln(1 - (d1 + d2) / risk::DOUBLE) END) OVER w) END, 1) AS s0
 FROM ar WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""") + f"""
SELECT t, {r("sum(s0 * d1 / risk::DOUBLE) OVER (ORDER BY t)", name="cif")} FROM sp""")
def d03_cumulative_incidence(spark, sf_dir):
    return sv.incidence_curve(durations(spark, sf_dir), [], "duration", sv.risk_code()).select("t", rnd("cif").alias("cif"))


SQL_SURV = f"""{SQL_MEM},
sl AS (SELECT m.*, s.date AS y3_end FROM mem m JOIN sess s ON s.series_id = m.series_id AND s.session_idx = least(m.session_idx + greatest(CAST(m.duration AS BIGINT) - 1, 0), m.last_idx)),
sf AS (SELECT fold, min(event_date) AS ftd FROM sl WHERE role = 'test' GROUP BY 1),
sp AS (SELECT sl.* FROM sl JOIN sf USING (fold) WHERE role = 'test' OR y3_end < ftd),
smd AS (SELECT fold, coalesce(median(x1), 0) AS med FROM sp WHERE role = 'train' GROUP BY 1),
si AS (SELECT sp.*, coalesce(x1, med) AS xi FROM sp JOIN smd USING (fold)),
srt AS (SELECT fold, duration AS t, count(*) AS n, sum(event_observed) AS d FROM si WHERE role = 'train' GROUP BY 1, 2),
sar AS (SELECT *, sum(n) OVER (PARTITION BY fold ORDER BY t DESC) AS risk FROM srt),
skm AS (SELECT fold, t, CASE WHEN max((d = risk)::INT) OVER w = 1 THEN 0 ELSE exp(coalesce(sum(CASE WHEN d < risk THEN ln(1 - d / risk::DOUBLE) END) OVER w, 0)) END AS s FROM sar WINDOW w AS (PARTITION BY fold ORDER BY t)),
sfold AS (SELECT fold, {", ".join(f"1 - coalesce(max_by(s, t) FILTER (t <= {k}), 1) AS k_{k}" for k in sv.PROB_TIMES)}, coalesce(min(t) FILTER (s <= 0.5), 90) AS med FROM skm GROUP BY 1),
sln AS (SELECT fold, regr_slope(duration, xi) AS b, regr_intercept(duration, xi) AS a FROM si WHERE role = 'train' GROUP BY 1),
sw AS (SELECT si.fold, event_id, series_id, event_date, duration, event_observed, drawdown, reason, sfold.* EXCLUDE (fold, med), sfold.med, greatest(least(a + b * xi, 90), 0) AS l
  FROM si JOIN sfold USING (fold) JOIN sln USING (fold) WHERE role = 'test'),
surv AS (
  SELECT fold, event_id, series_id, event_date, duration, event_observed, drawdown, reason, 'km_train' AS model, med AS pred_median, {", ".join(f"k_{k} AS p_{k}" for k in sv.PROB_TIMES)} FROM sw
  UNION ALL SELECT fold, event_id, series_id, event_date, duration, event_observed, drawdown, reason, 'median_step', med, {", ".join(f"(med <= {k})::INT::DOUBLE" for k in sv.PROB_TIMES)} FROM sw
  UNION ALL SELECT fold, event_id, series_id, event_date, duration, event_observed, drawdown, reason, 'line', l, {", ".join(f"1 / (1 + exp((l - {k}) / 20))" for k in sv.PROB_TIMES)} FROM sw)"""


@query("d04_d13_survival_baselines", ctes(SQL_SURV) + f"""
SELECT fold, event_id, model, duration, event_observed, {r("pred_median", name="pred_median")}, {", ".join(r(f"p_{k}", name=f"p_{k}") for k in sv.PROB_TIMES)} FROM surv""")
def d04_d13_survival_baselines(spark, sf_dir):
    return predictions(spark, sf_dir).select("fold", "event_id", "model", "duration", "event_observed", rnd("pred_median").alias("pred_median"),
                                             *[rnd(c).alias(c) for c in PROBS.values()])


SQL_HC = """
su AS (SELECT * REPLACE (round(pred_median, 9) AS pred_median) FROM surv),
hc AS (SELECT a.model, a.series_id AS ci, b.series_id AS cj, sum(CASE WHEN b.pred_median > a.pred_median THEN 1 WHEN b.pred_median = a.pred_median THEN 0.5 ELSE 0 END) AS wins, count(*)::DOUBLE AS pairs
 FROM su a JOIN su b ON a.model = b.model AND a.event_observed = 1 AND (b.duration > a.duration OR (b.duration = a.duration AND b.event_observed = 0)) GROUP BY 1, 2, 3)"""


@query("d05_j20_harrell_c", ctes(SQL_SURV, SQL_HC) + f"""
SELECT model, (SELECT count(*) FROM surv s WHERE s.model = hc.model) AS n, (SELECT sum(event_observed) FROM surv s WHERE s.model = hc.model)::BIGINT AS n_events,
 {r("CASE WHEN (SELECT min(pred_median) < max(pred_median) FROM su s WHERE s.model = hc.model) THEN sum(wins) / sum(pairs) END", name="c_index")} FROM hc GROUP BY model""")
def d05_j20_harrell_c(spark, sf_dir):
    t = sv.harrell_c(predictions(spark, sf_dir), ["model"], "duration", "event_observed", "pred_median")
    return t.select("model", "n", "n_events", rnd("c_index").alias("c_index"))


SQL_G = """
gr AS (SELECT model, duration AS t, count(*) AS n, sum(1 - event_observed) AS d FROM surv GROUP BY 1, 2),
ga AS (SELECT *, sum(n) OVER (PARTITION BY model ORDER BY t DESC) AS risk FROM gr),
gk AS (SELECT model, t, CASE WHEN max((d = risk)::INT) OVER w = 1 THEN 0 ELSE exp(coalesce(sum(CASE WHEN d < risk THEN ln(1 - d / risk::DOUBLE) END) OVER w, 0)) END AS g FROM ga WINDOW w AS (PARTITION BY model ORDER BY t))"""


@query("d06_uno_c", ctes(SQL_SURV, SQL_G) + f"""
SELECT a.model, {r("sum((1 / greatest(g, 1e-9)) ** 2 * CASE WHEN b.pred_median > a.pred_median THEN 1 WHEN b.pred_median = a.pred_median THEN 0.5 ELSE 0 END) / sum((1 / greatest(g, 1e-9)) ** 2)", name="uno_c")}
FROM surv a JOIN gk ON gk.model = a.model AND gk.t = a.duration JOIN surv b ON a.model = b.model AND a.event_observed = 1 AND b.duration > a.duration GROUP BY 1""")
def d06_uno_c(spark, sf_dir):
    return sv.uno_c(predictions(spark, sf_dir), ["model"], "duration", "event_observed", "pred_median").select("model", rnd("uno_c").alias("uno_c"))


def _sql_brier(floor):
    return f"""
lg AS (SELECT model, duration, event_observed AS e, unnest([{", ".join(f"{{'horizon': {float(k)}::DOUBLE, 'p': p_{k}}}" for k in sv.PROB_TIMES)}], recursive := true) FROM surv),
gat AS (SELECT l.model, l.horizon, coalesce(max_by(g, t) FILTER (t <= horizon), 1) AS g_at FROM (SELECT DISTINCT model, horizon FROM lg) l JOIN gk USING (model) GROUP BY 1, 2),
br AS (SELECT l.model, l.horizon, avg(CASE WHEN e = 1 AND duration <= l.horizon THEN (p - 1) ** 2 / greatest(gk.g, {floor}) WHEN duration > l.horizon THEN p ** 2 / greatest(g_at, {floor}) ELSE 0 END) AS brier
 FROM lg l JOIN gk ON gk.model = l.model AND gk.t = l.duration JOIN gat ON gat.model = l.model AND gat.horizon = l.horizon GROUP BY 1, 2)"""


@query("d07_brier_by_time", ctes(SQL_SURV, SQL_G, _sql_brier(1e-3)) + f" SELECT model, horizon, {r('brier', name='brier')} FROM br")
def d07_brier_by_time(spark, sf_dir):
    b = sv.brier_by_time(predictions(spark, sf_dir), ["model"], "duration", "event_observed", PROBS, sv.FLOOR_MEAN)
    return b.select("model", "horizon", rnd("brier").alias("brier"))


@query("d07_integrated_brier", ctes(SQL_SURV, SQL_G, _sql_brier(1e-9), """
tz AS (SELECT *, (horizon - lag(horizon) OVER w) * (brier + lag(brier) OVER w) / 2 AS a FROM br WINDOW w AS (PARTITION BY model ORDER BY horizon))""") + f"""
SELECT model, {r("avg(brier)", name="ibs_mean")}, {r("sum(a) / (80 + 1e-9)", name="ibs_trapezoid")} FROM tz GROUP BY 1""")
def d07_integrated_brier(spark, sf_dir):
    b = sv.brier_by_time(predictions(spark, sf_dir), ["model"], "duration", "event_observed", PROBS, sv.FLOOR_TRAPEZOID)
    t = sv.brier_mean(b, ["model"]).join(sv.brier_trapezoid(b, ["model"]), "model")
    return t.select("model", rnd("ibs_mean").alias("ibs_mean"), rnd("ibs_trapezoid").alias("ibs_trapezoid"))


SQL_SKM = """
or1 AS (SELECT model, duration AS t, count(*) AS n, sum(event_observed) AS d FROM surv GROUP BY 1, 2),
oa AS (SELECT *, sum(n) OVER (PARTITION BY model ORDER BY t DESC) AS risk FROM or1),
ok AS (SELECT model, t, CASE WHEN max((d = risk)::INT) OVER w = 1 THEN 0 ELSE exp(coalesce(sum(CASE WHEN d < risk THEN ln(1 - d / risk::DOUBLE) END) OVER w, 0)) END AS s,
 coalesce(sum(CASE WHEN d < risk THEN d / (risk::DOUBLE * (risk - d)) END) OVER w, 0) AS gw FROM oa WINDOW w AS (PARTITION BY model ORDER BY t))"""


@query("d08_probability_calibration", ctes(SQL_SURV, SQL_SKM, f"""
pm AS (SELECT model, {", ".join(f"avg(p_{k}) AS p_{k}" for k in sv.PROB_TIMES)} FROM surv GROUP BY 1),
pl AS (SELECT model, unnest([{", ".join(f"{{'horizon': {float(k)}::DOUBLE, 'predicted': p_{k}}}" for k in sv.PROB_TIMES)}], recursive := true) FROM pm),
j AS (SELECT pl.model, horizon, any_value(predicted) AS predicted, max_by(s, t) AS s, max_by(gw, t) AS gw FROM pl JOIN ok ON ok.model = pl.model AND t <= horizon GROUP BY 1, 2)""") + f"""
SELECT model, horizon, {r("predicted", name="predicted")}, {r("1 - s", name="observed")}, {r("predicted - 1 + s", name="gap")},
 {r("1 - s ** exp(-1.959963984540054 * sqrt(gw) / abs(ln(s)))", name="ci_low")}, {r("1 - s ** exp(1.959963984540054 * sqrt(gw) / abs(ln(s)))", name="ci_high")} FROM j""")
def d08_probability_calibration(spark, sf_dir):
    t = sv.calibration(predictions(spark, sf_dir), ["model"], "duration", "event_observed", PROBS)
    return t.select("model", "horizon", *[rnd(c).alias(c) for c in ("predicted", "observed", "gap", "ci_low", "ci_high")])


@query("d09_point_errors", ctes(SQL_SURV) + f"""
SELECT model, count(*) AS n_uncensored, {r("avg(abs(pred_median - duration))", name="mae")}, {r("sqrt(avg((pred_median - duration) ** 2))", name="rmse")},
 {r("median(abs(pred_median - duration))", name="median_abs_error")} FROM surv WHERE event_observed = 1 GROUP BY 1""")
def d09_point_errors(spark, sf_dir):
    t = sv.point_errors(predictions(spark, sf_dir), ["model"], "duration", "event_observed", "pred_median")
    return t.select("model", "n_uncensored", *[rnd(c).alias(c) for c in ("mae", "rmse", "median_abs_error")])


SQL_CAT = """
cat AS (SELECT *, (event_observed = 1 AND duration <= 20)::INT AS y FROM surv WHERE NOT (event_observed = 0 AND duration < 20) AND model IN ('line', 'km_train'))"""


@query("d10_recovery_category", ctes(SQL_SURV, SQL_CAT, """
rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY p_20) + (count(*) OVER (PARTITION BY model, p_20) - 1) / 2.0 AS rk FROM cat)""") + f"""
SELECT model, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, {r("(sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))", name="auc")}, {r("avg((p_20 - y) ** 2)", name="brier")} FROM rk GROUP BY 1""")
def d10_recovery_category(spark, sf_dir):
    """Recovered within 20 sessions; rows censored before that are unknown and dropped."""
    p = predictions(spark, sf_dir).where(F.col("model").isin("line", "km_train"))
    known = p.where(~((F.col("event_observed") == 0) & (F.col("duration") < 20))).withColumn(
        "y", ((F.col("event_observed") == 1) & (F.col("duration") <= 20)).cast("int")).withColumn("prob", F.col("p_20"))
    a = mt.roc_auc(known, ["model"]).join(mt.classification_metrics(known, ["model"]).select("model", "brier"), "model")
    return a.select("model", "n_pos", "n_neg", rnd("auc").alias("auc"), rnd("brier").alias("brier"))


@query("d14_without_competing", ctes(SQL_SURV, """
su AS (SELECT * REPLACE (round(pred_median, 9) AS pred_median) FROM surv),
v AS (SELECT 'all' AS variant, * FROM su WHERE model = 'line' UNION ALL SELECT 'exclude_competing', * FROM su WHERE model = 'line' AND reason <> 'next_disaster')""") + f"""
SELECT a.variant, {r("sum(CASE WHEN b.pred_median > a.pred_median THEN 1 WHEN b.pred_median = a.pred_median THEN 0.5 ELSE 0 END) / count(*)", name="c_index")}
FROM v a JOIN v b ON a.variant = b.variant AND a.event_observed = 1 AND (b.duration > a.duration OR (b.duration = a.duration AND b.event_observed = 0)) GROUP BY 1""")
def d14_without_competing(spark, sf_dir):
    p = predictions(spark, sf_dir).where("model = 'line'")
    both = p.withColumn("variant", F.explode(F.when(F.col("reason") == "next_disaster", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("exclude_competing")))))
    return sv.harrell_c(both, ["variant"], "duration", "event_observed", "pred_median").select("variant", rnd("c_index").alias("c_index"))


@query("d15_cif_baseline", ctes(SQL_OUT, SQL_KM, SQL_AT, """
k AS (SELECT horizon, max_by(s, t) AS s, max_by(gw, t) AS gw FROM ts JOIN km ON t <= horizon GROUP BY 1),
n AS (SELECT horizon, sum((duration >= horizon)::INT)::BIGINT AS n_at_risk, sum((duration < horizon AND event_observed = 1)::INT)::BIGINT AS n_events, sum((duration < horizon AND event_observed = 0)::INT)::BIGINT AS n_censored_before FROM outc, ts GROUP BY 1)""") + f"""
SELECT horizon, {r("1 - s", name="cif")}, {r("1 - least(s + 1.96 * s * sqrt(gw), 1)", name="ci_low")}, {r("1 - greatest(s - 1.96 * s * sqrt(gw), 0)", name="ci_high")}, n_at_risk, n_events, n_censored_before FROM k JOIN n USING (horizon)""")
def d15_cif_baseline(spark, sf_dir):
    d = durations(spark, sf_dir)
    k = sv.at_times(sv.km_curve(d, []), [], sv.PROB_TIMES, {"surv": 1.0, "gw": 0.0})
    cells = d.groupBy("duration", "event_observed").agg(F.count("*").alias("c"))
    n = cells.withColumn("horizon", F.explode(F.array(*[F.lit(float(x)) for x in sv.PROB_TIMES]))).groupBy("horizon").agg(
        F.sum(F.when(F.col("duration") >= F.col("horizon"), F.col("c")).otherwise(0)).alias("n_at_risk"),
        F.sum(F.when((F.col("duration") < F.col("horizon")) & (F.col("event_observed") == 1), F.col("c")).otherwise(0)).alias("n_events"),
        F.sum(F.when((F.col("duration") < F.col("horizon")) & (F.col("event_observed") == 0), F.col("c")).otherwise(0)).alias("n_censored_before"))
    lo, hi = sv.plain_interval(F.col("surv"), F.col("gw"))
    return k.join(n, "horizon").select("horizon", rnd(1 - F.col("surv")).alias("cif"), rnd(1 - hi).alias("ci_low"), rnd(1 - lo).alias("ci_high"), "n_at_risk", "n_events", "n_censored_before")


@query("d17_tercile_calibration", ctes(SQL_SURV, """
u AS (SELECT * FROM surv WHERE model = 'line' AND event_observed = 1),
q AS (SELECT quantile_cont(pred_median, 1.0/3) AS q1, quantile_cont(pred_median, 2.0/3) AS q2 FROM u)""") + f"""
SELECT CASE WHEN pred_median <= q1 THEN 'low' WHEN pred_median <= q2 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, {r("avg(duration)", name="actual")}, {r("avg(pred_median)", name="predicted")} FROM u, q GROUP BY 1""")
def d17_tercile_calibration(spark, sf_dir):
    u = predictions(spark, sf_dir).where("model = 'line' AND event_observed = 1")
    t = sv.tercile_calibration(u, ["model"], "duration", "pred_median")
    return t.select("bucket", "n", rnd("actual").alias("actual"), rnd("predicted").alias("predicted"))


@query("b06_c_index_bootstrap", ctes(SQL_SURV, SQL_HC, _draw_sql("(SELECT * FROM surv WHERE model = 'line')", [], "series_id", NB), """
ds AS (SELECT a.b, sum(a.w * b.w * wins) / sum(a.w * b.w * pairs) AS v FROM hc JOIN dr a ON a.cluster = ci JOIN dr b ON b.cluster = hc.cj AND b.b = a.b WHERE model = 'line' GROUP BY 1)""") + f"""
SELECT {r("(SELECT sum(wins) / sum(pairs) FROM hc WHERE model = 'line')", name="value")}, count(*) AS n_draws, {r("quantile_cont(v, 0.025)", name="ci_low")}, {r("quantile_cont(v, 0.975)", name="ci_high")} FROM ds WHERE v IS NOT NULL""")
def b06_c_index_bootstrap(spark, sf_dir):
    p = predictions(spark, sf_dir).where("model = 'line'")
    names = sorted(x[0] for x in p.select("series_id").distinct().collect())  # the series list is bounded
    conc = sv.cluster_concordance(p, ["model"], "series_id", names, "duration", "event_observed", "pred_median")
    b = rs.concordance_bootstrap(conc, ["model"], p.select("model", F.col("series_id").alias("cluster")).distinct(), NB)
    return b.select(rnd("value").alias("value"), "n_draws", rnd("ci_low").alias("ci_low"), rnd("ci_high").alias("ci_high"))


@query("a09_recovery_state_descriptives", ctes(SQL_OUT, """
s AS (SELECT unnest(['recovered', 'no_drawdown', 'next_disaster', '90_day_cap', 'no_baseline']) AS state)""") + f"""
SELECT state, count(duration) AS n, {r("avg(duration)", name="mean")}, {r("median(duration)", name="median")}, {r("quantile_cont(duration, 0.25)", name="q25")},
 {r("quantile_cont(duration, 0.75)", name="q75")}, min(duration) AS min, max(duration) AS max FROM s LEFT JOIN outc ON reason = state GROUP BY 1""")
def a09_recovery_state_descriptives(spark, sf_dir):
    """States stay listed when empty. Durations take horizon most 91 values, so percentiles stay small."""
    states = ["recovered", "no_drawdown", "next_disaster", "90_day_cap", "no_baseline"]
    g = outcomes(spark, sf_dir).where("duration IS NOT NULL").groupBy(F.col("reason").alias("state")).agg(
        F.count("*").alias("n"), F.avg("duration").alias("mean"), F.percentile("duration", 0.5).alias("median"), F.percentile("duration", 0.25).alias("q25"),
        F.percentile("duration", 0.75).alias("q75"), F.min("duration").alias("min"), F.max("duration").alias("max"))
    base = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in states])).alias("state"))
    return base.join(g, "state", "left").select("state", F.coalesce("n", F.lit(0).cast("long")).alias("n"),
                                                *[rnd(c).alias(c) for c in ("mean", "median", "q25", "q75")], "min", "max")
