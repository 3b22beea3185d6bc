"""Diagnostics, reports and checks over features, outcomes and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor import schema as sm
from tremor.functions import scalars as sc
from tremor.functions.scalars import rnd
from tremor.operators import diagnose as dg
from tremor.operators import metrics as mt
from tremor.plans.forecast_queries import SQL_MEM, SQL_OEPI, SQL_OOF, members, oof, ordered
from tremor.plans.outcome_queries import SQL_OUT, SQL_RET, features, outcomes
from tremor.plans.registry import ctes, query, r
from tremor.sources.adapters import SQL_SESS, SQL_SHOCKS, sessions, shocks, table

FEATS = ["log_return", "squared_return", "sma_5", "sma_10", "vol_ratio_5_30", "price_to_sma_5"]

SQL_FEATS = f"""{SQL_RET},
fe AS (SELECT series_id, date, session_idx, log_return, log_return * log_return AS squared_return,
  CASE WHEN count(*) OVER b5 = 5 THEN avg(close) OVER b5 END AS sma_5, CASE WHEN count(*) OVER b10 = 10 THEN avg(close) OVER b10 END AS sma_10,
  CASE WHEN count(*) OVER b30 = 30 THEN avg(volume) OVER b5 / avg(volume) OVER b30 - 1 END AS vol_ratio_5_30,
  CASE WHEN count(*) OVER b5 = 5 THEN p1 / avg(close) OVER b5 - 1 END AS price_to_sma_5
  FROM rets WINDOW b5 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
   b10 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
   b30 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))"""


def _pairs():
    return [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]


SQL_PEARSON = "pp AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM fe" for a, b in _pairs()) + ")"


@query("q01_pearson_pairs", ctes(SQL_FEATS, SQL_PEARSON) + f" SELECT a, b, {r('rho', 5, 'rho')} FROM pp")
def q01_pearson_pairs(spark, sf_dir):
    return dg.pearson_pairs(features(spark, sf_dir), FEATS).select("a", "b", rnd("rho", 5).alias("rho"))


SQL_SPEARMAN = "sx AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM fe WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _pairs()) + """),
sr AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM sx),
sp AS (SELECT a, b, count(*) AS n, corr(rx, ry) AS rho FROM sr GROUP BY 1, 2)"""


@query("q01_spearman_pairs", ctes(SQL_FEATS, SQL_SPEARMAN) + f" SELECT a, b, n, {r('rho', 5, 'rho')} FROM sp")
def q01_spearman_pairs(spark, sf_dir):
    return dg.spearman_pairs(features(spark, sf_dir), FEATS).select("a", "b", "n", rnd("rho", 5).alias("rho"))


@query("q01_embedding_pearson", """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(corr(a.v, b.v), 5) + 0.0 AS rho FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2""")
def q01_embedding_pearson(spark, sf_dir):
    return dg.vector_pearson(table(spark, sf_dir, "embeddings"), "embedding").select("i", "j", rnd("rho", 5).alias("rho"))


@query("q02_t01_top_pairs", ctes(SQL_FEATS, SQL_PEARSON) + f" SELECT a, b, {r('rho', 5, 'rho')} FROM pp ORDER BY abs(rho) DESC, a, b LIMIT 5")
def q02_t01_top_pairs(spark, sf_dir):
    p = dg.pearson_pairs(features(spark, sf_dir), FEATS)
    return p.orderBy(F.abs("rho").desc(), "a", "b").limit(5).select("a", "b", rnd("rho", 5).alias("rho"))


@query("q03_variance_inflation", ctes(SQL_FEATS, """
c AS (SELECT corr(log_return, vol_ratio_5_30) AS p, corr(log_return, price_to_sma_5) AS q, corr(vol_ratio_5_30, price_to_sma_5) AS s FROM fe),
d AS (SELECT *, 1 + 2 * p * q * s - p * p - q * q - s * s AS det FROM c)""") + f"""
SELECT 'log_return' AS feature, {r("(1 - s * s) / det", 5, "vif")} FROM d UNION ALL SELECT 'vol_ratio_5_30', {r("(1 - q * q) / det", 5)} FROM d
UNION ALL SELECT 'price_to_sma_5', {r("(1 - p * p) / det", 5)} FROM d""")
def q03_variance_inflation(spark, sf_dir):
    return dg.vif(features(spark, sf_dir), ["log_return", "vol_ratio_5_30", "price_to_sma_5"]).select("feature", rnd("vif", 5).alias("vif"))


@query("q04_condition_indices", ctes(SQL_FEATS, "c AS (SELECT abs(corr(sma_5, sma_10)) AS p FROM fe)") + f"""
SELECT 0 AS position, 1.0::DOUBLE AS condition_index UNION ALL SELECT 1, {r("sqrt((1 + p) / (1 - p))", 5)} FROM c""")
def q04_condition_indices(spark, sf_dir):
    return dg.condition_indices(features(spark, sf_dir), ["sma_5", "sma_10"]).select("position", rnd("condition_index", 5).alias("condition_index"))


@query("q05_redundant_features", ctes(SQL_FEATS, SQL_PEARSON, """
e AS (SELECT a, b FROM pp WHERE abs(rho) >= 0.6 UNION ALL SELECT b, a FROM pp WHERE abs(rho) >= 0.6),
RECURSIVE_PLACEHOLDER""").replace("WITH", "WITH RECURSIVE", 1).replace("RECURSIVE_PLACEHOLDER", """
reach(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM reach r JOIN e ON e.a = r.y),
comp AS (SELECT x AS feature, min(y) AS component FROM reach GROUP BY 1),
dep AS (SELECT *, CASE WHEN feature IN ('squared_return', 'price_to_sma_5') THEN 1 ELSE 0 END AS depth FROM comp),
kp AS (SELECT component, min_by(feature, (depth, feature)) AS kept FROM dep GROUP BY 1)""") + """
SELECT feature AS dropped, kept FROM dep JOIN kp USING (component) WHERE feature <> kept""")
def q05_redundant_features(spark, sf_dir):
    return dg.redundant_features(dg.pearson_pairs(features(spark, sf_dir), FEATS), sm.feature_spec(spark, FEATS), 0.6)


@query("q08_stationarity", ctes(SQL_RET, """
r0 AS (SELECT series_id, date, log_return - lag(log_return) OVER w AS dy, lag(log_return) OVER w AS u, lag(log_return) OVER w - lag(log_return, 2) OVER w AS v FROM rets WINDOW w AS (PARTITION BY series_id ORDER BY date)),
g AS (SELECT series_id, count(*)::DOUBLE AS n, var_pop(u) AS suu, var_pop(v) AS svv, var_pop(dy) AS syy, covar_pop(u, v) AS suv, covar_pop(u, dy) AS suy, covar_pop(v, dy) AS svy
  FROM r0 WHERE dy IS NOT NULL AND u IS NOT NULL AND v IS NOT NULL GROUP BY 1),
g2 AS (SELECT *, suu * svv - suv * suv AS det FROM g), g3 AS (SELECT *, (svv * suy - suv * svy) / det AS b, (suu * svy - suv * suy) / det AS c FROM g2),
adf AS (SELECT series_id, n, b / sqrt((syy - b * suy - c * svy) / (n - 3) * svv / det) AS adf_t FROM g3),
e AS (SELECT series_id, date, log_return - avg(log_return) OVER (PARTITION BY series_id) AS e FROM rets WHERE log_return IS NOT NULL),
k0 AS (SELECT *, sum(e) OVER w AS s, lag(e, 1) OVER w AS l1, lag(e, 2) OVER w AS l2, lag(e, 3) OVER w AS l3, lag(e, 4) OVER w AS l4 FROM e WINDOW w AS (PARTITION BY series_id ORDER BY date)),
kp AS (SELECT series_id, sum(s * s) / count(*) ** 2 / (sum(e * e) / count(*) + 2 * (0.8 * sum(e * l1) + 0.6 * sum(e * l2) + 0.4 * sum(e * l3) + 0.2 * sum(e * l4)) / count(*)) AS kpss FROM k0 GROUP BY 1)""") + f"""
SELECT series_id, n::BIGINT AS n, {r("adf_t", 5, "adf_t")}, {r("kpss", 5, "kpss")}, adf_t < -2.86 AND kpss < 0.463 AS stationary FROM adf JOIN kp USING (series_id)""")
def q08_stationarity(spark, sf_dir):
    s = dg.stationarity(features(spark, sf_dir).select("series_id", "date", "log_return"), ["series_id"], "date", "log_return")
    return s.select("series_id", "n", rnd("adf_t", 5).alias("adf_t"), rnd("kpss", 5).alias("kpss"), "stationary")


@query("q09_missingness_states", ctes(SQL_MEM) + """
SELECT feature, state, count(*) AS n FROM (
 SELECT 'x1' AS feature, CASE WHEN x1 IS NULL THEN 'missing' ELSE 'observed' END AS state FROM fo UNION ALL
 SELECT 'y2_5', CASE WHEN v_base IS NULL THEN 'zero_filled' WHEN y2_5 IS NULL THEN 'missing' ELSE 'observed' END FROM fo) GROUP BY 1, 2""")
def q09_missingness_states(spark, sf_dir):
    return dg.value_states(ordered(spark, sf_dir), "event_id", {"x1": None, "y2_5": F.col("v_base").isNull()})


_MISS = ["x1", "x2", "y1_5", "y1_20", "y2_5", "y2_20"]


@query("a07_q10_missingness", ctes(SQL_MEM, "mm AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, count(*) - count({c}) AS n_missing FROM fo" for c in _MISS) + ")") + f"""
SELECT feature, CASE WHEN feature LIKE 'y%' THEN 'outcome' ELSE 'feature' END AS role, n, n_missing, {r("n_missing / n", name="share_missing")} FROM mm""")
def a07_q10_missingness(spark, sf_dir):
    t = dg.missingness(ordered(spark, sf_dir), _MISS)
    role = F.when(F.col("feature").startswith("y"), "outcome").otherwise("feature")
    return t.select("feature", role.alias("role"), "n", "n_missing", rnd("share_missing").alias("share_missing"))


@query("a08_f14_coverage", ctes(SQL_MEM, """
b AS (SELECT type, CASE WHEN year(event_date) < 1997 THEN 'early' WHEN year(event_date) <= 1999 THEN 'middle' ELSE 'late' END AS period, x1, y1_20, y2_20 FROM fo),
l AS (SELECT type, period, 'x1' AS variable, (x1 IS NOT NULL)::INT AS s FROM b UNION ALL SELECT type, period, 'y1_20', (y1_20 IS NOT NULL)::INT FROM b UNION ALL SELECT type, period, 'y2_20', (y2_20 IS NOT NULL)::INT FROM b)""") + f"""
SELECT variable, type, period, {r("avg(s)", name="coverage")}, count(*) AS n FROM l GROUP BY GROUPING SETS ((variable), (variable, type), (variable, period))""")
def a08_f14_coverage(spark, sf_dir):
    y = F.year("event_date")
    o = ordered(spark, sf_dir).withColumn("period", F.when(y < 1997, "early").when(y <= 1999, "middle").otherwise("late"))
    t = dg.coverage_by(o, ["x1", "y1_20", "y2_20"], ["type", "period"])
    return t.select("variable", "type", "period", rnd("coverage").alias("coverage"), "n")


@query("a14_sector_skill", ctes(SQL_OOF) + f"""
SELECT series_id, count(*) AS n, {r("avg(y_true)", name="mean_response")}, {r("1 - sqrt(avg((y_pred - y_true) ** 2)) / sqrt(avg(y_true ** 2))", name="skill_vs_zero")}
FROM oof WHERE target = 'ret5' AND model = 'ols' GROUP BY 1""")
def a14_sector_skill(spark, sf_dir):
    e = F.col("y_pred") - F.col("y_true")
    t = oof(spark, sf_dir).where("target = 'ret5' AND model = 'ols'").groupBy("series_id").agg(
        F.count("*").alias("n"), F.avg("y_true").alias("m"), (1 - F.sqrt(F.avg(e * e)) / F.sqrt(F.avg(F.col("y_true") * F.col("y_true")))).alias("s"))
    return t.select("series_id", "n", rnd("m").alias("mean_response"), rnd("s").alias("skill_vs_zero"))


@query("a14_within_event_dispersion", ctes(SQL_OUT, """
long AS (SELECT series_id FROM sess GROUP BY 1 HAVING count(*) >= 60), days AS (SELECT DISTINCT event_date FROM shocks),
dorg AS (SELECT d.event_date, x.series_id, min(x.session_idx) AS session_idx FROM days d JOIN sess x ON x.date >= d.event_date JOIN long USING (series_id) GROUP BY 1, 2),
pn AS (SELECT d.event_date, w.y1_5 FROM dorg d JOIN win w USING (series_id, session_idx) WHERE d.session_idx > 1)""") + f"""
SELECT {r("avg(sd)", name="mean_dispersion")}, count(sd) AS n_days FROM (SELECT event_date, stddev_samp(y1_5) AS sd FROM pn GROUP BY 1)""")
def a14_within_event_dispersion(spark, sf_dir):
    from tremor.plans.outcome_queries import panel

    p = panel(spark, sf_dir).groupBy("event_date").agg(F.stddev_samp("y1_5").alias("sd"))
    return p.agg(F.avg("sd").alias("m"), F.count("sd").alias("n_days")).select(rnd("m").alias("mean_dispersion"), "n_days")


@query("a15_series_coverage", ctes(SQL_SESS, "g AS (SELECT min(date) AS lo, max(date) AS hi FROM sess)") + """
SELECT series_id, min(date) AS first_date, max(date) AS last_date, count(*) AS n_sessions, (min(date) > any_value(lo) OR max(date) < any_value(hi)) AS is_short FROM sess, g GROUP BY 1""")
def a15_series_coverage(spark, sf_dir):
    per = sessions(spark, sf_dir).groupBy("series_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_sessions"))
    w = W.partitionBy(F.lit("all"))  # one row per series
    short = (F.col("first_date") > F.min("first_date").over(w)) | (F.col("last_date") < F.max("last_date").over(w))
    return per.withColumn("is_short", short)


@query("a16_threshold_sweep", ctes(SQL_SHOCKS, "t AS (SELECT unnest([100, 500, 1000, 2500, 5000, 10000]) AS threshold)") + """
SELECT CAST(threshold AS INTEGER) AS threshold, count(*) AS n_events FROM t JOIN shocks ON affected >= threshold GROUP BY 1
UNION ALL SELECT 10000, 0 WHERE NOT EXISTS (SELECT 1 FROM shocks WHERE affected >= 10000)""")
def a16_threshold_sweep(spark, sf_dir):
    ts = [100, 500, 1000, 2500, 5000, 10000]
    one = shocks(spark, sf_dir).agg(*[F.sum((F.col("affected") >= t).cast("long")).alias(f"t{t}") for t in ts])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.coalesce(f"t{t}", F.lit(0).cast("long")).alias("n_events")) for t in ts])).alias("_x")).select("_x.*")


@query("a17_contingency", ctes(SQL_OUT) + """
SELECT y1_5 >= 0 AS return_up, duration = 0 AS no_drawdown, count(*) AS n FROM outc WHERE y1_5 IS NOT NULL AND duration IS NOT NULL GROUP BY 1, 2""")
def a17_contingency(spark, sf_dir):
    o = outcomes(spark, sf_dir).where("y1_5 IS NOT NULL AND duration IS NOT NULL")
    return o.groupBy((F.col("y1_5") >= 0).alias("return_up"), (F.col("duration") == 0).alias("no_drawdown")).agg(F.count("*").alias("n"))


@query("a20_label_prevalence", ctes(SQL_OUT, """
l AS (SELECT unnest([{'label': 'down', 'y': (y1_5 < 0)::INT}, {'label': 'spike', 'y': (y2_5 > 0)::INT}, {'label': 'drawdown', 'y': drawdown::INT}], recursive := true) FROM outc)""") + f"""
SELECT label, count(y) AS n, {r("avg(y)", name="prevalence")}, {r("greatest(avg(y), 1 - avg(y))", name="majority")} FROM l GROUP BY 1""")
def a20_label_prevalence(spark, sf_dir):
    labels = {"down": F.col("y1_5") < 0, "spike": F.col("y2_5") > 0, "drawdown": F.col("drawdown")}
    one = outcomes(spark, sf_dir).agg(*[F.avg(c.cast("int")).alias(f"p_{k}") for k, c in labels.items()], *[F.count(c).alias(f"n_{k}") for k, c in labels.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"n_{k}").alias("n"), F.col(f"p_{k}").alias("p")) for k in labels])
    t = one.select(F.explode(rows).alias("_x")).select("_x.*")
    return t.select("label", "n", rnd("p").alias("prevalence"), rnd(F.greatest(F.col("p"), 1 - F.col("p"))).alias("majority"))


@query("q11_outliers", ctes(SQL_OUT, """
q AS (SELECT type, quantile_cont(y1_5, 0.25) AS q1, median(y1_5) AS md, quantile_cont(y1_5, 0.75) AS q3 FROM outc GROUP BY 1),
m AS (SELECT type, median(abs(y1_5 - md)) AS mad FROM outc JOIN q USING (type) GROUP BY 1)""") + f"""
SELECT type, count(y1_5) AS n, {r("any_value(q1)", name="q1")}, {r("any_value(q3)", name="q3")}, {r("any_value(mad)", name="mad")},
 sum((y1_5 < q1 - 1.5 * (q3 - q1) OR y1_5 > q3 + 1.5 * (q3 - q1))::INT)::BIGINT AS n_iqr, sum((0.6745 * abs(y1_5 - md) / mad > 3.5)::INT)::BIGINT AS n_mad FROM outc JOIN q USING (type) JOIN m USING (type) GROUP BY 1""")
def q11_outliers(spark, sf_dir):
    t = dg.outliers(outcomes(spark, sf_dir), ["type"], "y1_5")
    return t.select("type", "n", rnd("q1").alias("q1"), rnd("q3").alias("q3"), rnd("mad").alias("mad"), "n_iqr", "n_mad")


@query("q12_shape", ctes(SQL_OUT, "m AS (SELECT type, avg(y1_5) AS mu FROM outc GROUP BY 1)") + f"""
SELECT type, count(y1_5) AS n, {r("avg(y1_5)", name="mean")}, {r("stddev_samp(y1_5)", name="std")},
 {r("avg((y1_5 - mu) ** 3) / var_pop(y1_5) ** 1.5", 5, "skew")}, {r("avg((y1_5 - mu) ** 4) / var_pop(y1_5) ** 2 - 3", 5, "excess_kurtosis")} FROM outc JOIN m USING (type) GROUP BY 1""")
def q12_shape(spark, sf_dir):
    t = dg.shape(outcomes(spark, sf_dir), ["type"], "y1_5")
    return t.select("type", "n", rnd("mean").alias("mean"), rnd("std").alias("std"), rnd("skew", 5).alias("skew"), rnd("excess_kurtosis", 5).alias("excess_kurtosis"))


@query("q13_f10_feature_target", ctes(SQL_MEM, """
l AS (SELECT 'x1' AS feature, x1 AS x, y1_5 AS y FROM fo WHERE x1 IS NOT NULL AND y1_5 IS NOT NULL UNION ALL SELECT 'x2', x2, y1_5 FROM fo WHERE x2 IS NOT NULL AND y1_5 IS NOT NULL
 UNION ALL SELECT 'severity', severity, y1_5 FROM fo WHERE y1_5 IS NOT NULL),
rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM l)""") + f"""
SELECT feature, count(*) AS n, {r("corr(rx, ry)", 5, "rho")}, {r("tanh(1.959964 / sqrt(count(*) - 3))", name="critical_r")} FROM rk GROUP BY 1""")
def q13_f10_feature_target(spark, sf_dir):
    o = ordered(spark, sf_dir)
    long = o.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x"), F.col("y1_5").alias("y")) for c in ("x1", "x2", "severity")])).alias("_x")).select("_x.*")
    long = long.where("x IS NOT NULL AND y IS NOT NULL")
    n = long.groupBy("feature").agg(F.count("*").alias("n"))
    s = mt.spearman(long, ["feature"], "x", "y")
    return n.join(s, "feature").select("feature", "n", rnd("spearman", 5).alias("rho"), rnd(sc.critical_r("n")).alias("critical_r"))


@query("q14_histogram", ctes(SQL_OUT) + """
SELECT CAST(CASE WHEN y1_5 < -200 THEN 0 WHEN y1_5 >= 200 THEN 21 ELSE floor((y1_5 + 200) / 400.0 * 20) + 1 END AS BIGINT) AS bin, count(*) AS n FROM outc WHERE y1_5 IS NOT NULL GROUP BY 1""")
def q14_histogram(spark, sf_dir):
    return dg.histogram(outcomes(spark, sf_dir), "y1_5", -200.0, 200.0, 20)


@query("q14_ecdf", ctes(SQL_OUT) + f"""
SELECT DISTINCT type, duration, {r("cume_dist() OVER (PARTITION BY type ORDER BY duration)", name="ecdf")} FROM outc WHERE duration IS NOT NULL""")
def q14_ecdf(spark, sf_dir):
    return dg.ecdf(outcomes(spark, sf_dir), ["type"], "duration").select("type", "duration", rnd("ecdf").alias("ecdf"))


@query("q15_fold_sigma", ctes(SQL_MEM) + f"""
SELECT fold, {r("stddev_pop(CASE WHEN role = 'test' THEN y1_5 END)", name="sigma_test")},
 {r("stddev_pop(CASE WHEN role = 'test' THEN y1_5 END) / (SELECT stddev_pop(y1_5) FROM fo)", name="ratio_to_full")} FROM mem GROUP BY 1""")
def q15_fold_sigma(spark, sf_dir):
    full = ordered(spark, sf_dir).agg(F.stddev_pop("y1_5").alias("_s"), F.lit("test").alias("role"))
    t = members(spark, sf_dir).where("role = 'test'").groupBy("fold", "role").agg(F.stddev_pop("y1_5").alias("sigma_test"))
    return t.join(full, "role").select("fold", rnd("sigma_test").alias("sigma_test"), rnd(F.col("sigma_test") / F.col("_s")).alias("ratio_to_full"))


_M = "m AS (SELECT target, model, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, 1 - sum((y_pred - y_true) ** 2) / (count(*) * var_pop(y_true)) AS r2 FROM oof GROUP BY 1, 2)"


def _metrics(spark, sf_dir):
    return mt.regression_metrics(oof(spark, sf_dir), ["target", "model"])


@query("t02_best_configuration", ctes(SQL_OOF, _M) + f"""
SELECT target, model AS best_model, {r("rmse", name="rmse")} FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY rmse, model) AS rn FROM m) WHERE rn = 1""")
def t02_best_configuration(spark, sf_dir):
    b = _metrics(spark, sf_dir).groupBy("target").agg(F.min(F.struct("rmse", "model")).alias("_b"))
    return b.select("target", F.col("_b.model").alias("best_model"), rnd("_b.rmse").alias("rmse"))


@query("t03_most_extreme", ctes(SQL_OUT, "md AS (SELECT median(y1_5) AS md FROM outc)") + f"""
SELECT event_id, {r("y1_5", name="y1_5")} FROM outc, md WHERE y1_5 IS NOT NULL ORDER BY abs(y1_5 - md) DESC, event_id LIMIT 10""")
def t03_most_extreme(spark, sf_dir):
    from tremor.functions.ordered import exact_quantiles

    o = outcomes(spark, sf_dir).where("y1_5 IS NOT NULL").withColumn("_k", F.lit(1))
    md = exact_quantiles(o, ["_k"], "y1_5", {"md": 0.5})
    return o.join(F.broadcast(md), "_k").orderBy(F.abs(F.col("y1_5") - F.col("md")).desc(), "event_id").limit(10).select("event_id", rnd("y1_5").alias("y1_5"))


@query("t04_without_worst_errors", ctes(SQL_OOF, """
o AS (SELECT * FROM oof WHERE target = 'ret5' AND model = 'ols'), w AS (SELECT event_id FROM o ORDER BY abs(y_pred - y_true) DESC, event_id LIMIT 5)""") + f"""
SELECT count(*) AS n, {r("sqrt(avg((y_pred - y_true) ** 2))", name="rmse")} FROM o WHERE event_id NOT IN (SELECT event_id FROM w)""")
def t04_without_worst_errors(spark, sf_dir):
    o = oof(spark, sf_dir).where("target = 'ret5' AND model = 'ols'")
    worst = o.orderBy(F.abs(F.col("y_pred") - F.col("y_true")).desc(), "event_id").limit(5).select("event_id")
    return o.join(worst, "event_id", "left_anti").agg(*mt.regression_aggs()).select("n", rnd("rmse").alias("rmse"))


@query("t05_ranked_table", ctes(SQL_OOF, _M) + f"""
SELECT row_number() OVER (ORDER BY target, rmse, model) AS rank, target, model, {r("rmse", name="rmse")} FROM m""")
def t05_ranked_table(spark, sf_dir):
    w = W.partitionBy(F.lit("report")).orderBy("target", "rmse", "model")  # one row per configuration
    return _metrics(spark, sf_dir).select(F.row_number().over(w).cast("long").alias("rank"), "target", "model", rnd("rmse").alias("rmse"))


@query("a19_ablation_pivot", ctes(SQL_OOF, "f AS (SELECT target, model, fold, sqrt(avg((y_pred - y_true) ** 2)) AS rmse FROM oof GROUP BY 1, 2, 3)") + f"""
SELECT target, fold, {", ".join(r(f"max(rmse) FILTER (model = '{m}')", name=m) for m in ("ols", "train_mean", "train_median", "zero"))} FROM f GROUP BY 1, 2""")
def a19_ablation_pivot(spark, sf_dir):
    e = F.col("y_pred") - F.col("y_true")
    names = ["ols", "train_mean", "train_median", "zero"]
    t = oof(spark, sf_dir).groupBy("target", "fold").pivot("model", names).agg(F.sqrt(F.avg(e * e)))
    return t.select("target", "fold", *[rnd(n).alias(n) for n in names])


@query("m15_w23_analysis_map", ctes(SQL_OOF, _M) + """
SELECT 'accuracy' AS analysis, target || ':' || model AS comparison, target AS family_id, count(*) OVER (PARTITION BY target) AS family_size FROM m
UNION ALL SELECT 'skill', target || ':' || model, target || ':skill', count(*) OVER (PARTITION BY target) FROM m WHERE model <> 'zero'""")
def m15_w23_analysis_map(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    name = F.concat_ws(":", "target", "model").alias("comparison")
    a = m.select(F.lit("accuracy").alias("analysis"), name, F.col("target").alias("family_id"))
    b = m.where("model <> 'zero'").select(F.lit("skill").alias("analysis"), name, F.concat("target", F.lit(":skill")).alias("family_id"))
    return a.unionByName(b).withColumn("family_size", F.count("*").over(W.partitionBy("family_id")))


@query("m16_final_tables", ctes(SQL_OOF, _M, "z AS (SELECT target, rmse AS zr FROM m WHERE model = 'zero')") + f"""
SELECT target, model, {r("rmse", name="rmse")}, {r("r2", name="r2")}, {r("1 - rmse / zr", name="rmse_reduction")}, {r("1 - rmse * rmse / (zr * zr)", name="mse_reduction")} FROM m JOIN z USING (target)""")
def m16_final_tables(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    z = m.where("model = 'zero'").select("target", F.col("rmse").alias("zr"))
    return m.join(z, "target").select("target", "model", rnd("rmse").alias("rmse"), rnd("r2").alias("r2"), rnd(sc.skill("rmse", "zr")).alias("rmse_reduction"),
                                      rnd(sc.skill(F.col("rmse") * F.col("rmse"), F.col("zr") * F.col("zr"))).alias("mse_reduction"))


@query("m17_m19_drift_check", ctes(SQL_OUT) + """
SELECT sum((NOT (event_id % 101 = 0 AND event_id % 103 = 0))::INT)::BIGINT AS n_rows,
 sum((event_id % 97 = 0 AND y1_5 IS NOT NULL AND event_id % 101 <> 0 AND event_id % 103 <> 0)::INT)::BIGINT AS n_changed,
 sum((event_id % 103 = 0 AND event_id % 101 <> 0)::INT)::BIGINT AS n_only_before, sum((event_id % 101 = 0 AND event_id % 103 <> 0)::INT)::BIGINT AS n_only_now FROM outc""")
def m17_m19_drift_check(spark, sf_dir):
    """A snapshot with known revisions against the outcomes computed again, row by row."""
    from tremor.operators import outcomes as oc
    from tremor.session import stage

    revised = F.when(F.col("event_id") % 97 == 0, F.col("y1_5") + 0.5).otherwise(F.col("y1_5"))
    snap = stage(outcomes(spark, sf_dir).where("event_id % 101 <> 0").select("event_id", revised.alias("y1_5"), "duration"), "snapshot")
    now = oc.event_outcomes(shocks(spark, sf_dir), sessions(spark, sf_dir)).where("event_id % 103 <> 0")
    now = now.select("event_id", F.col("y1_5").alias("b1"), F.col("duration").alias("b2"), F.lit(1).alias("_n"))
    j = snap.withColumn("_s", F.lit(1)).join(now, "event_id", "full_outer")
    both = F.col("_s").isNotNull() & F.col("_n").isNotNull()
    gap = F.abs(F.coalesce("y1_5", F.lit(-9e9)) - F.coalesce("b1", F.lit(-9e9))) > 1e-9
    diff = both & (gap | ~F.col("duration").eqNullSafe(F.col("b2")))
    count = lambda c: F.sum(c.cast("long"))
    return j.agg(F.count("*").alias("n_rows"), count(diff).alias("n_changed"), count(F.col("_n").isNull()).alias("n_only_before"), count(F.col("_s").isNull()).alias("n_only_now"))


@query("m18_invariant_checks", ctes(SQL_OOF) + """
SELECT 'events_per_model' AS check_name, (SELECT count(DISTINCT n) FROM (SELECT model, count(*) AS n FROM oof WHERE target = 'ret5' GROUP BY 1)) = 1 AS passed
UNION ALL SELECT 'no_missing_prediction', (SELECT count(*) FROM oof WHERE y_pred IS NULL) = 0
UNION ALL SELECT 'zero_model_is_zero', (SELECT max(abs(y_pred)) FROM oof WHERE model = 'zero') = 0
UNION ALL SELECT 'each_event_tested_once', (SELECT max(n) FROM (SELECT count(*) AS n FROM oof GROUP BY target, model, event_id)) = 1""")
def m18_invariant_checks(spark, sf_dir):
    o = oof(spark, sf_dir)
    per_event = o.groupBy("target", "model", "event_id").agg(F.count("*").alias("n"), F.max("y_pred").alias("p"), F.count("y_pred").alias("np"))
    per_model = per_event.groupBy("target", "model").agg(F.sum("n").alias("rows"), F.sum(F.col("n") - F.col("np")).alias("missing"), F.max(F.abs("p")).alias("top"), F.max("n").alias("most"))
    one = per_model.agg(
        (F.countDistinct(F.when(F.col("target") == "ret5", F.col("rows"))) == 1).alias("events_per_model"), (F.sum("missing") == 0).alias("no_missing_prediction"),
        (F.max(F.when(F.col("model") == "zero", F.col("top"))) == 0).alias("zero_model_is_zero"), (F.max("most") == 1).alias("each_event_tested_once"))
    return one.unpivot([], one.columns, "check_name", "passed")


@query("p06_p12_f13_feature_classes")
def p06_p12_f13_feature_classes(spark, sf_dir):
    """Every feature column of the data with its block, availability class and depth."""
    cols = [c for c in features(spark, sf_dir).columns if c not in ("series_id", "date", "close", "volume", "session_idx")]
    sm.assert_no_leak(cols)
    spec = sm.feature_spec(spark, cols)
    sm.information_sets(spec)
    return spec.join(dg.missingness(features(spark, sf_dir), cols), "feature")


@query("j14_tail_alignment", ctes(SQL_OOF, """
a AS (SELECT event_id, ord, y_pred, y_true, row_number() OVER (ORDER BY ord DESC) AS tail FROM oof WHERE model = 'ols' AND target = 'vol5'),
b AS (SELECT event_id AS base_event, row_number() OVER (ORDER BY ord DESC) AS tail FROM oof WHERE model = 'zero' AND target = 'ret5')""") + """
SELECT tail - 1 AS tail, event_id, base_event FROM a JOIN b USING (tail)""")
def j14_tail_alignment(spark, sf_dir):
    """Two prediction lists of different length matched by distance from their ends."""
    from tremor.functions.ordered import order_index

    def tail(df, name):
        n = df.count()
        return order_index(df, "event_date", "event_id", "_o").select(F.col("event_id").alias(name), (F.lit(n - 1) - F.col("_o")).alias("tail"))

    o = oof(spark, sf_dir)
    return tail(o.where("model = 'ols' AND target = 'vol5'"), "event_id").join(tail(o.where("model = 'zero' AND target = 'ret5'"), "base_event"), "tail").select("tail", "event_id", "base_event")


@query("p08_clip_to_bounds", ctes(SQL_OOF) + f"""
SELECT target, event_id, {r("greatest(least(y_pred * 3, CASE WHEN target = 'ret5' THEN 1 END), CASE WHEN target = 'ret5' THEN -1 ELSE 0 END)", name="clipped")} FROM oof WHERE model = 'ols'""")
def p08_clip_to_bounds(spark, sf_dir):
    """Per-target bounds; a missing bound leaves that side open."""
    low = F.when(F.col("target") == "ret5", -1.0).otherwise(0.0)
    high = F.when(F.col("target") == "ret5", 1.0)
    return oof(spark, sf_dir).where("model = 'ols'").select("target", "event_id", rnd(sc.clip(F.col("y_pred") * 3, low, high)).alias("clipped"))


@query("u01_union_missing_columns", ctes(SQL_OOF) + """
SELECT target, model, count(*) AS n, count(status) AS n_status FROM (SELECT target, model, status FROM oof WHERE target = 'ret5' UNION ALL SELECT target, model, NULL FROM oof WHERE target = 'vol5') GROUP BY 1, 2""")
def u01_union_missing_columns(spark, sf_dir):
    o = oof(spark, sf_dir)
    both = o.where("target = 'ret5'").unionByName(o.where("target = 'vol5'").drop("status"), allowMissingColumns=True)
    return both.groupBy("target", "model").agg(F.count("*").alias("n"), F.count("status").alias("n_status"))
