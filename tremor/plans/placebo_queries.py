"""Placebo event studies, randomisation, matched forecasts and augmentation.

These run on severe events, the inclusion rule of the study: with every urgent order
as an event no session would be free of events.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.ordered import exact_quantiles
from tremor.functions.scalars import rnd
from tremor.operators import augment as ag
from tremor.operators import calendar as cal
from tremor.operators import folds as fd
from tremor.operators import metrics as mt
from tremor.operators import models as md
from tremor.operators import outcomes as oc
from tremor.operators import placebo as pb
from tremor.operators import resample as rs
from tremor.operators import series as sr
from tremor.operators import study as st
from tremor.plans.event_queries import derive
from tremor.plans.forecast_queries import NB, SQL_OOF, _draw_sql, oof
from tremor.plans.model_queries import SQL_ROWS, XS, rows
from tremor.plans.outcome_queries import SQL_ALIGNED, SQL_FIT, features, fitted
from tremor.plans.registry import ctes, query, r
from tremor.session import stage, staged_once
from tremor.sources.adapters import SQL_SHOCKS, factor, sessions, shocks

#: Draws of the randomisation test.
PERMUTED = 5000
#: Events that count as severe: so many of each series and calendar year. The rule follows the
#: calendar, so free sessions remain however many events there are.
SEVERE_PER_YEAR = 2


def severe(spark, sf_dir, most=SEVERE_PER_YEAR):
    """The most severe events of each series and year; ties go to the smaller id."""
    w = W.partitionBy("series_id", F.year("event_date")).orderBy(F.desc("severity"), "event_id")
    return shocks(spark, sf_dir).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def severe_days(spark, sf_dir):
    return staged_once(spark, sf_dir, "severe_days", lambda: cal.event_days(severe(spark, sf_dir), sessions(spark, sf_dir)))


def context(spark, sf_dir):
    return staged_once(spark, sf_dir, "context", lambda: pb.session_context(sessions(spark, sf_dir)))


def free_sessions(spark, sf_dir):
    return staged_once(spark, sf_dir, "free_sessions", lambda: pb.candidates(context(spark, sf_dir), severe_days(spark, sf_dir)))


def origin_context(spark, sf_dir):
    o = cal.usable_origins(severe_days(spark, sf_dir)).groupBy("series_id", F.col("session_idx").alias("origin")).agg(F.sum("n_events").alias("weight"))
    return o.join(context(spark, sf_dir).withColumnRenamed("session_idx", "origin").select("series_id", "origin", "vol", "month", "year"), ["series_id", "origin"])


def matched(spark, sf_dir):
    return staged_once(spark, sf_dir, "matched", lambda: pb.matched_placebos(origin_context(spark, sf_dir), free_sessions(spark, sf_dir)))


def fitted50(spark, sf_dir):
    def build():
        a = cal.align_factor(sessions(spark, sf_dir), factor(spark, sf_dir)).withColumn("log_return", sr.log_return())
        return sr.market_model(a, "log_return", "factor_ret", least=50)

    return staged_once(spark, sf_dir, "fitted50", build)


SQL_FREE = f"""{SQL_SHOCKS},
sev AS (SELECT * FROM shocks QUALIFY row_number() OVER (PARTITION BY series_id, year(event_date) ORDER BY severity DESC, event_id) <= {SEVERE_PER_YEAR}),
so AS (SELECT s.event_id, s.series_id, s.event_date, min(x.session_idx) AS session_idx FROM sev s JOIN sess x ON x.series_id = s.series_id AND x.date >= s.event_date GROUP BY 1, 2, 3),
lr AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY series_id ORDER BY date)) AS lret FROM sess),
cx AS (SELECT series_id, session_idx, date, month(date) AS mo, year(date) AS yr, max(session_idx) OVER (PARTITION BY series_id) AS last_idx,
  CASE WHEN count(*) OVER f >= 5 AND count(lret) OVER f = count(*) OVER f THEN stddev_samp(lret) OVER f END AS vol FROM lr WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
cand AS (SELECT * FROM cx WHERE session_idx > 250 AND session_idx <= last_idx - 20 AND NOT EXISTS (SELECT 1 FROM so WHERE so.series_id = cx.series_id AND cx.session_idx BETWEEN so.session_idx - 5 AND so.session_idx + 20)),
org AS (SELECT o.series_id, o.session_idx AS origin, count(*) AS weight, any_value(vol) AS vol, any_value(mo) AS mo, any_value(yr) AS yr FROM so o JOIN cx USING (series_id, session_idx) WHERE o.session_idx > 1 GROUP BY 1, 2)"""

SQL_MATCH = """
mm AS (SELECT o.series_id, o.origin, o.weight, min_by(c.session_idx, (abs(c.vol - o.vol), c.session_idx)) AS m FROM org o JOIN cand c ON c.series_id = o.series_id AND c.mo = o.mo WHERE o.vol IS NOT NULL AND c.vol IS NOT NULL GROUP BY 1, 2, 3),
ma AS (SELECT o.series_id, o.origin, o.weight, min_by(c.session_idx, (abs(c.vol - o.vol), c.session_idx)) AS a FROM org o JOIN cand c ON c.series_id = o.series_id WHERE o.vol IS NOT NULL AND c.vol IS NOT NULL GROUP BY 1, 2, 3),
match AS (SELECT ma.series_id, ma.origin, ma.weight, coalesce(m, a) AS placebo FROM ma LEFT JOIN mm USING (series_id, origin))"""


@query("j17_volatility_match", ctes(SQL_ALIGNED, SQL_FREE, SQL_MATCH) + " SELECT series_id, origin, placebo FROM match")
def j17_volatility_match(spark, sf_dir):
    return matched(spark, sf_dir).select("series_id", "origin", "placebo")


@query("v11_placebo_study", ctes(SQL_FIT, SQL_FREE, SQL_MATCH, """
ks AS (SELECT unnest(range(-5, 21)) AS k),
pan AS (SELECT m.series_id, m.origin, m.weight, ks.k, f.fit_sigma, f.fit_n, f.factor_ss, x.log_return - f.fit_alpha - f.fit_beta * x.factor_ret AS ar, x.factor_ret - f.factor_mean AS fd
  FROM match m JOIN fit f ON f.series_id = m.series_id AND f.session_idx = m.placebo CROSS JOIN ks LEFT JOIN fit x ON x.series_id = m.series_id AND x.session_idx = m.placebo + ks.k - 1 WHERE f.fit_alpha IS NOT NULL),
rep AS (SELECT *, unnest(range(0, weight)) AS copy FROM pan),
cums AS (SELECT *, sum(coalesce(ar, 0)) OVER w AS car, sum(coalesce(fd, 0)) OVER w AS cdev, (k + 6)::DOUBLE AS nd FROM rep WINDOW w AS (PARTITION BY series_id, origin, copy ORDER BY k)),
scars AS (SELECT *, car / (fit_sigma * sqrt(nd + nd * nd / fit_n + cdev * cdev / factor_ss)) AS scar FROM cums)""") + f"""
SELECT CAST(k AS INTEGER) AS k, count(car) AS n_events, {r("avg(car)", 4, "caar")}, {r("avg(car) / (stddev_samp(car) / sqrt(count(car)))", 4, "t_cross")}, {r("sqrt(count(scar)) * avg(scar) / stddev_samp(scar)", 4, "t_bmp")} FROM scars GROUP BY 1""")
def v11_placebo_study(spark, sf_dir):
    """The event study on matched placebo origins; rejections there measure test size."""
    m = matched(spark, sf_dir)
    o = m.groupBy("series_id", F.col("placebo").alias("origin")).agg(F.sum("weight").alias("weight"))
    t = st.cross_section(st.standardised(st.cumulated(st.abnormal_panel(fitted(spark, sf_dir), o), -5), -5), [])
    return t.select("k", "n_events", *[rnd(c, 4).alias(c) for c in ("caar", "t_cross", "t_bmp")])


@query("v11_rejection_rate")
def v11_rejection_rate(spark, sf_dir):
    """Share of placebo event-time days with p below 5 %, per test."""
    m = matched(spark, sf_dir)
    o = m.groupBy("series_id", F.col("placebo").alias("origin")).agg(F.sum("weight").alias("weight"))
    t = st.with_p_values(st.event_study_table(fitted(spark, sf_dir), o, []))
    return t.agg(*[F.avg((F.col(p) < 0.05).cast("double")).alias(f"reject_{p[2:]}") for p in ("p_cross", "p_bmp", "p_rank", "p_kp")], F.count("*").alias("n_days"))


SQL_POOL = """
car AS (SELECT series_id, session_idx, """ + ", ".join(f"""CASE WHEN count(factor_ret) OVER w{h} = {h} THEN ln(lead(close, {h - 1}) OVER w / lag(close) OVER w) - {h} * fit_alpha - fit_beta * sum(factor_ret) OVER w{h} END AS car_{h}""" for h in pb.CAR_HORIZONS) + """
  FROM fit WINDOW w AS (PARTITION BY series_id ORDER BY date), """ + ", ".join(f"w{h} AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)" for h in pb.CAR_HORIZONS) + """),
oc AS (SELECT o.series_id, o.origin, o.yr, c.session_idx, c.yr AS cyr, c.mo = o.mo AS same, (o.vol > 0 AND c.vol > 0 AND greatest(c.vol / o.vol, o.vol / c.vol) <= 3) AS near FROM org o JOIN cand c USING (series_id)),
tr AS (SELECT *, CASE WHEN same AND cyr <> yr AND coalesce(near, false) THEN 1 WHEN same AND cyr <> yr THEN 2 WHEN same THEN 3 ELSE 4 END AS tier FROM oc),
tc AS (SELECT series_id, origin, sum((tier = 1)::INT) AS n1, sum((tier <= 2)::INT) AS n2, sum((tier <= 3)::INT) AS n3 FROM tr GROUP BY 1, 2),
pool AS (SELECT t.series_id, t.origin, t.session_idx, row_number() OVER (PARTITION BY t.series_id, t.origin ORDER BY t.session_idx) AS slot, count(*) OVER (PARTITION BY t.series_id, t.origin) AS size
  FROM tr t JOIN tc USING (series_id, origin) WHERE CASE WHEN n1 >= 10 THEN tier = 1 WHEN n2 > 0 THEN tier <= 2 WHEN n3 > 0 THEN tier <= 3 ELSE true END)"""


@query("j16_candidate_pools", ctes(SQL_FIT.replace("n >= 60", "n >= 50"), SQL_FREE, SQL_POOL) + """
SELECT series_id, origin, max(size)::BIGINT AS pool_size, min(session_idx) AS first_candidate, max(session_idx) AS last_candidate FROM pool GROUP BY 1, 2""")
def j16_candidate_pools(spark, sf_dir):
    p = pb.pools(origin_context(spark, sf_dir), free_sessions(spark, sf_dir), pb.session_car(fitted50(spark, sf_dir)))
    ids = F.transform("pool", lambda c: c["idx"])
    return p.select("series_id", "origin", F.size("pool").cast("long").alias("pool_size"), F.array_min(ids).alias("first_candidate"), F.array_max(ids).alias("last_candidate"))


@query("v12_randomisation_test", ctes(SQL_FIT.replace("n >= 60", "n >= 50"), SQL_FREE, SQL_POOL, """
ev AS (SELECT so.event_id, so.series_id, so.session_idx AS origin, p.size FROM so JOIN (SELECT DISTINCT series_id, origin, size FROM pool) p ON p.series_id = so.series_id AND p.origin = so.session_idx),
dr AS (SELECT event_id, series_id, origin, b, CAST(floor(('0x' || substr(md5('42:' || event_id || ':' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE * size) AS BIGINT) + 1 AS slot FROM ev, (SELECT unnest(range(0, 5000)) AS b)),
ds AS (SELECT b, avg(car_1) AS d1, avg(car_5) AS d5, avg(car_10) AS d10, avg(car_20) AS d20 FROM dr JOIN pool USING (series_id, origin, slot) JOIN car ON car.series_id = dr.series_id AND car.session_idx = pool.session_idx GROUP BY 1),
ob AS (SELECT avg(car_1) AS o1, avg(car_5) AS o5, avg(car_10) AS o10, avg(car_20) AS o20 FROM ev JOIN car ON car.series_id = ev.series_id AND car.session_idx = ev.origin),
lg AS (SELECT unnest([{'horizon': 1, 'd': d1, 'o': o1}, {'horizon': 5, 'd': d5, 'o': o5}, {'horizon': 10, 'd': d10, 'o': o10}, {'horizon': 20, 'd': d20, 'o': o20}], recursive := true) FROM ds, ob)""") + f"""
SELECT CAST(horizon AS INTEGER) AS horizon, {r("any_value(o)", 5, "observed")}, {r("avg(d)", 5, "placebo_mean")}, {r("stddev_samp(d)", 5, "placebo_sd")}, {r("quantile_cont(d, 0.025)", 5, "placebo_low")},
 {r("quantile_cont(d, 0.975)", 5, "placebo_high")}, {r("(1 + sum((abs(d) >= abs(o))::INT)) / (1 + count(*))", name="p_value")} FROM lg GROUP BY 1""")
def v12_randomisation_test(spark, sf_dir):
    cars = pb.session_car(fitted50(spark, sf_dir))
    p = pb.pools(origin_context(spark, sf_dir), free_sessions(spark, sf_dir), cars)
    days = cal.usable_origins(severe_days(spark, sf_dir)).select("series_id", "event_date", F.col("session_idx").alias("origin"))
    ev = severe(spark, sf_dir).join(days, ["series_id", "event_date"]).select("event_id", "series_id", "origin")
    t = pb.randomisation(ev, p, cars, PERMUTED)
    return t.select("horizon", *[rnd(c, 5).alias(c) for c in ("observed", "placebo_mean", "placebo_sd", "placebo_low", "placebo_high")], rnd("p_value").alias("p_value"))


@query("v13_matched_forecast", ctes(SQL_FIT, SQL_FREE, SQL_MATCH, """
xx AS (SELECT series_id, session_idx, date, lag(lret) OVER (PARTITION BY series_id ORDER BY date) AS x, 100 * ln(lead(close, 4) OVER (PARTITION BY series_id ORDER BY date) / lag(close) OVER (PARTITION BY series_id ORDER BY date)) AS y FROM lr),
bo AS (SELECT 'event' AS origin_type, series_id, origin, origin AS at_idx FROM match UNION ALL SELECT 'placebo', series_id, origin, placebo FROM match),
mr AS (SELECT b.*, xx.date, xx.x, xx.y, hash_key FROM bo b JOIN xx ON xx.series_id = b.series_id AND xx.session_idx = b.at_idx JOIN (SELECT series_id, origin, row_number() OVER (ORDER BY series_id, origin) AS hash_key FROM match) h ON h.series_id = b.series_id AND h.origin = b.origin WHERE xx.x IS NOT NULL AND xx.y IS NOT NULL),
o0 AS (SELECT *, year(date) * 12 + month(date) AS mo, min(year(date) * 12 + month(date)) OVER (PARTITION BY origin_type) AS m0, max(year(date) * 12 + month(date)) OVER (PARTITION BY origin_type) AS m1 FROM mr),
od AS (SELECT *, mo - m0 AS ord, m1 - m0 + 1 AS n, 30 AS tr, 10 AS te FROM o0),
fl AS (SELECT unnest(range(0, 10)) AS fold),
mem AS (SELECT fold, CASE WHEN ord < fold * te + tr THEN 'train' ELSE 'test' END AS role, od.* FROM od, fl
  WHERE n >= tr + te AND fold <= (n - tr - te) // te AND ord >= fold * te AND ord < fold * te + tr + te),
ln_ AS (SELECT origin_type, fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM mem WHERE role = 'train' GROUP BY 1, 2),
pr AS (SELECT m.origin_type, y AS y_true, a + b * x AS y_pred FROM mem m JOIN ln_ USING (origin_type, fold) WHERE role = 'test')""") + f"""
SELECT origin_type, count(*) AS n, {r("sqrt(avg((y_pred - y_true) ** 2))", 4, "rmse")}, {r("avg(abs(y_pred - y_true))", 4, "mae")}, {r("1 - sum((y_pred - y_true) ** 2) / (count(*) * var_pop(y_true))", 4, "r2")} FROM pr GROUP BY 1""")
def v13_matched_forecast(spark, sf_dir):
    """The same one-feature forecast on event origins and on their matched placebos."""
    m = matched(spark, sf_dir).select("series_id", "origin", "placebo")
    # one integer per match, by series and origin, as the position tie-breaker
    per = m.groupBy("series_id").agg(F.count("*").alias("_n"))
    off = per.select("series_id", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit("series")).orderBy("series_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    keyed = m.join(off, "series_id").withColumn("key", F.col("_o") + F.row_number().over(W.partitionBy("series_id").orderBy("origin")))
    both = keyed.withColumn("_x", F.explode(F.array(F.struct(F.lit("event").alias("origin_type"), F.col("origin").alias("session_idx")), F.struct(F.lit("placebo").alias("origin_type"), F.col("placebo").alias("session_idx")))))
    both = both.select("series_id", "key", "_x.*")
    f = features(spark, sf_dir).select("series_id", "session_idx", "date", F.lag("log_return").over(sr.w_series()).alias("x"), oc.forward_return(5).alias("y"))
    d = stage(both.join(f, ["series_id", "session_idx"]).where("x IS NOT NULL AND y IS NOT NULL"), "matched_rows")
    out = None
    for kind in ("event", "placebo"):
        mem = fd.fold_membership(*fd.month_positions(d.where(F.col("origin_type") == kind), "date"))
        line = mem.where("role = 'train'").groupBy("fold").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
        t = mem.where("role = 'test'").join(F.broadcast(line), "fold").select("origin_type", F.col("y").alias("y_true"), (F.col("a") + F.col("b") * F.col("x")).alias("y_pred"))  # one row per fold
        out = t if out is None else out.unionByName(t)
    t = mt.regression_metrics(out, ["origin_type"])
    return t.select("origin_type", "n", *[rnd(c, 4).alias(c) for c in ("rmse", "mae", "r2")])


@query("b04_metric_interval", ctes(SQL_OOF, "pr AS (SELECT target, series_id AS cluster, y_true, y_pred FROM oof WHERE model = 'ols')", _draw_sql("pr", ["target"], "cluster", NB), """
te AS (SELECT target, cluster, count(*)::DOUBLE AS n, sum((y_pred - y_true) ** 2) AS se, sum(y_true) AS sy, sum(y_true ** 2) AS syy FROM pr GROUP BY 1, 2),
ds AS (SELECT t.target, b, 1 - sum(w * se) / (sum(w * syy) - sum(w * sy) ** 2 / sum(w * n)) AS v FROM te t JOIN dr d ON d.target = t.target AND d.cluster = t.cluster GROUP BY 1, 2),
pt AS (SELECT target, sum(n)::BIGINT AS n, 1 - sum(se) / (sum(syy) - sum(sy) ** 2 / sum(n)) AS v FROM te GROUP BY 1)""") + f"""
SELECT pt.target, any_value(pt.n) AS n, {r("any_value(pt.v)", name="value")}, {r("quantile_cont(ds.v, 0.025)", name="ci_low")}, {r("quantile_cont(ds.v, 0.975)", name="ci_high")} FROM pt JOIN ds ON ds.target = pt.target GROUP BY 1""")
def b04_metric_interval(spark, sf_dir):
    """R2 as additive terms and a finaliser, resampled by series."""
    o = oof(spark, sf_dir).where("model = 'ols'")
    e = F.col("y_pred") - F.col("y_true")
    terms = {"n": F.lit(1.0), "se": e * e, "sy": F.col("y_true"), "syy": F.col("y_true") * F.col("y_true")}
    r2 = lambda t: 1 - t("se") / F.nullif(t("syy") - t("sy") * t("sy") / t("n"), F.lit(0.0))
    b = rs.metric_bootstrap(o, ["target"], "series_id", terms, r2, NB)
    return b.select("target", "n", *[rnd(c).alias(c) for c in ("value", "ci_low", "ci_high")])


def _minority(spark, sf_dir):
    """Train rows in the outer tenths of the response, features scaled by the spread of those rows."""
    train = rows(spark, sf_dir).where("role = 'train'")
    cut = exact_quantiles(train, ["fold"], "y", {"_lo": 0.1, "_hi": 0.9}).drop("n_total")
    few = train.join(F.broadcast(cut), "fold").where((F.col("y") < F.col("_lo")) | (F.col("y") > F.col("_hi")))  # one row per fold
    s = few.groupBy("fold").agg(*[F.avg(x).alias(f"_m_{x}") for x in XS], *[F.stddev_samp(x).alias(f"_s_{x}") for x in XS])
    j = few.join(F.broadcast(s), "fold")  # one row per fold
    return train, stage(j.select("fold", "type", "event_id", "event_date", *XS, "y", *[((F.col(x) - F.col(f"_m_{x}")) / F.col(f"_s_{x}")).alias(f"z{i + 1}") for i, x in enumerate(XS)]), "minority")


@query("c08_j18_interpolated_rows", ctes(SQL_ROWS, """
tr AS (SELECT * FROM rw WHERE role = 'train'),
qs AS (SELECT fold, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM tr GROUP BY 1),
m0 AS (SELECT tr.* FROM tr JOIN qs USING (fold) WHERE y < lo OR y > hi),
ss AS (SELECT fold, avg(x1) AS m1, avg(x2) AS m2, stddev_samp(x1) AS s1, stddev_samp(x2) AS s2 FROM m0 GROUP BY 1),
mi AS (SELECT m0.*, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM m0 JOIN ss USING (fold)),
pr AS (SELECT a.fold, a.type, a.event_id, b.event_id AS nb, a.x1, a.x2, a.y, b.x1 AS bx1, b.x2 AS bx2, b.y AS by_, abs(date_diff('day', a.event_date, b.event_date)) <= 5 * 365.25 AS inw, round((a.z1 - b.z1) ** 2 + (a.z2 - b.z2) ** 2, 12) AS d
  FROM mi a JOIN mi b ON a.fold = b.fold AND a.type = b.type AND a.event_id <> b.event_id),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, event_id ORDER BY inw DESC, d, nb) AS rn FROM pr) WHERE rn = 1),
sy AS (SELECT *, ('0x' || substr(md5('42:' || event_id || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM pk)""") + f"""
SELECT fold, type, event_id, nb AS neighbour, inw AS in_window, {r("x1 + u * (bx1 - x1)", 5, "x1")}, {r("x2 + u * (bx2 - x2)", 5, "x2")}, {r("y + u * (by_ - y)", 4, "y")} FROM sy""")
def c08_j18_interpolated_rows(spark, sf_dir):
    train, minority = _minority(spark, sf_dir)
    s = ag.interpolated(train, minority, ["fold", "type"], XS, "y")
    return s.select("fold", "type", "event_id", "neighbour", "in_window", rnd("x1", 5).alias("x1"), rnd("x2", 5).alias("x2"), rnd("y", 4).alias("y"))


#: Every column that does not follow from others.
BASE_COLUMNS = [*XS, "severity", "affected"]

SQL_WIDE = """
tr AS (SELECT rw.*, severity, affected FROM rw JOIN (SELECT event_id, severity, affected FROM shocks) USING (event_id) WHERE role = 'train'),
qs AS (SELECT fold, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM tr GROUP BY 1),
m0 AS (SELECT tr.* FROM tr JOIN qs USING (fold) WHERE y < lo OR y > hi),
ss AS (SELECT fold, """ + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_samp({c}), 0), 1) AS s_{c}" for c in BASE_COLUMNS) + """ FROM m0 GROUP BY 1),
mi AS (SELECT m0.*, """ + ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in BASE_COLUMNS) + """ FROM m0 JOIN ss USING (fold)),
pr AS (SELECT a.fold, a.type, a.event_id, b.event_id AS nb, a.y, b.y AS by_, """ + ", ".join(f"a.{c}, b.{c} AS b_{c}" for c in BASE_COLUMNS) + """,
  abs(date_diff('day', a.event_date, b.event_date)) <= 5 * 365.25 AS inw, round(""" + " + ".join(f"(a.z_{c} - b.z_{c}) ** 2" for c in BASE_COLUMNS) + """, 12) AS d
  FROM mi a JOIN mi b ON a.fold = b.fold AND a.type = b.type AND a.event_id <> b.event_id),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, event_id ORDER BY inw DESC, d, nb) AS rn FROM pr) WHERE rn = 1),
sy AS (SELECT *, ('0x' || substr(md5('42:' || event_id || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM pk),
mx AS (SELECT fold, type, event_id, nb, inw, y + u * (by_ - y) AS y, """ + ", ".join(f"{c} + u * (b_{c} - {c}) AS {c}" for c in BASE_COLUMNS) + """ FROM sy)"""


def wide_minority(spark, sf_dir):
    """Train rows with every base column, and the minority with their z-scores over each fold's minority."""
    train = rows(spark, sf_dir).where("role = 'train'").join(shocks(spark, sf_dir).select("event_id", "severity", "affected"), "event_id")
    cut = exact_quantiles(train, ["fold"], "y", {"_lo": 0.1, "_hi": 0.9}).drop("n_total")
    few = train.join(F.broadcast(cut), "fold").where((F.col("y") < F.col("_lo")) | (F.col("y") > F.col("_hi")))  # one row per fold
    return train, stage(ag.scaled(few.select("fold", "type", "event_id", "event_date", *BASE_COLUMNS, "y"), ["fold"], BASE_COLUMNS), "minority")


@query("c08_all_columns", ctes(SQL_ROWS, SQL_WIDE) + f"""
SELECT fold, type, event_id, nb AS neighbour, inw AS in_window, {r("x1", 5, "x1")}, {r("x2", 5, "x2")}, {r("severity", 2, "severity")}, {r("affected", 2, "affected")}, {r("y", 4, "y")},
  {r("ln(1 + greatest(severity, 0))", 5, "log_severity")}, {r("CASE WHEN type = 'BUILDING' THEN ln(1 + greatest(severity, 0)) ELSE 0 END", 5, "log_severity_x_building")} FROM mx""")
def c08_all_columns(spark, sf_dir):
    """Interpolation by the nearest row in all base columns; columns that follow from them are derived anew."""
    train, few = wide_minority(spark, sf_dir)
    s = ag.interpolated(train, few, ["fold", "type"], BASE_COLUMNS, "y", columns=tuple(f"z_{c}" for c in BASE_COLUMNS), derive=derive)
    return s.select("fold", "type", "event_id", "neighbour", "in_window", rnd("x1", 5).alias("x1"), rnd("x2", 5).alias("x2"), rnd("severity", 2).alias("severity"), rnd("affected", 2).alias("affected"),
                    rnd("y", 4).alias("y"), rnd("log_severity", 5).alias("log_severity"), rnd("log_severity_x_building", 5).alias("log_severity_x_building"))


@query("c08_pair_report", ctes(SQL_ROWS, SQL_WIDE) + """
SELECT m.fold, count(*) AS n_minority, count(p.inw) FILTER (p.inw) AS pairs_in_window, count(p.inw) FILTER (NOT p.inw) AS pairs_window_relaxed,
  2 * count(p.inw) AS n_synthetic, count(*) - count(p.inw) AS skipped_no_partner
FROM mi m LEFT JOIN pk p ON p.fold = m.fold AND p.event_id = m.event_id GROUP BY 1""")
def c08_pair_report(spark, sf_dir):
    """What the pairing of each fold came to, with two synthetic rows a pair."""
    train, few = wide_minority(spark, sf_dir)
    s = ag.interpolated(train, few, ["fold", "type"], BASE_COLUMNS, "y", copies=2, max_share=1.0, columns=tuple(f"z_{c}" for c in BASE_COLUMNS))
    return ag.pair_report(few, s, ["fold"])
