"""Event-study inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions.scalars import rnd
from tremor.operators import calendar as cal
from tremor.operators import cross_corr as cc
from tremor.operators import series as sr
from tremor.operators import study as st
from tremor.plans.outcome_queries import SQL_FIT, fitted
from tremor.plans.registry import ctes, query, r
from tremor.session import stage, staged_once
from tremor.sources.adapters import SQL_ORIGIN, SQL_SESS, SQL_SHOCKS, sessions, shocks


def origins(spark, sf_dir):
    return staged_once(
        spark, sf_dir, "origins",
        lambda: st.weighted_origins(cal.event_days(shocks(spark, sf_dir), sessions(spark, sf_dir))),
    )


def volume_fitted(spark, sf_dir):
    """Mean-adjusted model of the log volume."""

    def build():
        s = sessions(spark, sf_dir).withColumn("log_volume", F.when(F.col("volume") > 0, F.log("volume")))
        return sr.mean_model(s, "log_volume").withColumn("factor_ret", F.lit(0.0))

    return staged_once(spark, sf_dir, "volume_fitted", build)


#: The panel over CTEs ``fit`` and ``origin``, whatever model made the fit.
_PANEL = """
ks AS (SELECT unnest(range(-5, 21)) AS k),
pan AS (
  SELECT o.event_id, o.series_id, o.session_idx AS origin, ks.k, f.fit_alpha, f.fit_beta, f.fit_sigma, f.fit_n, f.factor_ss,
    x.log_return - f.fit_alpha - f.fit_beta * x.factor_ret AS ar, x.factor_ret - f.factor_mean AS fd
  FROM origin o JOIN fit f USING (series_id, session_idx) CROSS JOIN ks
  LEFT JOIN fit x ON x.series_id = o.series_id AND x.session_idx = o.session_idx + ks.k - 1
  WHERE o.session_idx > 1 AND f.fit_alpha IS NOT NULL),
cums AS (
  SELECT *, sum(coalesce(ar, 0)) OVER w AS car, sum(coalesce(fd, 0)) OVER w AS cdev, CAST(k + 6 AS DOUBLE) AS nd
  FROM pan WINDOW w AS (PARTITION BY event_id ORDER BY k)),
scars AS (SELECT *, car / (fit_sigma * sqrt(nd + nd * nd / fit_n + cdev * cdev / factor_ss)) AS scar FROM cums)"""

SQL_PANEL = f"{SQL_FIT},{SQL_SHOCKS},{SQL_ORIGIN},{_PANEL}"

SQL_TESTS = """
tests AS (SELECT k, count(car) AS n_events, avg(car) AS caar, avg(car) - 1.96 * stddev_samp(car) / sqrt(count(car)) AS ci_low,
  avg(car) + 1.96 * stddev_samp(car) / sqrt(count(car)) AS ci_high,
  avg(car) / (stddev_samp(car) / sqrt(count(car))) AS t_cross, sqrt(count(scar)) * avg(scar) / stddev_samp(scar) AS t_bmp
  FROM scars GROUP BY k)"""

SQL_RANKS = """
obs AS (
  SELECT o.event_id, NULL AS k, x.log_return - f.fit_alpha - f.fit_beta * x.factor_ret AS v
  FROM origin o JOIN fit f USING (series_id, session_idx)
  JOIN fit x ON x.series_id = o.series_id AND x.session_idx BETWEEN o.session_idx - 250 AND o.session_idx - 1
  WHERE f.fit_alpha IS NOT NULL AND x.log_return IS NOT NULL AND x.factor_ret IS NOT NULL
  UNION ALL SELECT event_id, k, ar FROM pan WHERE ar IS NOT NULL),
devs AS (SELECT event_id, k, rank() OVER (PARTITION BY event_id ORDER BY v) + (count(*) OVER (PARTITION BY event_id, v) - 1) / 2.0
   - (count(*) OVER (PARTITION BY event_id) + 1) / 2.0 AS dev FROM obs),
dm AS (SELECT k, avg(dev) AS m FROM devs WHERE k IS NOT NULL GROUP BY k),
ranks AS (SELECT k, sum(m) OVER (ORDER BY k) / (sqrt(count(*) OVER (ORDER BY k)) * (SELECT sqrt(avg(m * m)) FROM dm)) AS t_rank FROM dm)"""


def _panel(spark, sf_dir):
    return st.abnormal_panel(fitted(spark, sf_dir), origins(spark, sf_dir))


@query("v01_abnormal_panel", ctes(SQL_PANEL) + f"""
SELECT DISTINCT series_id, origin, CAST(k AS INTEGER) AS k, {r("ar", 5, "ar")}, {r("fd", 5, "factor_dev")} FROM pan""")
def v01_abnormal_panel(spark, sf_dir):
    return _panel(spark, sf_dir).select("series_id", "origin", "k", rnd("ar", 5).alias("ar"), rnd("factor_dev", 5).alias("factor_dev"))


_VARIANTS = ("zero_expected", "mean_adjusted", "market", "lagged_market")


@query("v02_panel_variants", ctes(SQL_PANEL, """
al AS (SELECT series_id, date, session_idx, log_return AS y0, lag(factor_ret) OVER (PARTITION BY series_id ORDER BY date) AS x0 FROM fit),
lraw AS (SELECT *, regr_count(y, x) OVER f AS n, regr_sxx(y, x) OVER f AS sxx, regr_sxy(y, x) OVER f AS sxy, regr_avgx(y, x) OVER f AS mx, regr_avgy(y, x) OVER f AS my,
   count(y0) OVER f AS n0, avg(y0) OVER f AS m0
  FROM (SELECT *, CASE WHEN x0 IS NOT NULL THEN y0 END AS y, CASE WHEN y0 IS NOT NULL THEN x0 END AS x FROM al)
  WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
lfit AS (SELECT *, CASE WHEN n >= 60 AND sxx > 0 THEN my - sxy / sxx * mx END AS a, CASE WHEN n >= 60 AND sxx > 0 THEN sxy / sxx END AS b, CASE WHEN n0 >= 60 THEN m0 END AS mean FROM lraw),
ov AS (SELECT ks.k, f.a, f.b, f.mean, x.y0, x.x0 FROM origin o JOIN lfit f USING (series_id, session_idx) CROSS JOIN ks
  JOIN lfit x ON x.series_id = o.series_id AND x.session_idx = o.session_idx + ks.k - 1 WHERE o.session_idx > 1)""") + f"""
SELECT 'zero_expected' AS variant, CAST(k AS INTEGER) AS k, count(y0) AS n_events, {r("avg(y0)", 5, "aar")} FROM ov GROUP BY k UNION ALL
SELECT 'mean_adjusted', CAST(k AS INTEGER), count(y0 - mean), {r("avg(y0 - mean)", 5)} FROM ov GROUP BY k UNION ALL
SELECT 'lagged_market', CAST(k AS INTEGER), count(y0 - a - b * x0), {r("avg(y0 - a - b * x0)", 5)} FROM ov GROUP BY k UNION ALL
SELECT 'market', CAST(k AS INTEGER), count(ar), {r("avg(ar)", 5)} FROM pan GROUP BY k""")
def v02_panel_variants(spark, sf_dir):
    """Mean abnormal value per k under four expectation models, each with a fit of its own."""
    f, o = fitted(spark, sf_dir), origins(spark, sf_dir)
    plain = f.drop("fit_alpha", "fit_beta", "fit_sigma", "fit_n", "factor_mean", "factor_ss")
    lagged = plain.withColumn("factor_ret", F.lag("factor_ret").over(sr.w_series()))
    flat = plain.withColumn("factor_ret", F.lit(0.0))
    none = {c: F.lit(0.0) for c in ("fit_alpha", "fit_beta", "fit_sigma", "factor_mean", "factor_ss")}
    models = (flat.withColumns(none | {"fit_n": F.lit(0).cast("long")}), sr.mean_model(flat, "log_return"), f, sr.market_model(lagged, "log_return", "factor_ret"))
    out = None
    for name, fit in zip(_VARIANTS, models, strict=True):
        p = st.abnormal_panel(fit, o, "log_return", "factor_ret").where(F.col("ar").isNotNull())
        part = p.groupBy("k").agg(
            F.sum("weight").alias("n_events"),
            (F.sum(F.col("weight") * F.col("ar")) / F.sum("weight")).alias("aar"),
        ).select(F.lit(name).alias("variant"), "k", "n_events", rnd("aar", 5).alias("aar"))
        out = part if out is None else out.unionByName(part)
    return out


@query("v03_v05_v06_cross_section", ctes(SQL_PANEL, SQL_TESTS) + f"""
SELECT CAST(k AS INTEGER) AS k, n_events, {", ".join(r(c, 4, c) for c in ("caar", "ci_low", "ci_high", "t_cross", "t_bmp"))} FROM tests""")
def v03_v05_v06_cross_section(spark, sf_dir):
    t = st.cross_section(st.standardised(st.cumulated(_panel(spark, sf_dir), -5), -5), [])
    return t.select("k", "n_events", *[rnd(c, 4).alias(c) for c in ("caar", "ci_low", "ci_high", "t_cross", "t_bmp")])


SQL_PAIRS = """
wo AS (SELECT series_id, session_idx AS origin, count(*) AS weight FROM origin WHERE session_idx > 1 GROUP BY 1, 2),
est AS (SELECT w.series_id, w.origin, w.weight, x.session_idx AS row, x.log_return - f.fit_alpha - f.fit_beta * x.factor_ret AS resid
  FROM wo w JOIN fit f ON f.series_id = w.series_id AND f.session_idx = w.origin
  JOIN fit x ON x.series_id = w.series_id AND x.session_idx BETWEEN w.origin - 250 AND w.origin - 1
  WHERE f.fit_alpha IS NOT NULL AND x.log_return IS NOT NULL AND x.factor_ret IS NOT NULL),
prs AS (SELECT a.series_id, a.origin, b.origin - a.origin AS lag, count(*) AS n, corr(a.resid, b.resid) AS r,
  CASE WHEN a.origin = b.origin THEN any_value(a.weight) * (any_value(a.weight) - 1) / 2.0 ELSE any_value(a.weight) * any_value(b.weight) END AS pw
  FROM est a JOIN est b ON a.series_id = b.series_id AND a.row = b.row AND a.origin <= b.origin
  GROUP BY a.series_id, a.origin, b.origin HAVING count(*) >= 10)"""


#: All pairs of events by the dates that both windows share, whatever their series.
SQL_ALL_PAIRS = """
wo AS (SELECT series_id, session_idx AS origin, count(*) AS weight FROM origin WHERE session_idx > 1 GROUP BY 1, 2),
est AS (SELECT dense_rank() OVER (ORDER BY w.series_id, w.origin) AS nr, w.weight, x.date, x.log_return - f.fit_alpha - f.fit_beta * x.factor_ret AS resid
  FROM wo w JOIN fit f ON f.series_id = w.series_id AND f.session_idx = w.origin
  JOIN fit x ON x.series_id = w.series_id AND x.session_idx BETWEEN w.origin - 250 AND w.origin - 1
  WHERE f.fit_alpha IS NOT NULL AND x.log_return IS NOT NULL AND x.factor_ret IS NOT NULL),
pr AS (SELECT a.nr, any_value(CASE WHEN a.nr = b.nr THEN a.weight * (a.weight - 1) / 2.0 ELSE a.weight * b.weight END) AS pw, corr(a.resid, b.resid) AS r
  FROM est a JOIN est b ON a.date = b.date AND a.nr <= b.nr GROUP BY a.nr, b.nr HAVING count(*) >= 10),
prs AS (SELECT pw, r FROM pr WHERE pw > 0 AND r IS NOT NULL AND NOT isnan(r)),
mc AS (SELECT sum(pw * r) / sum(pw) AS c FROM prs)"""


def pooled_corr(f, o, value="log_return", factor="factor_ret"):
    """Correlation of all pairs of events, within and across series."""
    return cc.pair_correlation_summary(f, o, value, factor, median=False)


@query("j19_v04_all_pairs", ctes(SQL_FIT, SQL_SHOCKS, SQL_ORIGIN, SQL_ALL_PAIRS, """
upto AS (SELECT r, sum(sum(pw)) OVER (ORDER BY r) AS upto FROM prs GROUP BY r),
tot AS (SELECT sum(pw) AS n, sum(pw * r) / sum(pw) AS m FROM prs),
ev AS (SELECT sum(weight) AS w FROM wo JOIN fit f ON f.series_id = wo.series_id AND f.session_idx = wo.origin WHERE f.fit_alpha IS NOT NULL)""") + f"""
SELECT CAST(n AS BIGINT) AS n_pairs, {r("m", 6, "mean_corr")},
  {r("((SELECT min(r) FROM upto WHERE upto > floor((n - 1) / 2)) + (SELECT min(r) FROM upto WHERE upto > ceil((n - 1) / 2))) / 2", 6, "median_corr")},
  CAST(w * (w - 1) / 2 AS BIGINT) AS n_pairs_total FROM tot, ev""")
def j19_v04_all_pairs(spark, sf_dir):
    """Mean and median residual correlation over all pairs of events with enough shared dates."""
    t = cc.pair_correlation_summary(fitted(spark, sf_dir), origins(spark, sf_dir))
    return t.select("n_pairs", rnd("mean_corr", 6).alias("mean_corr"), rnd("median_corr", 6).alias("median_corr"), "n_pairs_total")


@query("v04_date_sum_correlation", ctes(SQL_FIT, SQL_SHOCKS, SQL_ORIGIN, SQL_ALL_PAIRS, """
zz AS (SELECT date, weight AS w, (resid - avg(resid) OVER e) / stddev_pop(resid) OVER e AS z FROM est WINDOW e AS (PARTITION BY nr)),
dd AS (SELECT date, sum(w * z) AS s, sum(w * z * z) AS q, sum(w) AS n FROM zz GROUP BY date)""") + f"""
SELECT {r("sum(s * s - q) / sum(n * (n - 1))", 6, "date_sum_corr")}, CAST(sum(n * (n - 1)) / 2 AS BIGINT) AS n_date_pairs FROM dd""")
def v04_date_sum_correlation(spark, sf_dir):
    t = cc.date_sum_correlation(fitted(spark, sf_dir), origins(spark, sf_dir))
    return t.select(rnd("date_sum_corr", 6).alias("date_sum_corr"), "n_date_pairs")


@query("j19_v04_pair_correlations", ctes(SQL_FIT, SQL_SHOCKS, SQL_ORIGIN, SQL_PAIRS) + f"""
SELECT series_id, CAST(sum(pw) AS BIGINT) AS n_pairs, {r("sum(pw * r) / sum(pw)", 4, "mean_corr")} FROM prs WHERE pw > 0 GROUP BY 1""")
def j19_v04_pair_correlations(spark, sf_dir):
    p = st.pair_correlations(fitted(spark, sf_dir), origins(spark, sf_dir), "log_return", "factor_ret")
    return st.mean_correlation(p, ["series_id"]).select("series_id", "n_pairs", rnd("mean_corr", 4).alias("mean_corr"))


@query("v08_rank_test", ctes(SQL_PANEL, SQL_RANKS) + f"""
SELECT CAST(k AS INTEGER) AS k, {r("t_rank", 4, "t_rank")} FROM ranks""")
def v08_rank_test(spark, sf_dir):
    f, o = fitted(spark, sf_dir), origins(spark, sf_dir)
    d = st.rank_deviation(st.estimation_long(f, o, "log_return", "factor_ret"), st.abnormal_panel(f, o))
    return st.rank_test(d, -5, []).select("k", rnd("t_rank", 4).alias("t_rank"))


SQL_TABLE = f"""
SELECT CAST(k AS INTEGER) AS k, n_events, {", ".join(r(c, 4, c) for c in ("caar", "ci_low", "ci_high", "t_cross", "t_bmp", "t_rank"))},
  {r("t_bmp * sqrt((1 - c) / (1 + (n_events - 1) * c))", 4, "t_kp")}, {r("c", 4, "mean_corr")}
FROM tests JOIN ranks USING (k), mc"""


def _table(t):
    cols = ["caar", "ci_low", "ci_high", "t_cross", "t_bmp", "t_rank", "t_kp", "mean_corr"]
    return t.select("k", "n_events", *[rnd(c, 4).alias(c) for c in cols])


@query("v07_v09_event_study_table", ctes(SQL_PANEL, SQL_TESTS, SQL_RANKS, SQL_ALL_PAIRS) + SQL_TABLE)
def v07_v09_event_study_table(spark, sf_dir):
    f, o = fitted(spark, sf_dir), origins(spark, sf_dir)
    return _table(st.event_study_table(f, o, [], corr=pooled_corr(f, o)))


@query("f12_event_study_p_values")
def f12_event_study_p_values(spark, sf_dir):
    """The study table with p-values per series."""
    t = st.event_study_table(fitted(spark, sf_dir), origins(spark, sf_dir), ["series_id"])
    return st.with_p_values(t)


SQL_LOG_VOLUME = """
lv AS (SELECT *, CASE WHEN volume > 0 THEN ln(volume) END AS v FROM sess)"""


def _mean_fit(y: str, of: str) -> str:
    """CTE ``fit`` of the mean-adjusted model of a column over a CTE with sessions."""
    return f"""
fit AS (SELECT series_id, date, session_idx, {y} AS log_return, 0.0::DOUBLE AS factor_ret, CASE WHEN count({y}) OVER f >= 60 THEN avg({y}) OVER f END AS fit_alpha, 0.0::DOUBLE AS fit_beta,
   stddev_samp({y}) OVER f AS fit_sigma, count({y}) OVER f AS fit_n, 0.0::DOUBLE AS factor_mean, 1.0::DOUBLE AS factor_ss FROM {of}
  WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING))"""


def _zero_fit(y: str, of: str) -> str:
    return f"""
fit AS (SELECT series_id, date, session_idx, {y} AS log_return, 0.0::DOUBLE AS factor_ret, CASE WHEN count({y}) OVER f >= 60 THEN 0.0::DOUBLE END AS fit_alpha, 0.0::DOUBLE AS fit_beta,
   sqrt(sum({y} * {y}) OVER f / greatest(count({y}) OVER f - 1, 1)) AS fit_sigma, count({y}) OVER f AS fit_n, 0.0::DOUBLE AS factor_mean, 1.0::DOUBLE AS factor_ss FROM {of}
  WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING))"""


def _volume_table(spark, sf_dir):
    f, o = volume_fitted(spark, sf_dir), origins(spark, sf_dir)
    return _table(st.event_study_table(f, o, [], value="log_volume", corr=pooled_corr(f, o, "log_volume")))


_SQL_VOLUME = f"WITH {SQL_LOG_VOLUME},{_mean_fit('v', 'lv')},{_PANEL},{SQL_TESTS},{SQL_RANKS},{SQL_ALL_PAIRS}{SQL_TABLE}"


@query("v10_volume_study", ctes(SQL_SESS, SQL_SHOCKS, SQL_ORIGIN, SQL_LOG_VOLUME, _mean_fit("v", "lv"), _PANEL, SQL_TESTS, SQL_RANKS, SQL_ALL_PAIRS) + SQL_TABLE)
def v10_volume_study(spark, sf_dir):
    """The whole table for log volume under the mean-adjusted model."""
    return _volume_table(spark, sf_dir)


@query("v09_v10_both_series", ctes(SQL_PANEL, SQL_TESTS, SQL_RANKS, SQL_ALL_PAIRS, f"ret AS ({SQL_TABLE}), vol AS ({_SQL_VOLUME})") + """
SELECT 'return' AS series, * FROM ret UNION ALL SELECT 'volume' AS series, * FROM vol""")
def v09_v10_both_series(spark, sf_dir):
    """Returns under the market model and log volume under the mean-adjusted model, in one table."""
    return v07_v09_event_study_table(spark, sf_dir).select(F.lit("return").alias("series"), "*").unionByName(_volume_table(spark, sf_dir).select(F.lit("volume").alias("series"), "*"))


#: (series, variant): the fit of a variant; the factor plays no part in the volume's mean model.
_STUDIES = (
    ("return", "contemporaneous"), ("return", "lagged"), ("return", "constant_mean"), ("return", "zero_expected"),
    ("volume", "contemporaneous"), ("volume", "lagged"), ("volume", "constant_mean"), ("volume", "zero_expected"),
)


def _variant_fit(spark, sf_dir, series: str, variant: str):
    """Sessions with ``value``, ``factor_ret`` and the fit of one study variant."""
    fit_columns = ("fit_alpha", "fit_beta", "fit_sigma", "fit_n", "factor_mean", "factor_ss")
    if series == "volume":
        f = volume_fitted(spark, sf_dir).withColumnRenamed("log_volume", "value")
        if variant != "zero_expected":
            return f
        change = F.col("value") - F.lag("value").over(sr.w_series())
        return sr.zero_model(f.drop(*fit_columns).withColumn("value", change), "value")
    f = fitted(spark, sf_dir).withColumnRenamed("log_return", "value")
    if variant == "contemporaneous":
        return f
    plain = f.drop(*fit_columns)
    if variant == "lagged":
        return sr.market_model(plain.withColumn("factor_ret", F.lag("factor_ret").over(sr.w_series())), "value", "factor_ret")
    flat = plain.withColumn("factor_ret", F.lit(0.0))
    return sr.mean_model(flat, "value") if variant == "constant_mean" else sr.zero_model(flat, "value")


_SQL_LAGGED = """
lx AS (SELECT *, lag(factor_ret) OVER (PARTITION BY series_id ORDER BY date) AS x0 FROM aligned),
fl AS (SELECT *, regr_count(y, x) OVER f AS n, regr_sxx(y, x) OVER f AS sxx, regr_sxy(y, x) OVER f AS sxy,
    regr_syy(y, x) OVER f AS syy, regr_avgx(y, x) OVER f AS mx, regr_avgy(y, x) OVER f AS my
  FROM (SELECT *, CASE WHEN x0 IS NOT NULL THEN log_return END AS y, CASE WHEN log_return IS NOT NULL THEN x0 END AS x FROM lx)
  WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
fit AS (SELECT series_id, date, session_idx, log_return, x0 AS factor_ret, CASE WHEN ok THEN my - sxy / sxx * mx END AS fit_alpha, CASE WHEN ok THEN sxy / sxx END AS fit_beta,
    CASE WHEN ok THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) END AS fit_sigma, CASE WHEN ok THEN n END AS fit_n, CASE WHEN ok THEN mx END AS factor_mean, CASE WHEN ok THEN sxx END AS factor_ss
  FROM (SELECT *, n >= 60 AND sxx > 0 AS ok FROM fl))"""

_SQL_CHANGE = "lc AS (SELECT *, v - lag(v) OVER (PARTITION BY series_id ORDER BY date) AS dv FROM lv)"


def _sql_variants() -> str:
    fits = {
        "return contemporaneous": None, "return lagged": _SQL_LAGGED, "return constant_mean": _mean_fit("log_return", "aligned"), "return zero_expected": _zero_fit("log_return", "aligned"),
        "volume constant_mean": f"{SQL_LOG_VOLUME},{_mean_fit('v', 'lv')}", "volume zero_expected": f"{SQL_LOG_VOLUME},{_SQL_CHANGE},{_zero_fit('dv', 'lc')}",
    }
    tables = [f"t{k} AS (WITH {fit + ',' if fit else ''}{_PANEL},{SQL_TESTS},{SQL_RANKS},{SQL_ALL_PAIRS}{SQL_TABLE})" for k, fit in enumerate(fits.values())]
    place = {name: k for k, name in enumerate(fits)}
    rows = [f"SELECT '{s}' AS series, '{v}' AS variant, * FROM t{place.get(f'{s} {v}', place['volume constant_mean'])}" for s, v in _STUDIES]
    return ctes(SQL_FIT, SQL_SHOCKS, SQL_ORIGIN, *tables) + " UNION ALL ".join(rows)


@query("v02_variant_tests", _sql_variants())
def v02_variant_tests(spark, sf_dir):
    """The whole table of tests for each series and expected-value model, the volume's log change under a zero one."""
    o, out, made = origins(spark, sf_dir), None, {}
    for series, variant in _STUDIES:
        key = (series, variant if series == "return" or variant == "zero_expected" else "constant_mean")
        if key not in made:
            f = stage(_variant_fit(spark, sf_dir, *key), "variant")
            made[key] = stage(_table(st.event_study_table(f, o, [], value="value", corr=pooled_corr(f, o, "value"))), "variant-table")
        part = made[key].select(F.lit(series).alias("series"), F.lit(variant).alias("variant"), "*")
        out = part if out is None else out.unionByName(part)
    return out
