"""Event alignment, as-of joins, series windows and event outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.scalars import rnd
from tremor.operators import calendar as cal
from tremor.operators import outcomes as oc
from tremor.operators import series as sr
from tremor.plans.registry import ctes, query, r
from tremor.session import staged_once
from tremor.sources.adapters import (
    SQL_FACTOR,
    SQL_ORIGIN,
    SQL_SESS,
    SQL_SHOCKS,
    factor,
    sessions,
    shocks,
    table,
)


def outcomes(spark, sf_dir):
    """Staged event outcomes, the table later stages start from."""
    return staged_once(
        spark, sf_dir, "outcomes",
        lambda: oc.event_outcomes(shocks(spark, sf_dir), sessions(spark, sf_dir)),
    )


def features(spark, sf_dir):
    return staged_once(
        spark, sf_dir, "features", lambda: sr.market_features(sessions(spark, sf_dir))
    )


def fitted(spark, sf_dir):
    """Sessions with aligned factor and market-model fit."""

    def build():
        aligned = cal.align_factor(sessions(spark, sf_dir), factor(spark, sf_dir))
        return sr.market_model(aligned.withColumn("log_return", sr.log_return()), "log_return", "factor_ret")

    return staged_once(spark, sf_dir, "fitted", build)


SQL_OUT_BASE = f"""{SQL_SESS},{SQL_SHOCKS},{SQL_ORIGIN},
win AS (
  SELECT series_id, session_idx, date,
    lag(close) OVER w AS p0,
    {", ".join(f"100 * ln(lead(close, {h - 1}) OVER w / lag(close) OVER w) AS y1_{h}, lead(date, {h - 1}) OVER w AS y1_{h}_end" for h in oc.RETURN_HORIZONS)},
    CASE WHEN count(*) OVER b = 30 THEN avg(volume) OVER b END AS v_base,
    {", ".join(f"CASE WHEN count(*) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) = {w} THEN avg(volume) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) END AS vf{w}, lead(date, {w - 1}) OVER w AS vd{w}" for w in oc.VOLUME_WINDOWS)},
    min(close) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gate,
    max(session_idx) OVER (PARTITION BY series_id) AS last_idx
  FROM sess
  WINDOW w AS (PARTITION BY series_id ORDER BY date),
         b AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))"""

SQL_OUT = f"""{SQL_OUT_BASE},
ordered AS (
  SELECT s.*, o.session_idx,
    lead(o.session_idx) OVER (PARTITION BY s.series_id ORDER BY s.event_date, s.event_id) AS next_idx
  FROM shocks s LEFT JOIN origin o USING (event_id)),
ev AS (
  SELECT o.*, w.* EXCLUDE (series_id, session_idx),
    CASE WHEN o.next_idx IS NOT NULL THEN greatest(0, o.next_idx - o.session_idx + 1) END AS t_next
  FROM ordered o JOIN win w ON w.series_id = o.series_id AND w.session_idx = o.session_idx
  WHERE o.session_idx > 1),
scan AS (
  SELECT w.series_id, w.session_idx, x.session_idx - w.session_idx + 1 AS k, x.close, w.p0
  FROM win w JOIN sess x ON x.series_id = w.series_id
    AND x.session_idx BETWEEN w.session_idx AND w.session_idx + 89),
dips AS (SELECT series_id, session_idx, min(k) AS dip FROM scan WHERE close < p0 GROUP BY 1, 2),
recs AS (
  SELECT s.series_id, s.session_idx, min(k) AS t_rec FROM scan s JOIN dips d USING (series_id, session_idx)
  WHERE s.close >= s.p0 AND s.k > d.dip GROUP BY 1, 2),
st AS (
  SELECT e.*, rc.t_rec, (e.gate < e.p0) AS drawdown,
    CASE WHEN NOT (e.gate < e.p0) THEN 'no_drawdown'
         WHEN t_rec IS NULL THEN CASE WHEN t_next < 90 THEN 'next_disaster' ELSE '90_day_cap' END
         WHEN t_rec < coalesce(t_next, 1000000) AND t_rec <= 90 THEN 'recovered'
         WHEN t_next <= 90 THEN 'next_disaster' ELSE '90_day_cap' END AS reason
  FROM ev e LEFT JOIN recs rc ON rc.series_id = e.series_id AND rc.session_idx = e.session_idx),
outc AS (
  SELECT *, CAST(CASE reason WHEN 'no_drawdown' THEN 0 WHEN 'recovered' THEN t_rec
                 ELSE least(90, coalesce(t_next, 90)) END AS DOUBLE) AS duration,
    CASE WHEN reason = 'recovered' THEN 1 ELSE 0 END AS event_observed,
    {", ".join(f"ln(vf{w} / v_base) AS y2_{w}" for w in oc.VOLUME_WINDOWS)}
  FROM st)"""


@query("q0_forward_outcomes", ctes(SQL_OUT_BASE) + f"""
SELECT o.event_id, o.series_id, o.event_date, w.date AS origin_date, {r("w.y1_5", name="y1_5")},
  CASE WHEN w.y1_5 IS NOT NULL THEN w.y1_5_end END AS y1_5_end,
  {r("ln(w.vf5 / w.v_base)", name="y2_5")}
FROM origin o JOIN win w ON w.series_id = o.series_id AND w.session_idx = o.session_idx
WHERE o.session_idx > 1""")
def q0_forward_outcomes(spark, sf_dir):
    """Forward return and abnormal volume per event: the flagship plan."""
    events, ses = shocks(spark, sf_dir), sessions(spark, sf_dir)
    values = ses.select(
        "series_id", "session_idx",
        oc.forward_return(5).alias("y1_5"),
        oc.forward_return_end(5).alias("y1_5_end"),
        F.log(oc.volume_future(5) / oc.volume_base()).alias("y2_5"),
    )
    days = cal.usable_origins(cal.event_days(events, ses)).join(values, ["series_id", "session_idx"])
    return events.join(days, ["series_id", "event_date"]).select(
        "event_id", "series_id", "event_date", "origin_date",
        rnd("y1_5").alias("y1_5"), "y1_5_end", rnd("y2_5").alias("y2_5"),
    )


@query("j01_origin_session", ctes(SQL_SESS, SQL_SHOCKS, SQL_ORIGIN) + """
SELECT s.event_id, s.series_id, s.event_date, o.session_idx, x.date AS origin_date
FROM shocks s LEFT JOIN origin o USING (event_id)
LEFT JOIN sess x ON x.series_id = o.series_id AND x.session_idx = o.session_idx""")
def j01_origin_session(spark, sf_dir):
    out = cal.asof_forward(
        shocks(spark, sf_dir),
        sessions(spark, sf_dir).select("series_id", "date", "session_idx"),
        ["series_id"], "event_date", "date",
    )
    return out.select("event_id", "series_id", "event_date", "session_idx", F.col("date").alias("origin_date"))


SNAP = ["log_return", "price_to_sma_20", "rolling_std_20", "vol_ratio_5_30"]


@query("j02_snapshot_asof", ctes(SQL_SESS, SQL_SHOCKS, """
f AS (SELECT series_id, date, ln(close / lag(close) OVER w) AS log_return,
  CASE WHEN count(*) OVER b = 20 THEN lag(close) OVER w / avg(close) OVER b - 1 END AS price_to_sma_20
  FROM sess WINDOW w AS (PARTITION BY series_id ORDER BY date),
  b AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""") + f"""
SELECT s.event_id, f.date AS snapshot_date, {r("f.log_return", name="log_return")},
  {r("f.price_to_sma_20", name="price_to_sma_20")}
FROM shocks s ASOF LEFT JOIN f ON f.series_id = s.series_id AND s.event_date - INTERVAL 1 DAY >= f.date""")
def j02_snapshot_asof(spark, sf_dir):
    """Features as of the day before the event."""
    left = shocks(spark, sf_dir).select("event_id", "series_id", F.date_sub("event_date", 1).alias("as_of"))
    right = features(spark, sf_dir).select("series_id", "date", "log_return", "price_to_sma_20")
    out = cal.asof_backward(left, right, ["series_id"], "as_of", "date")
    return out.select(
        "event_id", F.col("date").alias("snapshot_date"),
        rnd("log_return").alias("log_return"), rnd("price_to_sma_20").alias("price_to_sma_20"),
    )


@query("j03_daily_panel_carry", ctes(SQL_SESS, SQL_SHOCKS, """
lastev AS (SELECT series_id, event_date, max_by(severity, event_id) AS severity, max(event_id) AS event_id
           FROM shocks GROUP BY 1, 2)""") + """
SELECT s.series_id, s.date, CAST(l.event_id AS DOUBLE) AS last_event_id, l.event_date AS last_event_date, l.severity AS last_severity
FROM sess s ASOF LEFT JOIN lastev l ON l.series_id = s.series_id AND s.date >= l.event_date""")
def j03_daily_panel_carry(spark, sf_dir):
    """The latest event carried on every session."""
    latest = shocks(spark, sf_dir).groupBy("series_id", "event_date").agg(
        F.max_by("severity", "event_id").alias("severity"), F.max("event_id").alias("event_id")
    )
    ses = sessions(spark, sf_dir).select("series_id", "date")
    out = cal.asof_backward(ses, latest, ["series_id"], "date", "event_date")
    return out.select(
        "series_id", "date", F.col("event_id").cast("double").alias("last_event_id"),
        F.col("event_date").alias("last_event_date"), F.col("severity").alias("last_severity"),
    )


@query("j04_session_offset_windows", ctes(SQL_SESS, SQL_SHOCKS, SQL_ORIGIN, """
org AS (SELECT DISTINCT series_id, session_idx FROM origin WHERE session_idx > 1),
ks AS (SELECT unnest(range(-5, 21)) AS k)""") + """
SELECT o.series_id, o.session_idx, CAST(ks.k AS INTEGER) AS k, s.date, s.close
FROM org o CROSS JOIN ks JOIN sess s ON s.series_id = o.series_id AND s.session_idx = o.session_idx + ks.k - 1""")
def j04_session_offset_windows(spark, sf_dir):
    """Sessions at offsets -5..20 of every distinct origin, as an equi-join."""
    ses = sessions(spark, sf_dir)
    days = cal.usable_origins(cal.event_days(shocks(spark, sf_dir), ses))
    spans = days.select("series_id", "session_idx").distinct().withColumn(
        "k", F.explode(F.sequence(F.lit(-5), F.lit(20)))
    )
    right = ses.select("series_id", F.col("session_idx").alias("_row"), "date", "close")
    return spans.withColumn("_row", F.col("session_idx") + F.col("k") - 1).join(
        right, ["series_id", "_row"]
    ).select("series_id", "session_idx", "k", "date", "close")


@query("j06_nearest_poll", ctes(SQL_SHOCKS, """
polls AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE day(o_orderdate) = 15 AND month(o_orderdate) IN (3, 9)),
days AS (SELECT DISTINCT event_date FROM shocks),
gaps AS (SELECT event_date, date_diff('day', event_date, d) AS gap,
  row_number() OVER (PARTITION BY event_date ORDER BY abs(date_diff('day', event_date, d)), d) AS rn
  FROM days, polls)""") + """
SELECT s.event_id, CAST(g.gap AS INTEGER) AS poll_gap_days, CAST(abs(g.gap) AS INTEGER) AS poll_distance
FROM shocks s JOIN gaps g ON g.event_date = s.event_date AND g.rn = 1""")
def j06_nearest_poll(spark, sf_dir):
    """Signed distance to the nearest fixed calendar date (half-yearly, mid-March and mid-September)."""
    polls = (
        table(spark, sf_dir, "orders")
        .select(F.to_date("o_orderdate").alias("d")).distinct()
        .where((F.dayofmonth("d") == 15) & F.month("d").isin(3, 9))
        .withColumn("_k", F.lit(1))
    )
    left = shocks(spark, sf_dir).select("event_id", "event_date").withColumn("_k", F.lit(1))
    days = left.select("_k", "event_date").distinct()
    out = cal.nearest(days, polls, ["_k"], "event_date", "d", "poll_gap_days").drop("_k")
    return left.join(out, "event_date").select(
        "event_id", "poll_gap_days", F.abs("poll_gap_days").alias("poll_distance")
    )


SQL_ALIGNED = f"""{SQL_SESS},{SQL_FACTOR},
cumf AS (SELECT date, sum(ret) OVER (ORDER BY date) AS level FROM factor WHERE ret IS NOT NULL),
aligned AS (
  SELECT s.*, c.level - lag(c.level) OVER (PARTITION BY s.series_id ORDER BY s.date) AS factor_ret,
    ln(s.close / lag(s.close) OVER (PARTITION BY s.series_id ORDER BY s.date)) AS log_return
  FROM sess s ASOF LEFT JOIN cumf c ON s.date >= c.date)"""


@query("j07_align_factor", ctes(SQL_ALIGNED) + f"""
SELECT series_id, date, {r("factor_ret", name="factor_ret")} FROM aligned""")
def j07_align_factor(spark, sf_dir):
    out = cal.align_factor(sessions(spark, sf_dir), factor(spark, sf_dir))
    return out.select("series_id", "date", rnd("factor_ret").alias("factor_ret"))


@query("j08_left_join_source_tag", ctes("""
price AS (SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 6) AS close FROM orders GROUP BY 1),
vol AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS volume FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)""") + f"""
SELECT date, close, {r("volume", 2, "volume")}, CASE WHEN volume IS NULL THEN 'missing' ELSE 'trades' END AS volume_source
FROM price LEFT JOIN vol USING (date)""")
def j08_left_join_source_tag(spark, sf_dir):
    price = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("close")
    )
    vol = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").groupBy(
        F.to_date("l_shipdate").alias("date")
    ).agg(F.sum("l_quantity").alias("volume"), F.lit("trades").alias("src"))
    return price.join(vol, "date", "left").select(
        "date", "close", rnd("volume", 2).alias("volume"), F.coalesce("src", F.lit("missing")).alias("volume_source")
    )


@query("j10_competing_event", ctes(SQL_SESS, SQL_SHOCKS, SQL_ORIGIN, """
ordered AS (SELECT s.event_id, s.series_id, o.session_idx,
  lead(o.session_idx) OVER (PARTITION BY s.series_id ORDER BY s.event_date, s.event_id) AS next_idx
  FROM shocks s LEFT JOIN origin o USING (event_id))""") + """
SELECT event_id, session_idx, CAST(CASE WHEN next_idx IS NOT NULL THEN greatest(0, next_idx - session_idx + 1) END AS DOUBLE) AS t_next FROM ordered WHERE session_idx > 1""")
def j10_competing_event(spark, sf_dir):
    events = shocks(spark, sf_dir)
    days = cal.usable_origins(cal.event_days(events, sessions(spark, sf_dir)))
    out = cal.sessions_to_next(events.join(days, ["series_id", "event_date"]))
    return out.select("event_id", "session_idx", F.col("t_next").cast("double"))


@query("j11_splice_series", ctes("""
a AS (SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 6) AS close, count(*) AS volume
      FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1),
b AS (SELECT CAST(o_orderdate AS DATE) AS date, round(max(o_totalprice), 4) AS close FROM orders GROUP BY 1)""") + """
SELECT date, close, CAST(volume AS DOUBLE) AS volume FROM a UNION ALL
SELECT date, close, NULL FROM b WHERE date > (SELECT max(date) FROM a)""")
def j11_splice_series(spark, sf_dir):
    """Archive rows win; the extension only adds later dates, with the volume missing."""
    orders = table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    base = orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp")).groupBy("date").agg(
        F.round(F.avg("o_totalprice"), 6).alias("close"), F.count("*").cast("double").alias("volume")
    ).withColumn("k", F.lit(1))
    ext = orders.groupBy("date").agg(F.round(F.max("o_totalprice"), 4).alias("close")).withColumn("k", F.lit(1))
    return cal.splice_after(base, ext, ["k"], "date").select("date", "close", "volume")


@query("j12_overlap_check", ctes("""
a AS (SELECT CAST(o_orderdate AS DATE) AS date, round(avg(o_totalprice), 6) AS va FROM orders GROUP BY 1),
b AS (SELECT CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice), 6) AS vb FROM lineitem GROUP BY 1)""") + f"""
SELECT count(*) AS n_overlap, CAST(sum(CASE WHEN abs(va - vb) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_exact,
  {r("max(abs(va - vb))", 3, "max_abs_diff")}, {r("avg(abs(va - vb))", 3, "mean_abs_diff")}
FROM a JOIN b USING (date)""")
def j12_overlap_check(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("va"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.round(F.avg("l_extendedprice"), 6).alias("vb"))
    out = cal.overlap_check(a, b, ["date"], "va", "vb")
    return out.select("n_overlap", "n_exact", rnd("max_abs_diff", 3).alias("max_abs_diff"),
                      rnd("mean_abs_diff", 3).alias("mean_abs_diff"))


@query("j15_unblocked_sessions", ctes(SQL_SESS, SQL_SHOCKS, SQL_ORIGIN) + """
SELECT s.series_id, s.session_idx, s.date FROM sess s
WHERE NOT EXISTS (SELECT 1 FROM origin o WHERE o.series_id = s.series_id
  AND s.session_idx BETWEEN o.session_idx - 5 AND o.session_idx + 20)""")
def j15_unblocked_sessions(spark, sf_dir):
    ses = sessions(spark, sf_dir)
    days = cal.event_days(shocks(spark, sf_dir), ses)
    return cal.unblocked_sessions(ses, days).select("series_id", "session_idx", "date")


def _frame(w, what):
    return f"CASE WHEN count({what}) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) = {w}"


def _agg(fn, w, what):
    return (f"{_frame(w, what)} THEN {fn}({what}) OVER (PARTITION BY series_id ORDER BY date "
            f"ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) END")


SQL_RET = f"""{SQL_SESS},
rets AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY series_id ORDER BY date)) AS log_return,
  lag(close) OVER (PARTITION BY series_id ORDER BY date) AS p1,
  lag(volume) OVER (PARTITION BY series_id ORDER BY date) AS v1,
  lag(volume, 2) OVER (PARTITION BY series_id ORDER BY date) AS v2 FROM sess)"""


@query("w01_w02_returns_and_lags", ctes(SQL_RET) + f"""
SELECT series_id, date, {r("log_return", name="log_return")},
  {", ".join(r(f"lag(log_return, {k}) OVER (PARTITION BY series_id ORDER BY date)", name=f"lag_return_{k}") for k in (1, 2, 3, 5))},
  {r("log_return * log_return", name="squared_return")} FROM rets""")
def w01_w02_returns_and_lags(spark, sf_dir):
    f = features(spark, sf_dir)
    cols = ["log_return", *[f"lag_return_{k}" for k in (1, 2, 3, 5)], "squared_return"]
    return f.select("series_id", "date", *[rnd(c).alias(c) for c in cols])


@query("w03_w05_moving_means", ctes(SQL_RET, f"""
m AS (SELECT series_id, date, p1, {", ".join(_agg("avg", w, "close") + f" AS sma_{w}" for w in (5, 10, 20))} FROM rets)""") + f"""
SELECT series_id, date, {", ".join(r(f"sma_{w}", 6, f"sma_{w}") + ", " + r(f"p1 / sma_{w} - 1", name=f"price_to_sma_{w}") for w in (5, 10, 20))} FROM m""")
def w03_w05_moving_means(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select(
        "series_id", "date", *[rnd(f"sma_{w}", 6).alias(f"sma_{w}") for w in (5, 10, 20)],
        *[rnd(f"price_to_sma_{w}").alias(f"price_to_sma_{w}") for w in (5, 10, 20)],
    )


def _sql_ema(w):
    a = 2.0 / (w + 1)
    return (f"list_reduce(list(close) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING), "
            f"lambda acc, x: acc * (1 - {a!r}::DOUBLE) + x * {a!r}::DOUBLE)")


@query("w04_exponential_means", ctes(SQL_RET, f"""
m AS (SELECT series_id, date, session_idx, p1, {", ".join(f"CASE WHEN session_idx > {w} THEN {_sql_ema(w)} END AS ema_{w}" for w in (5, 10, 20))} FROM rets)""") + f"""
SELECT series_id, date, {", ".join(r(f"ema_{w}", 6, f"ema_{w}") + ", " + r(f"p1 / ema_{w} - 1", name=f"price_to_ema_{w}") for w in (5, 10, 20))} FROM m""")
def w04_exponential_means(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select(
        "series_id", "date", *[rnd(f"ema_{w}", 6).alias(f"ema_{w}") for w in (5, 10, 20)],
        *[rnd(f"price_to_ema_{w}").alias(f"price_to_ema_{w}") for w in (5, 10, 20)],
    )


@query("w06_rolling_volatility", ctes(SQL_RET) + f"""
SELECT series_id, date, {", ".join(r(_agg("stddev_samp", w, "log_return"), name=f"rolling_std_{w}") for w in (5, 10, 20, 30))} FROM rets""")
def w06_rolling_volatility(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select("series_id", "date", *[rnd(f"rolling_std_{w}").alias(f"rolling_std_{w}") for w in (5, 10, 20, 30)])


@query("w08_volume_block", ctes(SQL_RET, f"""
m AS (SELECT series_id, date, v1, v2, {", ".join(_agg("avg", w, "volume") + f" AS vm{w}" for w in (5, 10, 30))},
  {_agg("stddev_samp", 30, "volume")} AS vs30 FROM rets)""") + f"""
SELECT series_id, date, {r("v1 / vm30 - 1", name="vol_ratio_1_30")}, {r("vm5 / vm30 - 1", name="vol_ratio_5_30")},
  {r("vm10 / vm30 - 1", name="vol_ratio_10_30")}, {r("vs30 / vm30", name="vol_cv_30")}, {r("ln(v1 / v2)", name="log_vol_change_1")}
FROM m""")
def w08_volume_block(spark, sf_dir):
    f = features(spark, sf_dir)
    cols = ["vol_ratio_1_30", "vol_ratio_5_30", "vol_ratio_10_30", "vol_cv_30", "log_vol_change_1"]
    return f.select("series_id", "date", *[rnd(c).alias(c) for c in cols])


@query("w09_forward_fill", ctes(SQL_SESS, """
gappy AS (SELECT series_id, date, CASE WHEN volume > close THEN volume END AS multi_volume FROM sess)""") + """
SELECT series_id, date, last_value(multi_volume IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS multi_volume FROM gappy""")
def w09_forward_fill(spark, sf_dir):
    gappy = sessions(spark, sf_dir).select(
        "series_id", "date", F.when(F.col("volume") > F.col("close"), F.col("volume")).alias("multi_volume")
    )
    return sr.forward_fill(gappy, ["multi_volume"])


@query("w14_realised_volatility", ctes(SQL_RET) + f"""
SELECT series_id, date, {r('''CASE WHEN count(*) OVER f >= 5 AND count(log_return) OVER f = count(*) OVER f
  THEN stddev_samp(log_return) OVER f END''', name="realised_vol")}
FROM rets WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def w14_realised_volatility(spark, sf_dir):
    df = sessions(spark, sf_dir).withColumn("log_return", sr.log_return())
    return df.select("series_id", "date", rnd(sr.realised_volatility()).alias("realised_vol"))


@query("w15_regime_features", ctes(SQL_RET, """
g AS (SELECT *, lag(close, 6) OVER w AS l5, lag(close, 11) OVER w AS l10, lag(close, 21) OVER w AS l20,
  CASE WHEN count(*) OVER f20 = 20 THEN avg(volume) OVER f5 / avg(volume) OVER f20 END AS vr
  FROM rets WINDOW w AS (PARTITION BY series_id ORDER BY date),
   f20 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
   f5 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
pairs AS (SELECT a.series_id, a.session_idx, b.session_idx AS j, b.close,
   max(b.close) OVER (PARTITION BY a.series_id, a.session_idx ORDER BY b.session_idx) AS peak
   FROM sess a JOIN sess b ON a.series_id = b.series_id AND b.session_idx BETWEEN a.session_idx - 20 AND a.session_idx - 1),
dd AS (SELECT series_id, session_idx, min(close / peak - 1) AS mdd, count(*) AS n FROM pairs GROUP BY 1, 2)""") + f"""
SELECT g.series_id, g.date, {r("p1 / l5 - 1", name="momentum_5")}, {r("p1 / l10 - 1", name="momentum_10")},
  {r("p1 / l20 - 1", name="momentum_20")}, {r("CASE WHEN dd.n = 20 THEN mdd END", name="max_drawdown_20")}, {r("vr", name="vol_ratio_5_20")}
FROM g LEFT JOIN dd USING (series_id, session_idx)""")
def w15_regime_features(spark, sf_dir):
    f = sr.regime_features(sessions(spark, sf_dir))
    cols = ["momentum_5", "momentum_10", "momentum_20", "max_drawdown_20", "vol_ratio_5_20"]
    return f.select("series_id", "date", *[rnd(c).alias(c) for c in cols])


@query("w17_forward_label_every_session", ctes(SQL_SESS) + f"""
SELECT series_id, date, {", ".join(r(f"100 * ln(lead(close, {h - 1}) OVER w / lag(close) OVER w)", name=f"fwd_{h}") for h in oc.RETURN_HORIZONS)}
FROM sess WINDOW w AS (PARTITION BY series_id ORDER BY date)""")
def w17_forward_label_every_session(spark, sf_dir):
    return sessions(spark, sf_dir).select(
        "series_id", "date", *[rnd(oc.forward_return(h)).alias(f"fwd_{h}") for h in oc.RETURN_HORIZONS]
    )


@query("e01_forward_returns", ctes(SQL_OUT_BASE) + f"""
SELECT o.event_id, {", ".join(r(f"w.y1_{h}", name=f"y1_{h}") + f", w.y1_{h}_end AS y1_{h}_end" for h in oc.RETURN_HORIZONS)}
FROM origin o JOIN win w ON w.series_id = o.series_id AND w.session_idx = o.session_idx WHERE o.session_idx > 1""")
def e01_forward_returns(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    cols = [c for h in oc.RETURN_HORIZONS for c in (rnd(f"y1_{h}").alias(f"y1_{h}"), F.col(f"y1_{h}_end"))]
    return o.select("event_id", *cols)


@query("e02_abnormal_volume", ctes(SQL_OUT_BASE) + f"""
SELECT o.event_id, {r("w.v_base", 4, "v_base")}, {r("w.vf5", 4, "v_future5")},
  {", ".join(r(f"ln(vf{w} / v_base)", name=f"y2_{w}") + f", CASE WHEN vf{w} / v_base IS NOT NULL THEN vd{w} END AS y2_{w}_end" for w in oc.VOLUME_WINDOWS)}
FROM origin o JOIN win w ON w.series_id = o.series_id AND w.session_idx = o.session_idx WHERE o.session_idx > 1""")
def e02_abnormal_volume(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    cols = [c for w in oc.VOLUME_WINDOWS for c in (rnd(f"y2_{w}").alias(f"y2_{w}"), F.col(f"y2_{w}_end"))]
    return o.select("event_id", rnd("v_base", 4).alias("v_base"), rnd("v_future5", 4).alias("v_future5"), *cols)


@query("e03_drawdown_gate", ctes(SQL_OUT_BASE) + """
SELECT o.event_id, w.p0, w.gate AS gate_low, w.gate < w.p0 AS drawdown
FROM origin o JOIN win w ON w.series_id = o.series_id AND w.session_idx = o.session_idx WHERE o.session_idx > 1""")
def e03_drawdown_gate(spark, sf_dir):
    events, ses = shocks(spark, sf_dir), sessions(spark, sf_dir)
    gate = ses.select(
        "series_id", "session_idx", F.lag("close").over(sr.w_series()).alias("p0"),
        F.min("close").over(sr.w_series().rowsBetween(0, oc.GATE - 1)).alias("gate_low"),
    )
    days = cal.usable_origins(cal.event_days(events, ses)).join(gate, ["series_id", "session_idx"])
    return events.join(days, ["series_id", "event_date"]).select(
        "event_id", "p0", "gate_low", (F.col("gate_low") < F.col("p0")).alias("drawdown")
    )


@query("e04_recovery_time", ctes(SQL_OUT) + """
SELECT event_id, duration, event_observed, reason, drawdown, CAST(t_next AS DOUBLE) AS t_next FROM outc""")
def e04_recovery_time(spark, sf_dir):
    return outcomes(spark, sf_dir).select(
        "event_id", "duration", "event_observed", "reason", "drawdown", F.col("t_next").cast("double")
    )


@query("e05_recovery_label_end", ctes(SQL_OUT) + """
SELECT o.event_id, s.date AS y3_end, (o.session_idx + 89 > o.last_idx) AS series_truncated
FROM outc o JOIN sess s ON s.series_id = o.series_id
 AND s.session_idx = least(o.session_idx + greatest(CAST(o.duration AS BIGINT) - 1, 0), o.last_idx)""")
def e05_recovery_label_end(spark, sf_dir):
    return outcomes(spark, sf_dir).select("event_id", "y3_end", "series_truncated")


@query("e06_event_outcomes", ctes(SQL_OUT, """
cuts AS (SELECT quantile_cont(y2_5, 0.05) AS lo, quantile_cont(y2_5, 0.95) AS hi FROM outc)""") + f"""
SELECT event_id, series_id, event_date, date AS origin_date, p0, {r("y1_5", name="y1_5")}, {r("y2_5", name="y2_5")},
  {r("100 * (exp(y2_5) - 1)", 4, "y2_5_pct")}, {r("CASE WHEN y2_5 IS NOT NULL THEN greatest(least(y2_5, hi), lo) END", name="y2_5_wins")},
  duration, event_observed, event_observed = 0 AS censored, reason
FROM outc, cuts""")
def e06_event_outcomes(spark, sf_dir):
    o = oc.winsorised(outcomes(spark, sf_dir), "y2_5", "y2_5_wins")
    return o.select(
        "event_id", "series_id", "event_date", "origin_date", "p0", rnd("y1_5").alias("y1_5"),
        rnd("y2_5").alias("y2_5"), rnd("y2_5_pct", 4).alias("y2_5_pct"), rnd("y2_5_wins").alias("y2_5_wins"),
        "duration", "event_observed", "censored", "reason",
    )


SQL_FIT = f"""{SQL_ALIGNED},
fitraw AS (
  SELECT *, regr_count(y, x) OVER f AS n, regr_sxx(y, x) OVER f AS sxx, regr_sxy(y, x) OVER f AS sxy,
    regr_syy(y, x) OVER f AS syy, regr_avgx(y, x) OVER f AS mx, regr_avgy(y, x) OVER f AS my
  FROM (SELECT *, CASE WHEN log_return IS NOT NULL AND factor_ret IS NOT NULL THEN log_return END AS y,
          CASE WHEN log_return IS NOT NULL AND factor_ret IS NOT NULL THEN factor_ret END AS x FROM aligned)
  WINDOW f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
fit AS (
  SELECT series_id, date, session_idx, close, volume, log_return, factor_ret,
    CASE WHEN ok THEN my - sxy / sxx * mx END AS fit_alpha, CASE WHEN ok THEN sxy / sxx END AS fit_beta,
    CASE WHEN ok THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2)) END AS fit_sigma,
    CASE WHEN ok THEN n END AS fit_n, CASE WHEN ok THEN mx END AS factor_mean, CASE WHEN ok THEN sxx END AS factor_ss
  FROM (SELECT *, n >= 60 AND sxx > 0 AS ok FROM fitraw))"""


@query("e07_market_model", ctes(SQL_FIT) + f"""
SELECT series_id, date, {r("fit_alpha", 5, "fit_alpha")}, {r("fit_beta", 5, "fit_beta")}, {r("fit_sigma", 5, "fit_sigma")},
  CAST(fit_n AS DOUBLE) AS fit_n FROM fit""")
def e07_market_model(spark, sf_dir):
    f = fitted(spark, sf_dir)
    return f.select("series_id", "date", *[rnd(c, 5).alias(c) for c in ("fit_alpha", "fit_beta", "fit_sigma")], F.col("fit_n").cast("double"))


@query("e08_e09_abnormal_returns", ctes(SQL_FIT, SQL_SHOCKS, SQL_ORIGIN, f"""
ab AS (SELECT series_id, session_idx, fit_n, {", ".join(f'''
  CASE WHEN count(factor_ret) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) = {h}
  THEN 100 * ({h} * fit_alpha + fit_beta * sum(factor_ret) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)) END AS ex_{h},
  100 * ln(lead(close, {h - 1}) OVER w / lag(close) OVER w) AS y_{h}''' for h in oc.RETURN_HORIZONS)}, fit_alpha, fit_beta, fit_sigma
  FROM fit WINDOW w AS (PARTITION BY series_id ORDER BY date))""") + f"""
SELECT o.event_id, CAST(coalesce(fit_n, 0) AS BIGINT) AS fit_n, {", ".join(r(c, 5, c) for c in ("fit_alpha", "fit_beta", "fit_sigma"))},
 {", ".join(r(f"y_{h} - ex_{h}", 4, f"ab_{h}") for h in oc.RETURN_HORIZONS)}
FROM origin o JOIN ab USING (series_id, session_idx) WHERE o.session_idx > 1""")
def e08_e09_abnormal_returns(spark, sf_dir):
    events, ses = shocks(spark, sf_dir), sessions(spark, sf_dir)
    ab = oc.abnormal_returns(fitted(spark, sf_dir)).drop("date")
    days = cal.usable_origins(cal.event_days(events, ses)).join(ab, ["series_id", "session_idx"])
    return events.join(days, ["series_id", "event_date"]).select(
        "event_id", "fit_n", *[rnd(c, 5).alias(c) for c in ("fit_alpha", "fit_beta", "fit_sigma")], *[rnd(f"ab_{h}", 4).alias(f"ab_{h}") for h in oc.RETURN_HORIZONS]
    )


@query("e14_direction_labels", ctes(SQL_OUT_BASE) + f"""
SELECT o.event_id, {", ".join(f"CAST(w.y1_{h} < 0 AS INTEGER)::DOUBLE AS down_{h}" for h in oc.RETURN_HORIZONS)}
FROM origin o JOIN win w ON w.series_id = o.series_id AND w.session_idx = o.session_idx WHERE o.session_idx > 1""")
def e14_direction_labels(spark, sf_dir):
    return outcomes(spark, sf_dir).select(
        "event_id", *[(F.col(f"y1_{h}") < 0).cast("int").cast("double").alias(f"down_{h}") for h in oc.RETURN_HORIZONS]
    )


@query("e15_series_event_panel", ctes(SQL_OUT_BASE, """
long AS (SELECT series_id FROM sess GROUP BY 1 HAVING count(*) >= 60),
days AS (SELECT DISTINCT event_date, dense_rank() OVER (ORDER BY event_date) - 1 AS event_code FROM (SELECT DISTINCT event_date FROM shocks)),
dayorg AS (SELECT d.event_code, d.event_date, x.series_id, min(x.session_idx) AS session_idx
  FROM days d JOIN sess x ON x.date >= d.event_date JOIN long USING (series_id) GROUP BY 1, 2, 3)""") + f"""
SELECT d.series_id, d.event_code, d.event_date, {r("w.y1_5", name="y1_5")}, {r("ln(w.vf5 / w.v_base)", name="y2_5")}
FROM dayorg d JOIN win w ON w.series_id = d.series_id AND w.session_idx = d.session_idx WHERE d.session_idx > 1""")
def e15_series_event_panel(spark, sf_dir):
    """Every event day read on every series with at least 60 sessions."""
    o = panel(spark, sf_dir)
    return o.select("series_id", "event_code", "event_date", rnd("y1_5").alias("y1_5"), rnd("y2_5").alias("y2_5"))


def panel(spark, sf_dir):
    return staged_once(
        spark, sf_dir, "panel",
        lambda: oc.series_panel(sessions(spark, sf_dir), shocks(spark, sf_dir)),
    )
