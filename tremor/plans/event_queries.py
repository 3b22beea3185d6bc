"""Event-table operators, side series, sources and sinks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tremor.functions import scalars as sc
from tremor.functions.scalars import rnd
from tremor.operators import calendar as cal
from tremor.operators import events as ev
from tremor.operators import sides as sd
from tremor.plans.registry import ctes, query, r
from tremor.session import shared_dir
from tremor.sources import readers as rd
from tremor.sources import sinks as sk
from tremor.sources.adapters import SQL_ORIGIN, SQL_SESS, SQL_SHOCKS, sessions, shocks, table


def _new(spark, name):
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


@query("p01_inclusion_filter", ctes(SQL_SHOCKS) + """
SELECT event_id, type, affected FROM shocks WHERE lower(trim(type)) NOT IN ('machinery') AND affected >= 1000""")
def p01_inclusion_filter(spark, sf_dir):
    e = ev.included(shocks(spark, sf_dir), "type", "affected", ["machinery"], 1000)
    return e.select("event_id", "type", "affected")


SQL_TYPED = """
typed AS (SELECT event_id, CASE WHEN affected > 9990 THEN type || '-' || CAST(event_id AS VARCHAR) ELSE type END AS type FROM shocks)"""


def _typed(spark, sf_dir):
    rare = F.concat_ws("-", "type", F.col("event_id").cast("string"))
    return shocks(spark, sf_dir).select("event_id", F.when(F.col("affected") > 9990, rare).otherwise(F.col("type")).alias("type"))


@query("p02_rare_type_pooling", ctes(SQL_SHOCKS, SQL_TYPED) + """
SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY type) < 3 THEN 'Other' ELSE type END AS type FROM typed""")
def p02_rare_type_pooling(spark, sf_dir):
    return ev.pooled_types(_typed(spark, sf_dir), "type").select("event_id", "type")


@query("p03_one_hot", ctes(SQL_SHOCKS) + """
SELECT event_id, CASE WHEN type = 'BUILDING' THEN 1.0::DOUBLE ELSE 0 END AS type_BUILDING,
  CASE WHEN type = 'FURNITURE' THEN 1.0::DOUBLE ELSE 0 END AS type_FURNITURE FROM shocks""")
def p03_one_hot(spark, sf_dir):
    e = ev.one_hot(shocks(spark, sf_dir), "type", ["BUILDING", "FURNITURE"], "type")
    return e.select("event_id", "type_BUILDING", "type_FURNITURE")


@query("p04_series_truncation", ctes(SQL_SESS, SQL_SHOCKS, """
pick AS (SELECT series_id, max(event_date) AS d FROM shocks WHERE event_date < DATE '2000-01-01' GROUP BY 1),
bound AS (SELECT p.series_id, min(x.session_idx) + 20 - 1 AS b FROM pick p JOIN sess x ON x.series_id = p.series_id AND x.date >= p.d GROUP BY 1)""") + """
SELECT s.series_id, s.date, s.session_idx FROM sess s JOIN bound USING (series_id) WHERE s.session_idx <= b""")
def p04_series_truncation(spark, sf_dir):
    """Each series cut 20 sessions after the origin of its last event in the study period."""
    study = shocks(spark, sf_dir).where(F.col("event_date") < F.lit("2000-01-01").cast("date"))
    ses = sessions(spark, sf_dir)
    return cal.truncate_series(ses, study, tail=20).select("series_id", "date", "session_idx")


@query("p05_study_period_violations", ctes(SQL_SHOCKS) + """
SELECT series_id, count(*) AS n_late, max(event_date) AS last_date FROM shocks WHERE event_date > DATE '2001-06-30' GROUP BY 1""")
def p05_study_period_violations(spark, sf_dir):
    late = shocks(spark, sf_dir).where(F.col("event_date") > F.lit("2001-06-30").cast("date"))
    return late.groupBy("series_id").agg(F.count("*").alias("n_late"), F.max("event_date").alias("last_date"))


@query("p10_subgroup_checks", ctes(SQL_SHOCKS) + """
SELECT name, sum(keep)::BIGINT AS n_kept FROM (
  SELECT 'all' AS name, 1 AS keep FROM shocks UNION ALL
  SELECT 'inside_crisis', CASE WHEN event_date BETWEEN DATE '1997-07-01' AND DATE '1998-12-31' THEN 1 ELSE 0 END FROM shocks UNION ALL
  SELECT 'outside_crisis', CASE WHEN event_date BETWEEN DATE '1997-07-01' AND DATE '1998-12-31' THEN 0 ELSE 1 END FROM shocks UNION ALL
  SELECT 'exact_status', CASE WHEN status = 'F' THEN 1 ELSE 0 END FROM shocks UNION ALL
  SELECT 'building_only', CASE WHEN type = 'BUILDING' THEN 1 ELSE 0 END FROM shocks) GROUP BY 1""")
def p10_subgroup_checks(spark, sf_dir):
    """Each check is one predicate; all are counted in one scan."""
    inside = F.col("event_date").between(F.lit("1997-07-01").cast("date"), F.lit("1998-12-31").cast("date"))
    checks = {"all": F.lit(True), "inside_crisis": inside, "outside_crisis": ~inside,
              "exact_status": F.col("status") == "F", "building_only": F.col("type") == "BUILDING"}
    one = shocks(spark, sf_dir).agg(*[F.sum(c.cast("long")).alias(n) for n, c in checks.items()])
    return one.unpivot([], list(checks), "name", "n_kept")


@query("p11_scenario_overrides", ctes(SQL_SHOCKS) + f"""
SELECT event_id, scenario, {r("sev", 2, "severity")}, {r("ln(1 + sev)", name="log_severity")}, {r("CASE WHEN type = 'BUILDING' THEN ln(1 + sev) ELSE 0 END", name="log_severity_x_building")}, avail AS severity_available
FROM (SELECT event_id, type, 'double' AS scenario, severity * 2 AS sev, 1.0::DOUBLE AS avail FROM shocks
  UNION ALL SELECT event_id, type, 'fixed', 250000.0, 1.0 FROM shocks)""")
def p11_scenario_overrides(spark, sf_dir):
    """What-if severities with every dependent column recomputed by the one derive step."""
    base = shocks(spark, sf_dir).select("event_id", "type", "severity")
    scen = base.withColumn("s", F.explode(F.array(
        F.struct(F.lit("double").alias("scenario"), (F.col("severity") * 2).alias("value")),
        F.struct(F.lit("fixed").alias("scenario"), F.lit(250000.0).alias("value")),
    ))).select("event_id", "type", "s.scenario", F.col("s.value").alias("severity"))
    d = derive(scen)
    return d.select("event_id", "scenario", rnd("severity", 2).alias("severity"), rnd("log_severity").alias("log_severity"),
                    rnd("log_severity_x_building").alias("log_severity_x_building"), "severity_available")


def derive(df):
    """Columns that follow from others; shared by features, scenarios and augmentation."""
    df = df.withColumn("log_severity", sc.log1p_clipped("severity"))
    df = df.withColumn("_b", (F.col("type") == "BUILDING").cast("int"))
    return df.withColumn("log_severity_x_building", sc.flag_interaction("_b", "log_severity")).withColumn(
        "severity_available", sc.all_present("severity")).drop("_b")


@query("p09_winsorise", ctes(SQL_SHOCKS, """
q AS (SELECT quantile_cont(affected, 0.05) AS lo, quantile_cont(affected, 0.95) AS hi FROM shocks)""") + f"""
SELECT event_id, {r("greatest(least(affected, hi), lo)", 4, "affected_wins")} FROM shocks, q""")
def p09_winsorise(spark, sf_dir):
    from tremor.operators.outcomes import winsorised

    return winsorised(shocks(spark, sf_dir), "affected", "affected_wins").select("event_id", rnd("affected_wins", 4).alias("affected_wins"))


@query("f01_f07_scalars", ctes(SQL_SHOCKS) + f"""
SELECT event_id, {r("ln(1 + greatest(affected, 0))", name="log_affected")}, {r("affected / nullif(severity, 0)", name="affected_ratio")},
  regexp_replace(lower(type || ' / ' || status), '[^a-z0-9]', '', 'g') AS clean_key, strftime(event_date, '%Y-%m') AS month_key,
  {r("date_diff('day', DATE '1995-01-01', event_date) / 365.25", name="years_in")},
  CASE WHEN affected IS NOT NULL AND severity IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS both_present,
  {r("CASE WHEN affected < 0 THEN -1 WHEN affected > 0 THEN 1 ELSE 0 END * sqrt(abs(affected))", name="signed_root")} FROM shocks""")
def f01_f07_scalars(spark, sf_dir):
    return shocks(spark, sf_dir).select(
        "event_id", rnd(sc.log1p_clipped("affected")).alias("log_affected"), rnd(sc.ratio("affected", "severity")).alias("affected_ratio"),
        sc.normalised_key(F.concat(F.col("type"), F.lit(" / "), F.col("status"))).alias("clean_key"),
        F.date_format("event_date", "yyyy-MM").alias("month_key"),
        rnd(sc.years_between(F.lit("1995-01-01").cast("date"), "event_date")).alias("years_in"),
        sc.all_present("affected", "severity").alias("both_present"),
        rnd(F.signum("affected") * F.sqrt(F.abs("affected"))).alias("signed_root"),
    )


SQL_EPI = """
epi AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY event_date, event_id) AS episode FROM (
  SELECT *, CASE WHEN date_diff('day', lag(event_date) OVER (PARTITION BY series_id ORDER BY event_date, event_id), event_date) > 14 THEN 1 ELSE 0 END AS new FROM shocks))"""


@query("w10_episodes", ctes(SQL_SHOCKS, SQL_EPI) + " SELECT event_id, CAST(episode AS BIGINT) AS episode FROM epi")
def w10_episodes(spark, sf_dir):
    return ev.with_episodes(shocks(spark, sf_dir), ["series_id"], "event_date").select("event_id", "episode")


@query("a05_episode_table", ctes(SQL_SHOCKS, SQL_EPI) + """
SELECT series_id, CAST(episode AS BIGINT) AS episode, count(*) AS n_events, min(event_date) AS first_date, max(event_date) AS last_date,
  CAST(date_diff('day', min(event_date), max(event_date)) AS INTEGER) AS span_days, min(event_id) AS first_id, max(event_id) AS last_id
FROM epi GROUP BY series_id, episode""")
def a05_episode_table(spark, sf_dir):
    return ev.episode_table(shocks(spark, sf_dir), ["series_id"], "event_date", "event_id")


@query("a05_episode_members", ctes(SQL_SHOCKS, SQL_EPI) + """
SELECT series_id, CAST(episode AS BIGINT) AS episode, event_id // 4096 AS block, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS members
FROM epi GROUP BY 1, 2, 3""")
def a05_episode_members(spark, sf_dir):
    m = ev.episode_members(shocks(spark, sf_dir), ["series_id"], "event_date", "event_id")
    return m.withColumn("members", F.concat_ws(",", F.col("members").cast("array<string>")))


@query("w11_truncated_windows", ctes(SQL_SHOCKS, """
d AS (SELECT DISTINCT series_id, event_date FROM shocks),
n AS (SELECT *, lead(event_date) OVER (PARTITION BY series_id ORDER BY event_date) AS nx FROM d)""") + """
SELECT series_id, event_date, CAST(CASE WHEN nx <= event_date + INTERVAL 30 DAY THEN nx - INTERVAL 1 DAY ELSE event_date + INTERVAL 30 DAY END AS DATE) AS window_end FROM n""")
def w11_truncated_windows(spark, sf_dir):
    return ev.truncated_windows(shocks(spark, sf_dir), ["series_id"], "event_date", 30)


@query("w12_w13_recency", ctes(SQL_SHOCKS) + """
SELECT s.event_id, CAST(coalesce(date_diff('day', lag(event_date) OVER (PARTITION BY series_id ORDER BY event_date, event_id), event_date), 3650) AS INTEGER) AS days_since_prev,
  (SELECT count(*) FROM shocks x WHERE x.series_id = s.series_id AND x.event_date > s.event_date - INTERVAL 365 DAY AND x.event_date < s.event_date) AS trailing_count
FROM shocks s""")
def w12_w13_recency(spark, sf_dir):
    e = ev.with_recency(shocks(spark, sf_dir), ["series_id"], "event_date", "event_id")
    return e.select("event_id", "days_since_prev", "trailing_count")


@query("a10_sample_flow", ctes(SQL_SESS, SQL_SHOCKS, SQL_ORIGIN, """
flags AS (SELECT s.event_id, lower(s.type) <> 'machinery' AS c1, s.affected >= 1000 AS c2, o.session_idx IS NOT NULL AS c3, o.session_idx > 1 AS c4
  FROM shocks s LEFT JOIN origin o USING (event_id)),
cnt AS (SELECT count(*) AS n0, sum((c1)::INT) AS n1, sum((c1 AND c2)::INT) AS n2, sum((c1 AND c2 AND c3)::INT) AS n3, sum((c1 AND c2 AND c3 AND c4)::INT) AS n4 FROM flags)""") + """
SELECT 0 AS step, 'raw' AS stage, 0::BIGINT AS n_removed, n0::BIGINT AS n_remaining FROM cnt UNION ALL
SELECT 1, 'type_excluded', n0 - n1, n1 FROM cnt UNION ALL SELECT 2, 'below_affected', n1 - n2, n2 FROM cnt UNION ALL
SELECT 3, 'no_session', n2 - n3, n3 FROM cnt UNION ALL SELECT 4, 'no_prior_close', n3 - n4, n4 FROM cnt""")
def a10_sample_flow(spark, sf_dir):
    events = shocks(spark, sf_dir)
    days = cal.event_days(events, sessions(spark, sf_dir)).select("series_id", "event_date", "session_idx")
    joined = events.join(days, ["series_id", "event_date"], "left")
    return ev.sample_flow(joined, [
        ("type_excluded", F.lower("type") != "machinery"),
        ("below_affected", F.col("affected") >= 1000),
        ("no_session", F.col("session_idx").isNotNull()),
        ("no_prior_close", F.col("session_idx") > 1),
    ])


SQL_LOSS = """
losses AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey % 25 AS district, l_returnflag AS kind, l_quantity AS affected, l_extendedprice AS damage FROM lineitem),
edays AS (SELECT DISTINCT event_date FROM shocks)"""


def _losses(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), (F.col("l_suppkey") % 25).alias("district"), F.col("l_returnflag").alias("kind"),
        F.col("l_quantity").alias("affected"), F.col("l_extendedprice").alias("damage"))


@query("a02_loss_features", ctes(SQL_SHOCKS, SQL_LOSS) + f"""
SELECT e.event_date, count(DISTINCT district)::DOUBLE AS districts_hit, {r("ln(1 + coalesce(sum(affected), 0))", name="affected_log")},
  {r("ln(1 + coalesce(sum(damage), 0))", name="damage_log")}, count(date)::DOUBLE AS records, (count(date) > 0)::INT::DOUBLE AS available
FROM edays e LEFT JOIN (SELECT * FROM losses WHERE kind IN ('R', 'A')) l ON l.date BETWEEN e.event_date - INTERVAL 7 DAY AND e.event_date + INTERVAL 14 DAY
GROUP BY 1""")
def a02_loss_features(spark, sf_dir):
    out = sd.loss_features(shocks(spark, sf_dir), "event_date", _losses(spark, sf_dir), ["affected", "damage"], ["R", "A"])
    return out.select("event_date", "districts_hit", rnd("affected_log").alias("affected_log"), rnd("damage_log").alias("damage_log"), "records", "available")


SQL_STATION = """
st AS (SELECT date, station, avg(rain) AS rain, avg(wind) AS wind FROM (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey % 7 AS station, l_quantity AS rain, l_discount * 100 AS wind FROM lineitem) GROUP BY 1, 2),
edays AS (SELECT DISTINCT event_date FROM shocks)"""


def _stations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), (F.col("l_suppkey") % 7).alias("station"),
        F.col("l_quantity").alias("rain"), (F.col("l_discount") * 100).alias("wind"))


@query("a03_hazard_features", ctes(SQL_SHOCKS, SQL_STATION, """
s3 AS (SELECT event_date, station, sum(rain) AS r3, max(wind) AS w FROM edays JOIN st ON date BETWEEN event_date - INTERVAL 2 DAY AND event_date GROUP BY 1, 2),
wn AS (SELECT event_date, max(r3) AS mx, avg(r3) AS mn, stddev_samp(r3) AS sp, sum((r3 > 80)::INT)::DOUBLE AS wet, max(w) AS wm FROM s3 GROUP BY 1),
b AS (SELECT event_date, 3 * avg(m) AS base FROM (SELECT event_date, station, avg(rain) AS m FROM edays JOIN st ON date BETWEEN event_date - INTERVAL 33 DAY AND event_date - INTERVAL 3 DAY GROUP BY 1, 2) GROUP BY 1)""") + f"""
SELECT event_date, {r("mx", name="rain_max3d")}, {r("mn", name="rain_mean3d")}, {r("sp", name="rain_spread3d")}, wet AS stations_wet, {r("wm", name="wind_max3d")},
  {r("CASE WHEN base > 0 THEN mn / base - 1 END", name="rain_anomaly")} FROM edays LEFT JOIN wn USING (event_date) LEFT JOIN b USING (event_date)""")
def a03_hazard_features(spark, sf_dir):
    out = sd.hazard_features(shocks(spark, sf_dir), "event_date", _stations(spark, sf_dir), heavy=80.0)
    cols = ["rain_max3d", "rain_mean3d", "rain_spread3d", "wind_max3d", "rain_anomaly"]
    return out.select("event_date", "stations_wet", *[rnd(c).alias(c) for c in cols])


SQL_FX = """
fx AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS rate FROM lineitem GROUP BY 1),
fr AS (SELECT *, ln(rate / lag(rate) OVER (ORDER BY date)) AS ret FROM fx),
fs AS (SELECT date, row_number() OVER (ORDER BY date) AS seen, ret AS r1, ln(rate / lag(rate, 5) OVER (ORDER BY date)) AS r5,
  stddev_samp(ret) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS v30 FROM fr)"""


@query("a04_fx_features", ctes(SQL_SHOCKS, SQL_FX) + f"""
SELECT e.event_date, {r("CASE WHEN seen >= 32 THEN r1 END", name="fx_logret_1")}, {r("CASE WHEN seen >= 32 THEN r5 END", name="fx_logret_5")},
  {r("CASE WHEN seen >= 32 THEN v30 END", name="fx_vol_30")}
FROM (SELECT DISTINCT event_date FROM shocks) e ASOF LEFT JOIN fs ON e.event_date > fs.date""")
def a04_fx_features(spark, sf_dir):
    fx = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.avg("l_extendedprice").alias("rate"))
    out = sd.fx_features(shocks(spark, sf_dir), "event_date", fx)
    return out.select("event_date", *[rnd(c).alias(c) for c in ("fx_logret_1", "fx_logret_5", "fx_vol_30")])


@query("j09_block_joins", ctes(SQL_SHOCKS, SQL_LOSS, SQL_FX) + f"""
SELECT s.event_id, {r("ln(1 + coalesce(l.q, 0))", name="affected_log")}, {r("f.r1", name="fx_logret_1")}
FROM shocks s LEFT JOIN (SELECT e.event_date, sum(affected) AS q FROM edays e JOIN losses l ON l.kind IN ('R', 'A') AND
   l.date BETWEEN e.event_date - INTERVAL 7 DAY AND e.event_date + INTERVAL 14 DAY GROUP BY 1) l USING (event_date)
LEFT JOIN (SELECT e.event_date, CASE WHEN seen >= 32 THEN r1 END AS r1 FROM edays e ASOF LEFT JOIN fs ON e.event_date > fs.date) f USING (event_date)""")
def j09_block_joins(spark, sf_dir):
    """Side blocks left-joined onto events, after a check that each has one row per day."""
    loss = sd.loss_features(shocks(spark, sf_dir), "event_date", _losses(spark, sf_dir), ["affected"], ["R", "A"])
    fx = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.avg("l_extendedprice").alias("rate"))
    block = sd.fx_features(shocks(spark, sf_dir), "event_date", fx)
    for side in (loss, block):
        sd.assert_unique(side, ["event_date"])
    e = shocks(spark, sf_dir).select("event_id", "event_date").join(loss, "event_date", "left").join(block, "event_date", "left")
    return e.select("event_id", rnd("affected_log").alias("affected_log"), rnd("fx_logret_1").alias("fx_logret_1"))


@query("s01_s04_artifact_store", ctes(SQL_SHOCKS) + """
SELECT 'events' AS name, count(*) AS rows, 7 AS n_columns, 'urgent orders' AS note FROM shocks UNION ALL
SELECT 'nations', (SELECT count(*) FROM nation), 3, ''""")
def s01_s04_artifact_store(spark, sf_dir):
    root = _new(spark, "artifacts")
    sk.save_frame(shocks(spark, sf_dir), root, "events", "urgent orders")
    sk.save_frame(table(spark, sf_dir, "nation"), root, "nations")
    rd.load_frame(spark, root, "events")
    return sk.artifact_status(spark, root).select("name", "rows", "n_columns", "note")


SQL_DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS date, round(max(o_totalprice), 2) AS close FROM orders GROUP BY 1)"


@query("s05_daily_series_csv", ctes(SQL_DAILY) + " SELECT date, close FROM daily WHERE date >= DATE '1996-01-01'")
def s05_daily_series_csv(spark, sf_dir):
    """A headed CSV with duplicate and dirty lines, read back as one clean row per date."""
    orders = table(spark, sf_dir, "orders")
    daily = orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.max("o_totalprice"), 2).alias("close"))
    good = daily.select(F.lit(0).cast("long").alias("seq"), F.col("date").cast("string").alias("date"), F.col("close").cast("decimal(18,2)").cast("string").alias("close"))
    dup = good.withColumn("seq", F.lit(1).cast("long")).withColumn("close", F.lit("1.0"))
    dirty = good.select(F.lit(2).cast("long").alias("seq"), F.lit("n/a").alias("date"), "close")
    path = _new(spark, "daily_csv")
    sk.export_csv(good.unionByName(dup).unionByName(dirty), path)
    return rd.load_daily_series(spark, path, "1996-01-01")


@query("s06_a01_trade_files", """
SELECT CAST(l_shipdate AS DATE) AS date, round(sum(l_quantity), 2) + 0.0 AS volume FROM lineitem GROUP BY 1""")
def s06_a01_trade_files(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    path = _new(spark, "trades")
    li.select(F.to_date("l_shipdate").cast("string").alias("date"), F.col("l_quantity").cast("string").alias("quantity"), F.col("l_returnflag").alias("part")) \
        .write.partitionBy("part").csv(path, header=True)
    volume, _ = rd.load_trade_files(spark, [path])
    return volume.select("date", rnd("volume", 2).alias("volume"))


@query("s06_rejected_rows", """
SELECT l_returnflag AS part, sum((l_orderkey % 50 = 0 OR l_orderkey % 70 = 0)::INT)::BIGINT AS n_rejected, count(*) AS n_rows FROM lineitem GROUP BY 1""")
def s06_rejected_rows(spark, sf_dir):
    """Files with unreadable quantities and dates, and how many rows of each part were rejected."""
    li = table(spark, sf_dir, "lineitem")
    path = _new(spark, "trades")
    day = F.when(F.col("l_orderkey") % 70 == 0, F.lit("soon")).otherwise(F.to_date("l_shipdate").cast("string"))
    amount = F.when(F.col("l_orderkey") % 50 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    li.select(day.alias("date"), amount.alias("quantity"), F.col("l_returnflag").alias("part")).write.partitionBy("part").csv(path, header=True)
    _, rejected = rd.load_trade_files(spark, [path])
    part = F.regexp_extract("file", "part=([^/]+)", 1).alias("part")
    return rejected.groupBy(part).agg(F.sum("n_rejected").alias("n_rejected"), F.sum("n_rows").alias("n_rows"))


@query("s07_wide_sheet_to_panel", ctes("""
p AS (SELECT c_mktsegment AS series_id, CAST(o_orderdate AS DATE) AS date, round(max(o_totalprice), 2) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""") + """
SELECT date, series_id, close FROM p WHERE series_id <> 'MACHINERY' AND series_id IN
 (SELECT series_id FROM p GROUP BY 1 HAVING count(*)::DOUBLE / (SELECT count(DISTINCT date) FROM p) >= 0.7)""")
def s07_wide_sheet_to_panel(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = o.groupBy(F.to_date("o_orderdate").alias("date")).pivot("c_mktsegment", names).agg(F.round(F.max("o_totalprice"), 2))
    return rd.wide_to_panel(wide, "date", ["machinery"], 0.7)


@query("s08_html_rows", """
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, trim(regexp_replace(c, '<[^>]+>', '', 'g')) AS cell FROM (
 SELECT page_id, generate_subscripts(x, 1) AS pos, unnest(x) AS c FROM (
  SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) AS x FROM pages))""")
def s08_html_rows(spark, sf_dir):
    rows = rd.html_rows(table(spark, sf_dir, "pages"), "html", "li", ["page_id"])
    return rows.select("page_id", "pos", F.trim(F.regexp_replace("inner", "<[^>]+>", "")).alias("cell"))


@query("s09_json_parameters", ctes("""
x AS (SELECT l_suppkey % 7 AS station, CAST(l_shipdate AS DATE) AS date, max(l_quantity) AS rain, max(l_discount) AS wind FROM lineitem GROUP BY 1, 2)""") + """
SELECT station, 'rain' AS parameter, date, CASE WHEN rain > 45 THEN NULL ELSE rain END AS value FROM x UNION ALL
SELECT station, 'wind', date, wind FROM x""")
def s09_json_parameters(spark, sf_dir):
    """Payloads {parameter: {yyyymmdd: value}} per station; the map is bounded by the calendar."""
    x = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("station"), F.date_format("l_shipdate", "yyyyMMdd").alias("d")).agg(
        F.max("l_quantity").alias("rain"), F.max("l_discount").alias("wind"))
    rain = F.when(F.col("rain") > 45, F.lit(-999.0)).otherwise(F.col("rain"))
    payload = x.groupBy("station").agg(F.to_json(F.create_map(
        F.lit("rain"), F.map_from_entries(F.collect_list(F.struct("d", rain.alias("v")))),
        F.lit("wind"), F.map_from_entries(F.collect_list(F.struct("d", F.col("wind").alias("v")))))).alias("payload"))
    return rd.json_daily_parameters(payload, "station", "payload")


@query("s10_loss_xml", """
SELECT CAST(o_orderdate AS DATE) AS date, upper(o_orderpriority) AS evento, o_orderstatus AS name1, count(*)::DOUBLE AS afectados, max(o_custkey)::DOUBLE AS muertos
FROM orders GROUP BY 1, 2, 3""")
def s10_loss_xml(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    recs = o.groupBy("date", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("afectados"), F.max("o_custkey").alias("muertos")).select(
        F.year("date").alias("fechano"), F.month("date").alias("fechames"), F.dayofmonth("date").alias("fechadia"),
        F.lower("o_orderpriority").alias("evento"), F.col("o_orderstatus").alias("name1"), "afectados", "muertos")
    path = _new(spark, "losses_xml")
    recs.write.format("xml").option("rowTag", "TR").option("rootTag", "ROWS").save(path)
    return rd.load_loss_xml(spark, path)


@query("s11_rate_csv", ctes(SQL_DAILY) + " SELECT date, close AS rate FROM daily WHERE close < 450000")
def s11_rate_csv(spark, sf_dir):
    d = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.max("o_totalprice"), 2).alias("close"))
    path = _new(spark, "rates_csv")
    sk.export_csv(d.select("date", F.when(F.col("close") < 450000, F.col("close").cast("decimal(18,2)").cast("string")).otherwise(F.lit(".")).alias("rate")), path)
    return rd.load_rate_csv(spark, path)


@query("s12_json_bindings", """
SELECT CAST(o_orderdate AS DATE) AS date, min(o_orderpriority) AS name FROM orders GROUP BY 1""")
def s12_json_bindings(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").alias("p")).distinct()
    b = F.struct(F.struct(F.concat(F.col("d").cast("string"), F.lit("T00:00:00Z")).alias("value")).alias("date"), F.struct(F.col("p").alias("value")).alias("name"))
    docs = o.groupBy(F.trunc("d", "month").alias("m")).agg(F.collect_list(b).alias("bindings")).select(F.struct("bindings").alias("results"))
    path = _new(spark, "bindings")
    docs.write.json(path)
    return rd.load_bindings(spark, path)


@query("s13_event_file_mapping", """
SELECT o_orderkey AS event_id,
  make_date(year(o_orderdate)::INT, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE month(o_orderdate)::INT END, CASE WHEN o_orderstatus = 'O' OR o_orderstatus = 'P' THEN 1 ELSE day(o_orderdate)::INT END) AS event_date,
  CASE o_orderstatus WHEN 'P' THEN 'year_only' WHEN 'O' THEN 'month_only' ELSE 'exact_day' END AS date_precision,
  CASE WHEN o_totalprice > 300000 THEN 'cpi_adjusted' WHEN o_totalprice > 100000 THEN 'unadjusted_fallback' ELSE 'missing' END AS damage_source,
  round(CASE WHEN o_totalprice > 300000 THEN o_totalprice * 1.5 WHEN o_totalprice > 100000 THEN o_totalprice END * 1000, 2) + 0.0 AS damage,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey::DOUBLE END AS mag_area, CASE WHEN o_orderpriority = '2-HIGH' THEN o_custkey::DOUBLE END AS mag_wind
FROM orders""")
def s13_event_file_mapping(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s, p, pr = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    raw = o.select(
        F.col("o_orderkey").alias("event_id"), F.year("o_orderdate").alias("start_year"),
        F.when(s != "P", F.month("o_orderdate")).alias("start_month"), F.when(s == "F", F.dayofmonth("o_orderdate")).alias("start_day"),
        pr.alias("type"), F.when(p > 300000, p * 1.5).alias("damage_adjusted"), F.when(p > 100000, p).alias("damage"),
        F.lit(None).cast("double").alias("deaths"), F.col("o_custkey").cast("double").alias("magnitude"),
        F.when(pr == "1-URGENT", " Km2 ").when(pr == "2-HIGH", "Kph").alias("magnitude_scale"))
    return rd.map_event_file(raw).select("event_id", "event_date", "date_precision", "damage_source", rnd("damage", 2).alias("damage"), "mag_area", "mag_wind")


@query("s14_macro_by_year", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 4) + 0.0 AS gdp, round(max(o_totalprice), 4) + 0.0 AS cpi, make_date(year(o_orderdate)::INT + 1, 7, 1) AS available_from FROM orders GROUP BY 1, 4""")
def s14_macro_by_year(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("gdp"), F.max("o_totalprice").alias("cpi"))
    long = y.unpivot(["year"], ["gdp", "cpi"], "series", "value")
    return rd.macro_by_year(long, "year", "series", "value", ["gdp", "cpi"]).select("year", rnd("gdp", 4).alias("gdp"), rnd("cpi", 4).alias("cpi"), "available_from")


@query("s15_control_returns", """
SELECT * FROM (SELECT date, round(ln(p / lag(p) OVER (ORDER BY date)), 6) + 0.0 AS log_return FROM (
 SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1)) WHERE log_return IS NOT NULL""")
def s15_control_returns(spark, sf_dir):
    from tremor.sources.adapters import factor

    return factor(spark, sf_dir).where(F.col("ret").isNotNull()).select("date", rnd("ret").alias("log_return"))


@query("s16_result_export", ctes(SQL_SHOCKS) + """
SELECT '| ' || series_id || ' | ' || CAST(count(*) AS VARCHAR) || ' |' AS line FROM shocks GROUP BY series_id""")
def s16_result_export(spark, sf_dir):
    t = shocks(spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("n"))
    path = _new(spark, "export")
    sk.export_csv(t, path)
    return sk.markdown_rows(spark.read.schema("series_id string, n long").csv(path, header=True))
