"""Folds, baseline forecasts, forecast metrics, resampling and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions import scalars as sc
from tremor.functions.draws import cluster_draws
from tremor.functions.ordered import counted_quantiles, exact_quantiles
from tremor.functions.scalars import rnd
from tremor.operators import events as ev
from tremor.operators import folds as fd
from tremor.operators import metrics as mt
from tremor.operators import resample as rs
from tremor.plans.event_queries import SQL_EPI
from tremor.plans.outcome_queries import SQL_OUT, features, outcomes, panel
from tremor.plans.registry import ctes, query, r
from tremor.session import stage, staged_once
from tremor.sources.adapters import table

# target name -> (value column, label end column)
TARGETS = {"ret5": ("y1_5", "y1_5_end"), "vol5": ("y2_5", "y2_5_end")}
MODELS = ["ols", "train_mean", "train_median", "zero"]


def ordered(spark, sf_dir):
    """Events with outcomes, two snapshot features and their chronological position."""

    def build():
        o = outcomes(spark, sf_dir).drop("t_rec", "t_next")
        f = features(spark, sf_dir).select("series_id", "session_idx", F.col("price_to_sma_20").alias("x1"), F.col("vol_ratio_5_30").alias("x2"))
        df, _ = fd.ordered_events(o.join(f, ["series_id", "session_idx"], "left"))
        return df

    return staged_once(spark, sf_dir, "ordered", build)


def geometry(spark, sf_dir):
    """Folds of 30, 10 and 10 months."""
    last = ordered(spark, sf_dir).agg(F.max("pos")).first()[0]
    return fd.Geometry(0 if last is None else last + 1)


def members(spark, sf_dir, mode="sliding"):
    return fd.fold_membership(ordered(spark, sf_dir), geometry(spark, sf_dir), mode=mode)


def train_lines(cells, geo, y, end):
    """Per fold: (fold, _med, train_mean, train_median, _b, _a) of the purged train rows, x1 imputed by its train median.

    ``cells`` are distinct (event_date, pos, x1, y, end) with the number ``n`` of events that have them, so what
    is read again for medians and moments follows the sessions and not the events.
    """
    p = fd.purge(fd.fold_membership(cells.where(F.col(y).isNotNull()), geo), "event_date", end).where("role = 'train'")
    p = stage(p.groupBy("fold", "x1", F.col(y).alias("y")).agg(F.sum("n").alias("n")), "train-cells")
    med = counted_quantiles(p, ["fold"], "x1", "n", {"_med": 0.5}).drop("n_total")
    known = p.select("fold").distinct().join(med, "fold", "left").select("fold", F.coalesce("_med", F.lit(0.0)).alias("_med"))
    p = p.join(F.broadcast(known), "fold").withColumn("x", F.coalesce("x1", "_med"))  # one row per fold
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    at = p.groupBy("fold", "_med").agg(mean("x").alias("_mx"), mean("y").alias("train_mean"), (F.min("x") < F.max("x")).alias("_varies"))
    dx, dy = F.col("x") - F.col("_mx"), F.col("y") - F.col("train_mean")
    s = p.drop("_med").join(F.broadcast(at), "fold").groupBy(*at.columns).agg((F.sum(F.col("n") * dx * dy) / F.sum(F.col("n") * dx * dx)).alias("_s"))
    s = s.withColumn("_b", F.when(F.col("_varies"), F.col("_s"))).withColumn("_a", F.col("train_mean") - F.col("_b") * F.col("_mx"))
    half = counted_quantiles(p, ["fold"], "y", "n", {"train_median": 0.5}).drop("n_total")
    return stage(s.join(half, "fold").select("fold", "_med", "train_mean", "train_median", "_b", "_a"), "train-lines")


def oof(spark, sf_dir):
    """Long out-of-fold table of constants and a one-feature line, purged per fold."""

    def build():
        o, geo = ordered(spark, sf_dir), geometry(spark, sf_dir)
        labels = [c for pair in TARGETS.values() for c in pair]
        # features and labels follow from the session, so the events of one day in a series share a row
        cells = stage(o.groupBy("event_date", "pos", "x1", *labels).agg(F.count("*").alias("n")), "oof-cells")
        tests = fd.fold_membership(o, geo).where("role = 'test'")
        parts = []
        for name, (y, end) in TARGETS.items():
            x = F.coalesce("x1", "_med")
            test = tests.where(F.col(y).isNotNull()).join(F.broadcast(train_lines(cells, geo, y, end)), "fold")  # one row per fold
            models = F.array(
                F.struct(F.lit("ols").alias("model"), (F.col("_a") + F.col("_b") * x).alias("y_pred")),
                F.struct(F.lit("train_mean").alias("model"), F.col("train_mean").alias("y_pred")),
                F.struct(F.lit("train_median").alias("model"), F.col("train_median").alias("y_pred")),
                F.struct(F.lit("zero").alias("model"), F.lit(0.0).alias("y_pred")),
            )
            parts.append(
                test.select("fold", "event_id", "ord", "series_id", "event_date", "status", "type", "severity",
                            F.col(y).alias("y_true"), F.col(end).alias("label_end"), F.explode(models).alias("m"))
                .select(F.lit(name).alias("target"), "m.model", "fold", "event_id", "ord", "series_id", "event_date",
                        "status", "type", "severity", "label_end", "y_true", "m.y_pred")
            )
        return parts[0].unionByName(parts[1])

    return staged_once(spark, sf_dir, "oof", build)


SQL_MEM = f"""{SQL_OUT},
ft AS (SELECT series_id, session_idx,
  CASE WHEN count(*) OVER b20 = 20 THEN lag(close) OVER w / avg(close) OVER b20 - 1 END AS x1,
  CASE WHEN count(*) OVER b30 = 30 THEN avg(volume) OVER b5 / avg(volume) OVER b30 - 1 END AS x2
  FROM sess WINDOW w AS (PARTITION BY series_id ORDER BY date),
   b20 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
   b30 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
   b5 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
fo AS (SELECT o.*, ft.x1, ft.x2, row_number() OVER (ORDER BY event_date, event_id) - 1 AS ord,
  year(event_date) * 12 + month(event_date) - min(year(event_date) * 12 + month(event_date)) OVER () AS pos FROM outc o LEFT JOIN ft USING (series_id, session_idx)),
fp AS (SELECT max(pos) + 1 AS n, 30 AS tr, 10 AS te FROM fo),
fl AS (SELECT unnest(range(0, (n - tr - te) // te + 1)) AS fold FROM fp),
mem AS (
  SELECT fl.fold, 'train' AS role, fo.* FROM fo, fp, fl WHERE pos >= fold * te AND pos < fold * te + tr
  UNION ALL SELECT fl.fold, 'test', fo.* FROM fo, fp, fl WHERE pos >= fold * te + tr AND pos < fold * te + tr + te)"""


def _sql_target(name, y, end):
    return f"""
m_{name} AS (SELECT m.*, m.{y} AS y FROM mem m WHERE m.{y} IS NOT NULL),
ftd_{name} AS (SELECT fold, min(event_date) AS ftd FROM m_{name} WHERE role = 'test' GROUP BY 1),
p_{name} AS (SELECT m.* FROM m_{name} m JOIN ftd_{name} USING (fold) WHERE role = 'test' OR {end} IS NULL OR {end} < ftd),
md_{name} AS (SELECT fold, coalesce(median(x1), 0) AS med FROM p_{name} WHERE role = 'train' GROUP BY 1),
i_{name} AS (SELECT p.*, coalesce(x1, med) AS xi FROM p_{name} p JOIN md_{name} USING (fold)),
t_{name} AS (SELECT fold, avg(y) AS mean, median(y) AS med, regr_slope(y, xi) AS b, regr_intercept(y, xi) AS a FROM i_{name} WHERE role = 'train' GROUP BY 1),
o_{name} AS (SELECT '{name}' AS target, i.fold, event_id, ord, series_id, event_date, status, type, severity, {end} AS label_end, y AS y_true,
  t.mean, t.med, t.a + t.b * xi AS ols FROM i_{name} i JOIN t_{name} t USING (fold) WHERE role = 'test')"""


SQL_OOF = f"""{SQL_MEM},{_sql_target("ret5", "y1_5", "y1_5_end")},{_sql_target("vol5", "y2_5", "vd5")},
ow AS (SELECT * FROM o_ret5 UNION ALL SELECT * FROM o_vol5),
oof AS (
  SELECT *, 'ols' AS model, ols AS y_pred FROM ow UNION ALL SELECT *, 'train_mean', mean FROM ow
  UNION ALL SELECT *, 'train_median', med FROM ow UNION ALL SELECT *, 'zero', 0.0 FROM ow)"""


@query("c01_fold_membership", ctes(SQL_MEM) + " SELECT fold, role, event_id, ord FROM mem")
def c01_fold_membership(spark, sf_dir):
    return members(spark, sf_dir).select("fold", "role", "event_id", "ord")


@query("c01_row_folds", ctes(SQL_MEM, """
rp AS (SELECT count(*) AS n, 30 AS tr, 10 AS te FROM fo),
rl AS (SELECT unnest(range(0, (n - tr - te) // te + 1)) AS fold FROM rp)""") + """
SELECT fold, CASE WHEN ord < fold * te + tr THEN 'train' ELSE 'test' END AS role, event_id FROM fo, rp, rl WHERE ord >= fold * te AND ord < fold * te + tr + te""")
def c01_row_folds(spark, sf_dir):
    """The geometry in rows: 30 events, then 10, moving by 10; four rows for each event."""
    o = ordered(spark, sf_dir)
    return fd.fold_membership(o, fd.Geometry(o.count()), "ord").select("fold", "role", "event_id")


@query("c01_expanding_folds", ctes(SQL_MEM) + """
SELECT fl.fold, 'train' AS role, fo.event_id FROM fo, fp, fl WHERE pos < fold * te + tr
UNION ALL SELECT fold, role, event_id FROM mem WHERE role = 'test'""")
def c01_expanding_folds(spark, sf_dir):
    return members(spark, sf_dir, "expanding").select("fold", "role", "event_id")


@query("c02_grouped_folds", ctes(SQL_OUT, """
go AS (SELECT *, dense_rank() OVER (ORDER BY event_date) - 1 AS gord FROM outc),
gp AS (SELECT count(DISTINCT event_date) AS n, 30 AS tr, 10 AS te FROM outc),
gl AS (SELECT unnest(range(0, (n - tr - te) // te + 1)) AS fold FROM gp)""") + """
SELECT fold, 'train' AS role, event_id FROM go, gp, gl WHERE gord >= fold * te AND gord < fold * te + tr
UNION ALL SELECT fold, 'test', event_id FROM go, gp, gl WHERE gord >= fold * te + tr AND gord < fold * te + tr + te""")
def c02_grouped_folds(spark, sf_dir):
    o = outcomes(spark, sf_dir).select("event_id", "event_date")
    geo = fd.Geometry(o.select("event_date").distinct().count())  # in event days
    return fd.fold_membership(fd.grouped_order(o, "event_date"), geo).select("fold", "role", "event_id")


@query("c03_purge", ctes(SQL_MEM, """
f1 AS (SELECT fold, min(event_date) AS ftd FROM mem WHERE role = 'test' GROUP BY 1),
ends AS (SELECT m.*, w.y1_20_end AS e20 FROM mem m JOIN win w ON w.series_id = m.series_id AND w.session_idx = m.session_idx)""") + """
SELECT fold, role, event_id FROM ends JOIN f1 USING (fold) WHERE role = 'test' OR e20 IS NULL OR e20 < ftd""")
def c03_purge(spark, sf_dir):
    return fd.purge(members(spark, sf_dir), "event_date", "y1_20_end").select("fold", "role", "event_id")


@query("u02_purged_rows", ctes(SQL_MEM, """
f1 AS (SELECT fold, min(event_date) AS ftd FROM mem WHERE role = 'test' GROUP BY 1)""") + """
SELECT fold, event_id FROM mem JOIN f1 USING (fold) WHERE role = 'train' AND y1_20_end >= ftd""")
def u02_purged_rows(spark, sf_dir):
    """Set difference: train rows the purge removed."""
    m = members(spark, sf_dir)
    train = m.where("role = 'train'").select("fold", "event_id")
    return train.join(fd.purge(m, "event_date", "y1_20_end").where("role = 'train'").select("fold", "event_id"), ["fold", "event_id"], "left_anti")


@query("c04_c05_inner_splits", ctes(SQL_MEM, """
tr0 AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY ord) - 1 AS ip, count(*) OVER (PARTITION BY fold) AS cnt FROM mem WHERE role = 'train'),
sp AS (SELECT t.*, s.split, CASE WHEN ip < cnt - (3 - split) * (cnt // 4) THEN 'train' WHEN ip < cnt - (3 - split) * (cnt // 4) + cnt // 4 THEN 'validation' END AS ir
  FROM tr0 t, (SELECT unnest(range(0, 3)) AS split) s),
fv AS (SELECT fold, split, min(event_date) AS d FROM sp WHERE ir = 'validation' GROUP BY 1, 2),
kept AS (SELECT sp.* FROM sp JOIN fv USING (fold, split) WHERE ir = 'validation' OR (ir = 'train' AND (y1_5_end IS NULL OR y1_5_end < d)))""") + """
SELECT fold, CAST(split AS INTEGER) AS split, sum((ir = 'train')::INT)::BIGINT AS n_train, sum((ir = 'validation')::INT)::BIGINT AS n_validation,
 sum((ir = 'train')::INT) >= 5 AS usable FROM kept GROUP BY fold, split""")
def c04_c05_inner_splits(spark, sf_dir):
    train = members(spark, sf_dir).where("role = 'train'")
    # train blocks are contiguous, so a row's place in its block is arithmetic
    block = train.groupBy("fold").agg(F.min("ord").alias("_first"), F.count("*").alias("_n"))
    placed = train.join(F.broadcast(block), "fold").withColumn("_pos", F.col("ord") - F.col("_first"))  # one row per fold
    inner = fd.inner_membership(placed, ["fold"], "_pos", "_n", "event_date", "y1_5_end")
    return fd.surviving_splits(inner, ["fold"])


@query("c06_median_impute", ctes(SQL_MEM, """
med AS (SELECT fold, coalesce(median(x2), 0) AS m FROM mem WHERE role = 'train' GROUP BY 1)""") + f"""
SELECT fold, role, event_id, {r("coalesce(x2, m)", name="x2")} FROM mem JOIN med USING (fold)""")
def c06_median_impute(spark, sf_dir):
    return fd.median_imputed(members(spark, sf_dir), ["x2"]).select("fold", "role", "event_id", rnd("x2").alias("x2"))


@query("c07_leakage_audit", ctes(SQL_MEM, """
f1 AS (SELECT fold, min(event_date) AS first_test FROM mem WHERE role = 'test' GROUP BY 1)""") + """
SELECT fold, first_test, max(y1_20_end) AS last_label_end, sum((y1_20_end >= first_test)::INT)::BIGINT AS n_overlapping, count(*) AS n_train,
 sum((y1_20_end >= first_test)::INT) > 0 AS leaks FROM mem JOIN f1 USING (fold) WHERE role = 'train' GROUP BY 1, 2""")
def c07_leakage_audit(spark, sf_dir):
    return fd.leakage_audit(members(spark, sf_dir), "event_date", "y1_20_end")


@query("c09_scaling", ctes(SQL_MEM, """
s AS (SELECT fold, avg(x2) AS m, stddev_pop(x2) AS sd, min(x2) AS lo, max(x2) AS hi FROM mem WHERE role = 'train' GROUP BY 1)""") + f"""
SELECT fold, role, event_id, {r("(x2 - m) / sd", name="x2_std")}, {r("(x2 - lo) / (hi - lo)", name="x2_minmax")} FROM mem JOIN s USING (fold)""")
def c09_scaling(spark, sf_dir):
    """Standard and min-max scaling with statistics of the fold's train rows."""
    m = members(spark, sf_dir)
    s = m.where("role = 'train'").groupBy("fold").agg(F.avg("x2").alias("_m"), F.stddev_pop("x2").alias("_sd"), F.min("x2").alias("_lo"), F.max("x2").alias("_hi"))
    return m.join(F.broadcast(s), "fold").select(  # one row per fold
        "fold", "role", "event_id", rnd(sc.ratio(F.col("x2") - F.col("_m"), "_sd")).alias("x2_std"),
        rnd(sc.ratio(F.col("x2") - F.col("_lo"), F.col("_hi") - F.col("_lo"))).alias("x2_minmax"))


@query("a06_fold_spans", ctes(SQL_MEM) + f"""
SELECT fold, role, count(*) AS n_rows, min(event_date) AS first_date, max(event_date) AS last_date,
 {r("date_diff('day', min(event_date), max(event_date)) / 365.25", name="span_years")} FROM mem GROUP BY fold, role""")
def a06_fold_spans(spark, sf_dir):
    t = fd.span_table(members(spark, sf_dir), "event_date", "event_id")
    return t.select("fold", "role", "n_rows", "first_date", "last_date", rnd("span_years").alias("span_years"))


@query("a06_test_type_counts", ctes(SQL_MEM) + """
SELECT fold, '{' || string_agg('"' || type || '":' || n, ',' ORDER BY type) || '}' AS type_counts FROM (
 SELECT fold, type, CAST(count(*) AS VARCHAR) AS n FROM mem WHERE role = 'test' GROUP BY 1, 2) GROUP BY 1""")
def a06_test_type_counts(spark, sf_dir):
    c = members(spark, sf_dir).where("role = 'test'").groupBy("fold", "type").agg(F.count("*").alias("n"))
    # few types per fold, counted before they are listed
    return c.groupBy("fold").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n"))))).alias("type_counts"))


def _accounting_sql(name, y, end):
    return f"""
f1_{name} AS (SELECT fold, min(event_date) AS ftd FROM mem WHERE role = 'test' GROUP BY 1),
k_{name} AS (SELECT m.*, NOT (role = 'test' OR {end} IS NULL OR {end} < ftd) AS purged FROM mem m JOIN f1_{name} USING (fold)),
pf_{name} AS (SELECT fold, sum((role = 'train' AND NOT purged AND {y} IS NOT NULL)::INT) AS n FROM k_{name} GROUP BY 1),
a_{name} AS (SELECT '{name}' AS target, (SELECT count({y}) FROM fo) AS n_labelled, (SELECT min(n) FROM pf_{name})::BIGINT AS min_train,
 (SELECT count(DISTINCT event_id) FROM k_{name} WHERE role = 'test' AND {y} IS NOT NULL) AS n_held_out,
 (SELECT count(DISTINCT event_id) FROM k_{name} WHERE purged) AS n_purged,
 (SELECT count(*) FROM fo WHERE ord >= (SELECT max(ord) + 1 FROM mem)) AS n_tail)"""


@query("a11_sample_accounting", ctes(SQL_MEM, _accounting_sql("ret5", "y1_5", "y1_5_end"), _accounting_sql("vol5", "y2_5", "vd5")) + """
SELECT * FROM a_ret5 UNION ALL SELECT * FROM a_vol5""")
def a11_sample_accounting(spark, sf_dir):
    """Labelled, trainable, held-out, purged and tail rows of each target, in two passes."""
    m = members(spark, sf_dir)
    first = F.broadcast(fd.first_test_dates(m, "event_date"))  # one row per fold
    out = None
    for name, (y, end) in TARGETS.items():
        k = m.join(first, "fold").withColumn("purged", (F.col("role") == "train") & (F.coalesce(F.col(end) >= F.col("first_test"), F.lit(False))))
        has = F.col(y).isNotNull()
        # a row is a test row of at most one fold; purged rows can repeat, so collapse per event first
        per_event = k.groupBy("event_id").agg(F.max("purged").alias("p"), F.max((F.col("role") == "test") & has).alias("t"), F.max("ord").alias("ord"))
        ev_side = per_event.agg(F.sum(F.col("t").cast("long")).alias("n_held_out"), F.sum(F.col("p").cast("long")).alias("n_purged"), F.max("ord").alias("_top"))
        fold_side = k.groupBy("fold").agg(F.sum(((F.col("role") == "train") & ~F.col("purged") & has).cast("long")).alias("n")).agg(F.min("n").alias("min_train"))
        total = ordered(spark, sf_dir).agg(F.count(y).alias("n_labelled"), F.max("ord").alias("_last"))
        key = F.lit(1).alias("_k")
        part = (
            ev_side.select("*", key).join(fold_side.select("*", key), "_k").join(total.select("*", key), "_k")  # one row each
            .select(F.lit(name).alias("target"), "n_labelled", "min_train", "n_held_out", "n_purged", (F.col("_last") - F.col("_top")).alias("n_tail"))
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("a21_fold_baselines", ctes(SQL_MEM) + f"""
SELECT fold, 0.0::DOUBLE AS zero, {r("avg(y1_5)", name="train_mean")}, {r("median(y1_5)", name="train_median")}, count(*) AS n_train
FROM mem WHERE role = 'train' AND y1_5 IS NOT NULL GROUP BY fold""")
def a21_fold_baselines(spark, sf_dir):
    b = fd.baselines(members(spark, sf_dir), "y1_5")
    return b.select("fold", "zero", rnd("train_mean").alias("train_mean"), rnd("train_median").alias("train_median"), "n_train")


@query("w16_regime_flags", ctes(SQL_MEM, """
med AS (SELECT fold, median(x1) AS m FROM mem WHERE role = 'train' GROUP BY 1)""") + """
SELECT fold, role, event_id, CAST(CASE WHEN x1 > m THEN 1 WHEN x1 <= m THEN 0 END AS DOUBLE) AS high_momentum FROM mem JOIN med USING (fold)""")
def w16_regime_flags(spark, sf_dir):
    m = members(spark, sf_dir)
    med = exact_quantiles(m.where("role = 'train'"), ["fold"], "x1", {"_m": 0.5})
    return m.join(F.broadcast(med), "fold").select("fold", "role", "event_id", (F.col("x1") > F.col("_m")).cast("double").alias("high_momentum"))


@query("e13_outcome_labels", ctes(SQL_MEM, """
cut AS (SELECT fold, quantile_cont(y1_5, 1.0/3) AS c1b, median(CASE WHEN reason NOT IN ('next_disaster', 'no_drawdown') THEN duration END) AS c3b FROM mem WHERE role = 'train' GROUP BY 1)""") + """
SELECT fold, role, event_id, drawdown::INT::DOUBLE AS c0, (y1_5 < 0)::INT::DOUBLE AS c1, (y1_5 < c1b)::INT::DOUBLE AS c1b, (y2_5 > 0)::INT::DOUBLE AS c2,
 CASE WHEN reason NOT IN ('next_disaster', 'no_drawdown') THEN event_observed::DOUBLE END AS c3,
 CASE WHEN reason NOT IN ('next_disaster', 'no_drawdown') THEN (duration > c3b)::INT::DOUBLE END AS c3b FROM mem JOIN cut USING (fold)""")
def e13_outcome_labels(spark, sf_dir):
    """Six labels; missing outcomes stay null, train-relative cuts come from train rows only."""
    m = members(spark, sf_dir)
    known = F.col("duration").isNotNull() & ~F.col("reason").isin("next_disaster", "no_drawdown")
    train = m.where("role = 'train'")
    # durations have at most as many values as the cap, returns have as many as there are rows
    cut = train.groupBy("fold").agg(F.percentile(F.when(known, F.col("duration")), 0.5).alias("_c3b"))
    cut = cut.join(exact_quantiles(train, ["fold"], "y1_5", {"_c1b": 1.0 / 3}).drop("n_total"), "fold", "left")
    d = lambda c: c.cast("double")
    return m.join(F.broadcast(cut), "fold").select(  # one row per fold
        "fold", "role", "event_id", d(F.col("drawdown")).alias("c0"), d(F.col("y1_5") < 0).alias("c1"), d(F.col("y1_5") < F.col("_c1b")).alias("c1b"),
        d(F.col("y2_5") > 0).alias("c2"), F.when(known, d(F.col("event_observed"))).alias("c3"), F.when(known, d(F.col("duration") > F.col("_c3b"))).alias("c3b"))


@query("m10_pooled_predictions", ctes(SQL_OOF) + f"""
SELECT target, model, fold, event_id, {r("y_true", name="y_true")}, {r("y_pred", name="y_pred")}, {r("y_pred - y_true", name="residual")} FROM oof""")
def m10_pooled_predictions(spark, sf_dir):
    return oof(spark, sf_dir).select("target", "model", "fold", "event_id", rnd("y_true").alias("y_true"), rnd("y_pred").alias("y_pred"),
                                     rnd(F.col("y_pred") - F.col("y_true")).alias("residual"))


_M01 = f"""count(*) AS n, {r("sqrt(avg((y_pred - y_true) ** 2))", name="rmse")}, {r("avg(abs(y_pred - y_true))", name="mae")},
  {r("1 - sum((y_pred - y_true) ** 2) / (count(*) * var_pop(y_true))", name="r2")}"""


@query("m01_a12_regression_metrics", ctes(SQL_OOF) + f" SELECT target, model, {_M01} FROM oof GROUP BY target, model")
def m01_a12_regression_metrics(spark, sf_dir):
    t = mt.regression_metrics(oof(spark, sf_dir), ["target", "model"])
    return t.select("target", "model", "n", *[rnd(c).alias(c) for c in ("rmse", "mae", "r2")])


@query("m02_extended_metrics", ctes(SQL_OOF, """
rk AS (SELECT *, rank() OVER (PARTITION BY target, model ORDER BY y_true) + (count(*) OVER (PARTITION BY target, model, y_true) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY target, model ORDER BY y_pred) + (count(*) OVER (PARTITION BY target, model, y_pred) - 1) / 2.0 AS rb FROM oof WHERE model = 'ols')""") + f"""
SELECT target, model, {r("median(abs(y_pred - y_true))", name="median_abs_error")}, {r("avg((sign(y_true) = sign(y_pred))::INT)", name="directional_accuracy")},
 {r("corr(y_true, y_pred)", name="pearson")}, {r("corr(ra, rb)", name="spearman")}, {r("sqrt(avg((y_pred - y_true) ** 2)) / stddev_pop(y_true)", name="rmse_normalised")}
FROM rk GROUP BY target, model""")
def m02_extended_metrics(spark, sf_dir):
    t = mt.extended_metrics(oof(spark, sf_dir).where("model = 'ols'"), ["target", "model"])
    cols = ["median_abs_error", "directional_accuracy", "pearson", "spearman", "rmse_normalised"]
    return t.select("target", "model", *[rnd(c).alias(c) for c in cols])


SQL_DIR = """
dir AS (SELECT *, (y_true < 0)::INT AS y, 1 / (1 + exp(y_pred / 10)) AS prob FROM oof WHERE target = 'ret5' AND model IN ('ols', 'train_mean'))"""


def directions(spark, sf_dir):
    """Down-move labels with a probability from the signed forecast."""
    o = oof(spark, sf_dir).where((F.col("target") == "ret5") & F.col("model").isin("ols", "train_mean"))
    return o.withColumn("y", (F.col("y_true") < 0).cast("int")).withColumn("prob", 1 / (1 + F.exp(F.col("y_pred") / 10)))


_CONF = """SELECT model, count(*) AS n, sum((prob >= 0.5 AND y = 1)::INT)::BIGINT AS tp, sum((prob >= 0.5 AND y = 0)::INT)::BIGINT AS fp,
  sum((prob < 0.5 AND y = 0)::INT)::BIGINT AS tn, sum((prob < 0.5 AND y = 1)::INT)::BIGINT AS fn, avg((prob - y) ** 2) AS brier FROM dir GROUP BY 1"""


@query("m03_classification_metrics", ctes(SQL_OOF, SQL_DIR, f"""
c AS ({_CONF}), d AS (SELECT *, coalesce(tp / nullif((tp + fp)::DOUBLE, 0), 0) AS pr, coalesce(tp / nullif((tp + fn)::DOUBLE, 0), 0) AS re,
 coalesce(tn / nullif((tn + fp)::DOUBLE, 0), 0) AS sp FROM c)""") + f"""
SELECT model, n, tp, fp, tn, fn, {r("brier", name="brier")}, {r("(tp + tn) / n", name="accuracy")}, {r("(re + sp) / 2", name="balanced_accuracy")},
 {r("coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0)", name="mcc")},
 {r("pr", name="precision")}, {r("re", name="recall")}, {r("sp", name="specificity")}, {r("coalesce(2 * pr * re / nullif(pr + re, 0), 0)", name="f1")},
 {r("greatest(tp + fn, tn + fp) / n", name="majority_baseline")}, (tp + tn) / n > greatest(tp + fn, tn + fp) / n AS beats_majority FROM d""")
def m03_classification_metrics(spark, sf_dir):
    t = mt.classification_metrics(directions(spark, sf_dir), ["model"])
    keep = ["model", "n", "tp", "fp", "tn", "fn", "beats_majority"]
    return t.select(*keep, *[rnd(c).alias(c) for c in t.columns if c not in keep])


SQL_AUC = """
rkd AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2.0 AS rk FROM dir),
aucs AS (SELECT model, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg,
 (sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS auc FROM rkd GROUP BY 1)"""


@query("m04_f09_roc_auc", ctes(SQL_OOF, SQL_DIR, SQL_AUC, """
h AS (SELECT *, sqrt((auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc) + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n_pos::DOUBLE * n_neg)) AS se FROM aucs)""") + f"""
SELECT model, n_pos, n_neg, {r("auc", name="auc")}, {r("greatest(0, auc - 1.96 * se)", name="auc_low")}, {r("least(1, auc + 1.96 * se)", name="auc_high")} FROM h""")
def m04_f09_roc_auc(spark, sf_dir):
    t = mt.roc_auc(directions(spark, sf_dir), ["model"])
    lo, hi = sc.hanley_mcneil("auc", "n_pos", "n_neg")
    return t.select("model", "n_pos", "n_neg", rnd("auc").alias("auc"), rnd(lo).alias("auc_low"), rnd(hi).alias("auc_high"))


@query("m04_document_auc", ctes("""
d AS (SELECT l.toxic AS y, n_chars::DOUBLE AS s FROM documents JOIN labels l USING (doc_id)),
k AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM d)""") + f"""
SELECT sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, {r("(sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))", name="auc")} FROM k""")
def m04_document_auc(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("prob")).join(
        table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id").withColumn("g", F.lit(1))
    return mt.roc_auc(d, ["g"]).select("n_pos", "n_neg", rnd("auc").alias("auc"))


@query("m05_average_precision", ctes(SQL_OOF, SQL_DIR, """
th AS (SELECT model, prob, sum(y) AS p, sum(1 - y) AS q FROM dir GROUP BY 1, 2),
cu AS (SELECT *, sum(p) OVER (PARTITION BY model ORDER BY prob DESC) AS tp, sum(q) OVER (PARTITION BY model ORDER BY prob DESC) AS fp, sum(p) OVER (PARTITION BY model) AS tot FROM th)""") + f"""
SELECT model, {r("sum(p / tot * (tp / (tp + fp)))", name="average_precision")} FROM cu GROUP BY 1""")
def m05_average_precision(spark, sf_dir):
    return mt.average_precision(directions(spark, sf_dir), ["model"]).select("model", rnd("average_precision").alias("average_precision"))


@query("m06_calibration_line", ctes(SQL_OOF, SQL_DIR) + f"""
SELECT model, {r("regr_slope(y, ln(prob / (1 - prob)))", 4, "calibration_slope")}, {r("regr_intercept(y, ln(prob / (1 - prob)))", 4, "calibration_intercept")}
FROM dir WHERE prob > 0 AND prob < 1 AND model = 'ols' GROUP BY 1""")
def m06_calibration_line(spark, sf_dir):
    t = mt.calibration_line(directions(spark, sf_dir).where("model = 'ols'"), ["model"])
    return t.select("model", rnd("calibration_slope", 4).alias("calibration_slope"), rnd("calibration_intercept", 4).alias("calibration_intercept"))


SQL_PERFOLD = f"""
pfm AS (SELECT target, model, fold, count(*) AS n, sqrt(avg((y_pred - y_true) ** 2)) AS rmse, avg(abs(y_pred - y_true)) AS mae,
 1 - sum((y_pred - y_true) ** 2) / (count(*) * var_pop(y_true)) AS r2, 1 - sqrt(avg((y_pred - y_true) ** 2)) / sqrt(avg(y_true ** 2)) AS skill,
 avg((sign(y_true) = sign(y_pred))::INT) AS da FROM oof GROUP BY 1, 2, 3)"""


@query("m07_fold_metrics", ctes(SQL_OOF, SQL_PERFOLD) + f"""
SELECT target, model, fold, n, {r("rmse", name="rmse")}, {r("mae", name="mae")}, {r("r2", name="r2")}, {r("skill", name="skill")}, {r("da", name="directional_accuracy")} FROM pfm""")
def m07_fold_metrics(spark, sf_dir):
    per, _ = mt.fold_stability(oof(spark, sf_dir), ["target", "model"])
    return per.select("target", "model", "fold", "n", *[rnd(c).alias(c) for c in ("rmse", "mae", "r2", "skill", "directional_accuracy")])


@query("m07_fold_stability", ctes(SQL_OOF, SQL_PERFOLD, """
bst AS (SELECT target, model, fold FROM (SELECT *, row_number() OVER (PARTITION BY target, model ORDER BY round(skill, 12) DESC, fold) AS rn FROM pfm) WHERE rn = 1)""") + f"""
SELECT target, model, {", ".join(r(f"avg({c})", name=f"{c}_mean") + ", " + r(f"stddev_samp({c})", name=f"{c}_std") for c in ("rmse", "mae", "r2", "skill"))}, any_value(bst.fold) AS best_fold
FROM pfm JOIN bst USING (target, model) WHERE model IN ('ols', 'train_mean') GROUP BY 1, 2""")
def m07_fold_stability(spark, sf_dir):
    _, across = mt.fold_stability(oof(spark, sf_dir).where(F.col("model").isin("ols", "train_mean")), ["target", "model"])
    cols = [f"{c}_{s}" for c in ("rmse", "mae", "r2", "skill") for s in ("mean", "std")]
    return across.select("target", "model", *[rnd(c).alias(c) for c in cols], "best_fold")


@query("m08_spread_diagnostics", ctes(SQL_OOF) + f"""
SELECT target, model, {r("stddev_pop(y_true)", name="sd_true")}, {r("stddev_pop(y_pred)", name="sd_pred")},
 {r("quantile_cont(y_true, 0.75) - quantile_cont(y_true, 0.25)", name="iqr_true")}, {r("quantile_cont(y_pred, 0.75) - quantile_cont(y_pred, 0.25)", name="iqr_pred")},
 CASE WHEN stddev_pop(y_pred) / stddev_pop(y_true) < 0.3 THEN 'collapsing' WHEN stddev_pop(y_pred) / stddev_pop(y_true) > 1.5 THEN 'excessive' ELSE 'reasonable' END AS verdict
FROM oof GROUP BY 1, 2""")
def m08_spread_diagnostics(spark, sf_dir):
    t = mt.spread_diagnostics(oof(spark, sf_dir), ["target", "model"])
    return t.select("target", "model", *[rnd(c).alias(c) for c in ("sd_true", "sd_pred", "iqr_true", "iqr_pred")], "verdict")


@query("m09_f08_conformal", ctes(SQL_OOF, """
pr AS (SELECT a.target, a.model, f.fold, abs(a.y_true - a.y_pred) AS res FROM oof a JOIN fl f ON a.fold < f.fold WHERE a.model = 'ols'),
rk AS (SELECT *, row_number() OVER (PARTITION BY target, model, fold ORDER BY res) AS rn, count(*) OVER (PARTITION BY target, model, fold) AS n FROM pr),
q AS (SELECT target, model, fold, min(res) AS hw FROM rk WHERE rn >= least(ceil((n + 1) * 0.8), n) GROUP BY 1, 2, 3),
cv AS (SELECT o.target, o.model, o.fold, count(*) AS n, sum((abs(y_true - y_pred) <= hw)::INT) AS k, max(hw) AS hw FROM oof o JOIN q USING (target, model, fold) GROUP BY 1, 2, 3),
tt AS (SELECT target, model, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, avg(hw) AS hw FROM cv GROUP BY 1, 2)""") + f"""
SELECT target, model, n::BIGINT AS n, k::BIGINT AS covered, {r("k / n", name="coverage")}, {r("hw", name="half_width")},
 {r("greatest(0, (k / n + 1.96 ** 2 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 ** 2 / (4 * n * n))) / (1 + 1.96 ** 2 / n))", name="wilson_low")},
 {r("least(1, (k / n + 1.96 ** 2 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 ** 2 / (4 * n * n))) / (1 + 1.96 ** 2 / n))", name="wilson_high")} FROM tt""")
def m09_f08_conformal(spark, sf_dir):
    per = mt.conformal(oof(spark, sf_dir).where("model = 'ols'"), ["target", "model"])
    t = per.groupBy("target", "model").agg(F.sum("n").alias("n"), F.sum("covered").alias("covered"), F.avg("half_width").alias("half_width"))
    lo, hi = sc.wilson("covered", "n")
    return t.select("target", "model", "n", "covered", rnd(F.col("covered") / F.col("n")).alias("coverage"), rnd("half_width").alias("half_width"),
                    rnd(lo).alias("wilson_low"), rnd(hi).alias("wilson_high"))


SQL_OEPI = f"""{SQL_EPI},
oo AS (SELECT o.*, e.series_id || ':' || CAST(CAST(e.episode AS BIGINT) AS VARCHAR) AS cluster FROM oof o JOIN epi e USING (event_id))"""


def clustered(spark, sf_dir):
    """Out-of-fold rows with the episode they belong to."""

    def build():
        from tremor.sources.adapters import shocks

        days = ev.episode_days(shocks(spark, sf_dir), ["series_id"], "event_date")
        return oof(spark, sf_dir).join(days, ["series_id", "event_date"]).withColumn(
            "cluster", F.concat_ws(":", "series_id", F.col("episode").cast("string")))

    return staged_once(spark, sf_dir, "clustered", build)


@query("m11_prediction_ledger", ctes(SQL_OOF, SQL_OEPI) + f"""
SELECT a.target, a.fold, a.event_id, a.label_end AS resolution_date, a.cluster, {r("a.y_true", name="y_true")}, {r("a.ols", name="ols")}, {r("a.mean", name="train_mean")},
 {r("a.med", name="train_median")}, 0.0::DOUBLE AS zero FROM oo a WHERE a.model = 'ols'""")
def m11_prediction_ledger(spark, sf_dir):
    """One row per target and event: every model side by side, from one grouped pass."""
    g = clustered(spark, sf_dir).groupBy("target", "fold", "event_id", F.col("label_end").alias("resolution_date"), "cluster", "y_true")
    wide = g.pivot("model", MODELS).agg(F.first("y_pred"))
    return wide.select("target", "fold", "event_id", "resolution_date", "cluster", *[rnd(c).alias(c) for c in ("y_true", *MODELS)])


@query("m12_exact_date_sensitivity", ctes(SQL_OOF) + f"""
SELECT target, model, count(*) AS n_exact, {r("CASE WHEN count(*) >= 8 THEN 1 - sum((y_pred - y_true) ** 2) / (count(*) * var_pop(y_true)) END", name="r2_exact")}
FROM oof WHERE status = 'F' GROUP BY 1, 2""")
def m12_exact_date_sensitivity(spark, sf_dir):
    t = mt.regression_metrics(oof(spark, sf_dir).where("status = 'F'"), ["target", "model"])
    return t.select("target", "model", F.col("n").alias("n_exact"), rnd(F.when(F.col("n") >= 8, F.col("r2"))).alias("r2_exact"))


@query("f11_skill_scores", ctes(SQL_OOF, """
m AS (SELECT target, model, sqrt(avg((y_pred - y_true) ** 2)) AS rmse FROM oof GROUP BY 1, 2)""") + f"""
SELECT a.target, a.model, {r("1 - a.rmse / b.rmse", name="skill_vs_zero")}, {r("1 - a.rmse ** 2 / b.rmse ** 2", name="mse_reduction")}
FROM m a JOIN m b ON a.target = b.target AND b.model = 'zero' WHERE a.model <> 'zero'""")
def f11_skill_scores(spark, sf_dir):
    m = mt.regression_metrics(oof(spark, sf_dir), ["target", "model"]).select("target", "model", "rmse")
    zero = m.where("model = 'zero'").select("target", F.col("rmse").alias("ref"))
    j = m.where("model <> 'zero'").join(zero, "target")
    return j.select("target", "model", rnd(sc.skill("rmse", "ref")).alias("skill_vs_zero"),
                    rnd(sc.skill(F.col("rmse") * F.col("rmse"), F.col("ref") * F.col("ref"))).alias("mse_reduction"))


@query("f15_minimum_detectable_effect", ctes(SQL_OOF, """
b AS (SELECT target, count(*) AS n, stddev_samp(y_true - y_pred) AS sd, var_samp(y_true) AS vy, sqrt(avg((y_true - y_pred) ** 2)) AS rb FROM oof WHERE model = 'train_mean' GROUP BY 1),
c AS (SELECT *, sqrt(2.0) * sd * (1.959964 + 0.841621) / sqrt(n) AS mde FROM b)""") + f"""
SELECT target, n, {r("sd", name="sd_residual")}, {r("mde", name="mde_rmse")}, {r("(1 - greatest(0, rb - mde) ** 2 / vy) - (1 - rb ** 2 / vy)", name="mde_r2")} FROM c""")
def f15_minimum_detectable_effect(spark, sf_dir):
    e = F.col("y_true") - F.col("y_pred")
    t = oof(spark, sf_dir).where("model = 'train_mean'").groupBy("target").agg(
        F.count("*").alias("n"), F.stddev_samp(e).alias("sd"), F.var_samp("y_true").alias("vy"), F.sqrt(F.avg(e * e)).alias("rb"))
    # fixed values: normal quantiles of a 5 % two-sided level and 80 % power
    mde = F.sqrt(F.lit(2.0)) * F.col("sd") * (1.959964 + 0.841621) / F.sqrt("n")
    alt = F.greatest(F.lit(0.0), F.col("rb") - mde)
    return t.select("target", "n", rnd("sd").alias("sd_residual"), rnd(mde).alias("mde_rmse"),
                    rnd((1 - alt * alt / F.col("vy")) - (1 - F.col("rb") * F.col("rb") / F.col("vy"))).alias("mde_r2"))


@query("a18_leave_one_out", ctes(SQL_OOF, """
t AS (SELECT target, model, count(*)::DOUBLE AS n, avg(y_true) AS m, var_pop(y_true) AS v, sum((y_pred - y_true) ** 2) AS sse FROM oof WHERE model = 'ols' GROUP BY 1, 2)""") + f"""
SELECT o.target, o.event_id, {r("1 - (sse - (y_pred - y_true) ** 2) / (n * v - (y_true - m) ** 2 * n / (n - 1))", name="loo_r2")}
FROM oof o JOIN t USING (target, model)""")
def a18_leave_one_out(spark, sf_dir):
    t = mt.leave_one_out(oof(spark, sf_dir).where("model = 'ols'"), ["target"], "event_id")
    return t.select("target", "event_id", rnd("loo_r2").alias("loo_r2"))


@query("a18_top_influence", ctes(SQL_OOF, """
t AS (SELECT target, model, count(*)::DOUBLE AS n, avg(y_true) AS m, var_pop(y_true) AS v, sum((y_pred - y_true) ** 2) AS sse FROM oof WHERE model = 'ols' GROUP BY 1, 2),
i AS (SELECT o.target, o.event_id, (1 - sse / (n * v)) - (1 - (sse - (y_pred - y_true) ** 2) / (n * v - (y_true - m) ** 2 * n / (n - 1))) AS inf FROM oof o JOIN t USING (target, model) WHERE target = 'ret5')""") + f"""
SELECT event_id, {r("inf", name="influence")} FROM i ORDER BY abs(inf) DESC, event_id LIMIT 5""")
def a18_top_influence(spark, sf_dir):
    t = mt.leave_one_out(oof(spark, sf_dir).where("model = 'ols' AND target = 'ret5'"), ["target"], "event_id")
    return t.orderBy(F.abs("influence").desc(), "event_id").limit(5).select("event_id", rnd("influence").alias("influence"))


def _draw_sql(src, by, cluster, n_boot, seed=42, tag="dr"):
    """Bootstrap weights: numbered clusters, md5 picks, counted."""
    cols = "".join(f"{c}, " for c in by)
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    join = " AND ".join([f"p.{c} = n.{c}" for c in by] + ["p.no = n.no"])
    return f"""
{tag}_n AS (SELECT {cols}{cluster} AS cluster, row_number() OVER ({part}ORDER BY {cluster}::VARCHAR) - 1 AS no FROM (SELECT DISTINCT {cols}{cluster} FROM {src})),
{tag}_c AS (SELECT {cols}count(*) AS c FROM {tag}_n {'GROUP BY ' + ', '.join(by) if by else ''}),
{tag}_q AS (SELECT {cols}c, b, q, md5('{seed}:' || b || ':' || q) AS m
  FROM (SELECT {cols}c, unnest(range(0, {n_boot})) AS b FROM {tag}_c), LATERAL (SELECT unnest(range(0, (c + 3) // 4)) AS q)),
{tag}_v AS (SELECT {cols}c, b, q, i, ('0x' || substr(m, CASE WHEN i < 2 THEN 1 ELSE 17 END, 15))::BIGINT AS v FROM {tag}_q, (VALUES (0), (1), (2), (3)) t(i) WHERE 4 * q + i < c),
{tag}_p AS (SELECT {cols}b, CAST(floor((CASE WHEN i % 2 = 0 THEN v & 1073741823 ELSE v >> 30 END) / 1073741824.0::DOUBLE * c) AS BIGINT) AS no FROM {tag}_v),
{tag} AS (SELECT {''.join(f'n.{c}, ' for c in by)}p.b, n.cluster, count(*) AS w FROM {tag}_p p JOIN {tag}_n n ON {join} GROUP BY ALL)"""


@query("b01_seeded_draws", ctes(SQL_OOF, _draw_sql("ow", [], "series_id", 200)) + """
SELECT CAST(b AS INTEGER) AS b, cluster, w FROM dr""")
def b01_seeded_draws(spark, sf_dir):
    c = oof(spark, sf_dir).select(F.col("series_id").alias("cluster")).distinct()
    return cluster_draws(c, [], "cluster", 200)


#: Draws for metrics and concordance, and for error differences.
NB, NB_ERROR = 2000, 10_000


def _pairs_sql(where):
    return f"""
pr AS (SELECT m.*, b.y_pred AS y_base, b.model AS base FROM oo m JOIN oo b ON b.target = m.target AND b.fold = m.fold AND b.event_id = m.event_id WHERE {where})"""


def _boot_sql(by, metric="rmse"):
    g = ", ".join(by)
    cols = "".join(f"{c}, " for c in by)
    on = " AND ".join([f"t.{c} = d.{c}" for c in by if c == "target"] + ["t.cluster = d.cluster"])
    delta = "sqrt(sum({w}sb) / sum({w}nr)) - sqrt(sum({w}sm) / sum({w}nr))" if metric == "rmse" else "sum({w}ab) / sum({w}nr) - sum({w}am) / sum({w}nr)"
    return f"""
te AS (SELECT {cols}cluster, sum((y_pred - y_true) ** 2) AS sm, sum((y_base - y_true) ** 2) AS sb, sum(abs(y_pred - y_true)) AS am, sum(abs(y_base - y_true)) AS ab, count(*)::DOUBLE AS nr FROM pr GROUP BY {cols}cluster),
ds AS (SELECT {''.join(f't.{c}, ' for c in by)}d.b, {delta.format(w='w * ')} AS dv FROM te t JOIN dr d ON {on} GROUP BY ALL),
ci AS (SELECT {cols}quantile_cont(dv, 0.025) AS lo, quantile_cont(dv, 0.975) AS hi, avg((dv <= 0)::INT) AS p FROM ds GROUP BY {g}),
pt AS (SELECT {cols}sum(nr)::BIGINT AS n, {delta.format(w='')} AS delta FROM te GROUP BY {g})"""


SQL_DRAWS_T = _draw_sql("oo", ["target"], "cluster", NB_ERROR)


@query("b02_paired_bootstrap", ctes(SQL_OOF, SQL_OEPI, _pairs_sql("m.model = 'ols' AND b.model = 'train_mean'"), SQL_DRAWS_T, _boot_sql(["target"])) + f"""
SELECT target, n, {r("delta", name="delta")}, {r("lo", 5, "ci_low")}, {r("hi", 5, "ci_high")}, {r("p", name="p_worse")}, lo > 0 AS significant FROM pt JOIN ci USING (target)""")
def b02_paired_bootstrap(spark, sf_dir):
    p = mt.paired(clustered(spark, sf_dir).where(F.col("model").isin("ols", "train_mean")), ["target", "fold", "event_id"], "train_mean")
    b = rs.paired_bootstrap(rs.error_terms(p, ["target"], "cluster"), ["target"], "cluster", NB_ERROR)
    return b.select("target", "n", rnd("delta").alias("delta"), rnd("ci_low", 5).alias("ci_low"), rnd("ci_high", 5).alias("ci_high"), rnd("p_worse").alias("p_worse"), "significant")


@query("b02_paired_bootstrap_mae", ctes(SQL_OOF, SQL_OEPI, _pairs_sql("m.model = 'ols' AND b.model = 'zero'"), SQL_DRAWS_T, _boot_sql(["target"], "mae")) + f"""
SELECT target, n, {r("delta", name="delta")}, {r("lo", 5, "ci_low")}, {r("hi", 5, "ci_high")}, {r("p", name="p_worse")} FROM pt JOIN ci USING (target)""")
def b02_paired_bootstrap_mae(spark, sf_dir):
    p = mt.paired(clustered(spark, sf_dir).where(F.col("model").isin("ols", "zero")), ["target", "fold", "event_id"], "zero")
    b = rs.paired_bootstrap(rs.error_terms(p, ["target"], "cluster"), ["target"], "cluster", NB_ERROR, metric="mae")
    return b.select("target", "n", rnd("delta").alias("delta"), rnd("ci_low", 5).alias("ci_low"), rnd("ci_high", 5).alias("ci_high"), rnd("p_worse").alias("p_worse"))


SQL_DM = """
dl AS (SELECT *, (y_base - y_true) ** 2 - (y_pred - y_true) ** 2 AS d, row_number() OVER (PARTITION BY target ORDER BY ord) AS k FROM pr),
dm AS (SELECT target, count(*)::DOUBLE AS n, avg(d) AS db, var_pop(d) AS g0 FROM dl GROUP BY 1)"""


@query("b08_diebold_mariano", ctes(SQL_OOF, SQL_OEPI, _pairs_sql("m.model = 'ols' AND b.model = 'train_mean'"), SQL_DM, """
lg AS (SELECT a.target, b.k - a.k AS lag, avg((a.d - dm.db) * (b.d - dm.db)) AS c FROM dl a JOIN dl b ON a.target = b.target AND b.k - a.k BETWEEN 1 AND 4 JOIN dm ON dm.target = a.target GROUP BY 1, 2),
lr AS (SELECT target, sum(2 * (1 - lag / 5.0) * c) AS e FROM lg GROUP BY 1)""") + f"""
SELECT target, n::BIGINT AS n, {r("sqrt(n / n) * db / sqrt(g0 / n) * sqrt((n + 1 - 2 + 0) / n)", 5, "dm_h1")},
 {r("CASE WHEN g0 + e > 0 THEN db / sqrt((g0 + e) / n) * sqrt((n + 1 - 10 + 20 / n) / n) END", 5, "dm_h5")} FROM dm JOIN lr USING (target)""")
def b08_diebold_mariano(spark, sf_dir):
    p = mt.paired(clustered(spark, sf_dir).where(F.col("model").isin("ols", "train_mean")), ["target", "fold", "event_id"], "train_mean")
    # position among scored rows: ord has gaps where labels are missing
    from tremor.functions.ordered import order_index

    parts = [order_index(p.where(F.col("target") == t), "event_date", "event_id", "pos") for t in TARGETS]
    placed = parts[0].unionByName(parts[1])
    h1 = rs.diebold_mariano(placed, ["target"], 1, "pos").select("target", "n", F.col("dm_stat").alias("dm_h1"))
    h5 = rs.diebold_mariano(placed, ["target"], 5, "pos").select("target", F.col("dm_stat").alias("dm_h5"))
    return h1.join(h5, "target").select("target", "n", rnd("dm_h1", 5).alias("dm_h1"), rnd("dm_h5", 5).alias("dm_h5"))


SQL_VERDICT = f"""
vd AS (SELECT pt.target, pt.model, pt.base, pt.n, pt.delta, lo, hi, p FROM pt JOIN ci USING (target, model, base)),
hl AS (SELECT *, least(1, max((m - rn + 1) * p) OVER (PARTITION BY target ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_holm FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY p, model, base) AS rn, count(*) OVER (PARTITION BY target) AS m FROM vd))"""


@query("b09_b10_b11_verdicts", ctes(SQL_OOF, SQL_OEPI, _pairs_sql("m.model <> b.model AND m.model IN ('ols', 'train_median') AND b.model IN ('zero', 'train_mean')"), SQL_DRAWS_T,
       _boot_sql(["target", "model", "base"]), SQL_VERDICT) + f"""
SELECT target, model, base AS baseline, n, {r("delta", name="delta")}, {r("lo", 5, "ci_low")}, {r("hi", 5, "ci_high")}, {r("p", name="p_worse")}, {r("p_holm", name="p_holm")},
 CASE WHEN lo > 0 THEN 'BEATS BASELINE' WHEN delta > 0 THEN 'better, not distinguishable' ELSE 'worse than baseline' END AS verdict FROM hl""")
def b09_b10_b11_verdicts(spark, sf_dir):
    c = clustered(spark, sf_dir)
    t = verdicts(c, ["ols", "train_median"], ["zero", "train_mean"])
    return t.select("target", "model", "baseline", "n", rnd("delta").alias("delta"), rnd("ci_low", 5).alias("ci_low"), rnd("ci_high", 5).alias("ci_high"),
                    rnd("p_worse").alias("p_worse"), rnd("p_holm").alias("p_holm"), "verdict")


def verdicts(c, models, bases, n_boot=NB_ERROR, cluster="cluster"):
    """Each model against each baseline: clustered interval, Holm p per target, text verdict.

    All comparisons of a target share one set of draws.
    """
    base = c.where(F.col("model").isin(bases)).select("target", "fold", "event_id", F.col("model").alias("baseline"), F.col("y_pred").alias("y_base"))
    pairs = c.where(F.col("model").isin(models)).join(base, ["target", "fold", "event_id"])
    by = ["target", "model", "baseline"]
    terms = rs.error_terms(pairs, by, cluster)
    draws = cluster_draws(terms.select("target", cluster).distinct(), ["target"], cluster, n_boot)
    b = rs.holm(rs.paired_bootstrap(terms, by, cluster, n_boot, draws=draws), ["target"], "p_worse", ["model", "baseline"])
    verdict = F.when(F.col("significant"), "BEATS BASELINE").when(F.col("delta") > 0, "better, not distinguishable").otherwise("worse than baseline")
    return b.withColumn("verdict", verdict)


@query("b14_hazard_group_bootstrap", ctes(SQL_OOF, SQL_OEPI, _pairs_sql("m.model = 'ols' AND b.model = 'train_mean' AND m.target = 'vol5'"),
       _draw_sql("pr", ["type"], "cluster", NB_ERROR), _boot_sql(["type"]).replace("ON t.cluster = d.cluster", "ON t.type = d.type AND t.cluster = d.cluster")) + f"""
SELECT type, n, {r("delta", name="delta")}, {r("lo", 5, "ci_low")}, {r("hi", 5, "ci_high")} FROM pt JOIN ci USING (type)""")
def b14_hazard_group_bootstrap(spark, sf_dir):
    c = clustered(spark, sf_dir).where("target = 'vol5'").where(F.col("model").isin("ols", "train_mean"))
    p = mt.paired(c, ["target", "fold", "event_id"], "train_mean")
    b = rs.paired_bootstrap(rs.error_terms(p, ["type"], "cluster"), ["type"], "cluster", NB_ERROR)
    return b.select("type", "n", rnd("delta").alias("delta"), rnd("ci_low", 5).alias("ci_low"), rnd("ci_high", 5).alias("ci_high"))


@query("b07_equivalence", ctes(SQL_OOF, SQL_OEPI, """
evq AS (SELECT target, cluster, event_id, avg((y_pred - y_true) ** 2) FILTER (model IN ('ols', 'train_median')) AS se, max((y_pred - y_true) ** 2) FILTER (model = 'train_mean') AS sb FROM oo GROUP BY 1, 2, 3),
ec AS (SELECT target, cluster, sum(se) AS sm, sum(sb) AS sb, count(*)::DOUBLE AS nr FROM evq GROUP BY 1, 2)""", SQL_DRAWS_T, """
ds AS (SELECT t.target, b, sqrt(sum(w * sb) / sum(w * nr)) - sqrt(sum(w * sm) / sum(w * nr)) AS dv FROM ec t JOIN dr d ON t.target = d.target AND t.cluster = d.cluster GROUP BY 1, 2),
ci AS (SELECT target, quantile_cont(dv, 0.05) AS lo, quantile_cont(dv, 0.95) AS hi FROM ds GROUP BY 1)""") + f"""
SELECT target, {r("lo", 5, "ci_low")}, {r("hi", 5, "ci_high")}, lo > -0.5 AND hi < 0.5 AS equivalent FROM ci""")
def b07_equivalence(spark, sf_dir):
    """Mean squared error over models per event; equivalent when the 90 % interval sits inside the margin."""
    c = clustered(spark, sf_dir)
    e2 = F.pow(F.col("y_pred") - F.col("y_true"), 2)
    ev_ = c.groupBy("target", "cluster", "event_id").agg(
        F.avg(F.when(F.col("model").isin("ols", "train_median"), e2)).alias("se"), F.max(F.when(F.col("model") == "train_mean", e2)).alias("sb"))
    terms = ev_.groupBy("target", "cluster").agg(F.sum("se").alias("sm"), F.sum("sb").alias("sb"), F.lit(0.0).alias("am"), F.lit(0.0).alias("ab"), F.count("*").alias("nr"))
    b = rs.paired_bootstrap(terms, ["target"], "cluster", NB_ERROR, alpha=0.10)
    inside = (F.col("ci_low") > -0.5) & (F.col("ci_high") < 0.5)
    return b.select("target", rnd("ci_low", 5).alias("ci_low"), rnd("ci_high", 5).alias("ci_high"), inside.alias("equivalent"))


SQL_DIRC = """
dd AS (SELECT d.*, e.series_id || ':' || CAST(CAST(e.episode AS BIGINT) AS VARCHAR) AS cluster FROM dir d JOIN epi e USING (event_id) WHERE d.model = 'ols')"""


def _auc_sql(joined):
    """Interval of the weighted AUC of ``joined`` (b, prob, y, w), and the plain AUC of dd."""
    return f"""
wc AS (SELECT b, prob, sum(w * y) AS p, sum(w * (1 - y)) AS q FROM {joined} GROUP BY 1, 2),
wb AS (SELECT *, sum(q) OVER (PARTITION BY b ORDER BY prob) - q / 2.0 AS below FROM wc),
ds AS (SELECT b, sum(p * below) / nullif(sum(p) * sum(q), 0) AS v FROM wb GROUP BY 1),
oc AS (SELECT prob, sum(y) AS p, sum(1 - y) AS q FROM dd GROUP BY 1),
ob AS (SELECT sum(p * below) / (sum(p) * sum(q)) AS v FROM (SELECT *, sum(q) OVER (ORDER BY prob) - q / 2.0 AS below FROM oc))"""


_AUC_OUT = f"""
SELECT {r("(SELECT v FROM ob)", name="value")}, count(*) AS n_draws, {r("quantile_cont(v, 0.025)", name="ci_low")}, {r("quantile_cont(v, 0.975)", name="ci_high")} FROM ds WHERE v IS NOT NULL"""


def clustered_directions(spark, sf_dir):
    """Direction scores of the line model, with each event's episode."""
    c = clustered(spark, sf_dir).where("model = 'ols' AND target = 'ret5'").select("event_id", "cluster")
    return directions(spark, sf_dir).where("model = 'ols'").join(c, "event_id")


def _auc_out(b):
    return b.select(rnd("value").alias("value"), "n_draws", rnd("ci_low").alias("ci_low"), rnd("ci_high").alias("ci_high"))


@query("b05_cluster_auc_bootstrap", ctes(SQL_OOF, SQL_DIR, SQL_EPI, SQL_DIRC, _draw_sql("dd", [], "cluster", NB),
       "dj AS (SELECT d.b, dd.prob, dd.y, d.w FROM dd JOIN dr d USING (cluster))", _auc_sql("dj")) + _AUC_OUT)
def b05_cluster_auc_bootstrap(spark, sf_dir):
    """Episodes are drawn, whatever their number."""
    return _auc_out(rs.auc_bootstrap(clustered_directions(spark, sf_dir), ["model"], "cluster", "y", "prob", NB))


@query("b05_stratified_auc", ctes(SQL_OOF, SQL_DIR, SQL_EPI, SQL_DIRC, _draw_sql("dd", ["y"], "event_id", NB),
       "dj AS (SELECT d.b, dd.prob, dd.y, d.w FROM dd JOIN dr d ON d.cluster = dd.event_id AND d.y = dd.y)", _auc_sql("dj")) + _AUC_OUT)
def b05_stratified_auc(spark, sf_dir):
    """Rows are drawn within their class."""
    return _auc_out(rs.auc_bootstrap(clustered_directions(spark, sf_dir), ["model"], "event_id", "y", "prob", NB, within=["y"]))


@query("b12_label_permutation", ctes(SQL_OOF, SQL_DIR, SQL_EPI, SQL_DIRC, """
rk AS (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS rk FROM dd),
cs AS (SELECT cluster, sum(rk) AS rs, count(*)::DOUBLE AS nr, min_by(y, event_id) AS label FROM rk GROUP BY 1),
sh AS (SELECT b, rs, nr, (row_number() OVER (PARTITION BY b ORDER BY ('0x' || substr(md5('42:' || b || ':' || cluster), 1, 8))::BIGINT, cluster) <= (SELECT sum(label) FROM cs))::INT AS label FROM cs, (SELECT unnest(range(0, 5000)) AS b)),
au AS (SELECT b, (sum(rs) FILTER (label = 1) - (sum(nr) FILTER (label = 1)) * (sum(nr) FILTER (label = 1) + 1) / 2) / ((sum(nr) FILTER (label = 1)) * (sum(nr) - sum(nr) FILTER (label = 1))) AS a FROM sh GROUP BY 1),
ob AS (SELECT (sum(rs) FILTER (label = 1) - (sum(nr) FILTER (label = 1)) * (sum(nr) FILTER (label = 1) + 1) / 2) / ((sum(nr) FILTER (label = 1)) * (sum(nr) - sum(nr) FILTER (label = 1))) AS a FROM cs)""") + f"""
SELECT {r("any_value(ob.a)", name="observed_auc")}, {r("avg(au.a)", name="perm_mean")}, {r("stddev_pop(au.a)", name="perm_sd")}, {r("quantile_cont(au.a, 0.95)", name="perm_p95")},
 {r("(1 + sum((au.a >= ob.a)::INT)) / (1 + count(*))", name="p_value")} FROM au, ob""")
def b12_label_permutation(spark, sf_dir):
    p = rs.permutation_auc(clustered_directions(spark, sf_dir), ["model"], "cluster", "event_id", "y", "prob", 5000)
    return p.select(*[rnd(c).alias(c) for c in ("observed_auc", "perm_mean", "perm_sd", "perm_p95", "p_value")])
