"""The return grid over information sets and capacities, its stability table and its verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions import scalars as sc
from tremor.functions.scalars import rnd
from tremor.operators import events as ev
from tremor.operators import folds as fd
from tremor.operators import grid as gr
from tremor.operators import logistic as lg
from tremor.operators import metrics as mt
from tremor.operators import models as md
from tremor.operators import outcomes as oc
from tremor.operators import resample as rs
from tremor.plans.forecast_queries import SQL_MEM, geometry, ordered
from tremor.plans.outcome_queries import features
from tremor.plans.registry import ctes, query, r
from tremor.schema import assert_no_leak, feature_spec, information_sets
from tremor.session import stage, staged_once
from tremor.sources.adapters import shocks

#: Features of the grid: known before the session, and reported after the event.
MARKET = ["lag_return_1", "price_to_sma_20", "vol_ratio_5_30"]
REPORTED = ["severity", "affected", "log_severity"]
WIDE = [*MARKET, "lag_return_2", "lag_return_3", "price_to_sma_5", "price_to_sma_10", "vol_ratio_1_30", "vol_ratio_10_30", *REPORTED]
KEYS = ("horizon", "fold")


def sets_of(spark, columns):
    """Information sets by availability, from the declared classes of the columns."""
    by_class = information_sets(feature_spec(spark, columns))
    return {"ex_post": [c for c in columns if c in by_class["ex_post"]], "real_time": [c for c in columns if c in by_class["real_time"]],
            "event_only": [c for c in columns if c not in by_class["real_time"]]}


def information_rows(spark, sf_dir):
    """Purged and imputed fold rows of every return horizon with all features."""

    def build():
        market = [c for c in WIDE if c not in REPORTED]
        # features join once per event, before events are repeated for folds and horizons
        o = ordered(spark, sf_dir).select("event_id", "event_date", "series_id", "session_idx", "pos", *(f"y1_{h}{e}" for h in oc.RETURN_HORIZONS for e in ("", "_end")))
        o = o.join(features(spark, sf_dir).select("series_id", "session_idx", *market), ["series_id", "session_idx"], "left")
        o = o.join(shocks(spark, sf_dir).select("event_id", "severity", "affected"), "event_id").withColumn("log_severity", sc.log1p_clipped("severity"))
        m = fd.fold_membership(stage(o, "information_events"), geometry(spark, sf_dir))
        cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y1_{h}").alias("y"), F.col(f"y1_{h}_end").alias("label_end")) for h in oc.RETURN_HORIZONS])
        long = m.select("fold", "role", "event_id", "event_date", "series_id", *WIDE, F.explode(cells).alias("_c")).select("*", "_c.*").drop("_c").where("y IS NOT NULL")
        return fd.median_imputed(fd.purge(long, "event_date", "label_end", KEYS), WIDE, KEYS)

    return staged_once(spark, sf_dir, "information_rows", build)


def _sql_grid() -> str:
    xs = [*MARKET, *REPORTED]
    horizons = oc.RETURN_HORIZONS
    value = {"lag_return_1": "lr1.v", "price_to_sma_20": "x1", "vol_ratio_5_30": "x2", "severity": "severity", "affected": "affected", "log_severity": "ln(1 + greatest(severity, 0))"}
    long = " UNION ALL ".join(
        f"SELECT {h} AS horizon, fold, role, event_id, event_date, y1_{h} AS y, y1_{h}_end AS label_end, {', '.join(f'{v} AS {c}' for c, v in value.items())} FROM mem LEFT JOIN lr1 USING (series_id, session_idx) WHERE y1_{h} IS NOT NULL" for h in horizons)
    tall = " UNION ALL ".join(f"SELECT horizon, fold, role, event_id, y, {k} AS f, {c} AS v FROM gp" for k, c in enumerate(xs))
    sets = {"ex_post": range(6), "real_time": range(3), "event_only": range(3, 6)}
    w1 = "CASE WHEN f2 IS NULL THEN n * c1 / (n + alpha) ELSE ((n + alpha) * n * c1 - n * rr * n * c2) / ((n + alpha) ** 2 - n * n * rr * rr) END / s1"
    w2 = "CASE WHEN f2 IS NULL THEN 0 ELSE ((n + alpha) * n * c2 - n * rr * n * c1) / ((n + alpha) ** 2 - n * n * rr * rr) / s2 END"
    return f"""
lr0 AS (SELECT series_id, session_idx, ln(close / lag(close) OVER (PARTITION BY series_id ORDER BY session_idx)) AS lr FROM sess),
lr1 AS (SELECT series_id, session_idx, lag(lr) OVER (PARTITION BY series_id ORDER BY session_idx) AS v FROM lr0),
gl AS ({long}),
gf AS (SELECT horizon, fold, min(event_date) AS ftd FROM gl WHERE role = 'test' GROUP BY ALL),
gp AS (SELECT gl.* FROM gl JOIN gf USING (horizon, fold) WHERE role = 'test' OR label_end IS NULL OR label_end < ftd),
gt AS ({tall}),
gd AS (SELECT horizon, fold, f, median(v) AS med FROM gt WHERE role = 'train' GROUP BY ALL),
gx AS (SELECT horizon, fold, role, event_id, y, f, coalesce(v, med, 0) AS v FROM gt LEFT JOIN gd USING (horizon, fold, f)),
go AS (SELECT *, row_number() OVER (PARTITION BY horizon, fold ORDER BY event_date, event_id) - 1 AS pos, count(*) OVER (PARTITION BY horizon, fold) AS cnt FROM gp WHERE role = 'train'),
gi AS (SELECT o.*, s, CASE WHEN pos < cnt - (3 - s) * (cnt // 4) THEN 'train' WHEN pos < cnt - (3 - s) * (cnt // 4) + cnt // 4 THEN 'validation' END AS ir FROM go o, (SELECT unnest(range(0, 3)) AS s)),
gv AS (SELECT horizon, fold, s, min(event_date) AS d FROM gi WHERE ir = 'validation' GROUP BY ALL),
gs AS (SELECT horizon, fold, s, ir, event_id FROM gi JOIN gv USING (horizon, fold, s) WHERE ir = 'validation' OR (ir = 'train' AND (label_end IS NULL OR label_end < d))
  UNION ALL SELECT horizon, fold, -1, 'train', event_id FROM go),
gr AS (SELECT s.horizon, s.fold, s.s, s.ir, x.event_id, x.f, x.v, x.y FROM gs s JOIN gx x ON x.horizon = s.horizon AND x.fold = s.fold AND x.event_id = s.event_id AND x.role = 'train'),
g1 AS (SELECT horizon, fold, s, f, count(*)::DOUBLE AS n, avg(v) AS m, avg(y) AS ay, stddev_pop(v) AS sd, covar_pop(v, y) / stddev_pop(v) AS c, corr(v, y) AS r FROM gr WHERE ir = 'train' GROUP BY ALL HAVING stddev_pop(v) > 1e-9),
g2 AS (SELECT a.horizon, a.fold, a.s, a.f AS f1, b.f AS f2, corr(a.v, b.v) AS rr FROM gr a JOIN gr b ON a.horizon = b.horizon AND a.fold = b.fold AND a.s = b.s AND a.event_id = b.event_id AND a.f <> b.f WHERE a.ir = 'train' AND b.ir = 'train' GROUP BY ALL),
iset AS ({" UNION ALL ".join(f"SELECT '{n}' AS info_set, unnest([{', '.join(map(str, fs))}]) AS f" for n, fs in sets.items())}),
p1 AS (SELECT horizon, fold, s, info_set, g1.f AS f1, n, ay, m AS m1, sd AS s1, c AS c1, r AS r1 FROM g1 JOIN iset USING (f) QUALIFY row_number() OVER (PARTITION BY horizon, fold, s, info_set ORDER BY round(r * r, 12) DESC, g1.f) = 1),
p2 AS (SELECT p1.horizon, p1.fold, p1.s, p1.info_set, g1.f AS f2, g1.m AS m2, g1.sd AS s2, g1.c AS c2, rr
  FROM p1 JOIN iset i ON i.info_set = p1.info_set JOIN g1 ON g1.horizon = p1.horizon AND g1.fold = p1.fold AND g1.s = p1.s AND g1.f = i.f AND g1.f <> p1.f1
  JOIN g2 ON g2.horizon = p1.horizon AND g2.fold = p1.fold AND g2.s = p1.s AND g2.f1 = p1.f1 AND g2.f2 = g1.f WHERE abs(rr) <= 0.9
  QUALIFY row_number() OVER (PARTITION BY p1.horizon, p1.fold, p1.s, p1.info_set ORDER BY round((g1.r - r1 * rr) ** 2 / (1 - rr * rr), 12) DESC, g1.f) = 1),
pk AS (SELECT *, 1 AS k, NULL AS f2, NULL AS m2, NULL AS s2, NULL AS c2, NULL AS rr FROM p1 UNION ALL
  SELECT p1.*, 2, f2, m2, s2, c2, rr FROM p1 LEFT JOIN p2 USING (horizon, fold, s, info_set)),
ga AS (SELECT unnest([{", ".join(repr(a) for a in md.ALPHAS)}])::DOUBLE AS alpha),
gw AS (SELECT *, {w1} AS w1, {w2} AS w2 FROM pk, ga),
ge AS (SELECT w.horizon, w.fold, w.s, w.info_set, w.k, w.alpha, sqrt(avg((ay + w1 * (a.v - m1) + w2 * coalesce(b.v - m2, 0) - a.y) ** 2)) AS rmse
  FROM gw w JOIN gr a ON a.horizon = w.horizon AND a.fold = w.fold AND a.s = w.s AND a.f = w.f1 AND a.ir = 'validation'
  LEFT JOIN gr b ON b.horizon = w.horizon AND b.fold = w.fold AND b.s = w.s AND b.f = w.f2 AND b.ir = 'validation' AND b.event_id = a.event_id WHERE w.s >= 0 AND w.n >= 5 GROUP BY ALL),
gm AS (SELECT horizon, fold, info_set, k, alpha, round(avg(rmse), 10) AS e FROM ge GROUP BY ALL),
gb AS (SELECT horizon, fold, info_set, k, alpha FROM gm QUALIFY row_number() OVER (PARTITION BY horizon, fold, info_set, k ORDER BY e, alpha) = 1),
fit AS (SELECT w.* FROM gw w JOIN gb USING (horizon, fold, info_set, k, alpha) WHERE s = -1),
gq AS (SELECT f.horizon, f.fold, f.info_set, f.k, a.event_id, a.y AS y_true, ay + w1 * (a.v - m1) + w2 * coalesce(b.v - m2, 0) AS y_pred
  FROM fit f JOIN gx a ON a.horizon = f.horizon AND a.fold = f.fold AND a.f = f.f1 AND a.role = 'test'
  LEFT JOIN gx b ON b.horizon = f.horizon AND b.fold = f.fold AND b.f = f.f2 AND b.role = 'test' AND b.event_id = a.event_id),
tb AS (SELECT horizon, fold, avg(y) AS mean, median(y) AS med FROM gp WHERE role = 'train' GROUP BY ALL),
gy AS (SELECT horizon, fold, info_set, k, 'ridge' AS model, event_id, y_true, y_pred FROM gq
  UNION ALL SELECT horizon, fold, 'baseline', 0, unnest(['zero', 'train_mean', 'train_median']), event_id, y, unnest([0.0, mean, med]) FROM gp JOIN tb USING (horizon, fold) WHERE role = 'test')"""


SQL_INFORMATION = f"{SQL_MEM},{_sql_grid()}"


def small_fits(spark, sf_dir):
    def build():
        d = information_rows(spark, sf_dir)
        return gr.grid_fits(d, sets_of(spark, [*MARKET, *REPORTED]), "y", "label_end", KEYS, (1, 2), ("ridge",))

    return staged_once(spark, sf_dir, "small_fits", build)


def grid_scores(rows, fits, columns):
    """(horizon, fold, info_set, k, model, event_id, y_true, y_pred) of all cells and baselines."""
    shared = ["horizon", "fold", "info_set", "k", "model", "event_id", F.col("y").alias("y_true"), "y_pred"]
    p = gr.grid_predictions(rows.where("role = 'test'"), fits, columns, KEYS).select(*shared)
    return p.unionByName(gr.baselines(rows, "y", KEYS).select(*shared))


@query("l06_l11_information_fits", ctes(SQL_INFORMATION) + f"""
SELECT CAST(horizon AS INTEGER) AS horizon, fold, info_set, CAST(k AS INTEGER) AS k, {r("alpha", 6, "alpha")}, CAST(n AS BIGINT) AS n_train, CAST(f1 AS INTEGER) AS first_feature, CAST(coalesce(f2, -1) AS INTEGER) AS second_feature,
  {r("ay - w1 * m1 - coalesce(w2 * m2, 0)", 4, "intercept")} FROM fit""")
def l06_l11_information_fits(spark, sf_dir):
    """Picked features, penalty and intercept of every ridge cell of one and two features."""
    xs = F.array(*map(F.lit, [*MARKET, *REPORTED]))
    place = lambda k: (F.array_position(xs, F.try_element_at("features", F.lit(k))) - 1).cast("int")
    f = small_fits(spark, sf_dir)
    return f.select("horizon", "fold", "info_set", "k", rnd("alpha").alias("alpha"), "n_train", place(1).alias("first_feature"), F.coalesce(place(2), F.lit(-1)).alias("second_feature"), rnd("intercept", 4).alias("intercept"))


@query("l06_l11_information_grid", ctes(SQL_INFORMATION) + f"""
SELECT CAST(horizon AS INTEGER) AS horizon, info_set, CAST(k AS INTEGER) AS k, model, count(*) AS n, {r("sqrt(avg((y_pred - y_true) ** 2))", 4, "rmse")}, {r("avg(abs(y_pred - y_true))", 4, "mae")},
  {r("1 - sum((y_pred - y_true) ** 2) / (count(*) * var_pop(y_true))", 4, "r2")}, {r("sqrt(avg(y_true ** 2)) - sqrt(avg((y_pred - y_true) ** 2))", 4, "rmse_improvement")},
  {r("1 - sqrt(avg((y_pred - y_true) ** 2)) / sqrt(avg(y_true ** 2))", 4, "rmse_reduction")} FROM gy GROUP BY ALL""")
def l06_l11_information_grid(spark, sf_dir):
    """Horizon x information set x capacity, with the baselines on the same held-out rows."""
    p = grid_scores(information_rows(spark, sf_dir), small_fits(spark, sf_dir), [*MARKET, *REPORTED])
    return _grid_table(p).select("horizon", "info_set", "k", "model", "n", *(rnd(c, 4).alias(c) for c in ("rmse", "mae", "r2", "rmse_improvement", "rmse_reduction")))


def _grid_table(p):
    by = ["horizon", "info_set", "k", "model"]
    t = mt.regression_metrics(p, by)
    zero = p.groupBy(*by).agg(F.sqrt(F.avg(F.col("y_true") * F.col("y_true"))).alias("_zero"))
    t = t.join(zero, by)
    return t.withColumn("rmse_improvement", F.col("_zero") - F.col("rmse")).withColumn("rmse_reduction", 1 - F.col("rmse") / F.nullif("_zero", F.lit(0.0)))


@query("a13_information_stability", ctes(SQL_INFORMATION, """
pf AS (SELECT DISTINCT horizon, fold, info_set, k, unnest([f1, f2]) AS f, unnest([1, 2]) AS rank FROM fit),
nf AS (SELECT horizon, info_set, k, count(DISTINCT fold) AS n_folds FROM fit GROUP BY ALL)""") + f"""
SELECT CAST(horizon AS INTEGER) AS horizon, info_set, CAST(k AS INTEGER) AS k, [{", ".join(repr(c) for c in [*MARKET, *REPORTED])}][f + 1] AS feature, count(DISTINCT fold) AS selection_count, {r("avg(rank)", 6, "mean_rank")},
  {r("median(rank)", 6, "median_rank")}, any_value(n_folds) AS n_folds, {r("count(DISTINCT fold) / any_value(n_folds)", 6, "selection_frequency")} FROM pf JOIN nf USING (horizon, info_set, k) WHERE f IS NOT NULL GROUP BY ALL""")
def a13_information_stability(spark, sf_dir):
    """How often and at which rank each feature was picked, per horizon, information set and capacity."""
    s = gr.stability(small_fits(spark, sf_dir))
    return s.select("horizon", "info_set", "k", "feature", "selection_count", rnd("mean_rank").alias("mean_rank"), rnd("median_rank").alias("median_rank"), "n_folds", rnd("selection_frequency").alias("selection_frequency"))


@query("l06_full_grid")
def l06_full_grid(spark, sf_dir):
    """All features, capacities 2, 5 and 10, ridge and elastic net; checked against plain fits in tests."""
    d = information_rows(spark, sf_dir)
    fits = gr.grid_fits(d, sets_of(spark, WIDE), "y", "label_end", KEYS, (2, 5, 10))
    return _grid_table(grid_scores(d, fits, WIDE)).select("horizon", "info_set", "k", "model", "n", "rmse", "mae", "r2", "rmse_improvement", "rmse_reduction")


#: Draws of the direction table's intervals.
AUC_DRAWS = 1000


def direction_scores(spark, sf_dir):
    """(horizon, event_id, cluster, y, prob): held-out probabilities of a falling price at every horizon."""

    def build():
        d = information_rows(spark, sf_dir).withColumn("down", (F.col("y") < 0).cast("int"))
        columns = [*MARKET, *REPORTED]
        assert_no_leak(columns)
        fits = lg.logistic_walk_forward(d, columns, "down", "label_end", KEYS)
        p = lg.probabilities(d.where("role = 'test'"), fits, columns, KEYS)
        days = ev.episode_days(shocks(spark, sf_dir), ["series_id"], "event_date")
        return p.join(days.select("series_id", "event_date", "episode"), ["series_id", "event_date"]).select(
            "horizon", "event_id", F.concat_ws(":", "series_id", F.col("episode").cast("string")).alias("cluster"), F.col("down").alias("y"), "prob")

    return staged_once(spark, sf_dir, "direction_scores", build)


@query("m14_direction_table")
def m14_direction_table(spark, sf_dir):
    """Per horizon: confusion counts, AUC with its interval over episodes, one-sided p, Holm over horizons.

    Penalties are chosen by AUC on inner splits; the fits are checked against a plain solver in tests.
    """
    o, by = direction_scores(spark, sf_dir), ["horizon"]
    t = mt.classification_metrics(o, by).join(mt.average_precision(o, by), by).join(mt.calibration_line(o, by), by, "left")
    n = o.groupBy(*by).agg(F.countDistinct("cluster").alias("n_episodes"))
    auc = rs.auc_bootstrap(o, by, "cluster", "y", "prob", AUC_DRAWS, against=0.5)
    j = t.join(n, by).join(auc.withColumnsRenamed({"value": "roc_auc", "ci_low": "auc_ci_low", "ci_high": "auc_ci_high"}), by, "left")
    return rs.holm(j.withColumn("family", F.lit("direction")), ["family"], "p_one_sided", ["horizon"]).drop("family")
