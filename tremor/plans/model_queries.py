"""Model fits in walk-forward, blends, ablations, scoring and importance."""

from __future__ import annotations

import os
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import AFTSurvivalRegression, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.draws import cluster_draws, hash_unit
from tremor.functions.ordered import exact_quantiles, order_index
from tremor.functions import scalars as sc
from tremor.functions.scalars import rnd
from tremor.operators import diagnose as dg
from tremor.operators import folds as fd
from tremor.operators import metrics as mt
from tremor.operators import models as md
from tremor.operators import outcomes as oc
from tremor.operators import resample as rs
from tremor.operators import series as sr
from tremor.operators import survival as sv
from tremor.plans.forecast_queries import NB_ERROR, SQL_MEM, SQL_OEPI, SQL_OOF, _boot_sql, _draw_sql, clustered, geometry, members, oof, ordered
from tremor.plans.outcome_queries import SQL_RET, SQL_SESS, features, panel
from tremor.plans.registry import ctes, query, r
from tremor.session import shared_dir, stage, staged_once
from tremor.sources.adapters import SQL_SHOCKS, sessions, shocks, table

XS = ["x1", "x2"]


def rows(spark, sf_dir, y="y1_5", end="y1_5_end", name="rows_ret5"):
    """Purged, imputed fold rows of one target, staged for the fits."""

    def build():
        m = fd.purge(members(spark, sf_dir).where(F.col(y).isNotNull()), "event_date", end)
        return fd.median_imputed(m, XS).select("fold", "role", "event_id", "event_date", "series_id", "type", "ord", F.col(y).alias("y"), F.col(end).alias("label_end"), *XS,
                                               "duration", "event_observed", "drawdown", "reason", "y3_end")

    return staged_once(spark, sf_dir, name, build)


#: Draws of the panel bootstrap and of the refitted permutation.
N_DRAWS = 5000


def n_folds(spark, sf_dir):
    return list(range(geometry(spark, sf_dir).n_folds))


SQL_ROWS = f"""{SQL_MEM},
m_r AS (SELECT m.*, y1_5 AS y FROM mem m WHERE y1_5 IS NOT NULL), f_r AS (SELECT fold, min(event_date) AS ftd FROM m_r WHERE role = 'test' GROUP BY 1),
p_r AS (SELECT m_r.* FROM m_r JOIN f_r USING (fold) WHERE role = 'test' OR y1_5_end IS NULL OR y1_5_end < ftd),
d_r AS (SELECT fold, coalesce(median(x1), 0) AS m1, coalesce(median(x2), 0) AS m2 FROM p_r WHERE role = 'train' GROUP BY 1),
rw AS (SELECT p.fold, role, event_id, event_date, series_id, type, ord, y, y1_5_end AS label_end, coalesce(x1, m1) AS x1, coalesce(x2, m2) AS x2 FROM p_r p JOIN d_r USING (fold))"""

def _ridge_sql(src, keys=("fold",), y="y", end="label_end", blocks=("both",), tag=""):
    """CTEs ending in ``fit{tag}``: standardised two-column ridge with purged inner splits."""
    t, k = tag, ", ".join(keys)
    on = f"({k})"
    mom = f"""count(*)::DOUBLE AS n, avg(x1) AS a1, avg(x2) AS a2, avg({y}) AS ay, CASE WHEN stddev_pop(x1) > 1e-9 THEN stddev_pop(x1) ELSE 1 END AS s1, CASE WHEN stddev_pop(x2) > 1e-9 THEN stddev_pop(x2) ELSE 1 END AS s2,
  CASE WHEN stddev_pop(x1) > 1e-9 AND stddev_pop(x2) > 1e-9 THEN corr(x1, x2) ELSE 0 END AS r,
  CASE WHEN stddev_pop(x1) > 1e-9 THEN covar_pop(x1, {y}) / stddev_pop(x1) ELSE 0 END AS c1, CASE WHEN stddev_pop(x2) > 1e-9 THEN covar_pop(x2, {y}) / stddev_pop(x2) ELSE 0 END AS c2"""
    w1 = "CASE block WHEN 'x1' THEN n * c1 / (n + alpha) WHEN 'x2' THEN 0 ELSE ((n + alpha) * n * c1 - n * r * n * c2) / ((n + alpha) ** 2 - n * n * r * r) END / s1"
    w2 = "CASE block WHEN 'x2' THEN n * c2 / (n + alpha) WHEN 'x1' THEN 0 ELSE ((n + alpha) * n * c2 - n * r * n * c1) / ((n + alpha) ** 2 - n * n * r * r) END / s2"
    return f"""
pos{t} AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY event_date, event_id) - 1 AS pos, count(*) OVER (PARTITION BY {k}) AS cnt FROM {src} WHERE role = 'train'),
ins{t} AS (SELECT p.*, s.split, CASE WHEN pos < cnt - (3 - split) * (cnt // 4) THEN 'train' WHEN pos < cnt - (3 - split) * (cnt // 4) + cnt // 4 THEN 'validation' END AS ir FROM pos{t} p, (SELECT unnest(range(0, 3)) AS split) s),
fvd{t} AS (SELECT {k}, split, min(event_date) AS d FROM ins{t} WHERE ir = 'validation' GROUP BY ALL),
inn{t} AS (SELECT i.* FROM ins{t} i JOIN fvd{t} USING ({k}, split) WHERE ir = 'validation' OR (ir = 'train' AND ({end} IS NULL OR {end} < d))),
al{t} AS (SELECT unnest([{", ".join(repr(a) for a in md.ALPHAS)}])::DOUBLE AS alpha),
bk{t} AS (SELECT unnest([{", ".join(repr(b) for b in blocks)}]) AS block),
im{t} AS (SELECT {k}, split, {mom} FROM inn{t} WHERE ir = 'train' GROUP BY {k}, split),
iw{t} AS (SELECT *, {w1} AS w1, {w2} AS w2 FROM im{t}, al{t}, bk{t}),
isc{t} AS (SELECT {", ".join("v." + c for c in keys)}, v.split, w.alpha, w.block, sqrt(avg((ay - w1 * a1 - w2 * a2 + w1 * x1 + w2 * x2 - {y}) ** 2)) AS rmse FROM inn{t} v JOIN iw{t} w USING ({k}, split) WHERE v.ir = 'validation' AND w.n >= 5 GROUP BY ALL),
pick{t} AS (SELECT {k}, block, alpha FROM (SELECT {k}, block, alpha, row_number() OVER (PARTITION BY {k}, block ORDER BY round(avg(rmse), 10), alpha) AS rn FROM isc{t} GROUP BY {k}, block, alpha) WHERE rn = 1),
om{t} AS (SELECT {k}, {mom} FROM {src} WHERE role = 'train' GROUP BY {k}),
fit{t} AS (SELECT {k}, block, alpha, n, {w1} AS w1, {w2} AS w2, ay, a1, a2 FROM om{t} JOIN pick{t} USING {on})"""


SQL_INNER = _ridge_sql("rw")


def ridge_fits(spark, sf_dir):
    return staged_once(spark, sf_dir, "ridge_fits", lambda: md.ridge_walk_forward(rows(spark, sf_dir), XS, "y", "label_end"))


@query("l01_ridge_inner_cv", ctes(SQL_ROWS, SQL_INNER) + f"""
SELECT fold, {r("alpha", name="alpha")}, n::BIGINT AS n_train, {r("ay - w1 * a1 - w2 * a2", 5, "intercept")}, {r("w1", 5, "w1")}, {r("w2", 5, "w2")} FROM fit""")
def l01_ridge_inner_cv(spark, sf_dir):
    f = ridge_fits(spark, sf_dir)
    return f.select("fold", rnd("alpha").alias("alpha"), "n_train", rnd("intercept", 5).alias("intercept"),
                    rnd(F.element_at("slopes", 1), 5).alias("w1"), rnd(F.element_at("slopes", 2), 5).alias("w2"))


@query("l01_ridge_predictions", ctes(SQL_ROWS, SQL_INNER) + f"""
SELECT fold, event_id, {r("ay - w1 * a1 - w2 * a2 + w1 * x1 + w2 * x2", 5, "y_pred")} FROM rw JOIN fit USING (fold) WHERE role = 'test'""")
def l01_ridge_predictions(spark, sf_dir):
    p = md.linear_predictions(rows(spark, sf_dir).where("role = 'test'"), ridge_fits(spark, sf_dir), ["fold"], XS)
    return p.select("fold", "event_id", rnd("y_pred", 5).alias("y_pred"))


@query("m13_overfit_gap", ctes(SQL_ROWS, SQL_INNER, """
pr AS (SELECT fold, role, y, ay - w1 * a1 - w2 * a2 + w1 * x1 + w2 * x2 AS p FROM rw JOIN fit USING (fold)),
g AS (SELECT fold, role, 1 - sum((p - y) ** 2) / (count(*) * var_pop(y)) AS r2 FROM pr GROUP BY 1, 2)""") + f"""
SELECT fold, {r("max(r2) FILTER (role = 'train')", 5, "r2_train")}, {r("max(r2) FILTER (role = 'test')", 5, "r2_test")}, {r("max(r2) FILTER (role = 'train') - max(r2) FILTER (role = 'test')", 5, "gap")} FROM g GROUP BY 1""")
def m13_overfit_gap(spark, sf_dir):
    p = md.linear_predictions(rows(spark, sf_dir), ridge_fits(spark, sf_dir), ["fold"], XS).withColumnRenamed("y", "y_true")
    g = p.groupBy("fold").pivot("role", ["train", "test"]).agg(mt.regression_aggs()[3])
    return g.select("fold", rnd("train", 5).alias("r2_train"), rnd("test", 5).alias("r2_test"), rnd(F.col("train") - F.col("test"), 5).alias("gap"))


@query("l13_permutation_importance", ctes(SQL_ROWS, SQL_INNER, """
te AS (SELECT *, row_number() OVER (ORDER BY event_date, event_id) - 1 AS pos, count(*) OVER () AS n_all FROM rw WHERE role = 'test'),
sh AS (SELECT f.feature, rp.repeat, ('0x' || substr(md5('42:' || f.feature || ':' || rp.repeat), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM (SELECT unnest(['x1', 'x2']) AS feature) f, (SELECT unnest(range(0, 5)) AS repeat) rp),
jj AS (SELECT sh.feature, sh.repeat, a.y, fit.ay - w1 * a1 - w2 * a2 + w1 * a.x1 + w2 * a.x2 AS p0,
  fit.ay - w1 * a1 - w2 * a2 + w1 * CASE WHEN sh.feature = 'x1' THEN b.x1 ELSE a.x1 END + w2 * CASE WHEN sh.feature = 'x2' THEN b.x2 ELSE a.x2 END AS p1
  FROM te a JOIN fit USING (fold) CROSS JOIN sh JOIN te b ON b.pos = (a.pos + CAST(floor(sh.u * a.n_all) AS BIGINT)) % a.n_all),
pr AS (SELECT feature, repeat, sqrt(avg((p1 - y) ** 2)) - sqrt(avg((p0 - y) ** 2)) AS d FROM jj GROUP BY 1, 2)""") + f"""
SELECT feature, {r("avg(d)", 5, "importance")}, {r("stddev_pop(d)", 5, "spread")} FROM pr GROUP BY 1""")
def l13_permutation_importance(spark, sf_dir):
    test = rows(spark, sf_dir).where("role = 'test'")
    n = test.count()
    t = order_index(test, "event_date", "event_id", "pos")
    imp = md.permutation_importance(t, ridge_fits(spark, sf_dir), XS, "y", n, 5)
    return imp.select("feature", rnd("importance", 5).alias("importance"), rnd("spread", 5).alias("spread"))


SQL_BLEND = """
pf AS (SELECT target, model, fold, sum((y_pred - y_true) ** 2) AS s, count(*) AS c FROM oof WHERE model IN ('ols', 'train_mean', 'train_median') GROUP BY 1, 2, 3),
wt AS (SELECT target, model, fold, coalesce(1 / greatest(sqrt(sum(s) OVER w / sum(c) OVER w), 1e-8), 1) AS w FROM pf WINDOW w AS (PARTITION BY target, model ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bl AS (SELECT target, fold, event_id, max(y_true) AS y_true, sum(w * y_pred) / sum(w) AS y_pred FROM oof JOIN wt USING (target, model, fold) GROUP BY 1, 2, 3)"""


@query("l07_ensemble_blend", ctes(SQL_OOF, SQL_BLEND) + f" SELECT target, fold, event_id, {r('y_pred', name='y_pred')} FROM bl")
def l07_ensemble_blend(spark, sf_dir):
    return md.prior_fold_blend(oof(spark, sf_dir), ["ols", "train_mean", "train_median"], ["target"], "event_id").select("target", "fold", "event_id", rnd("y_pred").alias("y_pred"))


@query("b17_shrinkage_scan", ctes(SQL_OOF, SQL_BLEND, "al AS (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS alpha)", """
sc AS (SELECT target, alpha, sqrt(avg((alpha * y_pred - y_true) ** 2)) AS rmse FROM bl, al WHERE fold < (SELECT max(fold) FROM bl) GROUP BY 1, 2)""") + f"""
SELECT target, {r("alpha", 2, "alpha")}, {r("rmse", name="rmse")}, row_number() OVER (PARTITION BY target ORDER BY rmse, alpha) = 1 AS chosen FROM sc""")
def b17_shrinkage_scan(spark, sf_dir):
    """Shrink the blend toward zero; the factor is chosen on all folds but the last."""
    b = md.prior_fold_blend(oof(spark, sf_dir), ["ols", "train_mean", "train_median"], ["target"], "event_id")
    last = max(n_folds(spark, sf_dir))
    e = lambda a: F.lit(a) * F.col("y_pred") - F.col("y_true")
    alphas = [0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
    g = b.where(F.col("fold") < last).groupBy("target").agg(*[F.sqrt(F.avg(e(a) * e(a))).alias(f"r{i}") for i, a in enumerate(alphas)])
    t = g.select("target", F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.col(f"r{i}").alias("rmse")) for i, a in enumerate(alphas)])).alias("_x")).select("target", "_x.*")
    w = W.partitionBy("target").orderBy("rmse", "alpha")
    return t.select("target", rnd("alpha", 2).alias("alpha"), rnd("rmse").alias("rmse"), (F.row_number().over(w) == 1).alias("chosen"))


@query("l08_stacked_weights")
def l08_stacked_weights(spark, sf_dir):
    """Non-negative stacking on prior folds: both weight conventions side by side."""
    wide = oof(spark, sf_dir).groupBy("target", "fold", "event_id", "y_true").pivot("model", ["ols", "train_mean", "train_median"]).agg(F.first("y_pred"))
    names = ["ols", "train_mean", "train_median"]
    a = md.stack_weights(wide, ["target"], names, "y_true", True).withColumn("convention", F.lit("intercept"))
    b = md.stack_weights(wide, ["target"], names, "y_true", False).withColumn("convention", F.lit("sum_to_one"))
    return a.unionByName(b).orderBy("target", "convention", "fold")


@query("e10_stage_a_expected", ctes(SQL_RET, """
z AS (SELECT *, lag(log_return) OVER w AS f1, CASE WHEN count(*) OVER b20 = 20 THEN lag(close) OVER w / avg(close) OVER b20 - 1 END AS g, 100 * ln(lead(close, 4) OVER w / lag(close) OVER w) AS y
  FROM rets WINDOW w AS (PARTITION BY series_id ORDER BY date), b20 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
z2 AS (SELECT series_id, session_idx, date, f1, lag(g) OVER (PARTITION BY series_id ORDER BY date) AS f2, y FROM z),
z3 AS (SELECT *, CASE WHEN f1 IS NOT NULL AND f2 IS NOT NULL AND y IS NOT NULL THEN 1 END AS ok FROM z2),
mo AS (SELECT series_id, session_idx, f1, f2, count(ok) OVER w AS n, avg(CASE WHEN ok = 1 THEN f1 END) OVER w AS a1, avg(CASE WHEN ok = 1 THEN f2 END) OVER w AS a2, avg(CASE WHEN ok = 1 THEN y END) OVER w AS ay,
  stddev_pop(CASE WHEN ok = 1 THEN f1 END) OVER w AS s1, stddev_pop(CASE WHEN ok = 1 THEN f2 END) OVER w AS s2,
  covar_pop(CASE WHEN ok = 1 THEN f1 END, CASE WHEN ok = 1 THEN f2 END) OVER w AS v12, covar_pop(CASE WHEN ok = 1 THEN f1 END, CASE WHEN ok = 1 THEN y END) OVER w AS v1y, covar_pop(CASE WHEN ok = 1 THEN f2 END, CASE WHEN ok = 1 THEN y END) OVER w AS v2y
  FROM z3 WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING)),
c AS (SELECT *, v12 / (s1 * s2) AS r, v1y / s1 AS c1, v2y / s2 AS c2 FROM mo WHERE n >= 250 AND f1 IS NOT NULL AND f2 IS NOT NULL)""") + f"""
SELECT series_id, session_idx, {r("ay + ((n + 10) * n * c1 - n * r * n * c2) / ((n + 10) ** 2 - n * n * r * r) / s1 * (f1 - a1) + ((n + 10) * n * c2 - n * r * n * c1) / ((n + 10) ** 2 - n * n * r * r) / s2 * (f2 - a2)", 4, "expected")} FROM c""")
def e10_stage_a_expected(spark, sf_dir):
    """Expected 5-session return from a ridge on all sessions settled before each session."""
    return stage_a(spark, sf_dir).select("series_id", "session_idx", rnd("expected", 4).alias("expected"))


def stage_a(spark, sf_dir):
    def build():
        w = sr.w_series()
        z = features(spark, sf_dir).select("series_id", "date", "session_idx", F.lag("log_return").over(w).alias("f1"), F.lag("price_to_sma_20").over(w).alias("f2"), oc.forward_return(5).alias("y"))
        return md.expanding_ridge(z, ["f1", "f2"], 5)

    return staged_once(spark, sf_dir, "stage_a", build)


SQL_STAGE_A = """
z AS (SELECT *, lag(log_return) OVER w AS f1, CASE WHEN count(*) OVER b20 = 20 THEN lag(close) OVER w / avg(close) OVER b20 - 1 END AS g, 100 * ln(lead(close, 4) OVER w / lag(close) OVER w) AS y
  FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY series_id ORDER BY date)) AS log_return FROM sess) WINDOW w AS (PARTITION BY series_id ORDER BY date), b20 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
z2 AS (SELECT series_id, session_idx, date, f1, lag(g) OVER (PARTITION BY series_id ORDER BY date) AS f2, y FROM z),
z3 AS (SELECT *, CASE WHEN f1 IS NOT NULL AND f2 IS NOT NULL AND y IS NOT NULL THEN 1 END AS ok FROM z2),
mo AS (SELECT series_id, session_idx, f1, f2, count(ok) OVER w AS n, avg(CASE WHEN ok = 1 THEN f1 END) OVER w AS a1, avg(CASE WHEN ok = 1 THEN f2 END) OVER w AS a2, avg(CASE WHEN ok = 1 THEN y END) OVER w AS ay,
  stddev_pop(CASE WHEN ok = 1 THEN f1 END) OVER w AS s1, stddev_pop(CASE WHEN ok = 1 THEN f2 END) OVER w AS s2,
  covar_pop(CASE WHEN ok = 1 THEN f1 END, CASE WHEN ok = 1 THEN f2 END) OVER w AS v12, covar_pop(CASE WHEN ok = 1 THEN f1 END, CASE WHEN ok = 1 THEN y END) OVER w AS v1y, covar_pop(CASE WHEN ok = 1 THEN f2 END, CASE WHEN ok = 1 THEN y END) OVER w AS v2y
  FROM z3 WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING)),
ca AS (SELECT *, v12 / (s1 * s2) AS r, v1y / s1 AS c1, v2y / s2 AS c2 FROM mo WHERE n >= 250 AND f1 IS NOT NULL AND f2 IS NOT NULL),
ex AS (SELECT series_id, session_idx, ay + ((n + 10) * n * c1 - n * r * n * c2) / ((n + 10) ** 2 - n * n * r * r) / s1 * (f1 - a1) + ((n + 10) * n * c2 - n * r * n * c1) / ((n + 10) ** 2 - n * n * r * r) / s2 * (f2 - a2) AS expected FROM ca),
rx AS (SELECT rw.*, e.expected, rw.y - e.expected AS resid FROM rw JOIN fo USING (event_id) JOIN ex e ON e.series_id = fo.series_id AND e.session_idx = fo.session_idx)"""


@query("e11_normal_plus_residual", ctes(SQL_ROWS, SQL_STAGE_A, _ridge_sql("rx", y="resid")) + f"""
SELECT fold, event_id, {r("y", 4, "y_true")}, {r("expected", 4, "expected")}, {r("ay - w1 * a1 - w2 * a2 + w1 * x1 + w2 * x2 + expected", 4, "y_pred")},
 (SELECT count(*) FROM rw w WHERE w.role = 'test' AND w.fold = rx.fold) - count(*) OVER (PARTITION BY fold) AS n_unscored FROM rx JOIN fit USING (fold) WHERE role = 'test'""")
def e11_normal_plus_residual(spark, sf_dir):
    """Fit y minus its stage-A expectation, then add the expectation back."""
    expected = stage_a(spark, sf_dir)
    ids = ordered(spark, sf_dir).select("event_id", "series_id", "session_idx")
    e = ids.join(expected, ["series_id", "session_idx"]).select("event_id", "expected")
    d = stage(rows(spark, sf_dir).join(e, "event_id").withColumn("resid", F.col("y") - F.col("expected")), "residual_rows")
    fits = md.ridge_walk_forward(d, XS, "resid", "label_end")
    p = md.linear_predictions(d.where("role = 'test'"), fits, ["fold"], XS, "_r")
    # held-out rows without an expectation get no score; how many, is said beside each fold's scores
    test = rows(spark, sf_dir).where("role = 'test'").groupBy("fold").agg(F.count("*").alias("_all"))
    scored = d.where("role = 'test'").groupBy("fold").agg(F.count("*").alias("_scored"))
    left = test.join(scored, "fold").select("fold", (F.col("_all") - F.col("_scored")).alias("n_unscored"))
    return p.join(left, "fold").select("fold", "event_id", rnd("y", 4).alias("y_true"), rnd("expected", 4).alias("expected"), rnd(F.col("_r") + F.col("expected"), 4).alias("y_pred"), "n_unscored")


@query("e12_yearly_volatility")
def e12_yearly_volatility(spark, sf_dir):
    return md.yearly_volatility(features(spark, sf_dir))


def _score(p):
    return mt.regression_metrics(p.withColumnRenamed("y", "y_true"), ["model"])


@query("l02_l03_l04_mllib_regressors")
def l02_l03_l04_mllib_regressors(spark, sf_dir):
    """Elastic net, random forest and boosted trees per fold, pooled metrics."""
    d, fs = rows(spark, sf_dir), n_folds(spark, sf_dir)
    out = None
    for name, est in (
        ("elastic_net", LinearRegression(regParam=0.1, elasticNetParam=0.5)),
        ("random_forest", RandomForestRegressor(numTrees=30, maxDepth=4, seed=42)),
        ("boosted_trees", GBTRegressor(maxIter=10, maxDepth=3, seed=42)),
    ):
        p = md.fit_folds(d, fs, est, XS, "y", ["event_id", "y"]).withColumn("model", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return _score(out)


@query("l05_m14_classifiers")
def l05_m14_classifiers(spark, sf_dir):
    """Direction classifiers per fold with balanced weights, and their diagnostics."""
    d = rows(spark, sf_dir).withColumn("down", (F.col("y") < 0).cast("int"))
    d, fs = md.balanced_weights(d, "down"), n_folds(spark, sf_dir)
    out = None
    for name, est in (
        ("logistic", LogisticRegression(regParam=0.01, weightCol="w")),
        ("random_forest", RandomForestClassifier(numTrees=30, maxDepth=4, seed=42, weightCol="w")),
        ("boosted_trees", GBTClassifier(maxIter=10, maxDepth=3, seed=42, weightCol="w")),
    ):
        p = md.fit_folds(d, fs, est, [*XS], "down", ["event_id", "down", "w"], md.class_probability()).withColumn("model", F.lit(name))
        out = p if out is None else out.unionByName(p)
    o = out.select("model", "event_id", F.col("down").alias("y"), F.col("y_pred").alias("prob"))
    return mt.classification_metrics(o, ["model"]).join(mt.roc_auc(o, ["model"]), "model").join(mt.average_precision(o, ["model"]), "model").join(mt.calibration_line(o, ["model"]), "model", "left")


BLOCKS = {"both": ["x1", "x2"], "x1": ["x1"], "x2": ["x2"]}


def grid_rows(spark, sf_dir):
    """Fold rows of every return horizon in one long table: the grid is a key, not a loop."""

    def build():
        m = members(spark, sf_dir)
        cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y1_{h}").alias("y"), F.col(f"y1_{h}_end").alias("label_end")) for h in oc.RETURN_HORIZONS])
        long = m.select("fold", "role", "event_id", "event_date", "series_id", *XS, F.explode(cells).alias("_c")).select("*", "_c.*").drop("_c").where("y IS NOT NULL")
        by = ("horizon", "fold")
        return fd.median_imputed(fd.purge(long, "event_date", "label_end", by), XS, by)

    return staged_once(spark, sf_dir, "grid_rows", build)


def _sql_long(values, key, cols):
    union = " UNION ALL ".join(f"SELECT {v} AS {key}, fold, role, event_id, event_date, series_id, x1, x2, {y} AS y, {e} AS label_end FROM mem WHERE {y} IS NOT NULL" for v, (y, e) in zip(values, cols))
    return f"""
lg AS ({union}),
lf AS (SELECT {key}, fold, min(event_date) AS ftd FROM lg WHERE role = 'test' GROUP BY 1, 2),
lp AS (SELECT lg.* FROM lg JOIN lf USING ({key}, fold) WHERE role = 'test' OR label_end IS NULL OR label_end < ftd),
lm AS (SELECT {key}, fold, coalesce(median(x1), 0) AS m1, coalesce(median(x2), 0) AS m2 FROM lp WHERE role = 'train' GROUP BY 1, 2),
lr AS (SELECT {key}, fold, role, event_id, event_date, series_id, y, label_end, coalesce(x1, m1) AS x1, coalesce(x2, m2) AS x2 FROM lp JOIN lm USING ({key}, fold))"""


SQL_GRID = _sql_long(oc.RETURN_HORIZONS, "horizon", [(f"y1_{h}", f"y1_{h}_end") for h in oc.RETURN_HORIZONS])


@query("l06_l11_grid_ablation", ctes(SQL_MEM, SQL_GRID, _ridge_sql("lr", ("horizon", "fold"), blocks=("both", "x1", "x2")), """
gp AS (SELECT horizon, block, y AS y_true, ay - w1 * a1 - w2 * a2 + w1 * x1 + w2 * x2 AS y_pred FROM lr JOIN fit USING (horizon, fold) WHERE role = 'test')""") + f"""
SELECT CAST(horizon AS INTEGER) AS horizon, block, count(*) AS n, {r("sqrt(avg((y_pred - y_true) ** 2))", 5, "rmse")}, {r("1 - sum((y_pred - y_true) ** 2) / (count(*) * var_pop(y_true))", 5, "r2")} FROM gp GROUP BY 1, 2""")
def l06_l11_grid_ablation(spark, sf_dir):
    """Horizon x feature block x fold grid of ridge fits, all from one scan, pooled per configuration."""
    d, by = grid_rows(spark, sf_dir), ("horizon", "fold")
    fits = md.ridge_walk_forward(d, XS, "y", "label_end", by=by, blocks=BLOCKS)
    p = md.linear_predictions(d.where("role = 'test'"), fits, [*by], XS).withColumnRenamed("y", "y_true")
    t = mt.regression_metrics(p, ["horizon", "block"])
    return t.select("horizon", "block", "n", rnd("rmse", 5).alias("rmse"), rnd("r2", 5).alias("r2"))


@query("l09_log_duration_model", ctes(SQL_MEM, """
sl AS (SELECT m.*, s.date AS y3_end, ln(1 + m.duration) AS ly FROM mem m JOIN sess s ON s.series_id = m.series_id AND s.session_idx = least(m.session_idx + greatest(CAST(m.duration AS BIGINT) - 1, 0), m.last_idx)),
sf AS (SELECT fold, min(event_date) AS ftd FROM sl WHERE role = 'test' GROUP BY 1),
sp AS (SELECT sl.* FROM sl JOIN sf USING (fold) WHERE role = 'test' OR y3_end < ftd),
sm AS (SELECT fold, coalesce(median(x1), 0) AS m1, coalesce(median(x2), 0) AS m2 FROM sp WHERE role = 'train' GROUP BY 1),
sr AS (SELECT fold, role, event_id, event_date, duration, ly, y3_end, coalesce(x1, m1) AS x1, coalesce(x2, m2) AS x2 FROM sp JOIN sm USING (fold))""", _ridge_sql("sr", y="ly", end="y3_end")) + f"""
SELECT fold, event_id, duration AS y_true, {r("greatest(least(exp(ay - w1 * a1 - w2 * a2 + w1 * x1 + w2 * x2) - 1, 90), 0)", 5, "y_pred")} FROM sr JOIN fit USING (fold) WHERE role = 'test'""")
def l09_log_duration_model(spark, sf_dir):
    """Ridge on log1p of the recovery duration, mapped back and clipped to the cap."""
    m = fd.purge(members(spark, sf_dir).where("duration IS NOT NULL"), "event_date", "y3_end")
    d = fd.median_imputed(m, XS).withColumn("ly", F.log1p("duration"))
    fits = md.ridge_walk_forward(d, XS, "ly", "y3_end")
    p = md.linear_predictions(d.where("role = 'test'"), fits, ["fold"], XS, "_l")
    return p.select("fold", "event_id", F.col("duration").alias("y_true"), rnd(sc.clip(F.expm1("_l"), 0.0, 90.0), 5).alias("y_pred"))


@query("l10_pca_ridge")
def l10_pca_ridge(spark, sf_dir):
    """Ten principal components of the embeddings, then a penalised line on the label."""
    d = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("v"), F.col("label").cast("double").alias("label"))
    scaler = StandardScaler(inputCol="v", outputCol="s", withMean=True)
    pca = PCA(k=10, inputCol="s", outputCol="features")
    model = Pipeline(stages=[scaler, pca, LinearRegression(regParam=0.1, elasticNetParam=0.0)]).fit(d)
    return model.transform(d).select("vec_id", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


@query("l12_final_refit_scoring")
def l12_final_refit_scoring(spark, sf_dir):
    """Refit on all labelled events, save, load, and score what-if scenarios with bounds."""
    o = ordered(spark, sf_dir)
    # missing features get the median of the labelled rows, in the refit and in every scored row
    fit_rows = o.where("y1_5 IS NOT NULL").withColumn("g", F.lit(1))
    for x in XS:
        mid = exact_quantiles(fit_rows, ["g"], x, {"_m": 0.5}).first()
        o = o.withColumn(x, F.coalesce(x, F.lit(float(mid["_m"]) if mid else 0.0)))
    labelled = o.where("y1_5 IS NOT NULL").withColumn("label", F.col("y1_5"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=[*XS, "severity"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features"), LinearRegression(regParam=0.1)])
    path = os.path.join(shared_dir(spark), f"model-{uuid.uuid4().hex[:12]}")
    pipe.fit(labelled).write().save(path)
    model = PipelineModel.load(path)
    scen = o.withColumn("_s", F.explode(F.array(F.struct(F.lit("actual").alias("scenario"), F.col("severity").alias("sev")), F.struct(F.lit("double").alias("scenario"), (F.col("severity") * 2).alias("sev")))))
    scen = scen.select("event_id", *XS, "_s.scenario", F.col("_s.sev").alias("severity"))
    return model.transform(scen).select("event_id", "scenario", sc.clip("prediction", -100.0, 100.0).alias("y_pred"))


@query("q06_importance_ranking")
def q06_importance_ranking(spark, sf_dir):
    """Per fold: drop redundant features on train rows, rank the rest by forest importance."""
    f = features(spark, sf_dir).select("series_id", "session_idx", "sma_5", "sma_10", "price_to_sma_5", "vol_cv_30", "rolling_std_20")
    cand = ["sma_5", "sma_10", "price_to_sma_5", "vol_cv_30", "rolling_std_20"]
    d = rows(spark, sf_dir).join(ordered(spark, sf_dir).select("event_id", "session_idx"), "event_id").join(f, ["series_id", "session_idx"], "left")
    from tremor import schema as sm

    d = d.fillna(0.0, cand).persist()
    out = []
    for k in n_folds(spark, sf_dir):
        train = d.where((F.col("fold") == k) & (F.col("role") == "train"))
        dropped = {x.dropped for x in dg.redundant_features(dg.pearson_pairs(train, cand), sm.feature_spec(spark, cand)).collect()}
        keep = [c for c in cand if c not in dropped]
        data = VectorAssembler(inputCols=keep, outputCol="features").transform(train.withColumn("label", F.col("y")))
        imp = RandomForestRegressor(numTrees=20, maxDepth=4, seed=42).fit(data).featureImportances.toArray()
        out += [(k, c, float(v)) for c, v in zip(keep, imp)]
    d.unpersist()
    w = W.partitionBy("fold").orderBy(F.col("importance").desc(), "feature")
    return spark.createDataFrame(out, "fold int, feature string, importance double").withColumn("rank", F.row_number().over(w))


@query("a13_selection_stability")
def a13_selection_stability(spark, sf_dir):
    t = q06_importance_ranking(spark, sf_dir)
    n = len(n_folds(spark, sf_dir))
    return t.groupBy("feature").agg(F.countDistinct("fold").alias("n_folds"), F.avg("rank").alias("mean_rank"), F.percentile("rank", 0.5).alias("median_rank"),
                                    (F.countDistinct("fold") / F.lit(n)).alias("frequency"))


@query("l14_panel_models")
def l14_panel_models(spark, sf_dir):
    """Panel rows with series dummies, folds that never split an event day, against the train mean."""
    f = features(spark, sf_dir).select("series_id", "session_idx", F.coalesce("price_to_sma_20", F.lit(0.0)).alias("x1"), F.coalesce("vol_ratio_5_30", F.lit(0.0)).alias("x2"))
    p = panel(spark, sf_dir).where("y1_5 IS NOT NULL").join(f, ["series_id", "session_idx"])
    p, geo = fd.month_positions(p, "event_date")
    m = fd.purge(fd.fold_membership(p, geo), "event_date", "y1_5_end").withColumn("label", F.col("y1_5"))
    idx = StringIndexer(inputCol="series_id", outputCol="_i", stringOrderType="alphabetAsc").fit(p)
    m = OneHotEncoder(inputCols=["_i"], outputCols=["dummies"]).fit(idx.transform(p)).transform(idx.transform(m))
    m = VectorAssembler(inputCols=[*XS, "dummies"], outputCol="features").transform(m).select("fold", "role", "series_id", "event_date", "label", "features").persist()
    out = None
    for k in range(geo.n_folds):
        fit = LinearRegression(regParam=0.1).fit(m.where((F.col("fold") == k) & (F.col("role") == "train")))
        t = fit.transform(m.where((F.col("fold") == k) & (F.col("role") == "test"))).select("fold", "series_id", "event_date", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
        out = t if out is None else out.unionByName(t)
    mean = m.where("role = 'train'").groupBy("fold").agg(F.avg("label").alias("y_base"))
    pairs = out.join(F.broadcast(mean), "fold").withColumn("g", F.lit("panel")).withColumn("cluster", F.col("event_date").cast("string"))  # one row per fold
    b = rs.paired_bootstrap(rs.error_terms(pairs, ["g"], "cluster"), ["g"], "cluster", N_DRAWS)
    return b.drop("g")



@query("b03_event_block_bootstrap", ctes(SQL_OOF, """
pr AS (SELECT m.target, strftime(m.event_date, '%Y-%m-%d') AS cluster, m.y_true, m.y_pred, b.y_pred AS y_base FROM oof m JOIN oof b USING (target, fold, event_id) WHERE m.model = 'ols' AND b.model = 'zero' AND m.target = 'ret5')""",
       _draw_sql("pr", ["target"], "cluster", N_DRAWS), _boot_sql(["target"])) + f"""
SELECT target, n, {r("delta", name="delta")}, {r("lo", 5, "ci_low")}, {r("hi", 5, "ci_high")}, {r("p", name="p_worse")} FROM pt JOIN ci USING (target)""")
def b03_event_block_bootstrap(spark, sf_dir):
    """Errors resampled by event day, so a day's series stay together."""
    o = oof(spark, sf_dir).where("target = 'ret5'").withColumn("cluster", F.col("event_date").cast("string"))
    p = mt.paired(o.where(F.col("model").isin("ols", "zero")), ["target", "fold", "event_id"], "zero")
    t = rs.paired_bootstrap(rs.error_terms(p, ["target"], "cluster"), ["target"], "cluster", N_DRAWS)
    return t.select("target", "n", rnd("delta").alias("delta"), rnd("ci_low", 5).alias("ci_low"), rnd("ci_high", 5).alias("ci_high"), rnd("p_worse").alias("p_worse"))


@query("b15_window_sensitivity", ctes(SQL_MEM, _sql_long(oc.VOLUME_WINDOWS, "window_", [(f"y2_{w}", f"vd{w}") for w in oc.VOLUME_WINDOWS]), _ridge_sql("lr", ("window_", "fold")), """
bs AS (SELECT window_, fold, avg(y) AS y_base FROM lr WHERE role = 'train' GROUP BY 1, 2),
pr AS (SELECT window_, series_id AS cluster, y AS y_true, ay - w1 * a1 - w2 * a2 + w1 * x1 + w2 * x2 AS y_pred, y_base FROM lr JOIN fit USING (window_, fold) JOIN bs USING (window_, fold) WHERE role = 'test')""",
       _draw_sql("pr", ["window_"], "cluster", NB_ERROR), _boot_sql(["window_"]).replace("ON t.cluster = d.cluster", "ON t.window_ = d.window_ AND t.cluster = d.cluster")) + f"""
SELECT CAST(window_ AS INTEGER) AS window_, n, {r("delta", 5, "delta")}, {r("lo", 4, "ci_low")}, {r("hi", 4, "ci_high")} FROM pt JOIN ci USING (window_)""")
def b15_window_sensitivity(spark, sf_dir):
    """Volume forecasts per response window against the train mean, clustered by series, in one pass."""
    m, by = members(spark, sf_dir), ("window_", "fold")
    cells = F.array(*[F.struct(F.lit(w).alias("window_"), F.col(f"y2_{w}").alias("y"), F.col(f"y2_{w}_end").alias("label_end")) for w in oc.VOLUME_WINDOWS])
    long = m.select("fold", "role", "event_id", "event_date", "series_id", *XS, F.explode(cells).alias("_c")).select("*", "_c.*").drop("_c").where("y IS NOT NULL")
    d = stage(fd.median_imputed(fd.purge(long, "event_date", "label_end", by), XS, by), "window_rows")
    fits = md.ridge_walk_forward(d, XS, "y", "label_end", by=by)
    base = d.where("role = 'train'").groupBy(*by).agg(F.avg("y").alias("y_base"))
    p = md.linear_predictions(d.where("role = 'test'"), fits, [*by], XS).join(F.broadcast(base), [*by])  # one row per window and fold
    p = p.select("window_", F.col("series_id").alias("cluster"), F.col("y").alias("y_true"), "y_pred", "y_base")
    t = rs.paired_bootstrap(rs.error_terms(p, ["window_"], "cluster"), ["window_"], "cluster", NB_ERROR)
    return t.select("window_", "n", rnd("delta", 5).alias("delta"), rnd("ci_low", 4).alias("ci_low"), rnd("ci_high", 4).alias("ci_high"))


CHECKS = ["all", "exact_status", "building_only", "outside_crisis", "no_such_type"]


@query("b16_robustness_suite", ctes(SQL_OOF, SQL_OEPI, """
x AS (SELECT m.*, b.y_pred AS y_base FROM oo m JOIN oo b USING (target, fold, event_id) WHERE m.model = 'ols' AND b.model = 'train_mean' AND target = 'ret5'),
ck AS (SELECT 'all' AS name, * FROM x UNION ALL SELECT 'exact_status', * FROM x WHERE status = 'F' UNION ALL SELECT 'building_only', * FROM x WHERE type = 'BUILDING'
 UNION ALL SELECT 'outside_crisis', * FROM x WHERE NOT event_date BETWEEN DATE '1997-07-01' AND DATE '1998-12-31'),
g AS (SELECT name, count(*) AS n, sqrt(avg((y_base - y_true) ** 2)) - sqrt(avg((y_pred - y_true) ** 2)) AS d FROM ck GROUP BY 1)""") + f"""
SELECT c.name, coalesce(n, 0) AS n, {r("d", name="delta")}, CASE WHEN n IS NULL THEN 'no rows' ELSE 'run' END AS status FROM (SELECT unnest(['all', 'exact_status', 'building_only', 'outside_crisis', 'no_such_type']) AS name) c LEFT JOIN g USING (name)""")
def b16_robustness_suite(spark, sf_dir):
    """Each check varies one thing; checks without rows stay with the reason."""
    p = mt.paired(clustered(spark, sf_dir).where("target = 'ret5'").where(F.col("model").isin("ols", "train_mean")), ["target", "fold", "event_id"], "train_mean")
    crisis = F.col("event_date").between(F.lit("1997-07-01").cast("date"), F.lit("1998-12-31").cast("date"))
    rules = {"all": F.lit(True), "exact_status": F.col("status") == "F", "building_only": F.col("type") == "BUILDING", "outside_crisis": ~crisis, "no_such_type": F.col("type") == "NONE"}
    tagged = p.withColumn("name", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))))
    g = rs.paired_bootstrap(rs.error_terms(tagged, ["name"], "cluster"), ["name"], "cluster", 200)
    base = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in CHECKS])).alias("name"))
    return base.join(g, "name", "left").select("name", F.coalesce("n", F.lit(0).cast("long")).alias("n"), rnd("delta").alias("delta"), F.when(F.col("n").isNull(), "no rows").otherwise("run").alias("status"))


@query("b13_refit_permutation")
def b13_refit_permutation(spark, sf_dir):
    """Labels shuffled over episodes, a linear score refitted per draw and fold, AUC per draw."""
    c = clustered(spark, sf_dir).select("series_id", "event_date", "cluster").distinct()
    d = rows(spark, sf_dir).join(c, ["series_id", "event_date"]).withColumn("down", (F.col("y") < 0).cast("int"))
    lab = d.groupBy("cluster").agg(F.min_by("down", "event_id").alias("label"))
    return rs.refit_permutation_auc(d.join(lab, "cluster"), "cluster", "label", "x1", N_DRAWS)


def _survival_rows(spark, sf_dir):
    def build():
        m = fd.purge(members(spark, sf_dir).where("duration IS NOT NULL"), "event_date", "y3_end")
        return fd.median_imputed(m, XS).select("fold", "role", "event_id", "event_date", *XS, "duration", "event_observed", "drawdown", "reason", "y3_end")

    return staged_once(spark, sf_dir, "survival_rows", build)


def _aft_frames(d):
    return d.withColumn("t", F.col("duration") + 0.5).withColumn("c", F.col("event_observed").cast("double"))


def _aft(train, test):
    """Weibull AFT on shifted durations: median and survival at the score times."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=XS, outputCol="features"), AFTSurvivalRegression(labelCol="t", censorCol="c")])
    model = pipe.fit(_aft_frames(train))
    scale = model.stages[-1].scale
    p = model.transform(_aft_frames(test))
    # prediction is exp(linear); S(t) = exp(-(t / exp(linear))^(1 / scale))
    surv = lambda t: F.exp(-F.pow((F.lit(float(t)) + 0.5) / F.col("prediction"), 1.0 / scale))
    median = F.greatest(F.least(F.col("prediction") * F.pow(F.log(F.lit(2.0)), scale) - 0.5, F.lit(90.0)), F.lit(0.0))
    return p.select("fold", "event_id", "duration", "event_observed", "drawdown", *XS, F.col("prediction").alias("location"), F.lit(float(scale)).alias("scale"), median.alias("pred_median"), *[(1 - surv(t)).alias(f"p_{t}") for t in sv.PROB_TIMES])


@query("d11_weibull_aft")
def d11_weibull_aft(spark, sf_dir):
    """Weibull AFT per fold, scored by concordance and integrated Brier."""
    d, out = _survival_rows(spark, sf_dir), None
    for k in n_folds(spark, sf_dir):
        t = _aft(d.where((F.col("fold") == k) & (F.col("role") == "train")), d.where((F.col("fold") == k) & (F.col("role") == "test")))
        out = t if out is None else out.unionByName(t)
    return _survival_scores(out.withColumn("model", F.lit("weibull_aft")))


def _survival_scores(p):
    probs = {k: f"p_{k}" for k in sv.PROB_TIMES}
    c = sv.harrell_c(p, ["model"], "duration", "event_observed", "pred_median")
    return c.join(sv.brier_mean(sv.brier_by_time(p, ["model"], "duration", "event_observed", probs, sv.FLOOR_MEAN), ["model"]), "model")


def _mixed_median(p, cap=90.0):
    """First whole day t with p * S(t) <= 1/2 for the Weibull S of ``_aft``: 0 where p is at most 1/2, the cap at most."""
    t = F.ceil(F.col("location") * F.pow(F.log(2 * F.col(p)), F.col("scale")) - 0.5)
    return F.when(F.col(p) <= 0.5, F.lit(0.0)).otherwise(sc.clip(t.cast("double"), 0.0, cap))


@query("d12_two_stage_survival")
def d12_two_stage_survival(spark, sf_dir):
    """P(drawdown) times the survival of drawdown rows; no drawdown means no time at risk."""
    d, out = _survival_rows(spark, sf_dir), None
    for k in n_folds(spark, sf_dir):
        tr, te = (d.where((F.col("fold") == k) & (F.col("role") == x)) for x in ("train", "test"))
        cond = _aft(tr.where("drawdown"), te)
        clf = Pipeline(stages=[VectorAssembler(inputCols=XS, outputCol="features"), LogisticRegression(labelCol="dd", regParam=0.01)]).fit(tr.withColumn("dd", F.col("drawdown").cast("double")))
        pd_ = clf.transform(te).select("event_id", md.class_probability().alias("p_dd"))
        j = cond.join(pd_, "event_id")
        mixed = j.select("fold", "event_id", "duration", "event_observed", _mixed_median("p_dd").alias("pred_median"), *[(1 - F.col("p_dd") * (1 - F.col(f"p_{t}"))).alias(f"p_{t}") for t in sv.PROB_TIMES])
        out = mixed if out is None else out.unionByName(mixed)
    return _survival_scores(out.withColumn("model", F.lit("two_stage")))


@query("d16_hurdle_model")
def d16_hurdle_model(spark, sf_dir):
    """P(recover) times the expected log-duration of recovered rows, the cap otherwise."""
    d, out = _survival_rows(spark, sf_dir), None
    asm = VectorAssembler(inputCols=XS, outputCol="features")
    for k in n_folds(spark, sf_dir):
        tr, te = (asm.transform(d.where((F.col("fold") == k) & (F.col("role") == x))) for x in ("train", "test"))
        s = tr.agg(F.sum("event_observed").alias("r"), F.count("*").alias("n"), F.avg("duration").alias("m")).first()
        if s.r < 2 or s.r == s.n:
            t = te.withColumn("y_pred", F.lit(float(s.m)))
        else:
            clf = LogisticRegression(labelCol="e", regParam=0.01, probabilityCol="pc", predictionCol="_c", rawPredictionCol="_r").fit(tr.withColumn("e", F.col("event_observed").cast("double")))
            reg = LinearRegression(labelCol="l", regParam=0.1, predictionCol="_l").fit(tr.where("event_observed = 1").withColumn("l", F.log1p("duration")))
            both = reg.transform(clf.transform(te))
            p, dur = md.class_probability("pc"), sc.clip(F.expm1("_l"), 0.0, 90.0)
            t = both.withColumn("y_pred", sc.clip(p * dur + (1 - p) * 90.0, 0.0, 90.0))
        t = t.select("fold", "event_id", F.col("duration").alias("y_true"), "y_pred")
        out = t if out is None else out.unionByName(t)
    return out
