"""Resampling, multiplicity, folds and survival against brute force."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import folds as fd
from tremor.operators import metrics as mt
from tremor.operators import models as md
from tremor.operators import resample as rs
from tremor.operators import survival as sv


def test_reference_geometry(spark):
    df = spark.range(74).select(F.col("id").alias("ord"), F.col("id").alias("pos"))
    geo = fd.Geometry(74)
    m = fd.fold_membership(df, geo)
    test = [r.ord for r in m.where("role = 'test'").collect()]
    assert geo.n_folds == 4 and len(test) == 40 and len(set(test)) == 40
    sizes = [r["count"] for r in m.where("role = 'train'").groupBy("fold").count().orderBy("fold").collect()]
    grow = [r["count"] for r in fd.fold_membership(df, geo, mode="expanding").where("role = 'train'").groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [30] * 4 and grow == [30, 40, 50, 60]
    late = m.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("ord"))).alias("t"), F.min(F.when(F.col("role") == "test", F.col("ord"))).alias("v")).where("t >= v")
    assert late.count() == 0


def test_more_rows_leave_earlier_folds_alone(spark):
    df = spark.range(200).select(F.col("id").alias("ord"), F.col("id").alias("pos"))
    keep = lambda n: {tuple(r) for r in fd.fold_membership(df.where(F.col("ord") < n), fd.Geometry(n)).select("fold", "role", "ord").collect()}
    a, b = keep(74), keep(200)
    assert a == {r for r in b if r[0] < fd.Geometry(74).n_folds}
    days = spark.createDataFrame([(i, date(2000, 1, 15) + timedelta(days=9 * i)) for i in range(300)], "id long, day date")

    def by_month(n):
        return {tuple(r) for r in fd.fold_membership(*fd.month_positions(days.where(F.col("id") < n), "day")).select("fold", "role", "id").collect()}

    a, b = by_month(250), by_month(300)
    last = max(r[0] for r in a)
    assert {r for r in a if r[0] < last} == {r for r in b if r[0] < last}


def test_purge_and_median_fill(spark):
    d0 = date(2020, 1, 1)
    rows = [(0, "train" if i < 6 else "test", i, d0 + timedelta(days=i), d0 + timedelta(days=i + 3)) for i in range(10)]
    m = spark.createDataFrame(rows, "fold long, role string, id long, day date, label_end date")
    assert sorted(r.id for r in fd.purge(m, "day", "label_end").where("role = 'train'").collect()) == [0, 1, 2]
    x = spark.createDataFrame([(0, "train", 1.0, None), (0, "train", 3.0, None), (0, "train", None, None), (0, "train", 5.0, None), (0, "test", None, None)], "fold long, role string, a double, b double")
    filled = fd.median_imputed(x, ["a", "b"])
    assert [(r.a, r.b) for r in filled.where("role = 'test'").collect()] == [(3.0, 0.0)]


def test_holm_matches_the_step_down_rule(spark):
    p = [0.01, 0.04, 0.03, 0.03, None]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "f string, id long, p double")
    got = {r.id: r.p_holm for r in rs.holm(df, ["f"], "p", ["id"]).collect()}
    order = sorted(range(5), key=lambda i: (1.0 if p[i] is None else p[i], i))
    top, want = 0.0, {}
    for k, i in enumerate(order):
        top = max(top, (5 - k) * (1.0 if p[i] is None else p[i]))
        want[i] = min(1.0, top)
    assert got == pytest.approx(want)


def test_bootstrap_sees_a_win_and_a_tie(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=200)
    rows = [("win", f"c{i // 4}", float(v), float(v + 0.2 * rng.normal()), float(v + rng.normal())) for i, v in enumerate(y)]
    rows += [("tie", f"c{i // 4}", float(v), float(v + 0.5 * rng.normal()), float(v + 0.5 * rng.normal())) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "g string, c string, y_true double, y_pred double, y_base double")
    got = {r.g: r for r in rs.paired_bootstrap(rs.error_terms(df, ["g"], "c"), ["g"], "c", 300).collect()}
    assert got["win"].significant and got["win"].ci_low > 0.5
    assert not got["tie"].significant
    few = rs.paired_bootstrap(rs.error_terms(df.limit(5), ["g"], "c"), ["g"], "c", 50).first()
    assert few.ci_low is None and few.delta is not None


def scored(n=120, seed=5):
    rng = random.Random(seed)
    return [("g", f"s{rng.randrange(4)}", int(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(n)]


def test_auc_and_weighted_auc(spark):
    rows = scored()
    df = spark.createDataFrame(rows, "g string, c string, y int, prob double")
    pairs = [(a, b) for a in rows if a[2] == 1 for b in rows if b[2] == 0]
    win = lambda a, b: 1.0 if a[3] > b[3] else 0.5 if a[3] == b[3] else 0.0
    assert mt.roc_auc(df, ["g"]).first().auc == pytest.approx(sum(win(a, b) for a, b in pairs) / len(pairs))
    weights = {"s0": 2, "s1": 0, "s2": 1, "s3": 3}
    w = spark.createDataFrame(list(weights.items()), "c string, w int")
    top = sum(weights[a[1]] * weights[b[1]] * win(a, b) for a, b in pairs)
    total = sum(weights[a[1]] * weights[b[1]] for a, b in pairs)
    assert rs.weighted_auc(df.join(w, "c"), ["g"], "y", "prob", "w").first().auc == pytest.approx(top / total)
    boot = rs.auc_bootstrap(df, ["g"], "c", "y", "prob", 200).first()
    assert boot.ci_low <= boot.value <= boot.ci_high and boot.n_draws > 150
    assert mt.roc_auc(df.where("y = 1"), ["g"]).first().auc is None


def lifetimes(n=90, seed=7):
    rng = random.Random(seed)
    return [("g", float(rng.randrange(0, 25)), int(rng.random() < 0.6), round(rng.random(), 1)) for _ in range(n)]


def km_brute(rows, flip=False):
    s, out = 1.0, {}
    for t in sorted({r[1] for r in rows}):
        n = sum(r[1] >= t for r in rows)
        d = sum(r[1] == t and (r[2] == 0 if flip else r[2] == 1) for r in rows)
        s *= 1 - d / n
        out[t] = s
    return out


def test_concordance_indices(spark):
    rows = lifetimes()
    df = spark.createDataFrame(rows, "g string, t double, e int, s double")
    win = lambda a, b: 1.0 if b[3] > a[3] else 0.5 if a[3] == b[3] else 0.0
    ok = [(a, b) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and a[2] == 1 and (b[1] > a[1] or (b[1] == a[1] and b[2] == 0))]
    assert sv.harrell_c(df, ["g"], "t", "e", "s").first().c_index == pytest.approx(sum(win(a, b) for a, b in ok) / len(ok))
    g = km_brute(rows, True)
    strict = [(a, b) for a in rows for b in rows if a[2] == 1 and b[1] > a[1]]
    w = lambda a: (1 / max(g[a[1]], 1e-9)) ** 2
    assert sv.uno_c(df, ["g"], "t", "e", "s").first().uno_c == pytest.approx(sum(w(a) * win(a, b) for a, b in strict) / sum(w(a) for a, _ in strict))
    flat = sv.harrell_c(df.withColumn("s", F.lit(1.0)), ["g"], "t", "e", "s").first()
    assert flat.c_index is None


def test_curves(spark):
    rows = lifetimes()
    df = spark.createDataFrame(rows, "g string, t double, e int, s double")
    want = km_brute(rows)
    km = {r.t: r.surv for r in sv.km_curve(df, ["g"], "t", "e").collect()}
    assert km == pytest.approx(want)
    # without a competing event the incidence is one minus the curve
    cif = {r.t: r.cif for r in sv.incidence_curve(df, ["g"], "t", F.col("e")).collect()}
    assert cif == pytest.approx({t: 1 - s for t, s in want.items()})
    seq = [cif[t] for t in sorted(cif)]
    assert all(a <= b + 1e-12 for a, b in zip(seq, seq[1:]))


def test_refit_permutation_has_all_draws_and_a_plain_auc(spark, monkeypatch):
    from tremor.operators import resample as rs
    from tremor.plans import model_queries as mq

    rng = np.random.default_rng(3)
    rows = [(f, role, f"c{k % 40}", int(k % 40 < 17), float(rng.normal() + (k % 40 < 17))) for f in range(3) for role in ("train", "test") for k in range(200)]
    df = spark.createDataFrame(rows, "fold int, role string, cluster string, label int, x double")
    r = rs.refit_permutation_auc(df, "cluster", "label", "x", 300).first()
    y, p = [], []
    for f in range(3):
        s, i = np.polyfit([q[4] for q in rows if q[:2] == (f, "train")], [q[3] for q in rows if q[:2] == (f, "train")], 1)
        y += [q[3] for q in rows if q[:2] == (f, "test")]
        p += [i + s * q[4] for q in rows if q[:2] == (f, "test")]
    y, p = np.array(y), np.array(p)
    d = p[y == 1][:, None] - p[y == 0][None, :]
    assert abs(r["observed_auc"] - ((d > 0).mean() + (d == 0).mean() / 2)) < 1e-9
    assert r["n_draws"] == 300 and abs(r["p_value"] - 1 / 301) < 1e-12 and 0.4 < r["perm_mean"] < 0.6

    asked = []
    whole = rs.paired_bootstrap
    monkeypatch.setattr(rs, "paired_bootstrap", lambda *a, **b: asked.append(a[3]) or whole(*a, **b))
    mq.l14_panel_models(spark, "/root/testdata/sf0.001")
    assert asked == [5000]
    assert mq.b13_refit_permutation(spark, "/root/testdata/sf0.001").first()["n_draws"] == 5000


def test_drawn_auc_equals_joined_draws_over_small_ranges(spark, monkeypatch):
    from tremor.functions.draws import cluster_draws

    monkeypatch.setattr(rs, "RANGE_CELLS", 40)
    monkeypatch.setattr(rs, "PACK_CELLS", 16)
    rng = random.Random(5)
    rows = [(g, f"e{i}", rng.randint(0, 1), rng.randint(0, 30) / 7) for g in "ab" for i in range(150)]
    df = spark.createDataFrame(rows, "g string, c string, y int, prob double")
    for within in ([], ["y"]):
        keys = ["g", *within]
        counts = df.groupBy(*keys, "c", "prob").agg(F.sum("y").alias("_p"), F.sum(1 - F.col("y")).alias("_q"))
        got = {(r.g, r.b): r.auc for r in rs.drawn_auc(counts, ["g"], within, "c", "prob", 70).collect()}
        w = cluster_draws(df.select(*keys, "c").distinct(), keys, "c", 70)
        want = {(r.g, r.b): r.auc for r in rs.weighted_auc(df.join(w, [*keys, "c"]), ["g", "b"], "y", "prob", "w").collect()}
        assert len(want) == 140 and got == pytest.approx(want)


def test_scores_apart_in_their_last_bits_tie(spark):
    rows = [("a", 1.0, 1, 0.1 + 0.2), ("b", 2.0, 1, 0.3), ("a", 3.0, 0, 7.0)]
    df = spark.createDataFrame(rows, "g string, t double, e int, s double").withColumn("m", F.lit("m"))
    assert sv.harrell_c(df, ["m"], "t", "e", "s").first().c_index == pytest.approx(2.5 / 3)
    pairs = sv.cluster_concordance(df, ["m"], "g", ["a", "b"], "t", "e", "s").agg(F.sum("wins").alias("w"), F.sum("pairs").alias("p")).first()
    assert (pairs.w, pairs.p) == (2.5, 3)


@pytest.mark.parametrize("n", [3, 7, 200])
def test_split_bits_are_the_roles_of_inner_membership(spark, n):
    rng = np.random.default_rng(n)
    day = rng.integers(0, max(2, n // 9), n)
    rows = [(f, int(i), int(d), None if i % 7 == 0 else int(d + rng.integers(0, 9))) for f in (0, 1) for i, d in zip(rng.permutation(n), day)]
    train = spark.createDataFrame(rows, "fold int, event_id long, event_date int, label_end int")
    marked, parts = fd.split_bits(train, ["fold"], "event_date", "event_id", "label_end", (3, 2))
    got = {tuple(r) for r in marked.select("fold", "event_id", F.explode(fd.split_roles(parts)).alias("x")).select("fold", "event_id", "x.*").collect()}
    placed = md.inner_positions(train, ["fold"], "event_date", "event_id")
    want = set()
    for k in (3, 2):
        want |= {(r.fold, r.event_id, k, r.split, r.inner_role) for r in fd.inner_membership(placed, ["fold"], "_pos", "_n", "event_date", "label_end", k).collect()}
    assert got == want and marked.count() == 2 * n
    # rows themselves are not shuffled: only days and the rows of a few days are
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan
