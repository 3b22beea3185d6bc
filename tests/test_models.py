import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremor import schema as sm
from tremor.operators import augment as ag
from tremor.operators import diagnose as dg
from tremor.operators import models as md
from tremor.operators import placebo as pb
from tremor.operators import series as sr
from tremor.operators import study as st
from tremor.sources import readers as rd

D0 = date(2015, 1, 1)


def walk(n, seed=0, shock_at=None):
    rng = np.random.default_rng(seed)
    f = rng.normal(0, 0.01, n)
    r = 1.2 * f + rng.normal(0, 0.003, n)
    for k in shock_at or []:
        r[k: k + 5] -= 0.006
    return f, r


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    X, y = rng.normal(size=(60, 3)) * [1, 5, 0.1] + [0, 3, 2], rng.normal(size=60)
    df = spark.createDataFrame([(*map(float, x), float(v)) for x, v in zip(X, y)], "a double, b double, c double, y double").withColumn("g", F.lit(1))
    row = md.moments(df, ["g"], ["a", "b", "c"], "y").toPandas().iloc[0]
    b0, w = md.ridge_from_moments(row, 3, 2.5)
    Z = (X - X.mean(0)) / X.std(0)
    ref = np.linalg.solve(Z.T @ Z + 2.5 * np.eye(3), Z.T @ (y - y.mean())) / X.std(0)
    assert w == pytest.approx(ref) and b0 == pytest.approx(y.mean() - ref @ X.mean(0))
    assert md.sse_from_moments(row, 3, b0, w) == pytest.approx(((y - b0 - X @ w) ** 2).sum())


def test_walk_forward_ridge_keeps_its_digits_and_asks_for_two_splits(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=80) + 1e6
    y = 3 * (x - 1e6) + rng.normal(size=80) * 0.1 - 2e5
    schema = "fold long, role string, event_id long, event_date date, label_end date, a double, y double"
    rows = [(0, "train", i, D0 + timedelta(days=i), D0 + timedelta(days=i), float(x[i]), float(y[i])) for i in range(80)]
    # labels of fold 1 last so long that the purge leaves no split enough train rows
    rows += [(1, "train", i, D0 + timedelta(days=i), D0 + timedelta(days=i + 1000), float(x[i]), float(y[i])) for i in range(80)]
    fits = {r.fold: r for r in md.ridge_walk_forward(spark.createDataFrame(rows, schema), ["a"], "y", "label_end").collect()}
    assert fits[1].alpha == md.DEFAULT_ALPHA
    for r in fits.values():
        z = (x - x.mean()) / x.std()
        w = z @ (y - y.mean()) / (80 + r.alpha) / x.std()
        assert r.slopes[0] == pytest.approx(w, rel=1e-8)
        assert r.intercept + r.slopes[0] * x.mean() == pytest.approx(y.mean(), rel=1e-8)


def test_constant_column_gets_no_weight():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=50), rng.normal(size=50)
    X = np.stack([x, np.full(50, 3.7)], 1)
    row = {"n": 50.0, "sy": y.sum(), "syy": (y * y).sum(), **{f"sx_{i}": X[:, i].sum() for i in range(2)}, **{f"sxy_{i}": (X[:, i] * y).sum() for i in range(2)},
           **{f"sxx_{i}_{j}": (X[:, i] * X[:, j]).sum() for i in range(2) for j in range(i, 2)}}
    _, w = md.ridge_from_moments(row, 2, 1.0)
    assert w[1] == 0.0


def test_nonnegative_fit():
    X = np.random.default_rng(3).normal(size=(200, 3))
    y = X @ [0.7, -0.4, 0.2]
    w = md.nonnegative_fit(X.T @ X / 200, X.T @ y / 200)
    assert (w >= 0).all() and w[1] == 0 and w[0] > 0.5


def test_market_model_matches_polyfit(spark):
    f, r = walk(400, 4)
    vals = [("A", D0 + timedelta(days=i), i + 1, float(r[i]), None if i == 120 else float(f[i])) for i in range(400)]
    df = spark.createDataFrame(vals, "series_id string, date date, session_idx long, log_return double, factor_ret double")
    got = sr.market_model(df, "log_return", "factor_ret").where("session_idx = 301").first()
    use = [i for i in range(50, 300) if i != 120]
    beta, alpha = np.polyfit(f[use], r[use], 1)
    res = r[use] - alpha - beta * f[use]
    assert (got.fit_n, got.fit_alpha, got.fit_beta, got.fit_sigma) == pytest.approx((249, alpha, beta, np.sqrt((res**2).sum() / 247)))


def test_study_finds_a_planted_shock_and_stays_quiet_on_noise(spark):
    at = list(range(280, 860, 30))
    for shock, fires in ((at, True), (None, False)):
        f, r = walk(900, 6, shock)
        vals = [("A", D0 + timedelta(days=i), i + 1, float(r[i]), float(f[i])) for i in range(900)]
        df = spark.createDataFrame(vals, "series_id string, date date, session_idx long, log_return double, factor_ret double")
        o = spark.createDataFrame([("A", k + 1, 1) for k in at], "series_id string, origin long, weight long")
        t = st.with_p_values(st.event_study_table(sr.market_model(df, "log_return", "factor_ret"), o, [], start=1)).where("k = 5").first()
        assert (t.p_bmp < 0.01 and t.caar < -0.02) if fires else t.p_bmp > 0.01


def test_weights_equal_repeated_events(spark):
    f, r = walk(500, 8)
    vals = [("A", D0 + timedelta(days=i), i + 1, float(r[i]), float(f[i])) for i in range(500)]
    fit = sr.market_model(spark.createDataFrame(vals, "series_id string, date date, session_idx long, log_return double, factor_ret double"), "log_return", "factor_ret")
    o = spark.createDataFrame([("A", 300, 3), ("A", 350, 1), ("A", 420, 2)], "series_id string, origin long, weight long")
    got = st.cross_section(st.cumulated(st.abnormal_panel(fit, o), -5).withColumn("scar", F.col("car")), []).where("k = 10").first()
    cars = {r_.origin: r_.car for r_ in st.cumulated(st.abnormal_panel(fit, o), -5).where("k = 10").collect()}
    full = [cars[300]] * 3 + [cars[350]] + [cars[420]] * 2
    assert got.caar == pytest.approx(np.mean(full)) and got.t_cross == pytest.approx(np.mean(full) / (np.std(full, ddof=1) / np.sqrt(6)))


def test_ema_matches_pandas(spark):
    rng = np.random.default_rng(9)
    p = 100 + rng.normal(size=600).cumsum()
    df = spark.createDataFrame([("A", D0 + timedelta(days=i), float(p[i]), float(i % 5 + 1), i + 1) for i in range(600)], "series_id string, date date, close double, volume double, session_idx long")
    got = sr.market_features(df).orderBy("date").toPandas()
    want = pd.Series(p).shift(1).ewm(span=20, adjust=False, min_periods=20).mean()
    assert np.allclose(got["ema_20"].astype(float), want, equal_nan=True, atol=1e-9)
    bumped = sr.market_features(df.withColumn("volume", F.when(F.col("session_idx") == 600, 1e9).otherwise(F.col("volume")))).orderBy("date").toPandas()
    cols = [c for c in got.columns if c.startswith("vol_")]
    assert np.allclose(got[cols].astype(float), bumped[cols].astype(float), equal_nan=True)


def test_volatility_recursion(spark):
    rng = np.random.default_rng(10)
    r = rng.normal(0, 0.01, 500)
    df = spark.createDataFrame([("A", D0 + timedelta(days=i), float(r[i])) for i in range(500)], "series_id string, date date, log_return double")
    got = md.yearly_volatility(df).orderBy("date").collect()
    past = r[:365]
    v, best = (past**2).mean(), None
    for a in md.GARCH_A:
        for b in md.GARCH_B:
            if a + b < 1:
                h, ll = v, 0.0
                for x in past:
                    ll += -np.log(h) - x * x / h
                    h = v * (1 - a - b) + a * x * x + b * h
                best = max(best, (ll, a, b, h)) if best else (ll, a, b, h)
    _, a, b, h = best
    assert len(got) == 135 and (got[0].a, got[0].b) == (a, b)
    want = []
    for x in r[365:]:
        want.append(np.sqrt(h))
        h = v * (1 - a - b) + a * x * x + b * h
    assert [g.cond_vol for g in got] == pytest.approx(want)


def test_nearest_neighbour_is_exact(spark):
    rng = random.Random(11)
    rows = [(0, rng.choice("ab"), i, D0 + timedelta(days=rng.randrange(4000)), round(rng.gauss(0, 1), 1), 0.0 if rng.random() < 0.3 else rng.gauss(0, 1)) for i in range(250)]
    df = spark.createDataFrame(rows, "fold int, type string, event_id long, event_date date, z1 double, z2 double")
    for windowed in (True, False):
        got = {r.event_id: r.neighbour for r in ag.nearest_in_group(df, ["fold", "type"], windowed).collect()}
        for a in rows:
            cand = [b for b in rows if b[2] != a[2] and b[1] == a[1] and (not windowed or abs((a[3] - b[3]).days) <= ag.WINDOW_DAYS)]
            want = min(cand, key=lambda b: ((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2, b[2]), default=None)
            assert got.get(a[2]) == (want[2] if want else None)


def test_share_cap_raises(spark):
    rows = [(0, "a", i, D0, float(i), float(i), 1.0, float(i), float(i)) for i in range(6)]
    m = spark.createDataFrame(rows, "fold int, type string, event_id long, event_date date, x1 double, x2 double, y double, z1 double, z2 double")
    with pytest.raises(ValueError):
        ag.interpolated(m, m, ["fold", "type"], ["x1", "x2"], "y")
    syn = ag.interpolated(m, m, ["fold", "type"], ["x1", "x2"], "y", max_share=1.0).collect()
    assert len(syn) == 6 and all(min(s.event_id, s.neighbour) <= s.x1 <= max(s.event_id, s.neighbour) for s in syn)


def test_nearest_value_match(spark):
    rng = random.Random(12)
    left = [("g", i, round(rng.random(), 2)) for i in range(60)]
    right = [("g", i, round(rng.random(), 2)) for i in range(40)]
    L = spark.createDataFrame(left, "g string, origin long, v double")
    R = spark.createDataFrame(right, "g string, k long, v double")
    got = {r.origin: r.m for r in pb.nearest_by_value(L, R, ["g"], "v", "k", "m").collect()}
    for _, i, v in left:
        best = min(abs(v - x[2]) for x in right)
        assert abs(v - right[got[i]][2]) == pytest.approx(best)


def test_guards(spark, tmp_path):
    with pytest.raises(ValueError):
        sm.assert_no_leak(["x1", "y1_5"])
    with pytest.raises(ValueError):
        sm.information_sets(sm.feature_spec(spark, ["log_return", "mystery"]))
    with pytest.raises(rd.MissingArtifact):
        rd.load_frame(spark, str(tmp_path), "absent")


def test_html_price_rows(spark):
    html = "<table><tr><td>01/02/2020</td><td>1,234.5</td></tr><tr><td>note</td><td>x</td></tr><tr class=a><td><b>01/03/2020</b></td><td>99</td></tr></table>"
    df = spark.createDataFrame([(1, html), (2, "<tr><td>01/03/2020</td><td>5</td></tr>")], "page_id long, html string")
    got = [(str(r.date), r.close) for r in rd.html_price_table(df, "html").orderBy("date").collect()]
    assert got == [("2020-01-02", 1234.5), ("2020-01-03", 99.0)]


def test_redundant_component_keeps_the_least_derived(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(a + 1e-3 * b), float(b)) for a, b in zip(x, rng.normal(size=200))], "log_return double, squared_return double, sma_5 double")
    out = dg.redundant_features(dg.pearson_pairs(df, df.columns), sm.feature_spec(spark, df.columns)).collect()
    assert [(r.dropped, r.kept) for r in out] == [("squared_return", "log_return")]


def test_two_stage_median_is_the_first_day_at_or_below_one_half(spark):
    from tremor.plans.model_queries import _mixed_median

    rng = random.Random(6)
    rows = [(rng.random(), rng.uniform(0.5, 120.0), rng.uniform(0.2, 2.0)) for _ in range(60)]
    df = spark.createDataFrame(rows, "p double, location double, scale double")
    surv = lambda t, loc, sc_: np.exp(-((t + 0.5) / loc) ** (1 / sc_))
    for r in df.withColumn("m", _mixed_median("p")).collect():
        want = next((t for t in range(91) if r.p * surv(t, r.location, r.scale) <= 0.5), 90)
        assert r.m == min(want, 90)


def test_train_lines_of_counted_cells_equal_those_of_single_rows(spark):
    """Cells that stand for many events give the fold constants of the events; a feature without spread has no line."""
    from tremor.operators import folds as fd
    from tremor.plans.forecast_queries import train_lines

    rng, day = np.random.default_rng(4), date(2020, 1, 1)
    cells = [(day + timedelta(days=30 * m + int(rng.integers(0, 25))), m, 0.1 if m < 4 else (None if k == 1 else float(rng.normal())), None if k == 2 else float(rng.normal()), int(rng.integers(1, 9)))
             for m in range(12) for k in range(6)]
    cells = [(d, m, x, y, d + timedelta(days=7) if k % 5 else None, n) for k, (d, m, x, y, n) in enumerate(cells)]
    geo = fd.Geometry(12, 4, 2, 2)
    df = spark.createDataFrame(cells, "event_date date, pos long, x1 double, y double, y_end date, n long")
    got = {r.fold: r for r in train_lines(df, geo, "y", "y_end").collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for f, r in got.items():
        live = [c for c in cells if c[3] is not None]
        first = min(c[0] for c in live if 2 * f + 4 <= c[1] < 2 * f + 6)
        train = [c for c in live if 2 * f <= c[1] < 2 * f + 4 and (c[4] is None or c[4] < first)]
        x = np.repeat([np.nan if c[2] is None else c[2] for c in train], [c[5] for c in train])
        y = np.repeat([c[3] for c in train], [c[5] for c in train])
        assert r._med == pytest.approx(np.nanmedian(x))
        assert (r.train_mean, r.train_median) == pytest.approx((y.mean(), np.median(y)))
        if f == 0:
            assert r._a is None and r._b is None
        else:
            x = np.where(np.isnan(x), r._med, x)
            assert (r._b, r._a) == pytest.approx(tuple(np.polyfit(x, y, 1)))
