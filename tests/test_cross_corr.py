"""Residual correlation of event pairs against plain pairs, and its use in the study."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import cross_corr as cc
from tremor.operators import series as sr
from tremor.operators import study as st

DAY = date(2020, 1, 1)


def walks(shared: float, n=160, names="abc", seed=0, gaps=True):
    """Return series with a part in common; each but the first misses some dates."""
    rng = np.random.default_rng(seed)
    common, factor = rng.normal(size=n), rng.normal(size=n)
    rows = []
    for s, name in enumerate(names):
        held = [t for t in range(n) if not gaps or s == 0 or rng.random() > 0.15]
        for k, t in enumerate(held):
            v = 0.3 * factor[t] + np.sqrt(shared) * common[t] + np.sqrt(1 - shared) * rng.normal()
            rows.append((name, DAY + timedelta(days=t), k + 1, float(v) if t % 29 else None, float(factor[t])))
    return rows


def fitted_of(spark, rows, window=40, least=15):
    df = spark.createDataFrame(rows, "series_id string, date date, session_idx long, log_return double, factor_ret double").repartition(3)
    return sr.market_model(df, "log_return", "factor_ret", window, least).cache()


def plain_pairs(fitted, origins, window, least):
    """(r, weight) of every pair of events, by the dates their residuals share."""
    by = {}
    for r in fitted.collect():
        by.setdefault(r.series_id, {})[r.session_idx] = r
    held = []
    for s, o, w in origins:
        f = by.get(s, {}).get(o)
        if f is None or f.fit_alpha is None:
            continue
        rows = [by[s][i] for i in range(max(1, o - window), o)]
        held.append((s, o, w, {x.date: x.log_return - f.fit_alpha - f.fit_beta * x.factor_ret for x in rows if x.log_return is not None and x.factor_ret is not None}))
    out = []
    for i, (s, o, w, a) in enumerate(held):
        for s2, o2, w2, b in held[i:]:
            days = sorted(set(a) & set(b))
            same = (s, o) == (s2, o2)
            weight = w * (w - 1) / 2 if same else w * w2
            if len(days) >= least and weight:
                out += [(np.corrcoef([a[d] for d in days], [b[d] for d in days])[0, 1], weight)]
    return np.array(out), sum(h[2] for h in held)


@pytest.mark.parametrize("rows_at_once", [256, 3])
def test_pairs_equal_plain_pairs(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(cc, "ROWS", rows_at_once)
    fit = fitted_of(spark, walks(0.4))
    origins = [(s, o, 1 + (o + k) % 3) for k, s in enumerate("abc") for o in range(5, 120, 7)] + [("nosuch", 3, 1)]
    o = spark.createDataFrame(origins, "series_id string, origin long, weight long")
    pairs, events = plain_pairs(fit, origins, 40, 10)
    got = cc.pair_correlation_summary(fit, o, window=40).first()
    each = np.repeat(pairs[:, 0], pairs[:, 1].astype(int))
    assert (got.n_pairs, got.n_pairs_total) == (len(each), events * (events - 1) // 2)
    assert cc.pair_correlation_summary(fit, o, window=40, median=False).first().mean_corr == got.mean_corr
    assert got.mean_corr == pytest.approx(each.mean()) and got.median_corr == pytest.approx(np.median(each))


def test_each_pair_of_series_meets_once(spark):
    df = spark.createDataFrame([(f"s{i}", [], 5) for i in range(40)], "series_id string, rows array<int>, window int")
    met = [(r.series_id, r.other_id) for r in cc.series_pairs(df).collect()]
    assert len(met) == len(set(met)) == 40 * 41 // 2 and all(a <= b for a, b in met)


def test_series_that_move_together_are_corrected(spark):
    found = {}
    for shared in (0.0, 0.9):
        fit = fitted_of(spark, walks(shared, n=400, seed=4, gaps=False), 250, 60)
        days = spark.createDataFrame([(s, o, 1) for s in "abc" for o in range(200, 370, 20)], "series_id string, origin long, weight long")
        corr = cc.pair_correlation_summary(fit, days)
        within = st.mean_correlation(st.pair_correlations(fit, days, "log_return", "factor_ret"), []).first().mean_corr
        found[shared] = corr.first().mean_corr, within
        t = st.event_study_table(fit, days, [], corr=corr.select("n_pairs", "mean_corr")).where("k = 5").first()
        if shared:
            assert abs(t.t_kp) < 0.5 * abs(t.t_bmp)
    assert found[0.9][0] > found[0.0][0] + 0.3
    # the mean within series can't tell the two apart
    assert abs(found[0.9][1] - found[0.0][1]) < 0.1


def test_date_sums(spark):
    fit = fitted_of(spark, walks(0.6, n=200, gaps=False))
    origins = [(s, o, 2) for s in "abc" for o in (60, 75)]
    o = spark.createDataFrame(origins, "series_id string, origin long, weight long")
    by = {(r.series_id, r.session_idx): r for r in fit.collect()}
    z = {}
    for s, i, w in origins:
        f = by[s, i]
        held = {x.date: x.log_return - f.fit_alpha - f.fit_beta * x.factor_ret for x in (by[s, k] for k in range(i - 40, i)) if x.log_return is not None}
        v = np.array(list(held.values()))
        for _ in range(w):
            for d, e in held.items():
                z.setdefault(d, []).append((e - v.mean()) / v.std())
    products = [a * b for e in z.values() for k, a in enumerate(e) for b in e[k + 1 :]]
    got = cc.date_sum_correlation(fit, o, window=40).first()
    assert got.n_date_pairs == len(products) and got.date_sum_corr == pytest.approx(np.mean(products))


def test_no_pairs(spark):
    fit = fitted_of(spark, walks(0.1))
    none = spark.createDataFrame([], "series_id string, origin long, weight long")
    got = cc.pair_correlation_summary(fit, none).first()
    assert (got.n_pairs, got.mean_corr, got.median_corr, got.n_pairs_total) == (0, None, None, 0)
    assert cc.date_sum_correlation(fit, none).first().date_sum_corr is None


def test_zero_model(spark):
    fit = sr.zero_model(spark.createDataFrame(walks(0.2, names="a"), "series_id string, date date, session_idx long, log_return double, factor_ret double"), "log_return", 40, 15)
    rows = fit.orderBy("session_idx").collect()
    before = np.array([r.log_return for r in rows[60:100] if r.log_return is not None])
    assert (rows[100].fit_alpha, rows[100].fit_beta, rows[100].fit_n) == (0, 0, len(before))
    assert rows[100].fit_sigma == pytest.approx(np.sqrt((before**2).sum() / (len(before) - 1)))
    assert rows[10].fit_alpha is None


def test_series_pairs_are_spread_over_tasks(spark):
    """A pair of series is heavy and its rows are few bytes, so neither their size nor a broadcast may gather the pairs."""
    fit = fitted_of(spark, walks(0.4, names="abcdefghijkl"))
    origins = spark.createDataFrame([(s, 60, 1) for s in "abcdefghijkl"], "series_id string, origin long, weight long")
    pairs = cc.series_pairs(cc.stage(cc.packed_series(fit, origins, "log_return", "factor_ret", 40), "packed"))
    held = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 78 and max(held) <= 39
