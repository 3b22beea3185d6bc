"""Keyed Newton steps against a plain solver for each fit."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import logistic as lg

D0 = date(2015, 1, 1)
XS = ["a", "b", "c"]


def plain(x, y, c):
    """Balanced, standardised, penalised logistic regression by Newton steps on the rows."""
    m, s = x.mean(0), x.std(0)
    s[s == 0] = 1
    z = np.c_[np.ones(len(y)), (x - m) / s]
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, pull = np.zeros(z.shape[1]), np.r_[0.0, np.full(x.shape[1], 1 / c)]
    for _ in range(200):
        mu = 1 / (1 + np.exp(-z @ w))
        w = w + 0.5 * np.linalg.solve((z * (weight * mu * (1 - mu))[:, None]).T @ z + np.diag(pull) + 1e-12 * np.eye(len(w)), z.T @ (weight * (y - mu)) - pull * w)
    slopes = w[1:] / s
    return w[0] - slopes @ m, slopes


def auc(y, p):
    a, b = p[y == 1], p[y == 0]
    return np.mean((a[:, None] > b) + 0.5 * (a[:, None] == b)) if len(a) and len(b) else None


def table(spark, rows):
    return spark.createDataFrame(rows, "horizon int, fold int, role string, event_id long, event_date date, label_end date, down int, a double, b double, c double").repartition(3)


def test_walk_forward_equals_plain_fits(spark):
    rng = np.random.default_rng(0)
    rows, at = [], {}
    for h in (1, 5):
        for fold in (0, 1):
            n = 90 + 30 * fold
            x = rng.normal(size=(n + 20, 3)) * [1, 50, 0] + [0, 1000, 3]  # the last column is constant
            y = (rng.random(n + 20) < 1 / (1 + np.exp(-(x[:, 0] * h / 2 - (x[:, 1] - 1000) / 60)))).astype(int)
            at[h, fold] = x, y, n
            rows += [(h, fold, "train" if i < n else "test", i, D0 + timedelta(days=i), None, int(y[i]), *map(float, x[i])) for i in range(n + 20)]
    df = table(spark, rows)
    fits = lg.logistic_walk_forward(df, XS, "down", "label_end", ("horizon", "fold"))
    got = {(r.horizon, r.fold): r for r in fits.collect()}
    assert set(got) == set(at)
    for key, r in got.items():
        x, y, n = at[key]
        size, mean = n // 4, {}
        for c in lg.PENALTIES:
            each = []
            for s in range(3):
                cut = n - (3 - s) * size
                b0, w = plain(x[:cut], y[:cut], c)
                each.append(auc(y[cut : cut + size], x[cut : cut + size] @ w + b0))
            mean[c] = round(np.mean([e for e in each if e is not None]), 12)
        assert r.penalty == min(mean, key=lambda c: (-mean[c], c)) and r.n_train == n
        b0, w = plain(x[:n], y[:n], r.penalty)
        assert r.intercept == pytest.approx(b0, abs=1e-6) and r.slopes == pytest.approx(w, abs=1e-6)
    for r in lg.probabilities(df.where("role = 'test'"), fits, XS, ("horizon", "fold")).collect():
        f = got[r.horizon, r.fold]
        assert r.prob == pytest.approx(1 / (1 + math.exp(-(f.intercept + f.slopes[0] * r.a + f.slopes[1] * r.b + f.slopes[2] * r.c))))


def test_one_class_and_no_rows(spark):
    rows = [(1, 0, "train" if i < 40 else "test", i, D0 + timedelta(days=i), None, 1, float(i), 1.0, 2.0) for i in range(50)]
    rows += [(1, 1, "train" if i < 40 else "test", i, D0 + timedelta(days=i), None, int(i == 0), float(i), 1.0, 2.0) for i in range(50)]
    df = table(spark, rows)
    fits = lg.logistic_walk_forward(df, XS, "down", "label_end", ("horizon", "fold"))
    got = {r.fold: r for r in fits.collect()}
    assert got[0].intercept == math.inf and got[0].slopes == [0.0] * 3
    # the splits hold no two classes to validate on
    assert got[1].penalty == lg.DEFAULT_C and np.isfinite(got[1].intercept)
    assert {r.prob for r in lg.probabilities(df.where("role = 'test' and fold = 0"), fits, XS, ("horizon", "fold")).collect()} == {1.0}
    assert lg.logistic_walk_forward(df.where(F.lit(False)), XS, "down", "label_end", ("horizon", "fold")).count() == 0


def test_packed_rows_give_the_sums_of_plain_rows():
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"fold": rng.integers(0, 2, 50), "_z0": rng.normal(size=50), "_z1": rng.normal(size=50), "_y": rng.integers(0, 2, 50) * 1.0, "_s": rng.random(50)})
    w = [0.1, -0.5, 0.7]
    packed = pd.concat(lg._packed(["fold"], 2)([rows[:20], rows[20:]]))
    packed = packed.rename(columns={"_zs": "chunk_z", "_ys": "chunk_y", "_ss": "chunk_s"}).assign(penalty=1.0, w=[w] * len(packed))
    sums, _ = lg._chunk_sums(2, ["fold"])
    got = pd.concat(sums([packed])).groupby("fold").sum(numeric_only=True)
    for fold, g in rows.groupby("fold"):
        z = np.c_[np.ones(len(g)), g["_z0"], g["_z1"]]
        mu = 1 / (1 + np.exp(-z @ w))
        assert got.loc[fold, ["g0", "g1", "g2"]].to_numpy() == pytest.approx(z.T @ (g["_s"] * (g["_y"] - mu)))
        assert got.loc[fold, "h1_2"] == pytest.approx((g["_s"] * mu * (1 - mu) * z[:, 1] * z[:, 2]).sum())
