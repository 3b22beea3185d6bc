"""The linear grid from moments against plain fits on the rows."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import grid as gr
from tremor.operators import models as md

D0 = date(2010, 1, 1)


def data(n=160, p=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * rng.lognormal(0, 2, p) + 100
    x[:, 3] = 2 * x[:, 0] + 1e-3 * rng.normal(size=n)  # the same as the first
    x[:, 4] = 7.0  # constant
    y = 0.5 * (x[:, 1] - 100) / x[:, 1].std() - 0.9 * (x[:, 0] - 100) / x[:, 0].std() + rng.normal(size=n)
    return x, y


def frame(spark, x, y, folds=2):
    xs = [f"f{i}" for i in range(x.shape[1])]
    rows = [(fold, "train" if i < 100 + 20 * fold else "test", 1000 * fold + i, D0 + timedelta(days=i), None, float(y[i]), *map(float, x[i])) for fold in range(folds) for i in range(120 + 20 * fold)]
    return xs, spark.createDataFrame(rows, "fold int, role string, event_id long, event_date date, label_end date, y double, " + ", ".join(f"{c} double" for c in xs)).repartition(4)


def moments_of(x, y):
    return gr.correlations(len(y), x.sum(0), y.sum(), x.T @ x, x.T @ y, y @ y)


def test_forward_selection_is_the_best_step_each_time():
    x, y = data()
    c, _, _ = moments_of(x - x.mean(0), y - y.mean())
    got = gr.picked(c, list(range(6)), 6)
    want, left = [], [0, 1, 2, 3, 5]
    while left:
        def sse(j):
            a = np.c_[np.ones(len(y)), x[:, [*want, j]]]
            return float(np.linalg.lstsq(a, y, rcond=None)[1][0])

        best = min(left, key=sse)
        want.append(best)
        left = [j for j in left if j != best and abs(np.corrcoef(x[:, j], x[:, best])[0, 1]) <= 0.9]
    assert got == want and 4 not in got and not {0, 3} <= set(got)


def test_elastic_net_meets_its_optimality_conditions():
    x, y = data(p=8, seed=3)
    c, _, _ = moments_of(x - x.mean(0), y - y.mean())
    idx = [0, 1, 2, 5, 6, 7]
    for one, two in ((0.05, 0.1), (0.3, 0.0), (0.0, 1.0)):
        w = gr.elastic_net(c, idx, one, two)
        slope = c[idx, -1] - c[np.ix_(idx, idx)] @ w - two * w
        assert np.all(np.abs(slope[w == 0]) <= one + 1e-8) and np.allclose(slope[w != 0], one * np.sign(w[w != 0]), atol=1e-8)
    assert not gr.elastic_net(c, idx, 2.0, 0.0).any()


def plain_ridge(x, y, alpha):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / s
    return y.mean() - w @ m, w


def test_cells_equal_plain_fits(spark):
    x, y = data()
    xs, df = frame(spark, x, y)
    fits = gr.grid_fits(df, {"all": xs, "few": xs[:2]}, "y", "label_end", ("fold",), (2, 3), ("ridge", "elastic_net"))
    cells = {(r.fold, r.info_set, r.k, r.model): r for r in fits.collect()}
    assert set(cells) == {(f, s, k, m) for f in (0, 1) for s, k in (("all", 2), ("all", 3), ("few", 2)) for m in ("ridge", "elastic_net")}
    for (fold, _, k, model), r in cells.items():
        n = 100 + 20 * fold
        idx = [xs.index(c) for c in r.features]
        assert len(idx) == k and r.n_train == n
        if model == "ridge":
            # the penalty of least mean error over the splits, features picked anew in each
            size = n // 4
            error = {}
            for alpha in md.ALPHAS:
                errs = []
                for s in range(3):
                    cut = n - (3 - s) * size
                    at = gr.picked(moments_of(x[:cut] - x[:cut].mean(0), y[:cut] - y[:cut].mean())[0], [xs.index(c) for c in (xs if r.info_set == "all" else xs[:2])], k)
                    b0, w = plain_ridge(x[:cut][:, at], y[:cut], alpha)
                    errs.append(np.sqrt(np.mean((b0 + x[cut : cut + size][:, at] @ w - y[cut : cut + size]) ** 2)))
                error[alpha] = round(np.mean(errs), 10)
            assert r.alpha == min(error, key=lambda a: (error[a], a))
            b0, w = plain_ridge(x[:n][:, idx], y[:n], r.alpha)
            assert r.intercept == pytest.approx(b0, rel=1e-6, abs=1e-6) and r.slopes == pytest.approx(w, rel=1e-6, abs=1e-9)
        else:
            z = (x[:n][:, idx] - x[:n][:, idx].mean(0)) / x[:n][:, idx].std(0)
            w = np.array(r.slopes) * x[:n][:, idx].std(0)
            slope = z.T @ (y[:n] - y[:n].mean() - z @ w) / n - r.alpha * (1 - r.l1_ratio) * w
            assert np.all(np.abs(slope) <= r.alpha * r.l1_ratio + 1e-6)
    test = df.where("role = 'test'")
    p = gr.grid_predictions(test, fits, xs, ("fold",))
    for r in p.collect():
        cell = cells[r.fold, r.info_set, r.k, r.model]
        assert r.y_pred == pytest.approx(cell.intercept + sum(w * r[c] for w, c in zip(cell.slopes, cell.features, strict=True)))
    both = p.select("fold", "info_set", "k", "model", "event_id").unionByName(gr.baselines(df, "y", ("fold",)).select("fold", "info_set", "k", "model", "event_id"))
    held = {}
    for r in both.collect():
        held.setdefault((r.info_set, r.k, r.model), set()).add((r.fold, r.event_id))
    assert len(held) == 9 and len({frozenset(v) for v in held.values()}) == 1


def test_leaks_short_folds_and_stability(spark):
    x, y = data()
    xs, df = frame(spark, x, y)
    with pytest.raises(ValueError):
        gr.grid_fits(df.withColumn("y1_5", F.col("y")), {"all": [*xs, "y1_5"]}, "y", "label_end", ("fold",))
    few = df.where("event_id % 1000 < 6 or role = 'test'")
    r = gr.grid_fits(few, {"all": xs}, "y", "label_end", ("fold",), (1,), ("ridge",)).first()
    assert r.alpha == md.DEFAULT_ALPHA and r.n_train == 6
    fits = spark.createDataFrame([(0, 0, "s", 2, "ridge", ["a", "b"]), (0, 1, "s", 2, "ridge", ["b", "c"]), (0, 0, "s", 2, "elastic_net", ["a", "b"])], "horizon int, fold int, info_set string, k int, model string, features array<string>")
    got = {r.feature: (r.selection_count, r.mean_rank, r.selection_frequency) for r in gr.stability(fits).collect()}
    assert got == {"a": (1, 1.0, 0.5), "b": (2, 1.5, 1.0), "c": (1, 2.0, 0.5)}
    assert gr.grid_fits(df.where("fold < 0"), {"all": xs}, "y", "label_end", ("fold",)).count() == 0
