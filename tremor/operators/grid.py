"""Grid of linear models over information sets, capacities and penalties from one table of moments.

Moments of all features come from one scan per (configuration, fold, inner split). A group of those
rows is all that a fit needs: features are picked by sweeps of the correlation matrix, and every
(information set, capacity, model, penalty) is solved on a sub-matrix. Test rows are scored by a join
with the fits, so every cell of a fold holds the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.operators.models import ALPHAS, DEFAULT_ALPHA, _unpack, split_moments
from tremor.schema import assert_no_leak

# Correlation from which two features count as one, and the mixing grid of the elastic net.
REDUNDANT = 0.9
L1_RATIOS = (0.1, 0.5, 0.9)
NET_ALPHAS = tuple(float(a) for a in np.logspace(-3, 1, 9))


def correlations(n: float, sx, sy: float, sxx, sxy, syy: float):
    """(correlation matrix of the columns and y, means, deviations); constant columns have deviation 0."""
    m = np.r_[sx, sy] / n
    both = np.block([[sxx, sxy[:, None]], [sxy[None, :], np.array([[syy]])]]) / n
    cov = both - np.outer(m, m)
    var = np.where(np.diag(cov) > 1e-12 * np.diag(both), np.diag(cov), 0.0)
    sd = np.sqrt(var)
    safe = np.where(sd > 0, sd, 1.0)
    c = cov / np.outer(safe, safe)
    c[sd == 0, :] = c[:, sd == 0] = 0.0
    return c, m, sd


def picked(c: np.ndarray, usable: list[int], most: int, limit: float = REDUNDANT) -> list[int]:
    """Columns in the order of forward selection by explained share of y, the last row of ``c``.

    A column that is constant, or correlates beyond ``limit`` with a picked one, is passed over; ties
    go to the first column. After each pick the matrix is swept on it.
    """
    s, left, out = c.copy(), [j for j in usable if c[j, j] > 0], []
    while left and len(out) < most:
        gain = [round(s[j, -1] ** 2 / s[j, j], 12) if s[j, j] > 1e-9 else -1.0 for j in left]
        best = int(np.argmax(gain))
        if gain[best] < 0:
            break
        j = left[best]
        out.append(j)
        s -= np.outer(s[:, j], s[j, :]) / s[j, j]
        left = [i for i in left if i != j and abs(c[i, j]) <= limit]
    return out


def ridge(c: np.ndarray, n: float, idx: list[int], alpha: float) -> np.ndarray:
    """Slopes on standardised columns and y; the penalty counts against n times the correlation matrix."""
    return np.linalg.solve(n * c[np.ix_(idx, idx)] + alpha * np.eye(len(idx)), n * c[idx, -1])


def elastic_net(c: np.ndarray, idx: list[int], one: float, two: float, rounds: int = 1000, near: float = 1e-10) -> np.ndarray:
    """Coordinate descent on the correlation matrix: minimises |y - Xw|^2 / 2n + one |w| + two |w|^2 / 2."""
    g, r, w = c[np.ix_(idx, idx)], c[idx, -1], np.zeros(len(idx))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(idx)):
            rho = r[j] - g[j] @ w + g[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - one, 0.0) / (g[j, j] + two)
        if np.abs(w - before).max() <= near:
            break
    return w


class _Moments:
    """Moments of one set of rows, as correlations and back."""

    def __init__(self, row, p: int):
        self.raw = _unpack(row, p)
        self.n = self.raw[0]
        self.c, self.m, self.sd = correlations(*self.raw)

    def raw_units(self, idx: list[int], w: np.ndarray) -> tuple[float, np.ndarray]:
        slopes = w * self.sd[-1] / self.sd[idx]
        return self.m[-1] - float(slopes @ self.m[idx]), slopes

    def rmse(self, idx: list[int], b0: float, w: np.ndarray) -> float:
        n, sx, sy, sxx, sxy, syy = self.raw
        sse = syy - 2 * b0 * sy - 2 * w @ sxy[idx] + n * b0 * b0 + 2 * b0 * w @ sx[idx] + w @ sxx[np.ix_(idx, idx)] @ w
        return float(np.sqrt(max(sse, 0.0) / n))


def _cells(models) -> dict[str, list[tuple[float, float]]]:
    every = {"ridge": [(a, 0.0) for a in ALPHAS], "elastic_net": [(a, r) for r in L1_RATIOS for a in NET_ALPHAS]}
    return {m: every[m] for m in models}


def _solve(model: str, at: _Moments, idx: list[int], alpha: float, l1: float):
    # the net is fitted on a standardised y, where the penalty on |w| is in units of y's deviation
    w = ridge(at.c, at.n, idx, alpha) if model == "ridge" else elastic_net(at.c, idx, alpha * l1 / max(at.sd[-1], 1e-300), alpha * (1 - l1))
    return at.raw_units(idx, w)


def _grid_groups(keys: list[str], xs: list[str], sets: dict[str, list[int]], capacities, cells):
    p = len(xs)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, out = pdf[pdf["split"] < 0], []
        if len(whole):
            full = _Moments(whole.iloc[0], p)
            pairs = []
            for _, made in sorted(pdf[pdf["split"] >= 0].groupby("k"), key=lambda g: -g[0]):
                pairs = []
                for _, g in made.groupby("split"):
                    tr, va = g[g["inner_role"] == "train"], g[g["inner_role"] == "validation"]
                    if len(tr) and len(va) and tr["n"].iloc[0] >= 5:
                        pairs.append((_Moments(tr.iloc[0], p), _Moments(va.iloc[0], p)))
                if len(pairs) >= 2:
                    break
            for name, usable in sets.items():
                chosen = [picked(m.c, usable, max(capacities)) for m in (full, *(tr for tr, _ in pairs))]
                for k in capacities:
                    if k > len(usable):
                        continue
                    for model, options in cells.items():
                        best = (DEFAULT_ALPHA, 0.5 if model == "elastic_net" else 0.0)
                        if len(pairs) >= 2:
                            error = {o: np.mean([va.rmse(c[:k], *_solve(model, tr, c[:k], *o)) for (tr, va), c in zip(pairs, chosen[1:], strict=True)]) for o in options}
                            best = min(options, key=lambda o: (round(error[o], 10), options.index(o)))
                        idx = chosen[0][:k]
                        b0, w = _solve(model, full, idx, *best)
                        out.append({**{c: whole.iloc[0][c] for c in keys}, "info_set": name, "k": k, "model": model, "alpha": best[0], "l1_ratio": best[1], "n_train": int(full.n),
                                    "features": [xs[i] for i in idx], "intercept": b0, "slopes": [float(v) for v in w]})
        return pd.DataFrame(out, columns=[*keys, "info_set", "k", "model", "alpha", "l1_ratio", "n_train", "features", "intercept", "slopes"])

    return fit


def grid_fits(rows: DataFrame, sets: dict[str, list[str]], y: str, label_end: str, by: tuple = ("horizon", "fold"), capacities=(5, 10, 20),
              models=("ridge", "elastic_net"), k_inner: int = 3) -> DataFrame:
    """(by, info_set, k, model, alpha, l1_ratio, n_train, features, intercept, slopes) of every cell.

    ``rows`` is a purged, imputed membership table without missing y. Features are picked from the
    train rows alone, anew in every inner split; a capacity above the size of a set gives no cell, and
    a set whose usable features run out gives fewer. The penalty is the one with the least mean error
    over the inner splits, or the default where fewer than two survive the purge.
    """
    xs = list(dict.fromkeys(c for cs in sets.values() for c in cs))
    assert_no_leak(xs)
    keys = [*by]
    both, offset = split_moments(rows, xs, y, label_end, k_inner, keys)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema if f.name in keys)
    fits = both.groupBy(*keys).applyInPandas(
        _grid_groups(keys, xs, {n: [xs.index(c) for c in cs] for n, cs in sets.items()}, sorted(capacities), _cells(models)),
        f"{types}, info_set string, k int, model string, alpha double, l1_ratio double, n_train long, features array<string>, intercept double, slopes array<double>",
    )
    known = F.create_map(*(F.lit(v) for c in xs for v in (c, offset[c])))
    moved = F.aggregate(F.zip_with("features", "slopes", lambda f, w: w * known[f]), F.lit(0.0), lambda s, v: s + v)
    return fits.withColumn("intercept", F.col("intercept") + F.lit(offset[y]) - moved)


def grid_predictions(test: DataFrame, fits: DataFrame, xs: list[str], by: tuple = ("horizon", "fold"), out: str = "y_pred") -> DataFrame:
    """Test rows times cells with their prediction; the fits are one row for each cell."""
    values = F.create_map(*(v for c in xs for v in (F.lit(c), F.col(c).cast("double"))))
    j = test.withColumn("_x", values).join(fits.drop("n_train"), [*by])
    value = F.aggregate(F.zip_with("features", "slopes", lambda f, w: w * F.col("_x")[f]), F.col("intercept"), lambda s, v: s + v)
    return j.withColumn(out, value).drop("_x", "slopes", "intercept")


def baselines(rows: DataFrame, y: str, by: tuple = ("horizon", "fold")) -> DataFrame:
    """Test rows under zero, the train mean and the train median, in the shape of grid_predictions."""
    from tremor.functions.ordered import exact_quantiles

    train = rows.where("role = 'train'")
    mean = train.groupBy(*by).agg(F.avg(y).alias("_mean")).join(exact_quantiles(train, [*by], y, {"_median": 0.5}).drop("n_total"), [*by])
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("model"), v.alias("y_pred")) for n, v in (("zero", F.lit(0.0)), ("train_mean", F.col("_mean")), ("train_median", F.col("_median"))))))
    return rows.where("role = 'test'").join(mean, [*by]).select("*", each.alias("_b")).select(*rows.columns, F.lit("baseline").alias("info_set"), F.lit(0).alias("k"), "_b.*")


def stability(fits: DataFrame, by: tuple = ("horizon",)) -> DataFrame:
    """Of each configuration and feature: the folds that picked it, its ranks, and the share of folds."""
    one = fits.groupBy(*by, "fold", "info_set", "k").agg(F.first("features").alias("features"))  # models share the picks
    n = one.groupBy(*by, "info_set", "k").agg(F.countDistinct("fold").alias("n_folds"))
    at = one.select(*by, "fold", "info_set", "k", F.posexplode("features").alias("rank", "feature")).withColumn("rank", F.col("rank") + 1)
    s = at.groupBy(*by, "info_set", "k", "feature").agg(F.countDistinct("fold").alias("selection_count"), F.avg("rank").alias("mean_rank"), F.percentile("rank", F.lit(0.5)).alias("median_rank"))
    return s.join(n, [*by, "info_set", "k"]).withColumn("selection_frequency", F.col("selection_count") / F.col("n_folds"))
