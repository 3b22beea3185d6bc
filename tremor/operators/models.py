"""Forecast models: additive-moment ridge, MLlib fits per fold, blends and importance."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.functions.draws import hash_unit
from tremor.functions.ordered import order_index

# The penalty grid of the linear family and its fallback.
ALPHAS = [float(a) for a in np.logspace(-3, 3, 13)]
DEFAULT_ALPHA = 1.0


def moments(df: DataFrame, by: list[str], xs: list[str], y: str) -> DataFrame:
    """Additive moments of (xs, y) per group in one pass; enough for any least-squares fit."""
    p = len(xs)
    c = lambda name: F.col(name).cast("double")
    aggs = [F.count("*").cast("double").alias("n"), F.sum(c(y)).alias("sy"), F.sum(c(y) * c(y)).alias("syy")]
    aggs += [F.sum(c(x)).alias(f"sx_{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(c(x) * c(y)).alias(f"sxy_{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(c(xs[i]) * c(xs[j])).alias(f"sxx_{i}_{j}") for i in range(p) for j in range(i, p)]
    return df.groupBy(*by).agg(*aggs)


def _unpack(row, p: int):
    sx = np.array([row[f"sx_{i}"] for i in range(p)])
    sxy = np.array([row[f"sxy_{i}"] for i in range(p)])
    sxx = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            sxx[i, j] = sxx[j, i] = row[f"sxx_{i}_{j}"]
    return row["n"], sx, row["sy"], sxx, sxy, row["syy"]


def ridge_from_moments(row, p: int, alpha: float):
    """(intercept, slopes) of a ridge on standardised columns, mapped back to raw units."""
    n, sx, sy, sxx, sxy, _ = _unpack(row, p)
    mx, my = sx / n, sy / n
    cov = sxx / n - np.outer(mx, mx)
    var = np.diag(cov).copy()
    flat = var <= 1e-12 * np.diag(sxx) / n  # constant column: rounding left-over, not spread
    sd = np.sqrt(np.where(flat, 1.0, var))
    cov[flat, :] = cov[:, flat] = 0.0
    lhs = n * cov / np.outer(sd, sd) + alpha * np.eye(p)
    w = np.linalg.solve(lhs, np.where(flat, 0.0, n * (sxy / n - mx * my)) / sd) / sd
    return my - float(w @ mx), w


def sse_from_moments(row, p: int, b0: float, w) -> float:
    n, sx, sy, sxx, sxy, syy = _unpack(row, p)
    return syy - 2 * b0 * sy - 2 * w @ sxy + n * b0 * b0 + 2 * b0 * w @ sx + w @ sxx @ w


def _fit_groups(p: int, keys: list[str], alphas: list[float], blocks: dict[str, list[int]]):
    """Per group and feature block: choose the penalty on the inner splits, then fit on all train rows.

    A block is a subset of the columns, so its moments are a sub-matrix of the same row.
    """

    def narrowed(row, idx):
        out = {"n": row["n"], "sy": row["sy"], "syy": row["syy"]}
        for a, i in enumerate(idx):
            out[f"sx_{a}"], out[f"sxy_{a}"] = row[f"sx_{i}"], row[f"sxy_{i}"]
            for b in range(a, len(idx)):
                lo, hi = sorted((i, idx[b]))
                out[f"sxx_{a}_{b}"] = row[f"sxx_{lo}_{hi}"]
        return out

    def choose(pairs, q):
        means = {}
        for a in alphas:
            errs = []
            for tr, va in pairs:
                b0, w = ridge_from_moments(tr, q, a)
                errs.append(np.sqrt(max(sse_from_moments(va, q, b0, w), 0.0) / va["n"]))
            if errs:
                means[a] = np.mean(errs)
        return min(means, key=lambda a: (means[a], a)) if means else DEFAULT_ALPHA

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf[pdf["split"] < 0]
        out = []
        if len(whole):
            full = whole.iloc[0]
            for name, idx in blocks.items():
                best = DEFAULT_ALPHA
                for _, made in sorted(pdf[pdf["split"] >= 0].groupby("k"), key=lambda g: -g[0]):
                    pairs = []
                    for _, g in made.groupby("split"):
                        tr, va = g[g["inner_role"] == "train"], g[g["inner_role"] == "validation"]
                        if len(tr) and len(va) and tr["n"].iloc[0] >= 5:
                            pairs.append((narrowed(tr.iloc[0], idx), narrowed(va.iloc[0], idx)))
                    if len(pairs) >= 2:
                        best = choose(pairs, len(idx))
                        break
                b0, w = ridge_from_moments(narrowed(full, idx), len(idx), best)
                slopes = np.zeros(p)
                slopes[idx] = w
                out.append({**{k: full[k] for k in keys}, "block": name, "alpha": best, "n_train": int(full["n"]),
                            "intercept": b0, "slopes": [float(v) for v in slopes]})
        return pd.DataFrame(out, columns=[*keys, "block", "alpha", "n_train", "intercept", "slopes"])

    return fit


def inner_positions(train: DataFrame, by: list[str], date: str, key: str) -> DataFrame:
    """Train rows with their place and count inside each fold."""
    placed = order_index(train, date, key, "_pos", by=by)
    n = train.groupBy(*by).agg(F.count("*").alias("_n"))
    return placed.join(n, by)


def split_moments(rows: DataFrame, xs: list[str], y: str, label_end: str, k_inner: int, keys: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """Moments of the train rows of every fold (split -1) and of its purged inner splits, and what columns were centred on.

    The inner splits are made k_inner, k_inner - 1, ... and 2 at a time (column k). All of it is one grouped scan: rows with
    the same roles in all splits share their moments, which are added up for each split afterwards.
    """
    from tremor.operators.folds import split_bits, split_roles

    train = rows.where("role = 'train'")
    means = train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in [*xs, y]]).first()
    offset = {c: float(means[c] or 0.0) for c in [*xs, y]}
    train = train.withColumns({c: F.col(c).cast("double") - F.lit(m) for c, m in offset.items()})
    marked, parts = split_bits(train.select(*keys, "event_date", "event_id", label_end, *xs, y), keys, "event_date", "event_id", label_end, range(k_inner, 1, -1))
    m = moments(marked, [*keys, "_bits"], xs, y)
    whole = F.array(F.struct(F.lit(0).alias("k"), F.lit(-1).alias("split"), F.lit("all").alias("inner_role")))
    added = [c for c in m.columns if c not in (*keys, "_bits")]
    each = m.select("*", F.explode(F.concat(whole, split_roles(parts))).alias("_x")).select(*keys, "_x.*", *added)
    return each.groupBy(*keys, "split", "inner_role", "k").agg(*(F.sum(c).alias(c) for c in added)), offset


def ridge_walk_forward(rows: DataFrame, xs: list[str], y: str, label_end: str, alphas=None, k_inner: int = 3,
                       by: tuple = ("fold",), blocks: dict[str, list[str]] | None = None) -> DataFrame:
    """(by, block, alpha, n_train, intercept, slopes), the penalty picked by purged inner splits.

    Where fewer than two of ``k_inner`` splits survive the purge, fewer are made, down to two; where
    that fails too, the penalty is the default one. Columns are centred on their means over all rows
    before moments are taken, so large offsets cost no digits.

    ``rows`` is a purged, imputed membership table without missing y; ``by`` may add
    configuration keys to the fold. All fits of all configurations, folds, splits,
    blocks and penalties come from one grouped scan of moments; only those small
    rows reach Python.
    """
    alphas = ALPHAS if alphas is None else alphas
    keys = [*by]
    idx = {n: [xs.index(c) for c in cs] for n, cs in (blocks or {"all": xs}).items()}
    both, offset = split_moments(rows, xs, y, label_end, k_inner, keys)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema if f.name in keys)
    fits = both.groupBy(*keys).applyInPandas(
        _fit_groups(len(xs), keys, alphas, idx),
        f"{types}, block string, alpha double, n_train long, intercept double, slopes array<double>",
    )
    moved = F.lit(offset[y])
    for i, x in enumerate(xs):
        moved = moved - F.element_at("slopes", i + 1) * F.lit(offset[x])
    return fits.withColumn("intercept", F.col("intercept") + moved)


def linear_predictions(test: DataFrame, fits: DataFrame, keys: list[str], xs: list[str], out: str = "y_pred") -> DataFrame:
    """Predictions as a column expression over the joined coefficients (one row per fit)."""
    value = F.col("intercept")
    for i, x in enumerate(xs):
        value = value + F.element_at("slopes", i + 1) * F.col(x)
    return test.join(fits, keys).withColumn(out, value)


def fit_folds(rows: DataFrame, folds: list[int], estimator, xs: list[str], y: str, keep: list[str],
              output=None, threads: int = 4) -> DataFrame:
    """Fit an MLlib estimator on each fold's train rows and score its test rows.

    Folds are independent jobs from a small pool; rows never leave the cluster.
    """
    output = F.col("prediction") if output is None else output
    data = rows.select("fold", "role", *dict.fromkeys([*keep, *xs, y])).withColumn("label", F.col(y).cast("double"))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=xs, outputCol="features"), estimator])

    def one(f):
        model = pipe.fit(data.where((F.col("fold") == f) & (F.col("role") == "train")))
        return model.transform(data.where((F.col("fold") == f) & (F.col("role") == "test"))).select("fold", *keep, output.alias("y_pred"))

    if not folds:
        return data.limit(0).select("fold", *keep, F.lit(None).cast("double").alias("y_pred"))
    with ThreadPoolExecutor(threads) as pool:
        parts = list(pool.map(one, folds))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def class_probability(column: str = "probability"):
    return F.element_at(vector_to_array(column), 2)


def balanced_weights(rows: DataFrame, y: str) -> DataFrame:
    """Adds w: inverse class frequency within each fold's train rows."""
    c = rows.where("role = 'train'").groupBy("fold").agg(F.sum((F.col(y) == 1).cast("double")).alias("_p"), F.count(y).alias("_t"))
    w = F.when(F.col(y) == 1, F.col("_t") / (2 * F.col("_p"))).otherwise(F.col("_t") / (2 * (F.col("_t") - F.col("_p"))))
    return rows.join(F.broadcast(c), "fold").withColumn("w", F.coalesce(w, F.lit(1.0))).drop("_p", "_t")  # one row per fold


def prior_fold_blend(oof: DataFrame, members: list[str], by: list[str], key: str) -> DataFrame:
    """Blend weighted by inverse RMSE on earlier folds; equal weights on the first fold."""
    e = F.col("y_pred") - F.col("y_true")
    live = oof.where(F.col("model").isin(members))
    per = live.groupBy(*by, "model", "fold").agg(F.sum(e * e).alias("_s"), F.count("*").alias("_c"))
    before = W.partitionBy(*by, "model").orderBy("fold").rowsBetween(W.unboundedPreceding, -1)
    rm = F.sqrt(F.sum("_s").over(before) / F.sum("_c").over(before))
    weights = per.select(*by, "model", "fold", F.when(rm.isNull(), F.lit(1.0)).otherwise(1.0 / F.greatest(rm, F.lit(1e-8))).alias("_w"))
    j = live.join(F.broadcast(weights), [*by, "model", "fold"])  # folds x models
    return j.groupBy(*by, "fold", key).agg(F.max("y_true").alias("y_true"), (F.sum(F.col("_w") * F.col("y_pred")) / F.sum("_w")).alias("y_pred"))


def nonnegative_fit(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Least squares with non-negative weights by trying each support of a few members."""
    m, best, best_w = len(rhs), 0.0, np.zeros(len(rhs))
    for size in range(1, m + 1):
        for s in combinations(range(m), size):
            s = list(s)
            try:
                w = np.linalg.solve(gram[np.ix_(s, s)], rhs[s])
            except np.linalg.LinAlgError:
                continue
            value = w @ gram[np.ix_(s, s)] @ w - 2 * w @ rhs[s]
            if (w >= 0).all() and value < best - 1e-12:
                best, best_w = value, np.zeros(m)
                best_w[s] = w
    return best_w


def stack_weights(wide: DataFrame, by: list[str], members: list[str], y: str, intercept: bool) -> DataFrame:
    """Non-negative weights per (by, fold) from the moments of earlier folds.

    With an intercept the raw weights are kept; without, they are scaled to sum to 1.
    """
    per = moments(wide, [*by, "fold"], members, y)
    cols = [c for c in per.columns if c not in (*by, "fold")]
    before = W.partitionBy(*by).orderBy("fold").rowsBetween(W.unboundedPreceding, -1)
    prior = per.select(*by, "fold", *[F.sum(c).over(before).alias(c) for c in cols]).where("n IS NOT NULL")
    p = len(members)

    def solve(pdfs):
        for pdf in pdfs:
            out = []
            for _, row in pdf.iterrows():
                n, sx, sy, sxx, sxy, _ = _unpack(row, p)
                if intercept:
                    mx, my = sx / n, sy / n
                    w = nonnegative_fit(sxx / n - np.outer(mx, mx), sxy / n - mx * my)
                    b0 = my - float(w @ mx)
                else:
                    w, b0 = nonnegative_fit(sxx / n, sxy / n), 0.0
                    w = w / w.sum() if w.sum() > 0 else np.full(p, 1.0 / p)
                out.append({**{k: row[k] for k in (*by, "fold")}, "intercept": b0, "slopes": [float(v) for v in w]})
            yield pd.DataFrame(out, columns=[*by, "fold", "intercept", "slopes"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prior.schema if f.name in by)
    return prior.mapInPandas(solve, f"{schema + ', ' if schema else ''}fold long, intercept double, slopes array<double>")


def permutation_importance(rows: DataFrame, fits: DataFrame, xs: list[str], y: str, n: int, repeats: int, seed: int = 42) -> DataFrame:
    """RMSE increase when one column is replaced by another row's value.

    A repeat pairs row i with row (i + shift) mod n, the shift coming from a hash of
    (feature, repeat): a permutation made by an equi-join on the row position.
    ``rows`` carries a dense position ``pos`` in [0, n).
    """
    base = linear_predictions(rows, fits, ["fold"], xs, "_p0")
    grid = [(x, i, r) for i, x in enumerate(xs) for r in range(repeats)]
    picks = base.withColumn("_g", F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.lit(i + 1).alias("slot"), F.lit(r).alias("repeat")) for x, i, r in grid])))
    picks = picks.select("*", "_g.feature", "_g.slot", "_g.repeat").withColumn(
        "_to", (F.col("pos") + F.floor(hash_unit(seed, "feature", "repeat") * F.lit(n))) % F.lit(n))
    donor = rows.select(F.col("pos").alias("_to"), F.array(*[F.col(x) for x in xs]).alias("_d"))
    j = picks.join(donor, "_to")
    own = F.element_at(F.array(*[F.col(x) for x in xs]), F.col("slot"))
    shifted = F.col("_p0") + F.element_at("slopes", F.col("slot")) * (F.element_at("_d", F.col("slot")) - own)
    e0, e1 = F.col("_p0") - F.col(y), shifted - F.col(y)
    per = j.groupBy("feature", "repeat").agg((F.sqrt(F.avg(e1 * e1)) - F.sqrt(F.avg(e0 * e0))).alias("d"))
    return per.groupBy("feature").agg(F.avg("d").alias("importance"), F.stddev_pop("d").alias("spread"))


def expanding_ridge(sessions: DataFrame, xs: list[str], h: int, alpha: float = 10.0, least: int = 250) -> DataFrame:
    """Expected h-session return at every session from rows settled before it.

    ``xs`` are columns known at the previous close and ``y`` the forward label. The
    moments are running sums ending h rows back; each session's small system is
    solved from them. Sessions with a missing feature get no expectation.
    """
    w = W.partitionBy("series_id").orderBy("date").rowsBetween(W.unboundedPreceding, -h)
    ok = F.col("y").isNotNull()
    for x in xs:
        ok = ok & F.col(x).isNotNull()
    use = lambda e: F.sum(F.when(ok, e)).over(w)
    p = len(xs)
    cols = [F.sum(ok.cast("double")).over(w).alias("n"), use(F.col("y")).alias("sy"), use(F.col("y") * F.col("y")).alias("syy")]
    cols += [use(F.col(x)).alias(f"sx_{i}") for i, x in enumerate(xs)] + [use(F.col(x) * F.col("y")).alias(f"sxy_{i}") for i, x in enumerate(xs)]
    cols += [use(F.col(xs[i]) * F.col(xs[j])).alias(f"sxx_{i}_{j}") for i in range(p) for j in range(i, p)]
    ready = sessions.select("series_id", "session_idx", *xs, *cols).where(F.col("n") >= least)
    for x in xs:
        ready = ready.where(F.col(x).isNotNull())

    def solve(pdfs):
        """All sessions of a batch at once: one stacked p x p solve."""
        for pdf in pdfs:
            n = pdf["n"].to_numpy()
            sx, sxy = (np.stack([pdf[f"{k}_{i}"].to_numpy() for i in range(p)], axis=1) for k in ("sx", "sxy"))
            mx, my = sx / n[:, None], pdf["sy"].to_numpy() / n
            cov = np.empty((len(pdf), p, p))
            for i in range(p):
                for j in range(i, p):
                    cov[:, i, j] = cov[:, j, i] = pdf[f"sxx_{i}_{j}"].to_numpy() / n - mx[:, i] * mx[:, j]
            sd = np.sqrt(np.clip(np.diagonal(cov, axis1=1, axis2=2), 0.0, None))
            sd[sd == 0] = 1.0
            lhs = n[:, None, None] * cov / (sd[:, :, None] * sd[:, None, :]) + alpha * np.eye(p)
            rhs = n[:, None] * (sxy / n[:, None] - mx * my[:, None]) / sd
            w = np.linalg.solve(lhs, rhs[:, :, None])[:, :, 0] / sd
            x = np.stack([pdf[c].to_numpy() for c in xs], axis=1)
            yield pd.DataFrame({"series_id": pdf["series_id"], "session_idx": pdf["session_idx"], "expected": my + ((x - mx) * w).sum(axis=1)})

    return ready.mapInPandas(solve, "series_id string, session_idx long, expected double")


# Grid of the variance recursion, and the history it needs.
GARCH_A = [0.02, 0.05, 0.10, 0.15, 0.20]
GARCH_B = [0.60, 0.70, 0.80, 0.85, 0.90, 0.93]
GARCH_HISTORY = 250


def yearly_volatility(sessions: DataFrame, ret: str = "log_return", least: int = GARCH_HISTORY) -> DataFrame:
    """Conditional volatility from a variance-targeted recursion re-picked every year.

    For each (series, year) the pair (a, b) with the best Gaussian likelihood on
    strictly earlier years is chosen from a fixed grid; the year is then filtered
    with it. Arrays hold one series' calendar, a bounded length.
    """
    df = sessions.select("series_id", "date", F.year("date").alias("year"), F.col(ret).alias("r"))
    per_year = df.groupBy("series_id", "year").agg(F.sort_array(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("date", "r")))).alias("_rows"))
    w = W.partitionBy("series_id").orderBy("year").rowsBetween(W.unboundedPreceding, -1)
    past = per_year.select("series_id", "year", F.transform(F.flatten(F.collect_list("_rows").over(w)), lambda s: s["r"]).alias("past"))
    past = past.where(F.size("past") >= least)
    n = F.size("past").cast("double")
    mean_sq = F.aggregate("past", F.lit(0.0), lambda acc, x: acc + x * x) / n
    grid = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in GARCH_A for b in GARCH_B if a + b < 1])
    trial = past.withColumn("v", mean_sq).withColumn("_g", F.explode(grid)).select("series_id", "year", "past", "v", "_g.a", "_g.b")
    omega = F.col("v") * (1 - F.col("a") - F.col("b"))
    scored = trial.withColumn("_s", F.aggregate(
        "past", F.struct(F.col("v").alias("h"), F.lit(0.0).alias("ll")),
        lambda s, x: F.struct(
            (omega + F.col("a") * x * x + F.col("b") * s["h"]).alias("h"),
            (s["ll"] - F.log(s["h"]) - x * x / s["h"]).alias("ll")),
    ))
    best = scored.groupBy("series_id", "year").agg(F.max_by(F.struct("a", "b", "v", F.col("_s.h").alias("h")), F.struct("_s.ll", "a", "b")).alias("_b"))
    inside = W.partitionBy("series_id", "year").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    filt = df.join(best, ["series_id", "year"]).withColumn("_seen", F.collect_list(F.coalesce("r", F.lit(0.0))).over(inside))
    b = F.col("_b")
    om = b["v"] * (1 - b["a"] - b["b"])
    h = F.aggregate("_seen", b["h"], lambda acc, x: om + b["a"] * x * x + b["b"] * acc)
    return filt.select("series_id", "date", "year", b["a"].alias("a"), b["b"].alias("b"), F.sqrt(h).alias("cond_vol"))
