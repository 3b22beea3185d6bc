"""Penalised logistic regressions of all configurations, folds, inner splits and penalties at once.

One Newton step of every open fit is one aggregation: the train rows, packed once in chunks of a fit,
join the present coefficients, a row for each fit, and sums of gradient and curvature come back, a row
for each fit. The number of jobs is the number of steps, whatever the number of fits. The objective is
half the squared slopes plus C times the weighted log loss, on columns standardised over the fit's own
train rows, with classes weighed alike and a free intercept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.operators import metrics as mt
from tremor.operators.folds import split_bits, split_roles
from tremor.session import stage

# The penalty grid and the one used where no inner split can tell penalties apart.
PENALTIES = (0.01, 0.1, 1.0, 10.0)
DEFAULT_C = 1.0
STEPS, NEAR, LONGEST_STEP = 50, 1e-10, 4.0
#: Parts that the rows of a fit are dealt to before they are packed.
SALTS = 16


def _fit_rows(train: DataFrame, by: list[str], label_end: str, k_inner: int) -> DataFrame:
    """Train rows of every fold (split -1, role train) and of its purged inner splits."""
    marked, parts = split_bits(train, by, "event_date", "event_id", label_end, (k_inner,))
    inner = marked.select(*train.columns, F.explode(split_roles(parts)).alias("_x")).select(*train.columns, "_x.split", "_x.inner_role")
    whole = train.withColumn("split", F.lit(-1)).withColumn("inner_role", F.lit("train"))
    return whole.unionByName(inner.select(*whole.columns))


def _standards(rows: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    """One row for each fit: means, deviations (1 for a constant column) and the two class counts."""
    sd = lambda x: F.when(F.stddev_pop(x) > 1e-9 * F.greatest(F.abs(F.avg(x)), F.lit(1e-300)), F.stddev_pop(x)).otherwise(F.lit(1.0))
    return rows.where("inner_role = 'train'").groupBy(*keys).agg(
        F.array(*(F.avg(x) for x in xs)).alias("_mean"), F.array(*(sd(x) for x in xs)).alias("_sd"), F.count("*").alias("n_train"), F.sum(y).cast("long").alias("_ones"))


def _scaled(rows: DataFrame, standards: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    j = rows.join(standards, keys)  # one row for each fit
    return j.withColumn("_z", F.array(*((F.col(x).cast("double") - F.col("_mean")[i]) / F.col("_sd")[i] for i, x in enumerate(xs)))).drop(*xs)


def _linear(w: str, z: str, p: int) -> Column:
    return sum((F.col(w)[i + 1] * F.col(z)[i] for i in range(p)), F.col(w)[0])


def _packed(keys: list[str], p: int):
    """Rows of one batch as one row of arrays for each fit in it."""

    def pack(pdfs):
        for pdf in pdfs:
            made = []
            for key, g in pdf.groupby(keys, sort=False):
                z = np.column_stack([np.ones(len(g)), *(g[f"_z{i}"].to_numpy(float) for i in range(p))])
                made.append((*key, z.tobytes(), g["_y"].to_numpy(float).tobytes(), g["_s"].to_numpy(float).tobytes()))
            yield pd.DataFrame(made, columns=[*keys, "_zs", "_ys", "_ss"])

    return pack


def _chunk_sums(p: int, keys: list[str]):
    """Gradient and curvature of each packed chunk under the coefficients joined to it."""
    at = np.triu_indices(p + 1)

    def sums(pdfs):
        names = [*(f"g{i}" for i in range(p + 1)), *(f"h{i}_{j}" for i, j in zip(*at, strict=True))]
        for pdf in pdfs:
            made = []
            for row in pdf.itertuples(index=False):
                r = row._asdict()
                z = np.frombuffer(r["chunk_z"], float).reshape(-1, p + 1)
                y, s, w = np.frombuffer(r["chunk_y"], float), np.frombuffer(r["chunk_s"], float), np.asarray(r["w"], float)
                mu = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -700.0, 700.0)))
                h = z.T @ (z * (s * mu * (1.0 - mu))[:, None])
                made.append((*(r[k] for k in keys), r["penalty"], w.tolist(), *(z.T @ (s * (y - mu))), *h[at]))
            yield pd.DataFrame(made, columns=[*keys, "penalty", "w", *names])

    return sums, ", ".join([*(f"g{i} double" for i in range(p + 1)), *(f"h{i}_{j} double" for i, j in zip(*at, strict=True))])


def _step(p: int, keys: list[str]):
    """New coefficients of each fit from its sums; a step longer than LONGEST_STEP is shortened."""

    def solve(pdfs):
        for pdf in pdfs:
            out = []
            for row in pdf.itertuples(index=False):
                r = row._asdict()
                w, c = np.array(r["w"]), r["penalty"]
                g = np.array([r[f"g{i}"] for i in range(p + 1)])
                h = np.zeros((p + 1, p + 1))
                for i in range(p + 1):
                    for j in range(i, p + 1):
                        h[i, j] = h[j, i] = r[f"h{i}_{j}"]
                pull = np.r_[0.0, np.full(p, 1.0 / c)]
                d = np.linalg.solve(h + np.diag(pull) + 1e-12 * np.eye(p + 1), g - pull * w)
                top = np.abs(d).max()
                d *= min(1.0, LONGEST_STEP / top) if top > 0 else 1.0
                out.append({**{k: r[k] for k in keys}, "penalty": c, "w": [float(v) for v in w + d], "moved": float(top)})
            yield pd.DataFrame(out, columns=[*keys, "penalty", "w", "moved"])

    return solve


def logistic_fits(rows: DataFrame, xs: list[str], y: str, keys: list[str], penalties=PENALTIES) -> tuple[DataFrame, DataFrame]:
    """(keys, penalty, w, moved) on standardised columns, and the standards of each fit; rows have inner_role.

    Fits whose train rows hold one class only are not among the coefficients.
    """
    p = len(xs)
    standards = stage(_standards(rows, keys, xs, y), "logit-standards")
    both = standards.where((F.col("_ones") > 0) & (F.col("_ones") < F.col("n_train")))
    z = _scaled(rows.where("inner_role = 'train'").select(*keys, *xs, F.col(y).cast("double").alias("_y")), both, keys, xs)
    share = F.when(F.col("_y") == 1, F.col("_ones")).otherwise(F.col("n_train") - F.col("_ones"))
    z = z.select(*keys, *(F.col("_z")[i].alias(f"_z{i}") for i in range(p)), "_y", (F.col("n_train") / (2.0 * share)).alias("_s"))
    # rows of a fit are dealt to SALTS parts, so that no task holds a whole fit, and packed batch by batch
    dealt = z.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).repartition(*keys, "_salt").sortWithinPartitions(*keys)
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in z.schema if f.name in keys)
    z = dealt.mapInPandas(_packed(keys, p), f"{key_types}, _zs binary, _ys binary, _ss binary")
    z = stage(z.select(*keys, F.col("_zs").alias("chunk_z"), F.col("_ys").alias("chunk_y"), F.col("_ss").alias("chunk_s")), "logit-rows")
    sums, sum_types = _chunk_sums(p, keys)
    state = both.select(*keys, F.explode(F.array(*map(F.lit, map(float, penalties)))).alias("penalty"), F.array(*[F.lit(0.0)] * (p + 1)).alias("w"), F.lit(1e300).alias("moved"))
    state, done = stage(state, "logit-state"), None
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
    sums_schema = f"{key_types}, penalty double, w array<double>, {sum_types}"
    names = [c.split()[0] for c in sum_types.split(", ")]
    for _ in range(STEPS):
        j = z.join(F.broadcast(state.drop("moved")), keys).mapInPandas(sums, sums_schema)  # one row for each fit and penalty
        step = j.groupBy(*keys, "penalty").agg(F.first("w").alias("w"), *[F.sum(c).alias(c) for c in names])
        step = stage(step.mapInPandas(_step(p, keys), types), "logit-state")
        met = step.where(F.col("moved") <= NEAR)
        done = met if done is None else done.unionByName(met)
        state = step.where(F.col("moved") > NEAR)
        if not state.take(1):
            break
    return done.unionByName(state), standards


def logistic_walk_forward(rows: DataFrame, xs: list[str], y: str, label_end: str, by: tuple = ("fold",), penalties=PENALTIES, k_inner: int = 3) -> DataFrame:
    """(by, penalty, n_train, intercept, slopes): the penalty with the best mean AUC on the inner splits.

    A fold with one class in its train rows gets no slopes and an intercept of infinite odds for that
    class; where no inner split has two classes on both sides, the penalty is the default one.
    """
    keys = [*by, "split"]
    train = stage(rows.where("role = 'train'").select(*by, "event_id", "event_date", label_end, y, *xs), "logit-train")
    held = stage(_fit_rows(train, [*by], label_end, k_inner), "logit-splits")
    used = tuple(dict.fromkeys([*penalties, DEFAULT_C]))
    fits, standards = logistic_fits(held, xs, y, keys, used)
    fits = stage(fits, "logit-fits")
    # inner validation rows under every penalty, ranked by one pass of running sums
    check = held.where("inner_role = 'validation'").select(*keys, *xs, F.col(y).cast("int").alias("_y"))
    scored = _scaled(check, standards, keys, xs).join(fits, keys).select(*keys, "penalty", "_y", _linear("w", "_z", len(xs)).alias("_p"))
    auc = mt.roc_auc(scored, [*keys, "penalty"], "_y", "_p").where(F.col("auc").isNotNull() & F.col("penalty").isin(*map(float, penalties)))
    mean = auc.groupBy(*by, "penalty").agg(F.round(F.avg("auc"), 12).alias("m"))
    best = mean.groupBy(*by).agg(F.max(F.struct("m", (-F.col("penalty")).alias("low"))).alias("b")).select(*by, (-F.col("b.low")).alias("best"))
    whole = standards.where("split = -1").drop("split").join(best, [*by], "left").withColumn("penalty", F.coalesce("best", F.lit(float(DEFAULT_C))))
    got = whole.join(fits.where("split = -1").select(*by, "penalty", "w"), [*by, "penalty"], "left")
    slopes = F.transform(F.sequence(F.lit(0), F.lit(len(xs) - 1)), lambda i: F.col("w")[i + 1] / F.col("_sd")[i])
    got = got.withColumn("slopes", F.when(F.col("w").isNotNull(), slopes).otherwise(F.array(*[F.lit(0.0)] * len(xs))))
    shift = F.aggregate(F.zip_with("slopes", "_mean", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    sure = F.when(F.col("_ones") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return got.select(*by, "penalty", "n_train", F.coalesce(F.col("w")[0] - shift, sure).alias("intercept"), "slopes")


def probabilities(test: DataFrame, fits: DataFrame, xs: list[str], by: tuple = ("fold",), out: str = "prob") -> DataFrame:
    """Test rows with the probability of class one."""
    j = test.join(fits.drop("n_train"), [*by])
    eta = sum((F.col("slopes")[i] * F.col(x) for i, x in enumerate(xs)), F.col("intercept"))
    return j.withColumn(out, 1.0 / (1.0 + F.exp(-eta))).drop("slopes", "intercept")
