"""Nearest neighbours by pivots and boxes against brute force, and augmentation with derived columns."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.operators import augment as ag
from tremor.operators import neighbours as nb

D0 = date(2000, 1, 1)


def brute(ids, days, xs, window):
    out = {}
    for k, i in enumerate(ids):
        d = ((xs - xs[k]) ** 2).sum(1)
        d[k] = np.inf
        if window is not None:
            d[np.abs(days - days[k]) > window] = np.inf
        if np.isfinite(d.min()):
            out[i] = d.min()
    return out


@pytest.mark.parametrize("window", [None, 300.0])
def test_chunk_is_exact_and_cheap(window):
    rng = np.random.default_rng(3)
    n = 4000
    for dims, share in ((3, 0.15), (10, 0.85)):
        xs, days = rng.random((n, dims)), rng.integers(0, 3000, n)
        ids = rng.permutation(n).astype(np.int64)
        blocks, made = nb.within_chunk(ids, days, xs, window, 64)
        got = {i: b for blk in blocks for i, b, o in zip(blk.ids.tolist(), blk.best, blk.near, strict=True) if o != nb.NOBODY}
        assert got == pytest.approx(brute(ids.tolist(), days, xs, window))
        assert made < share * n * n


@pytest.mark.parametrize("window, dims", [(None, 10), (400.0, 10), (400.0, 2)])
def test_chunks_meet_exactly(spark, monkeypatch, window, dims):
    monkeypatch.setattr(nb, "CHUNK", 60)
    monkeypatch.setattr(nb, "BLOCK", 8)
    rng = np.random.default_rng(dims)
    n = 700
    xs = np.round(rng.normal(size=(n, dims)) + 3 * rng.integers(0, 3, n)[:, None], 1)
    days, g = rng.integers(0, 4000, n), rng.choice(["a", "a", "a", "b"], n)
    g[0] = "alone"
    df = spark.createDataFrame([(str(g[i]), i, int(days[i]), [float(v) for v in xs[i]]) for i in range(n)], "g string, rep long, day int, x array<double>").repartition(5)
    got = {r.id: (r.near, r.dist) for r in nb.nearest_points(df, window).collect()}
    want = {}
    for name in ("a", "b"):
        at = np.flatnonzero(g == name)
        want |= brute(at.tolist(), days[at], xs[at], window)
    assert {i: d for i, (_, d) in got.items()} == pytest.approx(want)
    for i, (near, dist) in got.items():
        ties = [j for j in np.flatnonzero(g == g[i]) if j != i and (window is None or abs(days[i] - days[j]) <= window) and ((xs[i] - xs[j]) ** 2).sum() < dist - 1e-9]
        assert not ties and g[near] == g[i]


def test_groups_nulls_and_copies(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, None]), rng.choice("ab"), i, D0 + timedelta(days=rng.randrange(4000)), *(float(rng.randrange(3)) for _ in range(4))) for i in range(300)]
    rows += [(0, "a", 1000 + i, D0, 9.0, 9.0, 9.0, 9.0) for i in range(50)]  # a hot point
    rows += [(0, "a", 2000, D0, None, 1.0, 1.0, 1.0), (0, "a", 2001, None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "fold int, type string, event_id long, event_date date, p double, q double, s double, t double")
    got = {r.event_id: r.neighbour for r in nb.nearest_in_group(df, ["fold", "type"], True, ("p", "q", "s", "t")).collect()}
    ok = [r for r in rows if None not in r[3:]]
    for a in ok:
        cand = [b for b in ok if b[2] != a[2] and b[:2] == a[:2] and abs((a[3] - b[3]).days) <= nb.WINDOW_DAYS]
        want = min(cand, key=lambda b: (sum((x - y) ** 2 for x, y in zip(a[4:], b[4:], strict=True)), b[2]), default=None)
        assert got[a[2]] == (want[2] if want else None)
    assert 2000 not in got and 2001 not in got
    assert nb.nearest_in_group(df.limit(0), ["fold", "type"], False, ("p", "q")).count() == 0


def test_synthetic_rows_keep_identities(spark):
    rows = [(0, "Flood", 1, date(2010, 1, 1), 1e6, -0.01, 1e11, -0.01, 40.0), (0, "Flood", 2, date(2012, 1, 1), 5e6, -0.03, 1e11, -0.03, 80.0), (0, "Storm", 3, date(2011, 1, 1), 2e6, -0.02, 1e11, -0.02, 60.0)]
    m = spark.createDataFrame(rows, "fold int, type string, event_id long, event_date date, damage double, ret double, gdp double, y1 double, y3 double")

    def derive(df):
        df = df.withColumn("log_damage", F.log1p(F.greatest("damage", F.lit(0.0)))).withColumn("squared", F.col("ret") * F.col("ret"))
        return df.withColumn("to_gdp", F.when(F.col("gdp") > 0, F.col("damage") / F.col("gdp")).otherwise(0.0)).withColumn("log_x_flood", F.when(F.col("type") == "Flood", F.col("log_damage")).otherwise(0.0))

    few = ag.scaled(m, ["fold"], ["damage", "ret", "gdp"])
    syn = ag.interpolated(m, few, ["fold", "type"], ["damage", "ret", "gdp"], ["y1", "y3"], max_share=1.0, columns=("z_damage", "z_ret", "z_gdp"), derive=derive)
    got = syn.collect()
    assert len(got) == 2 and {r.type for r in got} == {"Flood"}
    for r in got:
        assert r.log_damage == pytest.approx(np.log1p(r.damage)) and r.squared == pytest.approx(r.ret**2)
        assert r.to_gdp == pytest.approx(r.damage / 1e11) and r.log_x_flood == r.log_damage
        assert 1e6 <= r.damage <= 5e6 and 40 <= r.y3 <= 80
    again = nb.nearest_in_group(few.unionByName(few.withColumn("fold", F.lit(1)).where("event_id <> 2")), ["fold", "type"], True, ("z_damage",))
    assert {(r.fold, r.event_id): r.neighbour for r in again.collect()} == {(0, 1): 2, (0, 2): 1, (0, 3): None, (1, 1): None, (1, 3): None}
    report = ag.pair_report(few, syn, ["fold"]).first()
    assert (report.n_minority, report.pairs_in_window, report.pairs_window_relaxed, report.skipped_no_partner, report.n_synthetic) == (3, 2, 0, 1, 2)
    far = few.withColumn("event_date", F.when(F.col("event_id") == 2, F.lit(date(2030, 1, 1))).otherwise(F.col("event_date")))
    wide = ag.interpolated(m, far, ["fold", "type"], ["damage"], "y1", copies=3, max_share=1.0, columns=("z_damage",))
    report = ag.pair_report(far, wide, ["fold"]).first()
    assert (report.pairs_in_window, report.pairs_window_relaxed, report.n_synthetic) == (0, 2, 6)
    with pytest.raises(ValueError):
        ag.interpolated(m, few, ["fold", "type"], ["damage"], "y1", columns=("z_damage",))


def test_columns_that_change_in_their_last_bits_when_read_again_keep_their_rows(spark):
    shaky = F.udf(lambda v: v * (1 + random.randrange(64) * 2.0**-52), "double").asNondeterministic()
    rows = spark.createDataFrame([(0, "a", k, D0, float(k + 1)) for k in range(40)], "fold int, type string, event_id long, event_date date, x double")
    got = nb.nearest_in_group(rows.withColumn("z", shaky("x")), ["fold", "type"], True, ("z",)).collect()
    assert sorted(r.event_id for r in got) == list(range(40)) and all(abs(r.neighbour - r.event_id) == 1 for r in got)
