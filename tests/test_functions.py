import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.functions import ordered as od
from tremor.functions import scalars as sc
from tremor.functions.dist import student_p, two_sided_p
from tremor.functions.draws import cluster_draws


def hot_values(n=3000, seed=1):
    rng = random.Random(seed)
    return [1.5 if rng.random() < 0.34 else rng.gauss(0, 1) for _ in range(n)]


def test_exact_quantiles_with_a_hot_value(spark):
    v = hot_values()
    df = spark.createDataFrame([("g", x) for x in v], "g string, v double")
    got = od.exact_quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.937}).first()
    assert [got.a, got.b, got.c] == pytest.approx(list(np.quantile(v, [0.05, 0.5, 0.937])))


def test_value_ranks_match_average_ties(spark):
    v = [round(x, 1) for x in hot_values(500)]
    df = spark.createDataFrame([("g", x) for x in v], "g string, v double")
    got = {r.v: r["rank"] for r in od.value_ranks(df, ["g"], "v", 7).collect()}
    s = sorted(v)
    for x in set(v):
        lo, hi = s.index(x) + 1, len(s) - s[::-1].index(x)
        assert got[x] == (lo + hi) / 2


@pytest.mark.parametrize("parts", [1, 8])
def test_order_index_with_a_hot_date(spark, parts):
    rng = random.Random(3)
    rows = [(i, 5 if rng.random() < 0.4 else rng.randrange(20)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, day int").repartition(parts)
    got = {r.id: r.ord for r in od.order_index(df, "day", "id", width=16).collect()}
    want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda t: (t[1], t[0])))}
    assert got == want


def test_student_and_normal_p(spark):
    assert student_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-7)
    assert student_p(12.706, 1) == pytest.approx(0.05, abs=1e-5)
    df = spark.createDataFrame([(1.96, -1.0), (0.0, 5.0), (None, 5.0)], "s double, d double")
    p = [r.p for r in df.select(two_sided_p("s", "d").alias("p")).collect()]
    assert p[0] == pytest.approx(math.erfc(1.96 / math.sqrt(2))) and p[1] == pytest.approx(1.0) and p[2] is None


def test_draws_do_not_depend_on_partitioning(spark):
    c = spark.createDataFrame([("g", f"c{i}") for i in range(30)], "g string, c string")
    one = {tuple(r) for r in cluster_draws(c.repartition(1), ["g"], "c", 20).collect()}
    many = {tuple(r) for r in cluster_draws(c.repartition(8), ["g"], "c", 20).collect()}
    assert one == many
    assert {b: sum(r[3] for r in one if r[1] == b) for b in range(20)} == {b: 30 for b in range(20)}


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0, None, float("nan"))], "a double, b double, c double, d double")
    r = df.select(
        sc.ratio("a", "b").alias("x"), sc.finite("d").alias("y"), sc.log1p_clipped(F.lit(-5.0)).alias("z"),
        sc.flag_interaction(F.lit(0), "c").alias("i"), sc.flag_interaction(F.lit(1), "c").alias("j"), sc.all_present("a", "c").alias("k"),
        sc.safe_date(F.lit(2020), F.lit(None).cast("int"), F.lit(None).cast("int")).cast("string").alias("dt"), sc.safe_date(F.lit(2020), F.lit(2), F.lit(31)).alias("bad"),
    ).first()
    assert (r.x, r.y, r.z, r.i, r.j, r.k, r.dt, r.bad) == (None, None, 0.0, 0.0, None, 0.0, "2020-01-01", None)


def test_wilson_and_hanley(spark):
    lo, hi = sc.wilson(F.lit(20), F.lit(30))
    a, b = sc.hanley_mcneil(F.lit(0.8), F.lit(10), F.lit(20))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi"), a.alias("a"), b.alias("b")).first()
    assert r.lo == pytest.approx(0.4878, abs=1e-3) and r.hi == pytest.approx(0.8077, abs=1e-3) and r.a < 0.8 < r.b


def test_local_folder_where_none_is_named(spark, monkeypatch):
    from tremor import session

    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: None)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(session, "_OWN", {})
    a, b = session.shared_dir(spark), session.shared_dir(spark)
    assert a == b and a.startswith("/tmp/spark-")
    assert session.stage(spark.range(3), "kept").count() == 3


def test_quantiles_are_exact_where_the_sketch_points_elsewhere(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = {"g": rng.normal(size=30_000), None: rng.integers(0, 9, 2000).astype(float)}
    df = spark.createDataFrame([(g, float(x), float(-x) if i % 3 else None) for g, xs in v.items() for i, x in enumerate(xs)] + [("empty", None, None)], "g string, v double, w double")
    wanted = {"a": ("v", 0.1), "b": ("v", 0.5), "c": ("w", 0.9)}
    for width in (od.SKETCH, 10**7):  # the second one leaves no room for an error of the sketch
        monkeypatch.setattr(od, "SKETCH", width)
        got = {r.g: r for r in od.exact_quantiles_of(df.where("g IS NOT NULL OR v < 99"), ["g"], wanted).collect()}
        assert set(got) == {"g", None, "empty"} and got["empty"].a is None
        w = [-x for i, x in enumerate(v["g"]) if i % 3]
        assert [got["g"].a, got["g"].b, got["g"].c] == pytest.approx([*np.quantile(v["g"], [0.1, 0.5]), np.quantile(w, 0.9)], abs=1e-12)
    monkeypatch.setattr(od, "_bracketed", lambda df, by, wanted: (df.select(*by).distinct(), df.limit(1).select(*by, F.lit("a").alias("_name"), F.lit(0.1).alias("_p"), F.lit(9).alias("_n"), F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi"))))
    assert od.exact_quantiles(df.where("g = 'g'"), ["g"], "v", {"a": 0.1}).first().a == pytest.approx(np.quantile(v["g"], 0.1))
    assert {r.g: r.a for r in od.exact_quantiles_of(df, ["g"], {"a": ("v", 0.1)}).collect()}["g"] == pytest.approx(np.quantile(v["g"], 0.1))
