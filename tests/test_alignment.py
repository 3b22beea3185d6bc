from datetime import date

import pytest

from tremor.operators import calendar as cal
from tremor.operators import events as ev


def d(n):
    return date(2020, 1, n)


def test_forward_and_backward_asof(spark):
    right = spark.createDataFrame([("A", d(3), 1), ("A", d(7), 2)], "k string, date date, v int")
    left = spark.createDataFrame([("A", d(x)) for x in (1, 3, 4, 7, 9)], "k string, day date")
    fwd = {r.day.day: r.v for r in cal.asof_forward(left, right, ["k"], "day", "date").collect()}
    back = {r.day.day: r.v for r in cal.asof_backward(left, right, ["k"], "day", "date").collect()}
    assert fwd == {1: 1, 3: 1, 4: 2, 7: 2, 9: None}
    assert back == {1: None, 3: 1, 4: 1, 7: 2, 9: 2}


def test_nearest_prefers_the_earlier_on_ties(spark):
    right = spark.createDataFrame([("A", d(1)), ("A", d(11))], "k string, p date")
    left = spark.createDataFrame([("A", d(x)) for x in (2, 6, 9, 20)], "k string, day date")
    got = {r.day.day: r.gap for r in cal.nearest(left, right, ["k"], "day", "p", "gap").collect()}
    assert got == {2: -1, 6: -5, 9: 2, 20: -9}


def test_factor_accumulates_over_missing_days(spark):
    ses = spark.createDataFrame([("A", d(1)), ("A", d(2)), ("A", d(4))], "series_id string, date date")
    fac = spark.createDataFrame([(d(1), 0.01), (d(2), 0.02), (d(3), 0.03), (d(4), 0.04)], "date date, ret double")
    got = [r.factor_ret for r in cal.align_factor(ses, fac).orderBy("date").collect()]
    assert got[0] is None and got[1:] == pytest.approx([0.02, 0.07])


def test_splice_keeps_the_archive(spark):
    base = spark.createDataFrame([("A", d(1), 1.0, 5.0), ("A", d(2), 2.0, 6.0)], "k string, date date, close double, volume double")
    ext = spark.createDataFrame([("A", d(2), 9.0), ("A", d(3), 3.0)], "k string, date date, close double")
    got = [(r.date.day, r.close, r.volume) for r in cal.splice_after(base, ext, ["k"], "date").orderBy("date").collect()]
    assert got == [(1, 1.0, 5.0), (2, 2.0, 6.0), (3, 3.0, None)]


def test_overlap_breach_raises(spark):
    a = spark.createDataFrame([(d(1), 1.0)], "date date, a double")
    b = spark.createDataFrame([(d(1), 500.0)], "date date, b double")
    with pytest.raises(ValueError):
        cal.assert_overlap(cal.overlap_check(a, b, ["date"], "a", "b"), 100.0)


def test_study_end_breach_raises(spark):
    df = spark.createDataFrame([(d(9),)], "day date")
    cal.assert_within(df, "day", "2020-01-31")
    with pytest.raises(ValueError):
        cal.assert_within(df, "day", "2020-01-05")


def test_episodes_split_on_gaps(spark):
    e = spark.createDataFrame([(1, "A", date(2020, 1, 1)), (2, "A", date(2020, 1, 6)), (3, "A", date(2020, 1, 11)), (4, "A", date(2020, 2, 10))], "event_id long, s string, day date")
    got = {r.event_id: r.episode for r in ev.with_episodes(e, ["s"], "day").collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}


def test_inclusion_and_pooling(spark):
    e = spark.createDataFrame([("Flood", 2000.0), ("Flood", 3000.0), ("Flood", 1500.0), (" Epidemic", 9000.0), ("Cyclone", 900.0), ("Cyclone", None)], "type string, affected double")
    assert ev.included(e, "type", "affected", ["epidemic"], 1000).count() == 3
    pooled = ev.pooled_types(e.where("type != ' Epidemic'"), "type")
    assert {r.type for r in pooled.collect()} == {"Flood", "Other"}
