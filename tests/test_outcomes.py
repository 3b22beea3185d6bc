"""Protocol worked examples and recovery edge cases, as literal series."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tremor.operators import outcomes as oc
from tremor.operators.calendar import event_days

D0 = date(2020, 1, 1)


def series(spark, closes, volumes=None, name="A"):
    volumes = volumes or [1000.0] * len(closes)
    rows = [(name, D0 + timedelta(days=i), float(c), float(v), i + 1) for i, (c, v) in enumerate(zip(closes, volumes))]
    return spark.createDataFrame(rows, "series_id string, date date, close double, volume double, session_idx long")


def events(spark, offsets, name="A"):
    rows = [(i, name, D0 + timedelta(days=o)) for i, o in enumerate(offsets)]
    return spark.createDataFrame(rows, "event_id long, series_id string, event_date date")


def outcome(spark, closes, offsets=(30,), volumes=None):
    rows = oc.event_outcomes(events(spark, offsets), series(spark, closes, volumes)).orderBy("event_id").collect()
    return rows


def test_forward_return_and_label_end(spark):
    r = outcome(spark, [10000] * 30 + [9900, 9880, 9860, 9840, 9700])[0]
    assert r.y1_5 == pytest.approx(-3.0459, abs=1e-4)
    assert r.y1_5_end == D0 + timedelta(days=34)
    assert r.y1_10 is None and r.y1_10_end is None


def test_abnormal_volume(spark):
    vol = [20e6] * 30 + [30e6] * 5 + [20e6] * 10
    r = outcome(spark, [100.0] * 45, volumes=vol)[0]
    assert r.y2_5 == pytest.approx(math.log(1.5))
    assert r.y2_5_pct == pytest.approx(50.0)


def test_short_baseline_is_missing_not_truncated(spark):
    r = outcome(spark, [100.0] * 45, offsets=(29,))[0]
    assert r.y2_5 is None and r.v_base is None


@pytest.mark.parametrize(
    "tail, expect",
    [
        ([9900, 9850, 9800, 9750, 9700, 9650, 9700, 9750, 9800, 9850, 9900, 10020], (12.0, 1, "recovered", True)),
        ([10100] * 10, (0.0, 0, "no_drawdown", False)),
        ([9500] * 100, (90.0, 0, "90_day_cap", True)),
        ([9500, 10100, 9000], (2.0, 1, "recovered", True)),
    ],
)
def test_recovery_paths(spark, tail, expect):
    r = outcome(spark, [10000] * 30 + tail)[0]
    assert (r.duration, r.event_observed, r.reason, r.drawdown) == expect


def test_next_event_censors_and_same_session_counts_one(spark):
    closes = [10000] * 30 + [9500] * 20 + [10100] * 60
    a, b = outcome(spark, closes, offsets=(30, 39))
    assert (a.t_next, a.duration, a.reason) == (10, 10.0, "next_disaster")
    assert b.t_next is None and b.reason == "no_drawdown"  # its own P0 is already the low
    first, second = outcome(spark, closes, offsets=(30, 30))
    assert first.t_next == 1 and second.t_next is None


def test_no_recovery_at_the_cap_reports_the_cap(spark):
    # recovery at session 91 lies outside the scan, next event exactly at the cap
    closes = [10000] * 30 + [9500] * 90 + [10100] * 5
    a, _ = outcome(spark, closes, offsets=(30, 119))
    assert a.t_next == 90 and (a.duration, a.reason) == (90.0, "90_day_cap")


def test_unaligned_events_drop(spark):
    rows = outcome(spark, [100.0] * 40, offsets=(0, 35, 60))
    assert [r.event_id for r in rows] == [1]


def test_rows_after_the_windows_do_not_change_the_past(spark):
    closes = [100 + i % 7 for i in range(200)]
    bumped = closes[:150] + [999] * 50
    cols = ["y1_5", "y2_5"]
    a = outcome(spark, closes, offsets=(100,))[0]
    b = outcome(spark, bumped, offsets=(100,))[0]
    assert [a[c] for c in cols] == [b[c] for c in cols]


def test_hot_day_gives_same_outcome_to_every_event(spark):
    closes = [10000] * 30 + [9900] * 20
    rows = outcome(spark, closes, offsets=[30] * 50 + [31])
    assert len(rows) == 51 and len({r.y1_5 for r in rows[:50]}) == 1
    assert all(r.t_next == 1 for r in rows[:49]) and rows[49].t_next == 2
    days = event_days(events(spark, [30] * 50 + [31]), series(spark, closes))
    assert days.count() == 2 and days.agg(F.sum("n_events")).first()[0] == 51
