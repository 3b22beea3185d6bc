"""Registered queries against their SQL on the smallest data set."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import normal

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "q0_forward_outcomes", "j01_origin_session", "j02_snapshot_asof", "j10_competing_event", "e04_recovery_time", "e06_event_outcomes", "w06_rolling_volatility",
    "w10_episodes", "a10_sample_flow", "s08_html_rows", "s13_event_file_mapping", "c03_purge", "m01_a12_regression_metrics", "b02_paired_bootstrap", "d01_kaplan_meier",
    "d05_j20_harrell_c", "q12_shape", "j19_v04_all_pairs", "v04_date_sum_correlation", "v07_v09_event_study_table", "c08_all_columns", "c08_pair_report",
    "l06_l11_information_fits", "l06_l11_information_grid", "a13_information_stability",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    got = normal(queries()[name](spark, SF).toPandas())
    want = normal(duck.execute(oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_entry(spark):
    assert entry(spark).columns[0] == "event_id"
