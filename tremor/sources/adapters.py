"""Canonical inputs built from the supplied star-schema tables.

A series is one nation's daily market: close = average order price, volume = turnover.
An event is one urgent order; its series is the customer's nation. The factor is the
daily log return of the average line price and keeps its own calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.session import staged_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _located_orders(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("n_nationkey") == F.col("c_nationkey")
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, close, volume, session_idx), one row per series and trading day."""

    def build():
        daily = (
            _located_orders(spark, sf_dir)
            .groupBy(F.col("n_name").alias("series_id"), F.to_date("o_orderdate").alias("date"))
            .agg(
                F.round(F.avg("o_totalprice"), 6).alias("close"),
                F.round(F.sum("o_totalprice"), 2).alias("volume"),
            )
        )
        w = W.partitionBy("series_id").orderBy("date")
        return daily.withColumn("session_idx", F.row_number().over(w).cast("long"))

    return staged_once(spark, sf_dir, "sessions", build)


def shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, series_id, event_date, type, severity, affected)."""

    def build():
        return (
            _located_orders(spark, sf_dir)
            .where(F.col("o_orderpriority") == "1-URGENT")
            .select(
                F.col("o_orderkey").alias("event_id"),
                F.col("n_name").alias("series_id"),
                F.to_date("o_orderdate").alias("event_date"),
                F.col("c_mktsegment").alias("type"),
                F.col("o_totalprice").alias("severity"),
                F.col("c_acctbal").alias("affected"),
                F.col("o_orderstatus").alias("status"),
            )
        )

    return staged_once(spark, sf_dir, "shocks", build)


def factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ret): log return of the factor on its own calendar, one row per day."""

    def build():
        daily = (
            table(spark, sf_dir, "lineitem")
            .groupBy(F.to_date("l_shipdate").alias("date"))
            .agg(F.avg("l_extendedprice").alias("p"))
        )
        w = W.partitionBy(F.lit("factor")).orderBy("date")  # one row per calendar day
        return daily.select("date", F.log(F.col("p") / F.lag("p").over(w)).alias("ret"))

    return staged_once(spark, sf_dir, "factor", build)


SQL_SESS = """
panel AS (
  SELECT n_name AS series_id, CAST(o_orderdate AS DATE) AS date,
         round(avg(o_totalprice), 6) AS close, round(sum(o_totalprice), 2) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
  GROUP BY 1, 2),
sess AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) AS session_idx FROM panel)"""

SQL_SHOCKS = """
shocks AS (
  SELECT o_orderkey AS event_id, n_name AS series_id, CAST(o_orderdate AS DATE) AS event_date,
         c_mktsegment AS type, o_totalprice AS severity, c_acctbal AS affected,
         o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
  WHERE o_orderpriority = '1-URGENT')"""

SQL_FACTOR = """
factor AS (
  SELECT date, ln(p / lag(p) OVER (ORDER BY date)) AS ret
  FROM (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS p
        FROM lineitem GROUP BY 1))"""

# first session on or after each event date, per event
SQL_ORIGIN = """
origin AS (
  SELECT s.event_id, s.series_id, s.event_date, min(x.session_idx) AS session_idx
  FROM shocks s JOIN sess x ON x.series_id = s.series_id AND x.date >= s.event_date
  GROUP BY 1, 2, 3)"""
