"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.session import stage

#: Runs of anything but blank and U+0009..U+000D, as the contracts count words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased: on bytes, split() and lower() know ASCII only."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def crc32_mod(col: str, n: int):
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def map_batches(df: DataFrame, fn, schema: T.StructType, *args) -> DataFrame:
    """``fn(batches, *args)`` over the Arrow batches of each partition.

    Workers go on to other tasks, so what Arrow keeps of a finished one is given back.
    """

    def run(batches):
        yield from fn(batches, *args)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def rows_of(schema: T.StructType, columns: list) -> pa.RecordBatch:
    """A record batch of ``schema`` from one list or array for each field."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected ``edges`` (a, b), component being the smallest node reachable.

    Large-star and small-star rounds (Kiveris et al.): every round is two aggregations and two
    equi-joins over the links, and their table in the shared folder cuts the lineage. A star
    around a hot node is collapsed by the partial minimum before the shuffle. Nodes without a
    link are not in the result.
    """
    spark = edges.sparkSession
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        links = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        links = stage(links, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
