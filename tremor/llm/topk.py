"""Operator 7: exact top-k by inner product, with a three-phase uniform threshold.

A vector's components are dealt to ``NODES`` nodes; a score is the sum of the nodes' partial scores.
Phase 1: every node gives its best k entries of each query; the exact scores of those name the k-th
best so far, a safe cutoff. Phase 2: the cutoff goes out with the queries, and every node gives the
entries with at least cutoff / NODES: an entry below that on every node can't reach the cutoff.
Phase 3: those entries are resolved exactly, in the block where their other partial scores lie, and
only what reaches the cutoff is shuffled and ranked. The stated query set meets all candidates in blocks: ``QBLOCK`` queries
and ``CBLOCK`` candidates packed into one row each, query blocks copied to ``SLOTS`` keys and joined
on the key, so no side is broadcast and no pair of rows is made outside numpy. Of equal vectors only
the k + 1 smallest ids can be among the best, so a hot vector is k + 1 candidates.

Defined results: vectors that are null or hold null or non-finite components, and null ids, take no
part; an id that repeats counts once, with the vector that sorts first; missing components of shorter
vectors are zero; ties go to the smaller id; scores are exact below 2^53; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import map_batches, rows_of, stage, table
from tremor.llm.registry import query

SCALE = 256
NODES = 2
QBLOCK, CBLOCK, SLOTS = 512, 4096, 16

BLOCK = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("cells", T.BinaryType()), T.StructField("cut", T.BinaryType())])
ENTRY = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("node", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("part", T.LongType())])


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): components as whole numbers, one row for each usable id."""
    big = F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _pack_batches(batches, size: int):
    """Rows (id, vector, cutoff) to blocks of ``size``."""
    held: list = []

    def block(rows):
        ids = np.array([r[0] for r in rows], np.int64)
        dim = max(len(r[1]) for r in rows)
        cells = np.zeros((len(rows), dim), np.int64)
        for k, r in enumerate(rows):
            cells[k, : len(r[1])] = r[1]
        cut = np.array([r[2] for r in rows], np.int64)
        return rows_of(BLOCK, [[int(ids[0] % SLOTS)], [len(rows)], [ids.tobytes()], [cells.tobytes()], [cut.tobytes()]])

    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        while len(held) >= size:
            yield block(held[:size])
            held = held[size:]
    if held:
        yield block(held)


def _blocks(rows: DataFrame, size: int, cut: Column) -> DataFrame:
    return map_batches(rows.select("vec_id", "v", cut.cast("long")), _pack_batches, BLOCK, size)


def _unpack(n, ids, cells):
    return np.frombuffer(ids, np.int64), np.frombuffer(cells, np.int64).reshape(n, -1)


def _partials(batches):
    """For each joined pair of blocks: query ids, cutoffs, candidate ids, and each node's partial scores."""
    for batch in batches:
        for k in range(len(batch)):
            qn, qi, qv, qc, cn, ci, cv = (c[k].as_py() for c in batch.columns)
            qi, qv = _unpack(qn, qi, qv)
            ci, cv = _unpack(cn, ci, cv)
            dim = min(qv.shape[1], cv.shape[1])
            cut = np.frombuffer(qc, np.int64)
            parts = []
            for node in range(NODES):
                a, b = qv[:, node:dim:NODES], cv[:, node:dim:NODES]
                if np.abs(a).max(initial=0) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**53:
                    parts.append((a.astype(float) @ b.astype(float).T).astype(np.int64))
                else:
                    parts.append(a @ b.T)
            yield qi, cut, ci, parts


def _best_batches(batches, k: int):
    """Phase 1: each node's best k entries of each query in a block, not counting the query itself."""
    for qi, _, ci, parts in _partials(batches):
        for node, part in enumerate(parts):
            part[qi[:, None] == ci[None, :]] = np.iinfo(np.int64).min
            most = min(k, len(ci))
            best = np.argpartition(-part, most - 1, axis=1)[:, :most]
            rows, cols = np.repeat(np.arange(len(qi)), most), best.ravel()
            fine = qi[rows] != ci[cols]
            rows, cols = rows[fine], cols[fine]
            yield rows_of(ENTRY, [qi[rows], np.full(len(rows), node), ci[cols], part[rows, cols]])


def _enough_batches(batches):
    """Phases 2 and 3: entries that have cutoff / NODES on some node, resolved where their block lies.

    All nodes' components of a block are at hand in its task, so what is missing of an entry is added
    there, and only entries whose exact score reaches the cutoff leave it.
    """
    for qi, cut, ci, parts in _partials(batches):
        share = np.ceil(cut / NODES).astype(np.int64)[:, None]
        enough = parts[0] >= share
        for part in parts[1:]:
            enough |= part >= share
        rows, cols = np.nonzero(enough & (qi[:, None] != ci[None, :]))
        for at in range(0, len(rows), 100_000):
            r, c = rows[at : at + 100_000], cols[at : at + 100_000]
            score = sum(part[r, c] for part in parts)
            fine = score >= cut[r]
            yield rows_of(ENTRY, [qi[r[fine]], np.full(int(fine.sum()), -1), ci[c[fine]], score[fine]])


def _met(queries: DataFrame, candidates: DataFrame, fn, *args) -> DataFrame:
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"), F.col("n").alias("qn"), F.col("ids").alias("qi"), F.col("cells").alias("qv"), F.col("cut").alias("qc"))
    pairs = q.join(candidates, "slot").select("qn", "qi", "qv", "qc", "n", "ids", "cells")
    return map_batches(pairs, fn, ENTRY, *args)


def _resolve(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Exact scores of (query_id, vec_id)."""
    q = vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    each = F.zip_with("qv", "v", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long")))
    return pairs.join(q, "query_id").join(vectors, "vec_id").select("query_id", "vec_id", F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query.

    ``vectors`` is a table (vec_id, v) of whole numbers that can be read more than once, ``queries``
    holds the ids of the stated query set.
    """
    same = W.partitionBy("v").orderBy("vec_id")
    candidates = vectors.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("vec_id", "v")
    blocks = stage(_blocks(candidates, CBLOCK, F.lit(0)), "topk-candidates")
    asked = stage(vectors.join(queries.select("vec_id").distinct(), "vec_id").select("vec_id", "v"), "topk-queries")

    first = _met(_blocks(asked, QBLOCK, F.lit(0)), blocks, _best_batches, k)
    node_best = first.withColumn("r", F.row_number().over(W.partitionBy("query_id", "node").orderBy(F.desc("part"), "vec_id"))).where(F.col("r") <= k)
    lower = _ranked(_resolve(node_best.select("query_id", "vec_id").distinct(), vectors), k)
    cut = lower.groupBy("query_id").agg(F.max("rank").alias("n"), F.min("score").alias("cut")).where(F.col("n") == k)
    # without k entries so far there is no cutoff, and few candidates: all are collected
    cut = stage(asked.join(cut.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", F.coalesce("cut", F.lit(-(2**62)))), "topk-cut")
    cut = cut.toDF("vec_id", "v", "cut")

    enough = _met(_blocks(cut, QBLOCK, F.col("cut")), blocks, _enough_batches)
    found = _ranked(enough.select("query_id", "vec_id", F.col("part").alias("score")), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id query_id, b.vec_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


@query("op7_topk", SQL)
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stage(whole_vectors(table(spark, sf_dir, "embeddings")), "topk-vectors")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))
