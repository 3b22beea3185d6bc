"""Operator 2: near-duplicate embeddings by lattice hashing.

In each of ``TABLES`` tables a vector is projected at random to ``E8`` times 8 numbers; every 8 are
decoded to nearby points of the E8 lattice, and the ``PROBES`` nearest combined points are the cells
that hold the vector. Two vectors that share a cell are compared by cosine in double precision. A
cell of more than ``CHUNK`` vectors is cut into chunks by hash and compared chunk against chunk in
separate groups. A pair that shares several cells counts only in the smallest of them, which both
vectors know; so a task emits sums of links and stars of what is connected, never the pairs. Equal
vectors are one class with a count. At cosine 0.95 a pair of 64 components is found with about
0.99, closer pairs with more; ``SIDE`` is the lattice's scale for unit vectors, to be made smaller
or joined by a third E8 block for much larger tables.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths never link; repeated rows link with each other and give one
row each, with the smallest id of their component; null ids are ignored as component ids unless
nothing else is there; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import components, map_batches, rows_of, stage, table
from tremor.llm.registry import query
from tremor.llm.simhash import stars

COSINE = 0.95
TABLES, E8, SIDE, PROBES = 6, 2, 1.6, 4
CHUNK = 512
SEED = 20

CELLS = T.StructType([T.StructField("cid", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType()))])
FOUND = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def nearest_points(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """E8 points near each row of (n, 8): doubled coordinates (n, 8 points, 8) and squared distances.

    E8 is D8 and D8 moved by a half. In each, rounding gives the nearest integer point; where its sum
    is odd, the coordinate that was nearest to a tie goes the other way. The other points flip the
    next coordinates, keeping the sum even.
    """
    points, distances, row = [], [], np.arange(len(y))
    for shift in (0.0, 0.5):
        z = y - shift
        near = np.rint(z)
        miss = z - near
        order = np.argsort(-np.abs(miss), axis=1, kind="stable")[:, :4]
        other = np.where(miss >= 0, 1.0, -1.0)
        odd = near.sum(1) % 2 != 0
        for one, even in (((0,), ()), ((1,), (0, 1)), ((2,), (0, 2)), ((3,), (1, 2))):
            p = near.copy()
            for flips, rows in ((one, odd), (even, ~odd)):
                for f in flips:
                    p[row, order[:, f]] += np.where(rows, other[row, order[:, f]], 0.0)
            points.append(2 * (p + shift))
            distances.append(((z - p) ** 2).sum(1))
    return np.stack(points, 1), np.stack(distances, 1)


def lattice_cells(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Sorted hashed cells (n, TABLES * PROBES) of unit vectors."""
    n, dim = unit.shape
    rng = np.random.default_rng(seed + dim)
    found = []
    for t in range(TABLES):
        y = np.einsum("nd,dk->nk", unit, rng.normal(size=(dim, 8 * E8))) / SIDE
        mixer = rng.integers(1, 2**63, (E8, 8), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        keys = np.full((n, 1), (t * 1000003 + dim + 1) & 0xFFFFFFFF, np.uint64)
        far = np.zeros((n, 1))
        for b in range(E8):
            points, d = nearest_points(y[:, 8 * b : 8 * b + 8])
            hashed = (points.astype(np.int64).astype(np.uint64) * mixer[b]).sum(2, dtype=np.uint64)
            hashed ^= hashed >> np.uint64(31)
            hashed *= np.uint64(0x9E3779B97F4A7C15)
            far = (far[:, :, None] + d[:, None, :]).reshape(n, -1)
            keys = (keys[:, :, None] * np.uint64(0xD6E8FEB86659FD93) + hashed[:, None, :]).reshape(n, -1)
            best = np.argsort(far, axis=1, kind="stable")[:, :PROBES]
            far, keys = np.take_along_axis(far, best, 1), np.take_along_axis(keys, best, 1)
        found.append(keys ^ keys >> np.uint64(29))
    return np.sort(np.concatenate(found, 1).view(np.int64), axis=1)


def _units(column, dim: int) -> np.ndarray:
    v = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


def _by_length(column) -> dict[int, np.ndarray]:
    n = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False))
    return {int(d): np.flatnonzero(n == d) for d in np.unique(n)}


def _cell_batches(batches):
    for batch in batches:
        for dim, rows in _by_length(batch.column(1)).items():
            cells = lattice_cells(_units(batch.column(1).take(rows), dim))
            yield rows_of(CELLS, [batch.column(0).take(rows), list(cells)])


def _linked(left, right=None):
    """Verified links of a block: (kind, a, b) rows; kind 0 adds b links to a, kind 1 joins a and b.

    A side is (ids, counts, units, cells, cell, chunk): own cells sorted, the cell that it stands in
    here, and which of the cell's groups this is.
    """
    own = right is None
    right = left if own else right
    close = left[2] @ right[2].T >= COSINE
    close &= (left[4][:, None] == right[4][None, :]) & (left[5][:, None] == right[5][None, :])
    a, b = np.nonzero(np.triu(close, 1) if own else close)
    if not len(a):
        return
    here, first = left[4][a], np.zeros(len(a), bool)
    for at in range(0, len(a), 4096):
        part = slice(at, at + 4096)
        both, other = left[3][a[part]], right[3][b[part]]
        shared = (both[:, :, None] == other[:, None, :]).any(2)
        first[part] = both[np.arange(len(both)), shared.argmax(1)] == here[part]  # sorted, so the first shared is the smallest
    ids = left[0] if own else np.concatenate([left[0], right[0]])
    more = np.zeros(len(ids), np.int64)
    moved = b if own else b + len(left[0])
    np.add.at(more, a[first], right[1][b[first]])
    np.add.at(more, moved[first], left[1][a[first]])
    some = more > 0
    node, where = np.unique(ids, return_inverse=True)
    m, r = stars(node, where[a], where[moved])
    kind = np.r_[np.zeros(some.sum(), np.int32), np.ones(len(m), np.int32)]
    yield rows_of(FOUND, [kind, np.r_[ids[some], m], np.r_[more[some], r]])


def _link_batches(batches):
    """Sorted rows (cell, i, j, c, cid, n, cells, vector) to links; small groups share a block."""
    held = None
    pool: list = []
    pooled = 0

    def groups(cols, starts, ends):
        nonlocal pool, pooled
        for s, e in zip(starts, ends, strict=True):
            side = [x[s:e] for x in cols[4:]] + [cols[0][s:e], cols[1][s:e]]
            if cols[1][s] != cols[2][s]:
                at_i = cols[3][s:e] == cols[1][s]
                yield from _linked([x[at_i] for x in side], [x[~at_i] for x in side])
                continue
            if pool and pool[0][2].shape[1] != side[2].shape[1]:
                yield from flush()
            pool.append(side)
            pooled += e - s
            if pooled >= CHUNK // 2:
                yield from flush()

    def flush():
        nonlocal pool, pooled
        if pool:
            block, pool, pooled = [np.concatenate(x) for x in zip(*pool, strict=True)], [], 0
            yield from _linked(block)

    def of(batch):
        flat = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]]
        cells = batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        for dim, rows in _by_length(batch.column(7)).items():
            yield dim, [x[rows] for x in flat] + [_units(batch.column(7).take(rows), dim), cells[rows]]

    for batch in batches:
        if not len(batch):
            continue
        for dim, (cell, i, j, c, cid, n, unit, cells) in of(batch):
            cols = [cell, i, j, c, cid, n, unit, cells]
            if held is not None and held[6].shape[1] != dim:
                yield from groups(held, [0], [len(held[0])])
                held = None
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            starts = np.r_[0, new]
            yield from groups(cols, starts[:-1].tolist(), starts[1:].tolist())
            held = [x[starts[-1] :] for x in cols]
    if held is not None:
        yield from groups(held, [0], [len(held[0])])
    yield from flush()


def usable(vector):
    """Whether a vector has a direction: no null or non-finite component, and not zero."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.col("vector")))
    key = F.xxhash64("vector")
    classes = rows.where("vector is not null").groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    classes = stage(classes.withColumn("key", key), "lattice-classes")
    # a class is named by a hash of its vector; where two vectors share one, by their order under it
    named = classes.groupBy("key").agg(F.count("*").alias("same"), F.min("vector").alias("low"))
    odd = named.where("same > 1").select("key", "low")
    classes = classes.join(odd, "key", "left").select("key", "vector", "n", "first_id", F.when(F.col("low").isNull() | (F.col("low") == F.col("vector")), F.col("key")).otherwise(F.xxhash64("vector", F.lit(1))).alias("cid"))
    classes = stage(classes, "lattice-named")
    cells = stage(map_batches(classes.select("cid", "vector"), _cell_batches, CELLS), "lattice-cells")
    spots = cells.select("cid", F.explode(F.array_distinct("cells")).alias("cell"))
    sizes = spots.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1")
    spots = spots.join(sizes, "cell").withColumn("k", F.ceil(F.col("m") / CHUNK).cast("int"))
    spots = spots.withColumn("c", F.pmod(F.xxhash64("cid", F.lit(7)), "k").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    full = spots.join(cells, "cid").join(classes.select("cid", "n", "vector"), "cid")
    full = full.select("cell", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "cid", "n", "vector", "cells")
    full = full.select("cell", "i", "j", "c", "cid", "n", "cells", "vector", F.size("vector").alias("dim"))
    # a task meets one length after the other, so that a group is never cut by rows of another length
    full = full.repartition("cell", "i", "j").sortWithinPartitions("dim", "cell", "i", "j").drop("dim")
    found = stage(map_batches(full, _link_batches, FOUND), "lattice-links")
    more = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("more")).withColumnRenamed("a", "cid")
    joined = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "cid")
    whole = classes.join(more, "cid", "left").join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = whole.groupBy("component").agg(F.min("first_id").alias("component_id"))
    whole = stage(whole.join(lowest, "component").select("key", F.col("vector").alias("v"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id"), "lattice-groups")
    keyed = rows.withColumn("hash", key)
    done = keyed.join(whole, (keyed["hash"] == whole["key"]) & (keyed["vector"] == whole["v"]), "left")
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
links AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id)) AS component_id,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id)) = e.vec_id AS kept
FROM embeddings e
"""


@query("op2_lattice_dedup", SQL)
def op2_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))
