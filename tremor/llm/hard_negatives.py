"""Operator 12: hard negatives by length buckets and coordinate lists (Teflioudi et al., LEMP).

Candidates are dealt into buckets of ``BUCKET`` vectors that share labels and are alike in length. A
bucket carries the sorted list of every coordinate of its unit vectors. For an anchor and a score
range, a bucket whose longest vector can't reach the range is passed over; otherwise the range of
scores gives a range of angles, and that a feasible range of values for each of the ``FOCUS`` largest
coordinates of the anchor. The shortest of these ranges, found by binary search in the sorted lists,
is intersected with the others, and what remains is verified by its exact inner product. The range
narrows as a task goes from bucket to bucket: an anchor keeps its best so far, and the last of them
is its new lower end.

First the positives are searched among the rows of the anchor's label, then, in the window that their
scores give, the negatives among all others. Anchors travel in blocks, copied to one key for every
``SHARE`` buckets, so tasks follow the table; no side is broadcast, and only the best of a block and
key leave a task. Of equal vectors with one label only the first ``k + 1`` ids can be among the best,
so a hot vector is k + 1 candidates.

Defined results: rows with a null label or id, or with vectors that are null or hold null or
non-finite components take no part; an id that repeats counts once, with the label and vector that
sort first; missing components of shorter vectors are zero; ties go to the smaller id; anchors without
positives, or without rows in the window, have no rows; scores are exact below 2^56; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import map_batches, rows_of, stage, table
from tremor.llm.registry import query

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Percent of a positive's score that a negative has at least and at most.
LOW, HIGH = 30, 90
BUCKET, BLOCK, SHARE, FOCUS = 2048, 256, 8, 4
#: Slack of feasible ranges, far above the rounding of unit vectors.
SLACK = 1e-9

PACKED = T.StructType([T.StructField(n, t) for n, t in (("bucket", T.LongType()), ("low", T.LongType()), ("high", T.LongType()), ("longest", T.DoubleType()), ("ids", T.BinaryType()), ("labels", T.BinaryType()), ("cells", T.BinaryType()), ("lists", T.BinaryType()))])
ASKED = T.StructType([T.StructField(n, t) for n, t in (("block", T.LongType()), ("low", T.LongType()), ("high", T.LongType()), ("ids", T.BinaryType()), ("labels", T.BinaryType()), ("cells", T.BinaryType()), ("of", T.BinaryType()), ("of_scores", T.BinaryType()))])
FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor_id", "positive_id", "positive_score", "vec_id", "score")])

_NONE = -(2**62)


def labelled_vectors(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(vec_id, label, v): components as whole numbers, one row for each usable id."""
    big = F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x")).where("vec_id is not null and label is not null and x is not null")
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)))
    rows = rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")


def _matrix(rows: list) -> np.ndarray:
    cells = np.zeros((len(rows), max(1, max(map(len, rows)))), np.int64)
    for k, r in enumerate(rows):
        cells[k, : len(r)] = r
    return cells


def _units(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((cells.astype(float) ** 2).sum(1))
    return length, cells / np.where(length > 0, length, 1)[:, None]


def _chunks(batches, size: int):
    """Rows of all batches, ``size`` at a time."""
    held: list = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def _bucket_batches(batches):
    for rows in _chunks(batches, BUCKET):
        rows.sort(key=lambda r: r[1])
        ids, labels, cells = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), _matrix([r[2] for r in rows])
        length, unit = _units(cells)
        lists = np.argsort(unit, axis=0, kind="stable").T.astype(np.int16)
        yield rows_of(PACKED, [[int(ids[0])], [int(labels[0])], [int(labels[-1])], [float(length.max())], *([x.tobytes()] for x in (ids, labels, cells, lists))])


def _block_batches(batches):
    """Rows (vec_id, label, v, positives) to blocks; positives are structs (vec_id, score) or null."""
    for rows in _chunks(batches, BLOCK):
        ids, labels, cells = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), _matrix([r[2] for r in rows])
        most = max(1, max(len(r[3] or ()) for r in rows))
        of, scores = np.full((len(rows), most), _NONE), np.full((len(rows), most), _NONE)
        for k, r in enumerate(rows):
            for j, p in enumerate(r[3] or ()):
                of[k, j], scores[k, j] = p["vec_id"], p["score"]
        yield rows_of(ASKED, [[int(ids[0])], [int(labels.min())], [int(labels.max())], *([x.tobytes()] for x in (ids, labels, cells, of, scores))])


class Bucket:
    """Vectors alike in length, with the sorted list of each coordinate of their unit vectors."""

    def __init__(self, ids: bytes, labels: bytes, cells: bytes, lists: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.cells = np.frombuffer(cells, np.int64).reshape(len(self.ids), -1)
        self.lists = np.frombuffer(lists, np.int16).reshape(self.cells.shape[1], -1)
        length, self.unit = _units(self.cells)
        self.shortest, self.longest = float(length.min()), float(length.max())
        self.values = np.take_along_axis(self.unit.T, self.lists.astype(np.int64), 1)
        self.most = float(np.abs(self.cells).max(initial=0))

    def feasible(self, anchor: np.ndarray, length: float, low: float, high: float) -> np.ndarray | None:
        """Positions that can have an inner product in [low, high] with the anchor; None for all."""
        if length == 0:
            return None if low <= 0 <= high else np.zeros(0, np.int64)
        # the cosines that the range of scores leaves for vectors of the bucket's lengths
        ends = [v / (length * m) if m > 0 else math.copysign(math.inf, v) if v else 0.0 for v, m in ((low, self.longest if low > 0 else self.shortest), (high, self.shortest if high > 0 else self.longest))]
        if ends[0] > 1 + SLACK or ends[1] < -1 - SLACK:
            return np.zeros(0, np.int64)
        if self.shortest == 0:
            return None  # null vectors have no angle
        near, far = math.acos(max(-1.0, min(1.0, ends[1]))), math.acos(max(-1.0, min(1.0, ends[0])))
        unit = anchor / length
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        turn = np.arccos(np.clip(unit[focus], -1, 1))
        least = np.cos(np.minimum(np.pi, turn + far)) - SLACK
        most = np.cos(np.maximum(0, np.maximum(turn - far, near - turn))) + SLACK
        begin, end = (np.array([np.searchsorted(self.values[f], x, side) for f, x in zip(focus, bound, strict=True)]) for bound, side in ((least, "left"), (most, "right")))
        k = int(np.argmin(end - begin))
        rows = self.lists[focus[k], begin[k] : end[k]].astype(np.int64)
        for j, f in enumerate(focus):
            if j != k and end[j] - begin[j] < len(self.ids):
                value = self.unit[rows, f]
                rows = rows[(value >= least[j]) & (value <= most[j])]
        return rows

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(anchor).max(initial=0)) * len(anchor) < 2**53:
            return (self.cells[rows].astype(float) @ anchor.astype(float)).astype(np.int64)
        return self.cells[rows] @ anchor


class Best:
    """The best entries so far of every (anchor, positive) of a block, by score and smaller id."""

    def __init__(self, block: tuple, k: int, windows: tuple[int, int] | None):
        ids, labels, cells, of, scores = block
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.cells = np.frombuffer(cells, np.int64).reshape(len(self.ids), -1)
        self.of, self.of_scores = (np.frombuffer(x, np.int64).reshape(len(self.ids), -1) for x in (of, scores))
        self.length, self.k, self.same = _units(self.cells)[0], k, windows is None
        if windows is None:
            self.low, self.high = np.full(self.of.shape, _NONE), np.full(self.of.shape, 2**62)
        else:
            # -(-a // b) is a / b rounded up; a window without whole numbers is empty
            scores, none = np.where(self.of == _NONE, 0, self.of_scores), self.of == _NONE
            self.low, self.high = np.where(none, 1, -(-scores * windows[0] // 100)), np.where(none, 0, scores * windows[1] // 100)
        self.entries = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * self.of.shape[1] for _ in self.ids]

    def meet(self, bucket: Bucket) -> None:
        dim = min(self.cells.shape[1], bucket.cells.shape[1])
        for a, label in enumerate(self.labels):
            open_ = np.flatnonzero(self.low[a] <= self.high[a])
            if not len(open_):
                continue
            if self.same and not bucket.labels[0] <= label <= bucket.labels[-1] or not self.same and bucket.labels[0] == label == bucket.labels[-1]:
                continue
            low, high = int(self.low[a, open_].min()), int(self.high[a, open_].max())
            anchor = np.zeros(bucket.cells.shape[1], np.int64)
            anchor[:dim] = self.cells[a, :dim]
            rows = bucket.feasible(anchor, float(self.length[a]), low, high) if low > _NONE else None
            if rows is None:
                rows = np.arange(len(bucket.ids))
            rows = rows[(bucket.labels[rows] == label) == self.same]
            rows = rows[bucket.ids[rows] != self.ids[a]]
            if not len(rows):
                continue
            scores = bucket.scores(rows, anchor)
            for p in open_:
                fine = (scores >= self.low[a, p]) & (scores <= self.high[a, p])
                if not fine.any():
                    continue
                s, i = (np.r_[x, y] for x, y in zip(self.entries[a][p], (scores[fine], bucket.ids[rows[fine]]), strict=True))
                order = np.lexsort((i, -s))[: self.k]
                self.entries[a][p] = s[order], i[order]
                if len(order) == self.k:
                    self.low[a, p] = s[order[-1]]

    def rows(self):
        out = [(self.ids[a], self.of[a, p], self.of_scores[a, p], i, s) for a, each in enumerate(self.entries) for p, (ss, ii) in enumerate(each) for i, s in zip(ii.tolist(), ss.tolist(), strict=True)]
        if out:
            yield rows_of(FOUND, [list(c) for c in zip(*out, strict=True)])


def _search_batches(batches, k: int, windows: tuple[int, int] | None):
    """Blocks of anchors against buckets; a block that comes in a row with all its buckets keeps one state."""
    buckets: dict = {}
    held, best = None, None
    for batch in batches:
        for r in range(len(batch)):
            name = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
            if name != held:
                if best:
                    yield from best.rows()
                held, best = name, Best(tuple(batch.column(c)[r].as_py() for c in range(2, 7)), k, windows)
            key = (batch.column(7)[r].as_py(), batch.column(8)[r].as_py())
            if key not in buckets:
                while len(buckets) >= 2 * SHARE:
                    buckets.pop(next(iter(buckets)))
                buckets[key] = Bucket(*(batch.column(c)[r].as_py() for c in range(9, 13)))
            best.meet(buckets[key])
    if best:
        yield from best.rows()


def buckets_of(vectors: DataFrame, most_copies: int) -> DataFrame:
    """Buckets of all vectors, alike in label and length, with the key of their share."""
    same = W.partitionBy("label", "v").orderBy("vec_id")
    rows = vectors.withColumn("r", F.row_number().over(same)).where(F.col("r") <= most_copies)
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = rows.select("vec_id", "label", "v", length.alias("length"))
    parts = max(1, -(-vectors.count() // (4 * BUCKET)))
    dealt = rows.repartitionByRange(parts, "label", F.desc("length"), "vec_id").sortWithinPartitions("label", F.desc("length"), "vec_id")
    return stage(map_batches(dealt.select("vec_id", "label", "v"), _bucket_batches, PACKED), "negatives-buckets")


def search(anchors: DataFrame, buckets: DataFrame, k: int, windows: tuple[int, int] | None = None) -> DataFrame:
    """(anchor_id, positive_id, positive_score, rank, vec_id, score) of the best ``k`` of each anchor and positive.

    ``anchors`` is (vec_id, label, v, positives). Without ``windows`` the rows of the anchor's own label
    are ranked; with it the others, where their score is within these percents of the positive's.
    """
    shares = max(1, -(-buckets.count() // SHARE))
    blocks = map_batches(anchors.repartitionByRange(max(1, shares // 4), "label", "vec_id").sortWithinPartitions("label", "vec_id").select("vec_id", "label", "v", "positives"), _block_batches, ASKED)
    blocks = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).alias("a")
    keyed = buckets.withColumn("share", F.pmod(F.xxhash64("bucket", "low"), F.lit(shares)).cast("int")).alias("b")
    apart = F.col("a.high").between(F.col("b.low"), F.col("b.high")) | F.col("a.low").between(F.col("b.low"), F.col("b.high")) | F.col("b.low").between(F.col("a.low"), F.col("a.high"))
    # a merge join gives the buckets of a share block by block, so the state of one block is held
    met = blocks.hint("merge").join(keyed, (F.col("a.share") == F.col("b.share")) & (apart if windows is None else F.lit(True)))
    columns = ["a.share", "a.block", "a.ids", "a.labels", "a.cells", "a.of", "a.of_scores", "b.bucket", "b.low", "b.ids", "b.labels", "b.cells", "b.lists"]
    met = met.select(*(F.col(c).alias(c.replace(".", "_")) for c in columns))
    found = map_batches(met, _search_batches, FOUND, k, windows)
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    # a block that met a bucket twice gives an entry twice at most
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` is a table (vec_id, label, v) of whole numbers that can be read more than once,
    ``anchors`` holds the ids of the stated query set.
    """
    buckets = buckets_of(vectors, max(positives, negatives) + 1)
    asked = stage(vectors.join(anchors.select("vec_id").distinct(), "vec_id").select("vec_id", "label", "v"), "negatives-anchors")
    none = F.lit(None).cast("array<struct<vec_id:bigint,score:bigint>>")
    near = search(asked.withColumn("positives", none), buckets, positives)
    near = near.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives")).withColumnRenamed("anchor_id", "vec_id")
    asked = stage(asked.join(near, "vec_id").select("vec_id", "label", "v", "positives"), "negatives-asked")
    found = search(asked, buckets, negatives, (low, high))
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_inner_product(a.e, b.e) AS BIGINT) score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id positive_id, score positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id negative_id, positive_score, score negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = stage(labelled_vectors(table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding"), "negatives-vectors")
    return hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))
