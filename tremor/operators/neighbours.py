"""Exact nearest neighbour inside groups, in any number of columns, by pivots and boxes.

Points are dealt to the nearest of a few pivots (about the square root of the blocks), sorted by group,
pivot and distance, and taken up in chunks. A chunk is split at medians of its widest column into
blocks, each with the box of its points; date is a further column where a window in days applies, so
boxes are narrow in time as well. Inside a chunk every block visits the others in the order of the
lower bound between their boxes and stops at its worst distance so far. Chunks then meet only where
the bound between their boxes is within that distance, and of two chunks that meet, blocks and points
are passed over in the same way. Bounds never exceed a true distance, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.session import stage

# Fixed value: window in days for a comparable regime.
WINDOW_DAYS = 5 * 365.25
#: Points of a chunk and of a block at most, and pivots at most (they travel with the tasks).
CHUNK, BLOCK, PIVOTS = 16_384, 256, 4096
#: Part of a bound that rounding may take.
SLACK = 1e-12

BLOCKS = T.StructType([T.StructField(n, t) for n, t in (
    ("g", T.StringType()), ("chunk", T.StringType()), ("clow", T.ArrayType(T.DoubleType())), ("chigh", T.ArrayType(T.DoubleType())), ("cworst", T.DoubleType()),
    ("low", T.ArrayType(T.DoubleType())), ("high", T.ArrayType(T.DoubleType())), ("worst", T.DoubleType()),
    ("ids", T.BinaryType()), ("days", T.BinaryType()), ("xs", T.BinaryType()), ("best", T.BinaryType()), ("near", T.BinaryType()))])
FOUND = T.StructType([T.StructField("g", T.StringType()), T.StructField("id", T.LongType()), T.StructField("dist", T.DoubleType()), T.StructField("near", T.LongType())])

NOBODY = 2**63 - 1


def gap(low_a, high_a, low_b, high_b, n: int):
    """Squared distance of boxes over their first ``n`` columns; the last one, days, must come within a window of 1."""
    d = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    squares = (d[..., :n] ** 2).sum(-1) * (1 - SLACK)
    return np.where(d[..., n:].max(-1, initial=0) > 1 + SLACK, np.inf, squares)


class Block:
    """Points of one group: rows of columns and scaled day, with the best neighbour so far."""

    def __init__(self, ids, days, xs, best=None, near=None):
        self.ids, self.days, self.xs = ids, days, xs
        self.best = np.full(len(ids), np.inf) if best is None else best
        self.near = np.full(len(ids), NOBODY) if near is None else near

    def box(self, window: float | None):
        at = self.xs if window is None else np.c_[self.xs, self.days / window]
        return at.min(0), at.max(0)

    @property
    def worst(self) -> float:
        return float(self.best.max())

    def visit(self, other: Block, window: float | None) -> int:
        """Take nearer points of ``other``; returns the number of distances made."""
        n = self.xs.shape[1]
        at = self.xs if window is None else np.c_[self.xs, self.days / window]
        ask = np.flatnonzero(gap(at, at, *other.box(window), n) <= self.best)
        if not len(ask):
            return 0
        dist = np.zeros((len(ask), len(other.ids)))
        for c in range(n):  # one column after the other, so sums are the same in every block
            dist += (self.xs[ask, c, None] - other.xs[:, c]) ** 2
        if window is not None:
            dist[np.abs(self.days[ask, None] - other.days) > window] = np.inf
        dist[self.ids[ask, None] == other.ids] = np.inf
        low = dist.min(1)
        near = np.where((dist == low[:, None]) & np.isfinite(dist), other.ids, NOBODY).min(1)
        better = (low < self.best[ask]) | (low == self.best[ask]) & (near < self.near[ask]) & np.isfinite(low)
        self.best[ask[better]], self.near[ask[better]] = low[better], near[better]
        return dist.size


def split(at: np.ndarray, rows: np.ndarray, size: int):
    """Rows in parts of at most ``size``, cut at the median of the widest column."""
    if len(rows) <= size:
        yield rows
        return
    spread = at[rows].max(0) - at[rows].min(0)
    order = rows[np.argsort(at[rows, int(np.argmax(spread))], kind="stable")]
    yield from split(at, order[: len(order) // 2], size)
    yield from split(at, order[len(order) // 2 :], size)


def within_chunk(ids, days, xs, window: float | None, size: int) -> tuple[list[Block], int]:
    """Blocks of a chunk with exact neighbours inside it, and the distances made."""
    at = xs if window is None else np.c_[xs, days / window]
    blocks = [Block(ids[rows], days[rows], xs[rows]) for rows in split(at, np.arange(len(ids)), size)]
    low, high = (np.array(x) for x in zip(*(b.box(window) for b in blocks), strict=True))
    made = 0
    for k, b in enumerate(blocks):
        made += b.visit(b, window)
        bound = gap(low[k], high[k], low, high, xs.shape[1])
        for j in np.argsort(bound, kind="stable"):
            if bound[j] > b.worst or not np.isfinite(bound[j]):
                break
            if j != k:
                made += b.visit(blocks[j], window)
    return blocks, made


def _chunk_batches(batches, window, chunk: int, block: int):
    """Rows (g, cell, rep, day, x) in order to blocks; a chunk holds points of one group and cell."""
    held, key, made = [], None, 0

    def packed():
        ids, days, xs = (np.concatenate(c) for c in zip(*held, strict=True))
        blocks, _ = within_chunk(ids, days, xs, window, block)
        boxes = [b.box(window) for b in blocks]
        low, high = np.min([b[0] for b in boxes], 0), np.max([b[1] for b in boxes], 0)
        n, worst = len(blocks), max(b.worst for b in blocks)
        name = f"{int(ids.min())}|{key[1]}|{made}"
        columns = [[key[0]] * n, [name] * n, [low.tolist()] * n, [high.tolist()] * n, [worst] * n, [b[0].tolist() for b in boxes], [b[1].tolist() for b in boxes], [b.worst for b in blocks],
                   *([getattr(b, c).tobytes() for b in blocks] for c in ("ids", "days", "xs", "best", "near"))]
        yield _batch(BLOCKS, columns)

    for batch in batches:
        if not len(batch):
            continue
        g, cell = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ids, days = batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(np.int64)
        xs = batch.column(4).values.to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        start = 0
        while start < len(g):
            this = (g[start], cell[start])
            size = sum(len(h[0]) for h in held)
            if held and (this != key or size >= chunk):
                yield from packed()
                held, made, size = [], made + 1, 0
            key, end = this, start
            while end < len(g) and (g[end], cell[end]) == this and size + end - start < chunk:
                end += 1
            held.append((ids[start:end], days[start:end], xs[start:end]))
            start = end
    if held:
        yield from packed()


def _batch(schema: T.StructType, columns: list) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def _read(batch, at: int, r: int) -> Block:
    ids, days, xs, best, near = (batch.column(at + c)[r].as_py() for c in range(5))
    ids = np.frombuffer(ids, np.int64)
    return Block(ids, np.frombuffer(days, np.int64), np.frombuffer(xs, float).reshape(len(ids), -1), np.frombuffer(best, float).copy(), np.frombuffer(near, np.int64).copy())


def _own_batches(batches):
    for batch in batches:
        for r in range(len(batch)):
            b = _read(batch, 1, r)
            yield _batch(FOUND, [[batch.column(0)[r].as_py()] * len(b.ids), b.ids, b.best, b.near])


def _meet_batches(batches, window):
    """Block pairs of different chunks: points that have found somebody nearer."""
    for batch in batches:
        for r in range(len(batch)):
            a, b = _read(batch, 1, r), _read(batch, 6, r)
            before = a.near.copy()
            a.visit(b, window)
            new = a.near != before
            yield _batch(FOUND, [[batch.column(0)[r].as_py()] * int(new.sum()), a.ids[new], a.best[new], a.near[new]])


def _bound(a: str, b: str, n: int) -> Column:
    """Squared distance of two boxes given as arrays; null where a column beyond the first ``n``, the days, is out of the window."""
    high = "high" if not a.endswith("c") else "chigh"
    low = "low" if not a.endswith("c") else "clow"
    a, b = a.removesuffix("c"), b.removesuffix("c")
    apart = F.zip_with(F.zip_with(f"{a}.{low}", f"{b}.{high}", lambda x, y: x - y), F.zip_with(f"{b}.{low}", f"{a}.{high}", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    squares = F.aggregate(F.slice(apart, 1, n), F.lit(0.0), lambda s, x: s + x * x) * F.lit(1 - SLACK)
    return F.when(F.forall(F.slice(apart, n + 1, 1), lambda x: x <= 1 + SLACK), squares)


def _cells(points: DataFrame, n: int, dims: int) -> DataFrame:
    """Adds the nearest pivot as ``cell`` and the distance to it; pivots are points picked by hash."""
    wanted = min(PIVOTS, int(np.ceil(np.sqrt(n / BLOCK))))
    if n <= CHUNK or wanted < 2:
        return points.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("far"))
    picked = points.where(F.pmod(F.xxhash64(F.lit("pivot"), "rep"), F.lit(n)) < wanted).orderBy("rep").limit(2 * PIVOTS).select("x").collect()
    pivots = np.array([r.x for r in picked]).reshape(-1, dims)
    if len(pivots) < 2:
        return points.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("far"))
    schema = T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def dealt(batches):
        for batch in batches:
            x = batch.column(batch.schema.names.index("x")).values.to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            d = np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(np.sqrt(d.min(1)))], names=[f.name for f in schema])

    return points.mapInArrow(dealt, schema)


def nearest_points(points: DataFrame, window: float | None) -> DataFrame:
    """(g, id, near, dist): the nearest other point of the group, ties to the lowest id; squared distances.

    ``points`` is (g string, rep long, day int, x array<double> without nulls), rep distinct in a group. Points
    alone in their group or window are absent. An empty table gives none.
    """
    points = stage(points.select("g", "rep", F.col("day").cast("int").alias("day"), "x"), "points")
    n = points.count()
    if not n:
        return points.select("g", F.col("rep").alias("id"), F.col("rep").alias("near"), F.lit(0.0).alias("dist"))
    dims = len(points.select("x").first().x)
    parts = max(1, min(4096, n // (4 * CHUNK) + 8))
    placed = _cells(points, n, dims)
    placed = placed.repartitionByRange(parts, "g", "cell", "far").sortWithinPartitions("g", "cell", "far", "rep").select("g", "cell", "rep", "day", "x")
    chunk, block = CHUNK, BLOCK
    blocks = stage(placed.mapInArrow(lambda b: _chunk_batches(b, window, chunk, block), BLOCKS), "boxes")
    data = ["ids", "days", "xs", "best", "near"]
    own = blocks.select("g", *data).mapInArrow(_own_batches, FOUND)
    chunks = blocks.groupBy("g", "chunk").agg(F.first("clow").alias("clow"), F.first("chigh").alias("chigh"), F.first("cworst").alias("cworst"))
    a, b = chunks.alias("a"), chunks.alias("b")
    met = a.join(b, F.col("a.g") == F.col("b.g")).where((F.col("a.chunk") != F.col("b.chunk")) & (_bound("ac", "bc", dims) <= F.col("a.cworst")))
    met = met.select(F.col("a.g").alias("g"), F.col("a.chunk").alias("chunk"), F.col("b.chunk").alias("other"))
    left = blocks.join(met, ["g", "chunk"]).alias("a")
    right = blocks.withColumnRenamed("chunk", "other").alias("b")
    pairs = left.join(right, (F.col("a.g") == F.col("b.g")) & (F.col("a.other") == F.col("b.other"))).where(_bound("a", "b", dims) <= F.col("a.worst"))
    pairs = pairs.select(F.col("a.g").alias("g"), *(F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "ab" for c in data))
    found = own.unionByName(pairs.mapInArrow(lambda x: _meet_batches(x, window), FOUND))
    best = found.where(F.col("near") != NOBODY).groupBy("g", "id").agg(F.min(F.struct("dist", "near")).alias("_b"))
    return best.select("g", "id", F.col("_b.near").alias("near"), F.col("_b.dist").alias("dist"))


def nearest_in_group(rows: DataFrame, by: list[str], windowed: bool = True, columns: tuple[str, ...] = ("z1", "z2"), days: float = WINDOW_DAYS) -> DataFrame:
    """(by, event_id, neighbour): exact nearest row of the group by ``columns``, ties to the lowest id.

    Rows equal in all columns and the date are one point, so a hot value costs one row. Rows with a
    null column, or under a window a null date, take no part. Rows without a partner have none.
    """
    rows = rows.dropna(subset=[*columns, *(["event_date"] if windowed else [])]).select(*by, "event_id", "event_date", *columns)
    # read twice and joined on the columns: means and spreads summed anew in another order would differ in their last bits
    rows = stage(rows, "near-rows")
    points = stage(rows.groupBy(*by, F.col("event_date").alias("day"), *columns).agg(F.min("event_id").alias("rep"), F.count("*").alias("copies")), "points")
    points = points.withColumn("g", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    day = F.coalesce(F.datediff("day", F.lit("1970-01-01").cast("date")), F.lit(0))
    keyed = points.select("g", "rep", day.alias("day"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    found = nearest_points(keyed, days if windowed else None).select("g", F.col("id").alias("rep"), F.col("near").alias("neighbour"), "dist")
    # copies of a point are each other's nearest: lowest id, or the second lowest for the lowest itself
    same = [*by, "day", *columns]
    held = rows.select(*by, "event_id", F.col("event_date").alias("day"), *columns).alias("r").join(points.alias("p"), [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in same])
    held = held.select(*(F.col(f"r.{c}").alias(c) for c in [*by, "event_id"]), "p.g", "p.rep", "p.copies")
    second = held.where((F.col("copies") > 1) & (F.col("event_id") != F.col("rep"))).groupBy("g", "rep").agg(F.min("event_id").alias("_second"))
    j = held.join(second, ["g", "rep"], "left").join(found, ["g", "rep"], "left")
    twin = F.when(F.col("copies") > 1, F.when(F.col("event_id") == F.col("rep"), F.col("_second")).otherwise(F.col("rep")))
    # another point at distance zero with a lower id still comes first
    tied = (F.col("dist") == 0) & (F.col("neighbour") < twin)
    return j.select(*by, "event_id", F.when(twin.isNotNull() & ~F.coalesce(tied, F.lit(False)), twin).otherwise(F.col("neighbour")).alias("neighbour"))
