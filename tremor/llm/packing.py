"""Operator 4: token ids packed into rows of equal length, by best-fit-decreasing.

A task encodes its texts, ends each with an end token and cuts it into pieces of ``WIDTH`` ids; the
full pieces are rows as they are. The shorter last pieces are gathered until ``POOL`` of them are
there and packed longest first: each goes into the open row with the least room that it fits, found
in a segment tree over capacities. Rows that are then less than ``FULL`` full give their pieces back
to the pool, until the partition ends. Nothing is shuffled, no key exists that could be hot, and a
task holds one pool; a lost task packs its own texts again. Which pieces share a row follows from
how the input is cut into partitions; that every id of every text is there once, in order, does not.

Defined results: null and empty texts are one end token; null ids and repeated rows are packed like
all others; an empty table gives no rows; other columns are not read. A row holds ids and positions
as little-endian unsigned 16-bit numbers, with zeros after the last token.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import map_batches, rows_of, table
from tremor.llm.registry import query

WIDTH = 2048
POOL = 8192
FULL = 0.98

PACKED = T.StructType([
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_starts", T.ArrayType(T.LongType())),
    T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
    T.StructField("ids", T.BinaryType()),
    T.StructField("positions", T.BinaryType()),
])


class Room:
    """Open rows by the room they have left: a segment tree over capacities 0 .. width."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the smallest room of at least ``least``, and that room; it is open no longer."""
        at = least + self.size
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of indices of pieces; pieces of one length keep their order."""
    room, rows = Room(width), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = room.take(lengths[k])
        if found is None:
            found = len(rows), width
            rows.append([])
        row, left = found
        rows[row].append(k)
        if left > lengths[k]:
            room.put(left - lengths[k], row)
    return rows


@cache
def encoder(path: str, pattern: str):
    """A byte-level encoding from a file of ranks, and its end token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, len(ranks)


def _row(pieces: list[tuple], width: int) -> tuple:
    """Columns of one packed row of pieces (doc_id, start, ids)."""
    ids, positions = np.zeros(width, "<u2"), np.zeros(width, "<u2")
    ends = [0]
    for _, _, x in pieces:
        at = ends[-1]
        ids[at : at + len(x)] = x
        positions[at : at + len(x)] = np.arange(len(x))
        ends.append(at + len(x))
    return [p[0] for p in pieces], [p[1] for p in pieces], ends, ids.tobytes(), positions.tobytes()


def _pack_batches(batches, path: str, pattern: str, width: int, pool_size: int):
    encode, end = encoder(path, pattern)
    pool: list[tuple] = []
    out: list[tuple] = []

    def packed(last: bool):
        nonlocal pool
        rows = best_fit_decreasing([len(p[2]) for p in pool], width)
        back = []
        for row in rows:
            pieces = [pool[k] for k in row]
            if last or sum(len(p[2]) for p in pieces) >= FULL * width:
                out.append(_row(pieces, width))
            else:
                back += pieces
        pool = back if len(back) < pool_size // 2 else []
        if back and not pool:  # pieces that fill no row: their rows go as they are
            for row in best_fit_decreasing([len(p[2]) for p in back], width):
                out.append(_row([back[k] for k in row], width))

    def flushed():
        while out:
            some = out[:1000]
            del out[:1000]
            yield rows_of(PACKED, list(map(list, zip(*some, strict=True))))

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.array([*encode(text.as_py() or ""), end], np.uint16)
            for at in range(0, len(ids), width):
                piece = i, at, ids[at : at + width]
                if len(piece[2]) == width:
                    out.append(_row([piece], width))
                else:
                    pool.append(piece)
            if len(pool) >= pool_size:
                packed(False)
            if len(out) >= 1000:
                yield from flushed()
    if pool:
        packed(True)
    yield from flushed()


def pack(docs: DataFrame, path: str, pattern: str, width: int = WIDTH, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``width`` ids: documents and starts of their segments, cumulative lengths, ids, positions that restart in each segment."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return map_batches(rows, _pack_batches, PACKED, path, pattern, width, pool)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet; one matrix row for each table row."""
    packed.write.mode("errorifexists").parquet(path)


def _digest(column):
    return F.sha2(column, 256)


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), *vocabulary())
    return packed.select("doc_ids", "doc_starts", "cu_seqlens", F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"), _digest(F.col("ids")).alias("ids_sha256"), _digest(F.col("positions")).alias("positions_sha256"))
