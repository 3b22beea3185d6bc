"""Operator 8: removing repeated passages by a depth-limited radix sort of suffixes.

Every start of a ``LENGTH``-byte string is a suffix, and suffixes are ordered only as far as LENGTH
bytes. The most significant pass deals them out by content: the string's anchor, its ``GRAM``-byte
piece with the smallest hash, so equal strings always meet, and neighbouring suffixes with one
anchor travel as one run (about 35 suffixes in one row of five numbers). Inside an anchor's group,
runs that are equal over all their bytes are equal in all their suffixes and are settled at once;
groups that hold different runs are sorted on by passes over 8 bytes at a time, each of which drops
the suffixes that stand alone. What is equal after the last pass are exactly the repeated strings,
and all but the first by (doc_id, start) are removed.

Equal runs are known by 128 bits of hashes, everything else is compared byte by byte. Of equal runs
that a task reads together only the first goes to its anchor's group, the others are settled where
they are, so a passage that a third of the texts hold sends one row for each PART of text. Sorted rows
stream through the tasks, and no group is held except its runs with different bytes; groups of more
than ``MOST`` such runs (a phrase in ever new surroundings) are cut up into single suffixes, dealt
by a 128-bit hash of all their bytes and settled by partial minimums. Texts are shuffled twice: to fetch
the bytes of differing runs, and to be cut.

Where ids repeat, rows are numbered by (id, 64-bit hash of the text) first, the numbers take the place of
the ids, and each number is searched once; so no id, the null one included, gathers its rows anywhere.

Defined results: a null text counts as empty; null ids come last and are one id; rows that repeat an
id and a text are one document and get the same result; rows with one id and different texts are
documents of their own, ordered by that hash; an empty table gives an empty result; other columns are kept where
asked for and don't take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import map_batches, rows_of, stage, table
from tremor.llm.registry import query

LENGTH = 100
GRAM = 32
#: Windows that one anchor can stand for at most.
SPAN = LENGTH - GRAM + 1
#: Bytes of text handled at once in a task.
PART = 1 << 19
#: Different runs of one anchor that are sorted in one task.
MOST = 4096

RUNS = T.StructType([T.StructField(n, t) for n, t in (("h", T.LongType()), ("c", T.LongType()), ("id", T.LongType()), ("at", T.LongType()), ("nr", T.IntegerType()))])
SORTED = T.StructType([T.StructField(n, t) for n, t in (("repeat", T.BooleanType()), ("h", T.LongType()), ("id", T.LongType()), ("at", T.LongType()), ("nr", T.IntegerType()))])
BYTES = T.StructType([T.StructField(n, t) for n, t in (("h", T.LongType()), ("id", T.LongType()), ("at", T.LongType()), ("nr", T.IntegerType()), ("bytes", T.BinaryType()))])
REMOVED = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("at", T.LongType()), ("n", T.LongType()))])
WINDOWS = T.StructType([T.StructField(n, t) for n, t in (("d1", T.LongType()), ("d2", T.LongType()), ("id", T.LongType()), ("at", T.LongType()))])

NUMBERED = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "t", "number")])

_NO_ID = 2**63 - 1
_OUTSIDE = np.uint64(2**32 - 1)


def anchor_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first start, number of starts, anchor - first start, anchor hash) of all runs."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none, none, none, none, none
    h, n = buf.astype(np.uint64) + np.uint64(1), 1
    while n < GRAM:
        h = h[:-n] * np.uint64(pow(0x9E3779B97F4A7C15, n, 2**64)) + h[n:]
        n *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    low = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)  # ties go to the first
    n = 1
    while 2 * n <= SPAN:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < SPAN:
        low = np.minimum(low[: n - SPAN], low[SPAN - n :])
    anchor = low & np.uint64(0xFFFFFFFF)
    start = 0
    for end in ends[:-1].tolist():
        anchor[max(start, end - LENGTH + 1) : end] = _OUTSIDE
        start = end
    first = np.r_[0, np.flatnonzero(anchor[1:] != anchor[:-1]) + 1]
    n = np.diff(np.r_[first, len(anchor)])
    inside = anchor[first] != _OUTSIDE
    first, n = first[inside], n[inside]
    at = anchor[first].astype(np.int64)
    text = np.searchsorted(ends, first, "right")
    return text, first - np.r_[0, ends][text], n, at - first, h[at].view(np.int64)


def _pieces(rows):
    """(ids, offsets, pieces): about PART bytes of whole texts; longer texts in pieces that overlap by LENGTH - 1."""
    some: list = []
    size = 0
    for i, base, text in rows:
        for at in range(0, max(1, len(text) - LENGTH + 1), PART):
            piece = text[at : at + PART + LENGTH - 1]
            some.append((i, base + at, piece))
            size += len(piece)
            if size >= PART:
                yield zip(*some, strict=True)
                some, size = [], 0
    if some:
        yield zip(*some, strict=True)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _spread(i: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = (i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ h >> np.uint64(32)).view(np.int64)


def _run_batches(batches):
    """Runs of the texts; a run that another one handled with it equals and precedes has its ``nr`` negative."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows = ((i, 0, _raw(t.as_py())) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for ids, offsets, texts in _pieces(rows):
            text, at, n, rel, h = anchor_runs(list(texts))
            nr = n << 8 | rel
            c = np.fromiter((digest(texts[t][a : a + m + LENGTH - 1], s) for t, a, m, s in zip(text.tolist(), at.tolist(), n.tolist(), nr.tolist(), strict=True)), np.uint64, len(text))
            c, i, at = c.view(np.int64), np.array(ids, np.int64)[text], at + np.array(offsets, np.int64)[text]
            order = np.lexsort((at, i, c, h))
            h, c, i, at, nr = (x[order] for x in (h, c, i, at, nr))
            new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])][: len(h)]
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            again = (i != i[first]) | (at != at[first])
            # settled here: they need no group, so their own place deals them out
            yield rows_of(RUNS, [np.where(again, _spread(i, at), h), np.where(again, 0, c), i, at, np.where(again, -nr, nr)])


def _settle_batches(batches):
    """Runs sorted by (h, c, id, at): repeats of equal runs, and the first runs of groups with different ones."""
    last = None  # the latest row's h and c, and its class' first id and at
    open_ = None  # the latest first run: h, id, at, nr, whether the one before had its h
    for batch in batches:
        columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        settled = columns[4] < 0
        if settled.any():
            done = [x[settled] for x in columns]
            yield rows_of(SORTED, [np.ones(len(done[0]), bool), done[0], done[2], done[3], -done[4]])
        h, c, i, at, nr = (x[~settled] for x in columns)
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first_i, first_at = i, at
        if last is not None:
            new[0] = (h[0], c[0]) != last[:2]
        where = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        held = where < 0
        first_i = np.where(held, last[2] if last else 0, i[where])
        first_at = np.where(held, last[3] if last else 0, at[where])
        last = h[-1], c[-1], first_i[-1], first_at[-1]
        again = ~new & ((i != first_i) | (at != first_at))
        f = np.flatnonzero(new)
        fh, rows = h[f], [h[f], i[f], at[f], nr[f]]
        before = np.zeros(len(f), bool)
        before[1:] = fh[1:] == fh[:-1]
        if open_ is not None:
            if len(f):
                before[0] = fh[0] == open_[0]
            rows = [np.r_[[o], x] for o, x in zip(open_[:4], rows, strict=True)]
            before = np.r_[[open_[4]], before]
        out = [np.zeros(0, np.int64)] * 4
        if len(before):
            open_ = (*(x[-1] for x in rows), before[-1])
            mixed = before[:-1] | before[1:]
            out = [x[:-1][mixed] for x in rows]
        n = int(again.sum())
        yield rows_of(SORTED, [np.r_[np.ones(n, bool), np.zeros(len(out[0]), bool)], *(np.r_[x[again], y] for x, y in zip((h, i, at, nr), out, strict=True))])
    if open_ is not None and open_[4]:
        yield rows_of(SORTED, [[False], *([x] for x in open_[:4])])


def _fetch_batches(batches, often: bool):
    """Rows (id, text, runs) to the bytes of the runs."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        size = 0
        for i, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = _raw(text.as_py())
            for r in runs.as_py() or ():
                if r["often"] is not often:
                    continue
                piece = raw[r["at"] : r["at"] + (r["nr"] >> 8) + LENGTH - 1]
                for x, v in zip(out, (r["h"], i, r["at"], r["nr"], piece), strict=True):
                    x.append(v)
                size += len(piece)
            if size > 4 * PART:
                yield rows_of(BYTES, out)
                out, size = [[], [], [], [], []], 0
        yield rows_of(BYTES, out)


def repeated_windows(group: np.ndarray, ids: np.ndarray, at: np.ndarray, nr: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(run, window) of all windows that an earlier window of the same group equals.

    Radix passes: windows start in buckets by group and distance from the anchor, each pass splits
    the buckets by 8 more bytes, outer bytes first, and buckets of one are dropped.
    """
    n = nr >> 8
    run = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    at_byte = (np.cumsum(lengths) - lengths)[run] + j
    bucket = group[run].astype(np.int64) << 8 | ((nr & 255)[run] - j)
    eight = np.lib.stride_tricks.sliding_window_view(buf, 8)
    alive = np.arange(len(run))

    def split(digit):
        nonlocal alive, bucket
        order = np.lexsort((bucket,)) if digit is None else np.lexsort((digit, bucket))
        b = bucket[order]
        new = np.ones(len(b), bool)
        new[1:] = b[1:] != b[:-1]
        if digit is not None:
            d = digit[order]
            new[1:] |= d[1:] != d[:-1]
        alone = new & np.r_[new[1:], True]
        keep = ~alone
        alive, bucket = alive[order][keep], np.cumsum(new)[keep]

    split(None)
    depths = sorted(range(0, LENGTH - 7, 8), key=lambda d: min(d, LENGTH - 8 - d)) + [LENGTH - 8]
    for d in depths[-1:] + depths[:-1]:
        if not len(alive):
            break
        split(np.ascontiguousarray(eight[at_byte[alive] + d]).view(np.uint64).ravel())
    start = at[run[alive]] + j[alive]
    order = np.lexsort((start, ids[run[alive]], bucket))
    alive, bucket, start = alive[order], bucket[order], start[order]
    new = np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    who = ids[run[alive]]
    later = (who != who[first]) | (start != start[first])
    return run[alive[later]], j[alive[later]]


def _sort_batches(batches):
    """Differing runs sorted by h to removed windows; whole groups are pooled into blocks."""
    held: list = []
    size = 0

    def settle(cols):
        h, ids, at, nr, texts = cols
        run, j = repeated_windows(np.cumsum(np.r_[0, h[1:] != h[:-1]]), ids, at, nr, texts)
        if len(run):
            order = np.lexsort((j, run))
            run, j = run[order], j[order]
            first = np.r_[0, np.flatnonzero((run[1:] != run[:-1]) | (j[1:] != j[:-1] + 1)) + 1]
            yield rows_of(REMOVED, [ids[run[first]], at[run[first]] + j[first], np.diff(np.r_[first, len(run)])])

    for batch in batches:
        if not len(batch):
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]] + [batch.column(4).to_pylist()]
        held = [np.r_[a, b] for a, b in zip(held[:4], cols[:4], strict=True)] + [held[4] + cols[4]] if held else cols
        size = len(held[0])
        h = held[0]
        new = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1]
        done = 0
        for e in new[1:].tolist():
            if e - done >= 2048:
                yield from settle([x[done:e] for x in held])
                done = e
        held = [x[done:] for x in held]
        size = len(held[0])
    if size:
        yield from settle(held)


def _window_batches(batches):
    """Single suffixes of runs (h, id, at, nr, bytes) under a hash of all their bytes."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for i, at, nr, raw in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            d = np.frombuffer(b"".join(digest(raw[k : k + LENGTH]) for k in range(nr >> 8)), np.int64).reshape(-1, 2)
            yield rows_of(WINDOWS, [d[:, 0].copy(), d[:, 1].copy(), np.full(len(d), i), at + np.arange(len(d))])


def spans(runs: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal byte spans that removed windows (at, n) cover."""
    out: list[tuple[int, int]] = []
    for at, n in sorted((r["at"], r["n"]) for r in runs or ()):
        end = at + n - 1 + LENGTH
        if out and at <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((at, end))
    return out


def cut(text: str | None, runs: list[dict] | None) -> tuple[bytes, int, int]:
    """The bytes that are left, how many were removed and in how many spans."""
    raw = _raw(text)
    gone = spans(runs)
    left, at = [], 0
    for a, b in gone:
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    kept = b"".join(left)
    return kept, len(raw) - len(kept), len(gone)


def _number_batches(batches):
    """Sorted (id, t) to numbers in that order; partitions hold ascending ranges."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        yield rows_of(NUMBERED, [batch.column(0), batch.column(1), np.arange(number, number + len(batch))])
        number += len(batch)


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (id, row) with the number of (id, text) for the id, in a table that can be read more than once."""
    rows = rows.withColumn("t", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    pairs = rows.select("id", "t").distinct().repartitionByRange("id", "t").sortWithinPartitions("id", "t")
    numbers = stage(map_batches(pairs, _number_batches, NUMBERED), "repeats-numbers")
    return stage(rows.join(numbers, ["id", "t"]).select(F.col("number").alias("id"), "row"), "repeats-rows")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, runs) of each row: row holds the text, the id and a struct of the columns ``keep``, runs the removed windows."""
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id")
    kept = F.struct(*keep) if keep else F.lit(0)
    rows = docs.select(ident, F.struct(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"), kept.alias("keep")).alias("row"))
    texts = rows
    if docs.select(ident).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").take(1):
        rows = _numbered(rows)
        texts = rows.dropDuplicates(["id"])
    texts = texts.select("id", F.col("row.text").alias("text"))
    runs = map_batches(texts, _run_batches, RUNS)
    settled = stage(map_batches(runs.repartition("h").sortWithinPartitions("h", "c", "id", "at"), _settle_batches, SORTED), "repeats-settled")
    whole = settled.where("repeat").select("id", "at", F.shiftright("nr", 8).cast("long").alias("n"))
    mixed = settled.where("not repeat")
    often = mixed.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > MOST)
    mixed = mixed.join(often, "h", "left").withColumn("often", F.col("k").isNotNull())
    per_doc = mixed.groupBy("id").agg(F.collect_list(F.struct("h", "at", "nr", "often")).alias("runs"))
    fetched = texts.join(per_doc, "id").select("id", "text", "runs")
    some = map_batches(fetched, _fetch_batches, BYTES, False)
    sorted_out = map_batches(some.repartition("h").sortWithinPartitions("h"), _sort_batches, REMOVED)
    single = map_batches(map_batches(fetched, _fetch_batches, BYTES, True), _window_batches, WINDOWS)
    first = single.groupBy("d1", "d2").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("m")).where("m > 1")
    singles_out = single.join(first, ["d1", "d2"]).where((F.col("id") != F.col("first.id")) | (F.col("at") != F.col("first.at"))).select("id", "at", F.lit(1).cast("long").alias("n"))
    removed = whole.unionByName(sorted_out).unionByName(singles_out)
    return rows.join(removed.groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("runs")), "id", "left").select("row", "runs")


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def _digest_batches(batches):
    for batch in batches:
        found = []
        row = batch.column(0)
        for text, runs in zip(row.field(0), batch.column(1), strict=True):
            kept, removed, n = cut(text.as_py(), runs.as_py())
            found.append((len(kept) + removed, removed, n, hashlib.sha256(kept).hexdigest()))
        yield rows_of(RESULT, [row.field(1), *map(list, zip(*found, strict=True))] if found else [[]] * 5)


def _text_batches(batches, schema: T.StructType, text_at: int):
    for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
        row = batch.column(0)
        texts = []
        for text, runs in zip(row.field(0), batch.column(1), strict=True):
            t, r = text.as_py(), runs.as_py()
            texts.append(cut(t, r)[0].decode("utf-8", "ignore") if r else t)
        kept = row.field(2)
        cols = [kept.field(k) for k in range(kept.type.num_fields)] if len(schema) > 1 else []
        cols.insert(text_at, pa.array(texts, pa.string()))
        yield rows_of(schema, cols)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    return map_batches(marked(docs), _digest_batches, RESULT)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left of each text; a character that a cut divides goes too, and n_chars follows."""
    keep = [c for c in docs.columns if c != "text"]
    left = map_batches(marked(docs, keep=keep), _text_batches, docs.schema, docs.schema, docs.columns.index("text"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in keep else left


@query("op8_repeats")
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
