"""Operator 10: near-duplicates by SimHash, with bit-sliced comparison of fingerprints.

Candidates: 64 bits are cut into ``BLOCKS`` blocks. Two fingerprints that differ in at most
``RADIUS`` bits agree in at least BLOCKS - RADIUS whole blocks, so every linked pair shares the
bits of some pair of blocks; each distinct fingerprint is put into one bucket for each pair.
Nothing is lost and equal fingerprints are one row. A bucket of more than ``CHUNK`` fingerprints
is cut into chunks by hash and compared chunk against chunk in separate groups, so that no task
holds a bucket. Comparison: the fingerprints of a chunk stand as vertical bit planes; each plane is
added into carry-save counters, one bit lane for each pair; rows are abandoned once all of their
lanes have overflowed the radius. A task emits only stars that join what is connected within its
block, never the pairs.

Defined results: a null or blank text has fingerprint zero; repeated rows and null ids give one row
each; a component of null ids only has a null id; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import components, map_batches, rows_of, stage, table, words
from tremor.llm.registry import query

SHINGLE = 3
SEED = 42
#: Linked at so many differing bits or fewer; one less than a power of two, so that counters overflow beyond it.
RADIUS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints compared in one block.
CHUNK = 1024

FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """SimHash of a text's word n-grams, as an unsigned number."""
    found = words(text)
    if not found:
        return 0
    joined = b" ".join(found)
    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    start = np.r_[0, end[:-1] + 1]
    n = min(n, len(found))
    digest = xxhash.xxh64_intdigest
    spans = zip(start[: len(found) - n + 1].tolist(), end[n - 1 :].tolist(), strict=True)
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(found) - n + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches):
    for batch in batches:
        fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64)
        yield rows_of(FINGERPRINTS, [batch.column(0), fps.view(np.int64)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), _fingerprint_batches, FINGERPRINTS)


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes (64 x words) of up to 64 * words fingerprints, one lane each."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((64, lanes), np.uint8)
    bits[:, : len(fps)] = (fps[None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def near(left: np.ndarray, right: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius: of ``left`` and ``right``, or i < j within ``left``."""
    own = right is None
    right = left if own else right
    planes, lanes = _planes(right), np.arange(-(-len(right) // 64) * 64)
    outside = lanes >= len(right)
    counters = radius.bit_length()
    found_a, found_b = [], []
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        row = np.arange(len(part))
        skip = (lanes[None, :] <= (at + row)[:, None]) | outside if own else np.broadcast_to(outside, (len(part), len(lanes)))
        over = np.packbits(skip, axis=1, bitorder="little").view(np.uint64)
        count = [np.zeros_like(over) for _ in range(counters)]
        flip = np.where(part[:, None] >> np.arange(64, dtype=np.uint64)[None, :] & np.uint64(1), np.uint64(2**64 - 1), np.uint64(0))
        for b in range(64):
            carry = planes[b][None, :] ^ flip[:, b : b + 1]
            for k, c in enumerate(count):
                count[k], carry = c ^ carry, c & carry
            over = over | carry
            if b % 8 == 7:
                live = (over != np.uint64(2**64 - 1)).any(1)
                if not live.all():
                    row, over, flip, count = row[live], over[live], flip[live], [c[live] for c in count]
                    if not len(row):
                        break
        if len(row):
            a, b = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
            found_a.append(at + row[a])
            found_b.append(b)
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) that connect what the index pairs (a, b) connect."""
    label = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    by_label = np.sort(ids)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            break
        label = new
    root = by_label[label]
    moved = root != ids
    return ids[moved], root[moved]


def _compare_batches(batches):
    """Sorted rows (key, i, j, c, fp) to star links; a pool of small groups is compared as one block."""
    pool: list[np.ndarray] = []
    pooled = 0
    held = None

    def links(left, right=None):
        ids = (left if right is None else np.concatenate([left, right])).view(np.int64)
        a, b = near(left, right)
        if not len(a):
            return
        m, r = stars(ids, a, b if right is None else b + len(left))
        yield rows_of(LINKS, [m, r])

    def groups(cols, starts, ends):
        nonlocal pool, pooled
        for s, e in zip(starts, ends, strict=True):
            fps, c, i = cols[4][s:e].view(np.uint64), cols[3][s:e], cols[1][s]
            if i != cols[2][s]:
                yield from links(fps[c == i], fps[c != i])
                continue
            pool.append(fps)
            pooled += len(fps)
            if pooled >= CHUNK // 2:
                yield from links(np.unique(np.concatenate(pool)))
                pool, pooled = [], 0

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        n = len(cols[0])
        if not n:
            continue
        new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
        starts = np.r_[0, new]
        yield from groups(cols, starts[:-1].tolist(), starts[1:].tolist())
        held = [x[starts[-1] :] for x in cols]
    if held is not None:
        yield from groups(held, [0], [len(held[0])])
    if pool:
        yield from links(np.unique(np.concatenate(pool)))


def near_links(classes: DataFrame) -> DataFrame:
    """Star links (a, b) between distinct fingerprints ``fp`` that connect all within the radius."""
    keep = len(BLOCKS) - RADIUS
    keys = []
    for t, chosen in enumerate(combinations(BLOCKS, keep)):
        key, shift = F.lit(t).cast("long"), 0
        for start, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1)))
            shift += width
        keys.append(key)
    rows = classes.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "key").withColumn("k", F.ceil(F.col("n") / CHUNK).cast("int"))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("fp"), "k").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "fp")
    return map_batches(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), _compare_batches, LINKS)


def near_components(sigs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of a table (doc_id, fp) that can be read more than once."""
    classes = sigs.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(near_links(classes.select("fp")))
    linked = classes.join(joined, classes.fp == joined.node)
    lowest = linked.groupBy("component").agg(F.min("first_id").alias("lowest"))
    linked = linked.join(lowest, "component").select(F.col("fp").alias("node"), "lowest")
    whole = stage(classes.join(linked, classes.fp == linked.node, "left").select("fp", F.when(F.col("node").isNull(), F.col("first_id")).otherwise(F.col("lowest")).alias("component_id")), "simhash-classes")
    return sigs.join(whole, "fp").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row."""
    found = near_components(stage(fingerprints(docs, id_col, text_col), "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def repeated_documents(docs: DataFrame) -> DataFrame:
    """Ids of the documents that are not the first of their group."""
    return simhash_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
