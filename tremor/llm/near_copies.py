"""Operator 10 for whole passages: documents that share four fifths of their five-word shingles.

Similarity is the Jaccard index of the sets of XXH64 hashes of five-word shingles, exact, 0.8 or more.
Each set gets a SimHash of ``WIDTH`` bits. At a similarity of 0.8 two bits agree with probability
0.8485, so a key of k chosen bits agrees with 0.8485^k, and as many tables of keys are made as miss
such a pair with probability ``MISS``; k follows the logarithm of the number of different sets, so that
a key is shared by few by chance, and the tables grow with its power 0.24. A row of a table carries the
first ``COMPARED`` bits and is shuffled once. Rows of one key are compared by bit planes with carry-save
counters, as for short fingerprints, in chunks of ``CHUNK``, and given up beyond ``RADIUS`` bits (2.9
standard deviations above the mean at 0.8).

Links: of the pairs within the radius a task emits only the shortest spanning forest of its block, by
differing bits, so a group of near copies costs rows in proportion to its size. What connects two
parts at 0.8 lies on that forest unless the bits order two pairs otherwise than the similarity does.
The pairs are checked on the sets themselves. Sets are read again for documents in such pairs only,
and a document in many pairs has its set spread by salt.

Defined results: a null or blank text has no shingle, and such texts are copies of one another; a text
of fewer than five words is one shingle; equal sets are one class (64 bits of hash); repeated rows and
null ids give one row each, a component of null ids only has a null id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import components, map_batches, rows_of, stage, words
from tremor.llm.simhash import LINKS

SHINGLE = 5
SEED = 42
#: Bits of a signature, in 64-bit words.
WIDTH = 512
#: Leading bits that are compared, and how many may differ; one less than a power of two.
COMPARED, RADIUS = 128, 31
#: Probability that two bits agree at similarity 0.8, and the share of such pairs all tables may miss.
AGREE = 0.8485
MISS = 0.015
CHUNK = 1024
#: Pairs of one document that meet its set in one task.
SPREAD = 256

_MIX = np.random.default_rng(SEED).integers(0, 2**64, WIDTH // 64, np.uint64)
SKETCHES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("sig", T.BinaryType())])
KEYS = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "cls", "lo", "hi")])
SETS = T.StructType([T.StructField("cls", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))])


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    n = min(n, len(found))
    joined = b" ".join(found)
    end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    start = np.r_[0, end[:-1] + 1]
    spans = zip(start[: len(found) - n + 1].tolist(), end[n - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(found) - n + 1))


def class_of(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a set of hashes; the empty set is 0."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def signature(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set as words of 64 bits; each word mixes the hashes anew."""
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        x = hashes[at : at + (1 << 13), None] ^ _MIX[None, :]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        for row in range(0, len(bits), 255):  # sums of so many bits fit a byte
            ones += bits[row : row + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def _sketch_batches(batches):
    for batch in batches:
        cls, sigs = [], []
        for t in batch.column(1):
            h = shingles(t.as_py())
            cls.append(class_of(h))
            sigs.append(signature(h).tobytes())
        yield rows_of(SKETCHES, [batch.column(0), cls, sigs])


def _set_batches(batches):
    """Sets of the texts, a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            found = [shingles(t.as_py()) for t in batch.column(1)[at : at + 64]]
            yield rows_of(SETS, [[class_of(h) for h in found], pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))])


def tables_for(n: int) -> list[np.ndarray]:
    """Bit numbers of each table for ``n`` different sets."""
    k = max(16, math.ceil(math.log2(max(n, 2))) - 2)
    count = math.ceil(math.log(MISS) / math.log1p(-(AGREE**k)))
    rng = np.random.default_rng(SEED)
    return [rng.permutation(WIDTH)[:k] for _ in range(count)]


def _key_batches(batches, tables):
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            bits = np.unpackbits(sigs, axis=1, bitorder="little")
            cls = part.column(0).to_numpy(zero_copy_only=False)
            lo, hi = np.ascontiguousarray(sigs[:, : COMPARED // 8]).view(np.int64).T
            for t, chosen in enumerate(tables):
                key = np.full(part.num_rows, t, np.int64)
                for b in chosen:
                    key = key << 1 | bits[:, b]
                yield rows_of(KEYS, [key, cls, np.ascontiguousarray(lo), np.ascontiguousarray(hi)])


def _planes(sigs: np.ndarray) -> np.ndarray:
    """Bit planes (bits x lane words) of n signatures, one lane each."""
    lanes = -(-len(sigs) // 64) * 64
    bits = np.zeros((COMPARED, lanes), np.uint8)
    bits[:, : len(sigs)] = np.unpackbits(np.ascontiguousarray(sigs).view(np.uint8).reshape(len(sigs), -1), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def near(left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs within ``RADIUS`` and their differing bits: of ``left`` and ``right``, or i < j within ``left``."""
    own = right is None
    right = left if own else right
    planes, lanes = _planes(right), np.arange(-(-len(right) // 64) * 64)
    full = np.uint64(2**64 - 1)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        row = np.arange(len(part))
        skip = np.broadcast_to(lanes >= len(right), (len(part), len(lanes)))
        if own:
            skip = skip | (lanes[None, :] <= (at + row)[:, None])
        over = np.packbits(skip, axis=1, bitorder="little").view(np.uint64)
        count = [np.zeros_like(over) for _ in range(RADIUS.bit_length())]
        for b in range(COMPARED):
            flip = np.where(part[:, b >> 6] >> np.uint64(b & 63) & np.uint64(1), full, np.uint64(0))
            carry = planes[b][None, :] ^ flip[:, None]
            for k, c in enumerate(count):
                count[k], carry = c ^ carry, c & carry
            over = over | carry
            if b % 32 == 31:
                live = (over != full).any(1)
                if not live.all():
                    row, part, over, count = row[live], part[live], over[live], [c[live] for c in count]
                    if not len(row):
                        break
        if len(row):
            a, b = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
            found_a.append(at + row[a])
            found_b.append(b)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    d = np.zeros(len(a), np.int64)
    for w in range(COMPARED // 64):
        d += np.bitwise_count(left[a, w] ^ right[b, w])
    return a, b, d


def forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of the edges (a, b) of a shortest spanning forest of ``n`` nodes, by length d."""
    order = np.lexsort((b, a, d))
    label, chosen = np.arange(n), []
    while True:
        la, lb = label[a[order]], label[b[order]]
        live = la != lb
        if not live.any():
            return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
        order, la, lb = order[live], la[live], lb[live]
        best, at = np.full(n, -1), np.arange(len(order))[::-1]
        # the shortest edge of a part is written last, from either end
        best[np.ravel(np.column_stack([la[::-1], lb[::-1]]))] = np.repeat(at, 2)
        pick = np.unique(best[best >= 0])
        chosen.append(order[pick])
        x, y = la[pick], lb[pick]
        root = np.arange(n)
        while (root[x] != root[y]).any():
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
        label = root[label]


def _compare_batches(batches):
    """Sorted rows (key, i, j, c, cls, lo, hi) to pairs; a pool of small groups is compared as one block."""
    pool: list[tuple[np.ndarray, np.ndarray]] = []
    pooled = 0
    held = None

    def pairs(cls, sigs, cut=None):
        a, b, d = near(sigs) if cut is None else near(sigs[:cut], sigs[cut:])
        b = b if cut is None else b + cut
        keep = forest(len(cls), a, b, d)
        if len(keep):
            x, y = cls[a[keep]], cls[b[keep]]
            yield rows_of(LINKS, [np.minimum(x, y), np.maximum(x, y)])

    def flush():
        nonlocal pool, pooled
        cls, first = np.unique(np.concatenate([c for c, _ in pool]), return_index=True)
        sigs = np.concatenate([s for _, s in pool])[first]
        pool, pooled = [], 0
        yield from pairs(cls, sigs)

    def groups(cols, starts, ends):
        nonlocal pooled
        for s, e in zip(starts, ends, strict=True):
            if e - s == 1:
                continue
            if cols[1][s] != cols[2][s]:
                own = cols[3][s:e] == cols[1][s]
                order = np.argsort(~own, kind="stable")
                yield from pairs(cols[4][s:e][order], cols[5][s:e][order], int(own.sum()))
                continue
            pool.append((cols[4][s:e], cols[5][s:e]))
            pooled += e - s
            if pooled >= CHUNK // 2:
                yield from flush()

    for batch in batches:
        if not batch.num_rows:
            continue
        *cols, lo, hi = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols.append(np.column_stack([lo, hi]).view(np.uint64))
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
        starts = np.r_[0, new]
        yield from groups(cols, starts[:-1].tolist(), starts[1:].tolist())
        held = [x[starts[-1] :] for x in cols]
    if held is not None:
        yield from groups(held, [0], [len(held[0])])
    if pool:
        yield from flush()


def candidates(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes to check, from a table (cls, sig) that can be read more than once."""
    keys = map_batches(classes.select("cls", "sig"), _key_batches, KEYS, tables_for(classes.count()))
    # only keys of more than one chunk; Spark knows the size of the written table
    hot = stage(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK), "near-hot")
    rows = keys.join(hot, "key", "left").withColumn("k", F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("int"))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("cls"), "k").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "cls", "lo", "hi")
    return map_batches(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), _compare_batches, LINKS).distinct()


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (cls, hashes) share at least 0.8 of their union."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    degree = ends.groupBy("cls").agg(F.count("*").alias("n"))
    n = [degree.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab"]
    turn = F.col("n_a") > F.col("n_b")
    # y is the end with more pairs; its set is dealt to one place for every SPREAD of them
    rows = pairs.join(n[0], "a").join(n[1], "b").select(
        F.when(turn, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("y"),
        F.ceil(F.greatest("n_a", "n_b") / SPREAD).alias("k"))
    rows = rows.withColumn("s", F.pmod(F.xxhash64("x"), "k"))
    y_sets = rows.select("y", "s").distinct().join(sets.select(F.col("cls").alias("y"), F.col("hashes").alias("hy")), "y")
    met = rows.join(sets.select(F.col("cls").alias("x"), F.col("hashes").alias("hx")), "x").join(y_sets, ["y", "s"])
    both = F.size(F.array_intersect("hx", "hy"))
    return met.where(5 * both >= 4 * (F.size("hx") + F.size("hy") - both)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, cls, component_id) of each row; component_id is the smallest doc_id of its group."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketches = stage(map_batches(texts, _sketch_batches, SKETCHES), "near-sketches")
    classes = stage(sketches.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.first("sig").alias("sig")), "near-classes")
    pairs = stage(candidates(classes.where("cls <> 0")), "near-pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    nodes = stage(named.join(classes.select("cls", "first_id"), "cls"), "near-nodes")
    ids = nodes.select(F.col("first_id").alias("id")).distinct()
    again = texts.join(ids, texts.doc_id.eqNullSafe(ids.id), "left_semi")
    sets = map_batches(again, _set_batches, SETS).join(nodes.select("cls"), "cls", "left_semi")
    sets = stage(sets.groupBy("cls").agg(F.first("hashes").alias("hashes")), "near-sets")
    linked = classes.join(components(checked(pairs, sets)), F.col("cls") == F.col("node")).select("cls", "first_id", "component")
    lowest = linked.groupBy("component").agg(F.min("first_id").alias("lowest"))
    linked = linked.join(lowest, "component").select("cls", "lowest", F.lit(True).alias("linked"))
    whole = stage(classes.join(linked, "cls", "left").select("cls", F.when(F.col("linked"), F.col("lowest")).otherwise(F.col("first_id")).alias("component_id")), "near-whole")
    return sketches.join(whole, "cls").select("doc_id", "cls", "component_id")


def repeated_documents(docs: DataFrame) -> DataFrame:
    """Ids of the documents that are not the first of their group."""
    return near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct()
