"""Operator 11: phrase collocations from FM-indexes over word ids, one index a shard, summed over shards.

A task turns the texts it reads into shards of about ``SHARD`` words: numbers for words, 0 for a
break. Words are counted over all shards of a language; words below ``least`` can be in no phrase and
become breaks. Each shard then gets a bidirectional FM-index: the Burrows-Wheeler transform of its
word ids in the order of suffixes by their first words, the same for the reversed shard, and the
last-to-first map of both. The interval of a phrase is extended to the left in one index and to the
right in the other, the partner interval following from the counts of smaller symbols, and every
extension comes with its count in the shard. Phrases of two words are enumerated first, then those of
three and more, each length only where both phrases one word shorter are frequent over all shards.
Counts are sums of integers over all texts; nothing but the counted threshold drops a phrase.

Sums across shards: a shard deals its words, and for each length its phrases, to buckets by hash, as
one packed row a bucket; a task sums one bucket after the other, tells each shard which of its own are
frequent, and under which number. Buckets follow the size of the input, so a bucket, a shard and an
answer are bounded, nothing is broadcast, and a word or phrase that every text holds is one entry a
shard. The extensions of a phrase by one word on either side are the phrases one word longer, so a
phrase is inside a longer one of equal count exactly if an extension has its count.

Defined results: null texts are empty; a null language is ``und``; rows that repeat count each;
texts without words and empty tables give no rows; ties go by the phrase in UTF-8 order; other columns
are not read. Long texts are read in slices that end at a break; a run of words without any break is
indexed whole. More than 2^31 - 1 frequent words are refused with a ValueError.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import cached_property
from itertools import count as counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import map_batches, rows_of, stage, table
from tremor.llm.registry import query

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words of a shard, and bytes of text that are split into words at once.
SHARD, SLICE = 1_500_000, 1 << 19
#: Bytes of text for each bucket.
BUCKET = 32 << 20
#: Level at which rows are compressed.
ZSTD = 3
#: Parts of a language that are ranked on their own before their best are ranked together.
PARTS = 32

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_MARK = b"\xff"  # in no UTF-8 text
_TO_MARK = bytes.maketrans(_BREAKS, _MARK * len(_BREAKS))

READ = T.StructType([T.StructField(n, t) for n, t in (("shard", T.LongType()), ("codes", T.BinaryType()), ("bucket", T.IntegerType()), ("lang", T.StringType()), ("words", T.BinaryType()), ("locals", T.BinaryType()), ("n", T.BinaryType()))])
CODED = T.StructType([T.StructField("shard", T.LongType()), T.StructField("codes", T.BinaryType())])
KEYS = T.StructType([T.StructField(n, t) for n, t in (("shard", T.LongType()), ("bucket", T.IntegerType()), ("keys", T.BinaryType()), ("n", T.BinaryType()))])
#: Sums of a bucket: frequent entries (place, lang and word or key, f), totals (lang, f), and answers (shard, mine, places).
SUMMED = T.StructType([T.StructField(n, t) for n, t in (("bucket", T.IntegerType()), ("place", T.IntegerType()), ("lang", T.StringType()), ("word", T.StringType()), ("key", T.LongType()), ("f", T.LongType()), ("shard", T.LongType()), ("mine", T.BinaryType()), ("places", T.BinaryType()))])
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]


def _packed(codes: np.ndarray) -> bytes:
    """All lowest bytes first, then the next ones: high bytes are mostly equal, and single bytes repeat more than numbers."""
    planes = np.ascontiguousarray(codes).view(np.uint8).reshape(-1, codes.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), ZSTD)


def _unpacked(blob: bytes, kind=np.int32) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _packed_ids(ids: np.ndarray) -> bytes:
    """Ascending ids by their differences."""
    return _packed(np.diff(ids, prepend=0).astype(np.int32))


def _unpacked_ids(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob), dtype=np.int64)


def _packed_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys: differences of the first halves, and second halves, by differences where the first half stays."""
    step, low = np.diff(keys >> 32, prepend=0), keys & (2**32 - 1)
    return _packed(np.r_[step, np.where(step == 0, np.diff(low, prepend=0), low)].astype(np.int32))


def _unpacked_sorted(blob: bytes) -> np.ndarray:
    step, low = _unpacked(blob).astype(np.int64).reshape(2, -1)
    run = np.cumsum(low)
    before = np.maximum.accumulate(np.where(step > 0, run - low, 0))
    return np.cumsum(step) << 32 | run - before


def _shift(prefix: np.ndarray, buckets: int) -> np.ndarray:
    return ((prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _dealt(prefix: np.ndarray, word: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and key of phrases: followers of a prefix go round all buckets, so a bucket's keys need the quotient only."""
    return (word + _shift(prefix, buckets)) % buckets, prefix << 32 | word // buckets


def _whole(bucket: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Prefix and word, as one number, of the keys of a bucket."""
    prefix = keys >> 32
    return prefix << 32 | (keys & (2**32 - 1)) * buckets + (bucket - _shift(prefix, buckets)) % buckets


def _slices(raw: bytes):
    """Parts of about SLICE bytes, cut after a break."""
    at = 0
    while at < len(raw):
        end = raw.find(_MARK, at + SLICE) + 1 or len(raw)
        yield raw[at:end]
        at = end


def _read_batches(batches, buckets: int):
    """Texts to shards: one row with the codes of a shard, and one for each of its (language, word)."""
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    made = 0

    def fresh():
        number = counter(1).__next__  # one numbering for the words of all languages of a shard
        return defaultdict(lambda: defaultdict(number, {_MARK: 0})), [np.zeros(1, np.int32)], 0

    def rows():
        codes = np.concatenate(parts)
        n, shard = np.bincount(codes), first + made
        yield rows_of(READ, [[shard], [_packed(codes)], *([None] for _ in range(5))])
        for lang, d in known.items():
            dealt: list[list[bytes]] = [[] for _ in range(buckets)]
            for w in d:
                dealt[crc32(w) % buckets].append(w)
            dealt[crc32(_MARK) % buckets].remove(_MARK)
            for bucket, words in enumerate(dealt):
                if words:
                    words.sort()
                    local = np.fromiter(map(d.__getitem__, words), np.int32, len(words))
                    yield rows_of(READ, [[shard], [None], [bucket], [lang], [zstandard.compress(b"\n".join(words), ZSTD)], [_packed(local)], [_packed(n[local])]])

    known, parts, size = fresh()
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            d = known[lang.as_py()]
            raw = (text.as_py() or "").encode("utf-8", "replace").lower().translate(_TO_MARK)
            for part in _slices(raw):
                words = part.replace(_MARK, b" \xff ").split()  # splits bytes at blanks and tabs; the rest are breaks
                if words:
                    parts.append(np.fromiter(map(d.__getitem__, words), np.int32, len(words)))
                    size += len(words)
                if size >= SHARD and part.endswith(_MARK):
                    yield from rows()
                    made += 1
                    known, parts, size = fresh()
                    d = known[lang.as_py()]
            parts.append(np.zeros(1, np.int32))
    if size:
        yield from rows()


def _answer(bucket: int, shard: int, mine: bytes, places: np.ndarray) -> pa.RecordBatch:
    return rows_of(SUMMED, [[bucket], *([None] for _ in range(5)), [shard], [mine], [_packed_ids(places)]])


def _word_sums(batches, least: int):
    """Word rows in the order of (bucket, language) to the frequent words, totals, and each shard's share of them."""
    held: list = []

    def summed(key):
        bucket, lang = key
        sums: Counter = Counter()
        for _, words, _, n in held:
            for w, k in zip(zstandard.decompress(words).split(b"\n"), _unpacked(n, np.int64).tolist(), strict=True):
                sums[w] += k
        often = {w: k for k, w in enumerate(sorted(w for w, f in sums.items() if f >= least))}
        yield rows_of(SUMMED, [[bucket], [None], [lang], [None], [None], [sum(sums.values())], [None], [None], [None]])
        if often:
            nothing = pa.nulls(len(often))
            start = taken[0]
            yield rows_of(SUMMED, [np.full(len(often), bucket), start + np.arange(len(often)), pa.array([lang] * len(often)), pa.array(list(often), pa.binary()), nothing, [sums[w] for w in often], nothing, nothing, nothing])
            for shard, words, local, _ in held:
                place = np.fromiter((often.get(w, -1) for w in zstandard.decompress(words).split(b"\n")), np.int64)
                yield _answer(bucket, shard, _packed(_unpacked(local)[place >= 0]), start + place[place >= 0])
            taken[0] += len(often)

    key, taken = None, [0]
    for batch in batches:
        for shard, bucket, lang, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (bucket, lang):
                if held:
                    yield from summed(key)
                taken = taken if key and key[0] == bucket else [0]
                key, held = (bucket, lang), []
            held.append((shard, *row))
    if held:
        yield from summed(key)


def _key_sums(batches, least: int, buckets: int):
    """Key rows in the order of buckets to the frequent keys, and each shard's share of them."""
    held: list = []

    def summed(bucket):
        shards = [(shard, _unpacked_sorted(keys), _unpacked(n)) for shard, keys, n in held]
        keys, at = np.unique(np.concatenate([k for _, k, _ in shards]), return_inverse=True)
        f = np.bincount(at, np.concatenate([n for _, _, n in shards])).astype(np.int64)
        often, f = keys[f >= least], f[f >= least]
        if not len(often):
            return
        nothing = pa.nulls(len(often))
        yield rows_of(SUMMED, [np.full(len(often), bucket), np.arange(len(often)), nothing, nothing, _whole(bucket, often, buckets), f, nothing, nothing, nothing])
        for shard, mine, _ in shards:
            place = np.minimum(np.searchsorted(often, mine), len(often) - 1)
            met = often[place] == mine
            if met.any():
                yield _answer(bucket, shard, _packed_sorted(mine[met]), place[met])

    last = None
    for batch in batches:
        for shard, bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != last and held:
                yield from summed(last)
                held = []
            last = bucket
            held.append((shard, *row))
    if held:
        yield from summed(last)


def _code_batches(batches):
    """Codes by the ids of frequent words; all other words become breaks, and single words go."""
    for batch in batches:
        for shard, codes, answers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            codes = _unpacked(codes)
            to = np.zeros(int(codes.max()) + 1, np.int32)
            for a in answers:
                to[_unpacked(a["mine"])] = a["before"] + _unpacked_ids(a["places"]) + 1
            yield rows_of(CODED, [[shard], [_packed(runs_of(to[codes], 2))]])


def runs_of(codes: np.ndarray, least: int) -> np.ndarray:
    """Runs of at least ``least`` words between breaks, with one break around each."""
    edge = np.flatnonzero(np.r_[0, codes, 0] == 0)
    length = np.diff(edge) - 1
    long = np.repeat(length >= least, length + 1)  # each run with the break before it
    return np.r_[np.r_[0, codes][: len(long)][long], 0].astype(np.int32)


class PhraseIndex:
    """Bidirectional FM-index of word ids (0 a break), good for phrases of up to ``depth`` words.

    Suffixes are ordered by their first ``depth`` words only: the rows that start with a phrase of
    that length at most lie together all the same, and a step to the left keeps their order.
    """

    def __init__(self, codes: np.ndarray, depth: int):
        self.names = np.unique(codes)
        if not len(self.names) or self.names[0]:
            self.names = np.r_[np.int32(0), self.names]
        self.text, self.depth, self.size = np.searchsorted(self.names, codes).astype(np.int32), depth, len(self.names)
        self.counts = np.bincount(self.text, minlength=self.size)

    @cached_property
    def left(self) -> tuple[np.ndarray, np.ndarray]:
        return self._half(self.text)

    @cached_property
    def right(self) -> tuple[np.ndarray, np.ndarray]:
        return self._half(self.text[::-1])

    def _half(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The transform and the last-to-first map."""
        bits = max(1, (self.size - 1).bit_length())
        ahead, keys = np.r_[text, np.zeros(self.depth, np.int32)], []
        for at in range(0, self.depth, 62 // bits):
            key = np.zeros(len(text), np.int64)
            for k in range(at, min(self.depth, at + 62 // bits)):
                key <<= bits
                key |= ahead[k : k + len(text)]
            keys.append(key)
        before = text[np.lexsort(keys[::-1]) - 1]
        back = np.empty(len(text), np.int32)
        back[np.argsort(before, kind="stable")] = np.arange(len(text), dtype=np.int32)
        return before, back

    def words(self):
        """(words, start in the left index, start in the right index, count) of all single words."""
        start = np.cumsum(self.counts) - self.counts
        w = np.flatnonzero(self.counts[1:]) + 1
        return w[:, None], start[w], start[w], self.counts[w]

    def extended(self, phrases, to_left: bool):
        """All phrases one word longer on one side, in the same form."""
        words, l, r, n = phrases
        before, back = self.left if to_left else self.right
        own, other = (l, r) if to_left else (r, l)
        begin = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        row = (np.arange(len(owner)) - (begin - own)[owner]).astype(np.int32)
        key = owner.astype(np.int64) * self.size + before[row]
        del owner
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        n = np.diff(np.r_[first, len(key)])
        owner, symbol = key[first] // self.size, key[first] % self.size
        own, other = back[row[order[first]]].astype(np.int64), other[owner] + first - begin[owner]
        fine = symbol > 0
        added, words = symbol[fine, None], words[owner[fine]]
        l, r = (own, other) if to_left else (other, own)
        return np.concatenate([added, words] if to_left else [words, added], 1), l[fine], r[fine], n[fine]


def _known(level: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes and words of a shard's frequent phrases of one length, ascending, and their ids."""
    keys = np.concatenate([_whole(a["bucket"], _unpacked_sorted(a["mine"]), buckets) for a in level])
    ids = np.concatenate([a["before"] + _unpacked_ids(a["places"]) for a in level])
    order = np.argsort(keys, kind="stable")
    return keys[order], ids[order]


def _looked_up(prefix: np.ndarray, word: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Ids of phrases by the id of all words but the last, and the last; -1 for others."""
    key = prefix.astype(np.int64) << 32 | word
    at = np.minimum(np.searchsorted(known[0], key), len(known[0]) - 1)
    return np.where((known[0][at] == key) & (prefix >= 0) & (word > 0), known[1][at], -1)


def _joined_runs(codes: np.ndarray, often: np.ndarray, size: int) -> np.ndarray:
    """The words of all places in a row where frequent phrases of ``size`` words start, two at least, with breaks around."""
    edge = np.flatnonzero(np.diff(np.r_[False, often, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    start, end = start[end - start > 1], end[end - start > 1] + size - 1
    n = end - start + 1
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out = codes[np.minimum(np.repeat(start, n) + at, len(codes) - 1)]
    out[np.cumsum(n) - 1] = 0
    return np.r_[np.int32(0), out]


def _often(codes: np.ndarray, known: list) -> np.ndarray:
    """Where phrases start that are one word longer than there are levels, all known to be frequent."""
    ids = np.where(codes > 0, codes, -1).astype(np.int64)  # of the phrase of one word, then more, that starts here
    for n, level in enumerate(known, 1):
        ids = np.r_[_looked_up(ids[: len(codes) - n], codes[n:], level), np.full(n, -1)]
    return ids >= 0


def _narrow_batches(batches, buckets: int):
    """Shards cut down to runs in which every phrase of the last level is frequent; levels pass on."""
    for batch in batches:
        levels = [c.to_pylist() for c in batch.columns[2:]]
        kept = []
        for k, codes in enumerate(map(_unpacked, batch.column(1).to_pylist())):
            known = [_known(level[k], buckets) for level in levels]
            kept.append(_packed(_joined_runs(codes, _often(codes, known), len(known) + 1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *batch.columns[2:]], schema=batch.schema)


def _phrase_batches(batches, size: int, buckets: int):
    """Phrases of ``size`` words with their counts in the shard; shorter ones of the levels are known to be frequent."""
    for batch in batches:
        levels = [c.to_pylist() for c in batch.columns[2:]]
        for k, (shard, codes) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            codes = _unpacked(codes)
            known = [_known(level[k], buckets) for level in levels]
            if len(codes) <= size:
                continue
            index = PhraseIndex(codes, size)
            found = index.words()
            for n in range(1, size):
                found = index.extended(found, n % 2 == 1)
            words, n = index.names[found[0]].astype(np.int64), found[3]
            prefix = words[:, 0]
            for at, level in enumerate(known, 1):
                prefix = _looked_up(prefix, words[:, at], level)
            bucket, key = _dealt(prefix, words[:, size - 1], buckets)
            order = np.lexsort((key, bucket))
            key, n, cut = key[order], n[order].astype(np.int32), np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                if cut[b] < cut[b + 1]:
                    part = slice(cut[b], cut[b + 1])
                    yield rows_of(KEYS, [[shard], [b], [_packed_sorted(key[part])], [_packed(n[part])]])


def _placed(summed: DataFrame) -> DataFrame:
    """(bucket, before): entries in the buckets before, from one row for each bucket."""
    sizes = summed.where("place is not null").groupBy("bucket").agg(F.count("*").alias("k"))
    placed = stage(sizes.select("bucket", "k", (F.sum("k").over(W.orderBy("bucket")) - F.col("k")).alias("before")), "phrase-places")
    n = placed.agg(F.sum("k")).first()[0] or 0
    if n >= 2**31 - 1:
        raise ValueError(f"{n} frequent entries, more than an id can hold")
    return placed.select("bucket", "before")


def _answers(summed: DataFrame, placed: DataFrame, name: str) -> DataFrame:
    """(shard, name): what a shard holds of the frequent entries, and their ids."""
    own = summed.where("shard is not null").select("bucket", "shard", "mine", "places").join(placed, "bucket")
    return own.groupBy("shard").agg(F.collect_list(F.struct("bucket", "mine", "places", "before")).alias(name))


def _summed(rows: DataFrame, fn, order: list[str], name: str, *args) -> DataFrame:
    return stage(map_batches(rows.repartition("bucket").sortWithinPartitions("bucket", *order), fn, SUMMED, *args), name)


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words with at least ``least`` occurrences.

    Returns (id, lang, word, f), (w1..w5, f) with 0 after the last word, single words among them, and
    (lang, n) with all words of a language.
    """
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    read = stage(map_batches(texts, _read_batches, READ, buckets), "phrase-shards")
    summed = _summed(read.where("bucket is not null").select("shard", "bucket", "lang", "words", "locals", "n"), _word_sums, ["lang"], "phrase-words", least)
    placed = _placed(summed)
    totals = summed.where("place is null and shard is null").groupBy("lang").agg(F.sum("f").alias("n"))
    words = summed.where("place is not null").join(placed, "bucket").select((F.col("before") + F.col("place") + 1).cast("int").alias("id"), "lang", "word", "f")
    coded = stage(map_batches(read.where("bucket is null").select("shard", "codes").join(_answers(summed, placed, "answers"), "shard"), _code_batches, CODED), "phrase-coded")

    none = F.lit(0)
    grams = words.select(F.col("id").alias("w1"), *(none.alias(c) for c in WORDS[1:]), "f")
    before, held = words.select(F.col("id").cast("long").alias("id"), F.col("id").alias("w1")), coded
    for k in range(2, longest + 1):
        summed = _summed(map_batches(held, _phrase_batches, KEYS, k, buckets), _key_sums, [], f"phrase-{k}", least, buckets)
        placed = _placed(summed)
        found = summed.where("place is not null").join(placed, "bucket").select((F.col("before") + F.col("place")).alias("new"), F.shiftright("key", 32).alias("id"), F.col("key").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias(WORDS[k - 1]), "f")
        found = stage(found.join(before, "id").select(F.col("new").alias("id"), *WORDS[:k], "f"), "phrase-named")
        grams = grams.unionByName(found.select(*WORDS[:k], *(none.alias(c) for c in WORDS[k:]), "f"))
        before = found.drop("f")
        if k < longest:
            held = held.join(_answers(summed, placed, f"level{k}"), "shard")
            held = stage(map_batches(held, _narrow_batches, held.schema, buckets), "phrase-held")
    return words, stage(grams, "phrase-grams"), totals


def _part(first: int, last: int) -> list[Column]:
    """Words ``first`` to ``last`` of a phrase in the columns of a phrase of their own."""
    return [F.col(f"w{first + k}") if first + k <= last else F.lit(0) for k in range(LONGEST)]


def _size() -> Column:
    return sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in WORDS[1:]), F.lit(1))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, words): the ``top`` phrases of each language by their weakest cut.

    ``score`` is floor(1000 a n / (l r)) at the cut where it is lowest, the first of equal ones. A
    phrase inside a longer one of the same count is left out. ``longest`` is at most 5.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    words, grams, totals = phrase_counts(docs, text_col, lang_col, least, longest)
    sized = grams.withColumn("size", _size())
    longer = [F.when(F.col("size") == s, F.array(F.struct(*(c.alias(w) for c, w in zip(_part(1, s - 1), WORDS, strict=True))), F.struct(*(c.alias(w) for c, w in zip(_part(2, s), WORDS, strict=True))))) for s in range(3, longest + 1)]
    inside = sized.where("size > 2").select("f", F.explode(F.coalesce(*longer, F.array())).alias("p")).select("p.*", "f") if longer else None
    phrases = sized.where("size > 1").withColumnRenamed("f", "a")
    if inside is not None:
        within = inside.groupBy(*WORDS).agg(F.max("f").alias("most"))
        phrases = phrases.join(within, WORDS, "left").where(F.coalesce(F.col("most") < F.col("a"), F.lit(True))).drop("most")
    phrases = stage(phrases, "phrase-kept")

    def cut(k: int, s: int) -> list[Column]:
        named = lambda part, side: F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *(c.alias(f"p{i + 1}") for i, c in enumerate(part)))
        return [named(_part(1, k), "l"), named(_part(k + 1, s), "r")]

    cuts = [F.when(F.col("size") == s, F.array(*(x for k in range(1, s) for x in cut(k, s)))) for s in range(2, longest + 1)]
    parts = phrases.select(*WORDS, "a", F.explode(F.coalesce(*cuts)).alias("c")).select(*WORDS, "a", "c.*")
    known = grams.select(*(F.col(w).alias(f"p{i + 1}") for i, w in enumerate(WORDS)), "f")
    parts = parts.join(known, [f"p{i + 1}" for i in range(LONGEST)])
    both = parts.groupBy(*WORDS, "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    # the language of a phrase is that of its first word
    spoken = both.join(words.select(F.col("id").alias("w1"), "lang"), "w1").join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    spoken = spoken.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = spoken.groupBy(*WORDS, "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select(*WORDS, "lang", "a", "n", "c.*")

    at = F.posexplode(F.filter(F.array(*WORDS), lambda w: w > 0))
    named = best.select("*", at.alias("at", "id")).join(words.select("id", "word"), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = named.groupBy("lang", "a", "l", "r", "n", "score", *WORDS).agg(text.alias("phrase"), F.count("*").alias("words"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    # the best of a part hold all of its rows among the best of the language
    near = named.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("r1", rank("lang", "part")).where(F.col("r1") <= top)
    out = near.withColumn("rank", rank("lang")).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "words")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) n FROM w GROUP BY lang),
sized AS (SELECT lang, ws, unnest([1, 2, 3, 4, 5]) k FROM w),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) phrase FROM sized WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f a, string_split(phrase, ' ') ws FROM f WHERE k > 1),
gone AS (
  SELECT DISTINCT lang, phrase, a FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:k], ' ')]) phrase FROM c WHERE k > 2)),
kept AS (SELECT * FROM c ANTI JOIN gone USING (lang, phrase, a)),
cuts AS (SELECT *, unnest(range(1, k)) j FROM kept),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.f l, y.f r, t.n, j,
    CAST(1000::HUGEINT * cuts.a * t.n // (x.f::HUGEINT * y.f) AS BIGINT) score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.k = j AND x.phrase = array_to_string(ws[1:j], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.k = cuts.k - j AND y.phrase = array_to_string(ws[j + 1:cuts.k], ' ')
  JOIN totals t ON t.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) <= 2000
"""


@query("op11_phrases", SQL)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("words")
