"""Operator 6: language-model scores by a hashed maximum-entropy model with class-factored softmax.

Words of all training texts are counted exactly. The ``(CLASSES - 1) * SLOTS`` most frequent ones sit
in classes of SLOTS words by rank, every other word in the last class. The model is
P(word | before) = P(class | before) * P(word | class, before): both factors are softmaxes over sums of
weight rows, hashed from the previous word, the two previous ones and skip features. The words of the
last class are the leaves of a binary tree: a word's path is a hash of the word, and every step of it is
a logistic factor of the words before, starting from the counted shares of both sides. The tree is as
deep as the number of words asks, at most DEPTH; words that end in one leaf share it by their smoothed
counts, and the unknown branches off at the root, so the probabilities of all words and of the unknown
sum to one.

Training is distributed: each of ``ROUNDS`` updates reads its own share of the training texts, all of
them once; tasks sum observed and expected weights in numpy, the sums are added up by slices in a
shuffle, and the driver moves a weight along its gradient (observed - expected), scaled by their sum.
Weights have a fixed size (rows x columns, and cells of steps), so what is collected and broadcast is
bounded. Scoring looks counts of the ``KNOWN`` most frequent words up in the task; the others, with what
their paths came to, meet their counts in an equi-join of (word, text) pairs.

Defined results: a null text is empty and is one end token; a null id counts as the empty text in the
held-out rule; rows that repeat an id and a text get the same scores, and rows with one id and
different texts their own; without training tokens the base is uniform over nothing (score 0); other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import crc32_mod, map_batches, rows_of, stage, table, words
from tremor.llm.registry import query

ALPHA = 0.1
CLASSES, SLOTS = 32, 32
#: Rows of the class weights and of the word weights.
ROWS = 1 << 12
ROUNDS, STEP = 5, 0.3
#: Steps of a path in the last class at most, and weights of steps.
DEPTH, CELLS = 18, 1 << 16
#: Steps added to those counted at a weight, so that few move it little.
STEADY = 8.0
#: Words whose counts go out with the model.
KNOWN = 150_000
#: Tokens handled at once in a task, and parts in which sums are added up.
TOKENS, SLICES = 1 << 15, 64

END = b"\n"
_TAIL = CLASSES - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CODE, _NODE = 0x61C88647, np.uint32(0x9E3779B1)
#: Log-odds of a step with words on one side only.
_SURE = 60.0

COUNTED = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])
SUMS = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("sums", T.BinaryType())])
#: Scores of a text, or one of its words that the task does not know (n and path over its occurrences).
SCORED = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("of", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("n_tail", T.LongType()), ("base", T.DoubleType()), ("tail", T.DoubleType()), ("model", T.DoubleType()), ("word", T.BinaryType()), ("n", T.LongType()), ("path", T.DoubleType()))])


def _count_batches(batches):
    for batch in batches:
        found: Counter = Counter()
        for text in batch.column(0):
            found.update(words(text.as_py()))
        if len(batch):
            found[END] = len(batch)
        rows = list(found.items())
        for at in range(0, len(rows), 50_000):
            yield rows_of(COUNTED, list(map(list, zip(*rows[at : at + 50_000], strict=True))))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over a table of texts, the end of each text counted as a word."""
    return map_batches(texts, _count_batches, COUNTED).groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``: all from a count on, which a histogram of logarithms finds."""
    size = F.floor(F.log(F.col("n").cast("double")) * 16)
    least, left = None, most
    for r in sorted(counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect(), reverse=True):  # some hundred rows
        left -= r["words"]
        if left < 0:
            break
        least = r["size"]
    if least is None:
        return []
    rows = counts.where(size >= least).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda w: (-w[1], w[0]))


def _code(crc: np.ndarray) -> np.ndarray:
    """Paths of words, first step in the highest bit, from their crc32."""
    return (crc.astype(np.uint64) * np.uint64(_CODE) & np.uint64(2**32 - 1)).astype(np.uint32)


def depth_of(distinct: int) -> int:
    return min(DEPTH, max(1, distinct.bit_length()))


def leaf_sums(counts: DataFrame, depth: int) -> np.ndarray:
    """Occurrences and words of each leaf, at most 2^DEPTH rows; all words are summed."""
    leaf = F.shiftright((F.crc32("word") * F.lit(_CODE)) % F.lit(2**32), 32 - depth)
    out = np.zeros((2, 1 << depth))
    for r in counts.groupBy(leaf.alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        out[:, r["leaf"]] = r["n"], r["words"]
    return out


class Tree:
    """Steps to the leaves of the last class: log-odds of the right side by counts, and the log share of each leaf."""

    def __init__(self, sums: np.ndarray):
        self.depth = sums.shape[1].bit_length() - 1
        mass = sums[0] + ALPHA * sums[1]
        mass[sums[1] == 0] = 0
        odds = np.zeros(1 << self.depth)
        level = mass
        for k in range(self.depth - 1, -1, -1):
            left, right = level[::2], level[1::2]
            with np.errstate(divide="ignore", invalid="ignore"):
                odds[1 << k : 2 << k] = np.where(left == 0, _SURE, np.where(right == 0, -_SURE, np.log(right) - np.log(left)))
            level = left + right
        self.odds = odds.astype(np.float32)
        self.share = np.log(np.maximum(mass, 1e-300) / max(level[0], 1e-300))

    def steps(self, code: np.ndarray, rows: np.ndarray, weights: np.ndarray):
        """(sides, cells, sums) of the steps of each token: side taken, two weights called, and log-odds of the right side."""
        level = np.arange(self.depth, dtype=np.uint32)
        node = np.uint32(1) << level | (code[:, None] >> np.uint32(1)) >> np.uint32(31) - level
        side = (code[:, None] >> np.uint32(31) - level & np.uint32(1)).astype(bool)
        mixed = node * _NODE
        cells = [((mixed ^ r[:, None]) >> np.uint32(16)).astype(np.intp) for r in rows]  # one of CELLS
        sums = self.odds[node]
        for c in cells:
            sums += np.take(weights, c)
        return side, cells, sums

    def moved(self, code: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How far the words before move the log-probability of each token's leaf from its share."""
        side, _, sums = self.steps(code, rows, weights)
        np.negative(sums, out=sums, where=side)
        return -np.log1p(np.exp(sums)).sum(1, dtype=float) - self.share[code >> np.uint32(32 - self.depth)]


class Lexicon:
    """Frequent words with their counts, and which of them have a class and a slot; ``leaves`` are sums of all words."""

    def __init__(self, known: list[tuple[bytes, int]], total: int, distinct: int, ends: int, leaves: np.ndarray | None = None):
        head = known[: _TAIL * SLOTS]
        self.place = {w: k for k, (w, _) in enumerate(head)}
        self.log = {w: float(np.log10(n + ALPHA)) for w, n in known} | {END: float(np.log10(ends + ALPHA))}
        self.unknown = END if not ends else None
        self.total, self.distinct = total, distinct
        self.head = np.array([n for _, n in head], float)
        self.head_log = np.log10(np.r_[self.head, 0.0] + ALPHA)
        tail = total - self.head.sum()
        self.base = float(np.log10(total + ALPHA * (distinct + 1)))
        self.tail = float(np.log10(tail + ALPHA * (distinct - len(head) + 1)))
        sums = np.zeros((2, 2)) if leaves is None else leaves.copy()
        if leaves is not None and head:
            at = _code(np.array([zlib.crc32(w) for w, _ in head])) >> np.uint32(33 - sums.shape[1].bit_length())
            np.subtract.at(sums, (slice(None), at), [self.head, np.ones(len(head))])  # whole numbers, so nothing is left of them
        self.tree = Tree(sums)

    def start(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of the model without features: shares of the classes and of the words in them; steps start at theirs."""
        by_class, by_word = np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, SLOTS), np.float32)
        cells = np.zeros(_TAIL * SLOTS)
        cells[: len(self.head)] = self.head
        cells = cells.reshape(_TAIL, SLOTS)
        share = np.r_[cells.sum(1), self.total - cells.sum()] + ALPHA
        empty = np.r_[cells.sum(1) == 0, False]
        by_class[0] = np.where(empty, -1e9, np.log(share / share.sum()))
        by_word[:_TAIL] = np.where(cells > 0, np.log(np.maximum(cells, 1) / np.maximum(cells.sum(1, keepdims=True), 1)), -1e9)
        return by_class, by_word, np.zeros(CELLS, np.float32)


def _hashed(first: int, *parts: np.ndarray, salt: int) -> np.ndarray:
    """Weight rows from ``first`` on."""
    h = np.full(len(parts[0]), salt, np.uint64)
    for p in parts:
        h = (h ^ p) * _MIX
        h ^= h >> np.uint64(32)
    return ((h >> np.uint64(32)) * np.uint64(ROWS - first) >> np.uint64(32)).astype(np.int64) + first


class Tokens:
    """Tokens of a few texts in a row: targets, and the weight rows that their surroundings call."""

    def __init__(self, texts: list[list[bytes]], lexicon: Lexicon):
        flat = list(chain.from_iterable(texts))
        n = len(flat)
        self.ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.place = np.fromiter(map(lexicon.place.get, flat, repeat(-1)), np.int64, n)
        self.cls = np.where(self.place < 0, _TAIL, self.place // SLOTS)
        self.slot = self.place % SLOTS
        code = np.fromiter(map(zlib.crc32, flat), np.uint64, n)
        at = np.arange(n) - np.repeat(self.ends - np.diff(np.r_[0, self.ends]), np.diff(np.r_[0, self.ends]))
        back = [np.where(at >= k, np.r_[np.zeros(min(k, n), np.uint64), code[: max(n - k, 0)]], np.uint64(1)) for k in (1, 2, 3)]
        self.class_rows = [_hashed(1, back[0], salt=1), _hashed(1, back[0], back[1], salt=2), _hashed(1, back[1], salt=3), _hashed(1, back[2], salt=4)]
        self.in_head = np.flatnonzero(self.place >= 0)
        cls = self.cls[self.in_head].astype(np.uint64)
        self.word_rows = [_hashed(CLASSES, back[0][self.in_head], cls, salt=5), _hashed(CLASSES, back[1][self.in_head], cls, salt=6)]
        self.flat = flat
        # the last class: paths of its words, and what the word before and the two before make of their steps
        self.in_tail = np.flatnonzero(self.place < 0)
        self.code = _code(code[self.in_tail])
        one, two = back[0][self.in_tail], back[1][self.in_tail]
        self.step_rows = [((h * _MIX) >> np.uint64(32)).astype(np.uint32) for h in (one + np.uint64(7), (one * _MIX ^ two) + np.uint64(8))]

    def logits(self, weights) -> tuple[np.ndarray, np.ndarray]:
        """Weight sums of all classes at each token, and of all slots at each token with a slot.

        They start from log shares and move by a bounded step in each round, so exp() can't overflow.
        """
        by_class, by_word = weights[:2]
        return _summed(by_class[0], by_class, self.class_rows), _summed(by_word[self.cls[self.in_head]], by_word, self.word_rows)


def _summed(start: np.ndarray, weights: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    out = weights[features[0]]
    out += start
    more = np.empty_like(out)
    for rows in features[1:]:
        np.take(weights, rows, axis=0, out=more)
        out += more
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _log_chosen(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log-probability of the chosen column of each row of sums."""
    value = x[np.arange(len(x)), chosen].astype(float)
    np.exp(x, out=x)
    return value - np.log(x.sum(1))


def _added(into: np.ndarray, rows: list[np.ndarray], values: np.ndarray) -> None:
    """into[:, rows] += values.T for each of the row lists, with repeated rows."""
    for k, column in enumerate(np.ascontiguousarray(values.T)):
        for r in rows:
            into[k] += np.bincount(r, column, ROWS)


def _in_turn(column, lexicon: Lexicon):
    """(Tokens, rows of the batch) of about TOKENS tokens; longer texts stay whole."""
    some: list = []
    size = first = 0
    for k, text in enumerate(column):
        some.append([*words(text.as_py()), END])
        size += len(some[-1])
        if size >= TOKENS:
            yield Tokens(some, lexicon), range(first, k + 1)
            some, size, first = [], 0, k + 1
    if some:
        yield Tokens(some, lexicon), range(first, len(column))


def _gradient_batches(batches, model):
    """Observed and expected sums of the partition's texts, one row for each slice of the weights."""
    lexicon, *weights = model.value
    observed = np.zeros((2, ROWS, SLOTS))  # of class and of word weights
    expected = np.zeros((2, SLOTS, ROWS))
    steps = np.zeros((2, CELLS))  # observed - expected, and their number
    for batch in batches:
        for t, _ in _in_turn(batch.column(0), lexicon):
            a, b = map(_softmax, t.logits(weights))
            for rows in t.class_rows:
                observed[0] += np.bincount(rows * CLASSES + t.cls, minlength=ROWS * CLASSES).reshape(ROWS, CLASSES)
            _added(expected[0], t.class_rows, a)
            if len(t.in_head):
                for rows in t.word_rows:
                    observed[1] += np.bincount(rows * SLOTS + t.slot[t.in_head], minlength=ROWS * SLOTS).reshape(ROWS, SLOTS)
                _added(expected[1], t.word_rows, b)
            if len(t.in_tail):
                side, cells, sums = lexicon.tree.steps(t.code, t.step_rows, weights[2])
                unsure = np.abs(sums) < _SURE / 2
                off = (side - 1 / (1 + np.exp(-sums)))[unsure]
                for c in cells:
                    c = c[unsure]
                    steps[0] += np.bincount(c, off, CELLS)
                    steps[1] += np.bincount(c, minlength=CELLS)
    sums = np.stack([observed, expected.transpose(0, 2, 1)], 1)  # matrix; observed or expected; row; column
    for k, part in enumerate(np.split(np.r_[sums.ravel(), steps.ravel()].astype(np.float32), SLICES)):
        if part.any():
            yield rows_of(SUMS, [[k], [part.tobytes()]])


def _add_batches(batches):
    """Sums of each slice, of rows dealt by slice."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(raw.as_py(), np.float32)
            total[k] = total[k] + part if k in total else part.astype(np.float64)
    for k, part in total.items():
        yield rows_of(SUMS, [[k], [part.astype(np.float32).tobytes()]])


def trained(texts: DataFrame, key, lexicon: Lexicon, rounds: int = ROUNDS):
    """Weights after one pass over ``texts`` (text, share in 0 .. rounds - 1)."""
    spark = texts.sparkSession
    weights = lexicon.start()
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((lexicon, *weights))
        summed = map_batches(texts.where(key == k).select("text"), _gradient_batches, SUMS, sent)
        parts = np.zeros((SLICES, (4 * ROWS * SLOTS + 2 * CELLS) // SLICES))
        for r in map_batches(summed.repartition("slice"), _add_batches, SUMS).collect():
            parts[r["slice"]] = np.frombuffer(bytes(r["sums"]), np.float32)
        sums, (off, n) = parts.ravel()[: 4 * ROWS * SLOTS].reshape(2, 2, ROWS, SLOTS), parts.ravel()[4 * ROWS * SLOTS :].reshape(2, CELLS)
        moved = 2 * STEP * (sums[:, 0] - sums[:, 1]) / (sums[:, 0] + sums[:, 1] + 2.0)
        moved[0, 0], moved[1, :CLASSES] = 0, 0  # shares stay what the counts say
        weights = tuple((w + m).astype(np.float32) for w, m in zip(weights, (*moved, 2 * off / (n + STEADY)), strict=True))
        sent.unpersist()
    return weights


def _of(text: str | None) -> int:
    """What tells rows with one id apart."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "replace")) - 2**63


def _score_batches(batches, model):
    """Scores of the texts, and their words whose counts the task does not know, once for each text."""
    lexicon, *weights = model.value
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        ids, of = batch.column(0).to_pylist(), [_of(x.as_py()) for x in batch.column(2)]
        for t, rows in _in_turn(batch.column(2), lexicon):
            a, b = t.logits(weights)
            value = _log_chosen(a, t.cls)
            value[t.in_head] += _log_chosen(b, t.slot[t.in_head])
            tail = t.place < 0
            rest = np.flatnonzero(tail)
            log = lexicon.head_log[t.place]  # the last one stands in for words without a place
            log[rest] = np.fromiter(map(lexicon.log.get, map(t.flat.__getitem__, rest.tolist()), repeat(np.nan)), float, len(rest))
            known = ~np.isnan(log)
            path = lexicon.tree.moved(t.code, t.step_rows, weights[2])  # of rest
            yield from _rare_rows(t, rest[~known[rest]], path[~known[rest]], ids[rows.start : rows.stop], of[rows.start : rows.stop])
            log[~known] = 0
            if lexicon.unknown is not None:
                known[t.ends - 1] = False
            value[rest] += np.where(known[rest], path, 0)
            first = np.r_[0, t.ends[:-1]]
            for x, v in zip(out, (np.ones(len(log)), known, tail, log, np.where(tail, log, 0), value), strict=True):
                x.append(np.add.reduceat(v.astype(float), first))
        n, known, tail, base, rest, value = (np.concatenate(x) if x else np.zeros(0) for x in out)
        none = pa.nulls(len(batch))
        yield rows_of(SCORED, [batch.column(0), of, batch.column(1), n.astype(np.int64), known.astype(np.int64), tail.astype(np.int64), base, rest, value / np.log(10), none, none, none])


def _rare_rows(t: Tokens, at: np.ndarray, path: np.ndarray, ids: list, of: list):
    """Rows of the tokens ``at``, added up by text and word."""
    found: dict[tuple[int, bytes], list] = {}
    for text, k, p in zip(np.searchsorted(t.ends, at, "right").tolist(), at.tolist(), path.tolist(), strict=True):
        row = found.setdefault((text, t.flat[k]), [0, 0.0])
        row[0] += 1
        row[1] += p
    rows = list(found.items())
    for k in range(0, len(rows), 50_000):
        part = rows[k : k + 50_000]
        none = pa.nulls(len(part))
        yield rows_of(SCORED, [[ids[x] for (x, _), _ in part], [of[x] for (x, _), _ in part], *([none] * 7), [w for (_, w), _ in part], [n for _, (n, _) in part], [p / np.log(10) for _, (_, p) in part]])


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = crc32_mod("doc_id", 10) == 0 if held_out is None else held_out
    train = rows.where(~out)
    counts = stage(word_counts(train.select("text")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = frequent(counts, KNOWN)
    ends = counts.where(F.col("word") == F.lit(bytearray(END))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lexicon = Lexicon(known, total, distinct, ends, leaf_sums(counts, depth_of(distinct)))
    weights = trained(train, F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)), lexicon)
    sent = spark.sparkContext.broadcast((lexicon, *weights))
    both = stage(map_batches(rows.select("doc_id", out, "text"), _score_batches, SCORED, sent), "lm-scored")
    scored = both.where("word IS NULL").drop("word", "n", "path")
    # rare words meet their counts; a text that is there m times brings each of them m times
    rare = both.where("word IS NOT NULL").select("word", "doc_id", "of", "n", "path").join(counts.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    seen = lambda c: F.sum(F.when(F.col("c") > 0, F.col(c)).otherwise(0))
    rare = rare.groupBy("doc_id", "of").agg(seen("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + ALPHA)).alias("more"), seen("path").alias("more_path"))
    times = scored.groupBy("doc_id", "of").agg(F.count("*").alias("m"))
    rare = rare.join(times, rare["doc_id"].eqNullSafe(times["doc_id"]) & (rare["of"] == times["of"])).select(rare["doc_id"].alias("_id"), rare["of"].alias("_of"), (F.col("more_known") / F.col("m")).cast("long").alias("more_known"), (F.col("more") / F.col("m")).alias("more"), (F.col("more_path") / F.col("m")).alias("more_path"))
    done = scored.join(rare, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_of")), "left")
    more = F.coalesce("more", F.lit(0.0))
    return done.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(lexicon.base)).alias("base_score"),
        (F.col("model") + F.col("tail") + more + F.coalesce("more_path", F.lit(0.0)) - F.col("n_tail") * F.lit(lexicon.tail)).alias("score"),
    )


@query("op6_maxent")
def op6_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
