"""Operator 9: language identification by multinomial naive Bayes over hashed character n-grams.

Fit: n-grams of all labelled rows are counted in numpy inside the tasks, one (language, bucket) matrix for each
partition, and only its non-zero cells are shuffled and summed. The log-probability matrix has
languages x ``BUCKETS`` cells, so what is collected and broadcast is bounded by the number of
labels. Predict: each text becomes a sparse vector of bucket counts, multiplied with the rows of
the matrix that it hits; nothing is shuffled.

Defined results: a text that is null or has no letter gets ``und`` with score 0, as does every
text when nothing could be learned; rows with a null label are not learned from; a null id counts
as the empty text in the held-out rule; repeated rows and null ids give one row each; ties go to
the label that sorts first; other columns are not read, and kept columns that are called like a
result are replaced by it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.llm.common import crc32_mod, map_batches, rows_of, table
from tremor.llm.registry import query

#: Hash buckets of the n-grams of all orders together.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Labels at most, so that the matrix stays below 64 MB; more are refused.
MOST_LABELS = 256
ALPHA = 0.5
UNKNOWN = "und"
#: Known text: its mean log-likelihood per n-gram under the best label is at most so many nats, or so many
#: spreads of that label's rows, below their median; in a short text single n-grams vary by NOISE / sqrt(n) more.
MARGIN, SPREADS, NOISE = 2.0, 10.0, 12.0
#: Decimals of a log-likelihood, so that the distinct values under a label are bounded whatever the rows.
PLACES = 4

_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray | None:
    """Buckets of all n-grams of a text, one for each occurrence; None if it has no letter.

    Letters are lower-cased; everything else counts as a blank, runs of blanks as one.
    """
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint32(32))
    code = code[letter | np.r_[True, letter[:-1]]].astype(np.uint64)
    if code[0] != 32:
        code = np.r_[np.uint64(32), code]
    if code[-1] != 32:
        code = np.r_[code, np.uint64(32)]
    found, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(code) - n + 1] + code[n - 1 :]) * _MIX
        if n in ORDERS:
            found.append((h ^ h >> np.uint64(29)) * _MIX >> np.uint64(64 - 15))
    return np.concatenate(found).astype(np.int64)


def _bag(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their counts."""
    if len(buckets) < BUCKETS // 16:
        return np.unique(buckets, return_counts=True)
    n = np.bincount(buckets, minlength=BUCKETS)
    hit = np.flatnonzero(n)
    return hit, n[hit]


CELLS = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])


def _count_batches(batches, labels: list[str]):
    index = {v: k for k, v in enumerate(labels)}
    cells = np.zeros((len(labels), BUCKETS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            if (b := ngrams(text.as_py())) is not None:
                cells[index[label.as_py()]] += np.bincount(b, minlength=BUCKETS)
    row, bucket = np.nonzero(cells)
    for at in range(0, len(row), 50_000):
        part = slice(at, at + 50_000)
        yield rows_of(CELLS, [row[part], bucket[part], cells[row[part], bucket[part]]])


def _labelled(df: DataFrame, text_col: str, label_col: str) -> tuple[DataFrame, dict[str, int]]:
    """(text, label) of all rows with a label, and the rows that each label has."""
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("label is not null")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: the matrix that goes to every task would not be bounded")
    return rows, sizes


def fit(train: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(labels, log-probability matrix buckets x labels, log priors) from rows with a label."""
    rows, sizes = _labelled(train, text_col, label_col)
    labels = sorted(sizes)
    if not labels:
        return [], np.zeros((BUCKETS, 0)), np.zeros(0)
    n = np.zeros((BUCKETS, len(labels)))
    got = map_batches(rows, _count_batches, CELLS, labels).groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    n[got["bucket"], got["label"]] = got["n"]
    log = np.log(n + ALPHA) - np.log(n.sum(0) + ALPHA * BUCKETS)
    prior = np.array([sizes[v] for v in labels], float)
    return labels, log, np.log(prior / prior.sum())


def _scored(text: str | None, labels: list[str], log: np.ndarray, prior: np.ndarray) -> tuple[str, float, float, int]:
    """Best label, its posterior, the mean log-likelihood per n-gram under it, and the number of n-grams."""
    b = ngrams(text) if labels else None
    if b is None:
        return UNKNOWN, 0.0, 0.0, 0
    hit, n = _bag(b)
    score = n @ log[hit] + prior
    best = int(score.argmax())
    return labels[best], float(1 / np.exp(score - score[best]).sum()), float((score[best] - prior[best]) / len(b)), len(b)


def predict_one(text: str | None, labels: list[str], log: np.ndarray, prior: np.ndarray) -> tuple[str, float]:
    return _scored(text, labels, log, prior)[:2]


def _predict_batches(batches, schema: T.StructType, text_at: int, own: bool, model):
    labels, log, prior = model.value
    for batch in batches:
        pairs = [predict_one(t.as_py(), labels, log, prior) for t in batch.column(text_at)]
        kept = batch.columns[:-1] if own else batch.columns
        yield rows_of(schema, [*kept, [p[0] for p in pairs], [p[1] for p in pairs]])


def predict(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of each row, then lang_pred and score."""
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    own = text_col not in keep
    rows = df.select(*keep, *([F.col(text_col)] if own else []))
    at = len(keep) if own else keep.index(text_col)
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_batches(rows, _predict_batches, schema, schema, at, own, df.sparkSession.sparkContext.broadcast(model))


FITS = T.StructType([T.StructField("label", T.StringType()), T.StructField("fit", T.DoubleType())])


def _fit_batches(batches, model):
    """Mean log-likelihood per n-gram of the rows whose label is the best one."""
    labels, log, prior = model.value
    for batch in batches:
        found = [(v.as_py(), _scored(t.as_py(), labels, log, prior)) for t, v in zip(batch.column(0), batch.column(1), strict=True)]
        found = [(v, x[2]) for v, x in found if v == x[0] and x[3]]
        yield rows_of(FITS, [[v for v, _ in found], [x for _, x in found]])


def typical(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text", label_col: str = "lang") -> dict[str, tuple[float, float]]:
    """For each label (median, median less the 16th percentile) of its rows' log-likelihood per n-gram: rows of odd texts under a label move neither."""
    rows, _ = _labelled(docs, text_col, label_col)
    fits = map_batches(rows, _fit_batches, FITS, docs.sparkSession.sparkContext.broadcast(model))
    return {r["label"]: (r["q"][1], r["q"][1] - r["q"][0]) for r in fits.groupBy("label").agg(F.percentile(F.round("fit", PLACES), F.array(F.lit(0.16), F.lit(0.5))).alias("q")).collect()}


def is_known(found: tuple[str, float, float, int], usual: dict[str, tuple[float, float]], sure: float) -> bool:
    """Whether a scored text has a label, a posterior of at least ``sure``, and n-grams as its label's rows have them."""
    label, posterior, each, n = found
    if not n or posterior < sure or label not in usual:
        return False
    middle, spread = usual[label]
    return middle - each <= np.hypot(max(MARGIN, SPREADS * spread), NOISE / np.sqrt(n))


def _known_batches(batches, schema: T.StructType, text_at: int, sent, sure: float):
    model, usual = sent.value
    for batch in batches:
        kept = [is_known(_scored(t.as_py(), *model), usual, sure) for t in batch.column(text_at)]
        yield rows_of(schema, batch.filter(pa.array(kept, pa.bool_())).columns)


def known(docs: DataFrame, sure: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is of a learned language.

    The posterior of a whole text only compares the labels with one another and is close to 1 for any
    text; the likelihood of its n-grams tells whether the best of them fits.
    """
    model = fit(docs.where(crc32_mod("doc_id", 3) != 1))
    sent = docs.sparkSession.sparkContext.broadcast((model, typical(docs, model)))
    return map_batches(docs, _known_batches, docs.schema, docs.schema, docs.columns.index(text_col), sent, sure)


def identify(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Fitted on the rows of ``docs`` that are not held out, applied to all of them."""
    return predict(docs, fit(docs.where(crc32_mod("doc_id", 3) != 1)), keep)


@query("op9_langid")
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, ["doc_id"]).select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
