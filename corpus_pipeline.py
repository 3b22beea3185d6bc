"""The corpus pipeline: documents through the stages in order, each written and read again.

1. language: rows whose language is unknown or unsure go, and rows
whose n-grams are unlike those of their best language.  2. near-duplicates: one document of each
group stays.  3. repeated passages: every repeat of a 100-byte string is cut out of the texts.
4. mixing: each document is there as often as the target weights of the sources ask for.
5. encoding: token counts and digests of ids and decoded texts.

A doc_id names a document: rows that repeat one stay or go together. Null ids and texts follow the
definitions of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import bpe, langid, mixing, near_copies, repeats
from tremor.llm.common import stage, table

#: Least posterior of the predicted language for a document to stay.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; the labels learned from are those of the input itself."""
    return langid.known(docs, SURE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of five-word shingles alike at 0.8 or more."""
    return docs.join(near_copies.repeated_documents(docs), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with what is left of their texts; all rows stay."""
    return repeats.without_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its rounded rate says; documents with no copy go."""
    return mixing.repeat_rows(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, bpe.vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("encoding", encoding)]

#: Trained and hashed stages have no SQL; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
