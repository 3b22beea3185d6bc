"""Ids and decoded texts against the tokenizers library."""

import hashlib
import random

import pytest

from tests.llm.conftest import SF
from tremor.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id long, text string, ids string, n_tokens string"
ODD = [None, "", " \t", "\x1ca\x1db", "don't I'll ΣΑΣ İ 123 ½ ²³", "<|endoftext|>x<|startoftext|> <|endoftext|", "é ́a x y　z", "a" * 500 + "the" * 900,
       "日本語テキスト 😀😀 ǅ", "ẞ ﬀ", "x_y __ -- ... !!!'s's", "word " * 30_000, "étude É"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary())


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_supplied_documents(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op1_bpe(spark, SF).collect()}
    assert found == {i: want(library, t) for i, t in texts.items()}


def test_odd_rows(frame, library):
    rows = list(enumerate(ODD)) + [(None, "a b"), (3, ODD[3])]
    docs = frame([(i, t, "i", "n") for i, t in rows], DOCS)
    found = sorted((tuple(r) for r in bpe.digests(docs, bpe.vocabulary()).collect()), key=str)
    assert found == sorted(((i, *want(library, t)) for i, t in rows), key=str)
    coded = bpe.encode(docs, bpe.vocabulary())
    ids = {r["doc_id"]: r["ids"] for r in coded.collect()}
    assert ids[4] == library.encode(ODD[4], add_special_tokens=False).ids and ids[0] == []
    back = {r["doc_id"]: r["text"] for r in bpe.decode(coded, bpe.vocabulary()).collect()}
    assert back[5] == library.decode(library.encode(ODD[5], add_special_tokens=False).ids, skip_special_tokens=False)


def test_small_cache_and_empty_table(frame, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    tok = bpe.Tokenizer(bpe.vocabulary())
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé '12!") for _ in range(200)) for _ in range(30)]
    for t, (ids, _) in zip(texts * 2, [x for t in texts * 2 for x in tok.written([t])], strict=True):
        assert ids == " ".join(map(str, library.encode(t, add_special_tokens=False).ids))
    assert bpe.digests(frame([], DOCS), bpe.vocabulary()).collect() == []


@pytest.mark.parametrize("n", [2, 30, 64, 65, 400])
def test_both_merges_agree(n):
    tok = bpe.Tokenizer(bpe.vocabulary())
    rng = random.Random(n)
    words = ["".join(rng.choice("etaoinshr") for _ in range(n)).encode() for _ in range(20)]
    assert [tok.merge_long(w) for w in words] == tok.merge_short(words)
