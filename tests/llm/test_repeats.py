"""Removed bytes against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import SF
from tremor.llm import repeats

DOCS = "doc_id long, text string, id long, row string, runs string, n_chars long"


def plain(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of rows with unique ids."""
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            if first.setdefault(raw[s : s + length], (i, s)) != (i, s):
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out.append((i, len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_supplied_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(repeats.op8_repeats(spark, SF)) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def odd_rows():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [word(rng.choice([60, 100, 101, 140, 400])) for _ in range(12)]
    rows = [(i, "".join(rng.choice([word(30), word(5), rng.choice(shared)]) for _ in range(rng.randrange(12)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "a" * 5000), (203, "ab" * 3000), (204, "a" * 99), (205, "a" * 100), (None, shared[3] * 2), (-5, shared[4])]


@pytest.mark.parametrize("most, part", [(4096, 1 << 20), (3, 700)])
def test_odd_rows(frame, monkeypatch, most, part):
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "PART", part)
    rows = odd_rows()
    assert got(repeats.digests(frame([(i, t, 1, "r", "x", 0) for i, t in rows], DOCS))) == plain(rows)


def test_repeated_ids(frame):
    rng = random.Random(8)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (300, 301))
    rows = [(1, a), (1, a), (1, b), (2, b), (3, "new " + a)]
    found = {}
    for r in repeats.digests(frame([(i, t, 1, "r", "x", 0) for i, t in rows], DOCS)).collect():
        found.setdefault((r["doc_id"], r["n_bytes"]), []).append(r["n_removed"])
    assert found == {(1, 300): [0, 0], (1, 301): [0], (2, 301): [301], (3, 304): [300]}


def test_many_texts_under_one_id(frame):
    # every pair of texts under the null id shares 124 bytes, and no two are taken for one document
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    shared = [text(124) for _ in range(2500)]
    rows = [(None, s + text(40)) for s in shared] + [(None, text(40) + s) for s in shared] + [(7, shared[0])] + [(None, "same " * 50)] * 200
    out = repeats.digests(frame([(i, t, 1, "r", "x", 0) for i, t in rows], DOCS, 4)).collect()
    pairs = [r for r in out if r.n_bytes == 164]
    assert len(pairs) == 5000 and sorted(r.n_removed for r in pairs)[:2499] == [0] * 2499
    assert sum(r.n_removed == 124 for r in pairs) >= 2499 and all(r.doc_id is None for r in pairs)
    # id 7 comes before the null id, so both texts with the first passage lose it
    assert sum(r.n_removed > 0 for r in pairs) == 2501 and next(r.n_removed for r in out if r.doc_id == 7) == 0
    # copies of one row are one document: the same result on each
    assert {r.n_removed for r in out if r.n_bytes == 250} == {245} and sum(r.n_bytes == 250 for r in out) == 200


def test_texts_left(frame):
    p = "".join(chr(97 + i * 7 % 26) + chr(98 + i * i % 23) for i in range(80))
    docs = frame([(1, p + " tail", 1, "r", "x", 165), (2, "é" + p + "ü", 2, None, "y", 162), (3, None, 3, "z", None, None)], DOCS)
    left = {r["doc_id"]: r for r in repeats.without_repeats(docs).collect()}
    assert left[1]["text"] == p + " tail" and left[2]["text"] == "éü" and left[2]["n_chars"] == 2 and left[3]["text"] is None
    assert left[2]["id"] == 2 and repeats.without_repeats(docs).columns == docs.columns


def test_empty_table(frame):
    assert got(repeats.digests(frame([], DOCS))) == []
