"""Packing: every id once and in order, and rows as best-fit-decreasing fills them."""

import random

import numpy as np
import pytest

from tests.llm.conftest import SF
from tremor.llm import packing

DOCS = "doc_id long, text string, ids string, positions string"


def plain_best_fit(lengths, width):
    rows, left = [], []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [r for r in range(len(rows)) if left[r] >= lengths[k]]
        if fits:
            r = min(fits, key=lambda r: left[r])
        else:
            r = len(rows)
            rows.append([])
            left.append(width)
        rows[r].append(k)
        left[r] -= lengths[k]
    return rows


@pytest.mark.parametrize("width, n", [(1, 5), (16, 200), (100, 400), (128, 300)])
def test_rows_are_filled_by_best_fit(width, n):
    rng = random.Random(width)
    lengths = [rng.randint(1, width) for _ in range(n)]
    fill = lambda rows: sorted(sorted(lengths[k] for k in r) for r in rows)
    assert len(packing.best_fit_decreasing(lengths, width)) == len(plain_best_fit(lengths, width))
    assert sorted(sum(r) for r in fill(packing.best_fit_decreasing(lengths, width))) == sorted(sum(r) for r in fill(plain_best_fit(lengths, width)))


def unpacked(rows, width):
    """Ids of each document, after checks of every row."""
    found = {}
    for r in rows:
        ids, pos = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
        ends = r["cu_seqlens"]
        assert len(ids) == len(pos) == width and ends[0] == 0 and ends[-1] <= width and len(ends) == len(r["doc_ids"]) + 1
        assert not ids[ends[-1] :].any() and not pos[ends[-1] :].any()
        for i, s, a, b in zip(r["doc_ids"], r["doc_starts"], ends, ends[1:], strict=False):
            assert (pos[a:b] == np.arange(b - a)).all() and b > a
            found.setdefault(i, []).append((s, ids[a:b].tolist()))
    return found


def want(text):
    encode, end = packing.encoder(*packing.vocabulary())
    return [*encode(text or ""), end]


def test_supplied_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, *packing.vocabulary()).collect()
    found = unpacked(rows, packing.WIDTH)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert found.keys() == texts.keys()
    for i, pieces in found.items():
        pieces.sort()
        assert [t for _, p in pieces for t in p] == want(texts[i]) and [s for s, _ in pieces] == list(np.cumsum([0] + [len(p) for _, p in pieces[:-1]]))
    assert sum(r["cu_seqlens"][-1] for r in rows) / (len(rows) * packing.WIDTH) > 0.95
    assert packing.op4_packing(spark, SF).count() == len(rows)


def test_odd_rows(frame):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x " * 20_000), (4, "same"), (4, "same"), (5, "é ü 日本")]
    got = unpacked(packing.pack(frame([(i, t, "i", "p") for i, t in rows], DOCS, 1), *packing.vocabulary(), 64, 4).collect(), 64)
    assert got[1] == got[2] == [(0, want(""))] and got[4] == [(0, want("same"))] * 2
    assert [t for _, p in sorted(got[3]) for t in p] == want("x " * 20_000) and got[None] == [(0, want("a b"))]
    assert packing.pack(frame([], DOCS), *packing.vocabulary()).collect() == []
