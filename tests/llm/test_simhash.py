"""Fingerprints and components against plain comparison of all pairs."""

import re

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import SF
from tremor.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, component_id long"


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    low = {r: min((ids[i] for i in g if ids[i] is not None), default=None) for r, g in groups.items()}
    return [low[find(i)] for i in range(len(ids))]


def check(found, rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], plain_components([r[0] for r in rows], fps), strict=True), key=str)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found.collect()), key=str) == want


def test_supplied_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(simhash.op10_simhash(spark, SF), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(frame):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "two words"), (7, "é É ß"), (7, "é É ß"), (None, "one"), (None, "alone here now"), (9, "x " * 50_000)]
    docs = frame([(i, t, None, None, None, 5, "k", 1) for i, t in rows], DOCS)
    check(simhash.simhash_groups(docs), rows)


def test_empty_table(frame):
    assert simhash.simhash_groups(frame([], DOCS)).collect() == []


def test_large_group_is_cut_into_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1, 2**62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))} | {int(x) for x in rng.integers(0, 2**63, 200)}
    ids = list(range(len(fps)))
    signed = np.array(list(fps), np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "CHUNK", 64)
    found = simhash.near_components(spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long")).collect()
    want = dict(zip(ids, plain_components(ids, list(fps)), strict=True))
    assert {r["doc_id"]: r["component_id"] for r in found} == want


@pytest.mark.parametrize("radius", [1, 3])
def test_near_finds_all_pairs(radius):
    rng = np.random.default_rng(radius)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    x[150:] = x[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    x = np.unique(x)
    a, b = simhash.near(x, radius=radius)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if (int(x[i]) ^ int(x[j])).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    a, b = simhash.near(x[:100], x[100:], radius)
    assert {(i, j + 100) for i, j in zip(a.tolist(), b.tolist(), strict=True)} == {(i, j) for i, j in want if i < 100 <= j}
