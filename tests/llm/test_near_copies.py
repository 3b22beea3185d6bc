"""Groups of near copies against Jaccard of five-word shingles over all pairs."""

import re

import numpy as np
import pytest

from tests.llm.conftest import SF
from tremor.llm import near_copies as nc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cls long, sig string, key string, component_id long"


def plain_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def plain_groups(rows):
    """Smallest id of each row's component."""
    sets = [plain_shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    low = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            low[x] = min(low.get(x, i), i)
    return [low.get(x) for x in label]


def check(docs, rows):
    got = sorted(((r["doc_id"], r["component_id"]) for r in nc.near_copies(docs).collect()), key=str)
    assert got == sorted(zip([i for i, _ in rows], plain_groups(rows), strict=True), key=str)


def edited(rng, base, share):
    """A copy of the words with runs replaced, so that about ``share`` of five-word windows stay."""
    out = list(base)
    for at in rng.choice(len(out) // 5, round((1 - share) / (1 + share) * len(out) / 5), replace=False):
        out[5 * at] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def test_supplied_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(frame):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "two words"), (7, "\u00e9 \u00c9 \u00df"), (7, "\u00e9 \u00c9 \u00df"), (None, "one"),
            (None, "alone here now"), (None, "one two three four five six seven"), (None, "one two three four five six seven"), (9, "x " * 50_000), (10, "y " * 9)]
    check(frame([(i, t, None, None, None, 5, "s", "k", 1) for i, t in rows], DOCS), rows)


def test_null_ids_are_linked(frame):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    rows = [(None, " ".join(base)), (None, edited(rng, base, 0.95)), (8, edited(rng, base, 0.95)), (None, "something else")]
    check(frame([(i, t, None, None, None, 5, "s", "k", 1) for i, t in rows], DOCS), rows)


def test_empty_table(frame):
    assert nc.near_copies(frame([], DOCS)).collect() == []


def test_recall_near_the_threshold(frame):
    """60 pairs a little above 0.8 and 60 a little below: all the upper are found, no lower one."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(120):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, edited(rng, base, 0.81 if k < 60 else 0.77))]
    low = plain_groups(rows)
    assert sum(a != b for a, (b, _) in zip(low, rows, strict=True)) == 60
    got = {r["doc_id"]: r["component_id"] for r in nc.near_copies(frame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i, _ in rows[120:])
    assert sum(got[i] != i for i, _ in rows[:120]) >= 58


def test_one_large_group_is_cut_and_spread(frame, monkeypatch):
    monkeypatch.setattr(nc, "CHUNK", 64)
    monkeypatch.setattr(nc, "SPREAD", 16)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    rows = [(i, edited(rng, base, 0.93)) for i in range(400)] + [(1000 + i, " ".join(f"v{x}" for x in rng.integers(0, 10**6, 60))) for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in nc.near_copies(frame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 400 else i for i, _ in rows}


@pytest.mark.parametrize("n", [70, 300])
def test_near_and_forest(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 2**64, (n, nc.COMPARED // 64), np.uint64)
    x[n // 2 :] = x[: n - n // 2]
    for i in range(n // 2, n):
        for bit in rng.permutation(nc.COMPARED)[: rng.integers(1, 50)]:
            x[i, bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    apart = np.bitwise_count(x[:, None, :] ^ x[None, :, :]).sum(2, dtype=np.int64)
    want = {(i, j): int(apart[i, j]) for i in range(n) for j in range(i + 1, n) if apart[i, j] <= nc.RADIUS}
    a, b, d = nc.near(x)
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), d.tolist(), strict=True)) == want
    a, b, d = nc.near(x[:40], x[40:])
    assert dict(zip(zip(a.tolist(), (b + 40).tolist(), strict=True), d.tolist(), strict=True)) == {k: v for k, v in want.items() if k[0] < 40 <= k[1]}

    a, b = (v.ravel() for v in np.triu_indices(n, 1))
    d = rng.integers(0, 50, len(a))
    keep = nc.forest(n, a, b, d)
    # a plain shortest tree, edge by edge
    label, total = list(range(n)), 0
    for e in np.lexsort((b, a, d)):
        if label[a[e]] != label[b[e]]:
            old, new = label[a[e]], label[b[e]]
            label, total = [new if v == old else v for v in label], total + d[e]
    assert len(keep) == n - 1 and d[keep].sum() == total
