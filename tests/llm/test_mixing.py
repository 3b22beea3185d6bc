"""Targets, rates and copies against a plain solution of the same problem."""

import math
import re
from collections import defaultdict

import pytest

from tests.llm.conftest import SF
from tremor.llm import mixing

DOCS = "doc_id long, text string, source string, target string, size string, v string"


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def check(found, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes)
    got = found.collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
        assert 0 <= r["n_copies"] <= 2
        taken[r["source"]] += r["n_copies"] * r["size"]
    most = {s: max([size(t) for _, t, x in rows if x == s]) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1, s


def test_supplied_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = mixing.mix(docs)
    check(found, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    assert sorted(found.collect()) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_odd_rows(frame):
    rows = [(i, "w " * (i % 7), "abc"[i % 3]) for i in range(200)] + [(None, None, None), (500, "x y", None), (501, "", "empty"), (502, "w " * 30_000, "a"), (503, "a b c", "Ä"), (504, "a b c", "\U0001F600")]
    check(mixing.mix(frame([(*r, "t", "s", "v") for r in rows], DOCS)), rows)


def test_empty_table(frame):
    assert mixing.mix(frame([], DOCS)).collect() == []
    assert mixing.mix(frame([(1, None, "a", None, None, None)], DOCS).select("doc_id", "text", "source")).collect()[0]["n_copies"] == 0


def test_rates_are_tilted_by_tokens(spark):
    sizes = spark.createDataFrame([("a", s, n) for s, n in ((1, 50), (5, 30), (20, 10))], "source string, size long, n long")
    total = 50 + 150 + 200
    for target in (0.3 * total, 1.0 * total, 1.4 * total, 1.9 * total):
        wanted = spark.createDataFrame([("a", total, target)], "source string, source_size long, target double")
        (r,) = mixing.multipliers(sizes, wanted).collect()
        rate = lambda s: min(2.0, math.exp(r["lam"] * s / r["mean"]))  # noqa: E731, B023
        assert sum(n * s * rate(s) for s, n in ((1, 50), (5, 30), (20, 10))) == pytest.approx(target, rel=1e-8)


def test_copies_follow_the_source(spark):
    # one id and size under two sources whose rates differ
    rows = [(i % 300, "w " * (1 + i % 5), "ab"[i // 300], "n", i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, row long").repartition(3)
    wanted = {(r.doc_id, r.source): r.n_copies for r in mixing.mix(docs).collect()}
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
        assert (r.doc_id, r.text, r.source) == rows[r.row][:3]
    assert got == {k: n for k, n in wanted.items() if n} and max(got.values()) <= 2
