"""Lattice dedup and exact top-k against plain comparison of all pairs."""

import math

import duckdb
import numpy as np
import pytest

from check import normal
from tests.llm.conftest import SF
from tremor.llm import embed_dedup, topk

VECTORS = "vec_id long, embedding array<float>, label int, n long, v string, key string, cid string"


def rows_at(cosine, n=400, dim=64, seed=5):
    """n random vectors, and one partner of each at the given cosine."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1)[:, None] * x
    g /= np.linalg.norm(g, axis=1)[:, None]
    return x, cosine * x + math.sqrt(1 - cosine * cosine) * g


@pytest.mark.parametrize("fn, sql", [(embed_dedup.op2_lattice_dedup, embed_dedup.SQL), (topk.op7_topk, topk.SQL)])
def test_equals_sql(spark, fn, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    a, b = normal(fn(spark, SF).toPandas()), normal(con.execute(sql).df())
    assert a.equals(b[a.columns]), (a, b)


def test_recall_at_the_threshold():
    x, y = rows_at(0.9501, 3000)
    a, b = embed_dedup.lattice_cells(x), embed_dedup.lattice_cells(y)
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() > 0.98


def test_lattice_points_are_in_the_lattice():
    points, d = embed_dedup.nearest_points(np.random.default_rng(0).normal(size=(200, 8)) * 3)
    p = points / 2
    assert ((points % 2 == points[:, :, :1] % 2).all() and (p.sum(2) % 2 == 0).all())
    near = d.min(1)
    assert (near <= 1 + 1e-9).all()  # the covering radius


def plain_groups(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ok:
        for b in ok:
            u, v = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
            if a < b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.95:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    out = []
    for i, (k, _) in enumerate(rows):
        low = min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None)
        out.append((k, links[i], low, k == low))
    return sorted(out, key=str)


def test_groups_of_odd_rows(frame, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CHUNK", 16)
    x, y = rows_at(0.97, 30, 16)
    rng = np.random.default_rng(9)
    close = [(x[0] + rng.normal(size=16) * 0.02).tolist() for _ in range(60)]
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *y])] + [(100 + i, v) for i, v in enumerate(close)]
    rows += [(200 + i, x[1].tolist()) for i in range(40)] + [(300, (x[1] * 3).tolist()), (300, (x[1] * 3).tolist())]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None, 1.0]), (405, [1.0]), (406, [2.0]), (407, [float("inf")] * 16), (None, None), (None, [7.0])]
    found = embed_dedup.embedding_groups(frame([(i, v, 1, 1, "v", "k", "c") for i, v in rows], VECTORS))
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found.collect()), key=str) == [(*r[:3], r[3]) for r in plain_groups(rows)]


def test_no_groups_of_no_rows(frame):
    assert embed_dedup.embedding_groups(frame([], VECTORS)).collect() == []


def plain_top(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * float(np.float32(x))) for x in v]
            ok[i] = min(w, ok.get(i, w))
    out = []
    for q in ok:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(ok[q], ok[c], strict=False)), c) for c in ok if c != q)[:k]
            out += [(q, r + 1, c, -x) for r, (x, c) in enumerate(s)]
    return sorted(out)


def top_of(frame, rows, parts=3):
    v = topk.whole_vectors(frame([(i, v, 1, 1, "v", "k", "c") for i, v in rows], VECTORS, parts)).cache()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect())


def test_top_of_odd_rows(frame, monkeypatch):
    monkeypatch.setattr(topk, "CBLOCK", 32)
    monkeypatch.setattr(topk, "QBLOCK", 4)
    x, y = rows_at(0.9, 150, 12)
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *y])] + [(1000 + i, x[0].tolist()) for i in range(40)] + [(1000 + i, (-x[0]).tolist()) for i in range(60, 70)]
    rows += [(2000, None), (2050, []), (2100, [0.0] * 12), (2150, [float("nan")]), (2200, [None]), (2250, [5.0]), (50, [9.0]), (None, [1.0]), (2300, (-x[3] * 2).tolist())]
    assert top_of(frame, rows) == plain_top(rows)


def test_top_with_few_candidates(frame):
    assert top_of(frame, []) == []
    rows = [(0, [-1.0, 2.0]), (50, [-1.0, -2.0]), (3, [-3.0, -3.0])]
    assert top_of(frame, rows) == plain_top(rows)


def test_groups_of_two_lengths_are_not_cut(spark, frame):
    rng = np.random.default_rng(11)
    rows = []
    for dim in (16, 64):
        x = rng.normal(size=(8, dim))
        rows += [(len(rows) + k, [float(v) for v in x[k % 8] + rng.normal(scale=0.01, size=dim)]) for k in range(160)]
    old, parts = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = {r["vec_id"]: r["n_links"] for r in embed_dedup.embedding_groups(frame(rows, "vec_id long, embedding array<float>")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert set(found.values()) == {19}
