"""Hard negatives against plain comparison of all pairs."""

import duckdb
import numpy as np
import pytest

from check import normal
from tests.llm.conftest import SF
from tremor.llm import hard_negatives as hn

VECTORS = "vec_id long, label int, embedding array<double>, v string, score long, share int"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    a, b = normal(hn.op12_hard_negatives(spark, SF).toPandas()), normal(con.execute(hn.SQL).df())
    assert len(a) and a.equals(b[a.columns])


def plain(rows, anchors, positives, negatives, low, high):
    out = []
    for a, la, va in rows:
        if a not in anchors:
            continue
        scored = sorted((-int(va @ v), i, label) for i, label, v in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            fine = [x for x in scored if x[2] != la and low * -s <= 100 * -x[0] <= high * -s]
            out += [(a, p, k + 1, i, -s, -x) for k, (x, i, _) in enumerate(fine[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("size, lengths", [(2048, "one"), (16, "many"), (7, "many")])
def test_equals_plain(spark, frame, monkeypatch, size, lengths):
    monkeypatch.setattr(hn, "BUCKET", size)
    monkeypatch.setattr(hn, "BLOCK", 5)
    rng = np.random.default_rng(size)
    centre = rng.normal(size=(4, 6))
    v = centre[rng.integers(0, 4, 300)] + 0.4 * rng.normal(size=(300, 6))
    v *= (rng.lognormal(0, 1, 300) if lengths == "many" else 1 / np.linalg.norm(v, axis=1))[:, None] if lengths == "many" else 1
    v[:30] = v[0]  # a hot vector, under several labels
    v[30:33] = 0
    whole = np.floor(256 * v).astype(np.int64)
    labels = rng.integers(0, 4, 300)
    df = frame([(i, int(labels[i]), [float(x) for x in v[i]], "v", 1, 2) for i in range(300)], VECTORS)
    vectors = hn.labelled_vectors(df, "vec_id", df.label, "embedding").cache()
    got = hn.hard_negatives(vectors, vectors.where("vec_id % 10 = 0"), 3, 4)
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())
    assert got == plain([(i, int(labels[i]), whole[i]) for i in range(300)], set(range(0, 300, 10)), 3, 4, 30, 90)


@pytest.mark.parametrize("spread, most", [(1.0, 500), (0.02, 50)])
def test_feasible_ranges_lose_nothing(spread, most):
    rng = np.random.default_rng(1)
    cells = rng.normal(size=(500, 8))
    cells = np.floor(1000 * cells / np.linalg.norm(cells, axis=1)[:, None] * rng.lognormal(0, spread, size=(500, 1))).astype(np.int64)
    lists = np.argsort(hn._units(cells)[1], axis=0, kind="stable").T.astype(np.int16)
    ids = np.arange(500)
    bucket = hn.Bucket(ids.tobytes(), ids.tobytes(), cells.tobytes(), lists.tobytes())
    kept = []
    for a in range(0, 500, 5):
        scores = cells @ cells[a]
        for low, high in ((scores.max() * 0.4, scores.max()), (0, scores.max() / 3), (-scores.max(), -10), (scores.max() * 0.9, scores.max())):
            got = bucket.feasible(cells[a], float(np.sqrt(cells[a] @ cells[a])), low, high)
            want = set(np.flatnonzero((scores >= low) & (scores <= high)))
            assert got is None or want <= set(got.tolist())
        kept.append(500 if got is None else len(got))
    assert np.mean(kept) < most  # of vectors alike in length most are passed over


def test_odd_rows(frame):
    inf = float("inf")
    rows = [(None, 1, [1.0, 1.0], "", 1, 1), (1, None, [1.0, 1.0], "", 1, 1), (2, 1, None, "", 1, 1), (3, 1, [1.0, None], "", 1, 1), (4, 1, [inf, 1.0], "", 1, 1), (5, 1, [], "", 1, 1)]
    rows += [(100, 1, [1.0, 0.0], "", 1, 1), (100, 1, [1.0, 0.0], "", 1, 1), (101, 1, [1.0], "", 1, 1), (102, 2, [0.5, 9.0, 3.0], "", 1, 1), (103, 2, [0.5, 9.0], "", 1, 1), (104, 2, [2.0], "", 1, 1)]
    df = frame(rows, VECTORS)
    vectors = hn.labelled_vectors(df, "vec_id", df.label, "embedding")
    got = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in hn.hard_negatives(vectors, vectors.where("vec_id = 100")).orderBy("positive_id", "rank").collect()]
    # the second positive is the empty vector of score 0, and no negative has score 0
    assert got == [(100, 101, 1, 102, 65536, 32768), (100, 101, 2, 103, 65536, 32768)]
    empty = frame([], VECTORS)
    none = hn.labelled_vectors(empty, "vec_id", empty.label, "embedding")
    assert hn.hard_negatives(none, none).count() == 0
