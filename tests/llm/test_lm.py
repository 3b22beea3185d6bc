"""Maximum-entropy scores: exact counts and base, a proper distribution, and gain on held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import SF
from tremor.llm import lm

DOCS = "doc_id long, text string, n long, word string, score string, c long"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def plain(rows):
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    out = []
    for i, x in rows:
        t = tokens(x)
        out.append((i, held(i), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)))
    return sorted(out, key=str)


def check(found, rows):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found), key=str)
    for a, b in zip(got, plain(rows), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r["score"] <= 1e-6 for r in found)


def test_supplied_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 2000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lm.op6_maxent(spark, "/root/testdata/sf0.01").collect()
    check(found, [(r["doc_id"], r["text"]) for r in docs.collect()])
    out = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_odd_rows(frame):
    rows = [(i, "the cat sat on the mat " * (i % 4)) for i in range(40)] + [(None, None), (101, ""), (102, "rare words HERE"), (102, "rare words HERE"), (102, "other words"), (103, "the cat " * 40_000), (104, "unseen\u00a0é")]
    check(lm.scores(frame([(i, t, 1, "w", "s", 2) for i, t in rows], DOCS)).collect(), rows)


def test_nothing_to_learn(frame):
    assert lm.scores(frame([], DOCS)).collect() == []
    i = next(i for i in range(100) if held(i))
    (r,) = lm.scores(frame([(i, "a b", 1, "w", "s", 2)], DOCS)).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_probabilities_sum_to_one(spark):
    counts = Counter({b"%d" % k: 5000 - k for k in range(1500)})
    counts[lm.END] = 9000
    lexicon = lm.Lexicon(counts.most_common(1200), sum(counts.values()), len(counts), 9000)
    docs = spark.createDataFrame([(" ".join(str((k * 7 + j) % 1500) for j in range(60)),) for k in range(80)], "text string")
    from pyspark.sql import functions as F

    weights = lm.trained(docs, F.lit(0), lexicon, 1)
    before = [b"3", b"77", b"1400"]
    places = [w for w, _ in counts.most_common(lm._TAIL * lm.SLOTS)]
    total = 0.0
    for w in places + [b"tail"]:
        t = lm.Tokens([[*before, w]], lexicon)
        a, b = map(lm._softmax, t.logits(weights))
        total += a[-1, t.cls[-1]] * (b[-1, t.slot[-1]] if t.place[-1] >= 0 else 1)
    assert total == pytest.approx(1, abs=1e-4)
    rest = [n for w, n in counts.items() if w not in places]
    assert sum((n + 0.1) / 10**lexicon.tail for n in [*rest, 0]) == pytest.approx(1)
    assert np.isfinite(weights[0]).all()


def test_words_of_the_last_class_follow_the_words_before(spark):
    """Each of 3,000 words comes after a word of its own, so what came before tells the rare ones too."""
    from pyspark.sql import functions as F

    counts = Counter({b"%d" % k: 2 for k in range(3000)})
    for k in range(40):
        counts[b"s%d" % k] = 5000
    counts[lm.END] = 9000
    leaves = np.zeros((2, 1 << lm.depth_of(len(counts))))
    for w, n in counts.items():
        leaf = int(lm._code(np.array([lm.zlib.crc32(w)]))[0]) >> 32 - lm.depth_of(len(counts))
        leaves[:, leaf] += n, 1
    found = spark.createDataFrame([(w, n) for w, n in counts.items()], "word binary, n long")
    assert (lm.leaf_sums(found, lm.depth_of(len(counts))) == leaves).all()
    lexicon = lm.Lexicon(counts.most_common(), sum(counts.values()), len(counts), 9000, leaves)
    rest = [w for w in counts if w not in lexicon.place]
    docs = spark.createDataFrame([(" ".join(f"s{int(w) % 40} {w.decode()}" for w in rest),)] * 20, "text string")
    weights = lm.trained(docs, F.lit(0), lexicon, 1)
    share = np.array([counts[w] + 0.1 for w in rest])

    def moved(before):
        t = lm.Tokens([[before, w] for w in rest], lexicon)
        return lexicon.tree.moved(t.code, t.step_rows, weights[2])[t.in_tail % 2 == 1]

    for before in (b"s3", b"s17", b"never"):
        assert (share * np.exp(moved(before))).sum() == pytest.approx(share.sum(), rel=1e-3)
    after = np.array([int(w) % 40 == 3 for w in rest])
    assert (moved(b"s3")[after] - moved(b"s17")[after]).mean() > 0.5
