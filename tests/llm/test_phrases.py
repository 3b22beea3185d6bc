"""Phrases of FM-indexed shards against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from tremor.llm import phrases

DOCS = "doc_id long, text string, lang string, word string, n long, id int"


def plain(rows, least, longest, top):
    """The contract, word by word."""
    n, f = Counter(), Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *w), a in found.items():
        inside = lambda long: any(list(long[i : i + len(w)]) == w for i in range(len(long) - len(w) + 1))
        if any(q[0] == lang and len(q) - 1 > len(w) and b >= a and inside(q[1:]) for q, b in found.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in n:
        of = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, k + 1, *r[1:]) for k, r in enumerate(of[:top])]
    return sorted(ranked)


def collected(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def random_rows(seed, n=60, words=12):
    rng = np.random.default_rng(seed)
    ends = [" ", " ", " ", "\t", ". ", "\n", ", ", "  "]
    text = lambda: "".join(f"{w}{ends[e]}" for w, e in zip((f"W{x}ß" if x % 5 == 0 else f"w{x}" for x in (rng.zipf(1.4, 40) % words)), rng.integers(0, len(ends), 40), strict=True))
    return [(text(), ["en", "fr", None][i % 3]) for i in range(n)]


@pytest.mark.parametrize("depth", [2, 5])
def test_index_counts_every_phrase(depth):
    rng = np.random.default_rng(depth)
    codes = np.r_[0, rng.integers(0, 6, 3000), 0].astype(np.int32)
    index = phrases.PhraseIndex(codes, depth)
    want = Counter(tuple(codes[i : i + depth]) for i in range(len(codes) - depth + 1) if codes[i : i + depth].all())
    for sides in ([True] * depth, [False] * depth, [True, False] * depth):
        found = index.words()
        for k in range(depth - 1):
            found = index.extended(found, sides[k])
        got = {tuple(index.names[w]): n for w, n in zip(found[0], found[3].tolist(), strict=True)}
        assert got == want


@pytest.mark.parametrize("kind", [np.int32, np.int64])
def test_packed_numbers_come_back(kind):
    for values in ([], [0], [-1, 2**31 - 1, 0, 7], list(range(-500, 500))):
        got = phrases._unpacked(phrases._packed(np.array(values, kind)), kind)
        assert got.dtype == kind and got.tolist() == values
    keys = np.array([3, 2**40, 2**62], np.int64)
    assert phrases._unpacked_sorted(phrases._packed_sorted(keys)).tolist() == keys.tolist()


@pytest.mark.parametrize("buckets", [1, 4, 211])
def test_keys_of_all_buckets_are_whole_again(buckets):
    prefix, word = np.divmod(np.unique(np.random.default_rng(3).integers(0, 2**20, 30_000)), 700)
    keys = (prefix + 1) << 32 | word + 1
    bucket, key = phrases._dealt(keys >> 32, keys & (2**32 - 1), buckets)
    parts = [phrases._unpacked_sorted(phrases._packed_sorted(np.sort(key[bucket == b]))) for b in range(buckets)]
    assert sorted(np.concatenate([phrases._whole(b, p, buckets) for b, p in enumerate(parts)]).tolist()) == keys.tolist()
    assert max(map(len, parts)) < 2 * len(keys) / buckets + 100


def test_packed_keys_stay_small_where_first_halves_change():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(1, 40_000, 50_000) << 32 | rng.integers(1, 3000, 50_000))
    assert len(phrases._packed_sorted(keys)) < 0.85 * len(phrases._packed(np.diff(keys, prepend=0)))


def test_packed_codes_are_smaller_than_compressed_integers():
    """What is shuffled and staged is packed codes and keys, so their size is the disk of the operator."""
    codes = np.minimum(np.random.default_rng(0).zipf(1.2, 200_000), 60_000).astype(np.int32)
    assert len(phrases._packed(codes)) < 0.93 * len(zstandard.compress(codes.tobytes(), 1))


def test_runs_between_breaks():
    assert phrases.runs_of(np.array([0, 1, 0, 2, 3, 0, 0, 4, 5, 6], np.int32), 2).tolist() == [0, 2, 3, 0, 4, 5, 6, 0]
    assert phrases.runs_of(np.array([1, 0, 2], np.int32), 2).tolist() == [0]
    assert phrases.runs_of(np.zeros(0, np.int32), 2).tolist() == [0]


def test_joined_runs():
    codes = np.array([0, 1, 2, 3, 4, 0, 5, 6, 7, 0], np.int32)
    # pairs that are frequent start at these places; runs of two places and more are kept, words between them too
    often = np.array([0, 1, 1, 0, 0, 0, 1, 0, 0, 0], bool)
    assert phrases._joined_runs(codes, often, 2).tolist() == [0, 1, 2, 3, 0]
    # two runs of phrases of three words may share words
    codes = np.arange(1, 9, dtype=np.int32)
    often = np.array([1, 1, 0, 1, 1, 0, 0, 0], bool)
    assert phrases._joined_runs(codes, often, 3).tolist() == [0, 1, 2, 3, 4, 0, 4, 5, 6, 7, 0]
    assert phrases._joined_runs(codes, ~often & False, 3).tolist() == [0]


@pytest.mark.parametrize("shard, bucket", [(400_000, 1 << 25), (200, 500)])
def test_equals_plain_counting(frame, monkeypatch, shard, bucket):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "BUCKET", bucket)
    monkeypatch.setattr(phrases, "SLICE", 64)
    rows = random_rows(3)
    rows += [("alpha beta gamma delta. " * 6, "en"), ("the the the the the the the", "fr"), ("x y", "und"), ("x y", None)] * 2
    df = frame([(i, t, lang, "w", 1, 2) for i, (t, lang) in enumerate(rows)], DOCS, 4)
    for least, longest, top in ((4, 5, 2000), (3, 3, 5)):
        assert collected(phrases.collocations(df, least=least, longest=longest, top=top)) == plain(rows, least, longest, top)


def test_odd_rows(frame):
    assert phrases.collocations(frame([], DOCS)).count() == 0
    rows = [(None, None, None, None, None, None), (1, "", "en", None, None, None), (1, " \n. ", "en", None, None, None), (2, "A b" * 3, None, None, None, None)]
    assert phrases.collocations(frame(rows, DOCS), least=1).count() > 0
    long = "a b c d. " * 40_000
    got = collected(phrases.collocations(frame([(1, long, "en", None, None, None)] * 2, DOCS)))
    assert got == [("en", 1, "a b c d", 80_000, 80_000, 80_000, 320_000, 4000)]
    with pytest.raises(ValueError):
        phrases.collocations(frame(rows, DOCS), longest=6)
