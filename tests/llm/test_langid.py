"""Language identification: held-out accuracy, repeatability and odd rows."""

import pytest

import corpus_pipeline
from tests.llm.conftest import SF
from tremor.llm import langid

DOCS = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark):
    found = langid.op9_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = [r for r in found.collect() if r["held_out"]]
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_repeats(spark):
    assert sorted(langid.op9_langid(spark, SF).collect()) == sorted(langid.op9_langid(spark, SF).collect())


def test_odd_rows(frame):
    train = [(i, t, v, "x") for i, (t, v) in enumerate([("the and of", "en"), ("der die und", "de"), ("the one", None)] * 20)]
    odd = [(None, None, "en", None), (901, "", "de", None), (902, "123 !?", "en", None), (903, "the and " * 30_000, None, None), (903, "the and", None, None)]
    docs = frame(train + odd, DOCS)
    got = {(r["doc_id"], r["text"] and r["text"][:9]): (r["lang_pred"], r["score"]) for r in langid.identify(docs, ["doc_id", "text", "lang"]).collect()}
    assert got[None, None] == got[901, ""] == got[902, "123 !?"] == ("und", 0.0)
    assert got[903, "the and t"][0] == got[903, "the and"][0] == "en"
    assert langid.identify(docs, ["doc_id", "score"]).columns == ["doc_id", "lang_pred", "score"]


def test_nothing_to_learn(frame):
    found = langid.identify(frame([(1, "the", None, None)], DOCS), ["doc_id"]).collect()
    assert [(r["lang_pred"], r["score"]) for r in found] == [("und", 0.0)]
    assert langid.identify(frame([], DOCS), ["doc_id"]).collect() == []


def test_labels_without_bound_are_refused(frame):
    with pytest.raises(ValueError, match="labels"):
        langid.fit(frame([(i, "the", f"l{i}", None) for i in range(langid.MOST_LABELS + 1)], DOCS))


def test_ngrams_ignore_case_and_runs_of_blanks():
    a, b = langid.ngrams("The  cat, 12 sat"), langid.ngrams("the cat sat")
    assert (a == b).all() and langid.ngrams("12 !") is None


def test_unknown_text_is_not_kept(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(-1, "Это обычное русское предложение о погоде и городе, которое написано здесь. " * 5, None), (-2, "xqzv kjwq zzpt vbnm qwrt plkj hgfd zxcv bnmq wrtp " * 5, "en"), (-3, "123 !?", "en")]
    both = docs.unionByName(frame(odd, "doc_id long, text string, lang string"))
    kept = corpus_pipeline.language(spark, both, SF)
    assert kept.columns == both.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()}


def test_every_labelled_row_is_learned_from(frame):
    docs = frame([(i, "ab", "en", None) for i in range(6000)], DOCS)
    labels, log, _ = langid.fit(docs)
    seen = langid.np.bincount(langid.ngrams("ab"), minlength=langid.BUCKETS) * 6000
    want = langid.np.log(seen + langid.ALPHA) - langid.np.log(seen.sum() + langid.ALPHA * langid.BUCKETS)
    assert labels == ["en"] and log[:, 0] == pytest.approx(want)
