"""The pipeline's rows against its operators' plain versions, stage by stage."""

from tests.llm.conftest import SF
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_near_copies import plain_groups
from tests.llm.test_repeats import plain as plain_repeats
from tremor.llm import mixing

import corpus_pipeline as pipeline


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "repeated_passages", "mixture", "encoding"]

    a = stages["language"](spark, docs, SF).cache()
    kept = {r["doc_id"] for r in a.collect()}
    assert a.columns == columns and len(kept) >= 0.97 * docs.count()

    b = stages["near_duplicates"](spark, a, SF).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in a.collect())
    low = plain_groups(rows)
    assert b.columns == columns and {r["doc_id"] for r in b.collect()} == set(low)

    c = stages["repeated_passages"](spark, b, SF).cache()
    want = {r[0]: r[1] - r[2] for r in plain_repeats([(r["doc_id"], r["text"]) for r in b.collect()])}
    got = {r["doc_id"]: r for r in c.collect()}
    assert c.columns == columns and got.keys() == want.keys()
    assert all(want[i] - 6 * 3 <= len(r["text"].encode()) <= want[i] and r["n_chars"] == len(r["text"]) for i, r in got.items())

    d = stages["mixture"](spark, c, SF).cache()
    check_mix(mixing.mix(c), [(r["doc_id"], r["text"], r["source"]) for r in c.collect()])
    n = {r["doc_id"]: r["n_copies"] for r in mixing.mix(c).collect()}
    assert d.columns == columns and d.count() == sum(n.values())

    e = stages["encoding"](spark, d, SF).collect()
    assert sorted(r["doc_id"] for r in e) == sorted(r["doc_id"] for r in d.collect())
    assert sorted(tuple(r) for r in e) == sorted(tuple(r) for r in pipeline.run(spark, SF).collect())


def test_odd_rows(frame):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "123", "en", "a", 3)]
    rows += [(i, f"the cat {i} and the {'dog ' * i} house", "en", None if i % 5 == 0 else "b", 1) for i in range(3, 30)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (frame(rows, schema), frame([], schema)):
        for name, fn in pipeline.STAGES:
            docs = fn(docs.sparkSession, docs, SF)
            if name != "encoding":
                assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.collect()
