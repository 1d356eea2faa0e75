"""The pipeline's near-duplicate stage keeps one row a group, whatever the ids are."""

import random

import corpus_pipeline


def test_null_and_repeated_ids(spark):
    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    alone, twice = [text() for _ in range(12)], text()
    rows = [(None, t, "en", "s", len(t)) for t in alone[:6]]  # null ids, unrelated texts
    rows += [(1, t, "en", "s", len(t)) for t in alone[6:9]] + [(2, t, None, "s", None) for t in alone[9:]]  # one id, unrelated texts
    rows += [(9, twice, "en", "s", 1), (8, twice, "en", "s", 1), (8, twice, "en", "s", 1), (8, twice, "fr", "s", 1), (None, twice, "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.one_of_each(spark, df, "").collect()
    assert sorted(r["text"] for r in got) == sorted([*alone, twice])
    assert [r["doc_id"] for r in got if r["text"] == twice] == [8]
    assert got[0].asDict().keys() == set(corpus_pipeline.COLUMNS)
