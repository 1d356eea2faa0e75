"""Registered queries of the package: SQL where there is some, and the pipeline against its own stages."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline
from foliolake.llm import queries, simhash, toxicity
from same import same_rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, duck, name):
    same_rows(queries.QUERIES[name](spark, sf), duck, queries.SQL[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    toxic = {r["doc_id"] for r in queries.QUERIES["op7_toxicity"](spark, sf).where("toxic").collect()}
    clean = docs.where(~F.col("doc_id").isin(list(toxic)))
    first = {r["doc_id"] for r in simhash.near_duplicates(clean).where("doc_id = component_id").collect()}
    bad = {r["doc_id"] for r in queries.QUERIES["op9_decontamination"](spark, sf).where("contaminated").collect()}
    assert set(out) == first - bad and toxic and bad and len(first) < clean.count()
    assert all(r["n_tokens"] == len(r["ids"]) and r["n_chars"] == len(r["text"]) for r in out.values())
    assert not any("@" in r["text"] and ".example.com" in r["text"] for r in out.values())
    assert corpus_pipeline.ORACLE_SQL is None and toxicity.THRESHOLD > 0
