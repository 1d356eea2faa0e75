"""Accepted and refused files from one pass."""

import pytest

from foliolake.sources import files as S

SCHEMA = "doc_id long, reason string, batch int"


def given(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, reason string")


def test_batches_add_up_and_can_be_tried_again(spark, tmp_path):
    path = str(tmp_path / "t")
    assert S.quarantine(given(spark, (1, None), (2, "bad"), (None, "bad")), path, 1) == {"accepted": 1, "refused": 2}
    assert S.quarantine(given(spark, (3, None)), path, 2) == {"accepted": 1, "refused": 0}
    for _ in range(2):
        assert S.quarantine(given(spark, (4, "worse"), (5, None)), path, 3) == {"accepted": 1, "refused": 1}
    assert sorted((r.doc_id, r.batch) for r in S.quarantined(spark, path, S.ACCEPTED, SCHEMA).collect()) == [(1, 1), (3, 2), (5, 3)]
    assert sorted((r.doc_id or 0, r.reason, r.batch) for r in S.quarantined(spark, path, S.REFUSED, SCHEMA).collect()) == [(0, "bad", 1), (2, "bad", 1), (4, "worse", 3)]


def test_one_scan_and_pruned_reads(spark, tmp_path):
    source = str(tmp_path / "files")
    given(spark, (1, None), (2, "bad")).write.parquet(source)
    trailers = spark.createDataFrame([(1, 0, "Encrypt", "x"), (1, 1, "Encrypt", "y")], "doc_id long, gen_order int, key string, value string")
    rows = S.encrypted_reason(spark.read.parquet(source), trailers)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, rows.collect())) == [(1, "encrypted"), (2, "bad")]
    S.quarantine(rows, str(tmp_path / "t"), 1)
    plan = S.quarantined(spark, str(tmp_path / "t"), S.REFUSED, SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "status" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("n", [0])
def test_empty_batch(spark, tmp_path, n):
    rows = given(spark, (1, None)).limit(n)
    assert S.quarantine(rows, str(tmp_path / "t"), 1) == {"accepted": 0, "refused": 0}
