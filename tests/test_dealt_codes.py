"""Code maps: fonts are dealt before their codes are made."""

from foliolake.operators import charmap as D

RANGES = "font_id long, seq int, kind string, lo string, hi string, dst array<string>"


def test_codes_do_not_move(spark):
    given = [
        (1, 9, "char", "05", None, ["0041"]), (1, 1, "range", "0004", "0006", ["00FF"]), (1, 2, "array", "0006", "FFFF", ["0042", None, "0043"]), (1, 3, "array", "0001", None, []),
        (1, 4, "range", "0009", "0008", ["0044"]), (2, 1, "range", "0000", "FFFF", ["0000"]), (2, 2, "array", "0001", None, None), (3, 1, "other", "0001", "0002", ["0041"]),
    ]
    out = D.expand_ranges(spark.createDataFrame(given, RANGES))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    rows = {(r.font_id, r.code_len, r.code): r.uni for r in out.collect()}
    assert {k: v for k, v in rows.items() if k[0] != 2} == {(1, 1, 5): "A", (1, 2, 4): "ÿ", (1, 2, 5): "Ā", (1, 2, 6): "B", (1, 2, 7): None, (1, 2, 8): "C"}
    assert len([k for k in rows if k[0] == 2]) == 65_536 and rows[2, 2, 0x41] == "A"


def test_partitions_follow_codes(spark, monkeypatch):
    monkeypatch.setattr(D, "DEALT_CODES", 100)
    given = [(f, 1, "range", "0000", "0031", ["0041"]) for f in range(40)]
    assert D.expand_ranges(spark.createDataFrame(given, RANGES)).rdd.getNumPartitions() == 21
