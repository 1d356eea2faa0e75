"""Lines are found by one loop over a page's numbers within an aggregation: odd values, and what is carried along."""

import pytest

from foliolake.operators import layout as L
from foliolake.plans import catalog
from test_line_arrays import SPAN, plain_lines, some_pages

NAN = float("nan")
ODD = [
    # Values that are no numbers are beyond all others; a stream without a place has none to break from; sizes of 0 are 1.
    (1, 0, 0, 0, 5.0, None, 10.0, False, "a"),
    (1, 0, 0, 1, 5.0, 7.0, 10.0, False, "b"),
    (1, 0, 0, 2, NAN, 7.0, 10.0, False, "c"),
    (1, 0, 0, 3, 90.0, NAN, 10.0, False, "d"),
    (1, 0, 0, 4, 90.0, 7.0, 10.0, False, " "),
    (1, 0, None, 5, 90.0, 70.0, 0.0, False, "e"),
    (1, 0, None, 6, None, 70.2, 0.0, None, None),
    (1, 0, None, 7, 99.0, 71.0, None, True, "f 　"),
    (None, None, 0, 0, None, None, None, None, None),
]


def test_odd_values(spark):
    got = L.space_lines(spark.createDataFrame(ODD[::-1], SPAN).repartition(2)).collect()
    assert {(r.doc_id, r.seq): (r.line_no, r.n_spaces) for r in got} == {(1, 0): (0, 0), (1, 1): (0, 0), (1, 2): (0, 3), (1, 3): (1, 0), (1, 4): (2, 0), (1, 5): (2, 0), (1, 6): (2, 0), (1, 7): (3, 0), (None, 0): (0, 0)}
    lines = L.read_lines(spark.createDataFrame(ODD, SPAN)).collect()
    assert sorted((r.line_no, r.text) for r in lines) == [(0, "ab   c"), (1, "d"), (2, " e"), (3, "f")]
    assert L.read_lines(spark.createDataFrame([], SPAN)).count() == 0


def test_only_what_is_wanted_is_carried(spark):
    given = list(some_pages(12))
    spans = spark.createDataFrame(given, SPAN)
    got = L.segment_lines(spans, ("seq",))
    assert got.columns == ["doc_id", "page_no", "seq", "line_no"]
    assert {(r.doc_id, r.page_no, r.seq): r.line_no for r in got.collect()} == plain_lines(given)
    assert L.segment_lines(spans).columns == [*spans.columns, "line_no"]


@pytest.mark.parametrize("name", ["l2_segment_lines", "l3_infer_spaces", "l4_assemble_lines", "l5_left_margin", "l6_margin_supported", "l7_restore_indent", "page_text", "l9_anchor_images"])
def test_no_arrays_of_spans(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowAggregatePython") == 1 and "lambdafunction(struct" not in plan and "aggregate(" not in plan
