"""Lines read from a page's array against the steps on rows; how documents are dealt before they are taken apart."""

import random

import pytest

from foliolake.operators import layout as L
from foliolake.plans import catalog
from foliolake.plans import q_layout as Q
from foliolake.plans import views as V
from foliolake.sources.shared import deal
from pyspark.sql import functions as F
from same import rows_of

SPAN = "doc_id long, page_no int, stream_id int, seq int, x double, y double, fs double, mono boolean, text string"


def some_pages(n):
    """Pages of several streams that take turns, with blanks and spans without a place, and one long page."""
    r = random.Random(7)
    for k in range(n):
        y = 0.0
        for seq in range(700 if k == 0 else r.randrange(1, 90)):
            y += r.choice([0.0, 1.0, 2.0, 14.0])
            placed = r.random() < 0.7
            yield (k % 3, k, r.choice([0, 0, 0, 104]) if k % 2 else 0, seq, r.randrange(600) / 2 if placed else None, y if placed else None, r.choice([10.0, -12.0, 0.0, None]), r.choice([True, False]), r.choice(["ab", " ", "", "中文", None]))


def plain_lines(rows):
    """line_no by (page, seq), by one loop."""
    out, pages = {}, {}
    for row in rows:
        pages.setdefault(row[:2], []).append(row)
    for page, spans in pages.items():
        opens, anchor = set(), {}
        for s in spans:
            fs = abs(s[6] or 0.0) or 1.0
            if s[2] in anchor and anchor[s[2]] is not None and s[5] is not None and abs(s[5] - anchor[s[2]]) > 0.3 * fs:
                opens.add(s[3])
                anchor[s[2]] = s[5]
            elif anchor.get(s[2]) is None:
                anchor[s[2]] = s[5]
        n = 0
        for s in spans:
            n += s[3] in opens
            out[*page, s[3]] = n
    return out


@pytest.fixture(scope="module")
def given():
    return list(some_pages(40))


def test_lines_against_a_loop(spark, given):
    got = L.segment_lines(spark.createDataFrame(given, SPAN).repartition(3)).collect()
    assert {(r.doc_id, r.page_no, r.seq): r.line_no for r in got} == plain_lines(given)


def test_arrays_against_rows(spark, given):
    spans = spark.createDataFrame(given, SPAN).repartition(3)
    rows = L.infer_spaces(L.segment_lines(spans))
    assert rows_of(L.space_lines(spans)) == rows_of(rows)
    lines = L.assemble_lines(rows)
    assert rows_of(L.read_lines(spans)) == rows_of(lines)
    margins = L.margin_supported(lines, L.left_margin(lines))
    assert rows_of(L.supported_margins(lines)) == rows_of(margins)
    assert rows_of(L.indented_lines(lines)) == rows_of(L.restore_indent(lines, margins))


@pytest.mark.parametrize("name", ["l1_replay_oplog", "l2_segment_lines", "l3_infer_spaces", "l4_assemble_lines", "l5_left_margin", "l6_margin_supported", "l7_restore_indent", "page_text"])
def test_documents_are_dealt_once(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan


def test_partitions_grow_with_the_input(spark, sf):
    rows = spark.range(1000).withColumn("t", F.repeat(F.lit("x"), 100))
    assert [deal(d, ["id"], F.length("t"), 10_000).rdd.getNumPartitions() for d in (rows, rows.union(rows), rows.limit(0))] == [11, 21, 1]
    assert V.drawn(spark, sf, 50_000).rdd.getNumPartitions() > 4 and Q.oplog(spark, sf).count() > 0
