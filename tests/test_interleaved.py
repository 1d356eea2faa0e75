"""Lines and images of one pass over a page against the steps on rows; documents are taken apart once."""

import random

from foliolake.functions import scalars as P
from foliolake.operators import layout as L
from foliolake.plans import catalog
from pyspark.sql import functions as F
from same import rows_of
from test_line_arrays import SPAN, some_pages

NAMES = ["p", "q", "r", "s", ""]


def drawn(n):
    """Pages with images of several names, blanks before them, images in a row, and one page without a document."""
    r = random.Random(11)
    for row in some_pages(n):
        key = (None, *row[1:]) if row[1] == 5 else row
        if r.random() < 0.25:
            yield (*key[:4], None, None, 0.0, False, None, r.choice(NAMES))
        else:
            yield (*key, None)


def test_one_pass_against_the_steps(spark):
    rows = spark.createDataFrame(list(drawn(60)), f"{SPAN}, image string").repartition(3)
    given = [(d, n, r) for d in (0, 1, None) for n, r in zip([*NAMES, None], ["jpeg", "raw", "unsupported", "jpeg", "raw", "jpeg"], strict=True)]
    images = spark.createDataFrame([*given, *given, (2, "r", "jpeg"), (9, "p", "jpeg")], "doc_id long, image string, kind string")
    want = L.interleave_images(L.read_lines(rows), L.anchor_images(L.space_lines(rows), images))
    got = L.interleaved(rows, images)
    assert got.dtypes == want.dtypes and got.columns == want.columns
    assert rows_of(got) == rows_of(want)
    kinds = [(r.doc_id, r.kind) for r in got.collect()]
    assert {(0, "image"), (2, "image"), (None, "line")} <= set(kinds) and (None, "image") not in kinds
    assert L.interleaved(rows.limit(0), images).count() == 0
    assert rows_of(L.interleaved(rows, images.limit(0)).where("kind = 'image'"))[1] == []


def test_documents_are_taken_apart_once(spark, sf):
    plan = catalog.QUERIES["l10_interleave_images"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("ArrowAggregatePython") == 1 and "Window [row_number" not in plan


def test_advances_of_words_and_blanks(spark):
    want = {("abc", False): 135, ("abc", True): 165, ("", False): 0, (" ", False): 25, ("a b", True): 165, ("a\u00a0b", False): 115, ("中b", False): 140, ("é", True): 55, (None, False): None, ("ab", None): 90, (" ", None): 25}
    rows = spark.createDataFrame(list(want), "text string, mono boolean")
    assert {(r.text, r.mono): r.n for r in rows.withColumn("n", P.advance_hundredths(F.col("text"), F.col("mono"))).collect()} == want
