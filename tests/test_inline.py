"""Inline marks of Markdown that nest, and what isn't closed."""

import random

import pytest
from pyspark.sql import functions as F

from foliolake.functions import scalars as P

CASES = {
    "**a *b* c**": "a :b|b:bi| c:b", "**a *b***": "a :b|b:bi", "***a* b**": "a:bi| b:b", "***a** b*": "a:bi| b:i", "*a **b** c*": "a :i|b:bi| c:i", "**a `b*c` d**": "a :b|b*c:bc| d:b",
    "**see [the *doc*](http://x_y) now**": "see :b|the :b|doc:bi| now:b", "**open": "**:|open:", "a * b * c": "a :|*:| b :|*:| c:", "**a *b** c*": "a :b|*:b|b:b| c:|*:", "_a **b**_": "a :i|b:bi",
    "snake_case_name": "snake:|_:|case:|_:|name:", "[x] y](z)": "[:|x:|]:| y:|](z):", "[a [b](c)": "[:|a :|b:", "![i](j) **![k](l)**": "［图：i］:| :|［图：k］:b", "\\*a\\* *b*": "*:|a:|*:| :|b:i", "": "", "****": "***:|*:",
    "*a _b* c_": "a :i|_:i|b:i| c:|_:", "***a***": "a:bi", "** a **": "**:| a :|**:", "**a***": "a:b|*:", "**a** *b***": "a:b| :|b:i|**:",
}


def rendered(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string").select("k", P.inline_runs(F.col("s")).alias("r")).orderBy("k").collect()
    return ["|".join(f"{x.t}:{'b' * x.b}{'i' * x.i}{'c' * x.c}" for x in r.r) for r in rows]


def test_cases(spark):
    got = dict(zip(CASES, rendered(spark, CASES), strict=True))
    assert got == CASES


def test_null(spark):
    assert spark.createDataFrame([(None,)], "s string").select(P.inline_runs(F.col("s")).alias("r")).first()["r"] is None


@pytest.mark.parametrize("seed", range(3))
def test_built_trees_are_read_back(spark, seed):
    """Nested marks written from a random tree: each letter has the marks above it, once for each kind."""
    r, texts, want = random.Random(seed), [], []

    def node(depth, b, i):
        kind = r.choice(["text", "text", "code", "bold", "italic", "link"]) if depth else "text"
        if kind == "text" or kind == "bold" and b or kind == "italic" and i:
            w = "".join(r.choice("pqrs") for _ in range(3))
            return w, [(c, b, i, 0) for c in w]
        if kind == "code":
            return "`x*y`", [(c, b, i, 1) for c in "x*y"]
        inner = [node(depth - 1, b or kind == "bold", i or kind == "italic") for _ in range(r.choice([1, 3]))]
        text, flat = " ".join(t for t, _ in inner), []
        for k, (_, f) in enumerate(inner):
            flat += ([(" ", b or kind == "bold", i or kind == "italic", 0)] if k else []) + f
        mark = {"bold": "**", "italic": "_", "link": ""}[kind]
        # A link in a link is none.
        return (f"[{text}](u)" if kind == "link" and "[" not in text else mark + text + mark), flat

    for _ in range(80):
        text, flat = node(4, False, False)
        texts.append(text)
        want.append([(c, int(b), int(i), k) for c, b, i, k in flat])
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string").select("k", "s", P.inline_runs(F.col("s")).alias("r")).orderBy("k").collect()
    for row, w in zip(rows, want, strict=True):
        assert [(c, x.b, x.i, x.c) for x in row.r for c in x.t] == w, row.s
