"""Operator 12 against distances to all entries."""

import numpy as np
import pytest

from foliolake.llm import vector_codes
from foliolake.llm.queries import QUERIES, SQL
from same import same_rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """vec_id -> code and error, and the codebooks, by every distance."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, [int(np.floor(1024 * x)) for x in r[1]]))
    q = np.array([[int(np.floor(1024 * float(np.float32(x)))) for x in r[1]] for r in kept], dtype=np.int64)
    out, books, error = [], [], 0
    for p in range(parts):
        w = q.shape[1] // parts
        x = q[:, p * w : (p + 1) * w]
        book = x[:entries].copy()
        for k in range(rounds + 1):
            d = ((x[:, None] - book[None]) ** 2).sum(2)
            near = d.argmin(1)
            if k < rounds:
                for e in set(near.tolist()):
                    own = x[near == e]
                    book[e] = [int(s) // len(own) for s in own.sum(0)]
        out.append(near)
        books.append(book)
        error = error + d.min(1)
    return [(r[0], "".join(f"{n:02x}" for n in c), e) for r, c, e in zip(kept, np.stack(out, 1).tolist(), np.asarray(error).tolist())], np.stack(books)


def test_sql(spark, sf, duck):
    same_rows(QUERIES["op12_vector_codes"](spark, sf), duck, SQL["op12_vector_codes"])


@pytest.mark.parametrize(("scale", "cell"), [(0.2, 32), (0.001, 4), (30000.0, 1 << 20), (0.2, 3000)])
def test_against_all_distances(spark, scale, cell):
    random = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in scale * random.normal(size=8)], i % 3) for i in range(400)]
    rows += [(1000 + i, rows[5][1], None) for i in range(100)]  # one vector very often
    made, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=30, cell=cell)
    want, want_books = plain(rows, entries=30)
    assert books.tolist() == want_books.tolist()
    assert sorted((r.vec_id, r.code, r.error) for r in made.collect()) == sorted(want)


def test_candidates_hold_the_nearest():
    """Every part of a cell has its nearest entry among the cell's candidates, ties included, and far entries aren't there."""
    random = np.random.default_rng(1)
    book = random.integers(-200, 200, (64, 4)).astype(float)
    book[9] = book[3]  # equal entries: the lower index counts
    parts = random.integers(-200, 200, (3000, 4)).astype(float)
    grid = vector_codes.Grid(book, 16, 50)
    near, distance = grid.nearest(parts)
    d = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert near.tolist() == d.argmin(1).tolist() and distance.tolist() == d.min(1).tolist()
    assert grid.exact < 0.5 * parts.shape[0] * len(book)
    again = vector_codes.Grid(book, 16)
    again.nearest(parts)
    cells = again.cells
    again.nearest(parts)
    assert again.cells == cells  # all of them were in the memo


def test_rows_without_a_vector_and_others(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [1.0, inf, 0.0, 0.0], 1), (4, [nan, 0.0, 0.0, 0.0], 1), (5, [], 7), (6, [1.0, 2.0], 7)]
    good = [(None, [0.5, 0.25, -0.001, 0.0], None), (8, [0.0, 0.0, 0.0, -1.0], None), (8, [0.0, 0.0, 0.0, -1.0], 2), (9, [9.0, 0.0, 0.0, 1.0], 2)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows + good], SCHEMA + ", code string, q int")
    made, books = vector_codes.compress(df)
    got = sorted(((r.vec_id or 0, r.code, r.error, r.label_error) for r in made.collect()), key=str)
    assert [g for g in got if g[0] in (5, 6)] == [(5, None, None, None), (6, None, None, None)]
    want, want_books = plain(good)
    assert books.tolist() == want_books.tolist()
    assert sorted((g[0], g[1], g[2]) for g in got if g[1]) == sorted((r[0] or 0, r[1], r[2]) for r in want)


@pytest.mark.parametrize("few", [0, 100])
def test_label_errors(spark, few):
    random = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in random.normal(size=4)], None if i % 4 == 0 else i % 2) for i in range(200)]
    made = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), entries=5, few=few)[0].collect()
    total: dict = {}
    for r in made:
        total[r.label] = total.get(r.label, 0) + r.error
    assert len(made) == 200 and all(r.label_error == total[r.label] for r in made) and len(total) == 3


def test_empty_and_errors(spark):
    made, books = vector_codes.compress(spark.createDataFrame([], SCHEMA))
    assert made.collect() == [] and books.size == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], SCHEMA))
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30, 2.0, 3.0, 4.0], 1)], SCHEMA))
