"""Tables of books that are replaced, and the stream that imports files into them."""

import os

from pyspark.sql import functions as F

from foliolake.sources import files as S
from foliolake.streaming import ingest


def rows(spark, *given):
    return spark.createDataFrame(list(given), "doc_id long, n int")


def test_replaced_books(spark, tmp_path):
    path = str(tmp_path)
    S.write_book_tables({"t": rows(spark, *((d, k) for d in range(40) for k in range(3)))}, path, 8)
    before = {p: os.stat(tmp_path / "t" / p).st_mtime_ns for p in os.listdir(tmp_path / "t") if p.startswith("part")}
    books = rows(spark, (3, 0), (5, 0), (99, 0)).select("doc_id")
    for _ in range(2):  # the same again changes nothing
        S.replace_books({"t": rows(spark, (3, 70), (99, 71)), "u": rows(spark, (3, 1))}, books, path, 8)
        got = sorted(map(tuple, S.read_books(spark, path, "t").collect()))
        assert got == sorted([(d, k) for d in range(40) for k in range(3) if d not in (3, 5)] + [(3, 70), (99, 71)])
    touched = {r[0] for r in spark.read.parquet(f"{path}/t").where("doc_id IN (3, 5, 99)").select("part_of_8").collect()} | {r[0] for r in books.select(F.pmod(F.xxhash64("doc_id"), F.lit(8))).collect()}
    after = {p: os.stat(tmp_path / "t" / p).st_mtime_ns for p in before}
    assert {p for p in before if after[p] != before[p]} == {f"part_of_8={k}" for k in touched} and len(touched) < 8
    assert [tuple(r) for r in S.read_books(spark, path, "u").collect()] == [(3, 1)]


def test_the_last_book_of_a_folder_goes(spark, tmp_path):
    S.write_book_tables({"t": rows(spark, (1, 1), (2, 2))}, str(tmp_path), 1000)
    S.replace_books({"t": rows(spark, (1, 1)).where("false")}, rows(spark, (1, 0)).select("doc_id"), str(tmp_path))
    assert [tuple(r) for r in S.read_books(spark, str(tmp_path), "t").collect()] == [(2, 2)]


def test_reading_some_books_prunes_folders(spark, tmp_path):
    S.write_book_tables({"t": rows(spark, *((d, d) for d in range(500)))}, str(tmp_path), 64)
    some = S.read_books(spark, str(tmp_path), "t", [7, 8])
    assert sorted(r.n for r in some.collect()) == [7, 8]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "part_of_64#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len({r.f for r in some.select(F.input_file_name().alias("f")).collect()}) <= 2
    assert S.read_books(spark, str(tmp_path), "t", []).collect() == []


def contents(spark, out):
    return sorted(r.t for r in ingest.latest(spark, out).select(F.decode("content", "UTF-8").alias("t")).collect())


def test_imports_and_imports_again(spark, tmp_path):
    """A file of the same name replaces its book, in the same batch and in a later one, unless it is older."""
    src, out = tmp_path / "in", str(tmp_path / "out")

    def put(name, text, at):
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text)
        os.utime(src / name, (at, at))

    def run():
        ingest.ingest_stream(spark, str(src), out, str(tmp_path / "ck"), "*.txt", buckets=4).awaitTermination()

    put("1/a.txt", "a one", 1_000_000)
    put("2/a.txt", "a two", 1_000_100)
    put("1/b.txt", "b one", 1_000_000)
    put("1/c.md", "not taken", 1_000_000)
    run()
    assert contents(spark, out) == ["a two", "b one"]
    put("3/b.txt", "b new", 1_000_200)
    put("3/a.txt", "a late but old", 1_000_050)
    put("3/d.txt", "d", 1_000_000)
    run()
    assert contents(spark, out) == ["a two", "b new", "d"]
    run()  # nothing new
    assert contents(spark, out) == ["a two", "b new", "d"]
    ids = [r.doc_id for r in ingest.latest(spark, out).where("path LIKE '%/d.txt'").collect()]
    assert [r.path[-7:] for r in ingest.latest(spark, out, ids).collect()] == ["3/d.txt"]
