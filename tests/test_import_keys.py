"""The keys of an import are found without its contents."""

from datetime import datetime

from foliolake.sources import files as S
from foliolake.streaming import ingest


def test_contents_move_once(spark, tmp_path, monkeypatch):
    at = datetime(2024, 1, 1)
    batch = spark.createDataFrame([(1, at, "a", b"x", [1]), (1, at, "a", b"y", [2]), (2, None, "b", None, [3]), (2, at, "a", b"z", [4])], "doc_id long, imported timestamp, path string, content binary, other array<int>")
    seen = {}

    def keep(tables, books, out, buckets):
        seen["keys"] = books._jdf.queryExecution().executedPlan().toString()
        S.replace_books(tables, books, out, buckets)

    monkeypatch.setattr(ingest, "replace_books", keep)
    narrow = batch.drop("other")
    path = str(tmp_path / "narrow.parquet")
    narrow.write.parquet(path)
    ingest.merge_newest(spark.read.parquet(path), str(tmp_path / "one"), 4)
    read = [x for x in seen["keys"].splitlines() if "ReadSchema" in x]
    assert read and not any("content" in x.split("ReadSchema")[1] for x in read)
    want = [(1, at, "a", b"y"), (2, at, "a", b"z")]
    assert sorted((r.doc_id, r.imported, r.path, bytes(r.content)) for r in ingest.latest(spark, str(tmp_path / "one")).collect()) == want
    ingest.merge_newest(batch, str(tmp_path / "two"), 4)
    assert sorted((r.doc_id, r.imported, r.path, bytes(r.content), r.other) for r in ingest.latest(spark, str(tmp_path / "two")).collect()) == [(*w, o) for w, o in zip(want, ([2], [4]))]
