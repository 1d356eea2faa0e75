"""Files that arrive are imported as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliolake.sources.files import BUCKETS, read_books, replace_books

#: Spark's schema of binary files.
SCHEMA = "path string, modificationTime timestamp, length long, content binary"
TABLE = "books"


def file_name(path: Column) -> Column:
    """The last part of a path: a file of the same name is the same book, wherever it lies."""
    return F.substring_index(path, "/", -1)


def merge_newest(batch: DataFrame, out: str, buckets: int = BUCKETS) -> None:
    """Puts a batch of imports (doc_id, imported, ...) into the table of the newest import of each book.

    Of several imports of a book in the batch the newest counts (of equally new ones the one with the largest row of the
    columns that can be ordered), and it replaces what the table has unless that is newer. Only the folders of the batch's
    books are read and written, so an import costs what it touches, and a batch that is tried again changes nothing.
    """
    spark = batch.sparkSession
    ties = [f.name for f in batch.schema.fields if f.name not in ("doc_id", "imported") and f.dataType.typeName() in ("string", "binary", "long", "integer")]
    order = F.struct("imported", *ties)
    rest = [c for c in batch.columns if c not in ("doc_id", "imported", *ties)]
    # Greatest rows rather than numbered ones: what asks for the keys alone doesn't read and move the contents.
    best = batch.groupBy("doc_id").agg(F.max("imported").alias("imported"), F.max(order).alias("_best"), *([F.max_by(F.struct(*rest), order).alias("_rest")] if rest else []))
    newest = best.select("doc_id", "imported", *(F.col("_best")[c].alias(c) for c in ties), *(F.col("_rest")[c].alias(c) for c in rest)).select(batch.columns)
    known = read_books(spark, out, TABLE, schema=f"doc_id {batch.schema['doc_id'].dataType.simpleString()}, imported timestamp")
    had = known.select("doc_id", F.col("imported").alias("_had")).join(batch.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    fresh = newest.join(had.hint("merge"), "doc_id", "left").where("_had IS NULL OR _had <= imported").drop("_had")
    replace_books({TABLE: fresh}, fresh.select("doc_id"), out, buckets)


def _run(rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, buckets: int) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        # The batch is read several times: once for its keys, once for its rows.
        merge_newest(prepare(batch), out, buckets)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "*", transform: Callable[[DataFrame], DataFrame] | None = None, key: Callable[[Column], Column] = file_name, buckets: int = BUCKETS) -> StreamingQuery:
    """Imports all files of a folder that weren't imported yet, and ends.

    A book is what ``key`` makes of a file's path, its doc_id a hash of that: a file of a known book replaces it. Each
    batch (doc_id, imported, path, length, content) is transformed by the batch operators, which keep doc_id and imported,
    one row a book, and merged into the table that latest() reads. An older file that arrives later doesn't replace a newer
    one.
    """
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.xxhash64(key(F.col("path"))).alias("doc_id"), F.col("modificationTime").alias("imported"), "path", "length", "content")
    return _run(rows, transform or (lambda x: x), out, checkpoint, buckets)


def ingest_table(spark: SparkSession, path: str, schema: str, key: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """As ingest_stream, for documents that arrive as Parquet files of a table: each row is a document by its key, and as
    new as its file."""
    rows = spark.readStream.format("parquet").schema(schema).load(path).withColumnRenamed(key, "doc_id").withColumn("imported", F.col("_metadata.file_modification_time"))
    return _run(rows, transform or (lambda x: x), out, checkpoint, buckets)


def latest(spark: SparkSession, out: str, ids: list[int] | None = None) -> DataFrame:
    """The newest import of each book, or of some books; earlier imports aren't there to be read."""
    return read_books(spark, out, TABLE, ids)
