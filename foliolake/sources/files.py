"""Files as tables: scan, routing by format, checks, archives, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Formats by extension, and what reads them.
FORMATS = {
    "mobi": ("MOBI", "text"), "prc": ("MOBI", "text"), "azw3": ("AZW3", "text"), "azw": ("AZW", "text"), "fb2": ("FB2", "text"), "docx": ("DOCX", "text"),
    "mhtml": ("MHTML", "text"), "mht": ("MHTML", "text"), "epub": ("EPUB", "text"), "txt": ("TXT", "text"), "text": ("TXT", "text"), "md": ("MD", "text"),
    "markdown": ("MD", "text"), "html": ("HTML", "text"), "htm": ("HTML", "text"), "xhtml": ("HTML", "text"), "xml": ("XML", "text"),
    "cbz": ("CBZ", "comic"), "cbt": ("CBT", "comic"), "cbr": ("CBR", "comic"), "cb7": ("CB7", "comic"), "pdf": ("PDF", "pdf"),
}
#: Bytes of a PDF in which its mark must come.
HEAD = 4096
IMAGE_NAME = r"(?i)\.(?:jpe?g|png|gif|webp|bmp)$"


def extension(path: Column) -> Column:
    """What follows the last dot, in lower case; the whole name if there is none."""
    return F.lower(F.substring_index(path, ".", -1))


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """doc_id, path, ext, content of every file below a path. doc_id is a hash of the path, the same in each scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    got = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return got.select(F.xxhash64("path").alias("doc_id"), "path", extension(F.col("path")).alias("ext"), "content")


def route_format(files: DataFrame, formats: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Adds fmt and route by extension; what isn't known goes to the route ``fallback``.

    formats: a small dictionary (its entries become one map literal in the plan), so nothing is shuffled.
    """
    known = formats or FORMATS
    find = lambda i: F.create_map(*(F.lit(x) for k, v in known.items() for x in (k, v[i])))[extension(F.col("path"))]
    return files.withColumns({"fmt": find(0), "route": F.coalesce(find(1), F.lit("fallback"))})


def validate_header(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ok and reason: a PDF has eight bytes at least and its mark in the first 4,096."""
    c = F.col(content)
    reason = F.when(F.coalesce(F.octet_length(c), F.lit(0)) < 8, "too short").when(~F.contains(F.substring(c, 1, HEAD), F.lit(bytearray(b"%PDF-"))), "no PDF mark")
    return files.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def encrypted_reason(files: DataFrame, trailers: DataFrame) -> DataFrame:
    """Adds reason ``encrypted`` to files whose merged trailer has the key ``Encrypt``, unless they have a reason already."""
    locked = trailers.where(F.col("key") == "Encrypt").select("doc_id").distinct().withColumn("_locked", F.lit(True))
    given = F.col("reason") if "reason" in files.columns else F.lit(None).cast("string")
    return files.join(locked.hint("merge"), "doc_id", "left").withColumn("reason", F.coalesce(given, F.when(F.col("_locked"), "encrypted"))).drop("_locked")


def reject_encrypted(files: DataFrame, trailers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose merged trailer has no key ``Encrypt``, and the others with a reason."""
    out = encrypted_reason(files, trailers)
    return out.where("reason IS NULL").select(files.columns), out.where("reason IS NOT NULL")


#: Where rows with and without a reason lie in a table that quarantine() writes.
ACCEPTED, REFUSED = "accepted", "refused"


def quarantine(rows: DataFrame, path: str, batch: int) -> dict[str, int]:
    """Writes rows (with their columns, reason among them) below a path in one pass: those without a reason as accepted,
    the others as refused, with their reason. Returns how many each are, as observed while they were written.

    A batch of an import has a folder of its own in both, so that one that is tried again replaces what it wrote, and
    other batches stay: the refused ones add up to a quarantine table.
    """
    seen = Observation()
    status = F.when(F.col("reason").isNull(), ACCEPTED).otherwise(REFUSED)
    marked = rows.withColumns({"status": status, "batch": F.lit(batch)}).observe(seen, F.count_if(F.col("reason").isNull()).alias(ACCEPTED), F.count_if(F.col("reason").isNotNull()).alias(REFUSED))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("status", "batch").parquet(path)
    return {ACCEPTED: 0, REFUSED: 0} | seen.get


def quarantined(spark: SparkSession, path: str, status: str, schema: str) -> DataFrame:
    """The accepted or the refused rows of all batches, with their batch; the other ones are not read. schema: of the rows
    and their batch."""
    return spark.read.schema(f"{schema}, status string").parquet(path).where(F.col("status") == status).drop("status")


def natural_key(name: Column) -> Column:
    """A key that sorts names by their numbers' values and without case. A number is led by how many digits it has, so that
    its length has no bound."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    number = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "\u0001")


def archive_pages(entries: DataFrame) -> DataFrame:
    """Image entries of every archive in natural order: archive_id, page_no (from 0), entry_name, mime. Ties of the
    natural order are settled by the name itself."""
    from pyspark.sql import Window

    low = F.lower("entry_name")
    mime = F.when(low.endswith(".png"), "image/png").when(low.endswith(".gif"), "image/gif").when(low.endswith(".webp"), "image/webp").when(low.endswith(".bmp"), "image/bmp").otherwise("image/jpeg")
    order = Window.partitionBy("archive_id").orderBy(natural_key(F.col("entry_name")), "entry_name")
    return entries.where(F.col("entry_name").rlike(IMAGE_NAME)).select("archive_id", (F.row_number().over(order) - 1).alias("page_no"), "entry_name", mime.alias("mime"))


def empty_archives(entries: DataFrame) -> DataFrame:
    """Archives without an image: archive_id and reason."""
    n = entries.groupBy("archive_id").agg(F.count_if(F.col("entry_name").rlike(IMAGE_NAME)).alias("n"))
    return n.where("n = 0").select("archive_id", F.lit("no image").alias("reason"))


def import_summary(chapters: DataFrame, scanned: DataFrame) -> DataFrame:
    """One line a document on its import. chapters: doc_id, chap_no, pages, by_outline; scanned: doc_id, scanned."""
    per = chapters.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("pages").alias("p"), F.bool_or("by_outline").alias("o"))
    line = F.concat_ws(" · ", F.concat(F.col("p").cast("string"), F.lit(" pages")), F.when(F.col("o"), F.concat(F.col("n").cast("string"), F.lit(" chapters by outline"))).otherwise("sections of 20 pages"), F.when(F.col("scanned"), "scanned"))
    return per.join(scanned.hint("merge"), "doc_id", "left").select("doc_id", line.alias("summary"))


#: Folders that a table of books is dealt into; the column's name says how many there are.
BUCKETS, PART = 64, "part_of_"


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn(f"{PART}{buckets}", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(buckets)).cast("int"))


def _part(df: DataFrame) -> tuple[str, int]:
    """The column of a table's folders and their number."""
    name = next(c for c in df.columns if c.startswith(PART))
    return name, int(name.removeprefix(PART))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_book_tables(tables: dict[str, DataFrame], path: str, buckets: int = BUCKETS) -> None:
    """Writes each table as Parquet below a path, dealt into folders by a hash of doc_id, which readers can prune. A large
    folder is several files; what was there before is replaced as a whole."""
    for name, df in tables.items():
        column = f"{PART}{buckets}"
        _dealt(df, buckets).hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(column).parquet(f"{path}/{name}")


def replace_books(tables: dict[str, DataFrame], books: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replaces the rows of some books (doc_id) in each table below a path, or adds them; a book without rows in a table
    has none afterwards. A table that isn't there yet is written.

    Only the folders that these books are dealt into are read and written again, each staged and moved when the job is done
    (Spark's dynamic overwrite of partitions), so that a job that is tried again does the same. What the driver gets is the
    folders' numbers. Tables stay dealt into as many folders as they were written with.
    """
    spark = books.sparkSession
    for name, df in tables.items():
        at = f"{path}/{name}"
        if not _exists(spark, at):
            write_book_tables({name: df}, path, buckets)
            continue
        there = spark.read.parquet(at)
        column, n = _part(there)
        keys = _dealt(books.select("doc_id").distinct(), n)
        touched = sorted(r[0] for r in keys.select(column).distinct().collect())
        old = there.where(F.col(column).isin(touched)).join(keys.select("doc_id").hint("merge"), "doc_id", "left_anti")
        new = _dealt(df, n)
        rows = old.select(new.columns).unionByName(new)
        full = {r[0] for r in rows.select(column).distinct().collect()}
        rows.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(at)
        for empty in set(touched) - full:  # no row is left to be written in its place
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/{column}={empty}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_books(spark: SparkSession, path: str, name: str, ids: list[int] | None = None, schema: str | None = None) -> DataFrame:
    """A table of books, or its rows for some books, for which only their folders are read. schema: of the table, for one
    that may have no rows at all."""
    if schema and not _exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(f"{path}/{name}")
    column, n = _part(df)
    if ids is not None:
        # Hashes of literals, which the optimizer folds before it lists folders.
        folders = [F.pmod(F.xxhash64(F.lit(i).cast("long")), F.lit(n)).cast("int") for i in ids]
        df = df.where(F.col(column).isin(*folders) & F.col("doc_id").isin(ids)) if ids else df.where(F.lit(False))
    return df.drop(column)
