"""Queries of scans, routing and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.operators.trees import route_fallback
from foliolake.plans import views as V
from foliolake.plans.registry import query, table
from foliolake.sources import files as S
from foliolake.sources.shared import shared_dir
from foliolake.streaming import ingest


@query(f"WITH {V.FILES} SELECT doc_id, path, 'txt' AS ext, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS digest FROM files_v")
def s1_scan_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as files of a few hundred lines each, scanned again, and their lines read."""
    base = f"{shared_dir(spark)}/scan-{uuid.uuid4().hex}"
    V.files(spark, sf).select(F.to_json(F.struct("doc_id", "path", "text")).alias("value")).write.option("maxRecordsPerFile", 500).text(f"{base}/out")
    scanned = S.scan_files(spark, f"{base}/out", "*.txt")
    lines = scanned.select("ext", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    row = lines.select("ext", F.from_json("line", "doc_id long, path string, text string").alias("r")).select("ext", "r.*")
    return row.select("doc_id", "path", "ext", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("digest"))


@query(
    f"""WITH {V.FILES}, e AS (SELECT doc_id, path, lower(regexp_extract(path, '[^.]*$')) AS ext FROM files_v)
SELECT doc_id, path, CASE ext WHEN 'prc' THEN 'MOBI' WHEN 'mht' THEN 'MHTML' WHEN 'text' THEN 'TXT' WHEN 'markdown' THEN 'MD' WHEN 'htm' THEN 'HTML' WHEN 'xhtml' THEN 'HTML' WHEN 'zip' THEN NULL WHEN 'jpg' THEN NULL ELSE upper(ext) END AS fmt,
CASE WHEN ext IN ('cbz', 'cbt', 'cbr', 'cb7') THEN 'comic' WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('zip', 'jpg') THEN 'fallback' ELSE 'text' END AS route FROM e"""
)
def s2_route_format(spark: SparkSession, sf: str) -> DataFrame:
    """Format and route of every document's file name."""
    return S.route_format(V.files(spark, sf)).select("doc_id", "path", "fmt", "route")


@query(
    """WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '%PDF-1.7 ' || text WHEN 1 THEN text WHEN 2 THEN repeat('x', 4091) || '%PDF-' || text ELSE repeat('x', 4092) || '%PDF-' || text END AS t FROM documents)
SELECT doc_id, CASE WHEN strlen(t) < 8 THEN 'too short' WHEN doc_id % 4 IN (1, 3) THEN 'no PDF mark' END AS reason, NOT (strlen(t) < 8 OR doc_id % 4 IN (1, 3)) AS ok FROM f"""
)
def s3_validate_header(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a PDF's mark at the start, nowhere, just within and just beyond the first 4,096 bytes."""
    t, k = F.col("text"), F.col("doc_id") % 4
    made = F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), t)).when(k == 1, t).when(k == 2, F.concat(F.lit("x" * 4091), F.lit("%PDF-"), t)).otherwise(F.concat(F.lit("x" * 4092), F.lit("%PDF-"), t))
    return S.validate_header(table(spark, sf, "documents").select("doc_id", F.encode(made, "UTF-8").alias("content"))).select("doc_id", "reason", "ok")


TRAILERS = "trailers_v AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS INTEGER) AS gen_order, (['Root', 'Info', 'Encrypt', 'W', 'Index', 'Size', 'ID'])[(o_orderkey % 7) + 1] AS key, o_orderpriority AS value FROM orders)"


def trailers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as trailer entries of customers."""
    return table(spark, sf, "orders").selectExpr("o_custkey doc_id", "CAST(o_orderkey AS INT) gen_order", "element_at(array('Root', 'Info', 'Encrypt', 'W', 'Index', 'Size', 'ID'), CAST(o_orderkey % 7 AS INT) + 1) key", "o_orderpriority value")


@query(f"WITH {TRAILERS} SELECT c_custkey AS doc_id, c_custkey NOT IN (SELECT doc_id FROM trailers_v WHERE key = 'Encrypt') AS accepted FROM customer")
def s4_reject_encrypted(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as documents, accepted and refused."""
    yes, no = S.reject_encrypted(table(spark, sf, "customer").selectExpr("c_custkey doc_id"), trailers(spark, sf))
    return yes.select("doc_id", F.lit(True).alias("accepted")).unionByName(no.select("doc_id", F.lit(False).alias("accepted")))


@query(
    f"""WITH {V.ARCHIVE}, k AS (SELECT *, CAST(regexp_extract(entry_name, '[0-9]+') AS BIGINT) AS n, lower(regexp_extract(entry_name, '[.][a-zA-Z]+$')) AS e FROM archive_v)
SELECT archive_id, CAST(row_number() OVER (PARTITION BY archive_id ORDER BY n, e, entry_name) - 1 AS INTEGER) AS page_no, entry_name,
CASE e WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' ELSE 'image/jpeg' END AS mime FROM k WHERE e <> '.txt'"""
)
def s5_archive_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Image entries of every archive in natural order."""
    return S.archive_pages(V.archive(spark, sf))


@query(
    """WITH c AS (SELECT c_custkey AS doc_id, CAST(o_orderkey % 5 + 1 AS BIGINT) AS pages, o_orderkey % 3 = 0 AS by_outline FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT doc_id, count(*) AS n, sum(pages) AS p, bool_or(by_outline) AS o FROM c GROUP BY doc_id)
SELECT doc_id, p || ' pages · ' || CASE WHEN o THEN n || ' chapters by outline' ELSE 'sections of 20 pages' END || CASE WHEN doc_id % 4 = 0 THEN ' · scanned' ELSE '' END AS summary FROM p"""
)
def s6_import_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Summary line of every customer's orders as chapters."""
    c = table(spark, sf, "orders").selectExpr("o_custkey doc_id", "o_orderkey chap_no", "o_orderkey % 5 + 1 pages", "o_orderkey % 3 = 0 by_outline")
    return S.import_summary(c, table(spark, sf, "customer").selectExpr("c_custkey doc_id", "c_custkey % 4 = 0 scanned"))


@query("SELECT doc_id, md5(text) AS digest, length(text) AS n FROM documents")
def s7_ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that arrive as files of a table, imported by a stream that ends when all are in. (A pattern, as a stream
    takes a path without one for a folder.)"""
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    slim = lambda b: b.select("doc_id", "imported", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))
    ingest.ingest_table(spark, f"{sf}/documents.parque[t]", "doc_id long, text string", "doc_id", f"{base}/out", f"{base}/progress", slim).awaitTermination()
    return ingest.latest(spark, f"{base}/out").select("doc_id", "digest", "n")


#: Documents in books of a thousand; each third book is imported again, with changed texts.
@query("SELECT doc_id, doc_id // 1000 AS book, md5(text || CASE WHEN doc_id // 1000 % 3 = 0 THEN ' again' ELSE '' END) AS digest FROM documents")
def s7_import_files(spark: SparkSession, sf: str) -> DataFrame:
    """Books written as files, imported by a stream of binary files; a second folder has files of some of them, which
    replace the first import in a second run of the stream."""
    base = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").selectExpr("doc_id DIV 1000 book", "to_json(struct(doc_id, text)) value")
    again = table(spark, sf, "documents").where("doc_id DIV 1000 % 3 = 0").selectExpr("doc_id DIV 1000 book", "to_json(struct(doc_id, concat(text, ' again') text)) value")
    book = lambda path: F.regexp_extract(path, "book=([0-9]+)", 1)
    for n, rows in enumerate((docs, again)):
        rows.repartition("book").write.partitionBy("book").text(f"{base}/in/{n}")
        ingest.ingest_stream(spark, f"{base}/in", f"{base}/out", f"{base}/progress", "*.txt", key=book).awaitTermination()
    lines = ingest.latest(spark, f"{base}/out").select(book(F.col("path")).cast("long").alias("book"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    row = lines.select("book", F.from_json("line", "doc_id long, text string").alias("r"))
    return row.select("r.doc_id", "book", F.md5("r.text").alias("digest"))


@query(
    f"""WITH {V.TEXT_LINES}, k AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '> ' || line ELSE line END AS now FROM text_lines_v WHERE doc_id % 9 <> 0 AND (doc_id % 3 <> 0 OR line_no % 2 = 0))
SELECT doc_id, count(*) AS n_lines, md5(string_agg(now, chr(10) ORDER BY line_no)) AS digest FROM k GROUP BY doc_id"""
)
def s6_replace_books(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of all documents as a table of books; each third book is replaced by one with half of its lines, each
    ninth by one without any."""
    path = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    lines = V.text_lines(spark, sf)
    S.write_book_tables({"lines": lines}, path)
    third = lines.where("doc_id % 3 = 0")
    S.replace_books({"lines": third.where("doc_id % 9 <> 0 AND line_no % 2 = 0").withColumn("line", F.concat(F.lit("> "), "line"))}, third.select("doc_id"), path)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    return S.read_books(spark, path, "lines").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(joined).alias("digest"))


@query(
    f"""WITH {TRAILERS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS batch, CAST(strlen(text) + CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 9 END AS BIGINT) AS n_bytes,
CASE WHEN doc_id % 5 = 0 THEN CASE WHEN strlen(text) < 8 THEN 'too short' ELSE 'no PDF mark' END WHEN doc_id IN (SELECT doc_id FROM trailers_v WHERE key = 'Encrypt') THEN 'encrypted' END AS reason FROM documents"""
)
def s4_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files in two imports; those without a PDF's mark and those with an encrypted trailer are refused. Both
    tables are read back."""
    path = f"{shared_dir(spark)}/quarantine-{uuid.uuid4().hex}"
    made = F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("%PDF-1.7 "), "text"))
    files = table(spark, sf, "documents").select("doc_id", F.encode(made, "UTF-8").alias("content"))
    for batch in (1, 2):
        rows = S.encrypted_reason(S.validate_header(files.where(F.col("doc_id") % 2 == batch - 1)), trailers(spark, sf))
        S.quarantine(rows.drop("ok"), path, batch)
    schema = "doc_id long, content binary, reason string, batch int"
    both = [S.quarantined(spark, path, status, schema) for status in (S.ACCEPTED, S.REFUSED)]
    return both[0].unionByName(both[1]).select("doc_id", "batch", "reason", F.octet_length("content").cast("long").alias("n_bytes"))


@query(
    f"""WITH {V.FILES}, x AS (SELECT doc_id, lower(regexp_extract(path, '[^.]*$')) AS ext FROM files_v),
o AS (SELECT doc_id, CASE WHEN ext IN ('cbz', 'cbt', 'cbr', 'cb7') THEN 'comic' WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('zip', 'jpg') THEN 'fallback' ELSE 'text' END AS route, ext FROM x)
SELECT doc_id, route, CASE WHEN doc_id % 5 <> 0 THEN 'e' || doc_id WHEN doc_id % 3 = 0 AND (route <> 'comic' OR ext IN ('cbz', 'cbt')) THEN 'f' || doc_id END AS result,
CASE WHEN doc_id % 5 = 0 AND NOT (doc_id % 3 = 0 AND (route <> 'comic' OR ext IN ('cbz', 'cbt'))) THEN 'bad ' || doc_id END AS reason FROM o"""
)
def m5_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """What neither the engine nor the fallback could read is refused with the engine's error; both tables are read back."""
    path = f"{shared_dir(spark)}/quarantine-{uuid.uuid4().hex}"
    routed = S.route_format(V.files(spark, sf)).withColumn("ext", S.extension(F.col("path")))
    engine = V.files(spark, sf).selectExpr("doc_id", "IF(doc_id % 5 <> 0, concat('e', doc_id), NULL) result", "IF(doc_id % 5 = 0, concat('bad ', doc_id), NULL) error")
    tried = route_fallback(routed, engine, V.files(spark, sf).where("doc_id % 3 = 0").selectExpr("doc_id", "concat('f', doc_id) result"))
    S.quarantine(tried.select("doc_id", "route", "result", F.when(F.col("status") == "failed", F.col("reason")).alias("reason")), path, 1)
    both = [S.quarantined(spark, path, status, "doc_id long, route string, result string, reason string, batch int") for status in (S.ACCEPTED, S.REFUSED)]
    return both[0].unionByName(both[1]).drop("batch")
