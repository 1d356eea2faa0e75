"""Queries of statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.operators import chapters as C
from foliolake.operators import stats as A
from foliolake.plans import views as V
from foliolake.plans.q_chapters import CHUNKS
from foliolake.plans.q_scalars import kinds
from foliolake.plans.registry import query, table


@query(f"WITH {CHUNKS}, c AS (SELECT doc_id, max(chap_no) AS chapters, CAST(sum(length(text)) AS BIGINT) AS chars, sum(DISTINCT chap_no) AS pages FROM paras_v GROUP BY doc_id) SELECT doc_id, CAST(chapters AS BIGINT) AS chapters, CAST(pages AS BIGINT) AS pages, chars FROM c")
def a1_doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of documents cut into sections; the k-th section has k pages."""
    p = C.chunk_headingless(table(spark, sf, "documents"))
    ch = p.select("doc_id", "chap_no").distinct().select("doc_id", F.col("chap_no").alias("pages"))
    return A.doc_stats(ch, p)


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents), n AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 4 GROUP BY doc_id, word),
r AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS INTEGER) AS rank, word, n FROM n) SELECT * FROM r WHERE rank <= 10"""
)
def a2_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Ten keywords of every document."""
    return A.keywords(table(spark, sf, "documents"))


@query("SELECT conv_id AS doc_id, conv_id % 7 = 0 AS scanned FROM conversations GROUP BY conv_id")
def a3_is_scanned(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as documents; each seventh has blank turns alone."""
    return A.is_scanned(table(spark, sf, "conversations").selectExpr("conv_id doc_id", "IF(conv_id % 7 = 0, ' ', text) text"))


@query(f"WITH {V.IMAGES} SELECT doc_id, count(*) AS page_count, count(*) FILTER (kind IN ('jpeg', 'raw')) AS usable FROM kinds_v GROUP BY doc_id")
def a4_image_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Usable images of suppliers."""
    return A.image_summary(kinds(spark, sf))


@query(f"WITH {V.IMAGES}, f AS (SELECT doc_id, note, min(img_seq) AS s FROM kinds_v WHERE note <> '' GROUP BY doc_id, note) SELECT doc_id, string_agg(note, '; ' ORDER BY s) AS notes FROM f GROUP BY doc_id")
def a5_distinct_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Different notes of suppliers' images."""
    return A.distinct_notes(kinds(spark, sf)).select("doc_id", F.array_join("notes", "; ").alias("notes"))


@query(
    f"""WITH {V.IMAGES}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY width * height DESC, img_seq) AS r FROM kinds_v WHERE width > 0 AND height > 0),
p AS (SELECT s_suppkey AS doc_id, CAST(r AS INTEGER) AS page_no FROM supplier, range(52) t(r))
SELECT p.doc_id, p.page_no, img_seq, coalesce(kind, 'none') AS kind FROM p LEFT JOIN b ON b.doc_id = p.doc_id AND b.page_no = p.page_no AND b.r = 1"""
)
def a6_largest_image(spark: SparkSession, sf: str) -> DataFrame:
    """Largest image of 52 pages of every supplier."""
    pages = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(51))).alias("page_no"))
    return A.largest_image(kinds(spark, sf), pages)


@query(
    """WITH i AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Title' WHEN o_orderkey % 3 = 1 THEN 'Author' ELSE 'Other' END AS key, o_orderpriority AS value FROM orders)
SELECT o_custkey AS doc_id, coalesce((SELECT min(value) FROM i WHERE i.doc_id = o_custkey AND key = 'Title'), '') AS title, coalesce((SELECT min(value) FROM i WHERE i.doc_id = o_custkey AND key = 'Author'), '') AS author, count(*) AS page_count FROM orders GROUP BY o_custkey"""
)
def a7_doc_info(spark: SparkSession, sf: str) -> DataFrame:
    """Title, author and pages of customers by their orders."""
    info = table(spark, sf, "orders").selectExpr("o_custkey doc_id", "element_at(array('Title', 'Author', 'Other'), CAST(o_orderkey % 3 AS INT) + 1) key", "o_orderpriority value")
    return A.doc_info(info, table(spark, sf, "orders").selectExpr("o_custkey doc_id", "o_orderkey page"))
