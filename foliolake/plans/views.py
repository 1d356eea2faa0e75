"""Tables in the shapes that the operators take, derived from the driver's tables: in Spark, and as SQL for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.plans.registry import table
from foliolake.sources.shared import deal

EXTENSIONS = ["mobi", "prc", "azw3", "azw", "fb2", "docx", "mhtml", "mht", "epub", "txt", "text", "md", "markdown", "html", "htm", "xhtml", "xml", "cbz", "cbt", "cbr", "cb7", "pdf", "zip", "JPG"]


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files with a name of their own."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS)).cast("int") + 1)
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), "text", "lang", "source")


FILES = f"files_v AS (SELECT doc_id, 'doc_' || doc_id || '.' || ([{', '.join(repr(e) for e in EXTENSIONS)}])[(doc_id % {len(EXTENSIONS)}) + 1] AS path, text, lang, source FROM documents)"


#: Characters of documents in a partition of their words.
DEALT = 2**21


def drawn(spark: SparkSession, sf: str, each: int = DEALT) -> DataFrame:
    """Every word of a document as a span: 40 lines a page, every fourth line indented, every third monospaced, drifting
    baselines. After each tenth word of a line stands a blank without a place, after each fiftieth of a page an image.
    Documents are dealt by their key before they are taken apart, which moves less than dealing their words, and so many to
    a partition that its words can be sorted in memory; words are numbered by what the lines before theirs have."""
    return spark.sql(
        """
        SELECT doc_id, page_no, 0 stream_id, line_src, w, n, part, 3 * n + part seq,
               IF(part = 0, 72D + IF(line_src % 4 = 3, 10D, 0D) + 60D * w, NULL) x, IF(part = 0, 760D - 14D * (line_src % 40) - 1.25D * (w % 5), NULL) y,
               IF(part = 0, 10D, 0D) fs, part < 2 AND line_src % 3 = 1 mono, CASE part WHEN 0 THEN word WHEN 1 THEN ' ' END text, IF(part = 2, concat('im', n DIV 50 % 3), NULL) image
        FROM (SELECT *, explode(CASE WHEN w % 10 = 8 AND n % 50 = 49 THEN array(0, 1, 2) WHEN w % 10 = 8 THEN array(0, 1) WHEN n % 50 = 49 THEN array(0, 2) ELSE array(0) END) AS part
              FROM (SELECT doc_id, page_no, line_src, w, word, before + w n
                    FROM (SELECT doc_id, page_no, line_src, before, posexplode(words) AS (w, word)
                          FROM (SELECT *, CAST(coalesce(sum(size(words)) OVER (PARTITION BY doc_id, page_no ORDER BY line_src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) before
                                FROM (SELECT doc_id, CAST(line_src DIV 40 AS INT) page_no, line_src, array_remove(split(line, ' '), '') words
                                      FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (line_src, line) FROM {documents}))))))
        """,
        documents=deal(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], F.length("text"), each),
    )


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """The drawn words and blanks without the images, and no more than what spans have."""
    return drawn(spark, sf).where("image IS NULL").select("doc_id", "page_no", "stream_id", "seq", "x", "y", "fs", "mono", "text")


SPANS = """words_v AS (
SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_src, w) - 1 AS INTEGER) AS n
FROM (SELECT doc_id, CAST(l // 40 AS INTEGER) AS page_no, CAST(l AS INTEGER) AS line_src, unnest(ws) AS word, CAST(unnest(range(len(ws))) AS INTEGER) AS w
      FROM (SELECT doc_id, l, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws
            FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))))),
drawn_v AS (SELECT doc_id, page_no, 0 AS stream_id, line_src, w, n, part, 3 * n + part AS seq,
    CASE WHEN part = 0 THEN CAST(72 + CASE WHEN line_src % 4 = 3 THEN 10 ELSE 0 END + 60 * w AS DOUBLE) END AS x, CASE WHEN part = 0 THEN CAST(760 - 14 * (line_src % 40) AS DOUBLE) - 1.25::DOUBLE * (w % 5) END AS y,
    CASE WHEN part = 0 THEN 10 ELSE 0 END::DOUBLE AS fs, part < 2 AND line_src % 3 = 1 AS mono, CASE part WHEN 0 THEN word WHEN 1 THEN ' ' END AS text, CASE WHEN part = 2 THEN 'im' || (n // 50 % 3) END AS image
FROM words_v, (VALUES (0), (1), (2)) t(part) WHERE part = 0 OR (part = 1 AND w % 10 = 8) OR (part = 2 AND n % 50 = 49)),
spans_v AS (SELECT * EXCLUDE (image) FROM drawn_v WHERE image IS NULL)"""


def lined_sql(of: str = "spans_v") -> str:
    """The closed form of the line rule on these spans."""
    return f"lined_v AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY line_src, 2 * (w // 5) + (CASE WHEN w % 5 >= 3 THEN 1 ELSE 0 END)) - 1 AS INTEGER) AS line_no FROM {of})"


LINED = lined_sql()
SPACED = """spaced_v AS (SELECT *, CASE WHEN gap IS NULL THEN 0 WHEN gap < 25 THEN 0 WHEN gap < 200 THEN 1 WHEN gap < 300 THEN 2 ELSE 3 END AS n_spaces
FROM (SELECT *, (x - last_value(x + length(text) * (CASE WHEN mono THEN 5.5 ELSE 4.5 END)::DOUBLE IGNORE NULLS) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) * 10 AS gap FROM lined_v))"""
#: A line's text; words here have no white space, and no wide characters.
LINES = """lines_v AS (SELECT doc_id, page_no, line_no, min_by(x, seq) AS x, min_by(fs, seq) AS fs, rtrim(string_agg(repeat(' ', n_spaces) || text, '' ORDER BY seq)) AS text
FROM spaced_v WHERE text IS NOT NULL GROUP BY doc_id, page_no, line_no)"""


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents: doc_id, line_no from 0, line."""
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


TEXT_LINES = "text_lines_v AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"


def md_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents with marks of Markdown by their number."""
    n, x = F.col("line_no") % 8, F.col("line")
    marked = (
        F.when(n == 0, F.concat(F.repeat(F.lit("#"), (F.col("line_no") / 8).cast("int") % 4 + 1), F.lit(" "), x)).when(n == 1, F.concat(F.lit("- "), x)).when(n == 2, F.concat(F.lit("1. "), x)).when(n == 3, F.concat(F.lit("> "), x))
        .when(n == 4, "```").when(n == 5, F.concat(F.lit("| "), x, F.lit(" |"))).when(n == 6, x).otherwise("")
    )
    return text_lines(spark, sf).select("doc_id", "line_no", marked.alias("line"))


MD_LINES = (
    TEXT_LINES
    + """, md_lines_v AS (SELECT doc_id, line_no, CASE line_no % 8 WHEN 0 THEN repeat('#', (line_no // 8) % 4 + 1) || ' ' || line WHEN 1 THEN '- ' || line WHEN 2 THEN '1. ' || line WHEN 3 THEN '> ' || line
WHEN 4 THEN '```' WHEN 5 THEN '| ' || line || ' |' WHEN 6 THEN line ELSE '' END AS line FROM text_lines_v)"""
)


def outline(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as outline entries."""
    return table(spark, sf, "conversations").selectExpr("conv_id doc_id", "CAST(turn AS INT) seq", "IF(role = 'user', 1, 2) depth", "substr(text, 1, 60) title", "CAST((turn * 7 + conv_id * 3) % 20 AS INT) page_no", "24 n_pages")


OUTLINE = "outline_v AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS seq, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS depth, substr(text, 1, 60) AS title, CAST((turn * 7 + conv_id * 3) % 20 AS INTEGER) AS page_no, 24 AS n_pages FROM conversations)"


def xref(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as entries of object indices in several generations."""
    return table(spark, sf, "lineitem").selectExpr("l_suppkey doc_id", "l_linenumber gen_order", "l_partkey num", "IF(l_returnflag = 'R', 0, 1) type", "l_orderkey offs")


XREF = "xref_v AS (SELECT l_suppkey AS doc_id, l_linenumber AS gen_order, l_partkey AS num, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS type, l_orderkey AS offs FROM lineitem)"


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as image descriptions; some sizes are zero or less."""
    out = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey doc_id", "CAST(l_orderkey % 50 AS INT) page_no", "CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS INT) img_seq",
        "CAST(l_quantity AS INT) - 3 width", "CAST(l_partkey % 37 AS INT) height", "element_at(array('DCTDecode','FlateDecode','JPXDecode','CCITTFaxDecode'), CAST(l_partkey % 4 AS INT) + 1) filter",
        "IF(l_partkey % 7 = 0, 4, 8) bpc", "element_at(array('DeviceRGB','DeviceGray','DeviceCMYK','ICCBased'), CAST(l_orderkey % 4 AS INT) + 1) color_space",
    )
    return out.selectExpr("*", "width * height * CASE color_space WHEN 'DeviceRGB' THEN 3 WHEN 'DeviceGray' THEN 1 WHEN 'DeviceCMYK' THEN 4 ELSE 0 END - IF(img_seq % 5 = 0, 1, 0) AS bytes_len")


IMAGES = """images0_v AS (SELECT l_suppkey AS doc_id, CAST(l_orderkey % 50 AS INTEGER) AS page_no, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS INTEGER) AS img_seq,
    CAST(trunc(l_quantity) AS INTEGER) - 3 AS width, CAST(l_partkey % 37 AS INTEGER) AS height, (['DCTDecode','FlateDecode','JPXDecode','CCITTFaxDecode'])[(l_partkey % 4) + 1] AS filter,
    CASE WHEN l_partkey % 7 = 0 THEN 4 ELSE 8 END AS bpc, (['DeviceRGB','DeviceGray','DeviceCMYK','ICCBased'])[(l_orderkey % 4) + 1] AS color_space FROM lineitem),
images_v AS (SELECT *, width * height * CASE color_space WHEN 'DeviceRGB' THEN 3 WHEN 'DeviceGray' THEN 1 WHEN 'DeviceCMYK' THEN 4 ELSE 0 END - CASE WHEN img_seq % 5 = 0 THEN 1 ELSE 0 END AS bytes_len FROM images0_v),
kinds_v AS (SELECT *, CASE WHEN width <= 0 OR height <= 0 THEN 'none' WHEN filter = 'DCTDecode' THEN 'jpeg' WHEN filter <> 'FlateDecode' THEN 'unsupported' WHEN bpc <> 8 OR color_space = 'ICCBased' THEN 'unsupported'
    WHEN bytes_len < width * height * CASE color_space WHEN 'DeviceRGB' THEN 3 WHEN 'DeviceGray' THEN 1 ELSE 4 END THEN 'unsupported' ELSE 'raw' END AS kind,
    CASE WHEN width <= 0 OR height <= 0 OR filter = 'DCTDecode' THEN '' WHEN filter <> 'FlateDecode' THEN 'filter ' || filter WHEN bpc <> 8 THEN 'bits per component' WHEN color_space = 'ICCBased' THEN 'colour space'
    WHEN bytes_len < width * height * CASE color_space WHEN 'DeviceRGB' THEN 3 WHEN 'DeviceGray' THEN 1 ELSE 4 END THEN 'incomplete pixels' ELSE '' END AS note FROM images_v)"""


def archive(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as entries of archives, in mixed case and with numbers of different lengths."""
    return table(spark, sf, "part").selectExpr("p_brand archive_id", "concat(IF(p_partkey % 2 = 0, 'P', 'p'), p_partkey, element_at(array('.png','.JPG','.gif','.txt','.webp'), CAST(p_size % 5 AS INT) + 1)) entry_name")


ARCHIVE = "archive_v AS (SELECT p_brand AS archive_id, CASE WHEN p_partkey % 2 = 0 THEN 'P' ELSE 'p' END || p_partkey || (['.png','.JPG','.gif','.txt','.webp'])[(p_size % 5) + 1] AS entry_name FROM part)"


#: Customers by nation and ten thousands of their key: books of some four hundred pages each, whose number grows with the data.
BOOK = "c_nationkey + 25 * (c_custkey DIV 10000)"


def page_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as pages of documents, each with five groups of twenty parts: doc_id, node, parent, ord, type,
    resources, media_box, rotate. Some parts hang on a second group, one holds a group, and one the root."""
    customer = table(spark, sf, "customer").withColumn("doc_id", F.expr(BOOK))
    docs = customer.select("doc_id").distinct()
    nodes = docs.selectExpr("doc_id", "explode(sequence(0, 19)) k")
    group = ["IF(k % 2 = 0, concat('G', k), NULL) resources", "CAST(NULL AS STRING) media_box", "IF(k % 2 = 1, 90, NULL) rotate"]
    part = ["IF(k % 3 = 0, concat('S', k), NULL) resources", "IF(k % 4 = 0, concat('M', k), NULL) media_box", "CAST(NULL AS INT) rotate"]
    rows = [
        docs.selectExpr("doc_id", "'r' node", "CAST(NULL AS STRING) parent", "0 ord", "'Pages' type", "'R0' resources", "'M0' media_box", "0 rotate"),
        nodes.where("k < 5").selectExpr("doc_id", "concat('g', k) node", "'r' parent", "k ord", "'Pages' type", *group),
        nodes.where("k = 1").selectExpr("doc_id", "'g1' node", "'s3' parent", "99 ord", "'Pages' type", *group),
        nodes.selectExpr("doc_id", "concat('s', k) node", "concat('g', k % 5) parent", "k ord", "'Pages' type", *part),
        nodes.where("k % 7 = 0").selectExpr("doc_id", "concat('s', k) node", "concat('g', (k + 1) % 5) parent", "50 + k ord", "'Pages' type", *part),
        nodes.where("k = 0").selectExpr("doc_id", "'r' node", "'s5' parent", "98 ord", "'Pages' type", "'R0' resources", "'M0' media_box", "0 rotate"),
        customer.selectExpr("doc_id", "concat('c', c_custkey) node", "concat('s', c_custkey % 20) parent", "CAST(c_custkey AS INT) ord", "'Page' type", "IF(c_custkey % 11 = 0, concat('C', c_custkey), NULL) resources", "IF(c_custkey % 13 = 0, concat('B', c_custkey), NULL) media_box", "IF(c_custkey % 17 = 0, 180, NULL) rotate"),
    ]
    return reduce(DataFrame.unionByName, rows)


PAGE_NODES = """books_v AS (SELECT *, c_nationkey + 25 * (c_custkey // 10000) AS doc_id FROM customer), docs_v AS (SELECT DISTINCT doc_id FROM books_v),
parts_v AS (SELECT doc_id, CAST(k AS INTEGER) AS k, CASE WHEN k % 3 = 0 THEN 'S' || k END AS resources, CASE WHEN k % 4 = 0 THEN 'M' || k END AS media_box, CAST(NULL AS INTEGER) AS rotate FROM docs_v, range(20) t(k)),
groups_v AS (SELECT doc_id, k, CASE WHEN k % 2 = 0 THEN 'G' || k END AS resources, CAST(NULL AS VARCHAR) AS media_box, CASE WHEN k % 2 = 1 THEN 90 END AS rotate FROM parts_v WHERE k < 5),
page_nodes_v AS (SELECT doc_id, 'r' AS node, CAST(NULL AS VARCHAR) AS parent, 0 AS ord, 'Pages' AS type, 'R0' AS resources, 'M0' AS media_box, 0 AS rotate FROM docs_v
UNION ALL SELECT doc_id, 'r', 's5', 98, 'Pages', 'R0', 'M0', 0 FROM docs_v
UNION ALL SELECT doc_id, 'g' || k, 'r', k, 'Pages', resources, media_box, rotate FROM groups_v
UNION ALL SELECT doc_id, 'g1', 's3', 99, 'Pages', resources, media_box, rotate FROM groups_v WHERE k = 1
UNION ALL SELECT doc_id, 's' || k, 'g' || (k % 5), k, 'Pages', resources, media_box, rotate FROM parts_v
UNION ALL SELECT doc_id, 's' || k, 'g' || ((k + 1) % 5), 50 + k, 'Pages', resources, media_box, rotate FROM parts_v WHERE k % 7 = 0
UNION ALL SELECT doc_id, 'c' || c_custkey, 's' || (c_custkey % 20), CAST(c_custkey AS INTEGER), 'Page', CASE WHEN c_custkey % 11 = 0 THEN 'C' || c_custkey END, CASE WHEN c_custkey % 13 = 0 THEN 'B' || c_custkey END, CASE WHEN c_custkey % 17 = 0 THEN 180 END FROM books_v)"""
