"""Structure of text: Markdown lines and blocks, blocks of HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING, QUOTE, BULLET, ORDERED = r"^(#{1,6})\s+(.*)$", r"^>\s?(.*)$", r"^\s*[-*+]\s+(.*)$", r"^\s*(\d+)[.)]\s+(.*)$"
FENCE, RULE, ROW = r"^\s*(?:```|~~~)", r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$", r"^\s*\|.*\|\s*$"
SEPARATOR = r"^\s*\|[\s:|-]*-[\s:|-]*\|\s*$"


def classify_md_lines(lines: DataFrame) -> DataFrame:
    """Adds type, level, marker and body to lines (doc_id, line_no, line) of Markdown, each line by itself."""
    x = F.col("line")
    kind = (
        F.when(x.rlike(FENCE), "fence").when(x.rlike(HEADING), "heading").when(x.rlike(RULE), "rule").when(x.rlike(QUOTE), "quote").when(x.rlike(BULLET), "item").when(x.rlike(ORDERED), "item")
        .when(x.rlike(SEPARATOR), "separator").when(x.rlike(ROW), "row").when(F.trim(x) == "", "blank").otherwise("text")
    )
    t = F.col("type")
    bullet = x.rlike(BULLET)
    level = F.when(t == "heading", F.length(F.regexp_extract(x, HEADING, 1))).otherwise(0)
    marker = F.when((t == "item") & bullet, "•").when(t == "item", F.concat(F.regexp_extract(x, ORDERED, 1), F.lit("."))).otherwise("")
    cells = F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*\||\|\s*$", ""), r"\s*\|\s*", "  "))
    body = F.when(t == "heading", F.regexp_extract(x, HEADING, 2)).when(t == "quote", F.regexp_extract(x, QUOTE, 1)).when((t == "item") & bullet, F.regexp_extract(x, BULLET, 1)).when(t == "item", F.regexp_extract(x, ORDERED, 2)).when(t == "row", cells).when(t.isin("rule", "fence", "separator", "blank"), "").otherwise(x)
    return lines.withColumn("type", kind).withColumns({"level": level, "marker": marker, "body": body})


def fenced_code(classified: DataFrame) -> DataFrame:
    """Adds fence_no and in_code to classified lines: those between an odd fence and the next are code, whatever they look
    like, and their body is the line itself."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(F.col("type") == "fence", 1).otherwise(0)).over(order)
    out = classified.withColumn("fence_no", n).withColumn("in_code", (F.col("fence_no") % 2 == 1) & (F.col("type") != "fence"))
    return out.withColumns({"type": F.when(F.col("in_code"), "code").otherwise(F.col("type")), "body": F.when(F.col("in_code"), F.col("line")).otherwise(F.col("body")), "marker": F.when(F.col("in_code"), "").otherwise(F.col("marker")), "level": F.when(F.col("in_code"), 0).otherwise(F.col("level"))})


def assemble_blocks(lines: DataFrame) -> DataFrame:
    """Blocks: doc_id, block_no (from 0), first_line, type, level, marker, lines array<string>. Neighbouring lines of text,
    of a quote or of one fence are one block; others stand alone; blanks, separators and fences are dropped."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    joins = F.col("type").isin("text", "quote", "code") & F.equal_null(F.lag("type").over(order), F.col("type")) & F.equal_null(F.lag("fence_no").over(order), F.col("fence_no"))
    island = F.sum(F.when(joins, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = lines.withColumn("island", island).where(~F.col("type").isin("blank", "separator", "fence"))
    made = kept.groupBy("doc_id", "island").agg(
        F.min("line_no").alias("first_line"), F.first("type").alias("type"), F.max("level").alias("level"), F.max("marker").alias("marker"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda s: s["body"]).alias("lines"),
    )
    made = made.withColumn("type", F.when(F.col("type").isin("text", "row"), "para").otherwise(F.col("type")))
    return made.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")) - 1).alias("block_no"), "first_line", "type", "level", "marker", "lines")


def md_blocks(lines: DataFrame) -> DataFrame:
    """All three steps."""
    return assemble_blocks(fenced_code(classify_md_lines(lines)))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings, paragraphs, list items and images of pages in order: page_id, block_no, type, text (an image's source).
    Scripts, styles, comments and menus are ignored, and blocks without text dropped."""
    h: Column = F.coalesce(F.col(html_col), F.lit(""))
    h = F.regexp_replace(h, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<nav\b.*?</nav>", " ")
    h = F.regexp_replace(h, r'(?i)<img\b[^>]*?\ssrc="([^"]*)"[^>]*>', "\u0001img\u0002$1</p>")
    h = F.regexp_replace(h, r"(?i)<(h[1-6]|p|li)(?:\s[^>]*)?>", "\u0001$1\u0002")
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(F.split(h, "\u0001")).alias("pos", "piece")).where(F.contains("piece", F.lit("\u0002")))
    rest = F.regexp_replace(F.split("piece", "\u0002").getItem(1), r"(?is)</(?:h[1-6]|p|li|article|body|footer)>.*", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(rest, "<[^>]*>", " "), r"\s+", " "))
    rows = rows.select("page_id", "pos", F.lower(F.split("piece", "\u0002").getItem(0)).alias("type"), text.alias("text")).where("text <> ''")
    return rows.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1).alias("block_no"), "type", "text")
