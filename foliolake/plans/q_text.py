"""Queries of text structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.operators import textstruct as T
from foliolake.plans import views as V
from foliolake.plans.registry import query, table

CLASSIFIED = (
    "WITH "
    + V.MD_LINES
    + r""", typed_v AS (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, '^\s*(?:```|~~~)') THEN 'fence' WHEN regexp_matches(line, '^(#{1,6})\s+(.*)$') THEN 'heading' WHEN regexp_matches(line, '^\s*(?:-{3,}|\*{3,}|_{3,})\s*$') THEN 'rule'
WHEN regexp_matches(line, '^>\s?(.*)$') THEN 'quote' WHEN regexp_matches(line, '^\s*[-*+]\s+(.*)$') OR regexp_matches(line, '^\s*(\d+)[.)]\s+(.*)$') THEN 'item' WHEN regexp_matches(line, '^\s*\|[\s:|-]*-[\s:|-]*\|\s*$') THEN 'separator'
WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'row' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS type FROM md_lines_v),
class_v AS (SELECT doc_id, line_no, line, type, CASE WHEN type = 'heading' THEN length(regexp_extract(line, '^(#{1,6})\s+(.*)$', 1)) ELSE 0 END AS level,
CASE WHEN type <> 'item' THEN '' WHEN regexp_matches(line, '^\s*[-*+]\s+(.*)$') THEN '•' ELSE regexp_extract(line, '^\s*(\d+)[.)]\s+(.*)$', 1) || '.' END AS marker,
CASE type WHEN 'heading' THEN regexp_extract(line, '^(#{1,6})\s+(.*)$', 2) WHEN 'quote' THEN regexp_extract(line, '^>\s?(.*)$', 1) WHEN 'item' THEN CASE WHEN regexp_matches(line, '^\s*[-*+]\s+(.*)$') THEN regexp_extract(line, '^\s*[-*+]\s+(.*)$', 1) ELSE regexp_extract(line, '^\s*(\d+)[.)]\s+(.*)$', 2) END
WHEN 'row' THEN trim(regexp_replace(regexp_replace(line, '^\s*\||\|\s*$', '', 'g'), '\s*\|\s*', '  ', 'g')) WHEN 'text' THEN line ELSE '' END AS body FROM typed_v)"""
)
FENCED = (
    CLASSIFIED
    + """, f0_v AS (SELECT *, CAST(sum(CASE WHEN type = 'fence' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS fence_no FROM class_v),
fenced_v AS (SELECT doc_id, line_no, line, fence_no, CASE WHEN c THEN 'code' ELSE type END AS type, CASE WHEN c THEN 0 ELSE level END AS level, CASE WHEN c THEN '' ELSE marker END AS marker, CASE WHEN c THEN line ELSE body END AS body FROM (SELECT *, fence_no % 2 = 1 AND type <> 'fence' AS c FROM f0_v))"""
)
BLOCKS = (
    FENCED
    + """, i_v AS (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM (SELECT *, type IN ('text', 'quote', 'code') AND coalesce(lag(type) OVER w = type AND lag(fence_no) OVER w = fence_no, false) AS j FROM fenced_v WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))),
b_v AS (SELECT doc_id, island, min(line_no) AS first_line, min(CASE WHEN type IN ('text', 'row') THEN 'para' ELSE type END) AS type, max(level) AS level, max(marker) AS marker, list(body ORDER BY line_no) AS lines FROM i_v WHERE type NOT IN ('blank', 'separator', 'fence') GROUP BY doc_id, island),
blocks_v AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS INTEGER) AS block_no, first_line, type, level, marker, lines FROM b_v)"""
)
HTML_BLOCKS = r"""h_v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<nav\b.*?</nav>', ' ', 'g'), '(?i)<img\b[^>]*?\ssrc="([^"]*)"[^>]*>', chr(1) || 'img' || chr(2) || '\1</p>', 'g'), '(?i)<(h[1-6]|p|li)(?:\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g') AS h FROM pages),
s_v AS (SELECT page_id, unnest(range(len(ps))) AS pos, unnest(ps) AS piece FROM (SELECT page_id, string_split(h, chr(1)) AS ps FROM h_v)),
t_v AS (SELECT page_id, pos, lower(split_part(piece, chr(2), 1)) AS type, trim(regexp_replace(regexp_replace(regexp_replace(split_part(piece, chr(2), 2), '(?is)</(?:h[1-6]|p|li|article|body|footer)>.*', ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM s_v WHERE contains(piece, chr(2))),
html_blocks_v AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS block_no, type, text FROM t_v WHERE text <> '')"""


@query(f"{CLASSIFIED} SELECT doc_id, line_no, type, CAST(level AS INTEGER) AS level, marker, body FROM class_v")
def t1_classify_md_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of all lines."""
    return T.classify_md_lines(V.md_lines(spark, sf)).select("doc_id", "line_no", "type", "level", "marker", "body")


@query(f"{FENCED} SELECT doc_id, line_no, fence_no, type, body FROM fenced_v")
def t2_fenced_code(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of all lines with code between fences."""
    return T.fenced_code(T.classify_md_lines(V.md_lines(spark, sf))).select("doc_id", "line_no", "fence_no", "type", "body")


@query(f"{BLOCKS} SELECT doc_id, block_no, first_line, type, CAST(level AS INTEGER) AS level, marker, array_to_string(lines, chr(10)) AS body FROM blocks_v")
def t3_assemble_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of all documents."""
    return T.md_blocks(V.md_lines(spark, sf)).select("doc_id", "block_no", "first_line", "type", "level", "marker", F.array_join("lines", "\n").alias("body"))


@query(f"WITH {HTML_BLOCKS} SELECT * FROM html_blocks_v")
def t4_html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of all pages."""
    return T.html_blocks(table(spark, sf, "pages"))
