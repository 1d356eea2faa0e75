"""Queries of chapters and pagination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.operators import chapters as C
from foliolake.plans import views as V
from foliolake.plans.q_text import BLOCKS, HTML_BLOCKS
from foliolake.plans.registry import query, table

MARKS = (
    "WITH "
    + V.OUTLINE
    + r""", before_v AS (SELECT *, max(page_no) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM outline_v),
marks_v AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS INTEGER) AS mark_no, title AS raw, page_no FROM before_v WHERE before IS NULL OR page_no > before),
docs_v AS (SELECT DISTINCT doc_id, n_pages FROM outline_v),
titled_v AS (SELECT doc_id, mark_no, coalesce(nullif(left(trim(regexp_replace(raw, '\s+', ' ', 'g')), 40), ''), '第 ' || mark_no || ' 节') AS title, page_no FROM marks_v),
ranged_v AS (SELECT doc_id, mark_no AS chap_no, title, page_no AS start_page, greatest(1, coalesce(lead(page_no) OVER (PARTITION BY doc_id ORDER BY mark_no), n_pages) - page_no) AS pages, count(*) OVER (PARTITION BY doc_id) AS n FROM titled_v JOIN docs_v USING (doc_id)),
by_marks_v AS (SELECT doc_id, chap_no, title, start_page, CAST(pages AS INTEGER) AS pages FROM ranged_v WHERE n >= 2),
fixed_v AS (SELECT doc_id, CAST(k + 1 AS INTEGER) AS chap_no, '第 ' || (k + 1) || ' 节' AS title, CAST(20 * k AS INTEGER) AS start_page, CAST(least(20, n_pages - 20 * k) AS INTEGER) AS pages FROM docs_v, range(2) r(k) WHERE 20 * k < n_pages AND doc_id NOT IN (SELECT doc_id FROM by_marks_v)),
chapters_v AS (SELECT * FROM by_marks_v UNION ALL SELECT * FROM fixed_v)"""
)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the outline view with their number of pages."""
    return V.outline(spark, sf).select("doc_id", "n_pages").distinct()


def chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters of the outline view."""
    return C.all_chapters(V.outline(spark, sf), docs(spark, sf))


@query(f"{MARKS} SELECT * FROM titled_v")
def c1_increasing_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of all documents."""
    return C.increasing_marks(V.outline(spark, sf))


@query(f"{MARKS} SELECT * FROM by_marks_v")
def c2_marks_to_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters between marks."""
    return C.marks_to_chapters(C.increasing_marks(V.outline(spark, sf)), docs(spark, sf))


@query(f"{MARKS} SELECT * FROM fixed_v")
def c3_fixed_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of documents without marks."""
    return C.fixed_chapters(docs(spark, sf), C.increasing_marks(V.outline(spark, sf)))


@query(f"{MARKS} SELECT doc_id, chap_no, CAST(unnest(range(start_page + 1, start_page + pages + 1)) AS INTEGER) AS page FROM chapters_v")
def c4_chapter_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of all chapters."""
    return C.chapter_pages(chapters(spark, sf))


@query(
    f"""WITH {V.OUTLINE}, n AS (SELECT doc_id, depth, count(*) AS n FROM outline_v GROUP BY doc_id, depth), l AS (SELECT doc_id, min(CASE WHEN n >= 2 THEN depth END) AS level FROM n GROUP BY doc_id)
SELECT doc_id, seq, depth, title, page_no FROM outline_v JOIN l USING (doc_id) WHERE level IS NULL OR depth = level"""
)
def c5_pick_level(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the level that chapters are made of."""
    return C.pick_level(V.outline(spark, sf)).select("doc_id", "seq", "depth", "title", "page_no")


@query(
    """WITH m AS (SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT doc_id, CAST(k AS INTEGER) AS mark_no FROM m WHERE n <= 40 OR k = 1 OR (k - 1) * 40 // n <> (k - 2) * 40 // n"""
)
def c6_downsample_marks(spark: SparkSession, sf: str) -> DataFrame:
    """At most forty order lines of each supplier."""
    return C.downsample_marks(V.images(spark, sf).select("doc_id", F.col("img_seq").alias("mark_no")))


@query(
    f"""WITH {V.TEXT_LINES}, l AS (SELECT doc_id, line_no, CASE WHEN line_no % 10 = 3 THEN '第' || (line_no // 10 + 1) || '章 ' || line ELSE line END AS line FROM text_lines_v),
s AS (SELECT *, CAST(sum(CASE WHEN line_no % 10 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS chap_no FROM l),
g AS (SELECT doc_id, chap_no, max(CASE WHEN line_no % 10 = 3 THEN trim(line) END) AS title, min(line_no) AS first_line, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, bool_or(trim(line) <> '') AS filled FROM s GROUP BY doc_id, chap_no)
SELECT doc_id, chap_no, left(coalesce(title, '正文'), 40) AS title, first_line, n_lines, n_chars FROM g WHERE chap_no > 0 OR filled"""
)
def c7_split_text_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters of documents whose every tenth line is made a heading."""
    line = lambda x, i: F.when(i % 10 == 3, F.concat(F.lit("第"), F.floor(i / 10 + 1).cast("string"), F.lit("章 "), x)).otherwise(x)
    return C.split_text_chapters(table(spark, sf, "documents").select("doc_id", F.transform(F.split("text", "\n"), line).alias("lines")))


@query(
    BLOCKS
    + r""", s_v AS (SELECT *, type = 'heading' AND level <= 3 AS h FROM blocks_v), c_v AS (SELECT *, CAST(sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) AS INTEGER) AS chap_no FROM s_v),
k_v AS (SELECT doc_id, min_by(array_to_string(lines, ' '), block_no) AS book FROM c_v WHERE type = 'heading' AND level = 1 GROUP BY doc_id),
g_v AS (SELECT doc_id, chap_no, max(CASE WHEN h THEN array_to_string(lines, ' ') END) AS title, count(*) AS n_blocks FROM c_v GROUP BY doc_id, chap_no)
SELECT doc_id, chap_no, coalesce(nullif(left(trim(regexp_replace(title, '\s+', ' ', 'g')), 40), ''), '正文') AS title, n_blocks, book FROM g_v LEFT JOIN k_v USING (doc_id)"""
)
def c8_split_md_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Chapters of the Markdown view."""
    return C.split_md_chapters(V.md_lines(spark, sf))


@query(
    "WITH "
    + HTML_BLOCKS
    + r""", c_v AS (SELECT *, regexp_matches(type, '^h[1-6]$') AS h, CAST(sum(CASE WHEN regexp_matches(type, '^h[1-6]$') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY block_no) AS INTEGER) AS chap_no FROM html_blocks_v)
SELECT page_id, chap_no, coalesce(nullif(left(max(CASE WHEN h THEN text END), 40), ''), '正文') AS title, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM c_v GROUP BY page_id, chap_no"""
)
def c9_split_html_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of all pages."""
    return C.split_html_chapters(table(spark, sf, "pages"))


CHUNKS = r"""q_v AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？!?])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS q FROM documents),
u_v AS (SELECT doc_id, unnest(range(len(q))) AS i, unnest(q) AS s FROM q_v),
p_v AS (SELECT doc_id, i, k, substr(s, k * 1200 + 1, 1200) AS text FROM (SELECT doc_id, i, s, unnest(range((length(s) - 1) // 1200 + 1)) AS k FROM u_v)),
paras_v AS (SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS para_no, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY i, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2000 + 1 AS INTEGER) AS chap_no, text FROM p_v WINDOW w AS (PARTITION BY doc_id ORDER BY i, k))"""


@query(f"WITH {CHUNKS} SELECT * FROM paras_v")
def c10_chunk_headingless(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs and sections of all documents."""
    return C.chunk_headingless(table(spark, sf, "documents"))


@query(
    f"""{MARKS}, p_v AS (SELECT doc_id, CAST(unnest(range(n_pages)) AS INTEGER) AS page_no FROM docs_v)
SELECT p_v.doc_id, page_no, max(chap_no) AS chap_no FROM p_v LEFT JOIN chapters_v c ON c.doc_id = p_v.doc_id AND c.start_page <= page_no GROUP BY p_v.doc_id, page_no"""
)
def c11_chapter_of(spark: SparkSession, sf: str) -> DataFrame:
    """Chapter of every page."""
    pages = docs(spark, sf).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)).alias("page_no"))
    return C.chapter_of(pages, chapters(spark, sf))


#: Turns as blocks of conversations: a type by turn and role, runs of two words, lines for code.
TYPED = """turns_v AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS block_no, CASE turn % 4 WHEN 0 THEN 'para' WHEN 1 THEN 'code' WHEN 2 THEN 'img' ELSE 'heading' END AS type, CASE WHEN (conv_id + turn) % 5 = 0 THEN '  ' ELSE text END AS text FROM conversations)"""


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """The same in Spark."""
    t = table(spark, sf, "conversations").selectExpr("conv_id doc_id", "CAST(turn AS INT) block_no", "element_at(array('para', 'code', 'img', 'heading'), CAST(turn % 4 AS INT) + 1) type", "IF((conv_id + turn) % 5 = 0, '  ', text) text")
    code = F.col("type") == "code"
    run = lambda x: F.struct(x.alias("t"), F.lit(0).alias("b"), F.lit(0).alias("i"), F.lit(0).alias("c"))
    runs = F.array(run(F.left("text", F.lit(7))), run(F.lit(None).cast("string")), run(F.substring("text", F.lit(8), F.length("text"))))
    return t.withColumns({"runs": F.when(~code & (F.col("type") != "img"), runs), "lines": F.when(code, F.split("text", r"\. "))})


@query(
    f"""WITH {TYPED}, r AS (SELECT doc_id, block_no // 2 AS chap_no, bool_or(type IN ('img', 'code') OR trim(text) <> '') AS rich, max(text) AS raw FROM turns_v WHERE doc_id % 3 <> 0 OR type IN ('para', 'heading') GROUP BY 1, 2)
SELECT doc_id, CAST(chap_no AS INTEGER) AS chap_no, 'blocks' AS status FROM r WHERE rich UNION ALL SELECT doc_id, CAST(chap_no AS INTEGER), 'flat' FROM r WHERE NOT rich AND doc_id % 2 = 0"""
)
def c12_chapter_content_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of turns as chapters that have content, rich or flat."""
    b = turns(spark, sf).where("doc_id % 3 <> 0 OR type IN ('para', 'heading')").withColumn("chap_no", F.expr("CAST(block_no DIV 2 AS INT)"))
    ch = b.select("doc_id", "chap_no").distinct().withColumn("raw", F.when(F.col("doc_id") % 2 == 0, "raw").otherwise(" "))
    return C.chapter_content_filter(ch, b).select("doc_id", "chap_no", "status")


@query(
    rf"""WITH {TYPED}, p AS (SELECT doc_id, block_no, CASE WHEN type = 'code' THEN list_transform(string_split(text, '. '), lambda x: trim(x)) ELSE [trim(regexp_replace(text, '\s+', ' ', 'g'))] END AS p FROM turns_v WHERE type <> 'img'),
f AS (SELECT doc_id, block_no, list_filter(p, lambda x: x <> '') AS p FROM p)
SELECT doc_id, block_no, CAST(unnest(range(len(p))) AS INTEGER) AS pos, unnest(p) AS text FROM f"""
)
def c13_blocks_to_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of turns as blocks."""
    return C.blocks_to_paragraphs(turns(spark, sf))


#: The same greedy rule token by token: what a blank, a token beyond the width and any other one do to the open line.
WRAPPED = rf"""WITH RECURSIVE {TYPED}, b AS (SELECT doc_id, block_no, type, text, CASE WHEN type = 'heading' THEN '' ELSE CASE WHEN block_no % 8 = 0 THEN '•' ELSE '' END END AS marker FROM turns_v WHERE type <> 'img'),
u AS (SELECT *, CASE WHEN type = 'code' THEN 62 ELSE 55 END AS unit, CASE WHEN type = 'code' THEN 35 ELSE 40 END AS longest, CASE WHEN marker <> '' THEN 200 ELSE 0 END AS hang,
    regexp_extract_all(text, '[⺀-鿿＀-｠　-〿]|[^\s⺀-鿿＀-｠　-〿]+|\s+') AS ts FROM b),
c AS (SELECT doc_id, block_no, unit, hang, flatten(list_transform(ts, lambda t: list_transform(range(0, (length(t) - 1) // longest + 1), lambda k: substr(t, CAST(k * longest + 1 AS BIGINT), longest)))) AS ts FROM u),
k AS (SELECT doc_id, block_no, hang, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i, unit FROM c),
tok AS (SELECT *, CASE WHEN regexp_matches(t, '^[⺀-鿿＀-｠　-〿]$') THEN 100 ELSE unit * length(t) END AS tw, regexp_matches(t, '^\s') AS blank FROM k),
r AS (SELECT doc_id, block_no, CAST(0 AS BIGINT) AS i, 0 AS line, CAST(hang + CASE WHEN type = 'para' THEN 200 ELSE 0 END AS BIGINT) AS w, true AS bare, false AS shown, '' AS t FROM u
UNION ALL SELECT r.doc_id, r.block_no, x.i, CASE WHEN r.w + tw > 2400 AND NOT bare THEN line + 1 ELSE line END, CASE WHEN blank AND r.w + tw > 2400 THEN hang WHEN blank AND bare THEN r.w WHEN r.w + tw > 2400 THEN hang + tw ELSE r.w + tw END,
    blank AND (r.w + tw > 2400 OR bare), NOT (blank AND (r.w + tw > 2400 OR bare)), x.t FROM r JOIN tok x ON x.doc_id = r.doc_id AND x.block_no = r.block_no AND x.i = r.i + 1),
l AS (SELECT doc_id, block_no, line AS pos, rtrim(string_agg(t, '' ORDER BY i)) AS text, max(w) AS width FROM r WHERE shown GROUP BY doc_id, block_no, line)"""


@query(
    f"""{WRAPPED} SELECT l.doc_id, l.block_no, pos, l.text, CAST(width AS INTEGER) AS width, CAST(CASE WHEN marker <> '' THEN 2 ELSE 0 END + CASE WHEN pos = 0 AND type = 'para' THEN 2 ELSE 0 END AS INTEGER) AS pad,
CASE WHEN pos = 0 AND marker <> '' THEN marker END AS marker, CASE type WHEN 'heading' THEN 'h' || (l.block_no % 3 + 1) ELSE type END AS style, type = 'heading' AS bold, type = 'code' AS mono FROM l JOIN b ON b.doc_id = l.doc_id AND b.block_no = l.block_no"""
)
def c14_wrap_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as blocks, wrapped to a width of 24."""
    marker = F.when((F.col("type") != "heading") & (F.col("block_no") % 8 == 0), "•").otherwise("")
    b = turns(spark, sf).where("type <> 'img'").withColumns({"marker": marker, "level": F.col("block_no") % 3 + 1})
    return C.wrap_lines(b, 24)


@query(
    f"""WITH RECURSIVE {V.IMAGES}, i AS (SELECT doc_id, page_no AS chap_no, img_seq AS seq, height % 4 + 1 AS n_lines, img_seq % 5 = 0 AS figure, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY img_seq) AS k FROM images_v),
r AS (SELECT doc_id, chap_no, seq, n_lines, figure, k, 0 AS line_pos FROM i WHERE k = 1
UNION ALL SELECT i.doc_id, i.chap_no, i.seq, i.n_lines, i.figure, i.k, r.line_pos + CASE WHEN r.figure THEN 6 ELSE r.n_lines END + CASE WHEN i.figure AND 15 - (r.line_pos + CASE WHEN r.figure THEN 6 ELSE r.n_lines END) % 15 < 6
    THEN 15 - (r.line_pos + CASE WHEN r.figure THEN 6 ELSE r.n_lines END) % 15 ELSE 0 END FROM r JOIN i ON i.doc_id = r.doc_id AND i.chap_no = r.chap_no AND i.k = r.k + 1)
SELECT doc_id, chap_no, seq, n_lines, figure, line_pos FROM r"""
)
def c15_place_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as items of suppliers' chapters; each fifth is a figure."""
    items = V.images(spark, sf).selectExpr("doc_id", "page_no chap_no", "img_seq seq", "height % 4 + 1 n_lines", "img_seq % 5 = 0 figure")
    return C.place_figures(items, 6)


PAGED = """counts_v AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS INTEGER) AS chap_no, CAST(o_orderkey % 400 + 1 AS INTEGER) AS n_lines FROM orders),
p0_v AS (SELECT *, greatest(2, (n_lines + 14) // 15 + ((n_lines + 14) // 15) % 2) AS p FROM counts_v),
paged_v AS (SELECT doc_id, chap_no, CAST(p AS INTEGER) AS pages, CAST(coalesce(sum(p) OVER (PARTITION BY doc_id ORDER BY chap_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM p0_v)"""


def paged(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as chapters of customers, paginated."""
    return C.paginate(table(spark, sf, "orders").selectExpr("o_custkey doc_id", "CAST(o_orderkey AS INT) chap_no", "CAST(o_orderkey % 400 + 1 AS INT) n_lines"))


@query(f"WITH {PAGED} SELECT doc_id, chap_no, pages, start, CAST(floor(start / 2 + 0.5) AS INTEGER) AS sheet FROM paged_v")
def c16_paginate(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and starts of all chapters."""
    return paged(spark, sf)


@query(f"WITH {PAGED} SELECT doc_id, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(pages) AS BIGINT) // 2 AS sheets, CAST(sum(pages) AS BIGINT) * 15 AS lines FROM paged_v GROUP BY doc_id")
def c16_book_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of all books."""
    return C.book_layout(paged(spark, sf))


@query(f"WITH {PAGED}, u AS (SELECT doc_id, chap_no, start, CAST(unnest(range(start, start + pages)) AS INTEGER) AS page_no FROM paged_v) SELECT doc_id, page_no, chap_no, page_no = start AS opening FROM u")
def c17_page_meta(spark: SparkSession, sf: str) -> DataFrame:
    """All pages with their chapters."""
    return C.page_meta(paged(spark, sf))


@query(
    f"""WITH {PAGED}, t AS (SELECT *, sum(pages) OVER (PARTITION BY doc_id) AS total, CAST(greatest(0, least(pages, 25 - start)) AS INTEGER) AS r FROM paged_v)
SELECT doc_id, chap_no, pages / total AS share, r / total AS read, (pages - r) / total AS unread FROM t"""
)
def c18_chapter_share(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of chapters, at the twenty-fifth page."""
    return C.chapter_share(paged(spark, sf), F.lit(25)).select("doc_id", "chap_no", "share", "read", "unread")
