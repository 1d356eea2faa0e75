"""Chapters and pagination: marks, ranges, sections, blocks, wrapped lines, pages.

Every window has doc_id in its partition keys, so a document bounds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions.scalars import normalize_title, running_sums, sentences
from foliolake.operators.textstruct import html_blocks, md_blocks

#: Pages and images a section without marks has, characters a paragraph may have, lines a page has.
PER_PAGE_SECTION, PER_IMAGE_SECTION, PARAGRAPH, PAGE_LINES = 20, 30, 1200, 15
#: Ours: characters a section of a text without headings has, and marks kept of a long outline.
SECTION_CHARS, MARKS = 2000, 40
CHAPTER_HEADING = r"^\s*第[0-9零一二三四五六七八九十百千两〇]+[章回节卷部](?:\s|$|[:：])"
DOC = ["doc_id"]


def increasing_marks(outline: DataFrame) -> DataFrame:
    """Marks: doc_id, mark_no, title, page_no, of entries (doc_id, seq, title, page_no) whose page is beyond all pages
    before; a title is cut to 40 characters, an empty one numbered."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    before = F.max(F.when(F.col("page_no") >= 0, F.col("page_no"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = outline.withColumn("before", before).where("page_no >= 0 AND (before IS NULL OR page_no > before)")
    kept = kept.withColumn("mark_no", F.row_number().over(order))
    return kept.select("doc_id", "mark_no", normalize_title(F.col("title"), F.concat(F.lit("第 "), F.col("mark_no").cast("string"), F.lit(" 节"))).alias("title"), "page_no")


def marks_to_chapters(marks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chapters of documents with two marks or more: doc_id, chap_no, title, start_page, pages. docs: doc_id, n_pages."""
    order = Window.partitionBy("doc_id").orderBy("mark_no")
    n = F.count("*").over(Window.partitionBy("doc_id"))
    ranged = marks.join(docs.select("doc_id", "n_pages"), "doc_id").withColumn("n", n).withColumn("to", F.coalesce(F.lead("page_no").over(order), F.col("n_pages"))).where("n >= 2")
    return ranged.select("doc_id", F.col("mark_no").alias("chap_no"), "title", F.col("page_no").alias("start_page"), F.greatest(F.lit(1), F.col("to") - F.col("page_no")).alias("pages"))


def fixed_chapters(docs: DataFrame, marks: DataFrame | None = None, per: int = PER_PAGE_SECTION, noun: str = "节") -> DataFrame:
    """Sections of so many pages for documents with fewer than two marks. docs: doc_id, n_pages."""
    if marks is not None:
        docs = docs.join(marks.groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 2").select("doc_id"), "doc_id", "left_anti")
    cut = docs.where("n_pages > 0").select("doc_id", "n_pages", F.posexplode(F.sequence(F.lit(0), F.col("n_pages") - 1, F.lit(per))).alias("k", "start_page"))
    return cut.select("doc_id", (F.col("k") + 1).alias("chap_no"), F.concat(F.lit("第 "), (F.col("k") + 1).cast("string"), F.lit(" " + noun)).alias("title"), "start_page", F.least(F.lit(per), F.col("n_pages") - F.col("start_page")).alias("pages"))


def all_chapters(outline: DataFrame, docs: DataFrame) -> DataFrame:
    """Chapters by the outline, or sections where there is none."""
    marks = increasing_marks(outline)
    return marks_to_chapters(marks, docs).unionByName(fixed_chapters(docs, marks))


def chapter_pages(chapters: DataFrame) -> DataFrame:
    """One row a page of a chapter: doc_id, chap_no, page (from 1)."""
    return chapters.select("doc_id", "chap_no", F.explode(F.sequence(F.col("start_page") + 1, F.col("start_page") + F.col("pages"))).alias("page"))


def pick_level(outline: DataFrame) -> DataFrame:
    """Entries of the shallowest depth that has two or more; all entries of a document that has no such depth."""
    counts = outline.groupBy("doc_id", F.coalesce("depth", F.lit(1)).alias("d")).agg(F.count("*").alias("n"))
    level = counts.groupBy("doc_id").agg(F.min(F.when(F.col("n") >= 2, F.col("d"))).alias("level"))
    return outline.join(level, "doc_id").where(F.col("level").isNull() | (F.coalesce("depth", F.lit(1)) == F.col("level"))).drop("level")


def downsample_marks(marks: DataFrame, cap: int = MARKS) -> DataFrame:
    """At most so many marks of a document, evenly spread, the first among them."""
    k, n = F.row_number().over(Window.partitionBy("doc_id").orderBy("mark_no")), F.count("*").over(Window.partitionBy("doc_id"))
    out = marks.withColumns({"_k": k, "_n": n})
    keep = (F.col("_n") <= cap) | (F.col("_k") == 1) | (F.floor((F.col("_k") - 1) * cap / F.col("_n")) != F.floor((F.col("_k") - 2) * cap / F.col("_n")))
    return out.where(keep).drop("_k", "_n")


def _sections(rows: DataFrame, order_col: str, is_heading: Column, by: list[str] | None = None) -> DataFrame:
    """Adds chap_no: how many headings came up to a row; rows before the first belong to chapter 1 if they stand alone."""
    order = Window.partitionBy(*(by or DOC)).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("is_heading", is_heading).withColumn("chap_no", F.sum(F.col("is_heading").cast("int")).over(order).cast("int"))


def split_text_chapters(docs: DataFrame) -> DataFrame:
    """Chapters of plain text: doc_id, chap_no, title, first_line, n_lines, n_chars. docs: doc_id, lines array<string>. A
    numbered chapter line starts one; what comes before the first, if it isn't blank, is chapter 0; numbered list lines are
    no headings. A chapter is a slice of its document's lines, so nothing is shuffled."""
    begins = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(CHAPTER_HEADING), i)), lambda i: i.isNotNull())
    rows = docs.select("doc_id", "lines", F.concat(F.array(F.lit(0)), begins).alias("b"))  # chapter 0 begins with the text

    def chapter(at: Column, k: Column) -> Column:
        own = F.slice("lines", at + 1, F.coalesce(F.get("b", k + 1), F.size("lines")) - at)
        return F.struct(
            k.cast("int").alias("chap_no"), F.when(k > 0, F.trim(F.get("lines", at))).alias("title"), at.alias("first_line"), F.size(own).cast("long").alias("n_lines"),
            F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("n_chars"), F.exists(own, lambda x: F.trim(x) != "").alias("filled"),
        )

    out = rows.select("doc_id", F.inline(F.transform("b", chapter)))
    return out.where("chap_no > 0 OR filled").select("doc_id", "chap_no", F.left(F.coalesce("title", F.lit("正文")), F.lit(40)).alias("title"), "first_line", "n_lines", "n_chars")


def split_md_chapters(lines: DataFrame, depth: int = 3) -> DataFrame:
    """Chapters of Markdown: doc_id, chap_no, title, n_blocks, book (the first heading of level 1)."""
    rows = _sections(md_blocks(lines), "block_no", (F.col("type") == "heading") & (F.col("level") <= depth))
    first = F.array_join("lines", " ")
    book = rows.groupBy("doc_id").agg(F.min_by(F.when(F.col("level") == 1, first), F.when((F.col("type") == "heading") & (F.col("level") == 1), F.col("block_no"))).alias("book"))
    out = rows.groupBy("doc_id", "chap_no").agg(F.max(F.when(F.col("is_heading"), first)).alias("title"), F.count("*").alias("n_blocks"))
    return out.join(book.hint("merge"), "doc_id").select("doc_id", "chap_no", normalize_title(F.col("title"), F.lit("正文")).alias("title"), "n_blocks", "book")


def split_html_chapters(pages: DataFrame) -> DataFrame:
    """Sections of pages led by headings: page_id, chap_no, title, n_blocks, n_chars."""
    rows = _sections(html_blocks(pages), "block_no", F.col("type").rlike("^h[1-6]$"), ["page_id"])
    out = rows.groupBy("page_id", "chap_no").agg(F.max(F.when(F.col("is_heading"), F.col("text"))).alias("title"), F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))
    return out.select("page_id", "chap_no", normalize_title(F.col("title"), F.lit("正文")).alias("title"), "n_blocks", "n_chars")


def chunk_headingless(docs: DataFrame, most: int = PARAGRAPH, section: int = SECTION_CHARS) -> DataFrame:
    """Paragraphs of texts without headings: doc_id, para_no, chap_no, text. Sentences longer than ``most`` characters are
    cut; a new section starts after so many characters. Characters are added up within the row."""
    cut = F.flatten(F.transform(sentences(F.coalesce("text", F.lit(""))), lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda k: F.substring(s, k * most + 1, F.lit(most)))))
    rows = docs.select("doc_id", cut.alias("p"))
    rows = rows.withColumn("until", running_sums(F.transform("p", lambda t: F.length(t))))
    paragraph = F.transform("p", lambda t, i: F.struct((F.floor((F.get("until", i) - F.length(t)) / section) + 1).cast("int").alias("chap_no"), t.alias("text")))
    return rows.select("doc_id", F.posexplode(paragraph).alias("para_no", "r")).select("doc_id", "para_no", "r.chap_no", "r.text")


def chapter_of(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """Adds chap_no to pages (doc_id, page_no): the last chapter that starts at or before the page; null before the first.
    An as-of join: both tables are sorted together by document and page, each shuffled once."""
    a = chapters.select("doc_id", F.col("start_page").alias("page_no"), F.col("chap_no").alias("here"), F.lit(0).alias("kind"))
    b = pages.select("doc_id", "page_no", F.lit(None).cast("int").alias("here"), F.lit(1).alias("kind"))
    last = F.last("here", True).over(Window.partitionBy("doc_id").orderBy("page_no", "kind", "here"))
    return a.unionByName(b).withColumn("chap_no", last).where("kind = 1").select("doc_id", "page_no", "chap_no")


def run_text(runs: Column) -> Column:
    """Text of runs, nulls skipped."""
    return F.array_join(F.transform(runs, lambda r: r["t"]), "")


def chapter_content_filter(chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chapters with an image, text in runs or lines of code: status ``blocks``; others that have text outside: status
    ``flat``; the rest is dropped. blocks: doc_id, chap_no, type, runs, lines; chapters: doc_id, chap_no, raw."""
    rich = blocks.groupBy("doc_id", "chap_no").agg(F.bool_or((F.col("type") == "img") | (F.trim(run_text(F.col("runs"))) != "") | (F.size("lines") > 0)).alias("rich"))
    out = chapters.join(rich, ["doc_id", "chap_no"], "left")
    status = F.when(F.coalesce("rich", F.lit(False)), "blocks").when(F.trim(F.coalesce("raw", F.lit(""))) != "", "flat")
    return out.withColumn("status", status).where("status IS NOT NULL").drop("rich")


def empty_documents(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Documents of which no chapter was kept, with a reason."""
    return docs.select("doc_id").join(kept.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("reason", F.lit("no readable text"))


def blocks_to_paragraphs(blocks: DataFrame) -> DataFrame:
    """Paragraphs of blocks: doc_id, block_no, pos, text. Images are skipped, code gives a paragraph a line, others their
    run text with white space collapsed; empty ones are dropped."""
    flat = F.array(F.trim(F.regexp_replace(run_text(F.col("runs")), r"\s+", " ")))
    parts = F.filter(F.when(F.col("type") == "code", F.transform("lines", lambda s: F.trim(s))).otherwise(flat), lambda s: s != "")
    return blocks.where("type <> 'img'").select("doc_id", "block_no", F.posexplode(parts).alias("pos", "text"))


#: Elements that a fold gathers before it puts them aside: to append to an array copies it, so a long one is built of parts.
PART = 256


def _gathered(a: Column, x: Column, kind: str) -> tuple[Column, Column]:
    """``part`` and ``out`` of a fold's state after one more element."""
    full = F.size(a["part"]) >= PART
    return F.array_append(F.when(full, F.array().cast(f"array<{kind}>")).otherwise(a["part"]), x), F.when(full, F.array_append(a["out"], a["part"])).otherwise(a["out"])


def wrap_lines(blocks: DataFrame, budget: int, pad: int = 2) -> DataFrame:
    """Lines of blocks (doc_id, block_no, type, marker, text, and level for headings) within a width: doc_id, block_no, pos,
    text, width (in hundredths of a wide character, indents included), pad, marker, style, bold, mono.

    Lines are filled greedily with words and wide characters; a word longer than a line is cut. A paragraph's first line
    is indented by ``pad``; the lines of a list item all have its marker's width, and the first one has the marker. Lines
    of headings are bold and have their level's style, those of code are monospaced. The fold holds one block.
    """
    mono = F.col("type") == "code"
    wide = "[⺀-鿿＀-｠　-〿]"
    unit = F.when(mono, 62).otherwise(55)
    longest = F.greatest(F.lit(1), F.floor((budget - pad) * 100 / unit).cast("int"))
    tokens = F.regexp_extract_all("text", F.lit(rf"{wide}|[^\s⺀-鿿＀-｠　-〿]+|\s+"), F.lit(0))
    cut = F.flatten(F.transform(tokens, lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / F.col("longest")).cast("int")), lambda k: F.substring(t, k * F.col("longest") + 1, F.col("longest")))))
    indent = F.when(F.col("type") == "para", 100 * pad).otherwise(0)
    hang = F.when(F.col("marker") != "", 100 * pad).otherwise(0)
    line = "struct<text:string,width:int>"
    start = F.struct(F.lit("").alias("cur"), (indent + hang).cast("int").alias("w"), F.array().cast(f"array<{line}>").alias("part"), F.array().cast(f"array<array<{line}>>").alias("out"))

    def closed(a: Column) -> tuple[Column, Column]:
        return _gathered(a, F.struct(F.rtrim(a["cur"]).alias("text"), a["w"].alias("width")), line)

    def step(a: Column, t: Column) -> Column:
        w = F.when(t.rlike(f"^{wide}$"), 100).otherwise(F.col("unit") * F.length(t)).cast("int")
        blank = t.rlike(r"^\s")
        over = a["w"] + w > 100 * budget
        cur = F.when(blank & (over | (a["cur"] == "")), F.when(over, "").otherwise(a["cur"])).when(over, t).otherwise(F.concat(a["cur"], t))
        width = F.when(blank & over, F.col("hang")).when(blank & (a["cur"] == ""), a["w"]).when(over, F.col("hang") + w).otherwise(a["w"] + w).cast("int")
        part, out = closed(a)
        ends = over & (a["cur"] != "")
        return F.struct(cur.alias("cur"), width.alias("w"), F.when(ends, part).otherwise(a["part"]).alias("part"), F.when(ends, out).otherwise(a["out"]).alias("out"))

    def end(a: Column) -> Column:
        part, out = closed(a)
        more = F.rtrim(a["cur"]) != ""
        return F.flatten(F.array_append(F.when(more, out).otherwise(a["out"]), F.when(more, part).otherwise(a["part"])))

    level = F.concat(F.lit("h"), F.coalesce(F.col("level"), F.lit(1)).cast("string")) if "level" in blocks.columns else F.lit("h1")
    style = F.when(F.col("type") == "heading", level).otherwise(F.col("type"))
    rows = blocks.withColumns({"unit": unit, "longest": longest, "hang": hang, "style": style}).withColumn("t", cut)
    rows = rows.select("doc_id", "block_no", "type", "hang", "marker", "style", F.posexplode(F.aggregate("t", start, step, end)).alias("pos", "l"))
    first = F.col("pos") == 0
    padded = (F.col("hang") / 100 + F.when(first & (F.col("type") == "para"), pad).otherwise(0)).cast("int")
    return rows.select("doc_id", "block_no", "pos", "l.text", "l.width", padded.alias("pad"), F.when(first & (F.col("marker") != ""), F.col("marker")).alias("marker"), "style", (F.col("type") == "heading").alias("bold"), (F.col("type") == "code").alias("mono"))


def place_figures(items: DataFrame, fig_lines: int, page_lines: int = PAGE_LINES) -> DataFrame:
    """Adds line_pos to items (doc_id, chap_no, seq, n_lines, figure): where each begins in its chapter; a figure takes
    ``fig_lines`` and moves to the next page rather than straddle one. The fold holds one chapter's items and lays them
    out again with their places."""
    rest = [c for c in items.columns if c not in ("doc_id", "chap_no", "seq", "line_pos")]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("part"), F.array().cast("array<array<int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        left = page_lines - a["at"] % page_lines
        at = F.when(x["figure"] & (left < fig_lines), a["at"] + left).otherwise(a["at"]).cast("int")
        part, out = _gathered(a, at, "int")
        return F.struct((at + F.when(x["figure"], fig_lines).otherwise(x["n_lines"])).cast("int").alias("at"), part.alias("part"), out.alias("out"))

    rows = items.groupBy("doc_id", "chap_no").agg(F.sort_array(F.collect_list(F.struct("seq", *rest))).alias("s"))
    places = F.aggregate("s", start, step, lambda a: F.flatten(F.array_append(a["out"], a["part"])))
    placed = rows.select("doc_id", "chap_no", F.inline(F.zip_with("s", places, lambda x, p: F.struct(x.alias("item"), p.alias("line_pos")))))
    return placed.select("doc_id", "chap_no", "item.*", "line_pos")


def paginate(line_counts: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """Pages of chapters (doc_id, chap_no, n_lines): doc_id, chap_no, pages (even), start, sheet (of a jump)."""
    p = F.ceil(F.col("n_lines") / page_lines)
    pages = F.greatest(F.lit(2), p + p % 2).cast("int")
    start = F.coalesce(F.sum("pages").over(Window.partitionBy("doc_id").orderBy("chap_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return line_counts.select("doc_id", "chap_no", pages.alias("pages")).withColumn("start", start).withColumn("sheet", F.floor(F.col("start") / 2 + 0.5).cast("int"))


def book_layout(paged: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """Totals of books: doc_id, pages, sheets, lines."""
    n = paged.groupBy("doc_id").agg(F.sum("pages").alias("p"))
    n = n.select("doc_id", (F.col("p") + F.col("p") % 2).alias("pages"))
    return n.select("doc_id", "pages", F.expr("pages DIV 2").alias("sheets"), (F.col("pages") * page_lines).alias("lines"))


def page_meta(paged: DataFrame) -> DataFrame:
    """Every page with its chapter, and whether it is the chapter's first: doc_id, page_no, chap_no, opening."""
    rows = paged.select("doc_id", "chap_no", "start", F.explode(F.sequence("start", F.col("start") + F.col("pages") - 1)).alias("page_no"))
    return rows.select("doc_id", "page_no", "chap_no", (F.col("page_no") == F.col("start")).alias("opening"))


def chapter_share(paged: DataFrame, at: Column | None = None) -> DataFrame:
    """Adds share (of the book's pages), read and unread (shares before and after a position) to chapters."""
    total = F.sum("pages").over(Window.partitionBy("doc_id"))
    at = F.lit(0) if at is None else at
    read = F.greatest(F.lit(0), F.least(F.col("pages"), at - F.col("start")))
    return paged.withColumns({"share": F.col("pages") / total, "read": read / total, "unread": (F.col("pages") - read) / total})
