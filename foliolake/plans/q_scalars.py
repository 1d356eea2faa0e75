"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.functions import scalars as P
from foliolake.operators import charmap
from foliolake.plans import views as V
from foliolake.plans.registry import query, table


@query(
    """WITH t AS (SELECT doc_id, CASE doc_id % 9 WHEN 4 THEN text || chr(65533) WHEN 5 THEN text || chr(65533) || 'z' WHEN 6 THEN text || chr(65533) || '😀' WHEN 7 THEN regexp_replace(text, '[^\x01-\x7F]', '', 'g') || 'é' WHEN 8 THEN '' ELSE text END AS t FROM documents)
SELECT doc_id, md5(t) AS digest, length(t) AS n FROM t"""
)
def p1_decode_text(spark: SparkSession, sf: str) -> DataFrame:
    """Documents encoded in nine ways by turns, and decoded without knowing which: UTF-16 of both kinds with an odd byte
    too many, UTF-8 with and without a mark, with a bad byte, with halves of pairs, Latin-1, and no bytes."""
    k, t = F.col("doc_id") % 9, F.col("text")
    data = lambda x: F.lit(bytearray(bytes.fromhex(x)))
    big, utf8 = F.encode(t, "UTF-16BE"), F.encode(t, "UTF-8")
    raw = F.when(k == 0, F.concat(data("feff"), big, data("00"))).when(k == 1, F.concat(data("fffe"), F.encode(t, "UTF-16LE"), data("d8"))).when(k == 2, F.concat(data("efbbbf"), utf8)).when(k == 3, utf8)
    raw = raw.when(k == 4, F.concat(data("efbbbf"), utf8, data("ff"))).when(k == 5, F.concat(data("feff"), big, data("d800007a"))).when(k == 6, F.concat(data("fffe"), F.encode(t, "UTF-16LE"), data("00de3dd800de")))
    raw = raw.when(k == 7, F.concat(F.encode(F.regexp_replace(t, "[^\x01-\x7F]", ""), "UTF-8"), data("e9"))).otherwise(data(""))
    got = table(spark, sf, "documents").select("doc_id", P.decode_text(raw).alias("t"))
    return got.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


NAMES = ["UniGB-UCS2-H", "GBK-EUC-H", "GB-EUC-V", "EUC-H", "B5pc-H", "CNS-EUC-H", "ETen-B5-V", "90ms-RKSJ-H", "90pv-RKSJ", "EUC-JP", "KSCms-UHC-H", "Identity-H", "UniJIS-UTF16-V"]


@query(
    f"""WITH n AS (SELECT doc_id, ({NAMES})[(doc_id % {len(NAMES)}) + 1] AS name FROM documents)
SELECT doc_id, name, ({["unicode", "gbk", "gbk", "gbk", "big5", "big5", "big5", "shift_jis", "shift_jis", "euc-jp", "euc-kr", "", "unicode"]})[(doc_id % {len(NAMES)}) + 1] AS charset FROM n"""
)
def p2_legacy_charset(spark: SparkSession, sf: str) -> DataFrame:
    """Charsets of map names, dealt over the documents; empty where there is none."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES)).cast("int") + 1)
    return table(spark, sf, "documents").select("doc_id", name.alias("name"), F.coalesce(P.legacy_charset(name), F.lit("")).alias("charset"))


GLYPHS = ["space", "eacute", "uni4E2D", "u1F600", "cid12", "A", "germandbls", "uni00e9.alt", "u12", "Scaron", "endash", "glyph7", "uni12", "OE", "uniD800"]
GLYPH_TEXT = [" ", "é", "中", "😀", "", "A", "ß", "é", "", "Š", "–", "", "", "Œ", "\ufffd"]


@query(f"SELECT doc_id, ({GLYPHS})[(doc_id % {len(GLYPHS)}) + 1] AS name, ({GLYPH_TEXT})[(doc_id % {len(GLYPHS)}) + 1] AS uni FROM documents")
def p3_glyph_to_unicode(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of glyph names, dealt over the documents."""
    name = F.element_at(F.array(*map(F.lit, GLYPHS)), (F.col("doc_id") % len(GLYPHS)).cast("int") + 1)
    return charmap.glyph_to_unicode(table(spark, sf, "documents").select("doc_id", name.alias("name")), "name", "uni")


FONTS = ["Courier New", "Times", "DejaVuSansMono", "SourceCodePro", "Fira  Code", "Georgia", "JETBRAINS", "Menlo-Bold"]


@query(f"SELECT doc_id, (doc_id % 8) IN (0, 2, 3, 4, 6, 7) AS mono FROM documents")
def p4_is_mono_font(spark: SparkSession, sf: str) -> DataFrame:
    """Whether font names, dealt over the documents, are monospaced."""
    return table(spark, sf, "documents").select("doc_id", P.is_mono_font(F.element_at(F.array(*map(F.lit, FONTS)), (F.col("doc_id") % 8).cast("int") + 1)).alias("mono"))


@query(
    """WITH n AS (SELECT doc_id, text, length(text) AS n, length(text) - length(regexp_replace(text, '[  ]', '', 'g')) AS b, length(text) - length(regexp_replace(text, '[⺀-鿿＀-｠]', '', 'g')) AS w FROM (SELECT doc_id, text || '中文' AS text FROM documents))
SELECT doc_id, (b * CASE WHEN doc_id % 2 = 0 THEN 55 ELSE 25 END + w * 95 + (n - b - w) * CASE WHEN doc_id % 2 = 0 THEN 55 ELSE 45 END) * 10::DOUBLE / 100 AS advance FROM n"""
)
def p5_approx_advance(spark: SparkSession, sf: str) -> DataFrame:
    """Advance of whole texts at size 10, monospaced by turns."""
    return table(spark, sf, "documents").select("doc_id", P.approx_advance(F.concat("text", F.lit("中文")), F.lit(10.0), F.col("doc_id") % 2 == 0).alias("advance"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 + l_tax_i * 0.5 + 72 AS x, l_quantity * 0.25 + l_tax_i * 4 - 8 AS y FROM (SELECT *, CAST(l_suppkey % 64 AS DOUBLE) AS l_tax_i FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem))")
def p6_text_position(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of order lines' numbers under one page matrix."""
    num = lambda *x: F.array(*(F.lit(float(v)) if not isinstance(v, str) else F.col(v).cast("double") for v in x))
    rows = table(spark, sf, "lineitem").withColumn("k", F.col("l_suppkey") % 64)
    p = P.text_position(num(1, 0, 0, 1, "l_quantity", "k"), num(2, 0.25, 0.5, 4, 72, -8))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", p["x"].alias("x"), p["y"].alias("y"))


@query(r"SELECT conv_id, turn, coalesce(nullif(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 40), ''), 'turn ' || turn) AS title FROM conversations")
def p7_normalize_title(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of turns."""
    return table(spark, sf, "conversations").select("conv_id", "turn", P.normalize_title(F.col("text"), F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("title"))


@query(rf"WITH {V.FILES} SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE text END, '\s+', ' ', 'g')), 40), ''), 'doc_' || doc_id) AS title FROM files_v")
def p8_doc_title(spark: SparkSession, sf: str) -> DataFrame:
    """Titles from the text, or from the file's name."""
    return V.files(spark, sf).select("doc_id", P.doc_title(F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("text")), F.col("path")).alias("title"))


@query(f"WITH {V.IMAGES} SELECT doc_id, img_seq, kind, note FROM kinds_v")
def p9_image_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds and notes of every image description."""
    return kinds(spark, sf).select("doc_id", "img_seq", "kind", "note")


def kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Images with their kind and note; ICC-based colours have no known number of components."""
    k = P.image_kind(F.col("width"), F.col("height"), F.array("filter"), F.col("color_space"), F.col("bpc"), F.col("bytes_len"), F.lit(False))
    return V.images(spark, sf).withColumn("k", k).select("*", "k.kind", "k.note").drop("k")


@query(
    r"""WITH s AS (SELECT page_id, string_split(regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '([。！？!?])\s*', '\1' || chr(1), 'g'), chr(1)) AS p FROM pages),
e AS (SELECT page_id, list_filter(list_transform(p, lambda x: trim(x)), lambda x: x <> '') AS p FROM s)
SELECT page_id, CAST(unnest(range(len(p))) AS INTEGER) AS pos, unnest(p) AS sentence FROM e"""
)
def p10_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every page."""
    return table(spark, sf, "pages").select("page_id", F.posexplode(P.sentences(P.strip_tags(F.col("html")))).alias("pos", "sentence"))


@query(
    """WITH h AS (SELECT page_id, replace(html, '<a href=', '<img alt="" src=') AS html FROM pages)
SELECT page_id, regexp_extract(html, '<img[^>]+src="([^"]+)"', 1) AS first, CAST(len(regexp_extract_all(html, '<img[^>]*? src="([^"]+)"', 1)) AS INTEGER) AS n, array_to_string(regexp_extract_all(html, '<img[^>]*? src="([^"]+)"', 1), ' ') AS every FROM h"""
)
def p11_image_src(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of the images that links are turned into."""
    h = table(spark, sf, "pages").select("page_id", F.replace("html", F.lit("<a href="), F.lit('<img alt="" src=')).alias("html"))
    every = P.all_image_src(F.col("html"))
    return h.select("page_id", P.first_image_src(F.col("html")).alias("first"), F.size(every).alias("n"), F.array_join(every, " ").alias("every"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: x <> '') AS w FROM conversations),
e AS (SELECT conv_id, turn, unnest(w) AS x, unnest(range(len(w))) AS i FROM w)
SELECT conv_id, turn, string_agg(x, ' ' ORDER BY i) AS plain, count(*) FILTER (i % 6 IN (0, 3)) AS bold, count(*) FILTER (i % 6 IN (1, 3)) AS italic, count(*) FILTER (i % 6 = 2) AS code FROM e GROUP BY conv_id, turn"""
)
def p12_inline_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with marks set by word, read again: plain text, and bold, italic and code runs."""
    w = F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != "")
    mark = lambda x, i: F.when(i % 6 == 0, F.concat(F.lit("**"), x, F.lit("**"))).when(i % 6 == 1, F.concat(F.lit("*"), x, F.lit("*"))).when(i % 6 == 2, F.concat(F.lit("`"), x, F.lit("`"))).when(i % 6 == 3, F.concat(F.lit("***"), x, F.lit("***"))).otherwise(x)
    md = table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.transform(w, mark), " ").alias("md")).where("md <> ''")
    runs = md.select("conv_id", "turn", P.inline_runs(F.col("md")).alias("r"))
    n = lambda f: F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x[f])
    return runs.select("conv_id", "turn", F.array_join(F.transform("r", lambda x: x["t"]), "").alias("plain"), n("b").alias("bold"), n("i").alias("italic"), n("c").alias("code"))


@query(
    r"""WITH c AS (SELECT conv_id, turn, text AS t, regexp_replace(text, '[\[\]]', '', 'g') AS l FROM conversations)
SELECT conv_id, turn, md5('a' || t || 'z a' || t || 'z k a' || l || 'z a' || t || 'z*_' || t || 'z') AS plain, 3 * length(t) + length(l) + 13 AS bold, length(t) + length(l) + 7 AS italic, 1 AS code FROM c"""
)
def p12_nested_runs(spark: SparkSession, sf: str) -> DataFrame:
    """All characters of all turns in nested marks: bold around italic around code and a link, and delimiters that close
    nothing. Plain text and the characters in each style."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.regexp_replace("text", r"([\\*_`!\[\]])", r"\\$1").alias("e"), F.regexp_replace(F.regexp_replace("text", r"[\[\]]", ""), r"([\\*_`!])", r"\\$1").alias("l"))
    piece = lambda c: F.concat(F.lit("a"), F.col(c), F.lit("z"))
    md = F.concat(F.lit("**"), piece("e"), F.lit(" *"), piece("e"), F.lit(" `k` ["), piece("l"), F.lit("](http://a.b/c_d)* "), piece("e"), F.lit("***_"), F.col("e"), F.lit("z"))
    runs = t.select("conv_id", "turn", P.inline_runs(md).alias("r"))
    n = lambda f: F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + F.when(x[f] == 1, F.length(x["t"])).otherwise(0))
    return runs.select("conv_id", "turn", F.md5(F.array_join(F.transform("r", lambda x: x["t"]), "")).alias("plain"), n("b").alias("bold"), n("i").alias("italic"), n("c").alias("code"))


@query("SELECT doc_id, CAST((length(text) + 2) * CASE WHEN doc_id % 3 = 0 THEN 62 ELSE 55 END + 2 * CASE WHEN doc_id % 3 = 0 THEN 38 ELSE 45 END AS DOUBLE) / 100 AS width FROM documents")
def p13_display_width(spark: SparkSession, sf: str) -> DataFrame:
    """Display width of whole texts with two wide characters, monospaced by turns."""
    return table(spark, sf, "documents").select("doc_id", (P.display_hundredths(F.concat("text", F.lit("中文")), F.col("doc_id") % 3 == 0) / 100.0).cast("double").alias("width"))
