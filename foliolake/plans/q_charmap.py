"""Queries of the character maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.operators import charmap as D
from foliolake.plans.registry import query, table

#: Parts as fonts: a single code, a range of 50 codes, an array of three.
CMAP = """cmap_v AS (
SELECT p_partkey AS font_id, 2 AS code_len, CAST(p_partkey % 500 AS BIGINT) AS code, chr(CAST(19968 + p_partkey % 1000 AS INTEGER)) AS uni, 0 AS pass FROM part
UNION ALL SELECT p_partkey, 2, 100 + i, chr(CAST(20000 + p_partkey % 300 + i AS INTEGER)), 1 FROM part, range(50) r(i)
UNION ALL SELECT p_partkey, 2, 140 + i, chr(CAST(25000 + i AS INTEGER)), 2 FROM part, range(3) r(i)),
last_v AS (SELECT font_id, code_len, code, max_by(uni, pass) AS uni FROM cmap_v GROUP BY font_id, code_len, code)"""


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Definitions of parts as fonts."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("font_id"))
    h = lambda x: F.lpad(F.hex(x), 4, "0")
    none = F.lit(None).cast("string")
    return (
        p.select("font_id", F.lit(9).alias("seq"), F.lit("char").alias("kind"), h(F.col("font_id") % 500).alias("lo"), none.alias("hi"), F.array(h(19968 + F.col("font_id") % 1000)).alias("dst"))
        .unionByName(p.select("font_id", F.lit(1).alias("seq"), F.lit("range").alias("kind"), F.lit("0064").alias("lo"), F.lit("0095").alias("hi"), F.array(h(20000 + F.col("font_id") % 300)).alias("dst")))
        .unionByName(p.select("font_id", F.lit(2).alias("seq"), F.lit("array").alias("kind"), F.lit("008C").alias("lo"), F.lit("00FF").alias("hi"), F.array(*(h(F.lit(25000 + i)) for i in range(3))).alias("dst")))
    )


@query(f"WITH {CMAP} SELECT * FROM last_v")
def d1_expand_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of every font."""
    return D.expand_ranges(ranges(spark, sf))


DIFF_GLYPHS = ["endash", "bullet", "quotedbl", "eacute", "nosuchglyph", "uni4E2D", "A"]
DIFF_TEXT = ["–", "•", '"', "é", None, "中", "A"]


def diffs(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as fonts: a code, three names, a second code beyond the first, two names."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("font_id"))
    glyph = lambda k: F.element_at(F.array(*map(F.lit, DIFF_GLYPHS)), ((F.col("font_id") + k) % 7).cast("int") + 1)
    none = F.lit(None)
    rows = [(0, (F.col("font_id") % 200).cast("int"), none), (1, none, glyph(0)), (2, none, glyph(1)), (3, none, glyph(2)), (4, F.lit(254), none), (5, none, glyph(3)), (6, none, glyph(4)), (7, none, glyph(5))]
    out = F.explode(F.array(*(F.struct(F.lit(q).alias("seq"), n.cast("int").alias("num"), g.cast("string").alias("glyph")) for q, n, g in rows)))
    return s.select("font_id", out.alias("d")).select("font_id", "d.*")


ENCODED = f"""t AS (SELECT {str(DIFF_TEXT).replace("None", "NULL").replace(chr(39) + chr(34) + chr(39), "chr(34)")} AS g),
changes AS (SELECT s_suppkey AS font_id, CASE WHEN k < 3 THEN s_suppkey % 200 + k ELSE 254 + k - 3 END AS code, g[((s_suppkey + k) % 7) + 1] AS uni, k FROM supplier, range(6) r(k), t),
known AS (SELECT font_id, code, max_by(uni, k) AS uni FROM changes WHERE uni IS NOT NULL AND code <= 255 GROUP BY font_id, code),
encoded_v AS (SELECT s.s_suppkey AS font_id, CAST(c AS BIGINT) AS code, coalesce(known.uni, chr(CAST(c AS INTEGER))) AS uni FROM supplier s CROSS JOIN range(1, 256) r(c) LEFT JOIN known ON known.font_id = s.s_suppkey AND known.code = c)"""


def latin(spark: SparkSession) -> DataFrame:
    """Latin-1 without the zero."""
    return spark.range(1, 256).select(F.col("id").alias("code"), F.decode(F.unhex(F.lpad(F.hex("id"), 2, "0")), "ISO-8859-1").alias("uni"))


@query(f"WITH {ENCODED} SELECT * FROM encoded_v")
def d2_overlay_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Encodings of suppliers as fonts over Latin-1."""
    return D.overlay_differences(latin(spark), diffs(spark, sf))


@query(
    f"""WITH {ENCODED}, w AS (SELECT c_custkey AS id, s_suppkey AS font_id, c_name AS name FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier)),
c AS (SELECT id, font_id, unnest(string_split(name, '')) AS x, unnest(range(length(name))) AS i FROM w)
SELECT id, string_agg(uni, '' ORDER BY i) AS text FROM c JOIN encoded_v e ON e.font_id = c.font_id AND e.code = ascii(x) GROUP BY id"""
)
def d3_decode_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Names of customers as byte strings in suppliers' encodings."""
    n = table(spark, sf, "supplier").count()
    encoding = D.overlay_differences(latin(spark), diffs(spark, sf))
    strings = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % n).alias("font_id"), F.encode("c_name", "UTF-8").alias("raw"))
    fonts = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("font_id"), F.lit(False).alias("composite"))
    none = spark.createDataFrame([], "font_id long, code_len int, code long, uni string")
    return D.decode_codes(strings, fonts, none, encoding)


#: Suppliers as fonts of four kinds: composite with a map of two-byte keys, composite with one-byte keys alone, composite
#: with both, and a simple font with both.
@query(
    """WITH w AS (SELECT c_custkey AS id, s_suppkey % 4 AS kind, c_name AS name FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier)),
c AS (SELECT id, kind, unnest(string_split(name, '')) AS x, unnest(range(length(name))) AS i FROM w), a AS (SELECT *, ascii(x) AS a, x BETWEEN '0' AND '9' AS digit FROM c),
m AS (SELECT id, kind, i, CASE kind WHEN 0 THEN CASE WHEN a % 2 = 0 THEN '<' || x || '>' WHEN digit THEN 'd' ELSE '' END WHEN 1 THEN CASE WHEN a % 2 = 0 THEN '[' || x || ']' WHEN digit THEN 'd' ELSE x END
WHEN 2 THEN CASE WHEN a % 3 = 0 THEN 'T' || x WHEN a % 3 = 1 THEN 'O' || x WHEN digit THEN 'd' ELSE x END ELSE CASE WHEN a % 2 = 0 THEN 'o' ELSE 't' END END AS t FROM a)
SELECT id, string_agg(t, '' ORDER BY i) || CASE WHEN any_value(kind) = 0 THEN 'EX' ELSE '' END AS text FROM m GROUP BY id"""
)
def d3_composite_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Names of customers as byte strings in composite and simple fonts, with two-byte codes, an odd last byte, codes that
    only the other map or the encoding knows, and codes that nothing knows."""
    n = table(spark, sf, "supplier").count()
    fonts = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("font_id"), (F.col("s_suppkey") % 4).cast("int").alias("kind"))
    keys = fonts.select("font_id", "kind", F.explode(F.sequence(F.lit(32), F.lit(126))).alias("a")).withColumn("x", F.char(F.col("a")))
    even, third = F.col("a") % 2 == 0, F.col("a") % 3
    entry = lambda width, code, uni: F.struct(F.lit(width).alias("code_len"), code.cast("long").alias("code"), uni.alias("uni"))
    maps = (
        F.when((F.col("kind") == 0) & even, entry(2, 256 + F.col("a"), F.concat(F.lit("<"), "x", F.lit(">")))).when((F.col("kind") == 0) & (F.col("a") == 33), entry(2, F.col("a"), F.lit("EX")))
        .when((F.col("kind") == 1) & even, entry(1, F.col("a"), F.concat(F.lit("["), "x", F.lit("]"))))
        .when((F.col("kind") == 2) & (third == 0), entry(2, F.col("a"), F.concat(F.lit("T"), "x"))).when((F.col("kind") == 2) & (third == 1), entry(1, F.col("a"), F.concat(F.lit("O"), "x")))
        .when((F.col("kind") == 3) & even, entry(1, F.col("a"), F.lit("o"))).when(F.col("kind") == 3, entry(2, F.col("a"), F.lit("t")))
    )
    cmap = keys.select("font_id", maps.alias("m")).where("m IS NOT NULL").select("font_id", "m.*")
    encoding = keys.where("x BETWEEN '0' AND '9'").select("font_id", F.col("a").cast("long").alias("code"), F.lit("d").alias("uni"))
    font_id = (F.col("c_custkey") % n).alias("font_id")
    pairs = lambda high: F.unhex(F.regexp_replace(F.hex(F.encode("c_name", "UTF-8")), "(..)", f"{high}$1"))
    kind = F.col("c_custkey") % n % 4
    raw = F.when(kind == 0, F.concat(pairs("01"), F.lit(bytearray(b"!")))).when(kind == 2, pairs("00")).otherwise(F.encode("c_name", "UTF-8"))
    strings = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), font_id, raw.alias("raw"))
    return D.decode_codes(strings, fonts.select("font_id", (F.col("kind") < 3).alias("composite")), cmap, encoding)


CJK = "中文发票测试"
CHARSETS = {"gbk": CJK, "big5": "中文", "shift_jis": "日本", "euc-jp": "日本", "euc-kr": "한국", "unicode": CJK}


@query(
    rf"""WITH c AS (SELECT *, CASE WHEN regexp_matches(text, '[^\x20-\x5B\x5D-\x7D\n]') THEN 'unicode' ELSE ({list(CHARSETS)})[(doc_id % {len(CHARSETS)}) + 1] END AS charset FROM documents)
SELECT doc_id, charset, md5((MAP {{{', '.join(f"'{k}': '{v}'" for k, v in CHARSETS.items())}}})[charset] || text) AS digest FROM c"""
)
def d4_decode_legacy_cjk(spark: SparkSession, sf: str) -> DataFrame:
    """Documents led by some East Asian characters in six charsets by turns; those with other letters in UTF-16."""
    names = list(CHARSETS)
    turn = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names)).cast("int") + 1)
    charset = F.when(F.col("text").rlike(r"[^\x20-\x5B\x5D-\x7D\n]"), "unicode").otherwise(turn)
    head = F.create_map(*(x for k, v in CHARSETS.items() for x in (F.lit(k), F.lit(bytearray(v.encode(D.CODECS[k]))))))
    raw = F.concat(head[F.col("charset")], F.when(F.col("charset") == "unicode", F.encode("text", "UTF-16BE")).otherwise(F.encode("text", "UTF-8")))
    rows = table(spark, sf, "documents").select("doc_id", "text", charset.alias("charset")).select("doc_id", "charset", raw.alias("raw"))
    return D.decode_legacy_cjk(rows, "raw", "charset", "text").select("doc_id", "charset", F.md5("text").alias("digest"))
