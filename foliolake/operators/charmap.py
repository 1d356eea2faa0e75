"""Character maps as joins: ranges to codes, encodings with differences, codes to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolake.functions.scalars import glyph_by_rule, utf16_text
from foliolake.sources.shared import deal

#: Codes that one range may have.
MOST_CODES = 65_536
#: Codes in a partition of fonts.
DEALT_CODES = 2**19
#: Glyph names that no rule gives, and their texts. Single Latin letters stand for themselves.
GLYPHS = {
    "Agrave": "À", "Aacute": "Á", "Acircumflex": "Â", "Atilde": "Ã", "Adieresis": "Ä", "Aring": "Å", "Ccedilla": "Ç", "Egrave": "È", "Eacute": "É", "Ecircumflex": "Ê",
    "Edieresis": "Ë", "Igrave": "Ì", "Iacute": "Í", "Icircumflex": "Î", "Idieresis": "Ï", "Ntilde": "Ñ", "Ograve": "Ò", "Oacute": "Ó", "Ocircumflex": "Ô", "Otilde": "Õ",
    "Odieresis": "Ö", "Ugrave": "Ù", "Uacute": "Ú", "Ucircumflex": "Û", "Udieresis": "Ü", "Yacute": "Ý", "agrave": "à", "aacute": "á", "acircumflex": "â", "atilde": "ã",
    "adieresis": "ä", "aring": "å", "ccedilla": "ç", "egrave": "è", "eacute": "é", "ecircumflex": "ê", "edieresis": "ë", "igrave": "ì", "iacute": "í", "icircumflex": "î",
    "idieresis": "ï", "ntilde": "ñ", "ograve": "ò", "oacute": "ó", "ocircumflex": "ô", "otilde": "õ", "odieresis": "ö", "ugrave": "ù", "uacute": "ú", "ucircumflex": "û",
    "udieresis": "ü", "yacute": "ý", "ydieresis": "ÿ", "Scaron": "Š", "scaron": "š", "Ydieresis": "Ÿ", "Zcaron": "Ž", "zcaron": "ž", "space": " ", "exclam": "!",
    "quotedbl": "\"", "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*",
    "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[",
    "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª",
    "guillemotleft": "«", "logicalnot": "¬", "sfthyphen": "\u00ad", "registered": "®", "macron": "¯", "degree": "°", "plusminus": "±", "twosuperior": "²",
    "threesuperior": "³", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "onesuperior": "¹", "ordmasculine": "º",
    "guillemotright": "»", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "multiply": "×", "divide": "÷", "germandbls": "ß", "Eth": "Ð",
    "eth": "ð", "Thorn": "Þ", "thorn": "þ", "AE": "Æ", "ae": "æ", "Oslash": "Ø", "oslash": "ø", "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "OE": "Œ", "oe": "œ",
    "florin": "ƒ", "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝", "quotesinglbase": "‚",
    "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹", "guilsinglright": "›",
    "fraction": "⁄", "Euro": "€", "trademark": "™", "minus": "−", "fi": "ﬁ", "fl": "ﬂ", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "endash": "–", "emdash": "—", "quoteleft": "‘",
    "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "nbspace": "\u00a0", "nonbreakingspace": "\u00a0",
}


def glyphs() -> dict[str, str]:
    """Glyph names and their texts."""
    return {chr(c): chr(c) for k in (65, 97) for c in range(k, k + 26)} | GLYPHS


def glyph_table(spark: SparkSession, names: dict[str, str] | None = None) -> DataFrame:
    """The glyph dictionary as a table: glyph, uni."""
    return spark.createDataFrame(list((names or glyphs()).items()), "glyph string, uni string")


def glyph_to_unicode(df: DataFrame, name_col: str, out_col: str, names: dict[str, str] | None = None) -> DataFrame:
    """Adds a glyph name's text: from the dictionary, a few hundred rows that are broadcast, else by rule."""
    known = F.broadcast(glyph_table(df.sparkSession, names).select(F.col("glyph").alias("_glyph"), F.col("uni").alias("_uni")))
    return df.join(known, F.col(name_col) == F.col("_glyph"), "left").withColumn(out_col, F.coalesce("_uni", glyph_by_rule(F.col(name_col)), F.lit(""))).drop("_glyph", "_uni")


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _even(hex_digits: Column) -> Column:
    """Targets are UTF-16 in hex; of an odd number of bytes all but the last, of one byte that byte."""
    n = F.length(hex_digits)
    return F.when(n <= 2, F.lpad(hex_digits, 4, "0")).otherwise(F.left(hex_digits, (n - n % 4).cast("int")))


def utf16(hex_digits: Column) -> Column:
    """Text of a target in hex."""
    return utf16_text(_even(hex_digits))


def _plus(hex_digits: Column, k: Column) -> Column:
    """A target some codes further, counted in its last two bytes, with a carry."""
    n = F.length(hex_digits)
    tail = F.greatest(n - 8, F.lit(0)).cast("int")
    head, last = F.left(hex_digits, tail), F.substring(hex_digits, tail + 1, n)
    return F.concat(head, F.lpad(F.hex(_number(last) + k), F.length(last), "0"))


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """From font_id, seq, kind (char, range, array), lo, hi, dst (array of hex) to font_id, code_len, code, uni.

    Singles come before all ranges, and later definitions replace earlier ones. An array counts from ``lo`` and ignores
    ``hi``; a range has at most ``MOST_CODES`` codes. Keys of up to two hex digits are one byte.
    """
    base = ranges.select("font_id", "kind", "dst", (F.when(F.col("kind") == "char", 0).otherwise(1)).alias("pass"), "seq", F.when(F.length("lo") <= 2, 1).otherwise(2).alias("code_len"), _number(F.col("lo")).alias("lo"), _number(F.col("hi")).alias("hi"))
    kind, last = F.col("kind"), F.least(F.col("hi"), F.col("lo") + MOST_CODES - 1)
    n = F.when((kind == "range") & (F.col("hi") >= F.col("lo")), last - F.col("lo") + 1).when((kind == "array") & (F.size("dst") > 0), F.size("dst").cast("long")).when(kind == "char", F.lit(1).cast("long"))
    # Fonts are dealt by their codes before these are made, so that their codes are sorted in memory and don't move.
    dealt = deal(base.withColumn("n", n).where("n > 0"), ["font_id"], F.col("n"), DEALT_CODES)
    codes = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    to = F.when(kind == "range", _plus(F.element_at("dst", 1), F.col("k"))).when(kind == "array", F.get("dst", F.col("k"))).otherwise(F.element_at("dst", 1))
    every = codes.select("font_id", "code_len", (F.col("lo") + F.col("k")).alias("code"), "pass", "seq", to.alias("to"))
    return every.groupBy("font_id", "code_len", "code").agg(F.max_by("to", F.struct("pass", "seq")).alias("to")).select("font_id", "code_len", "code", utf16(F.col("to")).alias("uni"))


def overlay_differences(base: DataFrame, diffs: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """An encoding with differences: base (code, uni) and diffs (font_id, seq, num, glyph) to font_id, code, uni.

    A number sets the code, and each name takes the code and moves on; codes outside 0 to 255 and unknown names change
    nothing. Of several names of a code the last known one counts.
    """
    order = Window.partitionBy("font_id").orderBy("seq")
    run = diffs.withColumn("run", F.sum(F.when(F.col("num").isNotNull(), 1).otherwise(0)).over(order))
    within = Window.partitionBy("font_id", "run").orderBy("seq")
    placed = run.withColumn("start", F.coalesce(F.first("num", True).over(within), F.lit(0))).withColumn("k", F.count("glyph").over(within)).where("glyph IS NOT NULL")
    placed = placed.select("font_id", "seq", (F.col("start") + F.col("k") - 1).alias("code"), "glyph").where("code BETWEEN 0 AND 255")
    known = glyph_to_unicode(placed, "glyph", "uni", names).where("uni <> ''").groupBy("font_id", "code").agg(F.max_by("uni", "seq").alias("new"))
    codes = diffs.select("font_id").distinct().select("font_id", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("code"))
    # One row a code, so 256 at most, whatever the base holds.
    full = codes.join(F.broadcast(base.where("code BETWEEN 0 AND 255").groupBy(F.col("code").cast("int").alias("code")).agg(F.max("uni").alias("uni"))), "code")
    return full.join(known.hint("merge"), ["font_id", "code"], "left").select("font_id", F.col("code").cast("long").alias("code"), F.coalesce("new", "uni").alias("uni"))


def decode_codes(strings: DataFrame, fonts: DataFrame, cmap: DataFrame, encoding: DataFrame) -> DataFrame:
    """Text of byte strings: strings (id, font_id, raw binary), fonts (font_id, composite), cmap (font_id, code_len, code,
    uni), encoding (font_id, code, uni) to id, text.

    Composite fonts have two-byte codes unless their map has one-byte keys alone; an odd last byte is single. A code is
    looked up in the map of its length, then by its low byte in the one-byte map, single codes also in the two-byte map,
    then the low byte in the encoding; two-byte codes with a high byte that nothing knows are dropped, and else the low
    byte is Latin-1.
    """
    widths = cmap.groupBy("font_id").agg(F.min("code_len").alias("least"), F.max("code_len").alias("most"))
    kind = fonts.join(widths.hint("merge"), "font_id", "left").select("font_id", F.when(F.col("composite") & ~F.equal_null("most", F.lit(1)), 2).otherwise(1).alias("width"))
    hexed = strings.join(kind.hint("merge"), "font_id").select("id", "font_id", F.hex("raw").alias("h"), "width")
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.length("h") / (2 * F.col("width"))).cast("int") - 1), lambda k: F.substring("h", k * 2 * F.col("width") + 1, 2 * F.col("width")))
    codes = hexed.where("h <> ''").select("id", "font_id", F.posexplode(pieces).alias("pos", "piece"))
    codes = codes.select("id", "font_id", "pos", (F.length("piece") / 2).cast("int").alias("len"), _number(F.col("piece")).alias("code")).withColumn("low", F.col("code") % 256)
    one, two = cmap.where("code_len = 1"), cmap.where("code_len = 2")

    def look(df: DataFrame, dim: DataFrame, on: Column, name: str) -> DataFrame:
        d = dim.select(F.col("font_id").alias("_f"), F.col("code").alias("_c"), F.col("uni").alias(name))
        return df.join(d.hint("merge"), (F.col("font_id") == F.col("_f")) & on, "left").drop("_f", "_c")

    codes = look(codes, two, F.col("code") == F.col("_c"), "by_two")
    codes = look(codes, one, F.col("low") == F.col("_c"), "by_one")
    codes = look(codes, encoding, F.col("low") == F.col("_c"), "by_encoding")
    mapped = F.when(F.col("len") == 2, F.coalesce("by_two", "by_one")).otherwise(F.coalesce("by_one", "by_two"))
    latin = F.decode(F.unhex(F.lpad(F.hex("low"), 2, "0")), "ISO-8859-1")
    char = F.coalesce(mapped, F.col("by_encoding"), F.when((F.col("len") == 2) & (F.col("code") > 255), "").otherwise(latin))
    text = codes.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", char.alias("c")))), lambda x: x["c"]), "").alias("text"))
    return strings.select("id").join(text.hint("merge"), "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


#: Python's names of the charsets.
CODECS = {"gbk": "gbk", "big5": "big5", "shift_jis": "shift_jis", "euc-jp": "euc_jp", "euc-kr": "euc_kr", "unicode": "utf_16_be"}


def decode_legacy_cjk(df: DataFrame, raw_col: str, charset_col: str, out_col: str) -> DataFrame:
    """Adds the text of bytes in an East Asian charset; bytes that don't fit are replaced, an unknown charset gives null.

    The JVM's decode() refuses these charsets by default, so they go through an Arrow function."""
    import pandas as pd

    def run(raw, charset):  # noqa: ANN001, ANN202
        return pd.Series([bytes(r).decode(CODECS[c], "replace") if r is not None and c in CODECS else None for r, c in zip(raw, charset, strict=True)], dtype=object)

    return df.withColumn(out_col, F.pandas_udf(run, "string")(raw_col, charset_col))
