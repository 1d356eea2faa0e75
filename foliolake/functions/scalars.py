"""Column functions: text decoding, names, geometry, titles, inline marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extents in hundredths of an em. Blank and no-break blank, wide characters, all others.
ADVANCE = {"blank": 25, "blank_mono": 55, "wide": 95, "other": 45, "other_mono": 55}
BLANK = "[ \u00a0]"
WIDE = "[\u2e80-\u9fff\uff00-\uff60]"
MONO_FONTS = r"(?i)mono|courier|consol|menlo|inconsolata|source\s*code|jetbrains|fira\s*code"
#: Ends of sentences after which a text is split.
SENTENCE_END = "[。！？!?]"
TAG = "<[^>]+>"
IMAGE = r"""(?i)<img[^>]+src="([^"]+)\""""
ANY_IMAGE = r"""(?i)<(?:img[^>]*?\ssrc|image[^>]*?\shref)="([^"]+)\""""


def utf16_text(hex_digits: Column, little: bool = False) -> Column:
    """Text of UTF-16 in hex digits. What is left of an odd number of bytes is dropped, and a surrogate without its other
    half becomes U+FFFD."""
    units = F.regexp_extract_all(hex_digits, F.lit("[0-9A-Fa-f]{4}"), F.lit(0))
    units = F.transform(units, lambda u: F.concat(F.substring(u, 3, 2), F.substring(u, 1, 2))) if little else units
    high, low = (lambda u: F.coalesce(u.rlike("^[dD][89abAB]"), F.lit(False))), (lambda u: F.coalesce(u.rlike("^[dD][c-fC-F]"), F.lit(False)))
    # The one-element array binds the units to a name.
    mend = lambda us: F.transform(us, lambda u, i: F.when(high(u) & ~low(F.get(us, i + 1)) | low(u) & ~high(F.get(us, i - 1)), F.lit("FFFD")).otherwise(u))
    mended = F.array_join(F.transform(F.array(units), mend)[0], "")
    whole = mended if little else F.when(hex_digits.rlike("[dD][89a-fA-F]"), mended).otherwise(F.left(hex_digits, (F.length(hex_digits) - F.length(hex_digits) % 4).cast("int")))
    return F.decode(F.unhex(whole), "UTF-16BE")


def decode_text(raw: Column) -> Column:
    """Bytes to text: by a byte-order mark, else as UTF-8 if that is valid and has a character of several bytes, else as
    Latin-1. Null stays null, and no bytes are an empty text. Malformed bytes after a mark become U+FFFD, an odd last byte
    of UTF-16 is dropped."""
    head = F.hex(F.substring(raw, 1, 3))
    rest = lambda n: F.substring(raw, n + 1, 2147483647)
    plain = raw.cast("string")
    multi = F.is_valid_utf8(plain) & (F.length(plain) < F.octet_length(raw))
    return (
        F.when(head.startswith("FEFF"), utf16_text(F.hex(rest(2))))
        .when(head.startswith("FFFE"), utf16_text(F.hex(rest(2)), little=True))
        .when(head == "EFBBBF", F.regexp_replace(F.make_valid_utf8(rest(3).cast("string")), "^\ufeff", ""))
        .when(multi, plain)
        .otherwise(F.decode(raw, "ISO-8859-1"))
    )


def legacy_charset(name: Column) -> Column:
    """Charset named by a legacy character map, null if none; the first rule that holds counts."""
    low = F.lower(name)
    has = lambda *parts: F.greatest(*(F.contains(low, F.lit(p)) for p in parts), F.lit(False))
    return (
        F.when(has("ucs2", "utf16"), "unicode")
        .when(has("gbk", "gb-euc", "gbpc-euc") | low.isin("euc-h", "euc-v"), "gbk")
        .when(has("b5", "cns-euc", "eten"), "big5")
        .when(has("rksj", "90ms", "90pv"), "shift_jis")
        .when(has("euc-jp"), "euc-jp")
        .when(has("ksc", "korean"), "euc-kr")
    )


def code_point(hex_digits: Column) -> Column:
    """The character of a code point in hex; U+FFFD for half of a pair, empty outside Unicode."""
    value = F.conv(hex_digits, 16, 10).cast("long")
    return F.when(value.between(0xD800, 0xDFFF), "\ufffd").when(value <= 0x10FFFF, F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")).otherwise("")


def glyph_by_rule(name: Column) -> Column:
    """Text of a glyph name that is in no dictionary: ``uni`` and four hex digits, or ``u`` and four to six; else empty."""
    uni, u = F.regexp_extract(name, "^uni([0-9A-Fa-f]{4})", 1), F.regexp_extract(name, "^u([0-9A-Fa-f]{4,6})$", 1)
    return F.when(uni != "", code_point(uni)).when(u != "", code_point(u)).otherwise("")


def is_mono_font(name: Column) -> Column:
    """Whether a font's name is that of a monospaced one."""
    return name.rlike(MONO_FONTS)


def advance_hundredths(text: Column, mono: Column) -> Column:
    """Approximate advance of a text in hundredths of an em, an integer, so that sums don't depend on order."""
    # Texts of one-byte characters, most of all texts, have nothing wide, and need no pattern; without a blank, as words are,
    # nothing is looked for in them.
    ascii_only, each = F.octet_length(text) == F.length(text), F.when(mono, ADVANCE["other_mono"]).otherwise(ADVANCE["other"])
    blank = F.length(text) - F.length(F.translate(text, BLANK.strip("[]"), ""))
    wide = F.when(ascii_only, 0).otherwise(F.regexp_count(text, F.lit(WIDE)))
    other = F.length(text) - blank - wide
    some = blank * F.when(mono, ADVANCE["blank_mono"]).otherwise(ADVANCE["blank"]) + wide * ADVANCE["wide"] + other * each
    return F.when(ascii_only & ~F.contains(text, F.lit(" ")), F.length(text) * each).otherwise(some)


def approx_advance(text: Column, fs: Column, mono: Column) -> Column:
    """Approximate advance of a text at a font size."""
    return advance_hundredths(text, mono) * fs / 100


def compose(m: Column, n: Column) -> Column:
    """The affine product of two matrices of six numbers: first ``m``, then ``n``."""
    a, b, c, d, e, f = (m[i] for i in range(6))
    g, h, i, j, k, l = (n[x] for x in range(6))  # noqa: E741
    return F.array(a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l)


def text_position(tm: Column, ctm: Column) -> Column:
    """Where a text matrix puts its origin on the page: struct<x, y>."""
    return F.struct((tm[4] * ctm[0] + tm[5] * ctm[2] + ctm[4]).alias("x"), (tm[4] * ctm[1] + tm[5] * ctm[3] + ctm[5]).alias("y"))


def normalize_title(title: Column, fallback: Column, most: int = 40) -> Column:
    """A title with white space collapsed, cut to so many characters; the fallback if nothing is left."""
    return F.coalesce(F.nullif(F.left(F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit(most)), F.lit("")), fallback)


def doc_title(meta_title: Column, file_name: Column) -> Column:
    """The title in the metadata, else the file's name without its last extension."""
    return normalize_title(meta_title, F.regexp_replace(file_name, r"\.[^.]+$", ""))


def components(color_space: Column) -> Column:
    """Numbers per pixel of a colour space; 0 if unknown."""
    return F.when(color_space == "DeviceRGB", 3).when(color_space == "DeviceGray", 1).when(color_space == "DeviceCMYK", 4).otherwise(0)


def image_kind(width: Column, height: Column, filters: Column, color_space: Column, bpc: Column, bytes_len: Column, palette_ok: Column) -> Column:
    """struct<kind, note>: what can be done with an image object, from its description alone."""
    last = F.when(F.size(filters) > 0, F.element_at(filters, -1))
    early = F.forall(F.slice(filters, 1, F.greatest(F.size(filters) - 1, F.lit(0))), lambda f: f.isin("ASCIIHexDecode", "AHx", "ASCII85Decode", "A85", "RunLengthDecode", "RL", "FlateDecode", "Fl"))
    comps = F.when(palette_ok, 1).otherwise(components(color_space))
    made = lambda kind, note="": F.struct(F.lit(kind).alias("kind"), F.lit(note).alias("note"))
    raw = (
        F.when(color_space.isNull(), made("unsupported", "colour space"))
        .when(~F.equal_null(bpc, F.lit(8)), made("unsupported", "bits per component"))
        .when(comps == 0, made("unsupported", "colour space"))
        .when(bytes_len < width * height * comps, made("unsupported", "incomplete pixels"))
        .otherwise(made("raw"))
    )
    return (
        F.when((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0), made("none"))
        .when(last.isin("DCTDecode", "DCT"), F.when(early, made("jpeg")).otherwise(made("unsupported", "filter before jpeg")))
        .when(last.isNull() | last.isin("FlateDecode", "Fl"), raw)
        .otherwise(F.struct(F.lit("unsupported").alias("kind"), F.concat(F.lit("filter "), last).alias("note")))
    )


def strip_tags(html: Column) -> Column:
    """Markup to blanks, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, TAG, " "), r"\s+", " "))


def sentences(text: Column) -> Column:
    """The text split after sentence ends, pieces trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, rf"(?<={SENTENCE_END})\s*"), lambda s: F.trim(s)), lambda s: s != "")


def first_image_src(html: Column) -> Column:
    """Source of the first image, empty if there is none."""
    return F.regexp_extract(html, IMAGE, 1)


def all_image_src(html: Column) -> Column:
    """Sources of all images, in order."""
    return F.regexp_extract_all(html, F.lit(ANY_IMAGE), F.lit(1))


def running_sums(values: Column) -> Column:
    """Sums of an array's values up to each place, itself included, by doubling the stretch that is added up: a number of
    passes that is the logarithm of the length, without a shuffle."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    steps = F.when(rounds > 0, F.transform(F.sequence(F.lit(0), F.greatest(rounds - 1, F.lit(0))), lambda k: F.pow(F.lit(2.0), k).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, values.cast("array<long>"), lambda s, k: F.transform(s, lambda v, i: v + F.coalesce(F.get(s, i - k), F.lit(0).cast("long"))))


#: Inline marks, tried in this order at each place: escapes, images, both ends of a link, code, delimiters, text.
INLINE = r"\\.|!\[[^\]]*\]\([^)]*\)|\[(?=[^\[\]]*\]\([^)]*\))|\]\([^)]*\)|`[^`]+`|\*{1,3}|_|[^\\*_`!\[\]]+|(?s:.)"
_PAIR = "struct<lo:int,hi:int,b:int,i:int,n:int>"


def _inline_pairs(tokens: Column) -> Column:
    """Which delimiters and ends of links belong together: lo, hi, b, i and how many characters of both they take. A fold with
    a stack of open delimiters: one that closes takes the nearest open one that has its mark, and what opened since then is
    text. Three asterisks are both marks, and may be closed or opened one after the other. tokens: array of kind, n,
    opens, closes."""
    opener = "struct<at:int,n:int,u:boolean>"
    start = F.struct(F.array().cast(f"array<{opener}>").alias("stack"), F.array().cast(f"array<{_PAIR}>").alias("pairs"), F.lit(-1).alias("link"), F.lit(0).alias("at"))

    def pair(lo: Column, hi: Column, n: Column) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), (n >= 2).cast("int").alias("b"), (n % 2).cast("int").alias("i"), n.alias("n"))

    def step(s: Column, m: Column) -> Column:
        stack, at, n, under = s["stack"], s["at"], m["n"], m["kind"] == "under"
        mark = m["kind"].isin("star", "under")
        size, top, second = F.size(stack), F.element_at(stack, -1), F.get(stack, F.size(stack) - 2)
        nearest = lambda fits: F.array_max(F.transform(stack, lambda o, k: F.when((o["u"] == under) & (at - o["at"] > 1) & fits(o), k)))
        hit = F.coalesce(nearest(lambda o: (o["n"] == n) | (o["n"] == 3)), nearest(lambda o: n == 3))
        both = F.coalesce((n == 3) & (size > 1) & (at - top["at"] > 1) & ~top["u"] & ~second["u"] & (top["n"] + second["n"] == 3), F.lit(False)) & ~under
        one = F.get(stack, hit)
        closes = mark & m["closes"] & (both | hit.isNotNull())
        rest = F.when(one["n"] <= n, F.array().cast(f"array<{opener}>")).otherwise(F.array(F.struct(one["at"].alias("at"), (3 - n).alias("n"), one["u"].alias("u"))))
        left = F.when(both, F.slice(stack, 1, F.greatest(size - 2, F.lit(0)))).otherwise(F.concat(F.slice(stack, 1, F.coalesce(hit, F.lit(0))), rest))
        link = (m["kind"] == "end") & (s["link"] >= 0)
        new = (
            F.when(closes & both, F.array(pair(second["at"], at, second["n"]), pair(top["at"], at, top["n"]))).when(closes, F.array(pair(one["at"], at, F.least(n, one["n"]))))
            .when(link, F.array(F.struct(s["link"].alias("lo"), at.alias("hi"), F.lit(0).alias("b"), F.lit(0).alias("i"), F.lit(1).alias("n")))).otherwise(F.array().cast(f"array<{_PAIR}>"))
        )
        pushed = F.array_append(stack, F.struct(at.alias("at"), n.alias("n"), under.alias("u")))
        return F.struct(
            F.when(closes, left).when(mark & m["opens"], pushed).otherwise(stack).alias("stack"), F.concat(s["pairs"], new.cast(f"array<{_PAIR}>")).alias("pairs"),
            F.when(m["kind"] == "begin", at).when(link | (m["kind"] == "stop"), -1).otherwise(s["link"]).alias("link"), (at + 1).alias("at"),
        )

    return F.aggregate(tokens, start, step, lambda s: s["pairs"])


def inline_runs(md: Column) -> Column:
    """array<struct<t, b, i, c>>: styled pieces of a line of Markdown. Marks nest: bold may hold italic, code or a link, and
    what isn't closed is text. A delimiter opens before what isn't white space and closes behind it; underscores don't within
    a word. Links keep their text, images their caption. Null gives null."""
    parts = F.regexp_extract_all(md, F.lit(INLINE), F.lit(0))
    around = lambda a, k: F.coalesce(F.get(a, k), F.lit(" "))

    def token(a: Column, x: Column, k: Column) -> Column:
        before, after = F.substring(around(a, k - 1), -1, 1), F.substring(around(a, k + 1), 1, 1)
        kind = (
            F.when(x.rlike(r"^\\."), "escape").when(x.rlike(r"^!\[.*\]\("), "image").when(x.rlike(r"^\](?=\()"), "end").when(x == "[", "begin").when(x == "]", "stop")
            .when(x.rlike("^`[^`]+`$"), "code").when(x.rlike(r"^\*+$"), "star").when(x == "_", "under").otherwise("text")
        )
        word = r"^[A-Za-z0-9_]$"
        free = lambda c: (x != "_") | ~c.rlike(word)
        return F.struct(kind.alias("kind"), F.length(x).alias("n"), (~after.rlike(r"^\s$") & free(before)).alias("opens"), (~before.rlike(r"^\s$") & free(after)).alias("closes"), x.alias("x"))

    def styled(a: Column) -> Column:
        return F.transform(F.array(_inline_pairs(a)), lambda pairs: finished(a, pairs))[0]

    def finished(a: Column, pairs: Column) -> Column:
        event = lambda at, order, b, i, n: F.struct(at.alias("at"), F.lit(order).alias("order"), b.alias("b"), i.alias("i"), n.alias("n"))
        zero = F.lit(0)
        opened, closed = F.transform(pairs, lambda p: event(p["lo"], 0, p["b"], p["i"], p["n"])), F.transform(pairs, lambda p: event(p["hi"], 1, -p["b"], -p["i"], p["n"]))
        events = F.sort_array(F.concat(opened, closed, F.transform(a, lambda _, k: event(k, 2, zero, zero, zero))))

        def sums(e: Column) -> Column:
            one = lambda f: running_sums(F.transform(e, lambda v: v[f]))
            return F.filter(F.arrays_zip(e.alias("e"), one("b").alias("b"), one("i").alias("i"), one("n").alias("n")), lambda z: z["e"]["order"] == 2)

        return F.transform(F.array(F.transform(F.array(events), sums)[0]), lambda z: F.transform(a, lambda m, k: run(m, F.get(z, k), F.get(z, k - 1))))[0]

    def run(m: Column, now: Column, last: Column) -> Column:
        used = now["n"] - F.coalesce(last["n"], F.lit(0).cast("long"))
        x, kind = m["x"], m["kind"]
        text = (
            F.when(kind == "escape", F.substring(x, 2, 1)).when(kind == "image", F.concat(F.lit("［图："), F.regexp_extract(x, r"^!\[([^\]]*)\]", 1), F.lit("］"))).when(kind == "code", F.substring(x, F.lit(2), m["n"] - 2))
            .when(kind.isin("star", "under"), F.repeat(F.substring(x, 1, 1), (m["n"] - used).cast("int"))).when(kind.isin("begin", "end") & (used > 0), "").otherwise(x)
        )
        # What is left of a delimiter stands outside of what it opens or closes.
        style = lambda f: F.when(kind.isin("star", "under"), F.least(now[f], F.coalesce(last[f], F.lit(0).cast("long")))).otherwise(now[f]).cast("int").alias(f)
        return F.struct(text.alias("t"), style("b"), style("i"), (kind == "code").cast("int").alias("c"))

    tokens = F.transform(F.array(parts), lambda a: F.transform(a, lambda x, k: token(a, x, k)))[0]
    return F.filter(F.transform(F.array(tokens), styled)[0], lambda r: r["t"] != "")


def display_hundredths(text: Column, code: Column) -> Column:
    """Width of a text in hundredths: wide characters 100, others 55, monospaced 62."""
    wide = F.regexp_count(text, F.lit("[\u2e80-\u9fff\uff00-\uff60\u3000-\u303f]"))
    return F.when(code, 62 * (F.length(text) - wide) + 100 * wide).otherwise(55 * (F.length(text) - wide) + 100 * wide)
