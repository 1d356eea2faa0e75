"""Operator 10: personal data, in DataFrame functions only.

Patterns propose spans, checksums confirm them (Luhn for cards, mod 97 for account numbers), and words nearby raise the
score of the weaker kinds. Every pattern is written so that a scan is linear: it starts only where a run starts, and
runs are possessive, so that texts of one endless run of letters or digits cost no more than others.

The four base kinds follow their contract: leftmost non-overlapping matches, those that fail dropped. A match of the
contract's patterns always begins where a run begins (or where the last match ended), which is what the look-behinds
say; runs of digits that are too short or too long for a card are no card, and skipping them changes no other match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. prior: score of a pattern match; checked: added where the checksum holds (a match whose
    checksum fails is dropped); near: words in the 40 characters before or after that add ``context``; hint: what a text
    must contain to have any match, a cheap test before the pattern."""

    name: str
    pattern: str
    hint: str = ""
    prior: float = 1.0
    checked: float = 0.0
    near: str = ""
    context: float = 0.0


#: Characters of an account number by country, from the public registry (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ XK LT LU MN", 21: "HR LV LI CH", 22: "BH BG CR GE DE IE ME RS GB VA",
    23: "GI IQ IL OM SO TL AE", 24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MR MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban(n: int, countries: str) -> str:
    whole, rest = divmod(n - 4, 4)
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{whole}}}" + (rf"\x20?[A-Z0-9]{{{rest}}}" if rest else "")


#: A number as long as its country's, whatever follows it.
EXACT_IBAN = "(?:" + "|".join(_iban(n, c) for n, c in IBAN_LENGTHS.items()) + ")"

#: In the order in which spans are listed; the first four are the base.
KINDS = [
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    # Other lengths and countries: the longest run of groups that ends with a word; see ``shortened``.
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{EXACT_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])", "", 0.4, 0.5, "iban|account|konto|compte|cuenta", 0.1),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.5, 0.0, "ssn|social|security|passport|identity|ausweis", 0.4),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9a-f]{32,64}+(?![A-Za-z0-9])", "", 0.5, 0.0, "token|secret|password|api.?key|passwort|clave", 0.4),
    # Identifiers of cloud access keys, by their public form, and values with a digit that a text gives to a secret's name.
    Kind("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", "IA"),
    Kind("credential", r"""(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\x20?[=:]\x20?["']?(?=[A-Za-z+/_.~-]*[0-9])[A-Za-z0-9+/_.~-]{8,}+"""),
]
BASE = 4
#: A span is kept from this score on.
THRESHOLD = 0.8
#: Characters before and after a span in which context words count.
REACH = 40


#: Matches whose lengths are summed at once, so that a text with very many of them costs no square.
_BLOCK = 256


def _running(rows: Column) -> Column:
    """Places of matches from the gaps before them and their lengths: sums over blocks, then within the block."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["gap"] + x["len"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(rows, b * _BLOCK + 1, _BLOCK)))
    before = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("all")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["all"], a["at"] + n).alias("all")))["all"]

    def place(before: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            start = F.get(before, block) + total(F.slice(rows, block * _BLOCK + 1, i - block * _BLOCK)) + x["gap"]
            return F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["match"].alias("match"))

        return F.transform(rows, one)

    return F.transform(F.array(before), place)[0]


def matches(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, match>> of a pattern's leftmost non-overlapping matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.hint:
        found = F.when(F.contains(text, F.lit(kind.hint)), found)

    def placed(found: Column) -> Column:
        # The text between matches has as many pieces as there are matches, and one more.
        pieces = F.slice(F.split(text, kind.pattern, -1), 1, F.size(found))
        rows = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), m.alias("match")))
        return F.transform(F.array(rows), _running)[0]

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.transform(F.array(found), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))[0]


def digits(x: Column) -> Column:
    """The digits of a string."""
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where the digits of a string pass the Luhn test."""
    at = lambda d: F.filter(F.split(F.reverse(d), ""), lambda c: c != "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1))
    return F.aggregate(F.transform(at(digits(number)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(number: Column) -> Column:
    """True where an account number passes the mod-97 test: its first four characters go to the end, letters count as
    10 to 35, and the rest by 97 is 1."""
    plain = F.upper(F.replace(number, F.lit(" "), F.lit("")))
    turned = F.filter(F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), ""), lambda c: c != "")
    letter = lambda c: F.ascii(c) - 55
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + letter(c)) % 97)) == 1


def octets(ip: Column) -> Column:
    """True where every part of a dotted number is at most 255."""
    short = F.transform(F.split(ip, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def confirmed(kind: Kind, x: Column) -> Column:
    """Whether a match of a kind is kept by its own test."""
    n = F.length(digits(x))
    return {"ip": octets(x), "card": luhn(x), "phone": (n >= 9) & (n <= 15), "iban": mod97(x)}.get(kind.name, F.lit(True))


def shortened(kind: Kind, m: Column) -> Column:
    """A match of account numbers of a length that its country doesn't have may hold words that follow the number: it ends
    at the last blank before which its checksum holds, if it doesn't hold for all of it. Other matches stay."""
    if kind.name != "iban":
        return m
    words = F.split(m["match"], " ")
    parts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    held = F.filter(parts, lambda p: (F.length(F.replace(p, F.lit(" "), F.lit(""))) >= 12) & mod97(p))
    best = F.coalesce(F.get(held, F.lit(0)), m["match"])
    cut = F.struct(m["start"].alias("start"), (m["start"] + F.length(best)).alias("end"), best.alias("match"))
    return F.when(m["match"].rlike(f"^{EXACT_IBAN}$"), m).otherwise(cut)


def score(text: Column, kind: Kind, m: Column) -> Column:
    """A confirmed match's score: prior, checksum and context words before or after it."""
    start = F.greatest(m["start"] - REACH, F.lit(0))
    sides = (F.substr(text, start + 1, m["start"] - start), F.substr(text, m["end"] + 1, F.lit(REACH)))
    seen = [F.lower(x).rlike(rf"(?<![a-z])(?:{kind.near})(?![a-z])") for x in sides] if kind.near else []
    near = F.when(seen[0] | seen[1], F.lit(kind.context)).otherwise(F.lit(0.0)) if seen else F.lit(0.0)
    return F.lit(kind.prior + kind.checked) + near


def find(df: DataFrame, text_col: str = "text", out_col: str = "pii", kinds: list[Kind] | None = None) -> DataFrame:
    """Adds ``out_col`` array<struct<kind int, start int, end int>>: spans by kind (its place in ``kinds``), then start,
    in code points, end exclusive.

    A null or empty text has no spans. Weaker kinds than the base don't overlap a base span. Rows are judged alone, so
    repeated rows, null keys and an empty table need no rule; a column named ``out_col`` is replaced, and names that begin
    with ``__pii_`` are the operator's own.
    """
    kinds = kinds or KINDS
    text = F.col(f"`{text_col}`")
    found = df.select(*(c for c in map(lambda c: F.col(f"`{c}`"), (c for c in df.columns if c != out_col))), *(matches(text, k).alias(f"__pii_{i}") for i, k in enumerate(kinds)))

    def spans(i: int, k: Kind) -> Column:
        found = F.col(f"__pii_{i}")
        found = F.transform(found, lambda m: shortened(k, m)) if k.name == "iban" else found
        kept = F.filter(found, lambda m: confirmed(k, m["match"]) & ((F.lit(k.prior) >= THRESHOLD) if k.prior >= THRESHOLD else (score(text, k, m) >= THRESHOLD)))
        return F.transform(kept, lambda m: F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    base = F.concat(*(spans(i, k) for i, k in enumerate(kinds[:BASE])))
    more = F.concat(none, *(spans(i + BASE, k) for i, k in enumerate(kinds[BASE:])))
    some = lambda part: F.lit(False) if not part else F.greatest(*(F.size(f"__pii_{i}") for i in part), F.lit(0)) > 0
    found = found.withColumn("__pii_base", F.when(some(range(BASE)), base).otherwise(none)).withColumn("__pii_more", F.when(some(range(BASE, len(kinds))), more).otherwise(none))
    clear = F.filter("__pii_more", lambda m: ~F.exists("__pii_base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.withColumn(out_col, F.concat("__pii_base", clear)).drop("__pii_base", "__pii_more", *(f"__pii_{i}" for i in range(len(kinds))))


def redacted(text: Column, spans: Column, kinds: list[Kind] | None = None) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    names = F.array(*(F.lit(f"[{k.name.upper()}]") for k in kinds or KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(a: Column, s: Column) -> Column:
        cut = F.concat(a["out"], F.substr(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(cut).alias("out"))

    end = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    whole = F.transform(F.array(end), lambda e: F.concat(e["out"], F.substr(text, e["at"] + 1, F.length(text))))[0]
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def listed(spans: Column, kinds: list[Kind] | None = None) -> Column:
    """``kind:start:end`` of the spans in their order, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in kinds or KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
