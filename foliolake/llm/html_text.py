"""Operator 3: main text of web pages by template deduction over the pages of a host.

1. Every page is cut into tokens: a tag with its class and the names of the elements around it, or a whole block of text
   with these names. A token's occurrence vector has, for each different page of the host, how often the token comes.
   The vector is never stored: pages are hashed with their counts and combined by exclusive or, with partial aggregation,
   so a host with a third of all pages is no larger than another. Copies of a page count once.
2. Tokens of a host with the same vector form an equivalence class. A class is valid if it comes on at least ``SHARE`` of
   the host's pages and on ``SUPPORT`` pages and has a size of at least ``CLASS``, where a block counts its words and a
   tag its start and end. The tokens of the valid classes are the host's template. As a token must be on half of the
   pages, a template has at most twice as many tokens as an average page.
3. Every page is cut by the template: its template elements nest by their paths, and what stands between two template
   tokens of one of them is a slot. Over the host's pages the text in slots is summed for each template element; the
   smallest element that is met once a page and holds more than half is the host's main element.
4. Template text is dropped on every page, inside an article too. Slots in the main element are the text, all other
   slots too but those that are mostly links. Names decide where this leaves it open: an article around the main
   element, or on pages without one, stands for it and then other slots are dropped; elements that are chrome by name or
   class (menus, footers, sidebars, notices, adverts, forms, comments) are dropped where the template has them too, or on
   pages without a template.
   A page that has nothing but its host's template keeps the template text of its main element or article.

References are decoded, white space in a block becomes one blank, and blocks are joined in page order.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from foliolake.llm.common import drop, stored

SUPPORT, SHARE, CLASS = 3, 0.5, 3
#: Tokens (8 bytes each) of all templates up to which they may be broadcast; beyond it they are joined by host.
BROADCAST_TOKENS = 2_000_000

#: Fixed values of HTML: elements without content, those whose content isn't markup, and those that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|textarea|iframe|title|select|xmp"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that the start of these ends.
IMPLIED = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
INLINE = frozenset("b i em strong a span font".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CHROME = frozenset("nav aside form footer button dialog menu label input fieldset".split())
#: Parts of a class, id or role that mark chrome.
CHROME_NAME = re.compile(
    r"(?<![a-z])(?:ads?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|banner|sidebar|side-?bar|menu|nav(?:bar|igation)?|breadcrumbs?|footer|masthead|site-?header|page-?header|cookies?|consent|gdpr|"
    r"notices?|alert|newsletter|subscri[a-z]*|sign-?up|log-?in|comments?|commentlist|respond|repl(?:y|ies)|discuss[a-z]*|disqus|share|sharing|social|related|recommend[a-z]*|popup|modal|overlay|widget|search|pagination|pager|toolbar|skip-?link)(?![a-z])"
)
#: Around articles that are not the page's own.
_OTHERS = re.compile("comment|repl|respond|discuss|related|recommend")
#: Comments, elements whose content isn't markup, and tags without an angle bracket inside. No part of it scans beyond the
#: next bracket, or scans twice what it skips.
_SIMPLE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})(?=[\s/>])[^<>]*+>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^<>\"]*+\"|'[^<>']*+')*+)>|<[!?/][^<>]*+>",
    re.S | re.I,
)
_RAW_START, _NAME = re.compile(rf"<({RAW})(?=[\s/>])", re.I), re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMED = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'])(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


#: Elements that can be a host's main element.
CONTAINERS = frozenset("article main section div td table form center blockquote".split())
_DIGITS = re.compile("[0-9]+")


@dataclass
class Element:
    """An element of a page. path: a hash of the names of the elements around it and its own; label: its class, id and
    role; up: place of the element around it, -1 without."""

    path: int
    name: str
    label: str
    hidden: bool
    up: int
    depth: int

    @property
    def token(self) -> int:
        return _hash(self.path, "." + _DIGITS.sub("0", self.label)) if self.label else self.path


@dataclass
class Block:
    """A block of text. path: that of its innermost open element; up: place of the innermost one; at: elements begun before its
    end; links: characters in links."""

    path: int
    text: str
    up: int
    at: int
    links: int


class _Ends:
    """Ends of tags with brackets or lone quotes inside. Places of quotes and closing brackets are listed once a page, and
    from what place on there is no end is remembered, so that all tags together take time in proportion to the page."""

    def __init__(self, page: str):
        self.page, self.marks = page, [(m.start(), m[0]) for m in re.finditer("[\"'>]", page)]
        self.places = [at for at, _ in self.marks]
        self.closing = [0] * len(self.marks)  # of each mark, the next one of its kind
        last: dict[str, int] = {}
        for k in range(len(self.marks) - 1, -1, -1):
            self.closing[k] = last.get(self.marks[k][1], len(self.marks))
            last[self.marks[k][1]] = k
        self.open_ended: set[int] = set()

    def bracket(self, at: int) -> int:
        """The next closing bracket; -1 for none."""
        k = bisect_left(self.places, at)
        k = k if k < len(self.marks) and self.marks[k][1] == ">" else self._next_bracket(k)
        return self.places[k] if k < len(self.marks) else -1

    def _next_bracket(self, k: int) -> int:
        at = self.page.find(">", self.places[k]) if k < len(self.marks) else -1
        return bisect_left(self.places, at) if at >= 0 else len(self.marks)

    def tag(self, at: int) -> int:
        """The closing bracket of a tag outside its quotes; -1 if there is none, as a quote isn't closed."""
        k, passed = bisect_left(self.places, at), []
        while k < len(self.marks) and self.marks[k][1] != ">" and k not in self.open_ended:
            passed.append(k)
            k = self.closing[k] + 1
        if k < len(self.marks) and self.marks[k][1] == ">":
            return self.places[k]
        self.open_ended.update(passed)
        return -1


def tags(page: str) -> Iterator[tuple[int, int, str | None, str | None, str | None, str | None]]:
    """Begin and end of every tag, comment and element of raw content, its raw element's name, or the tag's slash, name and
    attributes. A tag whose quotes aren't closed ends at the next bracket and has no name; without one it is text."""
    done = 0
    for m in _SIMPLE.finditer(page):
        if page.find("<", done, m.start()) >= 0:
            break
        yield m.start(), m.end(), *m.groups()
        done = m.end()
    # Most pages have nothing else; from the first other bracket on each is looked at.
    ends, at, last = None, page.find("<", done), page.rfind(">")
    while at >= 0:
        m = _SIMPLE.match(page, at)
        if m:
            yield at, m.end(), *m.groups()
            at = page.find("<", m.end())
            continue
        found = None
        if at < last:
            ends = ends or _Ends(page)
            if raw := _RAW_START.match(page, at):
                begin = ends.bracket(raw.end()) + 1
                close = re.compile(rf"</{raw[1]}\s*+>", re.I).search(page, begin)
                found = at, close.end() if close else len(page), raw[1], None, None, None
            elif name := _NAME.match(page, at):
                end = ends.tag(name.end())
                found = (at, end + 1, None, name[1], name[2], page[name.end() : end]) if end >= 0 else (at, ends.bracket(name.end()) + 1, None, None, None, None)
            elif page[at + 1 : at + 2] in ("!", "?", "/"):
                found = at, ends.bracket(at) + 1, None, None, None, None
        if found:
            yield found
        at = page.find("<", found[1] if found else at + 1)


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements and blocks of text of a page, in order."""
    blocks: list[Block] = []
    elements: list[Element] = []
    stack: list[tuple[str, int, int]] = []  # name, place in elements, how many stand below it and the inline ones there
    open_: Counter[str] = Counter()
    held: list[str] = []
    link_chars = at = 0

    def flush() -> None:
        nonlocal link_chars
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                up = stack[-1][1] if stack else -1
                blocks.append(Block(elements[up].path if stack else 0, text, up, len(elements), link_chars))
            held.clear()
        link_chars = 0

    def close(k: int) -> None:
        open_.subtract(s[0] for s in stack[k:])
        del stack[k:]

    for begin, end, raw, slash, tag, attributes in tags(page):
        if begin > at:
            part = page[at:begin]
            held.append(part)
            link_chars += len(part) if open_["a"] else 0
        at = end
        name = (tag or "").lower()
        if not name:
            if raw and raw.lower() == "title":
                flush()
            continue
        if slash:
            if open_[name]:  # else there is nothing to look for
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if any(s[0] in BLOCKS for s in stack[k:]):
                    flush()
                close(k)
            elif name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            held.append(" ")
        ends = IMPLIED.get(name)
        if ends:  # the outermost one to end, through elements that don't stop it
            last = k = len(stack)
            while k:
                k = k if stack[k - 1][0] not in INLINE else stack[k - 1][2]
                if not k or stack[k - 1][0] not in ends:
                    break
                k -= 1
                last = k
            close(last)
        up = stack[-1][1] if stack else -1
        path, depth = (elements[up].path, elements[up].depth + 1) if stack else (0, 0)
        label = " ".join(x.strip("\"'").lower() for x in _NAMED.findall(attributes)) if attributes else ""
        elements.append(Element(_hash(path, name), name, label, bool(attributes and _HIDDEN.search(attributes)), up, depth))
        if name not in VOID and not attributes.endswith("/"):
            # Below a run of inline elements stands what an implied end has to look at next.
            below = stack[-1][2] if stack and stack[-1][0] in INLINE else len(stack)
            stack.append((name, len(elements) - 1, below))
            open_[name] += 1
    if at < len(page):
        held.append(page[at:])
    flush()
    return elements, blocks


def _hash(path: int, text: str = "") -> int:
    return xxh64_intdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass"))


def tokens(page: str) -> dict[int, tuple[int, int]]:
    """Occurrences of the page's tokens, and their sizes: words of a block, 2 of a tag, 1 of a tag without content."""
    elements, blocks = parse(page)
    out: dict[int, tuple[int, int]] = {}
    for token, size in chain(((e.token, 1 if e.name in VOID else 2) for e in elements), ((_hash(b.path, b.text), b.text.count(" ") + 1) for b in blocks)):
        out[token] = (out.get(token, (0, 0))[0] + 1, size)
    return out


class Cut:
    """A page cut by its host's template (``known``, its tokens; empty without one).

    fixed: whether an element is of the template; open: the blocks in slots; slot: the slot of each of these, its
    innermost template element and the last template token before it; held: characters of open blocks in each element."""

    def __init__(self, page: str, known: frozenset | set):
        self.elements, self.blocks = parse(page)
        self.tokens = [e.token for e in self.elements]
        self.known, self.fixed = known, [t in known for t in self.tokens]
        home: list[int] = []  # the innermost template element in which an element is, or itself
        hidden: list[bool] = []
        for i, e in enumerate(self.elements):
            home.append(i if self.fixed[i] else home[e.up] if e.up >= 0 else -1)
            hidden.append(e.hidden or e.up >= 0 and hidden[e.up])
        self.shown = [b for b in self.blocks if b.up < 0 or not hidden[b.up]]
        self.open: list[Block] = []
        self.slot: list[tuple[int, int, int]] = []
        last = passed = at = 0
        for b in self.shown:
            while at < b.at:
                at += 1
                last = at if self.fixed[at - 1] else last
            if known and _hash(b.path, b.text) in known:
                passed += 1
            else:
                self.open.append(b)
                self.slot.append((home[b.up] if b.up >= 0 else -1, last, passed))
        self.held = self.sums(self.open)

    def sums(self, blocks: list[Block]) -> list[int]:
        """Characters of the blocks in each element."""
        out = [0] * len(self.elements)
        for b in blocks:
            if b.up >= 0:
                out[b.up] += len(b.text)
        for i in range(len(out) - 1, -1, -1):
            if self.elements[i].up >= 0:
                out[self.elements[i].up] += out[i]
        return out

    def around(self, up: int) -> Iterator[int]:
        """Places of an element and of those around it."""
        while up >= 0:
            yield up
            up = self.elements[up].up

    def weights(self) -> Iterator[tuple[int, int, int]]:
        """Token, depth and characters in slots of the template elements that come once and can be a main element."""
        n = Counter(self.tokens)
        for i, e in enumerate(self.elements):
            if self.fixed[i] and e.name in CONTAINERS and n[self.tokens[i]] == 1:
                yield self.tokens[i], e.depth, self.held[i]

    def main(self, token: int | None) -> int:
        """Place of the main element: that with the host's token, or without one the smallest container that holds more
        than half of the page's open text; -1 without. An article around it stands for it."""
        if token is not None:
            i = next((i for i, t in enumerate(self.tokens) if t == token), -1)
        else:
            most = sum(len(b.text) for b in self.open)
            large = [i for i, e in enumerate(self.elements) if e.name in CONTAINERS and 2 * self.held[i] > most]
            i = max(large, key=lambda i: self.elements[i].depth, default=-1)
        for k in self.around(i):
            i = k if self.elements[k].name in ("article", "main") else i
        return i

    def chrome(self, main: int) -> tuple[list[bool], list[bool]]:
        """Whether each element is chrome, and whether it is in an article.

        A name is a hint: on a page with a template an element is chrome by name only if it is of the template too. An
        article, a heading, the main element and what is around it never are by name alone, but a reader's comment in
        an article is if it is of the template."""
        spared = set(self.around(main))
        chrome: list[bool] = []
        article: list[bool] = []
        for i, e in enumerate(self.elements):
            off, inside = (chrome[e.up], article[e.up]) if e.up >= 0 else (False, False)
            named = e.name in CHROME or (e.name == "header" and not inside) or bool(e.label and e.name not in ("body", "html", "main") and CHROME_NAME.search(e.label))
            named = named and i not in spared and e.name not in HEADINGS and (self.fixed[i] or not self.known)
            if e.name == "article":
                named = named and inside and self.fixed[i]
            off = off or named or e.name == "head"
            if e.name in ("article", "main") and not named:
                # An article in a menu or advert that was never closed is an article all the same; a reader's comment isn't.
                if off and not (e.up >= 0 and _OTHERS.search(self.elements[e.up].label)):
                    off = False
                inside = inside or not off
            chrome.append(off)
            article.append(inside)
        return chrome, article

    def text(self, token: int | None) -> list[Block]:
        """The blocks of the main text. token: that of the host's main element."""
        main = self.main(token)
        chrome, article = self.chrome(main)
        in_main = lambda b: main >= 0 and main in self.around(b.up)
        on = lambda b: b.up < 0 or not chrome[b.up]
        inside = lambda b: b.up >= 0 and article[b.up]
        if any(inside(b) and on(b) for b in self.shown):
            named = main >= 0 and self.elements[main].name in ("article", "main") or token is None or main < 0
            whole = [b for b in self.shown if on(b) and (inside(b) if named else inside(b) or in_main(b))]
            left = set(map(id, self.open))
            return [b for b in whole if id(b) in left] or whole
        links: Counter = Counter()
        chars: Counter = Counter()
        for b, slot in zip(self.open, self.slot, strict=True):
            links[slot] += b.links
            chars[slot] += len(b.text)
        # Without a main element a slot may hold menu and text alike: there, blocks that are nothing but a link.
        linked = lambda b, slot: 2 * links[slot] > chars[slot] if main >= 0 and self.known else b.links >= len(b.text)
        kept = [b for b, slot in zip(self.open, self.slot, strict=True) if on(b) and (in_main(b) or not linked(b, slot))]
        return kept or [b for b in self.shown if on(b) and (main < 0 or in_main(b)) and b.links < len(b.text)]


def main_text(page: str, template: frozenset | set = frozenset(), main: int | None = None) -> str:
    """The text in the content slots of a page. template: tokens of its host's template; main: that of its main element."""
    return "\n\n".join(b.text for b in Cut(page, template).text(main))


def host(url_col: str) -> Column:
    """The host of an address in lower case; null if there is none."""
    found = F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def _known(template: pa.Scalar, host: str | None, held: dict) -> frozenset:
    """A template as a set; ``held`` has those of the last hosts."""
    if not template.is_valid:
        return frozenset()
    if host not in held:
        if len(held) >= 64:
            held.clear()
        held[host] = frozenset(template.values.to_numpy().view(np.uint64).tolist())
    return held[host]


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host and template (array of token hashes) of every host that has valid classes. Pages without host or html have
    no part in this, and copies of a page on its host count once."""
    given = pages.select(host(url_col).alias("host"), F.xxhash64(F.col(f"`{html_col}`")).alias("page"), F.col(f"`{html_col}`").alias("html")).where("host IS NOT NULL AND html IS NOT NULL")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counted = [tokens(x) for x in part.column("html").to_pylist()]
                sizes = [len(c) for c in counted]
                token = np.fromiter((t for c in counted for t in c), np.uint64, sum(sizes))
                n = np.fromiter((v for c in counted for v, _ in c.values()), np.int32, sum(sizes))
                size = np.fromiter((v for c in counted for _, v in c.values()), np.int32, sum(sizes))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (token.view(np.int64), n, size)]
                yield pa.RecordBatch.from_arrays([part.column("host"), part.column("page"), *lists], ["host", "page", "token", "n", "size"])

    # Pages become short lists of numbers before copies of a page are dropped, so that no markup is shuffled.
    once = stored(given.mapInArrow(run, "host string, page bigint, token array<bigint>, n array<int>, size array<int>").dropDuplicates(["host", "page"]), "page-tokens")
    rows = once.select("host", "page", F.inline(F.arrays_zip("token", "n", "size")))
    vectors = rows.groupBy("host", "token").agg(F.count("*").alias("support"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.max("size").alias("size")).where(F.col("support") >= SUPPORT)
    n_pages = once.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= SUPPORT)
    common = vectors.join(n_pages.hint("merge"), "host").where(F.col("support") >= SHARE * F.col("pages"))
    classes = common.groupBy("host", "support", "vector").agg(F.sum("size").alias("size"), F.collect_list("token").alias("tokens")).where(F.col("size") >= CLASS)
    out = stored(classes.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template")), "templates")
    drop(once)
    return out


def main_elements(rows: DataFrame) -> DataFrame:
    """host and main: the token of the main element of every host that has one. rows: host, html, template."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple] = []
                for host_, page, template in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), part.column("template"), strict=True):
                    cut = Cut(page, _known(template, host_, held))
                    out.append((host_, None, 0, sum(len(b.text) for b in cut.open)))
                    out.extend((host_, *w) for w in cut.weights())
                token = pa.array([None if t is None else t - (t >> 63 << 64) for _, t, _, _ in out], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), token, pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64())], ["host", "token", "depth", "chars"])

    found = rows.where("template IS NOT NULL").select("host", "html", "template").mapInArrow(run, "host string, token bigint, depth bigint, chars bigint")
    sums = found.groupBy("host", "token").agg(F.sum("chars").alias("chars"), F.max("depth").alias("depth"))
    # A host's elements are at most its template's; the row without a token has all of the host's open text.
    each = sums.groupBy("host").agg(F.max(F.when(F.col("token").isNull(), F.col("chars"))).alias("all"), F.collect_list(F.when(F.col("token").isNotNull(), F.struct("chars", (-F.col("depth")).alias("depth"), "token"))).alias("elements"))
    return each.select("host", F.array_min(F.filter("elements", lambda e: 2 * e["chars"] > F.col("all")))["token"].alias("main")).where("main IS NOT NULL")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text.

    A null or empty html gives an empty text. Pages without a host are extracted without a template, as are those of
    hosts with too few pages. Repeated rows and null keys give a row each; an empty table gives an empty table. Only
    the three named columns are read. Whole pages are read and whole texts returned.
    """
    found = templates(pages, url_col, html_col)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), host(url_col).alias("host"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    small = (found.agg(F.sum(F.size("template") + 16)).first()[0] or 0) <= BROADCAST_TOKENS
    sided = lambda df: F.broadcast(df) if small else df.hint("merge")
    mains = stored(main_elements(rows.join(sided(found), "host")), "main-elements")
    found = found.join(mains.hint("merge"), "host", "left")
    rows = rows.join(sided(found), "host", "left").select("page_id", "url", "host", "html", "template", "main")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for host_, page, template, main in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), part.column("template"), part.column("main").to_pylist(), strict=True):
                    texts.append(main_text(page, _known(template, host_, held), None if main is None else main % 2**64))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.mapInArrow(run, f"{kinds}, text string")
