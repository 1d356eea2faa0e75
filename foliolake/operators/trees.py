"""Trees, keyed lookups and generations, as joins.

A document's tree or outline is one row of arrays, dealt once by its key; a document bounds every group. Trees are walked
level by level within that row, to a depth that the formats fix. Paths are arrays of places, whose order is that of the
walk. A level has each node once, with its first path, so that shared parts of a tree are no more work than others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.sources.shared import cut

#: How deep page trees, name trees and outlines are followed, and the wrapping of destinations.
PAGE_DEPTH, NAME_DEPTH, OUTLINE_DEPTH, WRAPS = 64, 16, 3, 8
NO_NAME = ("W", "Index")
#: What pages have from the nearest node above them that has it.
INHERITED = ("resources", "media_box", "rotate")


def _family(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """One row a document: doc_id, rows (the document's nodes by parent and place, roots first: node, ord, the given columns,
    and where the rows of a node's own children begin and how many there are) and the number of roots.

    Nodes are dealt by document, once. Every row is met under its own key and under its parent's, which tells where a
    node's children stand."""
    given = nodes.where("node IS NOT NULL").repartition("doc_id")
    order = Window.partitionBy("doc_id").orderBy(F.col("parent").asc_nulls_first(), "ord", "node", *columns)
    numbered = given.select("doc_id", "node", "parent", "ord", *columns, (F.row_number().over(order) - 1).alias("at"))
    both = numbered.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("self")).withColumn("key", F.when(F.col("self"), F.col("node")).otherwise(F.col("parent")))
    same = Window.partitionBy("doc_id", "key")
    child = F.when(~F.col("self"), F.col("at"))
    met = both.withColumns({"begin": F.coalesce(F.min(child).over(same), F.lit(0)), "n": F.count(child).over(same).cast("int")})
    row = F.when(F.col("self"), F.struct("at", "node", "ord", "begin", "n", *columns))
    return met.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.count_if(F.col("self") & F.col("parent").isNull()).cast("int").alias("roots"))


def _firsts(found: Column) -> Column:
    """Of each node the row with the first path. A later path of the same length can only lead to later places."""
    by_node = F.array_sort(found)  # node, path, ...
    return F.flatten(F.transform(F.array(by_node), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["node"] != x["node"]))))


def _walk(family: DataFrame, depth: int, kept: Callable[[Column, Column | None], dict[str, Column]], leaf: Callable[[Column], Column], inner: Callable[[Column], Column]) -> DataFrame:
    """Adds found to documents: node, path and kept columns of all leaves by their first paths, in the order of nodes.

    A level is a list of nodes, each once; the next one is made of their children, which are slices of the document's rows.
    kept: columns of a node, by its row and its parent's. A node that its own path has already is not followed again."""
    kinds = {f.name: f.dataType.simpleString() for f in family.schema["rows"].dataType.elementType.fields}
    names = list(kept(F.lit(None), None))

    def made(k: Column, above: Column | None) -> Column:
        none = lambda t: F.array().cast(f"array<{t}>")
        path, seen = (none(kinds["ord"]), none(kinds["node"])) if above is None else (above["path"], above["seen"])
        own = kept(k, above)
        ends = [F.coalesce(f(k), F.lit(False)).alias(n) for f, n in ((leaf, "leaf"), (inner, "inner"))]
        return F.struct(k["node"].alias("node"), F.array_append(path, k["ord"]).alias("path"), *(own[c].alias(c) for c in names), F.array_append(seen, k["node"]).alias("seen"), k["begin"].alias("begin"), k["n"].alias("n"), *ends)

    def leaves(level: Column) -> Column:
        return F.transform(F.filter(level, lambda x: x["leaf"]), lambda x: F.struct(*(x[c].alias(c) for c in ("node", "path", *names))))

    def step(s: Column, _: Column) -> Column:
        def children(x: Column) -> Column:
            return F.transform(F.filter(F.slice("rows", x["begin"] + 1, x["n"]), lambda k: ~F.array_contains(x["seen"], k["node"])), lambda k: made(k, x))

        level = _firsts(F.flatten(F.transform(F.filter(s["level"], lambda x: x["inner"]), children)))
        return F.transform(F.array(level), lambda a: F.struct(a.alias("level"), F.concat(s["found"], leaves(a)).alias("found")))[0]

    roots = family.withColumn("level", _firsts(F.transform(F.slice("rows", 1, F.col("roots")), lambda k: made(k, None))))
    start = F.struct("level", leaves(F.col("level")).alias("found"))
    steps = F.sequence(F.lit(2), F.lit(depth)) if depth > 1 else F.array().cast("array<int>")
    return roots.select("doc_id", _firsts(F.aggregate(steps, start, step, lambda s: s["found"])).alias("found"))


def flatten_page_tree(nodes: DataFrame, depth: int = PAGE_DEPTH) -> DataFrame:
    """Leaves in order with inherited attributes: doc_id, node, page_no, and of ``INHERITED`` the columns that nodes have.

    nodes: doc_id, node, parent (null for a root), ord (place among siblings), type, attributes. A node with several
    parents counts where the walk meets it first, and a node that its own path has already is not followed again. A leaf
    is what is a page, or has no children and isn't a branch. Nodes are dealt by document once, and a document is a row of
    arrays in which the levels are found one after another; nothing is joined or shuffled for a level.
    """
    own = [c for c in INHERITED if c in nodes.columns]
    kept = lambda k, above: {c: k[c] if above is None else F.coalesce(k[c], above[c]) for c in own}
    leaf = lambda k: (k["type"] == "Page") | ((k["type"] != "Pages") & (k["n"] == 0))
    inner = lambda k: (k["type"] == "Pages") | ((k["n"] > 0) & (k["type"] != "Page"))
    walked = _walk(_family(nodes, ["type", *own]), depth, kept, leaf, inner)
    in_order = F.array_sort(F.transform("found", lambda x: F.struct(x["path"].alias("path"), x["node"].alias("node"), *(x[c].alias(c) for c in own))))
    return walked.select("doc_id", F.posexplode(in_order).alias("page_no", "r")).select("doc_id", "r.node", "page_no", *(f"r.{c}" for c in own))


def page_tree_fallback(pages: DataFrame, objects: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """Pages, and for documents without any that were scanned byte by byte all objects of type Page in the order of their
    numbers. objects: doc_id, num, type; pages: doc_id, num, page_no; scanned: doc_id (all documents if not given)."""
    order = Window.partitionBy("doc_id").orderBy("num")
    more = objects.where("type = 'Page'").join(pages.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti")
    if scanned is not None:
        more = more.join(scanned.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    return pages.select("doc_id", "num", "page_no").unionByName(more.select("doc_id", "num", (F.row_number().over(order) - 1).alias("page_no")))


def _doubled(state: Column, n: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` as often as pointers have to be doubled to lead over n places."""
    rounds = F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), rounds), state, lambda s, _: step(s))


def _outline_arrays(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """One row a document: doc_id, root, firsts, nexts (places of the nodes that a node leads to, -1 for none), entries
    (title, page_no), all in the order of the nodes' numbers, and whether two pointers lead to one node.

    Nodes and pointers are dealt by document and sorted by the number that they have or lead to, so that a running value
    turns numbers into places."""
    one = nodes.groupBy("doc_id", "num").agg(F.min(F.struct("first", "next", "title", "page_no")).alias("r")).select("doc_id", "num", "r.*")
    kinds = [("num", 0), ("first", 1), ("next", 2)]
    rows = one.select("doc_id", "num", "title", "page_no", F.inline(F.array(*(F.struct(F.col(c).cast("long").alias("to"), F.lit(k).alias("kind")) for c, k in kinds))))
    missing = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("num", "title", "page_no")}
    rows = rows.unionByName(roots.groupBy("doc_id").agg(F.min("first").cast("long").alias("to")).withColumns({**missing, "kind": F.lit(3)}))
    until = Window.partitionBy("doc_id").orderBy("to", "kind").rowsBetween(Window.unboundedPreceding, 0)
    is_node = F.col("kind") == 0
    seen = F.last(F.when(is_node, F.struct("to", F.lit(0))), True).over(until)
    place = F.when(F.col("to").eqNullSafe(seen["to"]) & F.col("to").isNotNull(), F.count(F.when(is_node, 1)).over(until).cast("int") - 1).otherwise(-1)
    placed = rows.repartition("doc_id").withColumn("place", place)
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("num", "place")))), lambda r: r["place"])
    arrays = placed.groupBy("doc_id").agg(
        F.max(F.when(F.col("kind") == 3, F.col("place"))).alias("root"), of(1).alias("firsts"), of(2).alias("nexts"),
        F.transform(F.sort_array(F.collect_list(F.when(is_node, F.struct("num", "title", "page_no")))), lambda r: F.struct(r["title"].alias("title"), r["page_no"].cast("int").alias("page_no"))).alias("entries"),
    ).where("root >= 0")
    led = F.filter(F.concat("firsts", "nexts", F.array("root")), lambda p: p >= 0)
    return arrays.withColumn("twice", F.size(F.array_distinct(led)) < F.size(led))


def _ranked(arrays: DataFrame, depth: int) -> DataFrame:
    """Entries of outlines in which one pointer at most leads to a node.

    first and next make a binary tree. Pointers to the node above are doubled until they reach the top: that gives a node's
    level, and whether it hangs on the root. Then the walk is a list: a node is entered, left for what follows it, and left
    for good, and each of these events has one that comes next. Doubling these pointers counts the entries from an event to
    the end of the walk, which orders them.
    """
    n = F.size("entries")
    # (to, from, 1 for a child and 0 for a sibling), and for each node one that leads from itself.
    links = F.concat(
        F.transform("firsts", lambda t, i: F.struct(t.alias("to"), i.alias("of"), F.lit(1).alias("w"))), F.transform("nexts", lambda t, i: F.struct(t.alias("to"), i.alias("of"), F.lit(0).alias("w"))),
        F.transform("nexts", lambda t, i: F.struct(i.alias("to"), F.lit(-1).alias("of"), F.lit(0).alias("w"))),
    )
    a = arrays.withColumn("links", F.sort_array(F.filter(links, lambda x: x["to"] >= 0)))
    last = lambda x, k: (k + 1 == F.size("links")) | (F.get("links", k + 1)["to"] != x["to"])
    a = a.withColumn("above", F.filter("links", last)).drop("links")
    up = F.struct(F.transform("above", lambda x: F.when(x["of"] < 0, x["to"]).otherwise(x["of"])).alias("p"), F.transform("above", lambda x: x["w"]).alias("d"))
    double = lambda s: F.struct(F.transform(s["p"], lambda q: F.get(s["p"], q)).alias("p"), F.transform(s["d"], lambda d, i: d + F.get(s["d"], F.get(s["p"], i))).alias("d"))
    a = a.withColumn("top", _doubled(up, n, double))
    level = lambda i: F.get(F.col("top.d"), i) + 1
    good = F.transform("entries", lambda e, i: (F.coalesce(e["title"], F.lit("")) != "") & e["page_no"].isNotNull() & (F.get(F.col("top.p"), i) == F.col("root")) & (level(i) <= depth))
    a = a.withColumn("good", good)

    def events(x: Column, i: Column) -> Column:
        child, sibling, above = F.get("firsts", i), F.get("nexts", i), x["of"]
        enter = F.when((child >= 0) & (level(i) < depth), 3 * child).otherwise(3 * i + 1)
        left = F.when(sibling >= 0, 3 * sibling).otherwise(3 * i + 2)
        gone = F.when(above < 0, 3 * i + 2).when(x["w"] == 1, 3 * above + 1).otherwise(3 * above + 2)
        return F.array(enter, left, gone)

    walk = F.struct(F.flatten(F.transform("above", events)).alias("p"), F.flatten(F.transform("good", lambda g: F.array(g.cast("int"), F.lit(0), F.lit(0)))).alias("d"))
    a = a.withColumn("rank", _doubled(walk, 3 * n, double)["d"])
    entry = F.transform("entries", lambda e, i: F.when(F.get("good", i), F.struct((F.get("rank", 3 * F.col("root")) - F.get("rank", 3 * i)).alias("seq"), e["title"].alias("title"), e["page_no"].alias("page_no"), level(i).alias("depth"))))
    return a.select("doc_id", F.inline(F.filter(entry, lambda e: e.isNotNull())))


def _walked(arrays: DataFrame, depth: int) -> DataFrame:
    """As _ranked, for outlines with nodes that two pointers lead to: which of them counts depends on the whole walk before,
    so a document is walked in sequence."""
    import pandas as pd

    def go(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for doc, root, firsts, nexts, entries in zip(*(batch[c] for c in ("doc_id", "root", "firsts", "nexts", "entries")), strict=True):
                seen, todo, n = set(), [(root, 1)], 0
                while todo:
                    i, level = todo.pop()
                    if i < 0 or i in seen or level > depth:
                        continue
                    seen.add(i)
                    e = entries[i]
                    if e["title"] and e["page_no"] is not None:
                        out.append((doc, n, e["title"], int(e["page_no"]), level))
                        n += 1
                    todo += [(int(nexts[i]), level), (int(firsts[i]), level + 1)]  # the child is taken first
            yield pd.DataFrame(out, columns=["doc_id", "seq", "title", "page_no", "depth"])

    kind = arrays.schema["doc_id"].dataType.simpleString()
    return arrays.select("doc_id", "root", "firsts", "nexts", "entries").mapInPandas(go, f"doc_id {kind}, seq int, title string, page_no int, depth int")


def flatten_outline(nodes: DataFrame, roots: DataFrame, depth: int = OUTLINE_DEPTH) -> DataFrame:
    """Outline entries in order: doc_id, seq, title, page_no, depth.

    nodes: doc_id, num, first, next, title, page_no; roots: doc_id, first. A node already visited ends its chain of
    siblings; entries without title or page are left out, and what is below them is not; nothing is deeper than ``depth``.
    Of several nodes with one number the smallest row counts, pointers to numbers that aren't there lead nowhere, and a
    document without its root's node has no entries.

    Nodes are dealt by document once. Outlines without a node that two pointers lead to are put in order by doubling
    pointers, in the JVM and in a number of rounds that is the logarithm of a document's length; if there are others, those
    alone are walked node by node. A document's outline is one row of arrays, as it is one document's own.
    """
    arrays = cut(_outline_arrays(nodes, roots))
    out = _ranked(arrays.where("NOT twice"), depth)
    others = arrays.where("twice")
    return out if others.isEmpty() else out.unionByName(_walked(others, depth))


def flatten_name_tree(nodes: DataFrame, depth: int = NAME_DEPTH) -> DataFrame:
    """Names and targets of a tree: doc_id, name, page_ref, path; of equal names the first counts, with or without a
    leading slash. nodes: doc_id, node, parent, ord, name, page_ref (both null for a branch). As page trees, without a
    shuffle for a level; names are compared within a document's row."""
    always = lambda k: F.lit(True)
    walked = _walk(_family(nodes, ["name", "page_ref"]), depth, lambda k, above: {"name": k["name"], "page_ref": k["page_ref"]}, lambda k: k["name"].isNotNull(), always)
    found = walked.select("doc_id", F.inline("found")).select("doc_id", F.regexp_replace("name", "^/", "").alias("name"), "page_ref", "path")
    return found.groupBy("doc_id", "name").agg(F.min_by("page_ref", "path").alias("page_ref"), F.min("path").alias("path"))


def unwrap_dests(dests: DataFrame, objects: DataFrame, wraps: int = WRAPS) -> DataFrame:
    """Destinations with what they lead to: doc_id, origin, name, page_ref.

    dests: doc_id, origin, name, num (the object that the name stands for); objects: doc_id, num, kind, page_ref (of an
    ``array``), inner (number of the object that the key D of a ``dict`` refers to, or null). At most so many objects are
    looked at; whatever isn't an array by then, or isn't there, leads nowhere, and its page_ref is null.
    """
    o = objects.select("doc_id", "num", F.col("kind").alias("_kind"), F.col("page_ref").alias("_ref"), F.col("inner").alias("_inner")).hint("merge")
    open_, done = dests.select("doc_id", "origin", "name", "num"), []
    for _ in range(wraps):
        met = cut(open_.join(o, ["doc_id", "num"], "left"))
        ends = (F.col("_kind") == "dict") & F.col("_inner").isNotNull()
        done.append(met.where(~F.coalesce(ends, F.lit(False))).select("doc_id", "origin", "name", F.when(F.col("_kind") == "array", F.col("_ref")).alias("page_ref")))
        open_ = met.where(ends).select("doc_id", "origin", "name", F.col("_inner").alias("num"))
        if open_.isEmpty():
            break
    else:
        done.append(open_.select("doc_id", "origin", "name", F.lit(None).cast(objects.schema["page_ref"].dataType).alias("page_ref")))
    return reduce(DataFrame.unionByName, done)


def dest_names(entries: DataFrame) -> DataFrame:
    """Adds dest_name to entries: their own named destination (dest_name), else the name that leads an array of theirs
    (array_name), else, for entries without a destination, the name that a GoTo action has (action, action_name). Entries
    may lack some of these columns."""
    has = lambda c: F.col(c) if c in entries.columns else F.lit(None).cast("string")
    return entries.withColumn("dest_name", F.coalesce(has("dest_name"), has("array_name"), F.when(has("action") == "GoTo", has("action_name"))))


def resolve_named_dest(entries: DataFrame, dests: DataFrame) -> DataFrame:
    """Adds page_ref to entries (doc_id, dest_name): the old dictionary by name, then by the name with a slash, then the
    name tree. The first that has the name counts, even if it leads nowhere. dests: doc_id, origin ('dict' or 'tree'),
    name, page_ref."""
    d = dests.groupBy("doc_id", "origin", "name").agg(F.struct(F.min("page_ref").alias("page_ref")).alias("found"))
    side = lambda origin, out: d.where(F.col("origin") == origin).select("doc_id", F.col("name").alias("dest_name"), F.col("found").alias(out)).hint("merge")
    by_slash = d.where("origin = 'dict' AND name LIKE '/%'").select("doc_id", F.substring("name", F.lit(2), F.length("name")).alias("dest_name"), F.col("found").alias("b")).hint("merge")
    out = entries.join(side("dict", "a"), ["doc_id", "dest_name"], "left").join(by_slash, ["doc_id", "dest_name"], "left").join(side("tree", "c"), ["doc_id", "dest_name"], "left")
    return out.withColumn("page_ref", F.coalesce("a", "b", "c")["page_ref"]).drop("a", "b", "c")


def dest_to_page(dests: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page_no to destinations (doc_id, page_ref, page_num, action): by reference, or the number clamped to the
    document; null for other actions than going to a page. pages: doc_id, num, page_no."""
    refs = pages.select("doc_id", F.col("num").alias("page_ref"), F.col("page_no").alias("by_ref"))
    n = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))
    out = dests.join(refs.hint("merge"), ["doc_id", "page_ref"], "left").join(n.hint("merge"), "doc_id", "left")
    number = F.when(F.col("n_pages") > 0, F.greatest(F.lit(0), F.least(F.col("page_num"), F.col("n_pages") - 1)))
    page = F.when(F.col("action").isNull() | (F.col("action") == "GoTo"), F.when(F.col("page_ref").isNotNull(), F.col("by_ref")).when(F.col("page_num").isNotNull(), number))
    return out.withColumn("page_no", page.cast("int")).drop("by_ref", "n_pages")


def merge_generations(xref: DataFrame) -> DataFrame:
    """One entry for each number: the newest that isn't free, else the newest. Aggregated, so that a number with very
    many generations is no larger in a task than another."""
    rest = [c for c in xref.columns if c not in ("doc_id", "num")]
    best = F.min_by(F.struct(*rest), F.struct(F.when(F.col("type") == 0, 1).otherwise(0), "gen_order", "offs"))
    return xref.groupBy("doc_id", "num").agg(best.alias("e")).select("doc_id", "num", "e.*")


def merge_trailers(trailers: DataFrame) -> DataFrame:
    """Value of each key in the first generation that has it."""
    return trailers.where(~F.col("key").isin(*NO_NAME)).groupBy("doc_id", "key").agg(F.min_by("value", "gen_order").alias("value"))


#: Marks of objects in raw text.
MARKER = r"(?:^|[\s>\])/])(\d{1,10})\s+\d{1,5}\s+obj\b"


def scan_markers(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, num, pos: the last place (in code points, of the number's first digit) of each object's mark."""
    found = F.regexp_extract_all(text_col, F.lit(MARKER), F.lit(0))
    pieces = F.split(F.col(text_col), MARKER, -1)
    lead = lambda m: F.when(m.rlike(r"^\d"), 0).otherwise(1)
    mark = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct((F.length(p) + lead(m)).alias("before"), (F.length(m) - lead(m)).alias("size"), F.regexp_extract(m, MARKER, 1).cast("long").alias("num")))
    given = docs.where(F.contains(text_col, F.lit("obj"))).select("doc_id", F.xxhash64(text_col).alias("text"), F.posexplode(mark).alias("k", "m"))
    # Rows of one id and text have the same marks, which count once.
    rows = given.groupBy("doc_id", "text", "k").agg(F.first("m").alias("m")).select("doc_id", "text", "k", "m.*")
    before = Window.partitionBy("doc_id", "text").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.coalesce(F.sum(F.col("before") + F.col("size")).over(before), F.lit(0)) + F.col("before")
    return rows.select("doc_id", "num", pos.cast("int").alias("pos")).groupBy("doc_id", "num").agg(F.max("pos").alias("pos"))


def lookup_chain(refs: DataFrame, first: DataFrame, second: DataFrame, third: DataFrame) -> DataFrame:
    """Adds value and origin to refs (doc_id, num): the first of three tables (doc_id, num, value) that has one. Of several
    values in the third the one registered first counts (its column seq)."""
    one = lambda t, name: t.groupBy("doc_id", "num").agg(F.min_by("value", "seq").alias(name))
    out = refs
    for t, name in ((first, "_a"), (second, "_b"), (third, "_c")):
        out = out.join(one(t, name).hint("merge"), ["doc_id", "num"], "left")
    origin = F.when(F.col("_a").isNotNull(), "xref").when(F.col("_b").isNotNull(), "scan").when(F.col("_c").isNotNull(), "embedded")
    return out.withColumns({"value": F.coalesce("_a", "_b", "_c"), "origin": origin}).drop("_a", "_b", "_c")


def route_fallback(files: DataFrame, engine: DataFrame, fallback: DataFrame) -> DataFrame:
    """doc_id, route, result, status, reason: the engine's result, else the fallback parser's, else none.

    files: doc_id, ext, route; engine: doc_id, result, error; fallback: doc_id, result. Of comics only cbz and cbt have a
    fallback. What failed keeps the engine's error.
    """
    e = engine.select("doc_id", F.col("result").alias("_e"), F.col("error").alias("_err"))
    f = fallback.select("doc_id", F.col("result").alias("_f"))
    allowed = (F.col("route") != "comic") | F.col("ext").isin("cbz", "cbt")
    out = files.join(e.hint("merge"), "doc_id", "left").join(f.hint("merge"), "doc_id", "left").withColumn("_f", F.when(allowed, F.col("_f")))
    status = F.when(F.col("_e").isNotNull(), "engine").when(F.col("_f").isNotNull(), "fallback").otherwise("failed")
    return out.select("doc_id", "route", F.coalesce("_e", "_f").alias("result"), status.alias("status"), F.when(F.col("_e").isNull(), F.coalesce("_err", F.lit("no result"))).alias("reason"))
