"""Queries of trees, lookups and generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.operators import trees as T
from foliolake.plans import views as V
from foliolake.plans.q_sources import TRAILERS, trailers
from foliolake.plans.registry import query, table

#: Every path of the walk that meets no node twice.
TREE = f"""WITH RECURSIVE {V.PAGE_NODES}, walk AS (SELECT doc_id, node, type, resources, media_box, rotate, [ord] AS path, [node] AS seen FROM page_nodes_v WHERE parent IS NULL
UNION ALL SELECT k.doc_id, k.node, k.type, coalesce(k.resources, w.resources), coalesce(k.media_box, w.media_box), coalesce(k.rotate, w.rotate), list_append(w.path, k.ord), list_append(w.seen, k.node)
FROM walk w JOIN page_nodes_v k ON k.parent = w.node AND k.doc_id = w.doc_id WHERE NOT list_contains(w.seen, k.node)),
first_v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, node ORDER BY path) AS r FROM walk WHERE type = 'Page') WHERE r = 1)"""


@query(f"{TREE} SELECT doc_id, node, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS INTEGER) AS page_no, resources, media_box, rotate FROM first_v")
def h1_flatten_page_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as pages of books."""
    return T.flatten_page_tree(V.page_nodes(spark, sf))


@query(
    """WITH b AS (SELECT *, c_nationkey + 25 * (c_custkey // 10000) AS doc_id FROM customer), p AS (SELECT doc_id, c_custkey AS num, row_number() OVER (PARTITION BY doc_id ORDER BY c_custkey) - 1 AS page_no FROM b WHERE doc_id % 3 = 0),
o AS (SELECT doc_id, c_custkey AS num, row_number() OVER (PARTITION BY doc_id ORDER BY c_custkey) - 1 AS page_no FROM b WHERE c_custkey % 2 = 0 AND doc_id % 3 <> 0 AND doc_id % 2 = 1)
SELECT doc_id, num, CAST(page_no AS INTEGER) AS page_no FROM (SELECT * FROM p UNION ALL SELECT * FROM o)"""
)
def h2_page_tree_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Books of which two of three have no page tree, and every second one was scanned."""
    books = table(spark, sf, "customer").withColumn("doc_id", F.expr(V.BOOK))
    objects = books.selectExpr("doc_id", "c_custkey num", "IF(c_custkey % 2 = 0, 'Page', 'Font') type")
    return T.page_tree_fallback(_pages(spark, sf).where("doc_id % 3 = 0"), objects, books.select("doc_id").where("doc_id % 2 = 1").distinct())


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    books = table(spark, sf, "customer").withColumn("doc_id", F.expr(V.BOOK))
    return books.selectExpr("doc_id", "c_custkey num", "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c_custkey) - 1 AS INT) page_no")


PAGES = "pages_v AS (SELECT doc_id, c_custkey AS num, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY c_custkey) - 1 AS INTEGER) AS page_no FROM (SELECT *, c_nationkey + 25 * (c_custkey // 10000) AS doc_id FROM customer))"


@query(
    f"WITH {V.OUTLINE} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS INTEGER) AS seq, title, page_no, CASE WHEN r % 3 = 0 THEN 1 ELSE 2 END AS depth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS r FROM outline_v) WHERE (r % 5) <> 4 AND title <> ''"
)
def h3_flatten_outline(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as linked nodes: every third is at the top, the two after it below; every fifth has no page."""
    o = V.outline(spark, sf).selectExpr("doc_id", "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS INT) num", "count(*) OVER (PARTITION BY doc_id) n", "title", "IF((row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1) % 5 = 4, NULL, page_no) page_no")
    nodes = o.selectExpr("doc_id", "num", "IF(num % 3 = 0 AND num + 1 < n, num + 1, NULL) first", "IF(num % 3 = 0, IF(num + 3 < n, num + 3, NULL), IF(num % 3 = 1 AND num + 1 < n, num + 1, NULL)) next", "title", "page_no")
    return T.flatten_outline(nodes, nodes.select("doc_id").distinct().withColumn("first", F.lit(0)))


@query(f"{TREE} SELECT doc_id, name, min_by(page_ref, path) AS page_ref, len(min(path)) AS depth FROM (SELECT doc_id, path, 'k' || (CAST(substr(node, 2) AS INTEGER) % 70) AS name, CAST(substr(node, 2) AS INTEGER) AS page_ref FROM first_v) GROUP BY doc_id, name")
def h4_flatten_name_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The trees of customers as name trees in which names come again."""
    leaf = F.col("type") == "Page"
    num = F.expr("CAST(substr(node, 2) AS INT)")
    nodes = V.page_nodes(spark, sf).where("ord NOT IN (98, 99) OR type = 'Page'")
    nodes = nodes.select("doc_id", "node", "parent", "ord", F.when(leaf, F.concat(F.when(num % 2 == 0, "/").otherwise(""), F.lit("k"), (num % 70).cast("string"))).alias("name"), F.when(leaf, num).alias("page_ref"))
    return T.flatten_name_tree(nodes).select("doc_id", "name", "page_ref", F.size("path").cast("long").alias("depth"))


#: A name stands for a chain of as many wrappers as its customer's key says; longer ones, and some others, lead nowhere.
DESTS = """dests_v AS (SELECT c_nationkey + 25 * (c_custkey // 10000) AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'dict' ELSE 'tree' END AS origin, CASE WHEN c_custkey % 4 = 0 THEN '/' ELSE '' END || 'd' || (c_custkey // 4 % 50) AS name, CASE WHEN c_custkey % 10 < 8 AND c_custkey % 23 <> 0 THEN c_custkey END AS page_ref FROM customer),
d_v AS (SELECT doc_id, origin, name, min(page_ref) AS page_ref FROM dests_v GROUP BY ALL),
entries_v AS (SELECT o_orderkey AS entry, o_custkey % 25 + 25 * (o_custkey // 10000) AS doc_id, CASE WHEN o_orderkey % 4 <> 3 THEN 'd' || (o_orderkey % 60) END AS dest_name FROM orders),
resolved_v AS (SELECT e.*, CASE WHEN a.doc_id IS NOT NULL THEN a.page_ref WHEN b.doc_id IS NOT NULL THEN b.page_ref ELSE c.page_ref END AS page_ref FROM entries_v e LEFT JOIN d_v a ON a.doc_id = e.doc_id AND a.origin = 'dict' AND a.name = e.dest_name
LEFT JOIN d_v b ON b.doc_id = e.doc_id AND b.origin = 'dict' AND b.name = '/' || e.dest_name LEFT JOIN d_v c ON c.doc_id = e.doc_id AND c.origin = 'tree' AND c.name = e.dest_name)"""


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as outline entries that name their destinations in four ways."""
    c = table(spark, sf, "customer")
    d = c.selectExpr(f"{V.BOOK} doc_id", "IF(c_custkey % 2 = 0, 'dict', 'tree') origin", "concat(IF(c_custkey % 4 = 0, '/', ''), 'd', c_custkey DIV 4 % 50) name", "c_custkey * 100 num")
    chain = c.selectExpr(f"{V.BOOK} doc_id", "c_custkey", "explode(sequence(0, CAST(c_custkey % 10 AS INT))) j")
    last = "j = c_custkey % 10"
    objects = chain.selectExpr("doc_id", "c_custkey * 100 + j num", f"CASE WHEN NOT {last} THEN 'dict' WHEN c_custkey % 23 = 0 THEN 'number' ELSE 'array' END kind", f"IF({last}, c_custkey, NULL) page_ref", f"IF({last}, NULL, c_custkey * 100 + j + 1) inner")
    way = lambda k, name: f"IF(o_orderkey % 4 = {k}, concat('d', o_orderkey % 60), NULL) {name}"
    entries = table(spark, sf, "orders").selectExpr("o_orderkey entry", "o_custkey % 25 + 25 * (o_custkey DIV 10000) doc_id", way(0, "dest_name"), way(1, "array_name"), "CASE o_orderkey % 4 WHEN 2 THEN 'GoTo' WHEN 3 THEN 'Launch' END action", "IF(o_orderkey % 4 >= 2, concat('d', o_orderkey % 60), NULL) action_name")
    return T.resolve_named_dest(T.dest_names(entries), T.unwrap_dests(d, objects))


@query(f"WITH {DESTS} SELECT entry, doc_id, dest_name, page_ref FROM resolved_v")
def h5_resolve_named_dest(spark: SparkSession, sf: str) -> DataFrame:
    """Destinations of the entries."""
    return resolved(spark, sf).select("entry", "doc_id", "dest_name", "page_ref")


@query(
    f"""WITH {DESTS}, {PAGES}, n AS (SELECT doc_id, count(*) AS n FROM pages_v GROUP BY doc_id), e AS (SELECT *, CASE WHEN entry % 3 = 0 THEN NULL ELSE page_ref END AS ref, CASE WHEN entry % 3 = 0 THEN entry % 90 - 10 END AS num, CASE WHEN entry % 7 = 0 THEN 'URI' WHEN entry % 2 = 0 THEN 'GoTo' END AS action FROM resolved_v)
SELECT entry, e.doc_id, CAST(CASE WHEN action = 'URI' THEN NULL WHEN ref IS NOT NULL THEN p.page_no WHEN e.num IS NOT NULL AND n.n > 0 THEN greatest(0, least(e.num, n.n - 1)) END AS INTEGER) AS page_no FROM e LEFT JOIN pages_v p ON p.doc_id = e.doc_id AND p.num = e.ref LEFT JOIN n ON n.doc_id = e.doc_id"""
)
def h6_dest_to_page(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of the entries, by reference or by number; some lead elsewhere."""
    e = resolved(spark, sf).selectExpr("entry", "doc_id", "IF(entry % 3 = 0, NULL, page_ref) page_ref", "IF(entry % 3 = 0, CAST(entry % 90 - 10 AS INT), NULL) page_num", "CASE WHEN entry % 7 = 0 THEN 'URI' WHEN entry % 2 = 0 THEN 'GoTo' END action")
    return T.dest_to_page(e, _pages(spark, sf)).select("entry", "doc_id", "page_no")


@query(f"WITH {V.XREF} SELECT doc_id, num, gen_order, type, offs FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, num ORDER BY CASE WHEN type = 0 THEN 1 ELSE 0 END, gen_order, offs) AS r FROM xref_v) WHERE r = 1")
def m1_merge_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of suppliers' indices after the merge."""
    return T.merge_generations(V.xref(spark, sf))


@query(f"WITH {TRAILERS} SELECT doc_id, key, min_by(value, gen_order) AS value FROM trailers_v WHERE key NOT IN ('W', 'Index') GROUP BY doc_id, key")
def m2_merge_trailers(spark: SparkSession, sf: str) -> DataFrame:
    """Merged trailers of customers."""
    return T.merge_trailers(trailers(spark, sf))


@query(
    """WITH r AS (SELECT l_orderkey AS doc_id, l_partkey % 5 AS num, l_linenumber, l_partkey, l_suppkey, 'zz ' || (l_partkey % 5) || ' 0 obj x' AS t FROM lineitem),
p AS (SELECT doc_id, num, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_partkey, l_suppkey, num ROWS UNBOUNDED PRECEDING) - length(t) + 3 AS pos FROM r)
SELECT doc_id, num, CAST(max(pos) AS INTEGER) AS pos FROM p GROUP BY doc_id, num"""
)
def m3_scan_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as raw texts with a mark for each line; the last place of each number."""
    r = table(spark, sf, "lineitem").selectExpr("l_orderkey doc_id", "struct(l_linenumber, l_partkey, l_suppkey, l_partkey % 5 AS num, concat('zz ', l_partkey % 5, ' 0 obj x') AS t) r")
    docs = r.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["t"]), "").alias("text"))
    return T.scan_markers(docs)


@query(
    """WITH a AS (SELECT l_suppkey AS doc_id, l_partkey AS num, min_by('x' || l_orderkey, (l_orderkey, l_linenumber)) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
b AS (SELECT l_suppkey AS doc_id, l_partkey AS num, min_by('s' || l_orderkey, (l_orderkey, l_linenumber)) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
c AS (SELECT l_suppkey AS doc_id, l_partkey AS num, min_by('e' || l_orderkey, (l_orderkey, l_linenumber)) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
SELECT r.doc_id, r.num, coalesce(a.v, b.v, c.v) AS value, CASE WHEN a.v IS NOT NULL THEN 'xref' WHEN b.v IS NOT NULL THEN 'scan' WHEN c.v IS NOT NULL THEN 'embedded' END AS origin
FROM (SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS num FROM lineitem) r LEFT JOIN a USING (doc_id, num) LEFT JOIN b USING (doc_id, num) LEFT JOIN c USING (doc_id, num)"""
)
def m4_lookup_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Objects looked up in three tables by return flag."""
    side = lambda flag, mark: table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).selectExpr("l_suppkey doc_id", "l_partkey num", f"concat('{mark}', l_orderkey) value", "struct(l_orderkey, l_linenumber) seq")
    refs = table(spark, sf, "lineitem").selectExpr("l_suppkey doc_id", "l_partkey num").distinct()
    return T.lookup_chain(refs, side("R", "x"), side("A", "s"), side("N", "e"))


@query(
    f"""WITH {V.FILES}, x AS (SELECT doc_id, lower(regexp_extract(path, '[^.]*$')) AS ext FROM files_v),
r AS (SELECT *, CASE WHEN ext IN ('cbz', 'cbt', 'cbr', 'cb7') THEN 'comic' WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('zip', 'jpg') THEN 'fallback' ELSE 'text' END AS route FROM x)
SELECT doc_id, route, CASE WHEN doc_id % 5 <> 0 THEN 'e' || doc_id WHEN doc_id % 3 = 0 AND (route <> 'comic' OR ext IN ('cbz', 'cbt')) THEN 'f' || doc_id END AS result,
CASE WHEN doc_id % 5 <> 0 THEN 'engine' WHEN doc_id % 3 = 0 AND (route <> 'comic' OR ext IN ('cbz', 'cbt')) THEN 'fallback' ELSE 'failed' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'bad ' || doc_id END AS reason FROM r"""
)
def m5_route_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which the engine fails on each fifth and the fallback on two of three."""
    from foliolake.sources import files as S

    f = S.route_format(V.files(spark, sf)).withColumn("ext", S.extension(F.col("path")))
    e = V.files(spark, sf).selectExpr("doc_id", "IF(doc_id % 5 <> 0, concat('e', doc_id), NULL) result", "IF(doc_id % 5 = 0, concat('bad ', doc_id), NULL) error")
    return T.route_fallback(f, e, V.files(spark, sf).where("doc_id % 3 = 0").selectExpr("doc_id", "concat('f', doc_id) result"))
