"""Outlines against a walk node by node."""

import random

from foliolake.operators import trees as T

SCHEMA = "doc_id long, num int, first int, next int, title string, page_no int"


def plain(nodes, root, depth=3):
    by = {r[1]: r for r in nodes}
    out, seen, todo = [], set(), [(root, 1)]
    while todo:
        num, level = todo.pop()
        if num is None or num in seen or num not in by or level > depth:
            continue
        seen.add(num)
        _, _, first, nxt, title, page = by[num]
        if title and page is not None:
            out.append((len(out), title, page, level))
        todo += [(nxt, level), (first, level + 1)]
    return out


def tree(r, doc, n):
    """A random outline in which each node hangs in one place; some nodes hang nowhere."""
    nums = r.sample(range(1000), n)
    first, nxt = dict.fromkeys(nums), dict.fromkeys(nums)
    for k, num in enumerate(nums[1:], 1):
        if r.random() < 0.1:
            continue
        for _ in range(20):
            at = r.choice(nums[:k])
            links = first if r.random() < 0.4 else nxt
            if links[at] is None:
                links[at] = num
                break
    return [(doc, x, first[x], nxt[x], r.choice(["", None, f"t{x}", f"t{x}", f"t{x}"]), r.choice([None, 3, 4, 5])) for x in nums], nums[0]


def test_against_a_walk(spark):
    r, rows, roots, want = random.Random(6), [], [], {}
    for doc in range(120):
        nodes, root = tree(r, doc, r.randrange(1, 40))
        if doc % 3 == 2:  # broken ones: cycles, shared nodes, pointers to nowhere and to oneself
            for _ in range(r.randrange(1, 5)):
                k = r.randrange(len(nodes))
                d, num, first, nxt, title, page = nodes[k]
                other = r.choice([num, 5000, *(x[1] for x in nodes)])
                nodes[k] = (d, num, other, nxt, title, page) if r.random() < 0.5 else (d, num, first, other, title, page)
        if doc % 20 == 7:
            root = r.choice([None, 7777])
        rows += nodes
        roots.append((doc, root))
        want[doc] = plain(nodes, root)
    r.shuffle(rows)
    got: dict = {}
    for x in T.flatten_outline(spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(roots, "doc_id long, first int")).collect():
        got.setdefault(x.doc_id, []).append((x.seq, x.title, x.page_no, x.depth))
    for doc, w in want.items():
        assert sorted(got.get(doc, [])) == w, doc


def test_a_hundred_thousand_siblings(spark):
    n = 100_000
    nodes = spark.range(n).selectExpr("1L doc_id", f"int((id * 77773) % {n}) num", "int(NULL) first", f"IF(id + 1 < {n}, int(((id + 1) * 77773) % {n}), NULL) next", "concat('t', id) title", "int(id) page_no")
    out = T.flatten_outline(nodes, spark.createDataFrame([(1, 0)], "doc_id long, first int"))
    assert out.where("seq = page_no AND depth = 1 AND title = concat('t', seq)").count() == n == out.count()


def test_empty_and_without_root(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.flatten_outline(none, spark.createDataFrame([(1, 1)], "doc_id long, first int")).collect() == []
    assert T.flatten_outline(spark.createDataFrame([(1, 1, None, None, "a", 1)], SCHEMA), spark.createDataFrame([], "doc_id long, first int")).collect() == []
