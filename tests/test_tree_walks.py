"""Page and name trees against a recursion over every path, with shared nodes, cycles and several roots."""

import random

from foliolake.operators import trees as T

PAGES = "doc_id long, node string, parent string, ord int, type string, resources string, rotate int"
NAMES = "doc_id long, node string, parent string, ord int, name string, page_ref int"


def paths(rows, inner, depth, simple=True):
    """(path, row, rows above) of every path from the roots."""
    kids: dict = {}
    for r in rows:
        kids.setdefault(r[2], []).append(r)
    out, todo = [], [((r[3],), [r]) for r in kids.get(None, [])]
    while todo:
        path, chain = todo.pop()
        out.append((path, chain))
        if len(path) < depth and inner(chain[-1], kids):
            todo += [((*path, k[3]), [*chain, k]) for k in kids.get(chain[-1][1], []) if not simple or k[1] not in [c[1] for c in chain]]
    return out


def some_tree(r, doc, kind):
    n = r.randrange(1, 12)
    place = iter(r.sample(range(1000), 100))
    value = {k: (kind(r, k), r.choice([None, f"R{k}"]), r.choice([None, k])) for k in range(n)}
    rows = [(doc, "n0", None, next(place), *value[0])]
    for k in range(1, n):
        for _ in range(r.choice([1, 1, 1, 2, 3])):
            rows.append((doc, f"n{k}", f"n{r.randrange(0, k)}", next(place), *value[k]))
    if doc % 4 == 1:  # cycles
        k = r.randrange(n)
        rows.append((doc, "n0", f"n{k}", next(place), *value[0]))
    if doc % 4 == 2:
        rows.append((doc, "n9x", None, next(place), *value[0]))
        rows.append((doc, "n0", "nowhere", next(place), *value[0]))
    return rows


def test_page_trees(spark):
    r, rows, want = random.Random(11), [], {}
    for doc in range(80):
        own = some_tree(r, doc, lambda r, k: r.choice(["Pages"] * 6 + ["Page", "Page", "Other", None]))
        rows += own
        first: dict = {}
        inner = lambda x, kids: x[4] == "Pages" or x[4] not in ("Page", None) and x[1] in kids
        parents = {x[2] for x in own}
        for path, chain in sorted(paths(own, inner, 6), key=lambda p: p[0]):
            x = chain[-1]
            if (x[4] == "Page" or x[4] == "Other" and x[1] not in parents) and x[1] not in first:
                up = [next((c[i] for c in reversed(chain) if c[i] is not None), None) for i in (5, 6)]
                first[x[1]] = (len(first), *up)
        want[doc] = first
    got: dict = {}
    r.shuffle(rows)
    for x in T.flatten_page_tree(spark.createDataFrame(rows, PAGES).repartition(5), 6).collect():
        got.setdefault(x.doc_id, {})[x.node] = (x.page_no, x.resources, x.rotate)
    assert got == {d: w for d, w in want.items() if w} and sum(map(len, want.values())) > 50


def test_name_trees(spark):
    r, rows, want = random.Random(12), [], {}
    for doc in range(60):
        own = [(*x[:4], x[4], None if x[4] is None else x[3]) for x in some_tree(r, doc, lambda r, k: r.choice([None, None, "a", "/a", "b", "c"]))]
        rows += own
        for path, chain in sorted(paths(own, lambda x, kids: True, 5), key=lambda p: p[0], reverse=True):
            if chain[-1][4] is not None:
                want[doc, chain[-1][4].lstrip("/")] = (chain[-1][5], list(path))
    got = {(x.doc_id, x.name): (x.page_ref, x.path) for x in T.flatten_name_tree(spark.createDataFrame(rows, NAMES).repartition(5), 5).collect()}
    assert got == want


def test_deep_chain_and_wide_node(spark):
    deep = [(1, f"d{k}", f"d{k - 1}" if k else None, 0, "Pages", None, None) for k in range(70)] + [(1, f"p{k}", f"d{k}", 1, "Page", None, None) for k in range(70)]
    wide = [(2, "r", None, 0, "Pages", "R", None)] + [(2, f"p{k}", "r", k, "Page", None, None) for k in range(5000)]
    got = T.flatten_page_tree(spark.createDataFrame(deep + wide, PAGES)).collect()
    assert sorted((x.page_no, x.node) for x in got if x.doc_id == 1) == sorted((62 - k, f"p{k}") for k in range(63))  # p62 is on level 64
    assert sorted((x.page_no, x.node, x.resources) for x in got if x.doc_id == 2) == sorted((k, f"p{k}", "R") for k in range(5000))


def test_one_exchange(spark):
    for made in (T.flatten_page_tree(spark.createDataFrame([], PAGES)),):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
        assert made.collect() == []
