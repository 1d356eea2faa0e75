"""Connected components of links that don't fit one machine: alternating large and small stars.

Every round rewires each link to the smallest node that one of its ends knows, by one aggregation and one join for
each star; a node with very many links is pre-aggregated and met through a join that adaptive execution may split. Each
round is written to the shared folder, so that neither the plan nor what a lost executor must repeat grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm.common import drop, stored

#: Rounds needed grow with the logarithm of the longest chain; this many would do for any graph that can be stored. A
#: graph that isn't done by then is an error.
MOST_ROUNDS = 100


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    sym = _both(e)
    least = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return sym.join(least.hint("merge"), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. e: links from larger to smaller."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of one orderable type to (node, root): root is the smallest node that can be reached.

    Loops, repeated links, links in either order and nulls are allowed (a link with a null is no link); nodes without
    a link to another node are not in the result.
    """
    pair = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(pair, "links")
    mark = _mark(now)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        last, now = now, stored(_small_star(_large_star(now)), "links")
        drop(last)
        before, mark = mark, _mark(now)
        if mark == before and _stars(now):
            break
    else:
        raise RuntimeError(f"components have not settled after {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _stars(e: DataFrame) -> bool:
    """True where no root is itself linked to a smaller node: the rewiring has ended."""
    return e.select("b").distinct().join(e.select(F.col("a").alias("b")).hint("merge"), "b", "left_semi").isEmpty()
