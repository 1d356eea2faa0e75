"""Operator 4: SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits in three segments. Two fingerprints that differ in at most four bits differ in at most one bit
of some segment (three segments with two bits each would be six), so every fingerprint looks up, in each segment's
table, the values within one bit of its own, and the complete distance of what it finds is verified in the join. Beyond
``MANY`` fingerprints so many share a segment's value by chance that two segments of 32 bits, with the values within two
bits of each, are less work; both ways find all. Documents with equal fingerprints are aggregated before, so that copies cost one row, and only links between different
fingerprints are made.

Where many different fingerprints share a segment's value (``DENSE``), pairs would grow with the square of their number.
Two such fingerprints within four bits share a point within two bits of both; so each of them is sent to all 2,081 points
within two bits of it, and at each point all are linked to the smallest: as many links as rows, at most 2,081 rows a
point, and the same components. Pairs of which one end isn't in such a bucket are found through that end's table.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm.common import drop, stored
from foliolake.llm.components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Lowest bit and number of bits of each segment, and distinct fingerprints from which the second division is less work:
#: 66 lookups that each meet n / 2**21 others by chance against 1,058 that meet n / 2**32.
SEGMENTS, WIDE_SEGMENTS, MANY = ((0, 21), (21, 21), (42, 22)), ((0, 32), (32, 32)), 30_000_000
#: Distinct fingerprints of one segment value beyond which points are used instead of pairs.
DENSE = 2_000
#: Shingles whose bits are counted at once.
PART = 65_536


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text as an unsigned number. bytes.lower() and bytes.split() know ASCII only, which is the
    contract's rule."""
    from xxhash import xxh64_intdigest

    w = data.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, PART):
        h = np.array([xxh64_intdigest(b" ".join(w[i : i + shingle]), seed) for i in range(k, min(k + PART, n))], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` and fp (the fingerprint's 64 bits as a signed long) of every row; a null text has no
    words, fingerprint 0."""
    given = df.select(F.col(f"`{id_col}`").alias("doc_id"), *(F.col(f"`{c}`") for c in keep), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("data"))
    names = ["doc_id", *keep]

    def run(it):
        for batch in it:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(len(names))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(fps)], [*names, "fp"])

    return given.mapInArrow(run, ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in names) + ", fp bigint")


def _ball(bits: int, radius: int) -> list[int]:
    """What turns a signed segment value of so many bits into each of those within so many bits of it."""
    flips = [1 << b if b < bits - 1 else -(1 << b) for b in range(bits)]
    return [reduce(xor, c, 0) for r in range(radius + 1) for c in combinations(flips, r)]


def links(fps: DataFrame, dense: int = DENSE, segments: tuple[tuple[int, int], ...] = SEGMENTS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``DISTANCE`` bits, as a stored table. fps: one column fp,
    distinct."""
    key = [F.shiftright(F.shiftleft("fp", 64 - lo - n), 64 - n) for lo, n in segments]  # signed, which is as good
    homes = fps.select("fp", F.posexplode(F.array(*key)).alias("seg", "value"))
    full = stored(homes.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > dense), "full-buckets")
    any_full = not full.isEmpty()
    if any_full:
        homes = homes.join(full.select("seg", "value", F.lit(True).alias("full")).hint("merge"), ["seg", "value"], "left").withColumn("full", F.coalesce("full", F.lit(False)))
        homes = stored(homes, "buckets")
    else:
        homes = homes.withColumn("full", F.lit(False))
    # What a fingerprint looks up: in each segment, its own value and those with so few bits changed.
    flips = [F.lit(_ball(n, DISTANCE // len(segments))).cast("array<bigint>") for _, n in segments]
    near = homes.select("fp", "seg", "full", F.explode(F.transform(F.element_at(F.array(*flips), F.col("seg") + 1), lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    left = near.select("seg", "value", F.col("fp").alias("a"), F.col("full").alias("a_full"))
    right = homes.where(~F.col("full")).select("seg", "value", F.col("fp").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = left.join(right.hint("merge"), ["seg", "value"]).where((apart <= DISTANCE) & (F.col("a_full") & (F.col("a") != F.col("b")) | (F.col("b") < F.col("a")))).select("a", "b")
    if any_full:
        masks = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
        signed = np.array(masks, np.uint64).view(np.int64).tolist()
        crowd = homes.where("full").select("fp").distinct()
        points = crowd.select("fp", F.explode(F.transform(F.lit(signed), lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
        least = points.groupBy("point").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").select("point", "least")
        found = found.unionByName(points.join(least.hint("merge"), "point").where("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b")))
    out = stored(found.distinct(), "near")
    drop(full, *([homes] if any_full else []))
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE, keep: tuple[str, ...] = (), many: int = MANY) -> DataFrame:
    """One row for each row of ``df``: doc_id, the columns ``keep``, fp, component_id, the smallest doc_id that links reach,
    and root, the component's own fingerprint, which no other component has (component_id may be, where ids repeat or
    are null).

    Null and empty texts and texts without words share fingerprint 0, linked like any other. Repeated rows share a
    component. Null ids are never the smallest; a component of null ids alone has a null id. An empty table gives an
    empty table. Only the two named columns and ``keep`` are read.
    """
    docs = stored(fingerprints(df, id_col, text_col, keep), "fingerprints")
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    near = links(nodes.select("fp"), dense, WIDE_SEGMENTS if nodes.count() > many else SEGMENTS)
    roots = components(near).select(F.col("node").alias("fp"), "root")
    placed = nodes.join(roots.hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "fingerprint-roots")
    drop(nodes, near)
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids.hint("merge"), "root").select("fp", "component_id", "root")
    return docs.join(named.hint("merge"), "fp").select("doc_id", *keep, "fp", "component_id", "root")
