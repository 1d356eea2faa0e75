"""Operator 12: vectors compressed to the indexes of their parts' nearest codebook entries.

Components become integers, so that all sums and distances are exact. A codebook for each part position is fitted over
all rows: every task assigns its rows' parts and adds up each entry's parts, and one row a task and entry is shuffled.

Assignment goes through a grid. A part lies in a coarse cell, a box with a fixed width in every dimension. Over a box each
entry has a smallest and a largest distance; an entry whose smallest is beyond another's largest is dominated: nowhere in
the box is it the nearest. The entries that are left are kept in a memo of bounded size under the cell's coordinates, and
only those are evaluated exactly for every part in the cell; of equals the lowest index counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm.common import drop, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Width of a cell in each dimension, in integer units.
CELL = 32
#: Cells that a task's memo holds for each part position.
MEMO = 50_000
#: Vectors that are evaluated at once.
ROWS = 1024
#: The largest component; beyond it a squared distance might not fit in 64 bits.
LARGEST = 1 << 17
#: Labels up to which their sums are broadcast (two numbers each).
FEW_LABELS = 100_000


class Grid:
    """Nearest entries of one codebook (entries × width, integers) through cells."""

    def __init__(self, book: np.ndarray, cell: int = CELL, memo: int = MEMO):
        self.book, self.cell, self.size, self.memo = book, cell, memo, {}
        #: How many cells were evaluated, and how many parts and entries exactly, for tests and figures.
        self.cells = self.exact = 0

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """Of each cell the entries that no other dominates, ascending."""
        low = (cells * self.cell).astype(self.book.dtype)
        high = low + (self.cell - 1)
        out = []
        for k in range(0, len(cells), 128):
            under, over = low[k : k + 128, None] - self.book, self.book - high[k : k + 128, None]
            least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(2)
            most = (np.maximum(-under, -over) ** 2).sum(2)
            out += [np.flatnonzero(x) for x in least <= most.min(1, keepdims=True)]
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every part and the squared distance."""
        cells = np.ascontiguousarray(np.floor_divide(parts, self.cell).astype(np.int32))
        step, data = cells.shape[1] * 4, cells.tobytes()
        keys = [data[k : k + step] for k in range(0, len(data), step)] if step else [b""] * len(parts)
        if len(self.memo) >= self.size:
            self.memo.clear()
        new = {k: i for i, k in enumerate(keys) if k not in self.memo}
        self.memo.update(zip(new, self._candidates(cells[list(new.values())]), strict=True))
        found = list(map(self.memo.__getitem__, keys))
        sizes = np.array([len(f) for f in found])
        which, row = np.concatenate(found), np.repeat(np.arange(len(parts)), sizes)
        distance = ((parts[row] - self.book[which]) ** 2).sum(1)
        self.cells, self.exact = self.cells + len(new), self.exact + len(which)
        starts = np.cumsum(sizes) - sizes
        best = np.minimum.reduceat(distance, starts)
        at = np.flatnonzero(distance == best[row])
        first = at[np.unique(row[at], return_index=True)[1]]
        return which[first], best


def _blocks(batch: pa.RecordBatch, column: str, width: int, kind: type) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows of a batch with their integer vectors as a matrix."""
    for k in range(0, batch.num_rows, ROWS):
        part = batch.slice(k, ROWS)
        yield part, part.column(column).flatten().to_numpy().reshape(-1, width).astype(kind)


def _fit(vectors: DataFrame, books: np.ndarray, kind: type, cell: int) -> np.ndarray:
    """The codebooks (parts × entries × width) after one round. At most parts × entries rows come to the driver."""
    n_parts, n_entries, width = books.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b.astype(kind), cell) for b in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in it:
            for _, x in _blocks(batch, "q", n_parts * width, kind):
                for p, grid in enumerate(grids):
                    own = x[:, p * width : (p + 1) * width]
                    which = grid.nearest(own)[0]
                    np.add.at(total[p], which, own.astype(np.int64))
                    count[p] += np.bincount(which, minlength=n_entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    sums = vectors.select("q").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width))).collect()
    out = books.copy()
    for r in found:
        out[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def _encoded(vectors: DataFrame, books: np.ndarray, kind: type, cell: int) -> DataFrame:
    """vec_id, label, code, error."""
    n_parts, _, width = books.shape
    types = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b.astype(kind), cell) for b in books]
        for batch in it:
            for part, x in _blocks(batch, "q", n_parts * width, kind):
                near = [g.nearest(x[:, p * width : (p + 1) * width]) for p, g in enumerate(grids)]
                codes = np.stack([w for w, _ in near], 1).astype(np.uint8)
                error = sum(d.astype(np.int64) for _, d in near)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "q").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint")


def _with_label_error(codes: DataFrame, few: int) -> DataFrame:
    """Adds label_error. Sums by label are made with partial aggregation; if there are few, they go to the rows, else both
    meet in a merge join, whose large partitions may be split."""
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    side = sums.withColumnRenamed("label", "_label").hint("broadcast" if sums.count() <= few else "merge")
    return codes.join(side, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def books_text(books: np.ndarray) -> str:
    """All entries' integers by part, entry and position."""
    return ",".join(map(str, books.ravel().tolist()))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             cell: int = CELL, few: int = FEW_LABELS) -> tuple[DataFrame, np.ndarray]:
    """The codes of all vectors and the codebooks: a table vec_id, label, code (two hex digits a part), error (squared
    distances in integer units), label_error (the errors of equal labels, nulls together), and parts × entries × width
    integers.

    Rows whose vector is null or holds a null or a number that isn't finite are dropped. A codebook begins with the parts
    of the rows with the smallest ids; of equal ids the smaller vector comes first, rows without an id come last, and with
    fewer rows there are fewer entries. Repeated rows each have a row and each count. Vectors of another length than most
    (of equally frequent lengths, than the longest) take no part: their code and error are null. An empty table gives an
    empty table and codebooks without entries. Columns beyond the three that are named are dropped, whatever their names.
    An error if the length isn't a multiple of ``parts``, if there are more than 256 entries, or if a component is
    beyond ``LARGEST``, whose squared distance might not fit in 64 bits. What goes to the driver and back is the
    codebooks: parts × entries × width numbers.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits: 1 to 256 entries")
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.when(F.abs(x) > LARGEST, F.raise_error(F.lit(f"a component beyond {LARGEST}")).cast("bigint")).otherwise(F.floor(x * SCALE)))
    given = df.where(v.isNotNull() & finite).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), whole.alias("q"))
    kept = stored(given.withColumns({"size": F.size("q"), "top": F.coalesce(F.array_max(F.transform("q", F.abs)), F.lit(0))}), "vectors")
    sizes = kept.groupBy("size").agg(F.count("*").alias("n"), F.max("top").alias("top")).orderBy(F.desc("n"), F.desc("size")).limit(2).collect()
    size, top = (sizes[0]["size"], sizes[0]["top"]) if sizes else (0, 0)
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    width, vectors = size // parts, kept.where(F.col("size") == size)
    # Doubles are exact and faster as long as every sum of squares is below 2**53.
    kind = np.float64 if max(width, 1) * (2 * (top + cell)) ** 2 < 1 << 53 else np.int64
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()
    books = np.array([r.q for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds if first else 0):
        books = _fit(vectors, books, kind, cell)
    others = kept.where(F.col("size") != size).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    codes = _encoded(vectors, books, kind, cell).unionByName(others) if len(sizes) > 1 else _encoded(vectors, books, kind, cell)
    codes = stored(codes, "codes")
    drop(kept)
    return _with_label_error(codes, few), books


def books_sha256(books: np.ndarray) -> str:
    """Digest of the codebooks' integers."""
    return hashlib.sha256(books_text(books).encode()).hexdigest()
