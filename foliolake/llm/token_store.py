"""Operator 6: token ids in a binary format of bit- or byte-planes, written and read back.

A *frame* holds the ids of some whole documents in order. Its ids are cut into blocks of a fixed number; each block is
transposed into planes (plane k holds byte k, or bit k, of every id), each plane is compressed with zstandard, and the
frame's head holds the index of all planes. Frames lie in Parquet files, written by Spark's own committer, one row a
frame, with the documents' keys and token counts beside them, so that a lost executor leaves no partial file and any
store that Spark can write will do. Rows are dealt by ranges of the key, and what Spark can't know before, the number
of ids before each part, is the running sum over the parts' totals: one row a part.

Frame layout, little-endian: ``BPS1``; u8 1 for bytes or 2 for bits; u8 number of planes; u16 zero; u32 block size in
ids; u64 ids; then for each block and plane u32 compressed length; then the compressed planes.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliolake.llm.bpe_codec import list_array
from foliolake.llm.pretokens import Encoder, mapped_text, packed

VOCABULARY = "byte_bpe_50k.json"
MAGIC = b"BPS1"
HEAD = struct.Struct("<4sBBHIQ")
BLOCK = 65_536
#: A frame is closed when it has so many ids; one longer document has a frame alone.
FRAME_IDS = 524_288
LEVEL = 3
SCHEMA = "part int, before bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, frame binary"


def pack(ids: np.ndarray, block: int = BLOCK, bits: bool = False, level: int = LEVEL) -> bytes:
    """One frame. Planes that are zero in every id are left out."""
    import zstandard

    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()).bit_length() if len(ids) else 0
    n = top if bits else -(-top // 8)
    z, sizes, planes = zstandard.ZstdCompressor(level=level), [], []
    for k in range(0, len(ids), block):
        part = ids[k : k + block]
        for p in range(n):
            plane = np.packbits((part >> p & 1).astype(np.uint8)) if bits else (part >> 8 * p & 255).astype(np.uint8)
            planes.append(z.compress(plane.tobytes()))
            sizes.append(len(planes[-1]))
    return HEAD.pack(MAGIC, 2 if bits else 1, n, 0, block, len(ids)) + np.array(sizes, "<u4").tobytes() + b"".join(planes)


def unpack(frame: bytes) -> np.ndarray:
    """The ids of one frame, as unsigned 32-bit integers."""
    import zstandard

    magic, kind, n, _, block, count = HEAD.unpack_from(frame)
    if magic != MAGIC:
        raise ValueError("not a frame of token ids")
    blocks = -(-count // block)
    sizes = np.frombuffer(frame, "<u4", blocks * n, HEAD.size).tolist()
    at, z, out = HEAD.size + 4 * len(sizes), zstandard.ZstdDecompressor(), np.zeros(count, "<u4")
    for b in range(blocks):
        part = out[b * block : (b + 1) * block]
        for p in range(n):
            size = sizes[b * n + p]
            plane = np.frombuffer(z.decompress(frame[at : at + size], max_output_size=4 * block), np.uint8)
            at += size
            part |= (np.unpackbits(plane, count=len(part)) if kind == 2 else plane).astype("<u4") << np.uint32(p if kind == 2 else 8 * p)
    return out


@functools.lru_cache(2)
def _encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """Ids of a text as the library's encode without special tokens gives them: the file's added tokens are found in the
    text first, and what stands between them is cut by the pattern."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize = tokenizer.model.tokenize  # the BPE itself: the texts are cut by the pattern before

    def encode(tokens: list[str]) -> bytes:
        return packed([t.id for p in tokens for t in tokenize(mapped_text(p))])

    plain = Encoder(regex.compile(pattern).findall, encode)
    added = {t.content: (packed([i]), t) for i, t in tokenizer.get_added_tokens_decoder().items()}
    if not added:
        return plain
    if any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()):  # they take more than their own characters
        found = regex.compile("|".join(map(regex.escape, added)))
        return lambda text: packed(tokenizer.encode(text, add_special_tokens=False).ids) if found.search(text) else plain(text)
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")

    def coder(text: str) -> bytes:
        first, *more = cut.split(text)
        return plain(first) + b"".join(added[p][0] if k % 2 == 0 else plain(p) for k, p in enumerate(more)) if more else plain(first)

    return coder


def write_ids(df: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None,
              pattern: str | None = None, partitions: int | None = None, block: int = BLOCK, bits: bool = False) -> None:
    """Encodes every text (a literal added token of the vocabulary file, such as <|endoftext|>, is its id), appends ``end_id`` to each document and writes the frames below ``out`` in ascending order of
    ``id_col``: folder ``frames`` with one row a frame: part, ids of the part before it, ids in it, its documents' keys and
    token counts, and the frame. part and the frames in it ascend with the key.

    A null text counts as empty: its document has the end id alone. Null keys come first; rows of the same key stay
    separate documents in the order of their texts. An empty table writes no frame.
    """
    path, pattern = path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN
    given = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = given.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, end = _encoder(path, pattern), TaskContext.get().partitionId(), np.array([end_id], "<i4").tobytes()
        keys: list = []
        held: list[bytes] = []
        ids, before = 0, 0

        def frame() -> pa.RecordBatch:
            counts = [len(x) // 4 for x in held]
            made = pack(np.frombuffer(b"".join(held), "<u4"), block, bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before]), pa.array([sum(counts)]), pa.array([keys], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([made], pa.binary())],
                ["part", "before", "n_ids", "doc_ids", "counts", "frame"])

        for batch in it:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = coder(text) + end
                if held and ids + len(made) // 4 > FRAME_IDS:
                    yield frame()
                    keys, held, ids, before = [], [], 0, before + ids
                keys.append(key)
                held.append(made)
                ids += len(made) // 4
        if held:
            yield frame()

    dealt.mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(f"{out}/frames")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """One row a document, from the frames: doc_id, start (ids of all documents before it), n_tokens, ids array<int>."""
    frames = spark.read.schema(SCHEMA).parquet(f"{out}/frames")
    total = frames.groupBy("part").agg(F.sum(F.col("n_ids")).alias("n"))  # one row a part, of two narrow columns
    parts = total.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in range(batch.num_rows):
                part, before, keys, counts, frame = (batch.column(c)[row].as_py() for c in ("part", "before", "doc_ids", "counts", "frame"))
                data, counts = unpack(frame), np.array(counts)
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(before + ends - counts), pa.array(counts),
                     list_array([data[e - c : e].tobytes() for c, e in zip(counts.tolist(), ends.tolist(), strict=True)])],
                    ["part", "doc_id", "in_part", "n_tokens", "ids"])

    docs = frames.select("part", "before", "doc_ids", "counts", "frame").mapInArrow(run, "part int, doc_id bigint, in_part bigint, n_tokens bigint, ids array<int>")
    # A part is a task of the writer: their number is the partition count that write_ids was given, so this side is small.
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("before_part") + F.col("in_part")).alias("start"), "n_tokens", "ids")


def ids_crc32(ids: str) -> Column:
    """Unsigned crc32 of a column of ids as little-endian unsigned 32-bit integers."""

    def crc32(lists: pa.Array) -> pa.Array:
        data, ends = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy().tolist()
        return pa.array([zlib.crc32(data[i:j]) for i, j in zip(ends, ends[1:])], pa.int64())

    return F.arrow_udf(crc32, "bigint")(ids)
