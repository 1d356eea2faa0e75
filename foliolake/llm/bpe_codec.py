"""Operator 5: byte-level BPE encoding and decoding through a sentencepiece model.

A rank file is serialised as a sentencepiece BPE model without training: each token's bytes become one character per
byte, its score is its negative rank, and normalisation is the identity. Sentencepiece merges the adjacent pair with the
highest score first and the leftmost among equals, which is the order of the ranks. Texts are cut by the public pattern
first; a pre-token that is itself in the vocabulary is that token, as in rank-based encoders. Decoding looks each id's
bytes up and concatenates them.

Nothing is shuffled: both directions are ``mapInArrow`` over the rows where they lie, a few MB of text at a time.
"""

from __future__ import annotations

import base64
import functools
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliolake.llm.pretokens import Encoder, mapped, packed

RANKS = "byte_bpe_50k.tiktoken"
#: Text that one Arrow batch from Python holds at most, but for a single longer one.
BATCH_CHARS = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, f))}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model file with the tokens in rank order, and after them the piece for the unknown."""
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in order] != list(range(len(order))):
        raise ValueError("ranks must be 0, 1, 2, ...: ids are places in the model")

    def piece(text: str, score: float, kind: int) -> bytes:
        return _message(1, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    body = b"".join(piece(mapped(t), -float(ranks[t]), 1) for t in order) + piece("<unk>", 0.0, 2)
    trainer = _number(3, 2) + _number(4, len(order) + 1) + _number(40, len(order))
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return body + _message(2, trainer) + _message(3, normaliser)


@functools.lru_cache(2)
def _encoder(path: str, pattern: str) -> Encoder:
    import regex
    import sentencepiece

    ranks = read_ranks(path)
    model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))

    ids_of = model.encode

    def encode(tokens: list[str]) -> bytes:
        ids: list[int] = []
        for data in map(str.encode, tokens):
            whole = ranks.get(data)
            ids += ids_of(mapped(data)) if whole is None else (whole,)
        return packed(ids)

    return Encoder(regex.compile(pattern).findall, encode)


@functools.lru_cache(2)
def _pieces(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    return sorted(ranks, key=ranks.__getitem__)


def list_array(parts: list[bytes]) -> pa.Array:
    """An Arrow list<int32> from one byte string of little-endian integers a row."""
    ends = np.cumsum([0, *(len(p) // 4 for p in parts)]).astype("<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def chunks(batch: pa.RecordBatch, column: str, size: int):
    """Parts of a batch whose column has about ``size`` characters or bytes each, one row at least."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    start, n = 0, 0
    for i, k in enumerate(lengths.tolist()):
        if i > start and n + k > size:
            yield batch.slice(start, i - start)
            start, n = i, 0
        n += k
    if start < len(lengths):
        yield batch.slice(start)


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Replaces a text column by ``ids_col`` array<int>; every other column stays as it is.

    A null text counts as empty and gives an empty list. Rows are independent, so repeated rows, ties and null keys need
    no rule, and an empty table gives an empty table. A column named ``ids_col`` that is there already is replaced.
    path: the rank file, at the same place on every executor.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    kept = [c for c in df.columns if c not in (text_col, ids_col)]
    given = df.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text_col))
    schema = T.StructType([*(given.schema[c] for c in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(it):
        coder = _encoder(path, pattern)
        for batch in it:
            for part in chunks(batch, text_col, BATCH_CHARS):
                ids = list_array([coder(t) for t in part.column(text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), ids], [*kept, ids_col])

    return given.mapInArrow(run, schema)


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds ``out_col`` binary: the bytes of the tokens in ``ids_col``, concatenated (UTF-8 if a text was encoded).

    A null list gives null. An id outside the vocabulary is an error.
    """
    path = path or public_tokenizers.path(RANKS)
    kept = [c for c in df.columns if c != out_col]
    given = df.select(*(F.col(f"`{c}`") for c in kept))
    schema = T.StructType([*given.schema.fields, T.StructField(out_col, T.BinaryType(), True)])

    def run(it):
        piece = _pieces(path).__getitem__
        for batch in it:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                column = part.column(ids_col)
                ids, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
                held = column.is_valid().to_pylist()
                data = pa.array([b"".join(map(piece, ids[i:j].tolist())) if ok else None for i, j, ok in zip(ends, ends[1:], held)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), data], [*kept, out_col])

    return given.mapInArrow(run, schema)
