"""Operator 11: alignment of two tokenizers' ids over the same texts.

Each text is tokenised as a whole by both vocabularies: A, a byte-level BPE, encodes a blank and the text, and B, a
sentencepiece BPE, the text, to which it adds the blank. Where a space-marked token of A and one of B start at the same
byte, the tokens before them end together: such verified places cut a document's ids into windows, mostly of one word.
A window's alignment depends on its ids alone, so it is looked up by the tuple of A's and B's ids in a memo of bounded
size, and only windows that aren't in it are aligned token by token.

Of two tokens that end together, the bytes of one are the end of the other's. So the id pairs that any corpus can link
are known from the two vocabularies (some hundred thousand), and so is the bound of the table of their counts: the
executors add up counts by pair, the driver gets one number a pair, and sends them back for the scores.

No text is shuffled: texts become rows of ids where they lie, which are written once, counted, and scored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm.bpe_codec import chunks, list_array
from foliolake.llm.common import stored
from foliolake.llm.pretokens import BYTE_CHARS, packed

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text that is tokenised between two Arrow batches, but for a single longer one.
BATCH_CHARS = 500_000
#: Windows that a memo's generation holds, and the bytes of ids (four an id) of the longest that it keeps.
MEMO, LONGEST = 120_000, 160
MARK = "▁"
#: Bytes of the characters that stand for them in A's vocabulary.
_BYTES = {chr(c): b for b, c in BYTE_CHARS.items()}


@functools.lru_cache(2)
def coder_a(path: str, pattern: str) -> Callable[[str], bytes]:
    """Ids of A by its file's vocabulary; the strings of special tokens are plain text. Its merges are in the order of their
    tokens' ids, so the ids are ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    vocab, merges = given["model"]["vocab"], given["model"]["merges"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)):
        raise ValueError("a vocabulary whose merges aren't in the order of its ids can't be used by rank")
    special = {t["content"] for t in given.get("added_tokens", [])}
    coder = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={_bytes_of(t): i for t, i in vocab.items() if t not in special}, special_tokens={})
    return lambda text: packed(coder.encode_ordinary(text))


@functools.lru_cache(2)
def coder_b(path: str) -> Callable[[str], bytes]:
    """Ids of B, whose library adds the blank before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: packed(model.encode(text))


def _bytes_of(token: str) -> bytes:
    return bytes(_BYTES[c] for c in token)


@dataclass(frozen=True)
class Vocabularies:
    """Bytes of all tokens of A and B, their lengths, ids as text, which are space-marked, and the pairs that can end together."""

    a: list[bytes]
    b: list[bytes]
    names: list[str]
    #: Ids of A as text before a comma and before a bar, then those of B before a comma and before a semicolon.
    parts: list[str]
    size_a: np.ndarray
    size_b: np.ndarray
    space_a: np.ndarray
    space_b: np.ndarray
    #: a * len(b) + b of every pair that can be linked, ascending.
    pairs: np.ndarray


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The pairs of which one's bytes are the end of the other's, as a * len(b) + b, ascending."""

    def ends(long: list[bytes], short: list[bytes]) -> Iterator[tuple[int, int]]:
        of: dict[bytes, list[int]] = {}
        for i, t in enumerate(short):
            of.setdefault(t, []).append(i)
        for i, t in enumerate(long):
            for k in range(len(t)):
                for j in of.get(t[k:], ()):
                    yield i, j

    codes = {i * len(b) + j for i, j in ends(a, b)} | {i * len(b) + j for j, i in ends(b, a)}
    return np.array(sorted(codes), np.int64)


@functools.lru_cache(2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """The tables of two vocabulary files."""
    import sentencepiece
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path_a).get_vocab(with_added_tokens=True)
    a = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        a[i] = _bytes_of(token)
    model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    if not all(a) or not all(b):
        raise ValueError("a token without bytes has no place in a text")
    marked = [np.array([t[:1] == b" " for t in x]) for x in (a, b)]
    names = [str(i) for i in range(max(len(a), len(b)))]
    parts = [n + c for ends in (",|", ",;") for n in names for c in ends]
    return Vocabularies(a, b, names, parts, *(np.array([len(t) for t in x]) for x in (a, b)), *marked, linkable(a, b))


def align_windows(keys: list[bytes], v: Vocabularies) -> list[tuple[str, bytes] | bool]:
    """For each window's tuple of ids (A's, -1, B's, as 32-bit integers) its groups of ids between the bytes where a token of A
    and one of B end, as text, and the places of the pairs of ids that end there; False if A's and B's bytes differ. The
    windows are aligned together: their tokens are laid end to end, and as no token is empty, one token of each ends at a
    byte where both do."""
    both = np.frombuffer(b"".join(keys), np.int32)
    length = np.array([len(k) // 4 for k in keys])
    between = np.flatnonzero(both == -1)
    side, n_a = np.arange(len(both)) - np.repeat(between, length), between - (np.cumsum(length) - length)
    ids_a, ids_b = both[side < 0], both[side > 0]
    bytes_a, bytes_b = ([t[i] for i in ids.tolist()] for t, ids in ((v.a, ids_a), (v.b, ids_b)))
    bound_a, bound_b = ([0, *np.cumsum(n).tolist()] for n in (n_a, length - n_a - 1))
    if b"".join(bytes_a) != b"".join(bytes_b) or len(keys) > 1 and not np.array_equal(*(np.concatenate([[0], np.cumsum(size[ids])])[b] for size, ids, b in ((v.size_a, ids_a, bound_a), (v.size_b, ids_b, bound_b)))):
        return [False] if len(keys) == 1 else [x for k in keys for x in align_windows([k], v)]
    end_a, end_b = np.cumsum(v.size_a[ids_a]), np.cumsum(v.size_b[ids_b])
    ends = np.zeros(end_a[-1] + 1, np.uint8)
    ends[end_a] = 1
    ends[end_b] += 1
    last_a, last_b = ends[end_a] == 2, ends[end_b] == 2
    group_a, group_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
    links = np.searchsorted(v.pairs, ids_a[group_a].astype(np.int64) * len(v.b) + ids_b[group_b]).astype("<i4").tobytes()
    # Tokens of a group in order, A's before B's, each with what stands after it.
    n = 2 * len(v.names)
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    sizes_a, sizes_b = (np.diff(np.concatenate([[-1], g])) for g in (group_a, group_b))
    order[np.arange(len(ids_a)) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)] = 2 * ids_a + last_a
    order[np.arange(len(ids_b)) + np.repeat(np.cumsum(sizes_a), sizes_b)] = n + 2 * ids_b + last_b
    text = list(map(v.parts.__getitem__, order.tolist()))
    cut = (np.array(bound_a) + bound_b).tolist()
    of = (4 * np.searchsorted(group_a, bound_a)).tolist()
    return [("".join(text[p:q])[:-1], links[r:s]) for p, q, r, s in zip(cut, cut[1:], of, of[1:], strict=False)]


class WindowMemo:
    """Alignments by the windows' tuples of ids. There are two generations of at most ``size`` windows; when the young one
    is full it becomes the old one. Long windows are never kept."""

    def __init__(self, v: Vocabularies, size: int = MEMO):
        self.v, self.size, self.young, self.old = v, size, {}, {}

    def look_up(self, keys: list[bytes]) -> list[tuple[str, bytes] | bool]:
        """The alignment of every window, False for none; those that aren't known are aligned together."""
        young, found = self.young, list(map(self.young.get, keys))
        unknown = [i for i, f in enumerate(found) if f is None]
        made = dict.fromkeys(keys[i] for i in unknown)
        made.update((k, self.old[k]) for k in made.keys() & self.old.keys())
        new = [k for k, value in made.items() if value is None]
        made.update(zip(new, align_windows(new, self.v) if new else [], strict=True))
        for i in unknown:
            found[i] = made[keys[i]]
        young.update((k, value) for k, value in made.items() if len(k) <= LONGEST)
        if len(young) >= self.size:
            self.old, self.young = young, {}
        return found


@functools.lru_cache(1)
def _memo(path_a: str, path_b: str) -> WindowMemo:
    """The memo of a Python worker, which tasks after one another share."""
    return WindowMemo(vocabularies(path_a, path_b))


def windows(a: list[bytes], b: list[bytes], lengths: list[int], v: Vocabularies) -> tuple[list[bytes], list[int]]:
    """The windows of some texts as tuples of ids (A's, -1, B's), one text after another, and how many each text has. a, b:
    ids as little-endian 32-bit integers. A text whose tokens of A or B don't have its length in bytes has no windows: both
    tokenizers only leave bytes out or, in B's case, replace them, which shows where windows are aligned."""
    n_a, n_b = (np.array([len(x) // 4 for x in side]) for side in (a, b))
    ids_a, ids_b = (np.frombuffer(b"".join(side), "<i4") for side in (a, b))
    ends = [np.concatenate([[0], np.cumsum(size[ids])])[np.concatenate([[0], np.cumsum(n)])] for ids, n, size in ((ids_a, n_a, v.size_a), (ids_b, n_b, v.size_b))]
    whole = (n_a > 0) & (n_b > 0) & (np.diff(ends[0]) == lengths) & (np.diff(ends[1]) == lengths)
    if not whole.all():
        good = np.flatnonzero(whole).tolist()
        keys, found = windows(*([side[i] for i in good] for side in (a, b, lengths)), v) if good else ([], [])
        counts = [0] * len(a)
        for i, n in zip(good, found, strict=True):
            counts[i] = n
        return keys, counts
    begins = np.zeros(ends[0][-1] + 1, np.uint8)
    marked = []
    for ids, n, size, space in ((ids_a, n_a, v.size_a, v.space_a), (ids_b, n_b, v.size_b, v.space_b)):
        mark = space[ids]
        mark[np.cumsum(n) - n] = True  # a text begins a window
        at, sizes = np.flatnonzero(mark), size[ids]
        start = (np.cumsum(sizes) - sizes)[at]
        begins[start] += 1
        marked.append((at, start))
    # Where tokens of both begin, those before them end together.
    i, k = (np.concatenate([at[begins[start] == 2], [len(ids)]]) for (at, start), ids in zip(marked, (ids_a, ids_b), strict=True))
    n = np.arange(len(i))
    both = np.full(len(ids_a) + len(ids_b) + len(i) - 1, -1, np.int32)
    both[np.arange(len(ids_a)) + np.repeat((k + n)[:-1], np.diff(i))] = ids_a
    both[np.arange(len(ids_b)) + np.repeat((i + n)[1:], np.diff(k))] = ids_b
    bounds, keys = (4 * (i + k + n)).tolist(), both.tobytes()
    counts = np.diff(np.searchsorted(i, np.concatenate([[0], np.cumsum(n_a)])))
    return [keys[p:q] for p, q in zip(bounds, bounds[1:], strict=False)], counts.tolist()


def align_texts(texts: list[str], a_of: Callable[[str], bytes], b_of: Callable[[str], bytes], v: Vocabularies, memo: WindowMemo) -> list[tuple[int, int, str, np.ndarray] | None]:
    """For each text the numbers of A's and B's tokens, the groups as text, and the places of all links in the table of
    pairs; None where there are no tokens."""
    led = [" " + t if t else "" for t in texts]
    a, b = list(map(a_of, led)), list(map(b_of, texts))
    keys, counts = windows(a, b, [len(t.encode()) for t in led], v)
    found, out, at = memo.look_up(keys), [], 0
    for x, y, n in zip(a, b, counts, strict=True):
        own = found[at : at + n]
        at += n
        if not n or False in own:
            out.append(None)
            continue
        groups, links = zip(*own, strict=True)
        out.append((len(x) // 4, len(y) // 4, ";".join(groups), np.frombuffer(b"".join(links), "<i4")))
    return out


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``: ids of A and B in order),
    n_links, pairs and times (which pairs of ids end together, as places in ``Vocabularies.pairs``, and how often). Written
    to the shared folder.

    A null or empty text, and one whose tokens of A or B don't join to a blank and the text (an unknown character, a
    literal ``\\u2581``), has no tokens: zeros, an empty string and empty lists. Rows are independent, so repeated rows and
    null or repeated keys need no rule; a text of any length is aligned as a whole; an empty table gives an empty table;
    columns beyond the two that are named are dropped, whatever their names. Paths are of files at the same place on every
    executor.
    """
    path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    pattern = pattern or public_tokenizers.PATTERN
    given = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "pairs", "times"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_of, b_of, v = coder_a(path_a, pattern), coder_b(path_b), vocabularies(path_a, path_b)
        memo = _memo(path_a, path_b)
        for batch in it:
            for part in chunks(batch, "text", BATCH_CHARS):
                rows, pairs, times = [], [], []
                for found in align_texts(part.column(1).to_pylist(), a_of, b_of, v, memo):
                    n_a, n_b, groups, links = found or (0, 0, "", np.zeros(0, "<i4"))
                    which, n = np.unique(links, return_counts=True)
                    rows.append((n_a, n_b, len(links), groups, len(links)))
                    pairs.append(which.astype("<i4").tobytes())
                    times.append(n.astype("<i4").tobytes())
                n_a, n_b, n_groups, groups, n_links = zip(*rows, strict=True)
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), long(n_a), long(n_b), long(n_groups), pa.array(groups, pa.string()), long(n_links), list_array(pairs), list_array(times)], names)

    schema = f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, groups string, n_links bigint, pairs array<int>, times array<int>"
    return stored(given.mapInArrow(run, schema), "aligned")


def pair_counts(aligned: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """pair (place in ``Vocabularies.pairs``) and n: how many links of the corpus are of this pair. Each task adds up its own
    rows first; the result has no more rows than pairs can be linked at all."""
    path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabularies(path_a, path_b).pairs), np.int64)
        for batch in it:
            np.add.at(total, batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy())
        found = np.flatnonzero(total)
        for k in range(0, len(found), 50_000):
            part = found[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["pair", "n"])

    return aligned.select("pairs", "times").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def scored(aligned: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Adds count_sum, the corpus-wide counts of a row's links added up, and n_best, how many of its links have the highest
    count of their id of B (equals included).

    The counts come to the driver as two numbers for each pair, of which there are no more than ``Vocabularies.pairs``,
    whatever the corpus, and go back to the executors as two arrays of that length.
    """
    path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    v = vocabularies(path_a, path_b)
    found = pair_counts(aligned, path_a, path_b).toArrow()
    count = np.zeros(len(v.pairs), np.int64)
    count[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    most = np.zeros(len(v.b), np.int64)
    np.maximum.at(most, v.pairs % len(v.b), count)
    best = count == most[v.pairs % len(v.b)]
    sent = aligned.sparkSession.sparkContext.broadcast((count, best))

    @F.arrow_udf("n_best bigint, count_sum bigint")
    def score(pairs: pa.Array, times: pa.Array) -> pa.Array:
        count, best = sent.value
        which, n = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        ends = np.cumsum([0, *pairs.value_lengths().to_pylist()])
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n * best[which], n * count[which])]
        return pa.StructArray.from_arrays([pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums], ["n_best", "count_sum"])

    return aligned.withColumn("_score", score("pairs", "times")).select("*", "_score.n_best", "_score.count_sum").drop("_score")
