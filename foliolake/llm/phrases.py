"""Operator 13: words of 35-word passages that come again anywhere in the corpus, by prefix-partitioned suffix trees.

All suffixes of a corpus with 35 words each would be far larger than it, so the trees hold the suffixes at *anchors*. A
window's anchor is its word with the smallest hash of the eight words from there on, the first of equals; it depends on
the window's words alone, so equal windows have it at the same place. Neighbouring windows with the same anchor are a
*run*: the suffix at the anchor, and the words before it that its windows reach. Each text gives a row a run.

1. Suffixes are split by prefix: the anchor's eight words. A prefix that comes once in the corpus can't have an inner
   node, and its run is done with. Runs that are equal in all words are repeats as they are, and count as one from there
   on. What is left is those prefixes under which different runs meet.
2. A prefix's runs are dealt to one task if they fit in memory. The tree is built level by level: a node of a level is
   the runs of one node above that go on with the same word, and a run that is alone is a leaf and leaves the tree. A
   window with l words before its anchor is a path of 35 - l words in this tree and one of l words in that of the words
   before the anchors, read backwards; where a node of the one and a node of the other have the same two runs or more,
   together 35 words deep, the windows there are repeats.
3. A prefix whose runs don't fit is split by the longest prefixes instead, the windows' whole 35 words: windows become
   rows by 128 bits of hash, which are counted with partial aggregation, wherever they lie.
4. Each text marks the windows found. Only rows of hashes, and the runs of step 2, are shuffled for the search, and the
   texts twice, by their key, to meet what was found.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.llm.bpe_codec import chunks
from foliolake.llm.common import drop, stored
from foliolake.llm.pretokens import Memo
from foliolake.llm.repeats import _intervals, _key, _least, _with_texts

WINDOW = 35
#: Bytes of runs under one prefix beyond which it is split by whole windows, and bytes that a task gathers at least before
#: it builds the trees of the prefixes that it has.
CROWD, GATHER = 4 << 20, 4 << 20
#: Windows of a text that are hashed at once; an anchor's place in them takes 20 bits.
PART = (1 << 20) - 1024
#: Bytes of a text that are cut into words at once, and of texts between two Arrow batches.
PIECE, BATCH_BYTES = 4 << 20, 4 << 20
_BLANK = re.compile(rb"[ \t-\r]")
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_PLACE = np.uint64((1 << 20) - 1)


def gram_of(window: int) -> int:
    """Words of an anchor's prefix: the largest power of two up to a quarter of the window."""
    if window < 8:
        raise ValueError("a window of less than eight words has no prefix to be dealt by")
    return 1 << ((window // 4).bit_length() - 1)


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some MB of it at a time. Python's bytes are split at the same six characters as the contract's
    pattern does."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


@functools.lru_cache(1)
def _digests() -> Memo:
    import xxhash

    return Memo(xxhash.xxh3_128_digest, 200_000)


def digests(*texts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word of some texts, one after another (n × 2), and how many words each text has."""
    of = _digests().__getitem__
    hashes = [b"".join([b"".join(map(of, words)) for words in pieces(data)]) for data in texts]
    return np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2), np.array([len(h) // 16 for h in hashes], np.int64)


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of pairs; what comes first matters."""
    z = x * _M[0] + (y ^ (y >> np.uint64(29))) * _M[1]
    z = (z ^ (z >> np.uint64(32))) * _M[2]
    return z ^ (z >> np.uint64(29))


def _doubled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n neighbours, n a power of two, from those of single words."""
    k = 1
    while k < n:
        h = _joined(h[:-k], h[k:])
        k *= 2
    return h


def _spans(block: np.ndarray, size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words from start to end (up to four blocks of ``size``), from those of all blocks."""
    last = end - size
    h = block[start]
    for k in (1, 2):
        h = _joined(h, block[np.minimum(start + k * size, last)])
    return _joined(_joined(h, block[last]), (end - start).astype(np.uint64))


def runs(h: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """Of every run of some texts with word hashes h, of which each has so many: the text, the first window, the number of
    windows, the anchor (places in the text), the hash of the anchor's prefix, and two hashes of all words."""
    gram, size = gram_of(window), 1 << (window.bit_length() - 1)
    begins, text = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    found: list[list[np.ndarray]] = [[] for _ in range(7)]
    for at in range(0, len(h) - window + 1, PART):
        part = h[at : at + PART + window - 1]
        one, two = np.ascontiguousarray(part[:, 0]), np.ascontiguousarray(part[:, 1])
        prefix = _doubled(one, gram)
        anchors = _least((prefix & ~_PLACE) | np.arange(len(prefix), dtype=np.uint64), window - gram + 1) & _PLACE
        owner = text[at : at + len(part)]
        inside = owner[: len(anchors)] == owner[window - 1 :]  # not across the end of a text
        change = (anchors[1:] != anchors[:-1]) | ~inside[1:] | ~inside[:-1]
        start = np.flatnonzero(inside & np.concatenate([[True], change]))
        stop = np.flatnonzero(inside & np.concatenate([change, [True]])) + 1
        anchor, end, which = anchors[start].astype(np.int64), stop - 1 + window, owner[start]
        whole = [_spans(_doubled(x, size), size, start, end) for x in (one, two)]
        for column, x in zip(found, (which, start + at - begins[which], stop - start, anchor + at - begins[which], prefix[anchor], *whole), strict=True):
            column.append(x)
    return [np.concatenate(c).view(np.int64) if c else np.zeros(0, np.int64) for c in found]


RUN = "small bigint, whole bigint, whole2 bigint"
RUN_KEY = ["small", "whole", "whole2"]


def _run_rows(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row a different run of every text: key, small, whole, whole2, times, size (bytes)."""
    given = df.where(F.octet_length(F.col(f"`{text_col}`")) >= 2 * window - 1).select(_key(id_col, text_col), F.col(f"`{text_col}`").cast("binary").alias("data"))

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in chunks(batch, "data", BATCH_BYTES):
                texts = part.column(1).to_pylist()
                h, counts = digests(*texts)
                text, start, n, _, small, whole, whole2 = runs(h, counts, window)
                if not len(text):
                    continue
                ends = np.concatenate([[0], np.cumsum([len(w) + 1 for data in texts for words in pieces(data) for w in words])])
                first = start + (np.cumsum(counts) - counts)[text]
                order = np.lexsort((whole2, whole, text))
                t, a, b = text[order], whole[order], whole2[order]
                other = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                times, one = np.diff(np.concatenate([other, [len(order)]])), order[other]
                columns = (part.column(0).to_numpy()[text[one]], small[one], whole[one], whole2[one], times, (ends[first + n - 1 + window] - ends[first])[one])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", *RUN_KEY, "times", "size"])

    return given.mapInArrow(go, f"key bigint, {RUN}, times bigint, size bigint")


def _known_runs(texts: list[bytes], whole: list[int], window: int) -> Iterator[tuple[int, ...]]:
    """The runs of some texts whose first hash is one of those given, as ``runs`` has them, text by text."""
    columns = runs(*digests(*texts), window)
    known = np.flatnonzero(np.isin(columns[5], np.array(whole, np.int64)))
    return zip(*(c[known].tolist() for c in columns), strict=True)


def _wanted_words(texts: DataFrame, window: int) -> DataFrame:
    """The words of the wanted runs of texts: small, whole, whole2, n, crowded, lead (words before the anchor), data (words
    joined by blanks). texts: data, found (array of whole, whole2, n, crowded)."""

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in chunks(batch, "data", BATCH_BYTES):
                out: list[list] = [[] for _ in range(7)]
                texts = part.column("data").to_pylist()
                want = {(t, f["whole"], f["whole2"]): f for t, found in enumerate(part.column("found").to_pylist()) for f in found}
                of_text, words = -1, []
                for text, start, n, anchor, small, whole, whole2 in _known_runs(texts, [w[1] for w in want], window):
                    f = want.pop((text, whole, whole2), None)
                    if f is not None:
                        if of_text != text:
                            of_text, words = text, [w for p in pieces(texts[text]) for w in p]
                        row = (small, whole, whole2, f["n"], f["crowded"], anchor - start, b" ".join(words[start : start + n - 1 + window]))
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
                kinds = [*[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [*RUN_KEY, "n", "crowded", "lead", "data"])

    return texts.select("data", "found").mapInArrow(go, f"{RUN}, n bigint, crowded boolean, lead bigint, data binary")


def _levels(root: np.ndarray, words: np.ndarray, depth: int) -> list[np.ndarray]:
    """Node of every run at each depth of a tree, -1 where it has left the tree: it is alone, or has no more words. root:
    the node at depth 0; words: runs × depth, -1 beyond a run's end."""
    base = np.int64(words.max(initial=0)) + 1
    node = root.astype(np.int64)
    out = [node]
    alive = np.arange(len(root))
    for d in range(depth):
        alive = alive[words[alive, d] >= 0]
        below = np.full(len(root), -1, np.int64)
        if len(alive):
            _, which, count = np.unique(node[alive] * base + words[alive, d], return_inverse=True, return_counts=True)
            inner = count[which] >= 2
            alive = alive[inner]
            below[alive] = which[inner]
        node = below
        out.append(node)
    return out


def repeated_windows(small: np.ndarray, lead: np.ndarray, data: list[bytes], window: int = WINDOW) -> np.ndarray:
    """For runs of some prefixes: runs × windows, true where the window with so many words before the anchor is in
    another run too."""
    gram = gram_of(window)
    most = window - gram
    ids: dict[bytes, int] = {}
    after, before = np.full((len(data), window), -1, np.int64), np.full((len(data), most), -1, np.int64)
    for i, (d, k) in enumerate(zip(data, lead.tolist(), strict=True)):
        words = [ids.setdefault(w, len(ids)) for w in d.split()]
        right, left = words[k : k + window], words[:k][::-1]
        after[i, : len(right)] = right
        before[i, : len(left)] = left
    root = np.unique(small, return_inverse=True)[1]
    right, left = _levels(root, after, window), _levels(root, before, most)
    out = np.zeros((len(data), most + 1), bool)
    for k in range(most + 1):
        # What is an inner node of both trees; the roots of the second are nodes for whoever is in the first.
        both = np.flatnonzero((right[window - k] >= 0) & (left[k] >= 0))
        if len(both):
            _, which, count = np.unique(right[window - k][both] * np.int64(len(data) + 1) + left[k][both], return_inverse=True, return_counts=True)
            out[both[count[which] >= 2], k] = True
    return out


def _compare(edges: DataFrame, window: int) -> DataFrame:
    """small, whole, whole2, hits (intervals of windows, flat) of the runs with n = 1 that hold repeated windows."""

    def together(held: list[tuple]) -> pa.RecordBatch:
        small, _, _, n, lead, data = zip(*held, strict=True)
        hit = repeated_windows(np.array(small, np.int64), np.array(lead, np.int64), list(data), window)
        rows = []
        for i in np.flatnonzero(hit.any(1) & (np.array(n) == 1)).tolist():
            # The window with k words before the anchor is the run's window lead - k.
            rows.append((*held[i][:3], _intervals(hit[i, : lead[i] + 1][::-1])))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.int64()))], [*RUN_KEY, "hits"])

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in it:
            for row in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if size >= GATHER and row[0] != held[-1][0]:
                    yield together(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield together(held)

    given = edges.select(*RUN_KEY, "n", "lead", "data").repartition("small").sortWithinPartitions("small")
    return given.mapInArrow(go, f"{RUN}, hits array<bigint>")


def _compare_crowd(edges: DataFrame, window: int) -> DataFrame:
    """As _compare, by the windows' whole words."""

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << (window.bit_length() - 1)
        for batch in it:
            for part in chunks(batch, "data", BATCH_BYTES // 8):
                out: list[list] = [[] for _ in range(7)]
                for small, whole, whole2, n, data in zip(*(part.column(c).to_pylist() for c in range(5)), strict=True):
                    h = digests(data)[0]
                    at = np.arange(len(h) - window + 1)
                    hashes = [_spans(_doubled(np.ascontiguousarray(h[:, f]), size), size, at, at + window).view(np.int64) for f in (0, 1)]
                    for column, x in zip(out, (*(np.full(len(at), v) for v in (small, whole, whole2, min(n, 2))), at, *hashes), strict=True):
                        column.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], [*RUN_KEY, "n", "at", "h1", "h2"])

    rows = stored(edges.select(*RUN_KEY, "n", "data").mapInArrow(go, f"{RUN}, n bigint, at bigint, h1 bigint, h2 bigint"), "windows")
    twice = rows.groupBy("h1", "h2").agg(F.sum("n").alias("times")).where("times >= 2").select("h1", "h2")
    hit = rows.where("n = 1").join(twice.hint("merge"), ["h1", "h2"]).groupBy(*RUN_KEY).agg(F.array_sort(F.collect_list("at")).alias("at"))
    return hit.select(*RUN_KEY, F.flatten(F.transform("at", lambda a: F.array(a, a + 1))).alias("hits"))


def marked(texts: list[bytes], found: list[list], window: int = WINDOW) -> list[np.ndarray | None]:
    """For each text, for every word whether it is in a repeated window; None if none is. found: for each text dicts of
    whole, whole2 and hits (None: all windows)."""
    hits = {(t, f["whole"], f["whole2"]): f["hits"] for t, own in enumerate(found) for f in own or ()}
    out: list[np.ndarray | None] = [None] * len(texts)
    some = [t for t, own in enumerate(found) if own]
    if not some:
        return out
    sums = {}
    for k, start, n, _, _, whole, whole2 in _known_runs([texts[t] for t in some], [w[1] for w in hits], window):
        key = some[k], whole, whole2
        if key in hits:
            own = [0, n] if hits[key] is None else hits[key]
            begins, ends = sums.setdefault(some[k], ([], []))
            begins += [start + x for x in own[::2]]
            ends += [start + y - 1 + window for y in own[1::2]]
    for t, (begins, ends) in sums.items():
        n = max(ends)
        out[t] = np.cumsum(np.bincount(begins, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:-1] > 0
    return out


def _kept(texts: DataFrame, window: int) -> DataFrame:
    """The remaining words and what was removed. texts: doc_id, data, found."""

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in chunks(batch, "data", BATCH_BYTES):
                rows, texts = [], part.column("data").to_pylist()
                for data, gone in zip(texts, marked(texts, part.column("found").to_pylist(), window), strict=True):
                    left, n = [], 0
                    for words in pieces(data):
                        # No word is removed beyond the last window that is.
                        own = words if gone is None or n >= len(gone) else [w for w, g in zip_longest(words, gone[n : n + len(words)].tolist()) if not g]
                        n += len(words)
                        if own:
                            left.append(b" ".join(own))
                    rows.append((b" ".join(left).decode(), n, 0 if gone is None else int(gone.sum())))
                kept, words, removed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])

    given = texts.select("doc_id", "data", "found")
    return given.mapInArrow(go, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, kept string, n_words bigint, n_removed bigint")


def remove_phrases(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """One row for each row of ``df``: doc_id, kept (the remaining words, joined by one blank), n_words, n_removed.

    A null or empty text has no words; texts of less than a window lose nothing. Repeated rows are repeats of each other:
    both lose what they share, and so do two places of one text. Keys may be null or repeated, as what is found is looked
    up by content. An empty table gives an empty table. Only the two named columns are read, whatever others are called.
    Runs count as equal by 128 bits of hashes of their words (two hashes that share nothing but the words); those that
    aren't equal are compared word by word, or, under a crowded prefix, by 128 bits of a window's words. A text is held
    whole in one task, with some five times its size.
    """
    rows = stored(_run_rows(df, id_col, text_col, window), "phrase-runs")
    again = rows.groupBy("small").agg(F.sum("times").alias("times")).where("times >= 2").select("small")
    shared = stored(rows.join(again.hint("merge"), "small"), "phrase-shared")
    drop(rows)
    counts = shared.groupBy(*RUN_KEY).agg(F.sum("times").alias("n"), F.min("key").alias("key"), F.max("size").alias("size"))
    # Of every prefix: how many different runs come once, and the bytes of all different runs.
    kinds = counts.groupBy("small").agg(F.count_if(F.col("n") == 1).alias("edges"), F.sum("size").alias("bytes"))
    status = stored(counts.join(kinds.hint("merge"), "small"), "phrase-counts")
    wanted = status.where("edges > 0").select("key", F.struct("whole", "whole2", F.least("n", F.lit(2)).alias("n"), (F.col("bytes") > crowd).alias("crowded")).alias("f"))
    by_text = wanted.groupBy("key").agg(F.collect_list("f").alias("found"))  # of equal runs one text's words do
    edges = stored(_wanted_words(_with_texts(df, id_col, text_col, by_text, "inner"), window), "phrase-edges")
    hits = _compare(edges.where("NOT crowded"), window)
    if not edges.where("crowded").isEmpty():
        hits = hits.unionByName(_compare_crowd(edges.where("crowded"), window))
    full = status.where("n >= 2").select(*RUN_KEY, F.lit(None).cast("array<bigint>").alias("hits"))
    verdict = stored(full.unionByName(hits), "phrase-verdicts")
    drop(status, edges)
    own = shared.select("key", *RUN_KEY).join(verdict.hint("merge"), RUN_KEY)
    found = stored(own.groupBy("key").agg(F.collect_set(F.struct("whole", "whole2", "hits")).alias("found")), "phrase-found")
    drop(shared, verdict)
    return _kept(_with_texts(df, id_col, text_col, found, "left"), window)
