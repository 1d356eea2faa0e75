"""Operator 13 against counts of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from foliolake.llm import phrases
from foliolake.llm.queries import QUERIES


def plain(texts, window=35):
    """Kept words and removed count of every text."""
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    return out


def made_texts(seed, n, vocabulary, window):
    """Texts that share passages of all lengths around the window, some at their ends, some overlapping, some twice."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    passages = [[word() for _ in range(r.choice([window - 1, window, window + 1, 2 * window, 3 * window, 5 * window]))] for _ in range(6)]
    texts = []
    for _ in range(n):
        out = [word() for _ in range(r.randrange(3 * window))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            out += p[a:] if r.random() < 0.3 else p[: a + 1] if r.random() < 0.3 else p
            out += [word() for _ in range(r.randrange(window))]
        texts.append(r.choice([" ", "\n", "\t "]).join(out))
    return texts


@pytest.mark.parametrize(("window", "vocabulary", "crowd"), [(35, 5000, 1 << 22), (35, 5000, 0), (9, 4, 1 << 22), (9, 4, 0), (35, 2, 1 << 22), (40, 3, 500), (16, 60, 300)])
def test_made_texts(spark, window, vocabulary, crowd):
    texts = made_texts(window + vocabulary, 60, vocabulary, window)
    texts += [None, "", " \n", "a " * 300, "a " * 35, "a " * 34, "a b " * 100, texts[0], texts[0], " ".join(texts[1].split()[:-1]), "ein  weiß \x1f　x " * 40]
    df = spark.createDataFrame([(i % 50 or None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(3)
    got = phrases.remove_phrases(df, window=window, crowd=crowd).collect()
    assert sorted((r.doc_id or 0, r.kept, r.n_words, r.n_removed) for r in got) == sorted((i % 50, *row) for i, row in enumerate(plain(texts, window)))


def test_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (n, g, hashlib.sha256(k.encode()).hexdigest()) for r, (k, n, g) in zip(rows, plain([r.text for r in rows]))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op13_repeated_phrases"](spark, sf).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_empty_table(spark):
    assert phrases.remove_phrases(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_hold_every_window_once(monkeypatch):
    """A long text in parts: every window is in one run, with its anchor inside."""
    monkeypatch.setattr(phrases, "PART", 500)
    monkeypatch.setattr(phrases, "PIECE", 300)
    r = random.Random(2)
    data = " ".join(r.choice(["a", "b", "cc", "ddd"]) for _ in range(3000)).encode()
    assert [w for p in phrases.pieces(data) for w in p] == data.split()
    _, start, n, anchor, *_ = phrases.runs(*phrases.digests(data))
    assert np.array_equal(np.concatenate([np.arange(s, s + k) for s, k in zip(start, n)]), np.arange(3000 - 34))
    text, *rest = phrases.runs(*phrases.digests(b"a b", data[:900], b"", data[:900], data[:50]))
    assert set(text.tolist()) == {1, 3} and all(np.array_equal(c[text == 1], c[text == 3]) for c in rest[:2])
    assert ((anchor >= start + n - 1) & (anchor <= start + 27)).all()


def test_trees():
    """Windows that two runs share, by place of the anchor; a window that only one run has is no inner node."""
    words = [f"x{k}" for k in range(100)]
    data = [" ".join(words[40 - a : 40 + b]).encode() for a, b in ((27, 35), (27, 35), (0, 35), (10, 30))] + [" ".join(["y", *words[31:75]]).encode()]
    lead = np.array([27, 27, 0, 10, 10])
    hit = phrases.repeated_windows(np.zeros(5, np.int64), lead, data)
    assert hit[0].all() and hit[1].all()
    assert np.flatnonzero(hit[2]).tolist() == [0]
    assert np.flatnonzero(hit[3]).tolist() == list(range(5, 11))
    assert np.flatnonzero(hit[4]).tolist() == list(range(10))
    alone = phrases.repeated_windows(np.arange(2), lead[:2], data[:2])
    assert not alone.any()
