"""The ten operators on awkward rows: nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns
with clashing names; and against brute force where SQL can't express them."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.llm import bpe_codec, components, decontaminate, html_text, language, pii, pretokens, quality_rules, queries, repeats, simhash, token_store, toxicity
from foliolake.llm.common import scratch

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old stone bridge today"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, LONG),
    (6, "Same text here for ties and copies in every respect, I think so\nline\nline\n"),
    (7, "Same text here for ties and copies in every respect, I think so\nline\nline\n"),
    (7, "Same text here for ties and copies in every respect, I think so\nline\nline\n"),
    (None, "no key but words " * 40),
    (8, "é" * 150 + " 😀  mixed  spaces\t\tand \n\n lines \r\n end "),
    (9, "a" * 50_000),
    (10, "1 " * 20_000),
]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, fp long, ids string, key string, pii string, found string, w int, n_words int, score string, p_toxic double, kept boolean, decoded int, part int, small long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", None, 1, "x", "k", "p", "f", 1, 2, "z", 0.5, True, 3, 4, 5) for i, t in TEXTS]
    return spark.createDataFrame(rows, EXTRA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_text(df, docs):
    """Rows of a result by the digest of the text that they are about, in the order of ids."""
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


# 1 quality rules


def brute_quality(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, none):
    got = by_text(quality_rules.quality(docs), docs)
    want = sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0))
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got] == [brute_quality(t) for _, t in want]
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert quality_rules.quality(none).count() == 0


def test_cascade_order_changes_no_verdict(spark):
    df = spark.range(50).select(F.col("id").alias("n_words"))
    a, b = quality_rules.Rule("a", lambda m: m["n_words"] > 40), quality_rules.Rule("b", lambda m: m["n_words"] % 2 == 0)
    m = {"n_words": F.col("n_words")}
    verdict = [df.where(quality_rules.cascade(x, m).isNull()).count() for x in ([a, b], [b, a])]
    assert verdict[0] == verdict[1] == 20


def test_cheap_selective_rules_come_first(spark):
    df = spark.createDataFrame([(i, f"{'A' if i % 2 else 'b'} " + " ".join(f"w{k % 900}x{i}" for k in range(3_000))) for i in range(60)], "doc_id long, text string").repartition(1).persist()
    costly = quality_rules.Rule("costly", lambda m: (m["n_repeat_words"] > 0) & (m["n_words"] > 0))  # rejects all, sorts windows
    cheap = quality_rules.Rule("cheap", lambda m: m["n_upper"] > 0)  # rejects half
    never = quality_rules.Rule("never", lambda m: m["n_upper"] < 0)
    got = quality_rules.order_rules(df, [costly, never, cheap])
    assert [r.name for r, _, _ in got] == ["cheap", "costly", "never"]
    assert [round(x, 2) for _, _, x in got] == [0.5, 1.0, 0.0] and got[0][1] < got[1][1]


def test_later_rules_are_not_evaluated(spark):
    """A rule that would fail the job where an earlier one rejects."""
    fails = quality_rules.Rule("fails", lambda m: F.when(m["n_words"] < 10, F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(F.lit(False)))
    short = quality_rules.Rule("short", lambda m: m["n_words"] < 10)
    df = spark.range(20).select(F.col("id").alias("n_words"))
    assert df.where(quality_rules.cascade([short, fails], {"n_words": F.col("n_words")}).isNull()).count() == 10


def test_quality_sample_is_bounded(spark):
    df = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")).repartition(8)
    a, b = (sorted(r["doc_id"] for r in quality_rules.sampled(x, 100).collect()) for x in (df, df.repartition(3)))
    assert a == b and len(a) == 100


# 2 language


def test_language(docs, none, spark):
    words = {"xx": "alpha beta gamma delta", "yy": "zorro quux fizz wuzz", "zz": "миру мир слово дело"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=12)), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    got = language.predict(df.drop("lang"), model).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    odd = {(r["doc_id"], r["text"]): r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert odd[2, None] == odd[3, ""] == odd[4, " \t\n "] == odd[10, "1 " * 20_000] == "und" and len(odd) == len(set(TEXTS))
    assert language.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.train(docs)).collect()} == {"und"}


def test_language_by_plain_sets(spark):
    """The kernel, its Nystroem features and the ridge weights from sets of n-grams and explicit sums."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abc adc bcd cab".split() if i % 2 else "xyz zyx yxx abz".split(), k=8)), "pq"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    seen = language.held_out()
    learnt = [(r["text"], r["lang"]) for r in df.where(~seen).collect()]

    def grams(t):
        t = " ".join(t.split())
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    def kernel(a, b):
        return len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5

    of = language.Grams(model.letters)
    size = sorted({len(grams(t)) for t, _ in learnt})
    assert sorted(model.landmarks.astype(bool).sum(0).tolist())[-1] == size[-1]  # the texts with the most n-grams are landmarks
    texts = [t for t, _ in learnt[:10]]
    marks = [t for t, _ in learnt if any(np.array_equal(of.present(t, model.grams).astype(bool), model.landmarks[:, k] > 0) for k in range(model.landmarks.shape[1]))]
    got = {round(float(v), 4) for t in texts for v in (of.present(t, model.grams).astype(np.float32) @ model.landmarks) / len(grams(t)) ** 0.5}
    want = {round(kernel(t, m), 4) for t in texts for m in marks}
    assert got <= want and len(got) > 5


def test_language_by_raw_scores(spark):
    """The highest raw score wins, below 0 and above 1 too."""
    df = spark.createDataFrame([(1, "abc"), (2, "")], "doc_id long, text string")
    base = language.fit("abc", [np.unique(np.concatenate(language.Grams("abc").codes("abc cab")))] * 2, ["aa", "bb"])
    for constants, score in (((-0.3, -0.1), 0.0), ((1.1, 1.4), 1.0), ((0.2, 0.2), 0.2)):
        base.weights = np.zeros_like(base.weights)
        base.weights[-1] = constants
        got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in language.predict(df, base).collect()}
        assert got == {1: ("aa" if constants[0] == constants[1] else "bb", score), 2: ("und", 0.0)}


def test_language_held_out_accuracy(spark, sf):
    got = queries.QUERIES["op2_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    share = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.95


# 3 html


def test_html(spark, none):
    nav = "<nav><a href=x>Home</a></nav><div class='site notice'>Cookies!</div>"
    page = lambda i: f"<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body>{nav}<p>Shared banner of the host</p><div><h2>Title {i}</h2><p>Own  text\n{i} &amp; &eacute;<br>more<p>unclosed {i}</div><form><p>mail</p></form><div id=comments><p>first!</p></div><footer>c</footer></body>"
    rows = [(i, f"http://Host.example/{i}", page(i), 1) for i in range(6)] + [(6, None, page(6), 1), (7, "http://h2/", None, 1), (8, "x", "", 1), (8, "x", "", 1), (9, "http://h3/", "<nav>menu<article><h1>A</h1>b</article><p>after", 1), (None, "http://h3/", "plain < text", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r["page_id"], r["url"]): r["text"] for r in html_text.extract(pages).collect()}
    for i in range(6):
        assert got[i, f"http://Host.example/{i}"] == f"Title {i}\n\nOwn text {i} & é more\n\nunclosed {i}"
    assert got[6, None] == "Shared banner of the host\n\nTitle 6\n\nOwn text 6 & é more\n\nunclosed 6"
    assert got[7, "http://h2/"] == got[8, "x"] == "" and got[9, "http://h3/"] == "A\n\nb" and got[None, "http://h3/"] == "plain < text"
    assert html_text.extract(pages).count() == len(rows)
    assert html_text.extract(pages.where("false")).count() == 0


# 4 simhash


def brute_components(texts):
    fps = [simhash.fingerprint((t or "").encode()) for _, t in texts]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(texts):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, least[find(i)]) for i, (d, _) in enumerate(texts)), key=repr)


def plain_fingerprint(text):
    """The contract's fingerprint from its words, one shingle and one bit at a time."""
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark, sf):
    got = {r["doc_id"]: r["fingerprint"] for r in queries.QUERIES["op4_simhash"](spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert {r["doc_id"]: f"{plain_fingerprint(r['text']):016x}" for r in texts} == got
    more = [(i, t) for i, (_, t) in enumerate(TEXTS)] + [(100, "\u00c9T\u00c9 Ab\x0bc\x1cd \u00a0x\u2003y"), (101, "a b c d a b c d a b c d"), (102, "ONE two")]
    out = simhash.near_duplicates(spark.createDataFrame(more, "doc_id long, text string")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f")).collect()
    assert {r["doc_id"]: r["f"] for r in out} == {i: f"{plain_fingerprint(t):016x}" for i, t in more}


@pytest.mark.parametrize(("dense", "many"), [(1, 10**9), (2_000, 10**9), (1, 0), (2_000, 0)])
def test_simhash(spark, docs, none, dense, many):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        near.append((100 + i, " ".join(w)))
    texts = TEXTS + near
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = simhash.near_duplicates(df, dense=dense, many=many).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == brute_components(texts)
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_duplicates(docs).count() == len(TEXTS)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# 5 and 6 tokens


@pytest.fixture(scope="module")
def reference_encoder():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, none, reference_encoder):
    rng = random.Random(5)
    odd = [(1000 + i, "".join(rng.choices([" ", "  ", "\n", "\t", "a", "'s", "'ll", "Wort", "é", "中", "😀", "12", "!?", " ", "\r\n", "<|endoftext|>"], k=rng.randrange(30)))) for i in range(400)]
    df = docs.select("doc_id", "text", "ids", "decoded").union(spark.createDataFrame([(*r, "i", 1) for r in odd], "doc_id long, text string, ids string, decoded int")).withColumn("copy", F.col("text"))
    got = bpe_codec.decode(bpe_codec.encode(df, text_col="copy")).collect()
    assert len(got) == len(TEXTS) + len(odd)
    for r in got:
        assert r["ids"] == reference_encoder.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe_codec.decode(bpe_codec.encode(none)).count() == 0


def test_memo_forgets_without_harm():
    memo = pretokens.Memo(lambda p: p.encode(), size=3)
    assert [memo[x] for x in "abcdeabcde"] == [x.encode() for x in "abcdeabcde"] and len(memo) <= 3


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits):
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0, "<u4"), np.zeros(5, "<u4"), rng.integers(0, 50_257, 1000), rng.integers(0, 2**32, 777)):
        for block in (64, 4096):
            assert token_store.unpack(token_store.pack(ids.astype("<u4"), block, bits)).tolist() == ids.tolist()


def test_token_store(spark, docs, none, reference_encoder, monkeypatch):
    out = scratch(spark, "store")
    token_store.write_ids(docs, out, partitions=3, block=512)
    got = sorted(token_store.read_ids(spark, out).collect(), key=lambda r: r["start"])
    want = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    at = 0
    for r, (_, t) in zip(got, want, strict=True):
        assert r["start"] == at and list(r["ids"]) == [*reference_encoder.encode_ordinary(t or ""), 2] and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    crc = {(r["start"]): r["c"] for r in token_store.read_ids(spark, out).select("start", token_store.ids_crc32("ids").alias("c")).collect()}
    assert all(crc[r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    empty = scratch(spark, "store")
    token_store.write_ids(none, empty)
    assert token_store.read_ids(spark, empty).count() == 0


# 7 toxicity


def test_toxicity(spark, docs, none):
    rng = random.Random(7)
    good, bad = [f"word{i}" for i in range(80)], ["vile", "scumbag", "nasty"]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        w = rng.choices(good, k=30) + (rng.choices(bad, k=4) if toxic else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 7 != 0), int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, lab, toxicity.TARGETS)
    got = {r["doc_id"]: r["p_toxic"] >= toxicity.THRESHOLD for r in toxicity.score(df, chain).collect()}
    assert all(got[i] == (i % 5 == 0) for i in got)
    odd = toxicity.score(docs, chain)
    assert odd.count() == len(TEXTS) and odd.where("p_toxic >= 0.3").count() == 0 and odd.columns.count("p_toxic") == 1
    assert toxicity.score(none, chain).count() == 0
    blank = toxicity.train(df, lab.where("false"), toxicity.TARGETS)
    assert all(r["p_toxic"] < 0.1 for r in toxicity.score(df, blank).collect())


def test_toxicity_by_plain_loops(spark):
    """The chain from dictionaries and dense loops: selection by likelihood ratio, out-of-fold probabilities, ridge steps."""
    import math

    rng = random.Random(17)
    good, bad = [f"word{i}" for i in range(40)], ["vile", "scumbag", "nasty"]
    rows = [(i, " ".join(rng.choices(good, k=20) + (rng.choices(bad, k=3) if i % 4 == 0 else []))) for i in range(120)]
    labels = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i, _ in rows]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, lab, toxicity.TARGETS)
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in toxicity.score(df, chain).collect()}

    has = [{s for w in t.split() for s in [w, *(w[:n] + "\n" for n in (3, 4, 5, 6, 7) if len(w) > n)]} for _, t in rows]
    ys = [[1 - q for _, q, _ in labels], [t for _, _, t in labels]]

    def ratio(s, y):
        total = 0.0
        for label in (0, 1):
            n = sum(v == label for v in y)
            k, inside = sum(v == label and s in h for v, h in zip(y, has)), sum(s in h for h in has)
            for seen, expected in ((k, inside * n / len(y)), (n - k, (len(y) - inside) * n / len(y))):
                total += 2 * seen * math.log(seen / expected) if seen else 0
        return total

    every = {s for h in has for s in h}
    chosen = sorted(s for s in every if sum(s in h for h in has) >= toxicity.SUPPORT and max(ratio(s, y) for y in ys) >= toxicity.RATIO)
    assert sorted(chain.features) == chosen and chosen

    def fit(x, y):
        w, seen, t = [0.0] * len(x[0]), [0.0] * len(x[0]), 1.0
        a = np.array(x)
        v = np.random.default_rng(1).normal(size=a.shape[1])
        for _ in range(60):
            v = a.T @ (a @ (v / np.linalg.norm(v)))
        step = 1 / (0.25 * np.linalg.norm(v) / len(y) + toxicity.RIDGE)
        w = np.zeros(a.shape[1])
        for _ in range(3_000):  # plain steps, to the optimum nearly
            w -= step * (a.T @ (1 / (1 + np.exp(-a @ w)) - y) / len(y) + toxicity.RIDGE * w)
        return w

    sure = lambda w, x: 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
    shares = [[0.0, 1 - len(set(t.split())) / len(t.split()), 0.0] for _, t in rows]
    base = [[float(s in h) for s in chosen] + sh for h, sh in zip(has, shares)]
    first = [b + [1.0] for b in base]
    w1 = fit(first, np.array(ys[0], float))
    folds = [fit([x for i, x in enumerate(first) if i % 5 != f], np.array([y for i, y in enumerate(ys[0]) if i % 5 != f], float)) for f in range(5)]
    second = [b + [sure(folds[i % 5], first[i]), 1.0] for i, b in enumerate(base)]
    w2 = fit(second, np.array(ys[1], float))
    for i, b in enumerate(base):
        p = sure(w1, first[i])
        assert abs(got[i][0] - p) < 0.05 and abs(got[i][1] - sure(w2, b + [p, 1.0])) < 0.05


# 8 repeats


def brute_repeats(texts):
    data = [(t or "").encode() for _, t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - 199):
            k = d[i : i + 200]
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (i, _), d in zip(texts, data, strict=True):
        gone = np.zeros(len(d) + 1, int)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd", [0, 20_000])
def test_repeats(spark, none, crowd):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared, texts = [letters(n) for n in (199, 200, 201, 450, 1500)], []
    for i in range(80):
        parts = [letters(rng.randrange(0, 300)), rng.choice(shared), letters(rng.randrange(0, 300)), rng.choice(shared)[: rng.randrange(100, 1500)], "ab" * rng.choice([0, 0, 150])]
        texts.append((i, "".join(parts)))
    texts += [*TEXTS, (None, shared[3] + letters(300)), (None, letters(250)), (None, shared[3]), (200, "x" * 3000), (201, "é" * 120), (202, shared[4]), (202, shared[4])]
    df = spark.createDataFrame([(*t, 1, "k", 2) for t in texts], "doc_id long, text string, small long, key string, found int")
    got = repeats.remove_repeats(df.repartition(3), crowd=crowd).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got), key=repr) == brute_repeats(texts)
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 105, 5000, dtype=np.uint8).tobytes() * 2
    monkeypatch.setattr(repeats, "PART", 777)
    start, n, *_ = repeats.runs(data)
    assert n.sum() == len(data) - 199 and (np.diff(start) == n[:-1]).all()


# 9 decontamination


def test_decontamination(spark, docs, none):
    item = "One two three four five six seven eight nine ten eleven TWELVE thirteen fourteen fifteen"
    rows = [(1, item), (2, "short ITEM here"), (3, None), (4, ""), (5, item), (None, "short item here")]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    inside = "zero " * 30 + item.lower().replace(" ", ", ")
    more = [(50, inside), (51, "one two three"), (52, "A short, item... HERE is"), (53, " ".join(item.split()[:12])), (54, "one two " + item), (None, inside)]
    df = docs.select("doc_id", "text", "found", "w").union(spark.createDataFrame([(*r, "f", 1) for r in more], "doc_id long, text string, found string, w int"))
    out = decontaminate.contamination(df, benchmark, keep=("text",)).collect()
    got = {(r["doc_id"], r["text"]): (r["n_hit"], r["n_items"], list(r["items"])) for r in out}
    assert len(out) == len(TEXTS) + len(more)
    assert got[50, inside] == got[None, inside] == (15, 2, ["1", "5"])
    assert got[51, "one two three"][0] == got[53, more[3][1]][0] == 0
    assert got[52, more[2][1]][:2] == (3, 1) or got[52, more[2][1]][0] == 3
    assert got[54, more[4][1]][0] == 15
    assert all(v[0] == 0 for k, v in got.items() if k[0] and k[0] < 50)
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.contamination(df, benchmark.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_without_broadcast(spark, sf, monkeypatch):
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    want = decontaminate.contamination(read("documents"), read("benchmark")).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    assert decontaminate.contamination(read("documents"), read("benchmark")).orderBy("doc_id").collect() == want


# 10 personal data


def brute_pii(t):
    import re

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    return [(k, *m.span()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, t or "") if ok(m[0])]


def test_pii(spark, docs, none):
    rng = random.Random(10)
    parts = ["1", "2", "40", "255", "256", ".", ".", "-", " ", "@", "a", "b.c", "_", "+", "+1", " (", "é", "😀", "\n", "4111111111111111", "x@y.zz", "10.0.0.1", "+1 (555) 123-4567", "0000255.1.2.3"]
    texts = TEXTS + [(100 + i, "".join(rng.choices(parts, k=rng.randrange(40)))) for i in range(800)]
    df = spark.createDataFrame([(*r, "x") for r in texts], "doc_id long, text string, pii string")
    got = pii.find(df).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [tuple(s) for s in r["pii"] if s["kind"] < 4] == brute_pii(r["text"])
    assert pii.find(none).count() == 0


def test_pii_scores_and_redaction(spark):
    t = "pay to account GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33; SSN 123-45-6789, not 123-45-6789; x@y.zz 4111 1111 1111 1111"
    df = pii.find(spark.createDataFrame([(1, t), (2, None), (3, "none")], "doc_id long, text string"))
    out = {r["doc_id"]: r["t"] for r in df.select("doc_id", pii.redacted(F.col("text"), F.col("pii")).alias("t")).collect()}
    assert out[1].startswith("pay to account [IBAN] or GB82 WEST 1234 5698 7654 33; SSN [NATIONAL_ID], not") and out[1].endswith("[EMAIL] [CARD]")
    assert out[2] is None and out[3] == "none"


# 3 html: the host's template decides inside articles too


def pages_of(spark, pages, host="h.example"):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in sorted(html_text.extract(df).collect(), key=lambda r: r["page_id"])]


def test_html_template_cuts_articles(spark):
    share = lambda i: "<p>Read all of our stories in the app</p>" if i != 4 else ""  # noqa: E731  not on every page: a class of its own
    page = lambda i: f"<html><body><div class=top>Site {i}</div><article><h1>Title {i}</h1><p>Our paper is free for all</p><p>Own text {i} of some length</p>{share(i)}</article></body></html>"
    got = pages_of(spark, [page(i) for i in range(6)])
    assert got == [f"Title {i}\n\nOwn text {i} of some length" for i in range(6)]
    # Copies of one page count once, so they are no template.
    assert pages_of(spark, [page(1)] * 5)[0] == "Title 1\n\nOur paper is free for all\n\nOwn text 1 of some length\n\nRead all of our stories in the app"


def test_html_main_element_without_article(spark):
    refs = lambda i: f"<ol><li><a href=r>Reference {i} of the first kind</a></li></ol>" if i == 2 else ""
    page = lambda i: f"<html><body><div class=m><ul><li><a href=x>Go {i}</a></li></ul></div><div class=c><h2>Title {i}</h2><p>Own text {i} that is much longer than the rest</p>{refs(i)}</div></body></html>"
    got = pages_of(spark, [page(i) for i in range(4)])
    assert got == [f"Title {i}\n\nOwn text {i} that is much longer than the rest" + ("\n\nReference 2 of the first kind" if i == 2 else "") for i in range(4)]


def test_html_names_are_hints(spark):
    more = lambda i: f"<h2 id=search>Search {i}</h2><section id=related-work><p>Related work {i}</p></section>" if i == 3 else ""
    page = lambda i: f"<html><body class='post-{i}'><article class='post category-social'><h1>Title {i}</h1><p>Own text {i} that is long enough to be the most</p>{more(i)}<div class=share>Send {i}</div></article><footer>c {i}</footer></body></html>"
    got = pages_of(spark, [page(i) for i in range(5)])
    own = [f"Title {i}\n\nOwn text {i} that is long enough to be the most" for i in range(5)]
    assert got == [*own[:3], own[3] + "\n\nSearch 3\n\nRelated work 3", own[4]]
    # Without a template: the element that holds most of the text, an article and a heading are no chrome by name.
    assert html_text.main_text("<div class='content has-sidebar'><h2 id=search>A</h2><p>Text of some length</p></div><div class=sidebar>x</div>") == "A\n\nText of some length"
    assert html_text.main_text("<article class='post tag-search'><p>Text</p></article><p>after") == "Text"
    assert html_text.main_text("<article><p>Text</p><div id=comments><article class=comment><p>first</p></article></div></article>") == "Text"


def plain_template(pages):
    """Tokens of the valid equivalence classes of one host's pages, from whole occurrence vectors."""
    counted = [html_text.tokens(p) for p in dict.fromkeys(pages)]
    classes = {}
    for t in {t for c in counted for t in c}:
        vector = tuple(c.get(t, (0, 0))[0] for c in counted)
        if sum(map(bool, vector)) >= max(html_text.SUPPORT, html_text.SHARE * len(counted)):
            classes.setdefault(vector, []).append(t)
    size = lambda t: max(c[t][1] for c in counted if t in c)
    return {t for ts in classes.values() if sum(map(size, ts)) >= html_text.CLASS for t in ts}


def test_html_template_by_whole_vectors(spark, monkeypatch):
    rng = random.Random(31)
    rows, by_host = [], {}
    for h in ("a.example", "b.example", "c.example"):  # the second host has the first one's pages: equal vectors there stay apart
        rng.seed(h != "b.example" and h or "a.example")
        for i in range(rng.randrange(4, 12)):
            ads = "".join(f"<div class=ad><p>Buy {rng.choice(['one now', 'two of them'])}</p></div>" for _ in range(rng.randrange(3)))
            items = "".join(f"<li>{rng.choice(['red', 'blue'])} {rng.randrange(3)}</li>" for _ in range(rng.randrange(4)))
            p = f"<html><body><div class=top>Welcome to us</div>{ads}<article><h1>T{rng.randrange(99)}</h1><p>Own {rng.randrange(999)}</p><ul>{items}</ul></article><footer>All rights are ours</footer></body></html>"
            rows += [(len(rows), f"http://{h}/{i}", p)] * rng.choice([1, 1, 2])
            by_host.setdefault(h, []).append(p)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["host"]: {t % 2**64 for t in r["template"]} for r in html_text.templates(df).collect()}
    assert got == {h: plain_template(p) for h, p in by_host.items()} and len(got["a.example"]) > 8
    texts = lambda: sorted((r["page_id"], r["text"]) for r in html_text.extract(df).collect())
    small = texts()
    monkeypatch.setattr(html_text, "BROADCAST_TOKENS", -1)
    assert texts() == small


def test_html_very_long_and_deep_pages(spark):
    deep = "<div>" * 3_000 + "<p>first<b><i><b><i><b><i><b><i>bold<p>second" + "</div>" * 3_000
    long = "<article>" + "".join(f"<p>Sentence {i} of many.</p>" for i in range(20_000)) + "</article>"
    got = pages_of(spark, [deep, long])
    assert got[0] == "firstbold\n\nsecond"
    assert got[1].count("\n\n") == 19_999 and got[1].endswith("Sentence 19999 of many.")
