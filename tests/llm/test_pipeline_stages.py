"""Each stage of the pipeline on the rows of its predecessor against plain loops, and on awkward rows."""

import base64
import re

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from test_ops import LONG, brute_pii, plain_fingerprint

STAGES = dict(P.STAGES)
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, _row string, fp int, ids string, found string, _key int, pii string, decoded int, root int"


def chars(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def kept_of_groups(rows):
    """The smallest id of each component of fingerprints within four bits."""
    prints = {d: plain_fingerprint(t) for d, t in rows}
    left, kept = dict(sorted(prints.items())), set()
    while left:
        first = min(left)
        kept.add(first)
        todo = [left.pop(first)]
        while todo:
            f = todo.pop()
            near = [d for d, g in left.items() if (f ^ g).bit_count() <= 4]
            todo += [left.pop(d) for d in near]
    return kept


def contaminated(text, items):
    w = chars(text)
    hit = set()
    for item in items:
        k = min(13, len(item))
        windows = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if item else set()
        hit |= {i + j for i in range(len(w) - k + 1) if k and tuple(w[i : i + k]) in windows for j in range(k)}
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def test_stages_by_brute_force(spark, sf):
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{sf}/documents.parquet").persist()
    near = {r["doc_id"]: r["text"] for r in STAGES["simhash"](spark, docs, sf).collect()}
    assert set(near) == kept_of_groups([(r["doc_id"], r["text"]) for r in docs.collect()]) and len(near) < docs.count()

    items = [chars(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    some = docs.where("doc_id % 2 = 0")
    clean = {r["doc_id"] for r in STAGES["decontamination"](spark, some, sf).collect()}
    assert clean == {r["doc_id"] for r in some.collect() if not contaminated(r["text"], items)} and len(clean) < some.count()

    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    private = {r["doc_id"]: (r["text"], r["n_chars"]) for r in STAGES["personal_data"](spark, docs, sf).collect()}
    assert set(private) == set(whole) and all(n == len(t) and not brute_pii(t) for t, n in private.values())
    assert {d for d in whole if brute_pii(whole[d])} <= {d for d in whole if private[d][0] != whole[d]} != set(whole)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in STAGES["bpe"](spark, docs, sf).collect():
        assert list(r["ids"]) == coder.encode_ordinary(whole[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) and r["text"] == whole[r["doc_id"]]


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_awkward_rows(spark, sf, name):
    texts = [(1, None), (2, ""), (3, " \n "), (4, LONG), (5, "Some words of a clean text that nobody else has written down yet, I hope"), (5, "Another text of the same id, about rivers and the bridges over them"), (None, "A text without an id that tells of clouds and rain over the hills"), (7, "One text twice in the table, each time with the same id and words"), (7, "One text twice in the table, each time with the same id and words")]
    df = spark.createDataFrame([(i, t, None, None, None, "r", 1, "i", "f", 2, "p", 3, 4) for i, t in texts], EXTRA).repartition(3)
    out = STAGES[name](spark, df, sf)
    assert out.columns[:5] == P.COLUMNS and (name == "bpe" or len(out.columns) == 5)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    want = sorted((i or 0, t or "") for i, t in texts)
    if name == "simhash":  # texts without words are one group, copies another
        want = sorted({(i, t) for i, t in want if i not in (2, 3)})
    assert got == want
    assert STAGES[name](spark, df.where(F.lit(False)), sf).count() == 0
