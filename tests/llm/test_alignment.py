"""Operator 11 against the libraries' own tokens, aligned by plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliolake.llm import alignment
from foliolake.llm.pretokens import BYTE_CHARS
from foliolake.llm.queries import QUERIES

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "\n", " \n ", "  \n\n a\n", "a\tb", "a \n b", "\r\n a", "<|endoftext|> x", "<s> </s> <unk>", "<0x0A>", "▁x", "x▁", "\x00x", "café naïve", "　 a b", "日本語 テキスト\n次の行",
    "😀 x😀", "the same the same", "the same the same", "don't can't 1234567 !!!", "word " * 2000, "y" * 3000, "ab\n" * 500, "https://example.org/a?b=c&d=1   end",
]


def plain(texts):
    """Rows by the contract: both libraries over whole texts, every pair of tokens by its end."""
    a_of = Tokenizer.from_file(public_tokenizers.path(alignment.VOCABULARY_A))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.VOCABULARY_B))
    back = {chr(c): b for b, c in BYTE_CHARS.items()}
    docs = []
    for text in texts:
        led = " " + (text or "")
        a = a_of.encode(led, add_special_tokens=False).ids if text else []
        b = b_of.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in a_of.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != led.encode() or b"".join(bytes_b) != led.encode():
            docs.append(([], [], [], []))
            continue
        end_a, end_b = (np.cumsum([len(t) for t in x]).tolist() for x in (bytes_a, bytes_b))
        links = [(a[i], b[end_b.index(e)]) for i, e in enumerate(end_a) if e in set(end_b)]
        groups, last = [], 0
        for e in sorted(set(end_a) & set(end_b)):
            groups.append(",".join(str(i) for i, x in zip(a, end_a) if last < x <= e) + "|" + ",".join(str(i) for i, x in zip(b, end_b) if last < x <= e))
            last = e
        docs.append((a, b, groups, links))
    count = Counter(p for d in docs for p in d[3])
    most: dict = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [(len(a), len(b), len(g), len(k), sum(count[p] == most[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, k in docs]


def by_query(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return QUERIES["op11_alignment"](spark, str(tmp_path))


def test_odd_texts(spark, tmp_path):
    rows = [(i, t, "x", 0) for i, t in enumerate(TEXTS)]
    got = {r[0]: tuple(r[1:]) for r in by_query(spark, tmp_path, rows, "doc_id long, text string, groups string, pairs int").collect()}
    want = plain(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i] == want[i], t


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 4 = 0").select("doc_id", "text").limit(40).collect()
    made = alignment.scored(alignment.align(spark.createDataFrame(docs)))
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest()) for r in made.collect()}
    assert got == dict(zip([d.doc_id for d in docs], plain([d.text for d in docs])))


def test_null_and_repeated_keys_and_empty_table(spark, tmp_path):
    rows = [(None, "a b"), (None, "a b"), (7, "a b"), (7, None)]
    made = alignment.scored(alignment.align(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted((r.doc_id or 0, r.n_a, r.n_links, r.count_sum) for r in made.collect()) == [(0, 2, 2, 6), (0, 2, 2, 6), (7, 0, 0, 0), (7, 2, 2, 6)]
    assert by_query(spark, tmp_path, [], "doc_id long, text string").collect() == []


def parts():
    paths = [public_tokenizers.path(p) for p in (alignment.VOCABULARY_A, alignment.VOCABULARY_B)]
    return alignment.coder_a(paths[0], public_tokenizers.PATTERN), alignment.coder_b(paths[1]), alignment.vocabularies(*paths)


@pytest.mark.parametrize("size", [1, 3])
def test_memo_of_few_windows(size):
    """What falls out of the memo is aligned again; what is in it isn't."""
    a, b, v = parts()
    small, large = alignment.WindowMemo(v, size), alignment.WindowMemo(v)
    for texts in (["one two three four five", "two one"], ["two three one"], ["unbelievable five", "", "▁"]):
        x, y = (alignment.align_texts(texts, a, b, v, m) for m in (small, large))
        assert [t and (t[:3], t[3].tolist()) for t in x] == [t and (t[:3], t[3].tolist()) for t in y]
    known = dict(large.young)
    large.look_up(list(known))
    assert large.young == known and len(known) > size


def test_windows_with_other_bytes():
    """Only the windows whose bytes differ have no alignment."""
    _, _, v = parts()
    between = b"\xff\xff\xff\xff"
    ids = lambda *t: alignment.packed(list(t))
    good = ids(v.a.index(b" the")) + between + ids(v.b.index(b" the"))
    bad = ids(v.a.index(b" the")) + between + ids(v.b.index(b" a"))
    assert [x is False for x in alignment.align_windows([good, bad, good], v)] == [False, True, False]
