"""The ids of the token store against the tokenizers library itself, added tokens in the text included."""

import random

import public_tokenizers as P
from tokenizers import Tokenizer

from foliolake.llm import token_store
from foliolake.llm.common import scratch


def test_added_tokens(spark):
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", " b", "Wort", "é", "😀", "12", "'s"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", *("".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(300))]
    out = scratch(spark, "added")
    token_store.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), out, partitions=2)
    library = Tokenizer.from_file(P.path(token_store.VOCABULARY))
    got = {r["doc_id"]: list(r["ids"]) for r in token_store.read_ids(spark, out).collect()}
    assert got[0] == [64, 220, 50256, 275, 2]
    assert [got[i] for i in range(len(texts))] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
