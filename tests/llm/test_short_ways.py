"""The short ways of the byte-level BPE: for printable ASCII, and for texts without odd white space."""

import random

import public_tokenizers
from foliolake.llm import pretokens as P
from foliolake.llm import token_store as S
from tokenizers import Tokenizer

ODD = ["a", "Zz", "é", "中", "😀", "'s", "9", "%%", "~", "\x7f", "\x00", " ", " ", "\n", "\t", "\r", "\x1c", "\x85", " ", " ", " ", " ", "　", "​", "﻿"]


def some_texts(n):
    r = random.Random(5)
    return ["", " ", "\n", *("".join(r.choices(ODD, k=r.randrange(1, 12))) for _ in range(n))]


def test_bytes_and_runs_are_those_of_the_long_way():
    for text in some_texts(4000):
        assert P.mapped_text(text) == P.mapped(text.encode())
        assert P.has_run(text) == bool(P._RUN.search(text))
    assert all(P.mapped_text(chr(c)) == P.mapped(chr(c).encode()) for c in range(0xD800))
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} == {*P._OTHER, " ", "\n"}


def test_ids_are_the_librarys():
    path = public_tokenizers.path(S.VOCABULARY)
    coder, library = S._encoder(path, public_tokenizers.PATTERN), Tokenizer.from_file(path)
    for text in some_texts(1500):
        assert coder(text) == P.packed(library.encode(text, add_special_tokens=False).ids)


def test_plain_words_take_the_short_way(monkeypatch):
    def long_way(_):
        raise AssertionError("a plain word was mapped byte by byte")

    coder = S._encoder.__wrapped__(public_tokenizers.path(S.VOCABULARY), public_tokenizers.PATTERN)
    monkeypatch.setattr(P, "mapped", long_way)
    assert coder("Plain words, and 12 numbers") == P.packed(Tokenizer.from_file(public_tokenizers.path(S.VOCABULARY)).encode("Plain words, and 12 numbers", add_special_tokens=False).ids)
