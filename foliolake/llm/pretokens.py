"""Pre-tokenisation with a bounded memo, shared by the two byte-level BPE operators.

The public pattern cuts a text into pre-tokens, and a byte-level BPE works inside each. A blank followed by a character
that is not white space always starts a pre-token, and so does a line end in the same place; so where no white space
follows a blank or a line end, the text may be cut there, and the ids of each piece may be looked up. Other texts are
cut by the pattern itself.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable

#: White space after a blank or line end, or one of these two at the end.
_RUN = re.compile(r"[ \n](?:\s|\Z)")
#: Other white space, which few texts have, and what is found in the others.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_PAIRS = [a + b for a in " \n" for b in " \n"]
#: The ids of longer pieces are not kept, so that the memo's size in bytes has a bound.
LONGEST = 48
#: Pieces in a generation of a memo, by what it is for: pieces after a blank are most of a text. An encoder has three memos
#: of two generations, so this bounds a Python worker's memory; frequent pieces go from the old generation to the young one.
MEMO, MEMO_REST = 60_000, 300_000
#: Characters that stand for the 256 bytes in public byte-level BPE vocabularies: printable Latin-1 as it is, the others
#: in order from U+0100.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = dict(zip([*_PLAIN, *(b for b in range(256) if b not in _PLAIN)], [*_PLAIN, *range(256, 512)], strict=False))


def mapped(data: bytes) -> str:
    """The bytes as a string of one character each."""
    return data.decode("latin-1").translate(BYTE_CHARS)


def mapped_text(text: str) -> str:
    """``mapped`` of a text's UTF-8. In printable ASCII, which most rare words are, only the blank stands for another character."""
    return text.replace(" ", chr(BYTE_CHARS[32])) if text.isascii() and text.isprintable() else mapped(text.encode())


def has_run(text: str) -> bool:
    """Whether ``_RUN`` is in a text: the pattern stops at each blank, looking for a few strings takes a third of its time."""
    if any(map(text.__contains__, _OTHER)):
        return _RUN.search(text) is not None
    return any(map(text.__contains__, _PAIRS)) or text.endswith((" ", "\n"))


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit integers."""
    out = array("i", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Memo(dict):
    """From pieces to their ids, little-endian 32-bit integers; what isn't known is computed. There are two generations
    of at most ``size`` pieces: when the young one is full, it becomes the old one."""

    def __init__(self, encode: Callable[[str], bytes], size: int = MEMO):
        super().__init__()
        self.encode, self.size, self.old = encode, size, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts. findall: cuts a text into pre-tokens; encode: ids of a list of pre-tokens."""

    def __init__(self, findall: Callable[[str], list[str]], encode: Callable[[list[str]], bytes]):
        self.findall = findall
        self.pre = Memo(lambda p: encode([p]))
        # A piece of letters alone is one pre-token, with or without a blank before it.
        self.first = Memo(lambda p: encode([p] if p.isalpha() else findall(p)) if p else b"")
        self.rest = Memo(lambda p: encode([" " + p] if p.isalpha() else findall(" " + p)), MEMO_REST)
        self.line_end = encode(["\n"])

    def __call__(self, text: str) -> bytes:
        if has_run(text):
            return b"".join(map(self.pre.__getitem__, self.findall(text)))
        first, rest, lines = self.first.__getitem__, self.rest.__getitem__, []
        for line in text.split("\n"):
            head, *more = line.split(" ")
            lines.append(first(head) + b"".join(map(rest, more)))
        return self.line_end.join(lines)
