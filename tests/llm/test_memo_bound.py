"""What a Python worker of the byte-level BPE operators keeps has a bound."""

from foliolake.llm.pretokens import Encoder, packed


def test_memos_are_small_and_ids_the_same():
    coder = Encoder(str.split, lambda tokens: packed([len(t) for t in tokens]))
    words = [f"w{k}" for k in range(450_000)]
    assert coder(" ".join(words)) == packed([len(w) + (k > 0 and w.isalpha()) for k, w in enumerate(words)])
    memos = (coder.pre, coder.first, coder.rest)
    assert all(len(m) + len(m.old) <= 2 * m.size for m in memos) and sum(2 * m.size for m in memos) <= 900_000
