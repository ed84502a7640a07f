import random

import pyarrow as pa
import pytest

from tests.llm.brute import words as plain
from themeloom.llm.words import pieces


@pytest.mark.parametrize("limit", [10, 1000, 1 << 22])
def test_words_and_fingerprints(limit):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "a b\tc\n", "é ü\x0b x\x1cy\x85z q a", "a" * 300_000 + " b " + "a" * 300_000]
    texts += ["".join(rng.choice("ab é\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    seen, row = {}, 0
    for piece in pieces(pa.array(texts), limit):
        for i in range(len(piece)):
            a, b = piece.begins[i], piece.begins[i + 1]
            got = [bytes(piece.data[s:e]).decode() for s, e in zip(piece.starts[a:b], piece.ends[a:b], strict=True)]
            assert got == plain(texts[row])
            for word, mark in zip(got, piece.marks[a:b], strict=True):
                assert seen.setdefault(word, mark) == mark
            row += 1
    assert row == len(texts) and len(set(seen.values())) == len(seen)
