"""Ids of chunks that are looked up, whatever the encoder has kept or let go since."""

import numpy as np
import pytest

from hushlake.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_words_are_kept_over_a_change_of_halves_and_with_marks():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = packing.ChunkEncoder(path)
    enc.LIMIT = 8
    texts = ["often again, often", *[f"often word{chr(97 + i)}x{chr(97 + i)}" for i in range(20)], "again often. été, été ÉTÉ!?", "", " a  b\n\nc ", "x<|y"]
    for t in texts:
        assert enc.encode(t) == np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(enc.seen) + len(enc.old) <= enc.LIMIT
    enc = packing.ChunkEncoder(path)
    enc.LIMIT, merged, tried = 8, enc._merged, []
    enc._merged = lambda x: tried.append(x) or merged(x)
    for w in ("aa", "bb", "cc", "dd", "ee", "ff", "gg"):
        enc.encode(f"x often {w} often,")
    assert tried.count(enc.space + "often") == 1
