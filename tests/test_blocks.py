"""Longest matching blocks as difflib chooses them, without its quadratic work."""

import random
from difflib import SequenceMatcher

from hushlake.functions import blocks


def wanted(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def cases(n=250):
    r = random.Random(5)
    words = ["aa", "ab", "ba", "x", " ", "lorem", "ipsum", "é", "\U0001f600", "aaaaaaaa"]
    for _ in range(n):
        a = "".join(r.choice(words) for _ in range(r.randint(0, 160)))
        b = list(a)
        for _ in range(r.choice((0, 1, 4, 30))):
            b[r.randint(0, len(b)) : r.randint(0, len(b))] = r.choice(words)
        yield a, "".join(b)
        yield a, "".join(r.choice(words) for _ in range(r.randint(0, 160)))


def test_ratio_is_that_of_difflib(monkeypatch):
    for small in (blocks.SMALL, 0):  # 0: nothing is left to difflib
        monkeypatch.setattr(blocks, "SMALL", small)
        for a, b in cases():
            want = wanted(a, b)
            assert blocks.ratio(a, b) == want
            near = blocks.ratio(a, b, 0.85)
            assert near == want if want >= 0.85 else near < 0.85


def test_longest_block_of_equal_ones_is_the_first():
    for a, b in cases():
        m = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        want = tuple(m) if m.size else (0, 0, 0)
        assert blocks.by_doubling(a, b) == want and blocks.longest(a, 0, len(a), b, 0, len(b)) == want


def test_long_texts_need_no_quadratic_work(monkeypatch):
    """difflib sees small ranges alone; 100,000 characters of few kinds took it a minute or more."""
    seen = []
    monkeypatch.setattr(blocks, "SequenceMatcher", lambda j, a, b, autojunk: seen.append(len(a) * len(b)) or SequenceMatcher(j, a, b, autojunk=autojunk))
    r = random.Random(1)
    a = "".join(r.choice("abcd ") for _ in range(100_000))
    b = a[:25_000] + "X" + a[25_000:60_000] + "YZ" + a[60_100:]
    assert blocks.ratio(a, b) == 2 * 99_900 / (len(a) + len(b)) and all(x <= blocks.SMALL for x in seen)
    assert blocks.ratio("ab" * 5_000 + "x" + "ab" * 5_000, "ab" * 5_000 + "y" + "ab" * 5_000) == 2 * 20_000 / 40_002
    assert blocks.ratio("ab " * 9000, "xyz" * 9000, 0.85) == 0.0
