"""difflib's ratio of two texts (autojunk=False) without its work for each pair of equal characters, which is quadratic.

Blocks are chosen as there: the longest, of equal ones the first in a, then the first in b; then left and right of it.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np

Match = tuple[int, int, int]  # start in a, start in b, length
#: Ranges up to so many pairs of characters are left to difflib.
SMALL = 2048


def _ahead(a: str, i: int, b: str, j: int, most: int) -> int:
    """Of most characters from i in a and j in b, how many are equal before the first that isn't."""
    n, step = 0, 64
    while n < most:
        size = min(step, most - n)
        if a[i + n : i + n + size] == b[j + n : j + n + size]:
            n, step = n + size, step * 2
        else:
            most, step = n + size - 1, max(1, size // 2)
    return n


def _behind(a: str, i: int, b: str, j: int, most: int) -> int:
    """The same before i in a and j in b."""
    n, step = 0, 64
    while n < most:
        size = min(step, most - n)
        if a[i - n - size : i - n] == b[j - n - size : j - n]:
            n, step = n + size, step * 2
        else:
            most, step = n + size - 1, max(1, size // 2)
    return n


def _common(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(np.isin(a, b).any())


def _joint(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs (a1, a2) and (b1, b2), equal for equal pairs."""
    size = int(max(a2.max(initial=0), b2.max(initial=0))) + 1
    ids = np.unique(np.concatenate([a1 * size + a2, b1 * size + b2]), return_inverse=True)[1].astype(np.int64)
    return ids[: len(a1)], ids[len(a1) :]


def by_doubling(a: str, b: str) -> Match:
    """The longest block by numbers of all substrings of a length, for any texts in n log(n)^2."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (a, b))
    if not _common(x, y):
        return 0, 0, 0
    levels = [(x, y)]
    while (size := 1 << len(levels)) <= min(len(a), len(b)):
        x, y = levels[-1]
        x, y = _joint(x[: len(a) - size + 1], x[size // 2 :], y[: len(b) - size + 1], y[size // 2 :])
        if not _common(x, y):
            break
        levels.append((x, y))
    x, y = levels.pop()
    n = 1 << len(levels)
    for t in range(len(levels) - 1, -1, -1):
        size, (u, v) = n + (1 << t), levels[t]
        if size <= min(len(a), len(b)):
            p, q = len(a) - size + 1, len(b) - size + 1
            x2, y2 = _joint(x[:p], u[n : n + p], y[:q], v[n : n + q])
            if _common(x2, y2):
                x, y, n = x2, y2, size
    i = int(np.isin(x, y).argmax())
    return i, int((y == x[i]).argmax()), n


def longest(a: str, alo: int, ahi: int, b: str, blo: int, bhi: int) -> Match:
    """The longest block in two ranges. Blocks of a of w characters are looked up in b: a match of 2w - 1 or more holds one
    of them, so once one that long is found, so are all that can be chosen."""
    w, most = min(ahi - alo, bhi - blo), 1000 + ahi - alo + bhi - blo
    best = (0, 0, 0)  # length, -start in a, -start in b
    while w:
        upto: dict[int, int] = {}  # by difference of places: where the last match ends in a
        for p in range(alo, ahi - w + 1, w):
            word = a[p : p + w]
            q = b.find(word, blo, bhi)
            while q >= 0:
                most -= 1
                if upto.get(q - p, -1) < p + w:
                    left = _behind(a, p, b, q, min(p - alo, q - blo))
                    n = left + w + _ahead(a, p + w, b, q + w, min(ahi - p, bhi - q) - w)
                    upto[q - p] = p - left + n
                    best = max(best, (n, left - p, left - q))
                if most < 0:  # words that repeat
                    i, j, n = by_doubling(a[alo:ahi], b[blo:bhi])
                    return alo + i, blo + j, n
                q = b.find(word, q + 1, bhi)
        if best[0] >= 2 * w - 1:
            break
        w //= 2
    return -best[1], -best[2], best[0]


def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Twice the characters in blocks by those of both texts. Under least it can be any value under least."""
    both = len(a) + len(b)
    if not both:
        return 1.0
    far = lambda n: 2.0 * n / both < least  # noqa: E731  # no more than n can match
    if a == b or far(min(len(a), len(b))) or far(sum((Counter(a) & Counter(b)).values())):
        return 1.0 if a == b else 0.0
    found, open_ = 0, min(len(a), len(b))
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        alo, ahi, blo, bhi = ranges.pop()
        open_ -= min(ahi - alo, bhi - blo)
        if (ahi - alo) * (bhi - blo) <= SMALL:
            found += sum(m.size for m in SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks())
        else:
            i, j, n = longest(a, alo, ahi, b, blo, bhi)
            found += n
            for r in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)) if n else ():
                if r[0] < r[1] and r[2] < r[3]:
                    ranges.append(r)
                    open_ += min(r[1] - r[0], r[3] - r[2])
        if far(found + open_):
            return 0.0
    return 2.0 * found / both
