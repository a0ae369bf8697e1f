"""Character n-grams of many words at once, hashed into buckets; shared by the text classifiers."""

from __future__ import annotations

import numpy as np

from .common import mix


def bags(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bucket ids, word indices), sorted by word: the n-grams of '<word>' and, if whole, the word itself."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(ends, lengths) - np.arange(len(chars))
    ids, own = [], []
    rolling = np.zeros(len(chars), np.uint64)
    for n in range(1, max(sizes) + 1):
        # after n steps rolling[i] hashes chars[i:i+n]
        ahead = chars[n - 1 :]
        rolling = mix(rolling[: len(ahead)] * np.uint64(0x100000001B3) + ahead + np.uint64(n << 24))
        if n in sizes:
            at = np.nonzero(room[: len(rolling)] >= n)[0]
            ids.append(rolling[at] % np.uint64(buckets))
            own.append(owner[at])
    if whole:
        power = mix(chars + np.uint64(0x51ED270B))
        place = np.arange(len(chars)) - np.repeat(ends - lengths, lengths)
        total = np.add.reduceat(power * (np.uint64(2) * mix(place.astype(np.uint64) + np.uint64(77)) + np.uint64(1)), ends - lengths)
        ids.append(mix(total) % np.uint64(buckets))
        own.append(np.arange(len(words)))
    ids, own = np.concatenate(ids).astype(np.int64), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return ids[order], own[order]


def plain(token: str) -> str:
    """A token as the classifiers read it: lower case, letters and digits only; may be empty."""
    if token.isalnum():
        return token.lower()
    return "".join(c for c in token.lower() if c.isalnum())
