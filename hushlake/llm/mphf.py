"""A minimal perfect hash of 64-bit keys: levels of bit arrays, numpy only."""

from __future__ import annotations

import numpy as np

from .common import mix

GAMMA = 2.0
LEVELS = 40
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    return (mix(keys ^ salt) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(sizes of the levels in bytes, their bits) for distinct keys; every key gets a slot of its own."""
    sizes, bits, left = [], [], keys
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, int(len(left) * GAMMA) + 7 & ~7)
        at = _slot(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size // 8)
        bits.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~alone[at]]
    if len(left):
        raise ValueError("keys are not distinct")
    return np.array(sizes, np.int32), b"".join(bits)


class Mphf:
    """Looks keys up: a number in 0..n-1 for each key of the set, some number or -1 for any other."""

    def __init__(self, sizes: np.ndarray, bits: bytes):
        self.sizes, self.bits = sizes, np.frombuffer(bits, np.uint8)
        self.rank = np.concatenate([[0], np.cumsum(_POP[self.bits], dtype=np.int64)])

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = _slot(keys[todo], level, int(size) * 8)
            byte, bit = base + (at >> 3), (at & 7).astype(np.uint8)
            b = self.bits[byte]
            hit = (b >> bit) & 1 == 1
            below = _POP[b[hit] & ((1 << bit[hit].astype(np.int64)) - 1).astype(np.uint8)]
            out[todo[hit]] = self.rank[byte[hit]] + below
            todo = todo[~hit]
            base += int(size)
        return out
