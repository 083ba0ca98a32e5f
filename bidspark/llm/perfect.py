"""Minimal perfect hashing of distinct 64-bit keys: cascades of bit arrays, one for each bucket of keys.

At each level the keys left over are hashed to twice as many places; those alone at their place set its bit and are done. A key's
number is the count of bits set before its own, so n keys get the numbers 0 to n - 1. Keys that were not among
those hashed get some number too: callers compare the key that stands there.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SPREAD = 2  # places for each key left over


def scramble(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(U) + U((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Perfect:
    """A minimal perfect hash: its levels' bits in one packed array."""

    def __init__(self, sizes: np.ndarray, packed: np.ndarray):
        self.sizes = sizes
        self.edge = np.append(0, np.cumsum(sizes))
        self.bits = np.unpackbits(packed, count=int(self.edge[-1])).view(bool)
        self.rank = np.append(0, np.cumsum(self.bits)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> Perfect:
        """Of distinct keys."""
        left, sizes, levels = np.asarray(keys).astype(U), [], []
        while len(left):
            size = max(64, SPREAD * len(left))
            at = (scramble(left, len(sizes) + 1) % U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(bits))

    @property
    def packed(self) -> np.ndarray:
        return np.packbits(self.bits)

    def __len__(self) -> int:
        return int(self.rank[-1])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1 for some keys that were not hashed."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        keys = np.asarray(keys).astype(U)
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = (scramble(keys[left], level + 1) % U(size)).astype(np.int64) + self.edge[level]
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out
