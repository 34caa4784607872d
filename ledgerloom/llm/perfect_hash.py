"""A minimal perfect hash over 128-bit keys, as bit vectors with ranks.

Level by level, every key left takes a slot of a bit vector about twice as long as there
are keys; slots taken by one key are set, keys that collided go on to the next level. A
key's number is the rank of its bit. About 3.7 bits a key.
"""

from __future__ import annotations

import io

import numpy as np

from .words import mix

ROOM, LEVELS = 2.0, 96


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h1 ^ mix(h2, 2 * level + 1), 2 * level) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """``find`` maps each key built on to its own number in 0..n-1, and any other key to -1 or some number."""

    def __init__(self, bits: np.ndarray, first: np.ndarray):
        self.bits, self.first = bits, first  # level l has the 64-bit words first[l]:first[l+1]
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """h1, h2: the words of distinct keys, as uint64."""
        levels: list[np.ndarray] = []
        while len(h1):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            size = 64 * max(1, int(np.ceil(len(h1) * ROOM / 64)))
            slot = _slot(h1, h2, len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[slot]
            h1, h2 = h1[left], h2[left]
        first = np.cumsum([0, *map(len, levels)])
        return cls(np.concatenate(levels) if levels else np.empty(0, np.uint64), first)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, dtype=np.int64)
        left = np.arange(len(h1))
        for level in range(len(self.first) - 1):
            if not len(left):
                break
            a, b = int(self.first[level]), int(self.first[level + 1])
            slot = _slot(h1[left], h2[left], level, 64 * (b - a))
            word, bit = self.bits[a + (slot >> 6)], (slot & 63).astype(np.uint64)
            here = ((word >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.rank[a + (slot >> 6)] + below)[here]
            left = left[~here]
        return out


class Shard:
    """Fingerprints and counts in the order of a perfect hash."""

    def __init__(self, keys: PerfectHash, fingerprint: np.ndarray, count: np.ndarray):
        self.keys, self.fingerprint, self.count = keys, fingerprint, count

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, count: np.ndarray) -> Shard:
        keys = PerfectHash.build(h1, h2)
        at = keys.find(h1, h2)
        fingerprint, counts = np.empty(len(h1), np.uint64), np.empty(len(h1), np.uint32)
        fingerprint[at], counts[at] = h2, np.minimum(count, 2**32 - 1)
        return cls(keys, fingerprint, counts)

    def counts(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Count of each key; 0 for keys that the shard doesn't hold."""
        at = self.keys.find(h1, h2)
        known = at >= 0
        known[known] = self.fingerprint[at[known]] == h2[known]
        out = np.zeros(len(h1), dtype=np.int64)
        out[known] = self.count[at[known]]
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bits=self.keys.bits, first=self.keys.first, fingerprint=self.fingerprint, count=self.count)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        x = np.load(io.BytesIO(raw))
        return cls(PerfectHash(x["bits"], x["first"]), x["fingerprint"], x["count"])
