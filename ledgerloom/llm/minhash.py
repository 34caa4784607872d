"""Circulant MinHash signatures of word-shingle sets.

A first permutation spreads shingles over a circle of positions; a second one gives
every position a rank. Coordinate k of a signature is the least rank found when the
set's positions are shifted by k, so two permutations make all coordinates.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .words import mix

#: Positions of the circle, coordinates of a signature, how many of them are banded, and how many make a band.
CIRCLE_BITS, COORDINATES, BANDED, ROWS = 20, 512, 128, 4
BANDS = BANDED // ROWS


@lru_cache(maxsize=1)
def _circle() -> np.ndarray:
    ranks = np.random.default_rng(20240229).permutation(1 << CIRCLE_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: COORDINATES - 1]]), COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES least ranks of a non-empty set of 64-bit shingles."""
    circle, at = _circle(), (mix(shingles, 11) >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
    out = circle[at[:512]].min(axis=0)
    for k in range(512, len(at), 512):
        np.minimum(out, circle[at[k : k + 512]].min(axis=0), out=out)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """64-bit band keys (n, BANDS) of signatures (n, COORDINATES)."""
    keys = np.zeros((len(signatures), BANDS), dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    rows = signatures[:, :BANDED].reshape(len(signatures), BANDS, ROWS)
    for r in range(ROWS):
        keys = mix(keys ^ rows[:, :, r].astype(np.uint64), r + 1)
    return keys


def sketch(signatures: np.ndarray) -> np.ndarray:
    """The low byte of every coordinate; equal bytes estimate the similarity."""
    return signatures.astype(np.uint8)
