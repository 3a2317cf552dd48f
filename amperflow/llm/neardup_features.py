"""Circulant MinHash signatures and their bands."""

from __future__ import annotations

import numpy as np

from .shingles import mix

BANDS, ROWS = 28, 4
V = np.uint32


def shifted(x: np.ndarray, k: int) -> np.ndarray:
    """The second permutation of 32-bit numbers, circularly shifted by ``k``."""
    v = x - V(k)
    v ^= v >> V(16)
    v *= V(0x7FEB352D)
    v ^= v >> V(15)
    v *= V(0x846CA68B)
    v ^= v >> V(16)
    return v


def bands_of(hashes: np.ndarray, bounds: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys (sets x bands, int64) of non-empty sets of hashes.

    The first permutation spreads the hashes over 32-bit numbers; the second, shifted by 0, 1, 2,
    ..., gives all coordinates of the signature: each coordinate is the least value over the set.
    """
    first = (mix(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(V)
    starts = bounds[:-1]
    keys = np.empty((len(starts), bands), np.int64)
    for b in range(bands):
        key = np.full(len(starts), b + 1, np.uint64)
        for r in range(rows):
            least = np.minimum.reduceat(shifted(first, b * rows + r), starts)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        keys[:, b] = key.view(np.int64)
    return keys
