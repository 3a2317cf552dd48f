"""Word shingles of whole texts as 64-bit hashes, computed over byte buffers."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(101)).integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(v: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers."""
    v = v ^ (v >> U(32))
    v = v * U(0xD6E8FEB86659FD93)
    v ^= v >> U(32)
    v *= U(0xD6E8FEB86659FD93)
    v ^= v >> U(32)
    return v


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text): words are runs of other than ASCII white space, A-Z lower-cased."""
    space = _SPACE[data]
    inside = ~space
    begin = inside.copy()
    begin[1:] &= space[:-1]
    firsts = ends[:-1][np.diff(ends) > 0]
    begin[firsts] = inside[firsts]  # no word runs from one text into the next
    start = np.flatnonzero(begin)
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))) if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))])
    powers = np.empty(int(place.max()) + 1, np.uint64)
    powers[:] = U(0x9E3779B97F4A7C15)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    value = _BYTE[_LOWER[data]]
    value *= powers[place]
    value[space] = 0
    return mix(np.add.reduceat(value, start)), np.searchsorted(ends, start, side="right") - 1


def shingle_hashes(data: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text k's distinct ``n``-word shingles, ascending, are ``hashes[bounds[k]:bounds[k + 1]]``.

    A text of fewer words has its whole sequence as one shingle; a text without a word has none.
    """
    words, doc = word_hashes(data, ends)
    count = np.bincount(doc, minlength=len(ends) - 1)
    at = np.cumsum(count) - count
    keys = mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    for j in range(n):
        total += padded[j : j + len(words)] * keys[j]
    total = mix(total)
    parts, bounds = [], np.zeros(len(count) + 1, np.int64)
    for k, (a, c) in enumerate(zip(at.tolist(), count.tolist(), strict=True)):
        if c >= n:
            own = np.unique(total[a : a + c - n + 1])
        elif c:
            whole = (words[a : a + c] * keys[:c]).sum(keepdims=True, dtype=np.uint64)
            own = mix(whole + np.array([c], np.uint64))
        else:
            own = words[:0]
        parts.append(own)
        bounds[k + 1] = bounds[k] + len(own)
    return np.concatenate(parts) if parts else words[:0], bounds
