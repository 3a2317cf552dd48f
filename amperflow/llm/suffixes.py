"""Suffix arrays by induced sorting, in whole-array numpy steps, and permuted common prefixes.

Suffixes are of type S where they are less than the next one, else L; a leftmost S after an L is
LMS. Sorted LMS suffixes induce all L suffixes in one pass over the buckets of first characters,
upwards, and those induce all S suffixes in one pass downwards. Within a bucket a step handles all
suffixes that are ready at once; only runs of one character take further steps. LMS substrings are
sorted the same way: induced from their places in the text, then named; where names repeat, the
shorter string of names is sorted in turn.
"""

from __future__ import annotations

import numpy as np


def types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; ``t`` ends in its only 0."""
    n = len(t)
    first = np.flatnonzero(np.diff(t.astype(np.int32), prepend=-1))
    up = np.append(t[first[1:]] > t[first[:-1]], True)
    return np.repeat(up, np.diff(np.append(first, n)))


def _deal(into: list[list[np.ndarray]], found: np.ndarray, t: np.ndarray) -> None:
    """Append positions to the buckets of their characters, in order."""
    chars = t[found]
    order = np.argsort(chars, kind="stable")
    chars, found = chars[order], found[order]
    cut = np.flatnonzero(np.diff(chars)) + 1
    for part in np.split(found, cut):
        into[t[part[0]]].append(part)


def induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from LMS positions ``lms`` that are in order within each first character."""
    buckets: list[list[np.ndarray]] = [[] for _ in range(size)]
    lefts: list[list[np.ndarray]] = [[] for _ in range(size)]
    rights: list[list[np.ndarray]] = [[] for _ in range(size)]
    if len(lms):
        _deal(buckets, lms, t)
    for c in range(size):
        done = 0
        while done < len(lefts[c]) or buckets[c]:
            if done < len(lefts[c]):
                batch = lefts[c][done:]
                done = len(lefts[c])
                at = np.concatenate(batch) if len(batch) > 1 else batch[0]
            else:
                at, buckets[c] = np.concatenate(buckets[c]), []
            at = at[at > 0] - 1
            at = at[~s_type[at]]
            if len(at):
                _deal(lefts, at, t)
    for c in range(size - 1, -1, -1):
        done, left = 0, True
        while done < len(rights[c]) or left:
            if done < len(rights[c]):
                batch = rights[c][done:]
                done = len(rights[c])
                at = np.concatenate(batch) if len(batch) > 1 else batch[0]
            else:
                left = False
                if not lefts[c]:
                    continue
                at = np.concatenate(lefts[c])[::-1]
            at = at[at > 0] - 1
            at = at[s_type[at]]
            if len(at):
                _deal(rights, at, t)
    out = []
    for c in range(size):
        out += lefts[c]
        if rights[c]:
            out.append(np.concatenate(rights[c])[::-1])
    # The sentinel precedes all and is induced by none.
    return np.concatenate([[len(t) - 1], *out]) if out else np.array([len(t) - 1])


def _order_names(names: np.ndarray, most: int) -> np.ndarray:
    """Order of all suffixes of a string of names, by their first ``most`` names at least; each rank takes in twice as many names."""
    rank, n, width = names.astype(np.int64), len(names), 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - width if width < n else 0] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        if new.max() == n - 1 or 2 * width >= min(n, most):
            return order
        rank, width = new, width * 2


def suffix_array(data: np.ndarray, most: int | None = None) -> np.ndarray:
    """Start positions of the suffixes of a byte array, ascending (a prefix precedes what it begins).

    With ``most``, suffixes that agree on so many bytes may come in any order.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    t = np.empty(n + 1, np.int16)
    t[:-1] = data
    t[:-1] += 1
    t[-1] = 0
    s_type = types(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    size = int(t.max()) + 1
    if len(lms) > 1:
        is_lms = np.zeros(n + 1, bool)
        is_lms[lms] = True
        order = induce(t, s_type, lms, size)
        order = order[is_lms[order]]  # by LMS substring
        ends = np.append(lms[1:], n)  # where each substring's last character is
        index = np.empty(n + 1, np.int64)
        index[lms] = np.arange(len(lms))
        k = index[order]
        length = ends[k] - order
        same = np.zeros(len(order), bool)
        same[1:] = length[1:] == length[:-1]
        live = np.flatnonzero(same)
        step = 0
        while len(live):  # compare neighbours of equal length, one character after another
            a, b = order[live], order[live - 1]
            equal = t[a + step] == t[b + step]
            same[live[~equal]] = False
            live = live[equal & (length[live] > step)]
            step += 1
        names = np.empty(len(lms), np.int64)
        names[k] = np.cumsum(~same)
        if names.max() < len(lms):
            lms = lms[_order_names(names, len(names) * 2 if most is None else most // 2 + 2)]  # a name covers two bytes at least
        else:
            lms = order
    return induce(t, s_type, lms, size)[1:]


def permuted_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position, the length of the prefix that its suffix shares with the preceding one in
    ``order``, up to ``most``; computed in the order of positions, where memory is read in rows."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    # Eight bytes at a time; where they differ, the lowest differing byte ends the prefix.
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.ndarray((n + most + 8,), "<u8", padded.tobytes(), strides=(1,)).copy()
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for step in range(0, most, 8):
        x = words[live + step] ^ words[before[live] + step]
        same = x == 0
        other = x[~same]
        lowest = np.frexp((other & (~other + np.uint64(1))).astype(np.float64))[1] - 1
        shared[live[~same]] = step + (lowest >> 3)
        live = live[same]
        shared[live] = step + 8
    return np.minimum(np.minimum(shared, most), np.where(before >= 0, n - np.maximum(np.arange(n), before), 0))
