"""Suffix arrays by induced sorting, in numpy, and the common prefixes of neighbouring suffixes.

Suffixes are classified as larger (L) or smaller (S) than their successor. The leftmost smaller ones (LMS) start substrings
that one induction sorts; equal substrings get equal names, and the order of the named string, found by doubling
ranks, is the order of the LMS suffixes. A last induction, linear in the text, gives the whole array. An induction goes
through the byte values once up and once down; all suffixes that a value's bucket holds induce at once.
"""

from __future__ import annotations

import numpy as np

from .vector import U, prefix_hash, range_hash


def classified(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smaller, lms): whether each suffix is smaller than its successor, and the leftmost smaller ones in order."""
    n = len(s)
    less = np.zeros(n, bool)
    less[:-1] = s[:-1] < s[1:]
    differs = np.ones(n, bool)
    differs[:-1] = s[:-1] != s[1:]
    at = np.where(differs, np.arange(n), n)
    smaller = less[np.minimum.accumulate(at[::-1])[::-1]]
    return smaller, np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _dealt(j: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions grouped by byte in order, their bytes, the rank inside the group, and the group sizes."""
    order = np.argsort(c, kind="stable")
    size = np.bincount(c, minlength=256)
    j, c = j[order], c[order]
    return j, c, np.arange(len(j)) - (np.cumsum(size) - size)[c], size


def induced(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array from LMS suffixes in order (or, from any order, one that is right up to LMS substrings)."""
    n = len(s)
    size = np.bincount(s, minlength=256)
    head = np.cumsum(size) - size
    tail = head + size
    begin, end = head.copy(), tail.copy()
    out = np.full(n, -1, np.int64)
    dealt, c, rank, count = _dealt(lms, s[lms])
    out[tail[c] - count[c] + rank] = dealt
    seeds = tail - count

    def put(j: np.ndarray) -> None:
        j, c, rank, count = _dealt(j, s[j])
        out[head[c] + rank] = j
        head[:] += count

    put(np.array([n - 1]))
    values = np.flatnonzero(size)
    for v in values:
        done = begin[v]
        while done < head[v]:
            j = out[done : head[v]] - 1
            done = head[v]
            j = j[j >= 0]
            put(j[~smaller[j]])
        put(out[seeds[v] : end[v]] - 1)

    larger_end = head.copy()
    for v in values:
        out[larger_end[v] : end[v]] = -1

    def put_last(j: np.ndarray) -> None:
        j, c, rank, count = _dealt(j, s[j])
        out[tail[c] - 1 - rank] = j
        tail[:] -= count

    for v in values[::-1]:
        done = end[v]
        while done > tail[v]:
            j = out[tail[v] : done][::-1] - 1
            done = tail[v]
            j = j[j >= 0]
            put_last(j[smaller[j]])
        j = out[begin[v] : larger_end[v]][::-1] - 1
        j = j[j >= 0]
        put_last(j[smaller[j]])
    return out


def _ranked(names: np.ndarray, most: int) -> np.ndarray:
    """The order of the named string's suffixes by doubling ranks, as far as `most` names from each."""
    n, rank, k = len(names), names.astype(np.int64) + 1, 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-k] = rank[k:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], key[order][1:] != key[order][:-1])))
        rank, k = new, 2 * k
        if k >= most or k >= n or new[order[-1]] == n:
            return order


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Where the suffixes of a byte array start, in order; with `depth`, suffixes equal in so many bytes may stand in any order."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    smaller, lms = classified(s)
    if len(lms) < 2:
        return induced(s, smaller, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = induced(s, smaller, lms)
    by_substring = by_substring[is_lms[by_substring]]
    stop = np.minimum(np.concatenate((lms[1:] + 1, [n])), n)
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    of = number[by_substring]
    h = range_hash(prefix_hash(s), lms, stop)
    h[-1] ^= U(1)  # the last one reaches the end, as no other does
    names = np.empty(len(lms), np.int64)
    names[of] = np.cumsum(np.concatenate(([0], h[of][1:] != h[of][:-1])))
    if names[of[-1]] + 1 == len(lms):
        return induced(s, smaller, by_substring)
    return induced(s, smaller, lms[_ranked(names, len(lms) if depth is None else depth // 2 + 2)])


def permuted_prefixes(s: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """By text position: how many bytes the suffix shares with its predecessor in the array, up to `most`."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    wide = np.zeros(n + most + 8, np.uint8)
    wide[:n] = s
    words = np.ndarray(n + most, "<u8", wide.data, strides=(1,))
    shared = np.zeros(n, np.int64)
    at = np.flatnonzero(before >= 0)
    for k in range(0, most, 8):
        gap = words[at + k] ^ words[before[at] + k]
        same = gap == 0
        part = at[~same]
        low = gap[~same] & (~gap[~same] + U(1))
        shared[part] = k + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        at = at[same]
        shared[at] = k + 8
    return np.minimum(shared, np.minimum(most, np.where(before >= 0, n - np.maximum(before, np.arange(n)), 0)))
