"""Words, windows and hashes of many texts at once, in numpy.

A batch's texts are joined into one byte array. Word hashes come from prefix sums of a polynomial over that
array, so the work per byte does not depend on the words. All hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are taken in groups of about so many bytes; a longer text makes a group of its own.
GROUP_BYTES = 2_000_000
#: Rows that Arrow hands over at once.
ARROW_ROWS = 512

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        m = max(n, GROUP_BYTES + 65536)
        have = np.full(m, U(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if m <= 8 * GROUP_BYTES:
            _POWERS[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray, lut: np.ndarray = _BYTE) -> np.ndarray:
    """Prefix sums with a leading 0 from which `range_hash` takes the hash of any range."""
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum(lut[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges; equal bytes have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(_UNBASE, len(prefix))[start] + (end - start).astype(U))


def groups(texts: list[bytes], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield at, i
            at, size = i, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, len(texts)


class Words:
    """The words of some texts: `start`, `end` (in the joined bytes), `doc` (the text's number), `count` by text."""

    def __init__(self, texts: list[bytes], fold: bool = False):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = _FOLD[data] if fold else data
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1]
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))[:-1]

    def hashes(self) -> np.ndarray:
        return range_hash(prefix_hash(self.data), self.start, self.end)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each run of n words inside one text, and the number of its first word."""
        h = self.hashes()
        if len(h) < n:
            return np.empty(0, U), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(h) - n + 1])
        out = np.zeros(len(h) - n + 1, U)
        for k in range(n):
            out += h[k : len(h) - n + 1 + k] * U(pow(_BASE, k + 1, 1 << 64))
        return mix(out[at]), at
