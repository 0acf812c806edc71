"""Vectorised text kernels on Arrow buffers: slicing, word boundaries and 64-bit hashes by numpy.

All hashes are taken modulo 2^64 from prefix sums, so a whole slice of documents is hashed without a
Python loop over words. Bytes map to random 64-bit values first and every result is mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix's finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(_BASE) + U(seed)) | U(1)


def letters(fold_case: bool) -> np.ndarray:
    """The 64-bit value of each byte; with ``fold_case`` A-Z have those of a-z."""
    table = salts(256, 77)
    if fold_case:
        table[65:91] = table[97:123]
    return table


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that are anything but ASCII white space.
NOT_WHITE = ~WHITE
#: Bytes of words of digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class _Powers:
    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            for name, b in (("up", _BASE), ("down", inverse)):
                p = np.full(size, U(b & (2**64 - 1)), U)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after another, and the offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slices(ends: np.ndarray, limit: int):
    """Cuts values into runs of whole values of about ``limit`` bytes: (first, last + 1)."""
    first, n = 0, len(ends) - 1
    while first < n:
        last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class Words:
    """The words of some documents: first byte, end, document number; and their hashes."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, inside: np.ndarray):
        self.data, self.ends = data, ends
        n = len(data)
        isin = inside[data]
        first = ends[:-1]
        before = np.zeros(n, bool)
        before[1:] = isin[:-1]
        before[first[first < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = isin[1:]
        last = ends[1:] - 1
        after[last[last >= 0]] = False
        self.start = np.flatnonzero(isin & ~before)
        self.end = np.flatnonzero(isin & ~after) + 1
        at = np.searchsorted(self.start, ends)
        self.count = np.diff(at)
        self.first = at[:-1]
        self.doc = np.repeat(np.arange(len(ends) - 1), self.count)

    def hashes(self, table: np.ndarray) -> np.ndarray:
        """Polynomial hashes, added up over runs of ``CHUNK`` bytes: memory doesn't grow with the texts."""
        up, down = _Powers.get(CHUNK)
        out = np.zeros(len(self.start), U)
        for c in range(0, len(self.data), CHUNK):
            part = self.data[c : c + CHUNK]
            h = np.zeros(len(part) + 1, U)
            np.cumsum(table[part] * up[: len(part)], out=h[1:])
            a, b = np.searchsorted(self.end, c, "right"), np.searchsorted(self.start, c + len(part))
            if a == b:
                continue
            first = np.maximum(self.start[a:b] - c, 0)
            own = (h[np.minimum(self.end[a:b] - c, len(part))] - h[first]) * down[first]
            if self.start[a] < c:  # a word that began in an earlier run
                own[:1] *= U(pow(_BASE, c - int(self.start[a]), 1 << 64))
            out[a:b] += own
        return mix(out + (self.end - self.start).astype(U) * U(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours in ``h``; runs are told apart by order."""
    out = np.zeros(max(0, len(h) - n + 1), U)
    for k, s in enumerate(salts(n, seed)):
        out += h[k : len(h) - n + 1 + k] * s
    return mix(out)
