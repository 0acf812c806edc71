"""Signatures for near-duplicate detection: shingle sets, one-permutation hashing, optimal densification, bands."""

from __future__ import annotations

import numpy as np

from .kernel import NOT_WHITE, U, Words, grams, letters, mix, salts

SHINGLE, ROWS, BANDS = 5, 4, 32
EMPTY = U(0xFFFFFFFFFFFFFFFF)
_TABLE = letters(True)


def shingle_sets(data: np.ndarray, ends: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, ascending, one document after another, and their offsets.

    A document of fewer than ``n`` words, but not none, has one shingle: all its words.
    """
    words = Words(data, ends, NOT_WHITE)
    h = words.hashes(_TABLE)
    runs = grams(h, n, 5)
    doc = words.doc[: len(runs)]
    inside = doc == words.doc[n - 1 :] if len(runs) else np.zeros(0, bool)
    value, owner = runs[inside], doc[inside]
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short):
        few = np.zeros(len(short), U)
        for k, s in enumerate(salts(n, 6)):
            has = words.count[short] > k
            few[has] += h[words.first[short[has]] + k] * s
        value = np.concatenate([value, mix(few ^ words.count[short].astype(U))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(ends) - 1))])


def signatures(value: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures: the least hash in each of ``bins`` ranges; an empty bin copies the first full one of its own
    sequence of bins, which depends on the bin alone, so equal sets and equal parts of sets agree. Rows of empty sets are EMPTY."""
    docs = len(at) - 1
    out = np.full((docs, bins), EMPTY)
    h = mix(value ^ U(0xA0761D6478BD642F))
    cell = np.repeat(np.arange(docs), np.diff(at)) * bins + ((h >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    order = np.lexsort((h, cell))
    first = np.ones(len(cell), bool)
    first[1:] = cell[order][1:] != cell[order][:-1]
    out.ravel()[cell[order][first]] = h[order][first]
    full = out != EMPTY
    row, col = np.nonzero(~full & full.any(1)[:, None])
    attempt = np.zeros(1, U)
    while len(row):
        attempt += U(1)
        probe = ((mix(np.arange(bins, dtype=U) * U(0x9E3779B97F4A7C15) + attempt * U(0xE7037ED1A0B428DB)) >> U(32)) * U(bins) >> U(32)).astype(np.int64)[col]
        hit = full[row, probe]
        out[row[hit], col[hit]] = out[row[hit], probe[hit]]
        row, col = row[~hit], col[~hit]
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` bins, told apart by band."""
    docs, bins = signature.shape
    key = np.zeros((docs, bins // rows), U)
    for k, s in enumerate(salts(rows, 9)):
        key += signature[:, k::rows][:, : bins // rows] * s
    return mix(key + salts(bins // rows, 10))
