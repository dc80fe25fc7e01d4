"""Whole-batch text primitives in numpy: UTF-8 bytes of an Arrow column, words, word hashes and shingle sets.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. Its hash takes in eight bytes at a
time and mixes after each, so it is linear in nothing; words of over ``LONG`` bytes are hashed by blake2b. Hashes of
several words chain those of the words in the same way. Two seeds give two independent hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that part plain tokens: ASCII that is neither letter nor digit.
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []
LONG = 256
#: The low k bytes of a 64-bit number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n at least, for hashes that only route."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 20, 1 << int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.full(size, b, U64) for b in (_BASE, inverse)]
        for p in _powers:
            p[0] = 1
            np.cumprod(p, out=p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64 bits."""
    h = h ^ (h >> U64(31))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(32))


def chained(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each ``data[start:end]``."""
    size = end - start
    out = mix(size.astype(U64) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
    alive = np.flatnonzero((size > 0) & (size <= LONG))
    t = 0
    while len(alive):
        left = size[alive] - t
        out[alive] = mix(out[alive] ^ (eight[start[alive] + t] & _LOW[np.minimum(left, 8)]))
        t += 8
        alive = alive[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return out


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column, "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes; a longer row stands alone, whole."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """Words of a slice: ``start`` and ``end`` in its bytes, ``hash``, and ``at``, the first word of each row (and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR, seed: int = 0):
        n = len(data)
        if n == 0:
            self.start = self.end = np.empty(0, np.int64)
            self.hash, self.at = np.empty(0, U64), np.zeros(len(offsets), np.int64)
            return
        inside = ~separator[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.empty(n, bool)
        before[0], before[1:] = True, ~inside[:-1]
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, ~inside[1:]
        self.start = np.flatnonzero(inside & (before | cut[:-1]))
        self.end = np.flatnonzero(inside & (after | cut[1:])) + 1
        self.hash = chained(_LOWER[data], self.start, self.end, seed)
        self.at = np.searchsorted(self.start, offsets)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (k - 1 fewer than words)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, k, U64)
    for i in range(k):
        out = mix(out + U64(0xD6E8FEB86659FD93) ^ hashes[i : i + n])
    return out


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-word shingle; fewer than k words: the whole sequence is the one shingle."""
    counts = np.diff(words.at)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), n)
    whole = runs(words.hash, k)
    first = np.cumsum(n) - n
    out = np.empty(int(n.sum()), U64)
    long = np.repeat(counts >= k, n)
    where = np.arange(len(out)) - np.repeat(first, n) + np.repeat(words.at[:-1], n)
    out[long] = whole[where[long]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        out[first[i]] = runs(words.hash[words.at[i] : words.at[i + 1]], int(counts[i]))[0]
    return row, out


def shingle_sets(words: Words, k: int = 5, other: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(hashes, at, others): row i's distinct k-word shingles, ascending, are ``hashes[at[i]:at[i + 1]]``; ``others`` are their hashes by ``other``.

    Fewer than k words: the whole sequence is the one shingle. No words: an empty set.
    """
    row, out = shingle_hashes(words, k)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    others = shingle_hashes(other, k)[1][order[fresh]] if other is not None else None
    out, row = out[fresh], row[fresh]
    return out, np.searchsorted(row, np.arange(len(words.at))), others
