"""Vectorised word and word-window hashing over a batch of UTF-8 texts.

A batch of texts is one byte array; every step below is a numpy pass over that
array, so no Python code runs per word.  Words are maximal runs of bytes other
than ``[\\x20\\x09-\\x0D]``.  A hash is a sum modulo 2**64 of randomised values, each
times a random odd coefficient of its place (multilinear hashing), finished by a
mixing step; no structure of a word, such as a pattern that cancels the powers of
a base, makes two of them equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def coefficients(n: int, salt: int) -> np.ndarray:
    """Odd coefficients of places 0 .. n-1; those of other salts are others."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xD1B54A32D192ED03) + _U(salt)) | _U(1)


def byte_ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the byte ranges start[i]:end[i], which do not overlap and are in order; ``values`` are those of the bytes."""
    size = end - start
    ends = np.cumsum(size)
    if not len(size) or not ends[-1]:
        return mix(np.zeros(len(size), dtype=_U))
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    total = np.zeros(ends[-1] + 1, dtype=_U)
    np.cumsum(values[place + np.repeat(start, size)] * coefficients(int(size.max()), 1)[place], out=total[1:])
    return mix(total[ends] - total[ends - size] + size.astype(_U))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch: ``hash[i]``, byte range ``start[i]:end[i]``; document d has words ``first[d]:first[d + 1]``."""

    def __init__(self, column, lower: bool = False):
        raw, offsets = text_bytes(column)
        if lower:
            raw = _LOWER[raw]
        self.raw, n = raw, len(raw)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[raw]
        edge = inside[1:] != inside[:-1]
        at = np.flatnonzero(edge)
        # Texts are adjacent in the array, so a text's first byte also begins a word.
        borders = offsets[1:-1]
        borders = np.unique(borders[(borders > 0) & (borders < n)])
        split = borders[inside[borders] & inside[borders + 1]] if len(borders) else borders
        self.start = np.sort(np.concatenate([at[0::2], split]))
        self.end = np.sort(np.concatenate([at[1::2], split]))
        self.first = np.searchsorted(self.start, offsets)
        self.hash = byte_ranges(_BYTE[raw], self.start, self.end)

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int, salt: int = 2) -> np.ndarray:
        """Hash of words i .. i+k-1 for every i with k words left in the batch (not in the document)."""
        n = len(self.hash) - k + 1
        total = np.full(max(n, 0), k, dtype=_U)
        for j, c in enumerate(coefficients(k, salt)):
            total += self.hash[j : j + n] * c if n > 0 else total
        return mix(total)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the short word ranges begin[i]:end[i]; depends on the words and their order alone."""
        size = end - begin
        total = size.astype(_U)
        for j, c in enumerate(coefficients(int(size.max(initial=0)), 3)):
            on = np.flatnonzero(size > j)
            total[on] += self.hash[begin[on] + j] * c
        return mix(total)

    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self)), self.counts())


def shingle_sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct k-word shingles, sorted by document, then hash.

    A document of 1 to k-1 words has one shingle, its whole sequence; one without words has none.
    """
    counts = words.counts()
    doc = words.owner()
    h = words.windows(k)
    place = np.arange(len(h))
    whole = place + k <= words.first[doc[: len(h)] + 1]
    short = np.flatnonzero((counts > 0) & (counts < k))
    d = np.concatenate([doc[: len(h)][whole], short])
    x = np.concatenate([h[whole], words.spans(words.first[short], words.first[short + 1])])
    order = np.lexsort((x, d))
    d, x = d[order], x[order]
    keep = np.ones(len(d), dtype=bool)
    keep[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return d[keep], x[keep]
