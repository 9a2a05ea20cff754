"""Word and shingle hashes of whole texts, vectorised over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z
lowered; nothing else is normalised, so non-ASCII letters keep their bytes. A
word's hash is a polynomial over its bytes modulo 2**64, read off one prefix
sum over the whole buffer and then mixed; a shingle's hash combines the hashes
of its words in order. Texts are taken in chunks of ``CHUNK`` bytes, so memory
is bounded by the chunk or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (multiply and shift finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            up = np.full(n, _BASE, dtype=np.uint64)
            down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up), np.cumprod(down)
        return cls.up[:n], cls.down[:n]


def _large(column) -> pa.LargeStringArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string())


def chunks(column, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, byte offsets of the rows); nulls are empty."""
    texts = _large(column)
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the words before each row (one more than rows)."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    word = ~_SPACE[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0], before[1:] = False, word
    after = np.empty(len(data) + 1, dtype=bool)
    after[-1], after[:-1] = False, word
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every lowered word."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _Powers.get(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from every position on; the last k - 1 positions are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + words[i : i + n]
    return mix(out)


def word_hashes(column, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, words before each row)."""
    for first, last, data, offsets in chunks(column, limit):
        starts, ends, rows = spans(data, offsets)
        yield first, last, hashes(data, starts, ends), rows


def shingle_sets(column, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per row of the column: (row, its distinct shingle hashes, ascending).

    A text with fewer than ``k`` words is one shingle of all its words; one
    without words (or null) has none.
    """
    for first, last, words, rows in word_hashes(column):
        every = shingles(words, k)
        for i in range(last - first):
            a, b = int(rows[i]), int(rows[i + 1])
            if b - a >= k:
                yield first + i, np.unique(every[a : b - k + 1])
            elif b > a:
                yield first + i, shingles(words[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield first + i, np.zeros(0, dtype=np.uint64)
