"""Words of many texts at once, as hashes in numpy arrays.

Tasks work on Arrow string columns. ``pieces`` cuts a column into runs of whole texts of about
a megabyte, and ``Words`` finds the words of such a run and a 64-bit hash of each, without a
Python object per word. A word is a maximal run of bytes that are not separators; separators
are ASCII, so UTF-8 letters are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
"""Separators of ``[^\\x20\\x09-\\x0D]+``."""

NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x80:] = False
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
"""Separators that leave runs of ASCII letters, digits and all characters beyond ASCII."""

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


LETTER_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_BASE = np.uint64(0x2545F4914F6CDD1D)


def _powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its texts; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """``start``, ``end`` (byte places), ``doc`` and ``hash`` of every word of a run of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, lower: bool = True):
        self.data, self.offsets, n = data, offsets, len(data)
        inside = ~separator[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.count = np.diff(np.searchsorted(self.start, offsets))
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.hash = self._hash(inside, lower)

    def _hash(self, inside: np.ndarray, lower: bool) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        letters = self.data[inside]
        place = np.arange(len(letters)) - np.repeat(begin, length)
        value = LETTER_CODE[LOWER[letters] if lower else letters] * _powers(int(length.max()))[place]
        return mix(np.add.reduceat(value, begin) + length.astype(np.uint64))

    def grams(self, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and the index of that word; none crosses texts.

        ``skip`` words are left out after the first.
        """
        span = n + skip
        if len(self.hash) < span:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        last = len(self.hash) - span + 1
        out = np.full(last, n * 1000 + skip, np.uint64)
        for k in [0, *range(1 + skip, span)]:
            out = out * _BASE + self.hash[k : k + last]
            out ^= out >> np.uint64(31)
        at = np.flatnonzero(self.doc[:last] == self.doc[span - 1 :])
        return mix(out[at]), at
