"""Vectorised words and word hashes of an Arrow text column (numpy, inside tasks).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit polynomials over
the word's bytes, mixed at the end; they pick buckets, orders and shingle identities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
# The finaliser constants of the public 64-bit murmur mix.
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S33)
    h *= _MIX_1
    h ^= h >> _S33
    h *= _MIX_2
    h ^= h >> _S33
    return h


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        x = np.full(size, base & (1 << 64) - 1, dtype=np.uint64)
        x[0] = 1
        _powers[kind] = have = np.cumprod(x, dtype=np.uint64)
    return have[:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offsets of each text in them; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    off = off.astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]] if len(off) else data[:0], off - off[0]


class Words:
    """Words of a run of texts. ``data`` holds every word followed by exactly one space; word ``i`` is
    ``data[start[i]:start[i + 1] - 1]``, and text ``d`` has the words ``first[d]`` to ``first[d + 1]``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        n = len(data)
        word = ~SPACE[data]
        last = word.copy()
        if n:
            last[:-1] &= ~word[1:]
            ends = off[1:][off[1:] > off[:-1]] - 1
            last[ends] = word[ends]
        # each word's bytes, then one space in place of what follows it
        size = np.cumsum(word) + np.concatenate(([0], np.cumsum(last)[:-1])) if n else np.zeros(0, np.int64)
        end = np.flatnonzero(last)
        out = np.full(int(size[end[-1]]) + 1 if len(end) else 0, 0x20, dtype=np.uint8)
        if len(end):
            out[size[word] - 1] = LOWER[data[word]] if lower else data[word]
        self.data = out
        self.start = np.concatenate(([0], size[end] + 1)).astype(np.int64) if len(end) else np.zeros(1, np.int64)
        self.first = np.searchsorted(end, off, side="left").astype(np.int64)
        self.n_words = len(end)
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        if not self.n_words:
            return np.zeros(0, np.uint64)
        x = self.data.astype(np.uint64)
        x += np.uint64(1)
        x[self.start[1:] - 1] = 0
        x *= _power("up", _BASE, n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        s = self.start
        return mix((total[s[1:]] - total[s[:-1]]) * _power("down", _INVERSE, n)[s[:-1]])

    def ngrams(self, h: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of ``k`` words that stay within a text, and the index of each run's first word."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        doc = self.doc()
        at = np.flatnonzero(doc[:n] == doc[k - 1:])
        total = np.full(n, salt, dtype=np.uint64)
        for j in range(k):
            total *= np.uint64(_BASE)
            total += h[j:j + n]
        return mix(total[at]), at


def slices(col: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; a longer text is a range of its own."""
    _, off = text_bytes(col)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
