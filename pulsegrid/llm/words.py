"""Words of whole texts as numpy arrays: places, owners and 64-bit hashes of all words of an Arrow column at once.

A running polynomial over the bytes (random 64-bit byte values, arithmetic modulo 2^64) gives the hash of any byte range by a subtraction, so
words, lines and windows of words are hashed without touching a Python string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at a time (about forty times as much is held meanwhile); a longer text is a slice of its own.
SLICE = 512 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.RandomState(20240229).randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get(0)
    if held is None or len(held[0]) < n:
        size = max(n, SLICE) + 1
        table = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))])
        held = _powers[0] = (table(_BASE), table(_BACK))
    return held


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Texts:
    """Bytes of a string column (null is empty) with word places: ``start``, ``end`` (bytes), ``owner`` (row), ``hash``, ``n_words`` by row."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
        self.bounds = at - at[0]
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.bounds] = True
        self.start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.owner = self.row_of(self.start)
        self.rows = len(column)
        self.n_words = np.bincount(self.owner, minlength=self.rows)
        power, self._back = _power_tables(n)
        values = _BYTE[_LOWER] if lower else _BYTE
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[self.data] * power[:n])])
        self.hash = self.hashes(self.start, self.end)

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, side="right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``size`` words that lies in one text."""
        n = max(0, len(self.owner) - size + 1)
        first = np.flatnonzero(self.owner[:n] == self.owner[size - 1:]) if n else np.empty(0, np.int64)
        h = np.zeros(len(first), np.uint64)
        for k in range(size):
            h = mix(h * _BASE + self.hash[first + k])
        return first, h

    def sum_by_row(self, per_byte: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_byte, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending inside a text, one text after another, and their number by text.

    A text with fewer words than ``size`` has its whole word sequence as the only shingle; one without words has none.
    """
    first, h = texts.windows(size)
    owner = texts.owner[first]
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < size))
    if len(short):
        begin = np.cumsum(texts.n_words) - texts.n_words
        whole = np.full(len(short), 7, np.uint64)
        for k in range(size - 1):
            has = texts.n_words[short] > k
            whole[has] = mix(whole[has] * _BASE + texts.hash[begin[short[has]] + k])
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=texts.rows)
