"""Vectorised word kernels over the UTF-8 buffers of Arrow string columns.

All patterns used here split on ASCII only, so words can be found on bytes: no text is decoded and
no Python object is made per word. 64-bit hashes stand for words and windows of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice of a batch holds about so many bytes, which bounds the arrays made from it; a longer single text makes a slice of its own.
SLICE_BYTES = 256 << 10
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_WINDOW_BASE = 0xA0761D6478BD642F

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Words [^\x20\x09-\x0D]+
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[32, *range(9, 14)]] = False
#: Words of digits, ASCII letters and every other character from U+0080 on.
WORD_LIKE = np.zeros(256, dtype=bool)
WORD_LIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multiplications, a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random 64-bit value for each byte.
_BYTE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _ODD)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; the tables grow as needed."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(n, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        have = _powers[base] = (tables[0], tables[1])
    return have


def _ranges(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """For each range lo..hi the sum of values[i] * base**(i - lo), modulo 2**64."""
    up, down = _power(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[hi] - total[lo]) * down[lo]


@dataclass
class Slice:
    """Some consecutive texts of a batch. Words of text d: first[d] to first[d + 1]."""

    row: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self, lowered: bool) -> np.ndarray:
        """A 64-bit hash of each word."""
        data = LOWERED[self.data] if lowered else self.data
        h = _ranges(_BYTE[data], self.starts, self.ends, _BASE)
        return mix(h + (self.ends - self.starts).astype(np.uint64) * _ODD)

    def text(self, d: int) -> str:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes().decode("utf-8", "replace")


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; the position is that of the first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    lo = np.arange(n)
    return mix(_ranges(words, lo, lo + size, _WINDOW_BASE) + _U(size * int(_ODD) % 2**64))


def split_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray, row: int = 0) -> Slice:
    """Find the words of the texts that lie at ``offsets`` in ``data``."""
    is_word = word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = is_word[:-1]
    before[edge[:-1]] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = is_word[1:]
    after[edge[1:]] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return Slice(row, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    o = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return d, o - o[0]


def slices(texts: pa.Array | pa.ChunkedArray, word: np.ndarray = NOT_BLANK) -> Iterator[Slice]:
    """The texts of a column, a few megabytes at a time, each text whole."""
    data, offsets = buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        to = min(to, n)
        yield split_words(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row], word, row)
        row = to


def distinct_shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words is one shingle."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    return np.unique(windows(words, min(size, len(words))))
