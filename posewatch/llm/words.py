"""Words of many texts at once, as 64-bit hashes, in numpy.

Words are the runs of characters other than space and U+0009 to U+000D. Their hash is a
polynomial over a fixed table of random numbers, mixed at the end, the same on every
machine. Two different words get the same hash with a chance of about 2^-64 a pair; the
operators that build on it compare hashes where this module's name is used.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_RANDOM = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of `n` consecutive hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= _BASE
        out += h[i : len(h) - n + 1 + i]
    return mix(out)


class Words:
    """Words of a batch: hash, start and end byte of each, first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data, self.offsets = data, offsets
        space = _SPACE[data]
        word = ~space
        first = word.copy()
        first[1:] &= space[:-1]
        last = word.copy()
        last[:-1] &= space[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]  # texts do not run together
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.begin = np.searchsorted(self.starts, offsets)
        self.hashes = _spans(data, self.starts, self.ends, lower)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.begin[i] : self.begin[i + 1]]

    def text(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]

    def spans(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.begin[i], self.begin[i + 1])
        return self.starts[s], self.ends[s]


def _spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of byte spans, block by block so that working memory stays small."""
    table = _BYTES[_LOWER] if lower else _BYTES
    out = np.zeros(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        at = starts[done]
        upto = max(done + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
        s, e = starts[done:upto] - at, ends[done:upto] - at
        n = int(e[-1])
        up, down = _powers(1 << max(20, n.bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data[at : at + n]] * up[:n], out=total[1:])
        out[done:upto] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        done = upto
    return mix(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, lower: bool) -> Words:
    return Words(*buffers(column), lower)
