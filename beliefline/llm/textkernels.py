"""Numpy kernels over Arrow text: words, their hashes and sets of shingles, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64)))


_BYTE = random_words(256, 1)
_LOWER_BYTE = _BYTE[_LOWER]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, np.uint64(base))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK + 1
    while size < n:
        size *= 2
    up, down = _powers(size)
    return up[:n], down[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end): a polynomial over random numbers for bytes, modulo 2^64, which
    one running sum gives for all ranges."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up, out=run[1:])
    return mix((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a block of rows: starts and ends in data, the first word of each row (n + 1), hashes (made when asked for)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets, self.lower = data, offsets, lower
        solid = ~_SPACE[data]
        before = np.zeros(len(data), bool)
        before[1:] = solid[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        before[edges] = False
        self.starts = np.flatnonzero(solid & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = solid[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets, "left")
        self.counts = np.diff(self.first)

    @cached_property
    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends, _LOWER_BYTE if self.lower else _BYTE)

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


_STEP = random_words(64, 2) | np.uint64(1)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of each k-word shingle; a row of fewer words gives one of all of them."""
    n, h = len(words.hashes), words.hashes
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = words.row()
    full = np.zeros(n, np.uint64)
    m = n - k + 1
    if m > 0:
        for j in range(k):
            full[:m] += h[j : j + m] * _STEP[j]
    place = np.arange(n) - words.first[:-1][row]
    left = words.counts[row] - place
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    for r in short:
        a, c = words.first[r], words.counts[r]
        full[a] = (h[a : a + c] * _STEP[:c]).sum(dtype=np.uint64) + np.uint64(c)
    keep = (left >= k) | ((words.counts[row] < k) & (place == 0))
    at = np.flatnonzero(keep)
    return mix(full[at]), row[at], at


def shingle_sets(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 offsets): each row's distinct shingles, ascending."""
    h, row, _ = shingles(words, k)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(words.counts) + 1))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def text_blocks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in blocks of about size bytes."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    for i, j in chunks(offsets, size):
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
