"""Vectorised text kernels for Arrow batches.

Spark partitions and moves the rows; inside a task these helpers look at a
whole Arrow column of strings as one byte array, so that splitting, hashing and
shingling cost a few NumPy passes over the bytes and never a Python loop over
words.  A null text counts as an empty one everywhere.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one NumPy pass looks at; bounds a worker's memory.
SLICE_BYTES = 1 << 20

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and len + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows so that each part has about `most` bytes of text (a longer row stands alone)."""
    if batch.num_rows == 0:
        return
    _, offsets = flat(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def let_go() -> None:
    """Gives memory that is free in the allocators back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def mapper(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: int = 1, most: int = SLICE_BYTES):
    """A function for mapInArrow that calls fn on slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
            let_go()

    return run


#: Classes of bytes: white space splits words everywhere.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: 0: other, 1: letter (every byte of a non-ASCII character counts), 2: digit.
LETTER = np.zeros(256, np.uint8)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
LETTER[[*range(48, 58)]] = 2

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters of UTF-8 (lead byte C3)."""
    out = _FOLD[data]
    if len(data) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def runs(kind: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal nonzero kind inside each document: starts, ends, and per document the index of its first run."""
    n = len(kind)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.empty(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[0] = edge[n] = True
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    inside = kind[cuts[:-1]] != 0
    starts, ends = cuts[:-1][inside], cuts[1:][inside]
    return starts, ends, np.searchsorted(starts, offsets)


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept by the worker."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES * 5 // 4), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial in an odd base."""
    n = len(data)
    if n == 0 or len(starts) == 0:
        return np.zeros(len(starts), U)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(_power("base", _BASE, n) * (data + U(1)), out=total[1:])
    inverse = _power("inverse", _BASE_INVERSE, n)[starts]
    return mix((total[ends] - total[starts]) * inverse + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """White-space words, `[^\\x20\\x09-\\x0D]+`: starts, ends, first word of each document (len + 1)."""
    return runs((~SPACE[data]).view(np.uint8), offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows in a row, and each row's first index into them (len + 1)."""
    data, offsets = flat(column)
    starts, ends, first = words(data, offsets)
    return span_hashes(data, starts, ends), first


def owners(first: np.ndarray) -> np.ndarray:
    """The row number of each element, from the rows' first indices."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and each row's first index. A row of 1 to k - 1 words has one shingle of all of them."""
    lengths = np.diff(first)
    n = len(hashes)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(first), np.int64)
    total = np.zeros(n, U)
    for j in range(k):
        weight = mix(np.array([j + 1], U))[0] | U(1)
        total[: n - j] += hashes[j:] * weight if j else hashes * weight
    if n >= k:
        total[:] = mix(total)
    counts = np.maximum(lengths - k + 1, np.minimum(lengths, 1))
    out_first = np.concatenate([[0], np.cumsum(counts)])
    own = np.repeat(np.arange(len(lengths)), counts)
    at = first[:-1][own] + (np.arange(len(own)) - out_first[own])
    out = total[at]
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    for d in short:  # fewer than k words: hash what there is, so that equal short texts still meet
        out[out_first[d]] = mix(np.array([int((hashes[first[d] : first[d + 1]] * (np.arange(1, lengths[d] + 1).astype(U) * U(2) + U(1))).sum(dtype=U))], U))[0]
    return out, out_first


def set_words(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a string column in one call."""
    return shingles(*word_hashes(column), k)


class Table:
    """An open-addressing table from 64-bit keys to their positions, looked up many at a time."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(U)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = (1 << self.bits) - 1
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        at, left = self._home(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several for one slot the last stays
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, or -1."""
        at = self._home(keys)
        out = self.slot[at]
        if len(self.keys) == 0:
            return out
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.slot[at[todo]]
            found = out[todo]
            todo = todo[(found >= 0) & (self.keys[found] != keys[todo])]
        return out


def letter_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased runs of letters, and each row's first index."""
    data, offsets = flat(column)
    kind = (LETTER[data] == 1).view(np.uint8)
    starts, ends, first = runs(kind, offsets)
    return span_hashes(fold_case(data), starts, ends), first


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
