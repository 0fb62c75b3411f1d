"""A compressed FM-index over integer words: a wavelet matrix of the Burrows-Wheeler transform, searched many patterns at a time."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector and its block counts a level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        now = sequence.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 - len(packed) % 8, np.uint8)]).view(np.uint64)  # one word more than needed
            self.bits.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            ones = bit.astype(bool)
            self.zeros.append(int(len(now) - ones.sum()))
            now = np.concatenate([now[~ones], now[ones]])
        every = np.arange(symbols, dtype=np.int32)
        self.base = self._walk(every, np.zeros(symbols, np.int32))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block = at >> 6
            below = np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ranks[k][block] + np.bitwise_count(self.bits[k][block] & below).astype(np.int32)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._walk(symbol, at) - self.base[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` words at least (a power of two is reached)."""
    n = len(text)
    rank = text.astype(np.int64)
    width = 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        tail = np.zeros(n, np.int64)
        tail[: n - width] = rank[width:] + 1
        key = rank * (n + int(text.max(initial=0)) + 2) + tail
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        rank, width = fresh, 2 * width
    return order.astype(np.int32)


class FMIndex:
    """Index of a text of words >= 1, with 0 as a separator that no pattern holds.

    Suffixes are ordered by `depth` words, so patterns of up to `depth` words are found exactly.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.order = suffix_order(text, depth)
        symbols = int(text.max(initial=0)) + 1
        self.matrix = WaveletMatrix(text[self.order - 1], symbols)  # of the first suffix: the last word, a separator
        counts = np.bincount(text, minlength=symbols)
        self.first = (np.cumsum(counts) - counts).astype(np.int32)

    def matches(self, text: np.ndarray, ends: np.ndarray, length: int, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of text[end - length : end] for each end, all in step: ranges of suffixes.

        A search whose matches so far are fewer than `least` is given up; its range is empty.
        """
        low = np.zeros(len(ends), np.int32)
        high = np.full(len(ends), len(self.order), np.int32)
        todo = np.arange(len(ends))
        for back in range(1, length + 1):
            word = text[ends[todo] - back].astype(np.int32)
            low[todo] = self.first[word] + self.matrix.rank(word, low[todo])
            high[todo] = self.first[word] + self.matrix.rank(word, high[todo])
            good = high[todo] - low[todo] >= least
            lost = todo[~good]
            high[lost] = low[lost]
            todo = todo[good]
            if len(todo) == 0:
                break
        return low, high
