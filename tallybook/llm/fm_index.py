"""An FM-index over a sequence of integers: wavelet ranks, backward search, sampled positions.

All operations take arrays, one element per pattern or row, and run as numpy array code.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector with the number of ones before a position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of symbols below ``2 ** depth``, one bit vector per bit of the symbol."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for shift in range(depth - 1, -1, -1):
            bits = (symbols >> shift) & 1 == 1
            self.levels.append((shift, BitRank(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            low_ones, at_ones = bits.rank(low), bits.rank(at)
            low = np.where(one, zeros + low_ones, low - low_ones)
            at = np.where(one, zeros + at_ones, at - at_ones)
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these positions."""
        symbol = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(symbol.dtype) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by doubling the compared length."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if fresh[-1] == n - 1 or step >= n:
            return order
        rank[order] = fresh
        step *= 2


class FMIndex:
    """Index of ``symbols`` (values 1 and up; 0 may be used as a separator that no pattern holds)."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        text = np.append(np.asarray(symbols, dtype=np.int64) + 1, 0)  # 0 ends the text
        order = suffix_array(text)
        top = int(text.max())
        before = text[order - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.ranks = WaveletMatrix(before, max(1, top.bit_length()))
        self.top = top
        kept = order % sample == 0
        self.marks = BitRank(kept)
        self.positions = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of patterns, given as rows padded with 0 on the left; empty if absent."""
        n, width = patterns.shape
        size = int(self.start[-1])
        low, high = np.zeros(n, dtype=np.int64), np.full(n, size, dtype=np.int64)
        alive = np.arange(n)
        for column in range(width - 1, -1, -1):
            symbol = patterns[alive, column].astype(np.int64) + 1
            # a padded place leaves its pattern as it is; a symbol beyond the text's is absent
            known = (symbol > 1) & (symbol <= self.top)
            done = symbol == 1
            rows, found = alive[known], symbol[known]
            low[rows] = self.start[found] + self.ranks.rank(found, low[rows])
            high[rows] = self.start[found] + self.ranks.rank(found, high[rows])
            absent = alive[~known & ~done]
            high[absent] = low[absent]
            alive = rows[high[rows] > low[rows]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the text to the next sampled one."""
        rows = rows.copy()
        out = np.empty(len(rows), dtype=np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            at = rows[left]
            hit = self.marks.get(at)
            out[left[hit]] = self.positions[self.marks.rank(at[hit])] + steps
            left, at = left[~hit], at[~hit]
            symbol = self.ranks.access(at)
            rows[left] = self.start[symbol] + self.ranks.rank(symbol, at)
            steps += 1
        return out
