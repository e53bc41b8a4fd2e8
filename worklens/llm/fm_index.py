"""An FM-index over a list of symbol sequences: backward search and locate.

The sequences are laid one after another, each closed by a separator that
sorts below all symbols (earlier ones first), so no match spans two sequences.
The Burrows-Wheeler transform is held as a wavelet matrix, which answers rank
in one step a bit of the alphabet; suffix positions are kept for every
``SAMPLE``-th place and for the first place of each sequence, and other rows
walk there by LF steps.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Sorted suffix starts, by prefix doubling until all ranks differ."""
    n = len(keys)
    _, rank = np.unique(keys, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = pair[order][1:] != pair[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Bits:
    """A bit sequence with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = int(len(bits) - ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Rank and access over symbols 0..sigma-1."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, (sigma - 1).bit_length())
        self.levels: list[Bits] = []
        for level in reversed(range(self.depth)):
            bits = (symbols >> level) & 1
            self.levels.append(Bits(bits.astype(np.uint8)))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        # Where each symbol's run begins on the last level.
        self.begin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(reversed(range(self.depth)), self.levels):
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._descend(symbol, at) - self.begin[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for bits in self.levels:
            bit, ones = bits.get(at), bits.rank(at)
            symbol = (symbol << 1) | bit
            at = np.where(bit, bits.zeros + ones, at - ones)
        return symbol


class FMIndex:
    """``text``: symbols 1..sigma-1, each sequence closed by a 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        ends = text == 0
        keys = np.where(ends, np.cumsum(ends) - 1, text + ends.sum())
        order = suffix_array(keys)
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma]
        first = np.ones(len(text), bool)
        first[1:] = ends[:-1]
        sampled = first[order] | (order % SAMPLE == 0)
        self.sampled, self.positions = Bits(sampled.astype(np.uint8)), order[sampled]
        self.n = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the phrases (rows of symbols, ``lengths`` of which count)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for back in range(phrases.shape[1]):
            live = np.flatnonzero((back < lengths) & (low < high))
            symbol = phrases[live, lengths[live] - 1 - back]
            low[live], high[live] = (self.less[symbol] + self.bwt.rank(symbol, edge[live]) for edge in (low, high))
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, walked = rows.copy(), np.zeros(len(rows), np.int64)
        left = np.flatnonzero(self.sampled.get(rows) == 0)
        while len(left):
            symbol = self.bwt.access(rows[left])
            rows[left] = self.less[symbol] + self.bwt.rank(symbol, rows[left])
            walked[left] += 1
            left = left[self.sampled.get(rows[left]) == 0]
        return self.positions[self.sampled.rank(rows)] + walked
