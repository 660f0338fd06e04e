"""A compressed FM-index over word sequences: the Burrows-Wheeler transform in a wavelet matrix of packed bits.

Every query is a whole array of positions or intervals at once.
"""

from __future__ import annotations

import numpy as np

#: Symbols 0 and 1 end the text and separate its sequences; no pattern holds them.
END, SEPARATOR, FIRST = 0, 1, 2


#: The bits below each position of a word of 64.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """rank(symbol, i): how often the symbol occurs before position i. A bit per symbol and level, counts per 64 bits."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1])
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            ones = self.before[k].take(word)
            ones += np.bitwise_count(self.bits[k].take(word) & BELOW.take(at & 63))
            at = np.where(symbols & (1 << (self.levels - 1 - k)), ones + self.zeros[k], at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbols, at) - self.start[symbols]


class FMIndex:
    """Counts and locates patterns of up to `depth` words in a set of word sequences."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        """text: symbols from FIRST on, SEPARATOR after each sequence, END at last."""
        rank, k = text.astype(np.int64), 1
        order = None
        while order is None or k < depth:
            ahead = np.zeros_like(rank)
            ahead[: max(0, len(rank) - k)] = rank[k:]
            key = rank * (int(rank.max()) + 1) + ahead
            order = np.argsort(key)
            new = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
            rank = np.empty_like(rank)
            rank[order] = new
            k *= 2
            if new[-1] == len(text) - 1:
                break
        self.suffixes = order
        self.tree = WaveletMatrix(text[order - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.n = len(text)

    def step(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of the patterns with a symbol put before them."""
        base = self.first[symbols]
        return base + self.tree.rank(symbols, lo), base + self.tree.rank(symbols, hi)

    def matches(self, text: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The matching statistics of streamed text at the ends of its windows, up to the threshold: how many words before
        each end also occur elsewhere in the index, and the interval of those whose statistic reaches the threshold."""
        lo, hi = self.first[text[ends]], self.first[text[ends] + 1]  # the interval of one word needs no rank
        length = (hi - lo > 1).astype(np.int64)
        on = np.flatnonzero(length)
        for i in range(1, threshold):
            lo[on], hi[on] = self.step(text[ends[on] - i], lo[on], hi[on])
            on = on[hi[on] - lo[on] > 1]
            length[on] += 1
        return length, lo, hi
