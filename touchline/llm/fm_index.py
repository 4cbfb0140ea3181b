"""An FM-index over integer sequences: bounded backward search and location of many phrases at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)[:-1]])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Rank of any symbol and access, a bit vector for each bit of the symbols (highest first)."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        symbols = symbols.astype(np.int32)
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.first = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` occurs among the first ``i`` symbols."""
        return self._down(c, i) - self.first[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and how often it occurs before ``i``."""
        c = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            bit, ones = bits.get(i).astype(np.int64), bits.rank(i)
            c |= bit << shift
            i = np.where(bit == 1, zeros + ones, i - ones)
        return c, i - self.first[c]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes. Zeros end the stretches of the text: each is smaller than all other
    symbols and than the zeros after it.

    The first order is by as many symbols as fit into a key. Then prefixes double, and only suffixes
    that aren't told apart yet are sorted again, within their group. A stretch of n symbols takes
    about log2(n) rounds.
    """
    n = len(text)
    zero = text == 0
    n_zeros = int(zero.sum())
    symbol = np.where(zero, np.cumsum(zero) - 1, n_zeros - 1 + text.astype(np.int64))
    bits = max(1, int(symbol.max()).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: max(0, n - k)] |= symbol[k:]
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = np.diff(key[order]) != 0
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group has the place of its first
    while True:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)  # places of suffixes in groups of several
        if not len(at):
            return order
        own = order[at]
        group, follow = rank[own], rank[np.minimum(own + width, n - 1)]  # no group reaches beyond its zero
        dense = np.cumsum(np.append(0, np.diff(group) != 0))
        again = np.argsort(dense * n + follow)
        order[at] = own = own[again]
        group, follow = group[again], follow[again]
        fresh = np.append(True, (np.diff(group) != 0) | (np.diff(follow) != 0))
        new[at] = fresh
        rank[own] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        width *= 2


class FMIndex:
    """Index of a text of symbols below ``n_symbols``; zeros separate its stretches and end it."""

    SAMPLE = 16  #: of so many suffixes one keeps its position, and the first of each stretch

    def __init__(self, text: np.ndarray, n_symbols: int):
        order = suffix_array(text)
        bwt = text[order - 1].astype(np.int64)
        self.n = len(text)
        self.tree = WaveletTree(bwt, n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))[:-1]])
        sampled = (order % self.SAMPLE == 0) | (bwt == 0)
        self.sampled, self.positions = Bits(sampled.astype(np.uint8)), order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [low, high) of suffixes that begin with each phrase; phrases end in the last column. A
        phrase with a negative symbol has none."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        high[(phrases < 0).any(axis=1)] = 0
        width = phrases.shape[1]
        for column in range(width - 1, -1, -1):
            on = np.flatnonzero((high > low) & (lengths >= width - column))
            c = phrases[on, column]
            low[on] = self.smaller[c] + self.tree.rank(c, low[on])
            high[on] = self.smaller[c] + self.tree.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to a sampled one, counted."""
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            done = self.sampled.get(rows) == 1
            out[todo[done]] = self.positions[self.sampled.rank(rows[done])] + steps
            todo, rows = todo[~done], rows[~done]
            c, before = self.tree.access(rows)
            rows, steps = self.smaller[c] + before, steps + 1
        return out
