"""An FM-index over word numbers: wavelet-matrix ranks, backward search of many patterns at once, sampled positions."""

from __future__ import annotations

import numpy as np


class BitRanks:
    """Bits in words of 64 with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletRanks:
    """Ranks of symbols in a sequence: one level of bits for each bit of a symbol, zeros first from level to level."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels: list[BitRanks] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.depth)):
            bits = (symbols >> level) & 1
            self.levels.append(BitRanks(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        #: Where each symbol's block begins below the last level.
        self.first = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.depth - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbol, at) - self.first[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. Zeros end a run and differ from each other by place."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        dense = np.empty(n, np.int64)
        dense[order] = np.append(0, np.cumsum(sorted_rank[1:] != sorted_rank[:-1]))
        if n == 0 or dense[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:-step] = dense[step:] + 1
        rank = dense * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    """Index of runs of symbols 1 .. size - 1, each run followed by 0."""

    def __init__(self, text: np.ndarray, size: int, every: int = 8):
        order = suffix_order(text)
        last = text[order - 1]
        self.last = last
        self.ranks = WaveletRanks(last, size)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=size)))
        begins = np.ones(len(text), bool)
        begins[1:] = text[:-1] == 0
        kept = (order % every == 0) | begins[order]  # a walk never leaves its run
        self.kept, self.places = BitRanks(kept), order[kept]
        self.is_kept = kept

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of patterns (one width), its interval of suffixes."""
        low = self.first[patterns[:, -1]]
        high = self.first[patterns[:, -1] + 1]
        live = np.flatnonzero(low < high)
        for column in reversed(range(patterns.shape[1] - 1)):
            symbol = patterns[live, column]
            low[live] = self.first[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.ranks.rank(symbol, high[live])
            dead = low[live] >= high[live]
            high[live[dead]] = low[live[dead]]
            live = live[~dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes given by rank: back to a kept one, step by step."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.arange(len(rows))
        while len(walking):
            done = self.is_kept[at[walking]]
            here = walking[done]
            out[here] = self.places[self.kept.rank(at[here])] + steps[here]
            walking = walking[~done]
            symbol = self.last[at[walking]]
            at[walking] = self.first[symbol] + self.ranks.rank(symbol, at[walking])
            steps[walking] += 1
        return out
