"""An FM-index over a sequence of symbols: wavelet-tree ranks, backward search, sampled positions. All patterns at once."""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places in the order of the suffixes that start there, by prefix doubling. A zero ends every segment and is unlike any
    other zero, so that no comparison runs past it."""
    n = len(symbols)
    zeros = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(zeros)
    rank[zeros] = np.arange(len(zeros))
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + 2 + n) + after
        order = np.argsort(key, kind="stable")
        changed = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]) if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = changed
        if not n or changed[-1] == n - 1:
            return order
        width *= 2


class WaveletTree:
    """Counts of a symbol before a place, over a sequence, one bit vector per bit of the alphabet (matrix layout)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        current = symbols.astype(np.uint32)
        for level in reversed(range(self.levels)):
            bits = (current >> np.uint32(level)) & np.uint32(1)
            packed = np.packbits(bits.astype(np.uint8), bitorder="little")
            words = np.frombuffer(np.pad(packed, (0, -len(packed) % 8 + 8)).tobytes(), np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64))
            self.zeros.append(int(len(bits) - bits.sum()))
            current = np.concatenate([current[bits == 0], current[bits == 1]])

    def _ones(self, level: int, places: np.ndarray) -> np.ndarray:
        word = places >> 6
        mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low, high = np.zeros_like(places), places
        for i in range(self.levels):
            bit = (symbols >> (self.levels - 1 - i)) & 1 == 1
            a, b = self._ones(i, low), self._ones(i, high)
            low = np.where(bit, self.zeros[i] + a, low - a)
            high = np.where(bit, self.zeros[i] + b, high - b)
        return high - low


class FmIndex:
    """Index of segments of symbols from 1 on, each followed by a zero."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_order(symbols)
        self.last = symbols[order - 1] if len(symbols) else symbols  # the symbol before each suffix
        self.tree = WaveletTree(self.last, alphabet)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))]).astype(np.int64)
        # Positions are kept at every SAMPLE_EVERY-th place, and at the start of each segment, where no symbol goes before.
        kept = (order % SAMPLE_EVERY == 0) | (self.last == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.positions = kept, order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern (one per row), from its last symbol to its first."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.last), np.int64)
        for column in reversed(range(patterns.shape[1])):
            alive = np.flatnonzero(low < high)
            symbols = patterns[alive, column].astype(np.int64)
            low[alive] = self.first[symbols] + self.tree.rank(symbols, low[alive])
            high[alive] = self.first[symbols] + self.tree.rank(symbols, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each suffix: walk to the left until a kept position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.kept[rows])
        while len(open_):
            symbols = self.last[rows[open_]].astype(np.int64)
            rows[open_] = self.first[symbols] + self.tree.rank(symbols, rows[open_])
            steps[open_] += 1
            open_ = open_[~self.kept[rows[open_]]]
        return self.positions[self.kept_before[rows]] + steps
