"""FM-index over integer sequences, in numpy.

The text is a set of sequences, each closed by an end mark of its own. Suffixes are
sorted by prefix doubling; the Burrows-Wheeler transform is kept in a wavelet tree
laid out as a matrix of packed bits (about ``log2(alphabet)`` bits a symbol, with
counts for every 64 bits). Backward search runs for many patterns at once, one step
for all of them at a time.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def suffix_order(ranks: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order; ``ranks`` are small integers and no two suffixes agree on
    more than ``longest`` symbols."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    step = 1
    while True:
        sorted_ = ranks[order]
        dense = np.zeros(n, np.int64)
        dense[1:] = np.cumsum(sorted_[1:] != sorted_[:-1])
        current = np.empty(n, np.int64)
        current[order] = dense
        if dense[-1] == n - 1 or step > longest:
            return order
        following = np.zeros(n, np.int64)
        following[: n - step] = current[step:] + 1
        ranks = current * (n + 1) + following
        order = np.argsort(ranks, kind="stable")
        step *= 2


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        n = len(symbols)
        for bit in reversed(range(max(1, int(alphabet - 1).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            words = np.zeros((n >> 6) + 1, np.uint64)
            packed = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words)[:-1], out=before[1:])
            zeros = n - int(ones.sum())
            self.levels.append((bit, words, before, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def lower(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the first ``places`` symbols send the given symbol on the last level."""
        places = places.copy()
        for bit, words, before, zeros in self.levels:
            at = places >> 6
            mask = (ONE << (places & 63).astype(np.uint64)) - ONE
            ones = before[at] + np.bitwise_count(words[at] & mask)
            places = np.where(symbols >> bit & 1 == 1, zeros + ones, places - ones)
        return places


class FMIndex:
    """Index of sequences of symbols 1 .. ``alphabet`` - 1, given end to end with bounds."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, alphabet: int, labels: np.ndarray):
        count = len(bounds) - 1
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(count), sizes + 1)
        text = np.zeros(len(owner), np.int64)
        closing = bounds[1:] + np.arange(count)
        real = np.ones(len(owner), bool)
        real[closing] = False
        text[real] = symbols
        ranks = np.where(real, text + count, 0)
        ranks[closing] = np.arange(count)
        order = suffix_order(ranks, int(sizes.max()) + 1 if count else 1)
        self.tree = WaveletMatrix(text[order - 1], alphabet)
        totals = np.bincount(symbols, minlength=alphabet)
        totals[0] = count
        self.first = np.append(0, np.cumsum(totals))
        every = np.arange(alphabet)
        self.shift = self.first[:-1] - self.tree.lower(every, np.zeros(alphabet, np.int64))
        self.minima = [labels[owner[order]]]

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges after one symbol in front of each pattern."""
        both = self.tree.lower(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        both += np.concatenate([self.shift[symbols], self.shift[symbols]])
        return both[: len(symbols)], both[len(symbols) :]

    def least_label(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest label in each non-empty suffix range, from minima of doubling width."""
        power = np.frexp((high - low).astype(float))[1] - 1
        while len(self.minima) <= (int(power.max()) if len(power) else 0):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))
        out = np.empty(len(low), self.minima[0].dtype)
        for p in np.unique(power):
            at = power == p
            table = self.minima[p]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(p))])
        return out

    def suffix_matches(
        self, symbols: np.ndarray, ends: np.ndarray, labels: np.ndarray, length: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics, read backwards and cut at ``length``.

        For each position in ``ends`` of ``symbols``: how many symbols before it occur
        a second time in the index (the pattern itself is indexed), and whether a full
        match of ``length`` has a label smaller than its own.
        """
        matched = np.zeros(len(ends), np.int64)
        smaller = np.zeros(len(ends), bool)
        open_ = np.arange(len(ends))
        last = symbols[ends - 1]
        low, high = self.first[last], self.first[last + 1]
        for depth in range(1, length + 1):
            alive = high - low > 1
            open_, low, high = open_[alive], low[alive], high[alive]
            matched[open_] = depth
            if depth == length or not len(open_):
                break
            low, high = self.step(symbols[ends[open_] - depth - 1], low, high)
        if len(open_):
            smaller[open_] = self.least_label(low, high) < labels[open_]
        return matched, smaller
