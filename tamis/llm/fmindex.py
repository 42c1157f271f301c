"""FM-index over the words of one shard: wavelet-matrix ranks, backward search, sampled locate."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class Bits:
    """A bit vector with constant-time rank: packed words and counts before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(((n >> 6) + 1) << 6, dtype=bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits]] = []
        rest = symbols
        for level in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bit = (rest >> level) & 1 == 1
            self.levels.append((level, Bits(bit)))
            rest = np.concatenate([rest[~bit], rest[bit]])
        self.base = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> level) & 1 == 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before position i."""
        return self._walk(c, i) - self.base[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its rank there."""
        c = np.zeros(len(i), np.int64)
        for level, bits in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            c |= one.astype(np.int64) << level
            i = np.where(one, bits.zeros + ones, i - ones)
        return c, i - self.base[c]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling.  Separators (0) are all different, in order of position."""
    n = len(symbols)
    gaps = symbols == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, symbols.astype(np.int64) + int(gaps.sum()))
    step, order = 1, np.argsort(rank, kind="stable")
    key = rank[order]
    while True:
        fresh = np.empty(n, dtype=bool)
        fresh[:1], fresh[1:] = True, key[1:] != key[:-1]
        first = np.flatnonzero(fresh)
        ranks = np.empty(n, np.int64)
        ranks[order] = np.repeat(first, np.diff(np.append(first, n)))
        if len(first) == n:
            return order
        # Only suffixes that are still tied are sorted again.
        tied = np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n)))
        at = order[tied]
        nxt = at + step
        second = np.where(nxt < n, ranks[np.minimum(nxt, n - 1)] + 1, 0)
        packed = (ranks[at] << 32) | second
        o = np.argsort(packed, kind="stable")
        order[tied] = at[o]
        key = ranks[order] << 32
        key[tied] = packed[o]
        step *= 2


class FMIndex:
    """Index of a sequence over 0..sigma-1, in which 0 separates; phrases never contain it."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        symbols = np.concatenate([[0], symbols.astype(np.int64), [0]])
        order = suffix_array(symbols)
        last = symbols[order - 1]
        self.wavelet = WaveletMatrix(last, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        gap = np.maximum.accumulate(np.where(symbols == 0, np.arange(len(symbols)), 0))
        into = np.arange(len(symbols)) - gap
        # A symbol right after a separator is sampled, so no walk crosses one.
        sampled = (into % SAMPLE == 1) | (into == 0)
        rows = sampled[order]
        self.marks = Bits(rows)
        self.samples = order[rows] - 1  # positions without the leading separator

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases (right-aligned in rows of the matrix), all at once."""
        width = phrases.shape[1]
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), int(self.before[-1]), np.int64)
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (high > low))
            if not len(live):
                break
            c = phrases[live, width - 1 - k]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps backwards to the nearest sampled suffix."""
        out = np.empty(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows.astype(np.int64)
        steps = 0
        while len(todo):
            hit = self.marks.get(at)
            out[todo[hit]] = self.samples[self.marks.rank(at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            if len(at):
                c, r = self.wavelet.access(at)
                at = self.before[c] + r
            steps += 1
        return out
