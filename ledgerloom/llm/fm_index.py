"""An FM-index over a sequence of integer symbols: wavelet-matrix ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence that ends in a unique smallest symbol, by prefix doubling."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        steps = np.empty(n, np.int64)
        steps[0] = 0
        np.cumsum(ordered[1:] != ordered[:-1], out=steps[1:])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if n == 1 or steps[-1] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Rank and access over symbols of `levels` bits, for arrays of queries at once."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels = levels
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(levels - 1, -1, -1):
            bits = (now >> level) & 1
            count = np.zeros(len(now) + 1, np.int64)
            np.cumsum(bits, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(now) - int(count[-1]))
            now = np.concatenate([now[bits == 0], now[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(at), at
        for k, (count, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = count[low], count[high]
            low = np.where(one, zeros + a, low - a)
            high = np.where(one, zeros + b, high - b)
        return high - low

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before it."""
        low, now, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for count, zeros in zip(self.ones, self.zeros, strict=True):
            one = (count[now + 1] - count[now]).astype(bool)
            symbol = symbol * 2 + one
            a, b = count[low], count[now]
            low = np.where(one, zeros + a, low - a)
            now = np.where(one, zeros + b, now - b)
        return symbol, now - low


class FMIndex:
    """Index of symbols of 1 and more; 0 is kept for the end."""

    def __init__(self, symbols: np.ndarray, sample: int = 8) -> None:
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        self.size = len(text)
        levels = max(1, int(text.max()).bit_length())
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt, levels)
        self.before = np.zeros((1 << levels) + 1, np.int64)
        self.before[1:] = np.cumsum(np.bincount(text, minlength=1 << levels))
        marked = order % sample == 0
        self.marked = marked
        self.mark_rank = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=self.mark_rank[1:])
        self.samples = order[marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns, which stand left-aligned in the rows; a symbol of -1 is in no text."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        rows = np.arange(len(patterns))
        top = len(self.before) - 1
        for k in range(int(lengths.max(initial=0)) - 1, -1, -1):
            rows = rows[(lengths[rows] <= k) | (low[rows] < high[rows])]
            now = rows[lengths[rows] > k]
            symbol = patterns[now, k]
            known = (symbol > 0) & (symbol < top)
            high[now[~known]] = low[now[~known]] = 0
            now, symbol = now[known], symbol[known]
            if len(now):
                low[now] = self.before[symbol] + self.wavelet.rank(symbol, low[now])
                high[now] = self.before[symbol] + self.wavelet.rank(symbol, high[now])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by their place in the suffix order."""
        found, steps, now, open_ = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.copy(), np.arange(len(at))
        while len(open_):
            here = now[open_]
            hit = self.marked[here]
            done = open_[hit]
            found[done] = self.samples[self.mark_rank[here[hit]]] + steps[done]
            open_ = open_[~hit]
            symbol, rank = self.wavelet.access_rank(now[open_])
            now[open_] = self.before[symbol] + rank
            steps[open_] += 1
        return found
