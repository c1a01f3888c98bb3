"""Words, paragraphs, shingles and MinHash keys of a slice of texts, by arrays.

A paragraph is a run of words between two cuts. The cuts hang on the words
alone, not on line ends or full stops: a word begins a paragraph if the hash of
it and the next word is less than that of the RADIUS places before and not above
that of the RADIUS places behind it. So two copies of a passage are cut alike but
for about RADIUS words at both ends, whatever stands around them. Paragraphs
have about 12 words, and MOST_WORDS at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import _text as X
from .jaccard import THRESHOLD

SHINGLE = 5
RADIUS = 6
MOST_WORDS = 32
#: Texts that are laid out at once; a word takes some twenty numbers meanwhile.
SLICE_BYTES = 1 << 20


def bands_for(rows: int, recall: float, threshold: float = THRESHOLD) -> int:
    """The fewest bands of `rows` values with which a pair at the threshold meets with that probability."""
    n = 1
    while 1 - (1 - threshold**rows) ** n < recall:
        n += 1
    return n


def factors(n: int) -> np.ndarray:
    return X.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minima(values: np.ndarray, bounds: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each of n hash functions, the least value of each set of shingles."""
    for factor in factors(n):
        yield np.minimum.reduceat(values * factor, bounds[:-1])


class Layout:
    """Words of a slice of texts, and its paragraphs as ranges of words: paragraph k is bounds[k]..bounds[k + 1]."""

    def __init__(self, texts: list[bytes], whole_texts: bool = False) -> None:
        """whole_texts: each text with words is one paragraph."""
        buf, self.starts = X.joined(texts, lower=True)
        self.a, self.b = X.word_spans(buf, X.NON_SPACE)
        self.owner = X.owners(self.a, self.starts)
        self.first = X.per_document(self.a, self.starts)
        self.hashes = X.span_hashes(buf, self.a, self.b)
        n = len(self.a)
        edges = np.unique(np.append(self.first[:-1][np.diff(self.first) > 0], n))
        self.bounds = edges if whole_texts or not n else self._cuts(edges)

    def _cuts(self, edges: np.ndarray) -> np.ndarray:
        h = self.hashes
        value = X.mix(h * np.uint64(31) + np.append(h[1:], np.uint64(0)))
        value[edges[1:] - 1] = X.mix(h[edges[1:] - 1])  # the last word of a text
        n, most = len(h), ~np.uint64(0)
        before, behind = np.full(n, most), np.full(n, most)
        for j in range(1, min(RADIUS, n - 1) + 1):
            one_text = self.owner[j:] == self.owner[:-j]
            before[j:] = np.minimum(before[j:], np.where(one_text, value[:-j], most))
            behind[:-j] = np.minimum(behind[:-j], np.where(one_text, value[j:], most))
        at = np.union1d(np.flatnonzero((value < before) & (value <= behind)), edges)
        sizes = np.diff(at)
        parts = -(-sizes // MOST_WORDS)
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.append(np.repeat(at[:-1], parts) + place * MOST_WORDS, n)

    def sequence_hashes(self, bounds: np.ndarray) -> np.ndarray:
        """A hash of the words of each range."""
        if len(bounds) < 2:
            return np.empty(0, np.uint64)
        sizes = np.diff(bounds)
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
        scaled = X.mix(self.hashes ^ (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        return X.mix(np.add.reduceat(scaled, bounds[:-1]) + sizes.astype(np.uint64))

    def shingles(self, bounds: np.ndarray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The shingle hashes of those ranges (of all), one range after another, and the bounds of each one's. Fewer words than a shingle's are one."""
        if len(bounds) < 2:
            return np.empty(0, np.uint64), np.zeros(1, np.int64)
        which = np.arange(len(bounds) - 1) if which is None else which
        begin, end = bounds[which], bounds[which + 1]
        short = end - begin < SHINGLE
        counts = np.where(short, 1, end - begin - SHINGLE + 1)
        ends = np.append(0, np.cumsum(counts))
        windows = X.window_hashes(self.hashes, SHINGLE)
        out = np.zeros(ends[-1], np.uint64)
        whole = ~np.repeat(short, counts)
        at = np.repeat(begin - ends[:-1], counts) + np.arange(ends[-1])
        out[whole] = windows[at[whole]]
        if short.any():
            out[~whole] = self.sequence_hashes(bounds)[which[short]]
        return out, ends
