"""Vectorised byte-level text helpers used inside Arrow tasks.

A chunk of documents becomes one byte buffer in which a newline stands before
and after every text, so no word crosses a document. All word classes used here
are closed under UTF-8 bytes: a byte of 0x80 or more is always a word byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_SPACE = {0x20, *range(0x09, 0x0E)}
#: Words of the class [^\x20\x09-\x0D].
NON_SPACE = np.array([c not in _SPACE for c in range(256)])
#: Words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing A-Z.
ALNUM = np.array([0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts hold about `limit` bytes, or one longer text; null texts become empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy() + np.int64(1))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start), [t or b"" for t in texts.slice(start, stop - start).to_pylist()]
            start = stop


def joined(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The buffer of all texts, and the offset at which each begins."""
    whole = b"\n" + b"\n".join(texts) + b"\n"
    if lower:
        whole = whole.translate(LOWER)
    starts = np.ones(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    starts[1:] += 1
    return np.frombuffer(whole, np.uint8), starts


def word_spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words begin and end."""
    inside = table[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return edges[0::2], edges[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_held: dict[str, np.ndarray] = {}


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit polynomial hash of each of the ordered, disjoint spans of bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + block)))
        low, high = int(starts[i]), int(ends[j - 1])
        n = high - low
        if len(_held.get("powers", ())) < n + 1:
            size = max(n + 1, block + (1 << 16))
            _held.update(powers=_powers(_BASE, size), inverse=_powers(_BASE_INVERSE, size))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buf[low:high].astype(np.uint64) + np.uint64(1)) * _held["powers"][:n], out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * _held["inverse"][a]
        i = j
    return mix(out)


def owners(starts: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """For each span, the index of the document that it lies in."""
    counts = np.diff(np.searchsorted(starts, doc_starts))
    return np.repeat(np.arange(len(counts)), counts)


def per_document(starts: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """For each document the index of its first span, then the number of spans."""
    return np.searchsorted(starts, doc_starts)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` values."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + n]
    return mix(out)
