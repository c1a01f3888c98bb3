"""Exact Jaccard similarity of shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

#: Similarity from which two texts are near copies.
THRESHOLD = 0.8
#: Shingles that one comparison holds at most, beyond those of one pair.
COMPARED = 4 << 20


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of each set, and all of them one after another."""
    sets = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy().view(np.uint64)


def _places(bounds: np.ndarray, which: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(bounds[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())


def similar(left: pa.Array | pa.ChunkedArray, right: pa.Array | pa.ChunkedArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether set i of the left and set j of the right, pair by pair, have a Jaccard similarity of THRESHOLD. A set has no value twice."""
    (bounds_l, flat_l), (bounds_r, flat_r) = _flat(left), _flat(right)
    size_l, size_r = np.diff(bounds_l)[i], np.diff(bounds_r)[j]
    out = np.zeros(len(i), bool)
    at = np.flatnonzero(np.minimum(size_l, size_r) >= THRESHOLD * np.maximum(size_l, size_r))
    total = np.cumsum(size_l[at] + size_r[at])
    low = 0
    while low < len(at):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + COMPARED)))
        now = at[low:high]
        keys = []
        for bounds, flat, which, count in ((bounds_l, flat_l, i[now], size_l[now]), (bounds_r, flat_r, j[now], size_r[now])):
            keys.append(X.mix(flat[_places(bounds, which, count)] ^ X.mix(np.repeat(np.arange(len(now), dtype=np.uint64), count) + np.uint64(1))))
        pair = np.repeat(np.arange(len(now)), size_l[now])
        common = np.bincount(pair[np.isin(keys[0], keys[1])], minlength=len(now))
        out[now] = common >= THRESHOLD * (size_l[now] + size_r[now] - common)
        low = high
    return out


class SimilarSets:
    """For buckets: rows whose column `shingles` holds similar sets. Rows of one `root`, where there is that column, are known to be linked and not compared."""

    def pairs(self, rows: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        open_ = np.flatnonzero(self._apart(rows, i, j))
        sets = rows.column("shingles").combine_chunks()
        out[open_] = similar(sets, sets, i[open_], j[open_])
        return out

    def within(self, rows: pa.Table, low: int, high: int) -> Callable[[int, np.ndarray], np.ndarray]:
        bounds, flat = _flat(rows.column("shingles"))
        _, number = np.unique(flat[bounds[low] : bounds[high]], return_inverse=True)
        bounds = bounds[low : high + 1] - bounds[low]
        sizes = np.diff(bounds)
        own = np.zeros(int(number.max(initial=-1)) + 1, np.int64)

        def links(one: int, many: np.ndarray) -> np.ndarray:
            out = np.zeros(len(many), bool)
            a, b = one - low, many - low
            fits = np.minimum(sizes[a], sizes[b]) >= THRESHOLD * np.maximum(sizes[a], sizes[b])
            open_ = np.flatnonzero(fits & self._apart(rows, one, many))
            own[number[bounds[a] : bounds[a + 1]]] = 1
            step = max(1, COMPARED // max(1, int(sizes[b[open_]].max(initial=1))))
            for k in range(0, len(open_), step):
                now = open_[k : k + step]
                count = sizes[b[now]]
                common = np.add.reduceat(own[number[_places(bounds, b[now], count)]], np.cumsum(count) - count)
                out[now] = common >= THRESHOLD * (sizes[a] + count - common)
            own[number[bounds[a] : bounds[a + 1]]] = 0
            return out

        return links

    @staticmethod
    def _apart(rows: pa.Table, i: int | np.ndarray, j: np.ndarray) -> np.ndarray:
        if "root" not in rows.column_names:
            return np.ones(len(j), bool)
        root = rows.column("root").to_numpy()
        return root[i] != root[j]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets, found by item in `sets` (item, shingles), are similar. Rows hold two sets, whatever an item's number of pairs."""
    own = sets.select(F.col("item").alias("a"), F.col("shingles").alias("left"))
    other = sets.select(F.col("item").alias("b"), F.col("shingles").alias("right"))
    both = pairs.select("a", "b").join(other, "b").join(own, "a").select("a", "b", "left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(batch.num_rows)
            hit = pa.array(similar(batch.column("left"), batch.column("right"), at, at))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])

    return both.mapInArrow(compare, "a long, b long")
