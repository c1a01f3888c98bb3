"""Links between the items of each bucket, found by comparing inside the bucket.

No pairs are emitted: a task yields trees over the items that its buckets link.
A bucket that weighs more than a chunk is cut into chunks by a hash of the item,
and every two chunks of it meet in a task of their own, so each comparison is
made and no task holds more than about two chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

CHUNK = 2048
#: Hot buckets that are joined by broadcast at most.
BROADCAST_ROWS = 50_000

#: Groups of up to this many items are compared all at once.
SMALL = 16


class Relation(Protocol):
    """What links two rows of a bucket."""

    def pairs(self, rows: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each pair of row numbers, whether the two rows link."""

    def within(self, rows: pa.Table, low: int, high: int) -> Callable[[int, np.ndarray], np.ndarray]:
        """For rows low..high-1: a function of one row and many that says which of these it links with."""


def trees(low: int, high: int, links: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that span each connected group of rows low..high-1; a row is compared with those not yet reached."""
    out, left = [], np.arange(low, high)
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            one = reached.pop()
            hit = links(one, left)
            new = left[hit].tolist()
            left = left[~hit]
            reached += new
            out += [(one, m) for m in new]
    return out


def _starts(rows: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for k in range(keys):
        x = rows.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows, which are sorted by the first columns, in tables that hold whole groups."""
    held = None
    for batch in batches:
        if batch.num_rows:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            last = int(_starts(now, keys)[-1])
            if last:
                yield now.slice(0, last).combine_chunks()
            held = now.slice(last)
    if held is not None:
        yield held.combine_chunks()


def _compared(rows: pa.Table, keys: int, relation: Relation) -> tuple[np.ndarray, np.ndarray]:
    starts = _starts(rows, keys)
    sizes = np.diff(np.append(starts, rows.num_rows))
    small = (sizes > 1) & (sizes <= SMALL)
    group_end = np.repeat(np.where(small, starts + sizes, 0), sizes)
    # of two chunks only what stands in different ones is compared here
    own = rows.column("own").to_numpy() if keys > 1 else None
    one_chunk = rows.column(1).to_numpy() == rows.column(2).to_numpy() if keys > 1 else None
    left, right = [], []
    at = np.flatnonzero(group_end)
    for shift in range(1, SMALL):
        at = at[at + shift < group_end[at]]
        if not len(at):
            break
        meet = at if own is None else at[one_chunk[at] | (own[at] != own[at + shift])]
        hit = relation.pairs(rows, meet, meet + shift)
        left.append(meet[hit])
        right.append(meet[hit] + shift)
    for k in np.flatnonzero(sizes > SMALL):
        low, high = int(starts[k]), int(starts[k] + sizes[k])
        links = relation.within(rows, low, high)
        if own is not None and not one_chunk[low]:
            inner = links
            links = lambda one, many, inner=inner: _where(own[many] != own[one], one, many, inner)
        found = np.array(trees(low, high, links), np.int64).reshape(-1, 2)
        left.append(found[:, 0])
        right.append(found[:, 1])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _where(meet: np.ndarray, one: int, many: np.ndarray, links: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    out = np.zeros(len(many), bool)
    out[meet] = links(one, many[meet])
    return out


def bucket_links(rows: DataFrame, relation: Relation, chunk: int = CHUNK, weight: str | None = None) -> DataFrame:
    """Links (a, b) among the items of each bucket. rows: bucket and item (long, an item once in a bucket), then what the relation needs.

    A chunk holds about `chunk` items, or items whose column `weight` adds up to that.
    """
    total = F.sum(weight) if weight else F.count("*")
    hot = cut(rows.groupBy("bucket").agg(total.alias("n")).where(F.col("n") > chunk))
    n_hot = hot.count()
    others = [c for c in rows.columns if c not in ("bucket", "item")]
    keys, dealt = ["bucket"], rows
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        parts = F.ceil(F.coalesce("n", F.lit(1)) / chunk)
        dealt = rows.join(hot, "bucket", "left").withColumn("parts", parts)
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("item"), F.col("parts")))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        keys, others = ["bucket", "i", "j"], [*others, "own"]
    dealt = dealt.select(*keys, "item", *others).repartition(*keys).sortWithinPartitions(*keys, "item")
    n_keys = len(keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}  # of the items that this task has linked

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for table in _whole_groups(batches, n_keys):
            a, b = _compared(table, n_keys, relation)
            item = table.column("item").to_numpy()
            new = []
            for x, y in zip(item[a].tolist(), item[b].tolist(), strict=True):
                p, q = top(x), top(y)
                if p != q:  # else buckets before this one have joined the two
                    up[max(p, q)] = min(p, q)
                    new.append((x, y))
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([min(e) for e in new], pa.int64()), pa.array([max(e) for e in new], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")
