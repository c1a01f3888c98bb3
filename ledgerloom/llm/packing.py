"""Best-fit packing of documents into fixed-length sequences, under conflicts.

A bin takes at most one piece of any source and of any duplicate cluster. Pieces
are dealt by a hash of their id to groups of a fixed expected size, whatever
source or cluster they come from, and each group is packed on its own in one
task; so a hot source never gathers in one place.
"""

from __future__ import annotations

import bisect
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

WORD = r"[^\x20\x09-\x0D]+"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, taken in the order given.

    The open bins are ordered by residual space. The search begins at the first
    bin that the piece fits, and goes on to its successors until one has neither
    the piece's source nor its cluster in its bitmaps: the tightest compatible
    bin. None: a new bin. A null source or cluster conflicts with nothing.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(c for c in clusters if c is not None))}
    residuals: list[tuple[int, int]] = []  # (space left, bin)
    seen: list[list[int]] = []  # by bin: bitmap of sources, of clusters
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect.bisect_left(residuals, (size, -1))
        while at < len(residuals):
            maps = seen[residuals[at][1]]
            if not maps[0] & s and not maps[1] & c:
                break
            at += 1
        if at < len(residuals):
            left, number = residuals.pop(at)
        else:
            left, number = capacity, len(seen)
            seen.append([0, 0])
        placed.append((number, capacity - left))
        seen[number][0] |= s
        seen[number][1] |= c
        if left > size:
            bisect.insort(residuals, (left - size, number))
    return placed


def packed(docs: DataFrame, capacity: int = 2048, group_size: int = 4096, id_col: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin, position, bin_group): where each piece of each document goes.

    Tokens are words. A document of more than `capacity` words is cut into
    pieces of `capacity` and a rest; `start` is the first word of the piece and
    `position` its offset in the bin. The bin is named "group-number". Pieces are
    taken by size, largest first, then by id, piece, source and cluster, so the
    bins don't hang on the order of the table. `cluster` names a column
    with the duplicate cluster; without it texts that are equal form a cluster.
    A null or wordless text has one row with a null bin. A null id is packed
    like any other; repeated rows are packed once each. A very long text is only
    counted whole; its pieces are packed like others. Other columns are ignored;
    an empty table gives no rows.
    """
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    group = F.col(cluster).cast("string") if cluster else F.xxhash64(F.col(text)).cast("string")
    slim = cut(docs.select(F.col(id_col).alias("doc_id"), n.alias("n"), F.col(source).cast("string").alias("source"), group.alias("cluster")))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1)
    pieces = slim.select("doc_id", "source", "cluster", "n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    pieces = pieces.select(
        "doc_id", "source", "cluster", "piece", (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n_tokens"),
    )
    total = slim.agg(F.sum(last + 1)).first()[0] or 0
    groups = max(1, math.ceil(total / group_size))
    # rows alike in all that counts are numbered by their count, so that repeated ids spread, whatever the layout of the table
    alike = ["doc_id", "source", "cluster", "piece", "start", "n_tokens"]
    counted = pieces.where("n_tokens > 0").groupBy(*alike).agg(F.count("*").alias("n"))
    dealt = counted.select(*alike, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    dealt = dealt.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", "source", "cluster", "copy"), F.lit(groups)))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "source", "cluster", "copy"))])
        columns = [rows.column(c).to_pylist() for c in ("n_tokens", "source", "cluster", "bin_group")]
        at = best_fit(*columns[:3], capacity)
        bins = [f"{g}-{b}" for g, (b, _) in zip(columns[3], at, strict=True)]
        out = rows.select(["doc_id", "piece", "start", "n_tokens"])
        for name, made in (("bin", pa.array(bins, pa.string())), ("position", pa.array([p for _, p in at], pa.int64())), ("bin_group", rows.column("bin_group"))):
            out = out.append_column(name, made)
        return out

    kind = dict(docs.dtypes)[id_col]
    names = f"doc_id {kind}, piece long, start long, n_tokens long, bin string, position long, bin_group long"
    out = dealt.groupBy("bin_group").applyInArrow(pack, names)
    empty = pieces.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("position"), F.lit(None).cast("long").alias("bin_group"))
    return out.unionByName(empty)
