"""Connected components of a graph of links, by repeated contraction over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b); nodes with the same root are connected.

    A round points each node to its smallest neighbour, follows pointers twice,
    and replaces both ends of every link by what they point to; links inside a
    node go. Each round's tables are written, so neither a lost executor nor a
    long chain repeats earlier rounds, and every join has plain exchanges on both
    sides and none behind it that hangs on its key: adaptive execution splits the
    rows of a node with many links.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct())
    members = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")))
        for _ in range(2):
            above = point.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            point = written(point.join(above, "up").select("node", F.col("higher").alias("up")))
        if members is None:
            members = point.select("node", F.col("up").alias("root"))
        else:
            moved = point.select(F.col("node").alias("root"), "up")
            members = written(members.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        for end in ("a", "b"):
            moved = point.select(F.col("node").alias(end), "up")
            edges = written(edges.join(moved, end).withColumn(end, F.col("up")).drop("up").where("a <> b" if end == "b" else "true"))
        edges = written(edges.distinct())
    return links.select(F.col("a").alias("node"), F.col("a").alias("root")).where("false") if members is None else members
