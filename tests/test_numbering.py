"""Places in groups of any key type against a plain sort; how even the ranges are."""

from __future__ import annotations

import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import annotations as A


def values(rng, kind):
    day = datetime.date(2024, 1, 1)
    return {
        "string": lambda: rng.choice(["", "a", "é", "/data/é/img_", "\0"]) + str(rng.randint(0, 400)),
        "long": lambda: rng.choice([rng.randint(-9, 9), 2**62 + rng.randint(0, 9), -(2**62)]),
        "double": lambda: rng.choice([rng.uniform(-1, 1), float("inf"), 0.0]),
        "date": lambda: day + datetime.timedelta(rng.randint(-999, 999)),
        "timestamp": lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randint(0, 10**6)),
        "boolean": lambda: rng.random() < 0.5,
        "binary": lambda: bytes([rng.randint(0, 255)]),
    }[kind]


def key(v):
    return (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)


@pytest.mark.parametrize("kind", ["string", "long", "double", "date", "timestamp", "boolean", "binary"])
def test_places(spark, kind):
    rng = random.Random(kind)
    make = values(rng, kind)
    rows = [(rng.choice(["x", "hot", "hot", None]), rng.choice([1, None]), None if rng.random() < 0.1 else make(), k, 5) for k in range(500)] + [("single", 1, make(), 600, 5), ("empty", 1, None, 601, 5)]
    df = spark.createDataFrame(rows, f"g string, h int, v {kind}, k int, place int")
    want = {}
    groups = defaultdict(list)
    for r in rows:
        groups[r[:2]].append(r)
    for found in groups.values():
        for place, r in enumerate(sorted(found, key=lambda r: (key(r[2]), r[3])), 1):
            want[r[3]] = (place, len(found))
    got = {r["k"]: (r["__place"], r["__size"]) for r in A._placed(df.repartition(5), ["g", "h"], ["v", "k"]).collect()}
    assert got == want


def test_one_directory_of_paths_is_spread(spark):
    path = F.format_string("/mnt/data/uploads/receipts/winmart/img_%07d.jpg", F.col("id"))
    df = spark.range(20_000).select(F.lit("winmart").alias("folder"), path.alias("path"))
    counts = Counter({r["__range"]: r["count"] for r in A._ranged(df, ["folder"], ["path"]).groupBy("__range").count().collect()})
    assert len(counts) > 200 and max(counts.values()) < 400
    dealt = A.round_robin(df, ["folder"], ["path"], ["a", "b", "c"]).select((F.regexp_extract("path", r"(\d+)\.jpg", 1).cast("int") % 3).alias("n"), "member").distinct().collect()
    assert sorted(map(tuple, dealt)) == [(0, "a"), (1, "b"), (2, "c")]


def test_renumbering_runs_nothing_before_it_is_asked(spark):
    one, two = spark.range(5).withColumn("x", F.lit("one")), spark.range(3).select((F.col("id") * 10).alias("id"))
    spark.sparkContext.setJobGroup("planning", "none")
    found = A.renumbered([one, two, one.limit(0), one], ["id"])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == 0
    got = sorted((r["new_id"], r["source_rank"], r["id"], r["x"]) for r in found.collect())
    rows = [(0, k, "one") for k in range(5)] + [(1, k, None) for k in (0, 10, 20)] + [(3, k, "one") for k in range(5)]
    assert got == [(n, *r) for n, r in enumerate(rows, 1)]
