"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by the leading bits of a document's hash. A bucket
whose bytes exceed the limit is split on one more bit, and only such buckets
are; so a shard is the shortest hash prefix whose documents fit. A pass settles
several bits at once: it sums bytes at the deepest of them (partial sums before
the shuffle), rolls the sums up to every shorter prefix and keeps each prefix
that fits while its parent does not.

The hash has 60 bits from the md5 of the key and 60 more from the md5 of the
text, so rows that share one key still split. Rows alike in both can't be told
apart by any hash; their bucket is cut into numbered pages by counting rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, free_names

KEY_BITS = 60
ALL_BITS = 120
#: Bits that one pass settles at most.
PASS_BITS = 26


def _bits(column: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(column), 1, 15), 16, 2), KEY_BITS, "0")


def _pass_bits(total: int, limit: int) -> int:
    return min(PASS_BITS, max(0, math.ceil(math.log2(max(1, total) / limit)) + 1)) if total > limit else 0


def _settle(rows: DataFrame, width: int, limit: int) -> DataFrame:
    """(base, bucket, shard, shard_bytes, shard_docs) for each bucket of `width` bits that some fitting prefix covers."""
    sums = rows.groupBy("base", F.substring("bits", F.length("base") + 1, F.lit(width)).alias("bucket")).agg(
        F.sum("n_bytes").alias("b"), F.count("*").alias("n")
    )
    by_depth = sums.select("base", "bucket", "b", "n", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("d")).withColumn(
        "prefix", F.substring("bucket", F.lit(1), F.col("d"))
    )
    nodes = by_depth.groupBy("base", "d", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    nodes = nodes.withColumn("fits", (F.col("b") <= limit) | (F.col("n") == 1))
    parents = nodes.where(~F.col("fits")).select("base", (F.col("d") + 1).alias("d"), F.col("prefix").alias("up"))
    # a base that is not the root is there because it doesn't fit
    inner = nodes.where("fits").withColumn("up", F.substring("prefix", F.lit(1), F.col("d") - 1))
    leaves = (inner.where("d > 0").join(parents, ["base", "d", "up"], "left_semi")).unionByName(inner.where("d = 0"))
    found = leaves.select("base", "d", "prefix", F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"))
    return by_depth.select("base", "bucket", "d", "prefix").join(found, ["base", "d", "prefix"]).select(
        "base", "bucket", F.concat("base", "prefix").alias("shard"), "shard_bytes", "shard_docs"
    )


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Pages for rows alike in key and text: row numbers from counts by partition, so no task gathers a group."""
    numbered = cut(rows.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()))
    counts = numbered.groupBy("bits", "part").agg(F.count("*").alias("here"))
    order = Window.partitionBy("bits").orderBy("part")
    before = counts.withColumn("before", F.sum("here").over(order) - F.col("here")).drop("here")
    within = F.row_number().over(Window.partitionBy("bits", "part").orderBy("seq")) - 1
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("n_bytes"))))
    paged = numbered.withColumn("within", within).join(before, ["bits", "part"])
    paged = paged.withColumn("page", F.floor((F.col("before") + F.col("within")) / per_page).cast("long"))
    sizes = paged.groupBy("bits", "page").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return paged.join(sizes, ["bits", "page"]).withColumn("shard", F.col("bits")).drop("part", "seq", "before", "within")


def extendible_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = 16 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: `key`, the columns to carry, n_bytes, shard, depth, page, shard_bytes, shard_docs, oversized.

    `shard` is "s" and the bits of the prefix ("s" alone: everything fits one
    shard). A null key hashes as the empty string and a null text has no bytes.
    Repeated rows share a shard as long as they fit it, else take pages. A
    single document over the limit has a shard of its own, marked oversized. An
    empty table gives no rows. Other columns are ignored unless carried; names
    to carry must differ from the columns made here.
    """
    spark = docs.sparkSession
    own = [F.col(key), *(F.col(c) for c in carry)]
    size = F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long"))
    bits = F.concat(_bits(F.coalesce(F.col(key).cast("string"), F.lit(""))), _bits(F.coalesce(F.col(text), F.lit(""))))
    rows = cut(docs.select(*own, size.alias("n_bytes"), bits.alias("bits"), F.lit("").alias("base")))
    kept = [key, *carry, "n_bytes", "bits", "shard", "page", "shard_bytes", "shard_docs"]
    done, depth = [], 0
    worst = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    while True:
        # the last pass for the key ends at its last bit, the next goes on in the text's
        width = min(_pass_bits(worst, max_bytes), ALL_BITS - depth)
        settled = cut(_settle(rows, width, max_bytes))
        bucket = F.substring("bits", F.length("base") + 1, F.lit(width))
        placed = rows.withColumn("bucket", bucket).join(settled, ["base", "bucket"])
        done.append(placed.withColumn("page", F.lit(0).cast("long")).select(*kept))
        depth += width
        rest = rows.withColumn("bucket", bucket).join(settled, ["base", "bucket"], "left_anti")
        sums = rest.groupBy("base", "bucket").agg(F.sum("n_bytes").alias("b")).agg(F.max("b")).first()[0]
        if sums is None:
            break
        rows, worst = cut(rest.withColumn("base", F.concat("base", "bucket")).drop("bucket")), sums
        if depth >= ALL_BITS:
            done.append(_pages(rows, max_bytes).select(*kept))
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        key, *carry, "n_bytes", F.concat(F.lit("s"), "shard").alias("shard"), F.length("shard").alias("depth"), "page",
        "shard_bytes", "shard_docs", (F.col("shard_bytes") > max_bytes).alias("oversized"),
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", max_bytes: int = 16 << 20) -> DataFrame:
    """Writes all columns as Parquet, one folder for each shard and page, and returns the assignment that it used.

    The columns may have any names; where they have `shard` or `page`, the
    folders' names get underscores before them. Nulls, empty texts and repeated
    rows are written as they are; an empty table has no folders.
    """
    inner = {c: f"__c{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    placed = extendible_shards(renamed, inner[key], inner[text], max_bytes, tuple(n for c, n in inner.items() if c != key))
    made = [c for c in placed.columns if not c.startswith("__c")]
    folders = free_names(docs, "shard", "page")
    rows = placed.select(*(F.col(n).alias(c) for c, n in inner.items()), *(F.col(c).alias(f) for c, f in zip(("shard", "page"), folders, strict=True)))
    rows.repartition(*folders).write.partitionBy(*folders).parquet(path)
    return placed.select(F.col(inner[key]).alias(key), *(c for c in made if c != key))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT) AS h
  FROM documents),
g AS (SELECT unnest(range(0, 31)) AS depth),
n AS (SELECT depth, h >> (60 - depth)::INT AS p, sum(n_bytes) AS b, count(*) AS c FROM d, g GROUP BY 1, 2),
f AS (SELECT d.doc_id, d.n_bytes, d.h, min(n.depth) AS depth FROM d, n
      WHERE n.p = (d.h >> (60 - n.depth)::INT) AND (n.b <= {limit} OR n.c = 1) GROUP BY ALL)
SELECT f.doc_id, f.n_bytes, 's' || CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(f.h >> (60 - f.depth)::INT), f.depth::INT, '0') END AS shard,
       f.depth::INT AS depth, 0::BIGINT AS page, n.b::BIGINT AS shard_bytes, n.c::BIGINT AS shard_docs, n.b > {limit} AS oversized
FROM f JOIN n ON n.depth = f.depth AND n.p = (f.h >> (60 - f.depth)::INT)
"""
