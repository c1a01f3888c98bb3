"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when at most 3 bits differ. Bits 0-30 and 31-61
form two halves; two linked fingerprints differ by at most 1 bit in one of them.
In each half the anchors are the words of the [31, 26] Hamming code, whose
covering radius is 1: every value has an anchor within 1 bit, and that anchor is
within 1 + 1 = 2 bits of the other value. So each fingerprint goes to every
anchor within 2 bits (at most 16 a half) and is compared, in all 64 bits, with
those that share an anchor. Copies are one fingerprint; hot anchors are split
into chunks. Links become components by contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from .buckets import bucket_links
from .components import components
from .jaccard import THRESHOLD, SimilarSets, verified
from .lookup import passes, sieve
from .paragraphs import SLICE_BYTES, Layout, bands_for, factors, minima
from .tables import cut, free_names, written

HALF = 31
MAX_BITS = 3
SHINGLE = 3
SEED = 42
#: Shingles that are held at once.
PART_SHINGLES = 1 << 20
#: For near copies by shingles: share of the pairs at the threshold that meet in a band, values of a band, and the bands for
#: it; 64-bit columns of a sketch, and how many of its bits may differ (at the threshold each does with a probability of 0.1).
RECALL = 0.9999
BAND_ROWS = 3
BANDS = bands_for(BAND_ROWS, RECALL)
SKETCH = ["s0", "s1", "s2", "s3"]
NEAR_BITS = 50
#: Shingles of the sets that make a chunk of a group.
CHUNK_SHINGLES = 2 << 20


def shingle_hashes(text: bytes, width: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of `width` words, lower-cased in A-Z; fewer words are one shingle."""
    words = text.translate(X.LOWER).split()
    if 0 < len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(w), seed) for w in zip(*(words[k:] for k in range(width)), strict=False)]


def fingerprint(hashes: list[int]) -> int:
    """Bits that over half of the hashes have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), PART_SHINGLES):
        values = np.array(hashes[k : k + PART_SHINGLES], "<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns to carry, fp long) of each input row; null and wordless texts have fingerprint 0."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, docs.schema[c].dataType) for c in carry), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in X.text_chunks(batches, "__text"):
            fp = np.array([fingerprint(shingle_hashes(t)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp)], names=schema.names)

    return docs.select(F.col(id_col), *(F.col(c) for c in carry), F.col(text).alias("__text")).mapInArrow(run, schema)


def _with_syndrome(x: Column) -> Column:
    """The 31-bit value and its syndrome: the position of the bit that parts it from the nearest code word, 0 for none."""
    syndrome = F.lit(0)
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, HALF + 1) if i >> j & 1)
        syndrome = syndrome + (F.bit_count(x.bitwiseAND(F.lit(mask).cast("long"))) % 2) * (1 << j)
    return F.struct(x.alias("x"), syndrome.cast("int").alias("s"), F.lit(1).cast("long").alias("one"))


def anchor_rows(prints: DataFrame, carry: tuple[str, ...] = ("fp",)) -> DataFrame:
    """(bucket, columns to carry): each fingerprint `fp` at each of its anchors; the bucket names the half and the anchor."""
    halves = prints.select(*{"fp": None, **dict.fromkeys(carry)}, F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    low = (1 << HALF) - 1
    value = F.expr(f"shiftrightunsigned(fp, half * {HALF}) & {low}L")
    found = halves.select(*carry, "half", _with_syndrome(value).alias("v"))
    near = """
        if(v.s = 0, array(v.x), concat(
            array(v.x ^ shiftleft(v.one, v.s - 1)),
            transform(filter(sequence(1, 31), i -> i < (i ^ v.s)), i -> v.x ^ shiftleft(v.one, i - 1) ^ shiftleft(v.one, (i ^ v.s) - 1))))
    """
    found = found.select(*carry, "half", F.explode(F.expr(near)).alias("anchor"))
    return found.select((F.col("anchor") + F.col("half") * F.lit(1 << HALF).cast("long")).alias("bucket"), *carry)


class NearValues:
    """For buckets: rows whose 64-bit columns differ in few bits in all. Rows of one `root`, where there is that column, are not compared."""

    def __init__(self, columns: list[str], most: int) -> None:
        self.columns, self.most = columns, most

    def pairs(self, rows: pa.Table, i: int | np.ndarray, j: np.ndarray) -> np.ndarray:
        differing = np.zeros(len(j), np.int64)
        for c in self.columns:
            x = rows.column(c).to_numpy()
            differing += np.bitwise_count((x[i] ^ x[j]).view(np.uint64))
        near = differing <= self.most
        if "root" in rows.column_names:
            root = rows.column("root").to_numpy()
            near &= root[i] != root[j]
        return near

    def within(self, rows: pa.Table, low: int, high: int):
        return lambda one, many: self.pairs(rows, one, many)


def fingerprint_roots(prints: DataFrame) -> DataFrame:
    """The rows, one a fingerprint `fp`, with `root`: the fingerprints that links of MAX_BITS bits at most connect have one."""
    roots = components(bucket_links(anchor_rows(prints).withColumnRenamed("fp", "item"), NearValues(["item"], MAX_BITS)))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return rooted.withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns to carry, fp, component_id) of each input row; component_id is the smallest id that links reach, the row's own included.

    Null ids take part; they have the component's smallest id, or null where all
    ids of it are null. Null, empty and wordless texts have fingerprint zero; a
    very long text is hashed whole, by one task. Repeated rows come out as often
    as they came in. Other columns are ignored; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text, carry))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    rooted = fingerprint_roots(prints)
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", *carry, "fp", "component_id")


def fingerprint_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- near copies by five-word shingles


def sketches(layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text with words: a row of BANDS keys, a row of sketch values, and its number of shingles.

    All come from minima over the five-word shingles, so two texts agree in each
    with a probability that hangs on their Jaccard similarity only, not on where
    they differ.
    """
    values, bounds = layout.shingles(layout.bounds)
    keys = np.zeros((len(bounds) - 1, BANDS), np.uint64)
    bits = np.zeros((len(bounds) - 1, len(SKETCH)), np.uint64)
    if len(keys):
        for k, least in enumerate(minima(values, bounds, BANDS * BAND_ROWS)):
            keys[:, k // BAND_ROWS] = X.mix(keys[:, k // BAND_ROWS] * np.uint64(31) + least + np.uint64(k))
        half = (values >> np.uint64(32)).astype(np.uint32)
        for k, factor in enumerate((factors(64 * len(SKETCH)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)):
            least = np.minimum.reduceat(half * factor, bounds[:-1]).astype(np.uint64)
            bits[:, k // 64] |= (X.mix(least + np.uint64(k)) & np.uint64(1)) << np.uint64(k % 64)
    return keys, bits, np.diff(bounds)


def _apart(x: str, y: str) -> Column:
    """In how many sketch bits two structs differ."""
    return reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in SKETCH))


def _stars(live: DataFrame, pivots: DataFrame) -> DataFrame:
    """(a, b): pivots (bucket, pivot) with the rows of other roots in their buckets that may be similar, each pair once."""
    size = (F.col("pivot.size"), F.col("row.size"))
    both = live.select("bucket", F.struct("item", "size", "root", *SKETCH).alias("row")).join(pivots, "bucket")
    both = both.where((F.col("row.root") != F.col("pivot.root")) & (F.least(*size) >= THRESHOLD * F.greatest(*size)))
    return both.where(_apart("row", "pivot") <= NEAR_BITS).select(F.col("pivot.item").alias("a"), F.col("row.item").alias("b")).distinct()


def _rooted(live: DataFrame, links: list[DataFrame]) -> DataFrame:
    """The rows with the roots of their items over all links so far, of buckets with several roots only."""
    roots = components(reduce(DataFrame.unionByName, links)).withColumnRenamed("node", "item")
    now = live.drop("root").join(roots, "item", "left").withColumn("root", F.coalesce("root", "item"))
    several = now.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    return written(written(now).join(several, "bucket"))


def _similar_links(live: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Tables of links (a, b) that connect similar items of the buckets. live: (bucket, item, score, size, sketch); sets: (item, shingles).

    First one pivot a bucket, the row that has most company in all its buckets,
    is compared with the others: in a family of copies of one text this links
    nearly all. A second pivot follows, of those that the first didn't reach.
    What is left, pairs of different roots without a pivot among them, is
    compared inside groups of near sketches, chunk by chunk.
    """
    best = F.max(F.struct("score", "item", "size", "root", *SKETCH)).alias("pivot")
    live = live.withColumn("root", F.col("item"))
    pivots = written(live.groupBy("bucket").agg(best))
    pairs = written(_stars(live, pivots))
    links = [written(verified(pairs, sets))]
    live = _rooted(live, links)
    if live.isEmpty():
        return links
    first = live.join(pivots.select("bucket", F.col("pivot.item").alias("item")), ["bucket", "item"], "left_semi").select("bucket", F.col("root").alias("reached"))
    tested = pivots.select("bucket", F.col("pivot.item").alias("item"))
    second = written(live.join(first, "bucket").where("root != reached").groupBy("bucket").agg(best))
    links.append(written(verified(_stars(live.join(tested, ["bucket", "item"], "left_anti"), second), sets)))
    tested = tested.unionByName(second.select("bucket", F.col("pivot.item").alias("item")))
    live = _rooted(live.join(tested, ["bucket", "item"], "left_anti"), links)
    if live.isEmpty():
        return links
    groups = written(components(bucket_links(live.select("bucket", "item", "root", *SKETCH), NearValues(SKETCH, NEAR_BITS))))
    roots = live.select("item", "root").distinct()
    rest = groups.select(F.col("root").alias("bucket"), F.col("node").alias("item")).join(roots, "item").join(sets, "item")
    rest = written(rest.select("bucket", "item", "root", "shingles", F.size("shingles").cast("long").alias("weight")))
    return [*links, bucket_links(rest, SimilarSets(), CHUNK_SHINGLES, "weight")]


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, words_hash, root) of each input row: rows with one root are copies or near copies.

    Near copies have a Jaccard similarity of 0.8 or more of their five-word
    shingles, lower-cased; a text of fewer words is one shingle, texts without
    words are copies of each other. The candidates are found by MinHash bands
    over those shingles: of pairs at 0.8, a share of RECALL meets in a band, be
    the edits scattered, in one block or a cut. Pairs that meet and differ in
    NEAR_BITS bits of a sketch or fewer are verified by their exact similarity (a
    pair at 0.8 differs in more with a probability under 1e-5); only verified
    links are followed from text to text. Null ids and repeated rows come out as
    they came in; a very long text is one set in one task; an empty table gives
    no rows. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("__text"))
    names = ["doc_id", "text_hash", "item", "size", *SKETCH, "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in X.text_chunks(batches, "__text", SLICE_BYTES):
            layout = Layout(texts, whole_texts=True)
            some = layout.owner[layout.bounds[:-1]]
            keys, bits, counts = sketches(layout)
            item, size, sketch = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64), np.zeros((len(texts), len(SKETCH)), np.uint64)
            item[some], size[some], sketch[some] = layout.sequence_hashes(layout.bounds), counts, bits
            ends = np.zeros(len(texts) + 1, np.int32)
            ends[some + 1] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(item.view(np.int64)), pa.array(size), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in sketch.T), bands], names=names)

    schema = f"doc_id {dict(slim.dtypes)['doc_id']}, text_hash long, item long, size long, {', '.join(f'{c} long' for c in SKETCH)}, bands array<long>"
    rows = written(slim.mapInArrow(run, schema))
    mark = F.xxhash64("doc_id", "text_hash")
    items = rows.where("size > 0").groupBy("item").agg(F.min(mark).alias("mark"), *(F.first(c).alias(c) for c in ("size", *SKETCH, "bands")))
    items = written(items)
    placed = items.select(F.explode("bands").alias("bucket"), "item")
    company = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(placed.join(company, "bucket"))
    score = shared.groupBy("item").agg(F.sum("n").alias("score"))
    live = written(shared.select("bucket", "item").join(score, "item").join(items.select("item", "size", *SKETCH), "item"))
    near = written(bucket_links(live.select("bucket", "item", *SKETCH), NearValues(SKETCH, NEAR_BITS)))
    members = near.select(F.col("a").alias("item")).unionByName(near.select(F.col("b").alias("item"))).distinct()
    members = written(items.select("item", "mark").join(members, "item"))
    passing = sieve(members, "mark")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in X.text_chunks(batches, "__text", SLICE_BYTES):
            wanted = np.flatnonzero(passes(passing.value, part.column(0).to_numpy().view(np.uint64)))
            layout = Layout([texts[k] for k in wanted.tolist()], whole_texts=True)
            values, bounds = layout.shingles(layout.bounds)
            sets = [np.unique(values[x:y]).view(np.int64) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(layout.sequence_hashes(layout.bounds).view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["item", "shingles"])

    taken = slim.select(mark.alias("mark"), "__text").mapInArrow(take, "item long, shingles array<long>")
    sets = written(taken.join(members.select("item"), "item", "left_semi").dropDuplicates(["item"]))
    passing.unpersist()
    links = _similar_links(written(live.join(members.select("item"), "item", "left_semi")), sets)
    roots = components(reduce(DataFrame.unionByName, links))
    named = rows.select("doc_id", "text_hash", F.col("item").alias("node")).join(roots, "node", "left")
    return named.select("doc_id", "text_hash", F.col("node").alias("words_hash"), F.coalesce("root", "node").alias("root"))


def _joined_by_fingerprints(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """The rows (text_hash, root) with roots over near fingerprints as well. prints: (text_hash, fp), a row a text."""
    near = fingerprint_roots(cut(prints.select("fp").distinct()))
    group = prints.join(near, "fp").select("text_hash", F.xxhash64(F.lit("fp"), "root").alias("b"))
    pairs = written(rows.select("text_hash", F.col("root").alias("a")).distinct().join(group, "text_hash").select("a", "b").distinct())
    several = pairs.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").select("b")
    joined = components(written(pairs.join(several, "b"))).select(F.col("node").alias("root"), F.col("root").alias("joined"))
    return rows.join(joined, "root", "left").withColumn("root", F.coalesce("joined", "root")).drop("joined")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", by_fingerprint: bool = False) -> DataFrame:
    """One document of each group of similar documents, all columns kept: that of the smallest id, then text hash; null ids come last.

    Documents are similar by similar_documents(); `by_fingerprint` adds the
    links of near_duplicates(), of SimHash fingerprints that differ in MAX_BITS
    bits at most, and links of both kinds make the groups. Of rows alike in id and text any one stays. Null and empty texts are one
    group; an empty table stays empty.
    """
    hash_, id_, own = free_names(docs, "hash", "id", "own")
    hashed = docs.withColumn(hash_, F.xxhash64(F.col(text)))
    rows = written(similar_documents(docs, id_col, text))
    if by_fingerprint:
        prints = written(fingerprints(hashed, hash_, text).select(F.col("doc_id").alias("text_hash"), "fp").distinct())
        rows = written(_joined_by_fingerprints(rows, prints))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("text_hash").alias("h"))
    stays = rows.groupBy("root").agg(F.min(order).alias("r")).select(F.col("r.id").alias(id_), F.col("r.h").alias(own))
    kept = hashed.join(stays, hashed[id_col].eqNullSafe(stays[id_]) & (hashed[hash_] == stays[own]), "left_semi")
    if not rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, hash_])
    return kept.select(*docs.columns)
