"""Substring deduplication: passages that repeat, found by paragraph.

Paragraphs are cut by their words (see `paragraphs`), so a passage inside a longer
line, or wrapped at other places, has the same paragraphs as its copy. MinHash
bands over the five-word shingles of each paragraph tell which may repeat; the
exact Jaccard similarity of those that meet in a band decides; paragraphs linked
in this way are a component. Of each component the occurrence of the smallest
(id, text hash, place) stays; the others are marked. Where a run of marked
paragraphs ends, it is extended word by word along the occurrence that stays,
over one word changed, put in or left out. A run of `min_words` and more is
removed.

A first pass counts the band keys. A second one writes the paragraphs with a key
that occurs more than once, each distinct one of a slice with its shingles: at
most MOST_WORDS, fewer than a signature would have. A third one takes the words
around the ends of runs, of texts that have any. The texts never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from .buckets import bucket_links
from .components import components
from .jaccard import SimilarSets
from .lookup import passes, sieve
from .paragraphs import SHINGLE, SLICE_BYTES, Layout, bands_for, minima
from .tables import free_names, written

#: Words of a run that is removed: less than the 50 of a passage, because changed words may part it.
MIN_WORDS = 40
RECALL = 0.98
BAND_ROWS = 2
BANDS = bands_for(BAND_ROWS, RECALL)
#: Words that are compared beyond each end of a run, and equal words that must follow a changed one.
CONTEXT = 37
BRIDGE = 4

#: Of an occurrence: words from the text's first on, bytes.
PLACE = ["w0", "w1", "first", "end"]


def keys_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of band keys for each set of shingles."""
    keys = np.zeros((len(bounds) - 1, BANDS), np.uint64)
    if len(keys):
        for k, least in enumerate(minima(values, bounds, BANDS * BAND_ROWS)):
            keys[:, k // BAND_ROWS] = X.mix(keys[:, k // BAND_ROWS] * np.uint64(31) + least + np.uint64(k))
    return keys


def band_keys(layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The paragraphs of SHINGLE words and more, by number; a row of keys for each; their shingles and the bounds of these."""
    which = np.flatnonzero(np.diff(layout.bounds) >= SHINGLE)
    values, bounds = layout.shingles(layout.bounds, which)
    return which, keys_of(values, bounds), values, bounds


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _repeated_keys(docs: DataFrame) -> DataFrame:
    """(key): the band keys that occur more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in X.text_chunks(batches, "text", SLICE_BYTES):
            _, keys, _, _ = band_keys(Layout(texts))
            keys, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([_long(keys), pa.array(np.minimum(n, 2).astype(np.int32))], names=["key", "n"])

    rows = docs.select("text").mapInArrow(count, "key long, n int")
    return rows.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def _occurrences(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, hash, content, places, shingles): the paragraphs with a repeated key. Shingles stand at one occurrence of a content in a slice."""
    passing = sieve(repeated)
    schema = T.StructType([
        *docs.schema.fields[:2], T.StructField("content", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in PLACE), T.StructField("shingles", T.ArrayType(T.LongType())),
    ])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in X.text_chunks(batches, "text", SLICE_BYTES):
            layout = Layout(texts)
            which, keys, values, bounds = band_keys(layout)
            hit = np.flatnonzero(passes(passing.value, keys).any(1))
            content = layout.sequence_hashes(layout.bounds)[which[hit]]
            w0, w1 = layout.bounds[which[hit]], layout.bounds[which[hit] + 1]
            doc = layout.owner[w0]
            place = [w0 - layout.first[doc], w1 - layout.first[doc], layout.a[w0] - layout.starts[doc], layout.b[w1 - 1] - layout.starts[doc]]
            once = np.zeros(len(hit), bool)
            once[np.unique(content, return_index=True)[1]] = True
            sets = [np.unique(values[bounds[k] : bounds[k + 1]]).view(np.int64) if o else None for k, o in zip(hit.tolist(), once.tolist(), strict=True)]
            own = [part.column(k).take(pa.array(doc)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, _long(content), *(pa.array(p.astype(np.int32)) for p in place), pa.array(sets, pa.list_(pa.int64()))], names=schema.names)

    found = written(docs.mapInArrow(take, schema))
    passing.unpersist()
    return found


def _clusters(found: DataFrame) -> DataFrame:
    """(content, root): contents that are similar to others, with the name of their component."""
    contents = found.where("shingles IS NOT NULL").select("content", "shingles")

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.ListArray, np.ndarray]:
        sets = batch.column(1)
        bounds = sets.offsets.to_numpy().astype(np.int64)
        return batch.column(0).to_numpy(), sets, keys_of(sets.values.to_numpy().view(np.uint64)[bounds[0] : bounds[-1]], bounds - bounds[0])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                content, _, keys = keyed(batch)
                yield pa.RecordBatch.from_arrays([_long(keys.ravel()), _long(np.repeat(content, BANDS))], names=["key", "content"])

    ends = contents.mapInArrow(meet, "key long, content long").groupBy("key").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    passing = sieve(written(ends.where("low < high").select("key")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                content, sets, keys = keyed(batch)
                row, band = np.nonzero(passes(passing.value, keys))
                yield pa.RecordBatch.from_arrays([_long(keys[row, band]), _long(content[row]), sets.take(pa.array(row))], names=["bucket", "item", "shingles"])

    met = written(contents.mapInArrow(place, "bucket long, item long, shingles array<long>").dropDuplicates(["bucket", "item"]))
    passing.unpersist()
    return components(bucket_links(met, SimilarSets())).select(F.col("node").alias("content"), "root")


def _runs(x: np.ndarray) -> np.ndarray:
    """How many true values follow from each place of each row on."""
    out = np.zeros((len(x), x.shape[1] + 1), np.int64)
    for k in range(x.shape[1] - 1, -1, -1):
        out[:, k] = np.where(x[:, k], out[:, k + 1] + 1, 0)
    return out


def reach(own: np.ndarray, other: np.ndarray, loose: np.ndarray | None = None) -> np.ndarray:
    """How many words of each row go on like the other row's, over one word changed, put in or left out with BRIDGE equal words behind it. 0 is no word.

    In loose rows, whose beginnings may be a word apart, one equal word behind the first is enough.
    """
    row = np.arange(len(own))
    plain = _runs((own == other) & (own != 0))
    at = plain[:, 0]
    more, less = np.zeros_like(own), np.zeros_like(own)
    more[:, :-1], less[:, :-1] = own[:, 1:], other[:, 1:]
    over = (  # words that follow, and how many of the row's own words the change takes
        (plain[row, np.minimum(at + 1, CONTEXT)], 1),
        (_runs((more == other) & (more != 0))[row, at], 1),
        (_runs((own == less) & (own != 0))[row, at], 0),
    )
    bridge = BRIDGE if loose is None else np.where(loose & (at == 0), 1, BRIDGE)
    best = at.copy()
    for follow, taken in over:
        best = np.maximum(best, np.where(follow >= bridge, at + taken + follow, 0))
    return np.minimum(best, CONTEXT)


def _ends(by_text: DataFrame) -> DataFrame:
    """(mark, w0, w1, right, edge, stays_mark, stays_w0, loose): the first and the last paragraph of each run, with the side to which it may go on and the byte there; loose: the paragraph that stays has another length."""
    numbered = by_text.select("mark", F.col("units").alias("u"), F.posexplode("units").alias("k", "unit"))
    begins = F.coalesce(F.expr("try_element_at(u, k).w1 < unit.w0"), F.lit(True)) & (F.col("unit.w0") > 0)
    numbered = numbered.withColumns({"begins": (F.col("k") == 0) & (F.col("unit.w0") > 0) | (F.col("k") > 0) & begins, "stops": F.coalesce(F.expr("try_element_at(u, k + 2).w0 > unit.w1"), F.lit(True))})
    side = F.explode(F.expr("filter(array(struct(begins AS is, false AS right), struct(stops AS is, true AS right)), s -> s.is)")).alias("side")
    rows = numbered.where("begins OR stops").select("mark", "unit", side)
    right = F.col("side.right")
    edge = F.when(right, F.col("unit.end")).otherwise(F.col("unit.first"))
    return rows.select("mark", F.col("unit.w0").alias("w0"), F.col("unit.w1").alias("w1"), right.alias("right"), edge.alias("edge"), F.col("unit.stays_mark").alias("stays_mark"), F.col("unit.stays_w0").alias("stays_w0"), F.col("unit.loose").alias("loose"))


#: The key of a side of an occurrence, from its text's mark, its first word, and the side.
SITE = "{0} ^ shiftleft({1}, 44) ^ shiftleft(cast(right AS bigint), 43)"


def _extended(docs: DataFrame, by_text: DataFrame) -> DataFrame:
    """(mark, places): words beyond the ends of runs that go on like those at the occurrence that stays. Nothing for an end that doesn't go on."""
    ends = written(_ends(by_text).withColumns({"own": F.expr(SITE.format("mark", "w0")), "other": F.expr(SITE.format("stays_mark", "stays_w0"))}))
    own_texts, own_sites = sieve(ends.select("mark").distinct(), "mark"), sieve(ends.select("own"), "own")
    other_texts, other_sites = sieve(ends.select("stays_mark").distinct(), "stays_mark"), sieve(ends.select("other").distinct(), "other")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in X.text_chunks(batches, "text", SLICE_BYTES):
            mark = part.column(0).to_numpy()
            some = np.flatnonzero(passes(own_texts.value, mark.view(np.uint64)) | passes(other_texts.value, mark.view(np.uint64)))
            layout = Layout([texts[k] for k in some.tolist()])
            doc = layout.owner[layout.bounds[:-1]]
            w0, own = layout.bounds[:-1] - layout.first[doc], mark[some][doc]
            for right in (False, True):
                key = own.view(np.uint64) ^ (w0.astype(np.uint64) << np.uint64(44)) ^ (np.uint64(right) << np.uint64(43))
                for sites, role in ((own_sites, True), (other_sites, False)):
                    at = np.flatnonzero(passes(sites.value, key))
                    for low in range(0, len(at), 1 << 14):
                        now = at[low : low + (1 << 14)]
                        words, far = _beyond(layout, doc[now], layout.bounds[now + right], right)
                        rows = [pa.array([r.tobytes() for r in x], pa.binary()) for x in ((words, far) if role else (words, words[:, :0]))]
                        flags = [pa.array(np.full(len(now), x)) for x in (right, role)]
                        yield pa.RecordBatch.from_arrays([pa.array(own[now]), _long(w0[now]), *flags, *rows], names=["mark", "w0", "right", "own", "words", "far"])

    found = docs.select(F.xxhash64("id", "hash").alias("mark"), "text").mapInArrow(around, "mark long, w0 long, right boolean, own boolean, words binary, far binary")
    found = written(found)
    for passing in (own_texts, own_sites, other_texts, other_sites):
        passing.unpersist()
    place = ["mark", "w0", "right"]
    own = ends.join(found.where("own").drop("own").dropDuplicates(place), place)
    # of a place where many others stay, the words are written once, so that Spark can split the join
    other = written(found.where("NOT own").select(F.col("mark").alias("stays_mark"), F.col("w0").alias("stays_w0"), "right", F.col("words").alias("like")).dropDuplicates(["stays_mark", "stays_w0", "right"]))
    pairs = own.join(other, ["stays_mark", "stays_w0", "right"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words, far, like = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, CONTEXT) for c in ("words", "far", "like"))
                w0, w1, edge = (batch.column(c).to_numpy() for c in ("w0", "w1", "edge"))
                right = batch.column("right").to_numpy(zero_copy_only=False)
                n = reach(words, like, batch.column("loose").to_numpy(zero_copy_only=False))
                more = np.flatnonzero(n)
                n, right, edge = n[more], right[more], edge[more]
                byte = edge + np.where(right, 1, -1) * far[more, n - 1].astype(np.int64)
                first, end = np.minimum(edge, byte), np.maximum(edge, byte)
                w0, w1 = np.where(right, w1[more], w0[more] - n), np.where(right, w1[more] + n, w0[more])
                yield pa.RecordBatch.from_arrays([batch.column("mark").take(pa.array(more)), *map(_long, (w0, w1, first, end))], names=["mark", *PLACE])

    return pairs.select("mark", "w0", "w1", "right", "edge", "loose", "words", "far", "like").mapInArrow(extend, f"mark long, {', '.join(f'{c} long' for c in PLACE)}")


def _beyond(layout: Layout, doc: np.ndarray, edge: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the CONTEXT words beyond each place between two words of its text, nearest first (0: none), and how many bytes they reach from the word at the edge."""
    step = np.arange(CONTEXT)
    place = edge[:, None] + step if right else edge[:, None] - 1 - step
    inside = (place >= layout.first[doc][:, None]) & (place < layout.first[doc + 1][:, None])
    place = np.where(inside, place, 0)
    words = (layout.hashes[place] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    far = layout.b[place] - layout.b[edge - 1][:, None] if right else layout.a[edge][:, None] - layout.a[place]
    return np.where(inside, words, np.uint32(0)), np.where(inside, far, 0).astype(np.uint32)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, hash, n_removed, spans): for each document with a passage to remove, its words and byte spans.

    `hash` is the xxhash64 of the text. Rows alike in id and text count as one
    document. A null id sorts before others; of equal ids the smaller text hash
    stays. Null and wordless texts have no passages, and an empty table has no
    rows. A very long text is one piece of work of one task. Of what repeats
    inside its own document the first `min_words` words stay. Other columns are
    ignored.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    found = _occurrences(docs, written(_repeated_keys(docs)))
    units = found.select("id", "hash", "content", *(F.col(c).cast("long").alias(c) for c in PLACE))
    units = units.join(_clusters(found), "content", "left").withColumn("root", F.coalesce("root", "content")).drop("content")
    # written, so that both sides of the join are plain exchanges and Spark can split a paragraph that many documents share
    units = written(units.withColumn("mark", F.xxhash64("id", "hash")))
    firsts = written(units.groupBy("root").agg(F.min(F.struct("id", "hash", "w0", "mark", "w1")).alias("stays")))
    marked = units.join(firsts, "root").where(f"mark <> stays.mark OR w0 >= stays.w0 + {int(min_words)}")
    unit = F.struct(*PLACE, F.col("stays.mark").alias("stays_mark"), F.col("stays.w0").alias("stays_w0"), F.expr("stays.w1 - stays.w0 <> w1 - w0").alias("loose"))
    by_text = written(marked.groupBy("mark").agg(F.first("id").alias("id"), F.first("hash").alias("hash"), F.array_sort(F.collect_set(unit)).alias("units")))
    more = _extended(docs, by_text).groupBy("mark").agg(F.collect_list(F.struct(*PLACE)).alias("more"))
    places = F.concat(F.transform("units", lambda u: F.struct(*(u[c].alias(c) for c in PLACE))), F.coalesce("more", F.array()))
    places = by_text.join(more, "mark", "left").select("mark", "id", "hash", F.explode(places).alias("p")).select("mark", "id", "hash", "p.*")
    # runs of marked words: one begins where no word before it is marked
    in_text = Window.partitionBy("mark").orderBy("w0", "w1")
    so_far = F.max("w1").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    begins = places.withColumn("begins", F.coalesce(F.col("w0") > so_far, F.lit(True)).cast("int"))
    numbered = begins.withColumn("run", F.sum("begins").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    ends = {"w0": F.min("w0"), "w1": F.max("w1"), "first": F.min("first"), "end": F.max("end"), "id": F.first("id"), "hash": F.first("hash")}
    runs = numbered.groupBy("mark", "run").agg(*(v.alias(k) for k, v in ends.items()))
    long = runs.where(F.col("w1") - F.col("w0") >= min_words)
    spans = F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans")
    return long.groupBy("mark").agg(F.first("id").alias(id_col), F.first("hash").alias("hash"), F.sum(F.col("w1") - F.col("w0")).alias("n_removed"), spans).drop("mark")


def passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, n_removed, spans) of each input row; rows without a passage to remove have 0 and no spans. Spans are UTF-8 byte offsets.

    Repeated rows come out as often as they came in; nulls, empty and very long
    texts, ties and empty tables as in `repeated_spans`.
    """
    found = repeated_spans(docs, id_col, text, min_words).withColumnRenamed(id_col, "found_id")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("own"))
    joined = rows.join(found, rows["id"].eqNullSafe(found["found_id"]) & (rows["own"] == found["hash"]), "left")
    none = F.array().cast("array<struct<first:bigint,end:bigint>>")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("spans", none).alias("spans"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, all columns kept, without the passages that repeat; null texts stay null.

    Repeated rows stay, each without its passages; nulls, empty and very long
    texts, ties and empty tables as in `repeated_spans`.
    """
    id_, hash_, spans, own = free_names(docs, "id", "hash", "spans", "own")
    found = repeated_spans(docs, id_col, text, min_words)
    found = found.select(F.col(id_col).alias(id_), F.col("hash").alias(hash_), F.col("spans").alias(spans))
    joined = docs.withColumn(own, F.xxhash64(F.col(text)))
    joined = joined.join(found, joined[id_col].eqNullSafe(found[id_]) & (joined[own] == found[hash_]), "left")
    # byte slices of a binary: what stands before, between and after the spans
    raw = F.col(text).cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    begins = F.concat(F.transform(spans, lambda s: s["first"]), F.array(F.octet_length(raw).cast("long")))
    kept = F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda s: F.substring(raw, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")).cast("string"))
    new = F.when(F.col(spans).isNotNull(), F.array_join(kept, "")).otherwise(F.col(text))
    return joined.withColumn(text, new).select(*docs.columns)
