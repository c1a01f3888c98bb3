"""Benchmark decontamination: an FM-index for each shard of training text, searched for the test phrases.

Words are lower-cased in A-Z and are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F].
A test phrase is each run of 10 words of an item, or all of a shorter item. A
shard is a slice of an Arrow batch (about 4 MB of text), so the work is one
narrow pass over the documents without a shuffle. The index leaves out words
that no item has, and runs of item words that are shorter than every phrase:
neither can be part of an occurrence.

The benchmark is taken in blocks of bounded bytes, each broadcast; every block is
searched in every shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from .fm_index import FMIndex

BLOCK_BYTES = 4 << 20
WINDOW = 10


def phrases(items: list[tuple[str | None, str]], window: int = WINDOW) -> dict:
    """The distinct phrases of a block of items: their words' hashes, their texts, and the items that have each."""
    found: dict[bytes, set[str]] = {}
    buf, starts = X.joined([(t or "").encode() for _, t in items], lower=True)
    a, b = X.word_spans(buf, X.ALNUM)
    first = X.per_document(a, starts)
    whole = buf.tobytes()
    for k, (item, _) in enumerate(items):
        words = [whole[x:y] for x, y in zip(a[first[k] : first[k + 1]], b[first[k] : first[k + 1]], strict=True)]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(b" ".join(words[i : i + window]), set()).add(item)
    texts = list(found)
    split = [t.split(b" ") for t in texts]
    lengths = np.array([len(s) for s in split], np.int64)
    buf, _ = X.joined(texts)
    a, b = X.word_spans(buf, X.NON_SPACE)
    hashes = X.span_hashes(buf, a, b)
    words = np.unique(hashes)
    grid = np.zeros((len(texts), int(lengths.max(initial=1))), np.int64)
    grid[np.arange(grid.shape[1]) < lengths[:, None]] = np.searchsorted(words, hashes) + 1
    return {"texts": texts, "items": [list(found[t]) for t in texts], "words": words, "grid": grid, "lengths": lengths}


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> list[Broadcast]:
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item).cast("string"), F.col(text)).where(F.col(text).isNotNull())
    out, held, size = [], [], 0
    for row in rows.toLocalIterator():
        if held and size + len(row[1]) > BLOCK_BYTES:
            out.append(spark.sparkContext.broadcast(phrases(held, window)))
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    return [*out, spark.sparkContext.broadcast(phrases(held, window))] if held else out


def shard_hits(words: np.ndarray, doc_of: np.ndarray, block: dict, same) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of each occurrence. `same(first, phrase)` confirms one by its text."""
    none = np.empty(0, np.int64)
    vocabulary, lengths = block["words"], block["lengths"]
    if not len(words) or not len(lengths):
        return none, none
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    known = vocabulary[at] == words
    # runs of item words inside one document, at least as long as the shortest phrase
    breaks = np.flatnonzero(np.append(True, (known[1:] != known[:-1]) | (doc_of[1:] != doc_of[:-1])))
    ends = np.append(breaks[1:], len(words))
    keep = known[breaks] & (ends - breaks >= lengths.min())
    breaks, ends = breaks[keep], ends[keep]
    if not len(breaks):
        return none, none
    spans = ends - breaks + 1  # one more for the gap
    begin = np.cumsum(spans) - spans
    origin = np.repeat(breaks - begin, spans) + np.arange(spans.sum())
    gap = begin + spans - 1
    origin[gap] = 0
    symbols = at[origin] + 1
    symbols[gap] = len(vocabulary) + 1
    index = FMIndex(symbols)
    low, high = index.search(block["grid"], lengths)
    counts = high - low
    phrase = np.repeat(np.arange(len(counts)), counts)
    rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    first = origin[index.locate(rows)]
    true = np.fromiter((same(f, p) for f, p in zip(first, phrase, strict=True)), bool, len(first))
    return first[true], phrase[true]


def _searched(batches: Iterator[pa.RecordBatch], column: str, blocks: list[Broadcast]):
    """For each slice of a batch: it, its texts, byte spans of its words, first word by document, hit flags, item sets."""
    for part, texts in X.text_chunks(batches, column):
        buf, starts = X.joined(texts, lower=True)
        a, b = X.word_spans(buf, X.ALNUM)
        first = X.per_document(a, starts)
        doc_of = X.owners(a, starts)
        hashes, whole = X.span_hashes(buf, a, b), buf.tobytes()
        edge = np.zeros(len(a) + 1, np.int64)
        items: list[set[str]] = [set() for _ in texts]
        for block in (x.value for x in blocks):
            size = block["lengths"]

            def same(f: int, p: int, block: dict = block) -> bool:
                span = slice(f, f + block["lengths"][p])
                return b" ".join(whole[x:y] for x, y in zip(a[span], b[span], strict=True)) == block["texts"][p]

            at, phrase = shard_hits(hashes, doc_of, block, same)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size[phrase], -1)
            for f, p in zip(at, phrase, strict=True):
                items[doc_of[f]].update(block["items"][p])
        yield part, texts, a - starts[doc_of], b - starts[doc_of], first, np.cumsum(edge)[:-1] > 0, items


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: id, n_words, n_hit, items (ids, as sorted strings), spans (first, last byte + 1).

    A word is hit if any occurrence of a phrase covers it; spans are the merged
    runs of hit words as UTF-8 byte offsets. A null or wordless text has no
    words and no spans; a text of any length is one slice at most. Benchmark rows
    with a null text are no items; those with a null id are one item, which
    `items` has as a null, last, as rows that repeat an id are one item. With an empty benchmark nothing is hit; an empty table
    gives no rows. Repeated rows and null ids of documents have a row each, and
    a very long text is one piece of work of one task; other columns are ignored.
    """
    blocks = _blocks(benchmark, item, item_text, window)
    kind = docs.schema[id_col].dataType
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, a, b, first, hit, items in _searched(batches, "__text", blocks):
            count = np.concatenate([[0], np.cumsum(hit)])
            spans = [removal_spans(a[i:j], b[i:j], hit[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(first), pa.int64()), pa.array(count[first[1:]] - count[first[:-1]], pa.int64()), pa.array([sorted(s, key=lambda i: (i is None, i or "")) for s in items], pa.list_(pa.string())), pa.array([[{"first": x, "end": y} for x, y in s] for s in spans], span_type)],
                names=schema.names,
            )

    return docs.select(F.col(id_col), F.col(text).alias("__text")).mapInArrow(search, schema)


def removal_spans(a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of the runs of hit words."""
    if not hit.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [(int(a[i]), int(b[j - 1])) for i, j in zip(edges[0::2], edges[1::2], strict=True)]


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for first, end in spans:
        kept.append(text[at:first])
        at = end
    return b"".join([*kept, text[at:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, all columns kept, with every hit span cut out of the text.

    Null and empty texts stay as they are, long texts are read whole, repeated
    rows stay alike; items without an id count like others. An empty table stays
    empty, and with an empty benchmark nothing is cut.
    """
    blocks = _blocks(benchmark, item, item_text, window)
    at = docs.columns.index(text)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts, a, b, first, hit, _ in _searched(batches, text, blocks):
            if hit.any():
                old = part.column(at)
                new = [without_spans(t, removal_spans(a[i:j], b[i:j], hit[i:j])) if v else None for t, i, j, v in zip(texts, first[:-1], first[1:], old.is_valid().to_pylist(), strict=True)]
                part = part.set_column(at, part.schema.field(at), pa.array(new, pa.binary()).cast(old.type))
            yield part

    return docs.mapInArrow(remove, docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


OP2_SQL = """
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
iw AS (SELECT item_id, regexp_extract_all(translate(text, u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark, up WHERE text IS NOT NULL),
ph AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS p, least(len(w), 10) AS size
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, u, l), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents, up),
sz AS (SELECT DISTINCT size FROM ph),
oc AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS p
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sz)),
h AS (SELECT DISTINCT doc_id, i, ph.size AS size, item_id FROM oc JOIN ph ON oc.p = ph.p AND oc.size = ph.size),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
