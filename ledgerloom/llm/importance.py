"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

A text's log weight is the sum, over its unigrams and bigrams of words and
punctuation, of the log ratio of two bags of hashed n-grams: one of the texts
labelled as target, one of all texts. Adding Gumbel noise, drawn from the id, to
the log weight divided by `temperature`, and taking the largest k samples k texts
in proportion to that power of their weights, without replacement. The
temperature is one for all texts: at 1 they are drawn by the ratio itself.

Both models count every text they are of, and have BUCKETS numbers, whatever the
input. Only texts that a bitmap of the target ids lets pass are shuffled, to be
joined with these; all others stay where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from .lookup import passes, sieve
from .tables import cut, written

BUCKETS = 1 << 14
FRACTION = 0.8
SEED = 7
#: Log weights are divided by this, so that the noise also acts between texts of hundreds of n-grams.
TEMPERATURE = 8.0
#: Keys that the driver sorts at most, and bins of a histogram that narrows them down.
SORTED_KEYS = 10_000
BINS = 4096

_CLASSES = np.where(X.ALNUM, 1, np.where(X.NON_SPACE, 2, 0)).astype(np.uint8)


def hashed_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of the key; all of them where there are no more."""
    n = rows.count()
    rate = min(1.0, most / n) if n else 1.0
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 30)) < int(rate * (1 << 30)))


def ngram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each unigram and bigram, and the text it is of."""
    buf, starts = X.joined(texts, lower=True)
    kinds = _CLASSES[buf]
    edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    a, b = edges[:-1], edges[1:]
    token = kinds[a] > 0
    a, b = a[token], b[token]
    doc_of = X.owners(a, starts)
    hashes = X.span_hashes(buf, a, b)
    pairs = X.window_hashes(hashes, 2)
    inside = doc_of[: len(pairs)] == doc_of[1:]
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    return (np.concatenate([hashes, pairs[inside]]) >> shift).astype(np.int64), np.concatenate([doc_of, doc_of[: len(pairs)][inside]])


def _counts(rows: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the column `__text`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for _, texts in X.text_chunks(batches, "__text"):
            n += np.bincount(ngram_buckets(texts)[0], minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    sums = rows.select("__text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def _target_texts(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The rows (__key, __text) whose key is among the ids; only those that pass a sieve of these are shuffled. Unpersist the sieve after use."""
    passing = sieve(ids.select(F.xxhash64("__key").alias("key")))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = passes(passing.value, batch.column(2).to_numpy().view(np.uint64))
            yield batch.select([0, 1]).filter(pa.array(hit))

    sifted = rows.withColumn("__hash", F.xxhash64("__key")).mapInArrow(sift, rows.schema)
    return sifted.join(ids.hint("merge"), "__key", "left_semi"), passing


def _models(docs: DataFrame, target: DataFrame, id_col: str, text: str) -> np.ndarray:
    """Log ratio of target to raw by bucket; zeros without a target row."""
    rows = docs.select(F.col(id_col).alias("__key"), F.col(text).alias("__text"))
    chosen, passing = _target_texts(rows, target.select(F.col(id_col).alias("__key")))
    raw, aimed = _counts(rows), _counts(chosen)
    passing.unpersist()
    if not aimed.any():
        return np.zeros(BUCKETS)
    share = lambda n: np.log(n + 0.5) - np.log(n.sum() + 0.5 * BUCKETS)
    return share(aimed) - share(raw)


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value (k of 1 and more, at most the number of rows), by histograms that narrow down to few values."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0  # rows over the range that is left
    inside = rows
    while low < high:
        width = (high - low) / BINS
        number = F.least(F.lit(BINS - 1), F.floor((F.col(column) - low) / width)).cast("int")
        bins = inside.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                low, high, n = row["low"], row["high"], row["n"]
                break
            above += row["n"]
        inside = rows.where(F.col(column).between(low, high))
        if n <= SORTED_KEYS:
            values = sorted((r[0] for r in inside.select(column).collect()), reverse=True)
            return values[k - above - 1]
    return low


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", fraction: float = FRACTION, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """(id, n_ngrams, log_weight, key, selected) of each input row. target: the ids of target texts.

    log_weight is the plain sum of log ratios, key that by `temperature` and the noise added. Another `seed` draws other noise.

    k is `fraction` of the rows, rounded down. Rows that tie for the last place
    share id and weight; all of them are selected. Null and wordless texts weigh
    1. A null id draws noise like any other and is never a target; ids that
    repeat draw the same noise. A very long text is one piece of work of one
    task. Other columns are ignored. Without target texts all weigh the same; an
    empty table gives no rows.
    """
    ids = written(target.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct())
    ratio = docs.sparkSession.sparkContext.broadcast(_models(docs, ids, id_col, text))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_ngrams", T.LongType()), T.StructField("log_weight", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in X.text_chunks(batches, "__text"):
            bucket, doc_of = ngram_buckets(texts)
            weight, n = np.bincount(doc_of, weights=ratio.value[bucket], minlength=len(texts)), np.bincount(doc_of, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(weight)], names=schema.names)

    rows = docs.select(F.col(id_col), F.col(text).alias("__text")).mapInArrow(weigh, schema)
    uniform = (F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed + 1)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    rows = cut(rows.withColumn("key", F.col("log_weight") / temperature - F.log(-F.log(uniform))))
    k = int(fraction * rows.count())
    return rows.withColumn("selected", F.col("key") >= kth_largest(rows, "key", k) if k else F.lit(False))
