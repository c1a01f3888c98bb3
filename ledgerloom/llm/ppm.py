"""Language-model scores by prediction by partial matching over bytes, and a smoothed unigram base.

The model is the trie of byte contexts of up to ORDER bytes in the training
texts, as a table of (ORDER + 1)-byte grams and their counts; each text is led by
start symbols and closed by an end symbol. Escapes are estimated by method C: a
context with N continuations, D of them distinct, gives D / (N + D) to an
escape. After an escape the symbols of the longer context are excluded from the
shorter one. A symbol of a longer context is one of each shorter context too, so
the excluded mass belongs to the longer context alone, and the probability of a
symbol depends on its gram only. It is worked out once for each gram that any
text has, with joins and sums over the gram table.

Counting and scoring are narrow passes over the documents; between them travel
counts of distinct grams and words. In scoring, the most frequent entries come
from a broadcast of bounded size (GRAMS, WORDS); what a text has beyond them is
joined to the full tables, so no entry is dropped at any size of corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from .lookup import Lookup
from .tables import cut

ORDER = 4
START, END = 0xFE, 0xFF
#: Bytes 0 to 0xFD and the end.
SYMBOLS = 255
#: Entries broadcast at most.
GRAMS, WORDS = 4 << 20, 1 << 19
CHUNK_BYTES = 2 << 20
#: Entries that a counting task holds at most before it passes them on.
HELD = 3 << 20
WORD, GRAM, CLOSE = 0, 1, 2


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, lower-cased in A-Z, and the text each is of."""
    buf, starts = X.joined(texts, lower=True)
    a, b = X.word_spans(buf, X.NON_SPACE)
    return X.span_hashes(buf, a, b), X.owners(a, starts)


_SYMBOL = bytes(min(c, 0xFD) for c in range(256))


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends in each symbol of the texts, their ends included, and the text each is of."""
    lead = bytes([START]) * ORDER
    texts = [t.translate(_SYMBOL) if b"\xfe" in t or b"\xff" in t else t for t in texts]  # no UTF-8 has these
    x = np.frombuffer(lead + (bytes([END]) + lead).join(texts) + bytes([END]), np.uint8)
    n = len(x) - ORDER
    keys = x[:n].astype(np.uint64)
    for j in range(1, ORDER + 1):
        keys <<= np.uint64(8)
        keys |= x[j : n + j]
    return keys[x[ORDER:] != START], np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.diff(np.append(at, len(keys)))


class _Counter:
    """Counts by key, merged now and then; `over` says that they should be passed on."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.empty(0, np.uint64), *(k for k, _ in self.parts)])
        counts = np.concatenate([np.empty(0, np.int64), *(c for _, c in self.parts)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        merged = keys[at], (np.add.reduceat(counts, at) if len(at) else counts)
        self.parts, self.size = [merged], len(merged[0])
        return merged

    @property
    def over(self) -> bool:
        return self.size > HELD // 2 and len(self.parts) == 1


def _counts(docs: DataFrame, train: str, text: str) -> DataFrame:
    """(kind, key, n): words and ends of the training texts, and grams of all texts with their count in training."""

    def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = {WORD: _Counter(), GRAM: _Counter()}, 0
        for part, texts in X.text_chunks(batches, "__text", CHUNK_BYTES):
            learn = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            ends += int(learn.sum())
            known, other = ([t for t, yes in zip(texts, learn, strict=True) if yes == want] for want in (True, False))
            held[WORD].add(*_runs(word_keys(known)[0]))
            held[GRAM].add(*_runs(gram_keys(known)[0] if known else np.empty(0, np.uint64)))
            if other:
                new = _runs(gram_keys(other)[0])[0]
                held[GRAM].add(new, np.zeros(len(new), np.int64))
            for kind, counter in held.items():
                if counter.over:
                    yield rows(kind, *counter.merge())
                    held[kind] = _Counter()
        for kind, counter in held.items():
            yield rows(kind, *counter.merge())
        yield rows(CLOSE, np.zeros(1, np.uint64), np.array([ends]))

    slim = docs.select(F.col(text).alias("__text"), F.col(train).alias("__train"))
    return slim.mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def gram_model(grams: DataFrame) -> DataFrame:
    """(key, n, value): the log10 probability of the last symbol of each gram after the bytes before it."""
    mask = lambda length: F.lit((1 << 8 * length) - 1).cast("long")
    g = {ORDER: grams.where("n > 0").select("key", "n")}
    for k in range(ORDER - 1, -1, -1):
        g[k] = cut(g[k + 1].groupBy(F.col("key").bitwiseAND(mask(k + 1)).alias("key")).agg(F.sum("n").alias("n")))
    c = {}
    for k in range(ORDER + 1):
        above = g[k].withColumn("low", F.col("key").bitwiseAND(mask(k))) if k else g[k].withColumn("lower", F.lit(0).cast("long"))
        if k:
            above = above.join(g[k - 1].select(F.col("key").alias("low"), F.col("n").alias("lower")), "low")
        names = [F.sum("n").alias(f"N{k}"), F.count("*").alias(f"D{k}"), F.sum("lower").alias(f"X{k}")]
        c[k] = cut(above.groupBy(F.shiftright("key", 8).alias(f"c{k}")).agg(*names))
    # contexts of up to two bytes are 65,793 at most
    small = lambda df, length: F.broadcast(df) if length <= 2 else df
    whole = g[ORDER].withColumn(f"c{ORDER}", F.shiftright("key", 8)).join(c[ORDER], f"c{ORDER}")
    known = whole.select("key", "n", F.log10(F.col("n") / (F.col(f"N{ORDER}") + F.col(f"D{ORDER}"))).alias("value"))
    new = grams.where("n = 0").select("key", "n")
    for k in range(ORDER + 1):
        new = new.withColumn(f"c{k}", F.shiftright("key", 8).bitwiseAND(mask(k))).join(small(c[k], k), f"c{k}", "left")
        if k < ORDER:
            lower = g[k].select(F.col("key").alias(f"g{k}"), F.col("n").alias(f"m{k}"))
            new = new.withColumn(f"g{k}", F.col("key").bitwiseAND(mask(k + 1))).join(small(lower, k + 1), f"g{k}", "left")
    value = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")
    p = F.try_divide(F.lit(1.0), SYMBOLS - value("D0"))  # none where every symbol has been seen
    for k in range(ORDER):
        # what is left of the order-k context once the longer context's symbols are out
        distinct = value(f"D{k}") - value(f"D{k + 1}")
        left = value(f"N{k}") - value(f"X{k + 1}") + distinct
        p = F.when(value(f"m{k}") > 0, F.try_divide(value(f"m{k}"), left)).when(left > 0, F.try_divide(distinct, left) * p).otherwise(p)
    escape = F.try_divide(value(f"D{ORDER}"), value(f"N{ORDER}") + value(f"D{ORDER}"))
    new = new.select("key", "n", F.log10(F.coalesce(escape, F.lit(1.0)) * p).alias("value"))
    return known.unionByName(new)


def _frequent(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the largest n, `most` at most, and the rest."""
    top = 1 << 16
    counts = rows.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("rows")).collect()
    total, least = 0, top + 1
    for row in sorted(counts, key=lambda r: -r["n"]):
        if total + row["rows"] > most:
            break
        total, least = total + row["rows"], row["n"]
    return rows.where(F.col("n") >= least), rows.where(F.col("n") < least)


def _lookup(rows: DataFrame, column: str) -> Lookup:
    table = rows.select("key", column).toArrow()
    return Lookup(table.column("key").to_numpy().view(np.uint64), table.column(column).to_numpy())


def _rest(doc_of: np.ndarray, keys: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, kind, key, count) of each distinct key of a document."""
    order = np.lexsort((keys, doc_of))
    d, k = doc_of[order], keys[order]
    at = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))[: len(d)])
    return d[at], np.full(len(at), kind), k[at], np.diff(np.append(at, len(d)))


def scored(docs: DataFrame, train: str, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), grams: int = GRAMS, words: int = WORDS) -> DataFrame:
    """(id, columns to carry, n_tokens, n_known, train_tokens, base_score, score) of each input row.

    `train` names a boolean column of the rows to learn from (null: not). Tokens
    are the words and one end of each text. n_known counts tokens that the
    training texts have; base_score is the sum of log10((c + 1) / (N + V + 1))
    with the token's count c, the N training tokens and their V kinds. score is
    the log10 probability of the text's bytes and end. Null texts count as
    empty, which have the end alone; without training rows c, N and V are 0 and
    all bytes are alike. Words are told apart by a 64-bit hash. A very long text
    is one slice of one task. Repeated rows and null ids are scored like others;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    marked = docs.withColumn("__train", F.coalesce(F.col(train), F.lit(False)))
    counts = cut(_counts(marked, "__train", text))
    totals = {r["kind"]: r for r in counts.where(F.col("kind") != GRAM).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    ends = totals[CLOSE]["n"] if CLOSE in totals else 0
    n_train = ends + (totals[WORD]["n"] if WORD in totals else 0)
    n_kinds = (ends > 0) + (totals[WORD]["v"] if WORD in totals else 0)
    vocabulary = counts.where(F.col("kind") == WORD).select("key", "n", F.log10(F.col("n") + 1).alias("value"))
    model = cut(gram_model(counts.where(F.col("kind") == GRAM)))
    (top_words, rare_words), (top_grams, rare_grams) = _frequent(vocabulary, words), _frequent(model, grams)
    shared = spark.sparkContext.broadcast({WORD: _lookup(top_words, "value"), GRAM: _lookup(top_grams, "value")})

    kept = [id_col, *carry]
    rest_type = pa.struct([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])
    rest_schema = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())]))
    numbers = [("__tokens", T.LongType()), ("__known", T.LongType()), ("__base", T.DoubleType()), ("__score", T.DoubleType()), ("__rest", rest_schema)]
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in kept), *(T.StructField(*x) for x in numbers)])
    end_value = float(np.log10(ends + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for part, texts in X.text_chunks(batches, "__text", CHUNK_BYTES):
            n_docs, sums, rest = len(texts), {}, []
            for kind, keyed in ((WORD, word_keys), (GRAM, gram_keys)):
                keys, doc_of = keyed(texts)
                at = tables[kind].find(keys)
                hit = at >= 0
                weights = np.zeros(len(keys))
                if hit.any():
                    weights[hit] = tables[kind].values[0][at[hit]]
                sums[kind] = np.bincount(doc_of, weights=weights, minlength=n_docs)
                if kind == WORD:
                    n, known = np.bincount(doc_of, minlength=n_docs), np.bincount(doc_of[hit], minlength=n_docs)
                rest.append(_rest(doc_of[~hit], keys[~hit], kind))
            d, kinds, keys, times = (np.concatenate(x) for x in zip(*rest, strict=True))
            order = np.argsort(d, kind="stable")
            entries = pa.StructArray.from_arrays([pa.array(kinds[order], pa.int32()), pa.array(keys[order].view(np.int64)), pa.array(times[order], pa.int64())], fields=list(rest_type))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d[order], np.arange(n_docs + 1)), pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(n + 1), pa.array(known + (ends > 0)), pa.array(sums[WORD] + end_value), pa.array(sums[GRAM]), lists], names=schema.names)

    rows = cut(docs.select(*(F.col(c) for c in kept), F.col(text).alias("__text")).mapInArrow(score, schema))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    entries = rows.select("__row", F.explode("__rest").alias("e")).select("__row", "e.kind", "e.key", F.col("e.n").alias("times"))
    rare = rare_words.select(F.lit(WORD).alias("kind"), "key", "value").unionByName(rare_grams.select(F.lit(GRAM).alias("kind"), "key", "value"))
    word, times = F.col("kind") == WORD, F.col("times") * F.col("value")
    more = entries.join(rare, ["kind", "key"]).groupBy("__row").agg(
        F.sum(F.when(word, F.col("times"))).alias("known2"), F.sum(F.when(word, times)).alias("base2"), F.sum(F.when(~word, times)).alias("score2")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.join(more, "__row", "left").select(
        *kept, F.col("__tokens").alias("n_tokens"), (F.col("__known") + zero("known2")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("__base") + zero("base2") - F.col("__tokens") * float(np.log10(n_train + n_kinds + 1))).alias("base_score"),
        (F.col("__score") + zero("score2")).alias("score"),
    )


#: The unigram base, its score to three decimals. CRC-32 goes bit by bit: each byte is added before the first of its eight shifts.
BASE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text,
    list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))) AS bytes FROM documents),
f AS (SELECT r, doc_id, text, xor(list_reduce(bytes, lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1))), 4294967295) % 7 = 2 AS held_out FROM d),
t AS (SELECT r, held_out, unnest(list_append(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), ' ')) AS token FROM f),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 3) AS base_score FROM t LEFT JOIN c USING (token), n GROUP BY 1)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, base_score FROM s JOIN f USING (r), n
"""
