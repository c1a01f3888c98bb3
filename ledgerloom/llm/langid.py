"""Language identification by nearest centroid.

Texts are TF-IDF vectors of byte bigrams and trigrams of their lower-cased
letters, hashed into DIMENSIONS and normalised. Each language has several
centroids, clustered by cosine; a text takes the language of the nearest one.
It is marked rejected where that similarity is under the language's limit, a
low quantile of what its training texts have.

Document frequencies come from all training texts. Centroids are clustered, one
task a language, on about SAMPLE_ROWS training texts of each language at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE_ROWS = 2000
ROUNDS = 10
REJECT_QUANTILE = 0.005
#: Texts whose vectors are held at once.
ROWS = 512

_LETTER = np.array([0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text.decode(errors="replace"))


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of the hashed bigrams and trigrams, a row a text."""
    buf, starts = X.joined(texts, lower=True)
    x = np.where(_LETTER[buf], buf, 32).astype(np.uint32)
    doc_of = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(starts))  # of each byte from the first text's on
    x = np.concatenate([x[starts[0] - 1 :], np.array([32, 32], np.uint32)])  # from the newline before it
    n = len(doc_of)
    pair = (x[:n] << np.uint32(8)) | x[1 : n + 1]
    triple = (pair << np.uint32(8)) | x[2 : n + 2]
    out = np.zeros(len(texts) * DIMENSIONS, np.int64)
    for keys, blank in ((pair, 0x2020), (triple, 0x202020)):
        used = (keys != blank) & (x[1 : n + 1] != 32)
        at = (keys[used] * np.uint32(2654435761)) >> np.uint32(32 - (DIMENSIONS - 1).bit_length())
        out += np.bincount(doc_of[used] * DIMENSIONS + at.astype(np.int64), minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = (np.log1p(counts) * idf).astype(np.float32)
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def cluster(rows: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by cosine; the first is the mean's nearest row, each next the row farthest from those chosen."""
    mean = rows.mean(0)
    chosen = [int((rows @ mean).argmax())]
    near = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(rounds):
        own = (rows @ centroids.T).argmax(1)
        for c in range(len(centroids)):
            if (own == c).any():
                mean = rows[own == c].mean(0)
                centroids[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centroids


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part, texts in X.text_chunks(batches, "__text"):
        for k in range(0, len(texts), ROWS):
            yield part.slice(k, ROWS), texts[k : k + ROWS]


def identified(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns to carry, lang_pred, score, rejected) of each row of docs, by what the rows of train with a text and a language teach.

    A null text, or one without a letter, is "und" with score 0 and rejected; so
    is every text where there is nothing to learn from. Ties go to the language
    that sorts first. A very long text is read whole, by one task. Repeated rows
    get the same prediction; other columns are ignored; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    taught = train.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("__text"), F.xxhash64(F.col(id_col), F.col(text)).alias("h")).where("lang IS NOT NULL AND __text IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for _, texts in _sliced(batches):
            seen += (term_counts(texts) > 0).sum(0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.append(n, seen))], names=["term", "n"])

    sums = taught.select("__text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(DIMENSIONS + 1, np.int64)
    seen[sums.column("term").to_numpy() + 1] = sums.column("n").to_numpy()
    idf = np.log((seen[0] + 1) / (seen[1:] + 1)) + 1

    per_lang = taught.groupBy("lang").agg(F.count("*").alias("rows"))
    rate = F.least(F.lit(1.0), sample_rows / F.col("rows"))
    sample = taught.join(F.broadcast(per_lang), "lang").where(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _sliced(batches):
            rows = vectors(term_counts(texts), idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "v"])

    def learn(table: pa.Table) -> pa.Table:
        name = table.column("lang")[0].as_py()
        rows = np.stack([np.frombuffer(v, np.float16) for v in sorted(table.column("v").to_pylist())]).astype(np.float32)
        centroids = cluster(rows)
        limit = float(np.quantile((rows @ centroids.T).max(1), REJECT_QUANTILE))
        return pa.table({"lang": [name], "reject_under": [limit], "centroids": [centroids.astype(np.float32).tobytes()]})

    model = sample.select("lang", "__text").mapInArrow(embed, "lang string, v binary").groupBy("lang").applyInArrow(learn, "lang string, reject_under double, centroids binary")
    learned = sorted(model.collect(), key=lambda r: r["lang"])
    matrices = [np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMENSIONS) for r in learned]
    names = [r["lang"] for r in learned]
    shared = spark.sparkContext.broadcast((idf, np.concatenate(matrices) if matrices else None, np.repeat(np.arange(len(matrices)), [len(m) for m in matrices]), np.array([r["reject_under"] for r in learned])))
    kept = [id_col, *carry]
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centroids, lang_of, limits = shared.value
        for part, texts in _sliced(batches):
            readable = np.array([has_letter(t) for t in texts]) & (centroids is not None)
            pred, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if readable.any():
                near = vectors(term_counts(texts), idf) @ centroids.T
                best = near.argmax(1)
                own = lang_of[best]
                score = np.where(readable, np.clip(near.max(1), 0, 1), 0).astype(float)
                rejected = ~readable | (near.max(1) < limits[own])
                pred = [names[o] if r else "und" for o, r in zip(own, readable, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    return docs.select(*(F.col(c) for c in kept), F.col(text).alias("__text")).mapInArrow(predict, schema)
