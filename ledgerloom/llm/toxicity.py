"""Toxicity by classifier chains.

The label columns form a chain of linear models over presence features (words
and word beginnings of 4 to 6 bytes). Each model after the first also reads the
log odds that the earlier ones give; in training those come from out-of-fold
models, so no model sees an earlier one's opinion of its own training rows.

The features are the SELECTED ones, at most, with the largest chi-square for any
label. They are chosen, and the models fitted, on at most about SAMPLE_ROWS labelled
documents, whose ids are broadcast; the fits of a link run as one task a fold.
Scoring is one narrow pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from .importance import hashed_sample
from .tables import cut

SAMPLE_ROWS = 20_000
SELECTED = 3000
LEAST_DOCS = 3
#: Chi-square of one degree of freedom at 0.001.
LEAST_CHI = 10.83
FOLDS = 3
#: Probability from which a document counts as toxic.
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
STEPS = 200
L2 = 1e-4


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings, and the text each is of; repeats included."""
    buf, starts = X.joined(texts, lower=True)
    a, b = X.word_spans(buf, X.ALNUM)
    doc_of = X.owners(a, starts)
    out, of = [X.span_hashes(buf, a, b)], [doc_of]
    for n in PREFIXES:
        longer = b - a > n
        out.append(X.mix(X.span_hashes(buf, a[longer], a[longer] + n) + np.uint64(n)))
        of.append(doc_of[longer])
    return np.concatenate(out), np.concatenate(of)


def fit(indptr: np.ndarray, index: np.ndarray, extra: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Weights of a logistic model, by Adam on all rows: `size` of the presence features, those of the extra columns, the intercept."""
    n, rows = len(y), np.repeat(np.arange(len(y)), np.diff(indptr))
    w = np.zeros(size + extra.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, weights=w[index], minlength=n) + extra @ w[size:-1] + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / max(1, n)
        g = np.concatenate([np.bincount(index, weights=error[rows], minlength=size), extra.T @ error, [error.sum()]])
        g[:-1] += L2 * w[:-1] / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def margins(indptr: np.ndarray, index: np.ndarray, extra: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
    """Log odds, held to what the chain passes on."""
    n = len(indptr) - 1
    z = np.bincount(np.repeat(np.arange(n), np.diff(indptr)), weights=w[index], minlength=n) + extra @ w[size:-1] + w[-1]
    return np.clip(z, -10, 10)


def _select(rows: DataFrame, labels: list[str], n: int, positives: list[int], selected: int) -> np.ndarray:
    """Sorted hashes of the features that tell most about any label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in X.text_chunks(batches, "__text"):
            marks = np.stack([part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in labels], 1)
            h, of = features(texts)
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]
            h, of = h[new], of[new]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            ones = np.add.reduceat(marks[of], at, axis=0) if len(at) else np.zeros((0, len(labels)), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h))).astype(np.int64)), *(pa.array(x) for x in ones.T)], names=["h", "n", *(f"p{k}" for k in range(len(labels)))])

    names = [f"p{k}" for k in range(len(labels))]
    counts = rows.mapInArrow(count, f"h long, n long, {', '.join(f'{p} long' for p in names)}")
    counts = counts.groupBy("h").agg(F.sum("n").alias("n"), *(F.sum(p).alias(p) for p in names)).where(F.col("n") >= LEAST_DOCS)
    scores = []
    for p, positive in zip(names, positives, strict=True):
        expected = F.col("n") * (positive / n)
        scores.append((F.col(p) - expected) ** 2 / (expected * (1 - positive / n) * (1 - F.col("n") / (n + 1.0)) + 1e-9))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    found = counts.select("h", best.alias("score")).where(F.col("score") > LEAST_CHI).orderBy(F.desc("score"), "h").limit(selected).collect()
    return np.sort(np.array([r["h"] for r in found], np.int64).view(np.uint64))


def present(texts: list[bytes], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indptr, index) of the chosen features that each text has."""
    h, of = features(texts)
    at = np.minimum(np.searchsorted(chosen, h), max(0, len(chosen) - 1))
    hit = chosen[at] == h if len(chosen) else np.zeros(len(h), bool)
    pairs = np.unique(of[hit].astype(np.int64) * max(1, len(chosen)) + at[hit])
    indptr = np.searchsorted(pairs, np.arange(len(texts) + 1) * max(1, len(chosen)))
    return indptr, pairs % max(1, len(chosen))


def _link(y: str, k: int, size: int):
    """The fit of one run of the chain's k-th model: out-of-fold log odds, or the weights from all rows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        lists = table.column("index").combine_chunks()
        indptr, index = np.concatenate([[0], np.cumsum([len(x) for x in lists])]), lists.flatten().to_numpy()
        extra = np.array(table.column("extra").to_pylist(), float).reshape(table.num_rows, k)
        labels, which = table.column(y).to_numpy(), table.column("run")[0].as_py()
        use = table.column("fold").to_numpy() != which  # the last run has a number that no fold has: all rows
        part = np.repeat(use, np.diff(indptr))
        w = fit(np.concatenate([[0], np.cumsum(np.diff(indptr)[use])]), index[part], extra[use], labels[use], size)
        if which == FOLDS:
            return pa.table({"id": pa.nulls(1, table.schema.field("id").type), "odds": [0.0], "w": [w.tolist()]})
        odds = margins(indptr, index, extra, w, size)
        return pa.table({"id": table.column("id").filter(pa.array(~use)), "odds": odds[~use], "w": pa.nulls(int((~use).sum()), pa.list_(pa.float64()))})

    return run


def trained(docs: DataFrame, labels: DataFrame, chain: list[str], id_col: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, selected: int = SELECTED) -> tuple[np.ndarray, list[np.ndarray]]:
    """The chosen features and the weights of each model of the chain.

    Label rows with a null id or a null label are left out, and of several rows
    for an id the largest labels count.
    """
    spark = docs.sparkSession
    known = labels.where(" AND ".join(f"{c} IS NOT NULL" for c in [id_col, *chain])).groupBy(F.col(id_col).alias("__key")).agg(*(F.max(F.col(c).cast("int")).alias(f"__y{k}") for k, c in enumerate(chain)))
    known = hashed_sample(known, "__key", sample_rows)
    ys = [f"__y{k}" for k in range(len(chain))]
    rows = docs.select(F.col(id_col).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(known), "__key")
    totals = rows.agg(F.count("*"), *(F.sum(y) for y in ys)).first()
    if not totals[0]:
        return np.empty(0, np.uint64), [np.zeros(k + 1) for k in range(len(chain))]
    chosen = _select(rows.select("__text", *ys), ys, totals[0], list(totals[1:]), selected)
    shared, size = spark.sparkContext.broadcast(chosen), len(chosen)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in X.text_chunks(batches, "__text"):
            indptr, index = present(texts, shared.value)
            lists = pa.ListArray.from_arrays(pa.array(indptr, pa.int32()), pa.array(index, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], lists], names=["id", *ys, "index"])

    kind = dict(rows.dtypes)["__key"]
    made = rows.mapInArrow(encode, f"id {kind}, {', '.join(f'{y} int' for y in ys)}, index array<int>")
    fold = F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int")
    made = cut(made.withColumn("fold", fold).withColumn("extra", F.array().cast("array<double>")))
    weights = []
    for k, y in enumerate(ys):
        last = k == len(ys) - 1
        runs = F.lit(FOLDS) if last else F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))
        fits = cut(made.withColumn("run", runs).groupBy("run").applyInArrow(_link(y, k, size), f"id {kind}, odds double, w array<double>"))
        weights.append(np.array(fits.where("w IS NOT NULL").first()["w"]))
        if not last:
            odds = fits.where("w IS NULL").select("id", "odds").groupBy("id").agg(F.first("odds").alias("odds"))
            made = cut(made.join(odds, "id").withColumn("extra", F.concat("extra", F.array("odds"))).drop("odds"))
    return chosen, weights


def probabilities(texts: list[bytes], chosen: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """A column for each label of the chain."""
    indptr, index = present(texts, chosen)
    extra = np.zeros((len(texts), 0))
    for w in weights:
        extra = np.column_stack([extra, margins(indptr, index, extra, w, len(chosen))])
    return 1 / (1 + np.exp(-extra))


def scored(docs: DataFrame, model: tuple[np.ndarray, list[np.ndarray]], chain: list[str], id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns to carry, p_<label> for each label of the chain) of each input row.

    A null or wordless text has the probabilities of a text without features; a
    very long one is scored whole, by one task. Ids may be null or repeat; other
    columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [id_col, *carry]
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in kept), *(T.StructField(f"p_{c}", T.DoubleType()) for c in chain)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in X.text_chunks(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *(pa.array(p) for p in probabilities(texts, *shared.value).T)], names=schema.names)

    return docs.select(*(F.col(c) for c in kept), F.col(text).alias("__text")).mapInArrow(score, schema)


def classified(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """scored() by a chain trained here, and `toxic`: whether the chain's last label has `threshold` or more.

    Without labelled documents every probability is 0.5 and nothing is toxic; a
    probability of just `threshold` is. Texts, ids and tables as in `scored`.
    """
    model = trained(docs, labels, list(chain), id_col, text)
    last = F.col(f"p_{chain[-1]}")
    return scored(docs, model, list(chain), id_col, text, carry).withColumn(chain[-1], (last >= threshold) if len(model[0]) else F.lit(False))


def without_toxic(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns kept, that the chain's last label leaves under `threshold`; all of them without labels."""
    model = trained(docs, labels, list(chain), id_col, text)
    if not len(model[0]):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in X.text_chunks(batches, text):
            p = probabilities(texts, *shared.value)[:, -1]
            yield part.filter(pa.array(p < threshold))

    return docs.mapInArrow(keep, docs.schema)
