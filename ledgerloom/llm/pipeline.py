"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give the columns of documents. A document whose text a stage removes whole goes;
documents that came without words stay. An empty table passes every stage as an
empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, packing, simhash, substring, toxicity
from .tables import cut, free_names, table

HAS_WORD = r"[^\x20\x09-\x0D]"


def _rewritten(docs: DataFrame, rewrite) -> DataFrame:
    """The documents as `rewrite` gives them, n_chars brought up to date, without those that lost all their words."""
    (had,) = free_names(docs, "had_words")
    cleaned = rewrite(docs.withColumn(had, F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False))))
    out = cleaned.where(F.col("text").isNull() | F.col("text").rlike(HAS_WORD) | ~F.col(had)).drop(had)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on `labels`, doesn't call toxic. Null and empty texts stay; repeated rows go or stay together."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of copies and near copies: by SimHash, and by the shingles of what its 3 bits don't reach. Null and empty texts are one group; of rows alike in id and text one stays."""
    return simhash.deduplicated(docs, by_fingerprint=True)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that another document has before them (by id); null texts stay null, repeated rows stay alike."""
    return _rewritten(docs, substring.deduplicated)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words that `benchmark` items share with them; null texts stay null, with an empty benchmark nothing goes."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _rewritten(docs, lambda rows: decontamination.decontaminated(rows, benchmark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; null and empty texts have one row without a bin, repeated rows are packed once each."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("best_fit_packing", pack),
]

#: Classifiers, components and packing are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
