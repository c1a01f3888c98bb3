"""The decoders over lists against those over rows, and queries over documents that share ids against their SQL."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import evaluate as E
from ledgerloom.operators import sequence as S
from ledgerloom.plans import queries as plans

LABELS = ["SELLER", "ADDRESS", "DATE", "OTHER", "TOTAL_COST", "STORE_NAME", "odd"]


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(8)
    tag = lambda: rng.choice(["O", "O", "I-SELLER", "I-SELLER"] + [f"{p}-{x}" for p in "BI" for x in LABELS])
    rows = []
    for k in range(200):
        n = rng.choice([1, 2, 5, 40])
        rows.append((k, [f"w{rng.randrange(9)}" for _ in range(n)], [tag() for _ in range(n)], [tag() if rng.random() < 0.3 else "B-SELLER" for _ in range(n)]))
    return spark.createDataFrame(rows, "doc_id long, words array<string>, tag array<string>, pred array<string>").cache()


@pytest.fixture(scope="module")
def tags(lists):
    rows = lists.select("doc_id", F.posexplode(F.arrays_zip("words", "tag", "pred")).alias("word_no", "z"))
    return rows.select("doc_id", F.col("word_no").cast("long").alias("word_no"), F.col("z.words").alias("word"), "z.tag", "z.pred").cache()


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)


def test_spans_of_lists(lists, tags):
    for of_list, of_rows in ((S.lenient_list, S.spans_lenient), (S.strict_list, S.spans_strict)):
        same(lists.select("doc_id", F.inline(of_list(F.col("words"), F.col("tag")))), of_rows(tags))


@pytest.mark.parametrize("variant", ["A", "B", "C", "C4", "D"])
def test_decoded_lists(lists, tags, variant):
    same(lists.select("doc_id", F.inline(S.decoded_list(F.col("words"), F.col("tag"), variant))), S.decoded(tags, variant))


def test_entity_counts_of_lists(lists, tags):
    counts = E.entity_counts(*(S.lenient_list(F.col("words"), F.col(c), texts=False) for c in ("tag", "pred")))
    found = lists.select(F.inline(counts)).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    predicted = S.spans_lenient(tags.drop("tag").withColumnRenamed("pred", "tag"))
    same(found, E.entity_confusion(S.spans_lenient(tags), predicted, ["label"], ["doc_id", "start", "end"]))


@pytest.fixture(scope="module")
def shared_ids(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    long = " ".join(f"w{k}" for k in range(500))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, long), (3, long), (3, long), (4, None), (5, ""), (6, "k  l\nm")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["subword_vote_first", "subword_vote_non_o", "truncate_words", "bio_decode_a", "bio_decode_b", "bio_decode_d", "bio_spans_a", "bio_spans_b", "entity_prf"])
def test_documents_that_share_ids(spark, shared_ids, name):
    found = plans.QUERIES[name](spark, shared_ids)
    columns = sorted(found.columns)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{shared_ids}/documents.parquet/*.parquet'")
        want = con.sql(plans.SQL[name]).select(*(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["subword_vote_first", "truncate_words", "bio_spans_b", "bio_decode_c"])
def test_texts_are_shuffled_not_their_words(spark, sf_dir, name):
    """Below each exchange of texts nothing is exploded, so what is shuffled and sorted grows with the texts."""
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    branches = plan.splitlines()
    union = next(k for k, line in enumerate(branches) if line.startswith("Union"))
    alone = [line for line in branches[union + 1 :] if line.startswith(("   ", ":  ", "+- ", ":- "))]
    alone = alone[: next((k for k, line in enumerate(alone) if k and line.startswith("+- ")), len(alone))]
    window = next(k for k, line in enumerate(alone) if "Window" in line)
    assert not any("Generate" in line or "Aggregate" in line for line in alone[window:])
    assert not any("Aggregate" in line or "Sort" in line or "Window" in line for line in alone[:window])
