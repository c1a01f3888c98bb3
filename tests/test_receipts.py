"""Receipts go by one shuffle by document, and give the rows that a shuffle by line and by field gives."""

from __future__ import annotations

from collections import Counter

from ledgerloom.functions import text as X
from ledgerloom.operators import evaluate as E
from ledgerloom.operators import rules as R
from ledgerloom.plans import queries as plans
from ledgerloom.sources.adapters import Tables
from pyspark.sql import functions as F


def test_scores_shuffle_lines_and_truth_once(spark, sf_dir):
    plan = plans.QUERIES["extractor_scores"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 3  # lines, truth, the counts of fields


def test_repeated_items_are_told_by_document(spark, sf_dir, tmp_path):
    for name in ("region", "nation", "customer", "orders"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    null_key = items.limit(3).withColumn("l_orderkey", F.lit(None).cast("long"))
    null_text = items.where("l_linenumber = 2").withColumn("l_partkey", F.lit(None).cast("long"))
    same_line = items.where("l_orderkey % 3 = 0").withColumn("l_linenumber", F.lit(1))
    items.unionByName(items).unionByName(null_key).unionByName(null_key).unionByName(null_text).unionByName(same_line).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.where("o_orderkey % 7 = 0").write.mode("append").parquet(f"{tmp_path}/orders.parquet")  # their own lines stay twice
    t = Tables(spark, str(tmp_path))
    assert Counter(map(tuple, t.receipt_lines(by_document=True).collect())) == Counter(map(tuple, t.receipt_lines().collect()))


def test_fields_of_odd_documents(spark):
    rows = [
        (1, None, "no number"), (1, None, "total 9"),
        (2, 5, "later"), (2, 2, None), (2, 3, "plain"),
        (3, 1, "first"), (3, 2, "TOTAL"), (3, 3, "x"), (3, 4, "Thanh toán"), (3, 5, "8.000 then 7.500"), (3, 6, "total 1"),
        (4, None, "before"), (4, 4, "số 5: a"), (4, 6, "10:20 01-02-2024"), (4, 7, "01/02/2024 10:20:30"),
        (None, 1, "keyless"),
    ]
    got = {r["doc_id"]: tuple(r)[1:] for r in R.extracted_fields(spark.createDataFrame(rows, "doc_id long, line_no int, text string"), title=False).collect()}
    assert got == {
        1: (None, None, None, None), 2: (None, None, None, None), 3: ("first", None, None, "7.500"), 4: ("số 5: a", "số 5: a", "10:20 01-02-2024", None), None: ("keyless", None, None, None),
    }


def test_wide_pairs_are_field_pairs(spark):
    schema = "doc_id long, A string, B string"
    truth = spark.createDataFrame([(1, "a", None), (1, "b", "b"), (2, " ", "x"), (None, "n", "n")], schema)
    found = spark.createDataFrame([(1, "a", "c"), (3, None, "\t"), (None, "n", None)], schema)
    long = [R.long_fields(side, "doc_id", ["A", "B"]) for side in (truth, found)]
    want = E.field_pairs(*long, ["doc_id", "field"]).select("doc_id", "field", "truth", "predicted")
    got = E.wide_pairs(truth, found, ["doc_id"], ["A", "B"]).select("doc_id", "field", "truth", "predicted")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_similarity_of_equal_and_absent_texts(spark):
    rows = spark.createDataFrame([("A b", "ab"), (None, None), ("", None), ("abcd", "abxd"), ("a", None)], "t string, p string")
    assert [r[0] for r in rows.select(X.edit_similarity(F.col("t"), F.col("p"))).collect()] == [1.0, 1.0, 1.0, 0.75, 0.0]
