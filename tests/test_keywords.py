"""Rules as rows against the expressions that they stand for, and against a plain loop over thousands of keywords."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import keywords as K
from ledgerloom.operators import rules as R

TEXTS = [None, "", "Ngày 01", "5/6", "5:", "no number /", "tổng tiền ngày", "WinMart Q1", "co.op food", "coXop food", "Go  mall", "go mall", "gomall", "Big C go!", "GS25 Quận 1", "địa chỉ: coffee house", "7-eleven legend", "total cost grand total", "ß straße đ/c", "Ŀ", "NUL \0 LOTTE", "line\nend ĐC:"]


def frame(spark):
    rows = [(k, t, float(y) if y is not None else None, "clash") for k, (t, y) in enumerate((t, y) for t in TEXTS for y in (None, 5, 17.9, 18, 50))]
    return spark.createDataFrame(rows, "id long, text string, y double, keyword string")


@pytest.mark.parametrize("under", [18, 20])
def test_line_rules(spark, under):
    got = K.classified(frame(spark), K.rule_table(spark, K.line_rules(under)), place="y", default="OTHER").withColumn("want", R.line_label(F.col("text"), F.col("y"), under)).collect()
    assert [r.label for r in got] == [r.want for r in got] and len({r.want for r in got}) == 5
    assert all(r.label == (r.labels[0] if r.labels else "OTHER") for r in got)


def test_chain_rules(spark):
    got = K.classified(frame(spark), K.rule_table(spark, K.chain_rules()), default=R.UNMATCHED).withColumn("want", R.chain_label(F.col("text"))).collect()
    assert [r.label for r in got] == [r.want for r in got] and len({r.want for r in got}) > 7


@pytest.mark.parametrize("block", [K.BLOCK_BYTES, 4000])
def test_many_keywords(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_BYTES", block)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdeé") for _ in range(n))
    rules = [(rng.randint(0, 300), f"L{rng.randint(0, 50)}", word(rng.randint(2, 7)), rng.choice([None, None, 10.0, 30.0]), rng.choice([None, None, None, "^A", "[DE]$"])) for _ in range(10_000 if block > 4000 else 700)]
    rules += [rules[0], (1, "none", "", None, None), (1, "none", None, None, None), (None, "none", "a", None, None), (2, None, "ab", None, None)]
    lines = [(k, rng.choice([None, "", word(rng.randint(1, 30)), word(5) + " " + word(9)]), rng.choice([None, 5.0, 10.0, 29.0, 90.0])) for k in range(200)]
    got = {r.id: (r.label, r.labels) for r in K.classified(spark.createDataFrame(lines, "id long, text string, y double"), K.rule_table(spark, rules), place="y", default="-").collect()}
    for k, text, y in lines:
        upper = (text or "").upper()
        hits = {(no, name) for no, name, keyword, under, pattern in rules if no is not None and keyword and keyword.upper() in upper and (under is None or y is not None and y < under) and (pattern is None or re.search(pattern, upper))}
        names = list(dict.fromkeys(name for _, name in sorted(hits, key=lambda x: (x[0], x[1] or ""))))
        assert got[k] == ((names[0] if names else None) or "-", names), (text, y)


def test_no_rules_and_no_lines(spark):
    none = K.rule_table(spark, [])
    assert {r.label for r in K.classified(frame(spark), none, default="x").collect()} == {"x"}
    assert K.classified(frame(spark).limit(0), K.rule_table(spark, K.chain_rules())).collect() == []


def test_large_rule_tables_stay_out_of_the_driver(spark, monkeypatch):
    """Beyond BLOCK_BYTES no automaton is made, and the labels are those of the automaton."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abß ") for _ in range(rng.randint(1, 4)))
    rules = [(rng.randint(0, 9), rng.choice(["x", "y", "z"]), word(), rng.choice([None, 3.0]), rng.choice([None, None, "A+", r"\d"])) for _ in range(80)]
    lines = spark.createDataFrame([(k, word() + word() + rng.choice(["", "1"]), rng.choice([None, 1.0, 5.0])) for k in range(200)] + [(1, None, 1.0), (2, "", None)] * 2, "id int, text string, place double")
    found = lambda: sorted(map(str, K.classified(lines, K.rule_table(spark, rules), place="place", default="none").collect()))
    want = found()
    monkeypatch.setattr(K, "BLOCK_BYTES", 50)
    monkeypatch.setattr(K, "Block", None)
    assert found() == want and sum("labels=[]" not in r for r in want) > 50
