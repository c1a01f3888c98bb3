"""Classification by rules that are rows of a table: keywords in families, priorities, places and patterns.

The keywords of a rule table of up to BLOCK_BYTES are one Aho-Corasick automaton,
which is broadcast, so a line is read once however many there are. A larger table
stays where it is: the parts of the lines that are as long as some keyword are
joined with the keywords, so neither the driver nor a task holds the rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules as R

#: rule_no: the lower goes first. under: the rule holds above this place only. pattern: what the line must match as well.
RULE = "rule_no int, label string, keyword string, under double, pattern string"
#: Characters of keywords, patterns and labels that the automaton is made of at most.
BLOCK_BYTES = 16 << 20
#: Lines that are read at once.
SLICE = 4096
#: Stands between lines; no keyword has it.
_BETWEEN = "\0"


def line_rules(seller_under: float = 18) -> list[tuple]:
    """The rules of rules.line_label as rows."""
    dated = [(0, "TIMESTAMP", mark, None, "[0-9]") for mark in "/:"]
    families = [("TIMESTAMP", R.TIME_WORDS, None), ("TOTAL_COST", R.TOTAL_WORDS, None), ("SELLER", R.SELLER_WORDS, float(seller_under)), ("ADDRESS", R.PLACE_WORDS, None)]
    return dated + [(no, label, word, under, None) for no, (label, words, under) in enumerate(families) for word in words]


def chain_rules(chains: list[tuple[str, list[str]]] = R.CHAINS) -> list[tuple]:
    """The chains' patterns as rows: of a pattern with gaps its longest part is the keyword."""
    rows = []
    for no, (name, patterns) in enumerate(chains):
        for pattern in patterns:
            parts = [p.replace("\\", "") for p in pattern.split(r"\s+")]
            rows.append((no, name, max(parts, key=len), None, pattern if len(parts) > 1 else None))
    return rows


def rule_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RULE)


class Block:
    """Some rules: the automaton of their keywords, and for each keyword its rules."""

    def __init__(self, rules: list[tuple]) -> None:
        by_keyword: dict[str, list[int]] = {}
        for at, (_, _, keyword, _, _) in enumerate(rules):
            by_keyword.setdefault(keyword, []).append(at)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for at, keyword in enumerate(by_keyword):
            self.automaton.add_word(keyword, at)
        self.automaton.make_automaton()
        self.sizes = np.array([len(v) for v in by_keyword.values()], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.rules = np.array([at for v in by_keyword.values() for at in v], np.int64)
        self.number = np.array([r[0] for r in rules], np.int64)
        self.label = [r[1] for r in rules]
        self.under = np.array([np.inf if r[3] is None else r[3] for r in rules])
        self.bound = np.array([r[3] is not None for r in rules])
        self.pattern = [r[4] for r in rules]

    def hits(self, texts: list[str], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, rule) of every rule that holds for a line, once each."""
        found = np.array(list(self.automaton.iter(_BETWEEN.join(texts))), np.int64).reshape(-1, 2)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        line, keyword = np.searchsorted(starts, found[:, 0], "right") - 1, found[:, 1]
        pairs = np.unique(line * max(1, len(self.sizes)) + keyword)
        line, keyword = pairs // max(1, len(self.sizes)), pairs % max(1, len(self.sizes))
        size = self.sizes[keyword]
        rule = self.rules[np.repeat(self.first[keyword] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        line = np.repeat(line, size)
        holds = ~self.bound[rule] | (places[line] < self.under[rule])  # a place that isn't known is above nothing
        for at in np.flatnonzero(holds):
            pattern = self.pattern[rule[at]]
            if pattern is not None and not re.search(pattern, texts[line[at]], re.ASCII):
                holds[at] = False
        return line[holds], rule[holds]


def _rules(rules: DataFrame) -> DataFrame:
    """The rules, upper-cased by Spark as the lines are; empty keywords and those with a NUL are no rules."""
    rows = rules.select("rule_no", "label", F.upper("keyword").alias("keyword"), F.col("under").cast("double").alias("under"), "pattern").where("keyword <> '' AND rule_no IS NOT NULL")
    return rows.where(~F.contains("keyword", F.lit(_BETWEEN)))


@F.pandas_udf(T.BooleanType())
def _matches(pattern: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([p is None or re.search(p, t, re.ASCII) is not None for p, t in zip(pattern, text, strict=True)], dtype=bool)


def _joined(lines: DataFrame, rules: DataFrame, upper: str, at: str, patterns: bool, labels: str) -> DataFrame:
    """(upper, at, labels) of each pair of text and place for which rules hold, by a join of the text's parts with the keywords."""
    sizes = sorted(r[0] for r in rules.select(F.length("keyword")).distinct().collect())
    known = lines.select(upper, at).distinct()
    texts = known.select(upper).distinct().withColumn("__n", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("__n") <= F.length(upper))
    places = F.sequence(F.lit(1), F.length(upper) - F.col("__n") + 1)
    parts = texts.select(upper, F.explode(F.array_distinct(F.transform(places, lambda i: F.substr(F.col(upper), i, F.col("__n"))))).alias("keyword"))
    hits = parts.join(rules, "keyword").drop("keyword")
    if patterns:
        hits = hits.where(F.col("pattern").isNull() | _matches("pattern", upper))
    held = known.join(hits, upper).where(F.col("under").isNull() | (F.col(at) < F.col("under")))
    rule = F.struct("rule_no", F.coalesce("label", F.lit("")).alias("o"), "label")
    return held.groupBy(upper, at).agg(F.array_distinct(F.transform(F.array_sort(F.collect_set(rule)), lambda x: x["label"])).alias(labels))


def classified(lines: DataFrame, rules: DataFrame, text: str = "text", place: str | None = None, default: str | None = None, label: str = "label", labels: str = "labels") -> DataFrame:
    """The lines with `label`, that of the first rule that holds, else `default`, and `labels`, those of all that hold, first rule first.

    A rule holds for a line whose upper-cased text has the rule's upper-cased
    keyword and matches its pattern, if it has one, and whose place is less than
    the rule's `under`, if it has one. Of rules with one number the label that is
    first in the alphabet counts. Null and empty texts have no labels, repeated
    rules count once, and without rules all lines have the default.
    """
    rules, upper, at = _rules(rules), "__upper", "__place"
    weight = F.sum(F.length("keyword") + F.coalesce(F.length("label"), F.lit(0)) + F.coalesce(F.length("pattern"), F.lit(0)))
    size, patterns = rules.agg(weight, F.count("pattern")).first()
    rows = lines.withColumns({upper: F.coalesce(F.upper(F.col(text)), F.lit("")), at: F.col(place).cast("double") if place else F.lit(None).cast("double")})
    if (size or 0) > BLOCK_BYTES:
        found = _joined(rows, rules, upper, at, patterns > 0, labels).withColumnsRenamed({upper: "__u", at: "__a"})
        out = rows.join(found, F.col(upper).eqNullSafe(F.col("__u")) & F.col(at).eqNullSafe(F.col("__a")), "left")
        out = out.select(*lines.columns, F.coalesce(F.col(labels), F.array().cast("array<string>")).alias(labels))
        return out.withColumn(label, F.coalesce(F.get(F.col(labels), F.lit(0)), F.lit(default)))
    block = rules.sparkSession.sparkContext.broadcast(Block(list(map(tuple, rules.collect()))) if size else None)
    schema = T.StructType([*lines.schema.fields, T.StructField(labels, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = part.column(part.num_columns - 2).to_pylist()
                places = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(float)  # null: not a number
                found: list[set[tuple[int, str]]] = [set() for _ in texts]
                known = block.value
                for line, rule in zip(*known.hits(texts, places), strict=True) if known else ():
                    found[line].add((int(known.number[rule]), known.label[rule]))
                named = [list(dict.fromkeys(name for _, name in sorted(s, key=lambda x: (x[0], x[1] or "")))) for s in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(named, pa.list_(pa.string()))], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.withColumn(label, F.coalesce(F.get(F.col(labels), F.lit(0)), F.lit(default)))
