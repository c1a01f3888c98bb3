"""Scores of predicted fields, entities and tags against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import blank_to_null, bound


def field_pairs(truth: DataFrame, predicted: DataFrame, keys: list[str], lines: DataFrame | None = None, document: str = "doc_id") -> DataFrame:
    """(keys, truth, predicted) over the fields of either side; blank values count as absent. Both: keys, value.

    With `lines`, the recognised lines, only documents that have any are scored.
    """
    if lines is not None:
        seen = lines.select(document).distinct()
        truth, predicted = (side.join(seen, document, "left_semi") for side in (truth, predicted))
    a = truth.select(*keys, blank_to_null(F.col("value")).alias("truth"))
    b = predicted.select(*keys, blank_to_null(F.col("value")).alias("predicted"))
    return a.join(b, keys, "full_outer")


def wide_pairs(truth: DataFrame, predicted: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, truth, predicted) as field_pairs gives, of sides that have a column for each field: joined by document."""
    sides = [side.select(*keys, F.struct(*(blank_to_null(F.col(f).cast("string")).alias(f) for f in fields)).alias(name)) for name, side in (("__t", truth), ("__p", predicted))]
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col("__t")[f].alias("truth"), F.col("__p")[f].alias("predicted")) for f in fields))
    return sides[0].join(sides[1], keys, "full_outer").select(*keys, F.inline(pairs))


def confusion(pairs: DataFrame, similarity: Column, by: list[str], threshold: float = 0.8, strict: bool = False) -> DataFrame:
    """(by, tp, fp, fn): a pair alike is one tp, unlike one fp and one fn; a lone truth one fn, a lone prediction one fp.

    `strict` asks for more than the threshold, otherwise it is enough itself.
    """
    rows = pairs.withColumn("__both", F.col("truth").isNotNull() & F.col("predicted").isNotNull())
    alike = F.col("__both") & ((similarity > threshold) if strict else (similarity >= threshold))
    rows = rows.withColumn("__alike", alike)
    counted = lambda side: F.sum((F.col(side).isNotNull() & ~F.col("__alike")).cast("long"))
    return rows.groupBy(*by).agg(F.sum(F.col("__alike").cast("long")).alias("tp"), counted("predicted").alias("fp"), counted("truth").alias("fn"))


def scores(counts: DataFrame, form: str = "guarded", digits: int = 2) -> DataFrame:
    """Adds precision, recall and f1 from tp, fp, fn.

    guarded: in percent, rounded half to even, 0 where nothing is to divide.
    epsilon: plain shares with 1e-9 under the line; rows of zeros are left out.
    """
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    if form == "guarded":
        share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
        p, r = share(tp, tp + fp), share(tp, tp + fn)
        f = share(2 * p * r, p + r)
        made = {n: F.bround(v * 100, digits) for n, v in (("precision", p), ("recall", r), ("f1", f))}
        return counts.withColumns(made)
    if form == "epsilon":
        tiny = 1e-9
        p, r = tp / (tp + fp + tiny), tp / (tp + fn + tiny)
        return counts.where("tp + fp + fn > 0").withColumns({"precision": p, "recall": r, "f1": 2 * p * r / (p + r + tiny)})
    raise ValueError(f"unknown form {form}")


def score_table(scored: DataFrame, dataset: str = "dataset", model: str = "model", by: str = "model") -> DataFrame:
    """The scores of models on datasets in order: by dataset, then by model, or by falling f1 (ties by model) with by="f1"."""
    if by not in ("model", "f1"):
        raise ValueError(f"by must be model or f1, not {by}")
    return scored.orderBy(dataset, *([F.desc("f1")] if by == "f1" else []), model)


def entity_confusion(truth: DataFrame, predicted: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """(by, tp, fp, fn) of spans: equal in keys, or wrong. Both sides have the columns of by and keys."""
    on = list(dict.fromkeys([*by, *keys]))
    a = truth.select(*on).distinct().withColumn("__a", F.lit(1))
    b = predicted.select(*on).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, on, "full_outer")
    count = lambda c: F.sum(c.cast("long"))
    return both.groupBy(*by).agg(
        count(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("tp"), count(F.col("__a").isNull()).alias("fp"), count(F.col("__b").isNull()).alias("fn")
    )


def entity_counts(truth: Column, predicted: Column) -> Column:
    """array<struct<label, tp, fp, fn>> whose sums by label are entity_confusion(); of one text whose spans (label, start, end), none twice, are lists."""
    long = lambda v: F.lit(v).cast("long")
    counted = lambda label, tp, fp, fn: F.struct(label.alias("label"), long(tp).alias("tp"), long(fp).alias("fp"), long(fn).alias("fn"))
    keys = lambda spans: F.transform(spans, lambda s: F.concat_ws(" ", s["start"], s["end"], s["label"]))
    label = lambda key: F.regexp_replace(key, "^[0-9]+ [0-9]+ ", "")
    both = lambda x: F.transform(F.array_intersect(keys(x["a"]), keys(x["b"])), lambda key: counted(label(key), 1, -1, -1))
    one = lambda spans, fp, fn: F.transform(spans, lambda s: counted(s["label"], 0, fp, fn))
    return bound(F.struct(truth.alias("a"), predicted.alias("b")), lambda x: F.concat(one(x["a"], 0, 1), one(x["b"], 1, 0), both(x)))


def token_accuracy(rows: DataFrame, by: list[str], truth: str = "tag", predicted: str = "pred", ignore: str | None = None) -> DataFrame:
    """(by, n, accuracy) over the tokens that aren't ignored."""
    kept = rows.where(F.col(truth) != ignore) if ignore is not None else rows
    return kept.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
