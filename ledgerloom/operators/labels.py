"""Label vocabularies and their frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The field vocabularies.
BASE_FIELDS = ["SELLER", "ADDRESS", "TIMESTAMP", "TOTAL_COST"]
ITEM_FIELDS = ["ITEM_NAME", "ITEM_QTY", "ITEM_PRICE", "ITEM_AMOUNT"]
FIELDS = [*BASE_FIELDS, *ITEM_FIELDS]
PAGE_LABELS = {"store_name": "SELLER", "address": "ADDRESS", "date": "TIMESTAMP", "total_amount": "TOTAL_COST"}


def canonical_label(label: Column, unknown: str = "OTHER") -> Column:
    """Upper case; numbered item labels lose their number; other names become OTHER, or null with unknown="drop"."""
    if unknown not in ("OTHER", "drop"):
        raise ValueError(f"unknown must be OTHER or drop, not {unknown}")
    upper = F.upper(label)
    out = F.when(upper.isin(BASE_FIELDS), upper)
    for field in ITEM_FIELDS:
        out = out.when(upper.startswith(field), field)
    return out.otherwise("OTHER") if unknown == "OTHER" else out


def page_label(label: Column) -> Column:
    """The field that a page element's label stands for; null for labels that stand for none."""
    out = F.lit(None).cast("string")
    for name, field in PAGE_LABELS.items():
        out = F.when(label == name, field).otherwise(out)
    for field in ITEM_FIELDS:
        out = F.when(label.startswith(field.lower()), field).otherwise(out)
    return out


def tag_label(tag: Column) -> Column:
    """The label of a B- or I- tag; OTHER for a missing tag."""
    return F.coalesce(F.when(tag.rlike("^[BI]-"), F.split_part(tag, F.lit("-"), F.lit(2))).otherwise(tag), F.lit("OTHER"))


def label_id(tag: Column, tags: list[str]) -> Column:
    """The place of a tag in its vocabulary, from 0; null for a tag that isn't in it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, tags)), tag) - 1, F.lit(-1).cast("long"))


def id_within(token: Column, size: int, unknown: int) -> Column:
    """Token ids outside a vocabulary become the unknown id."""
    return F.when((token >= size) | (token < 0), F.lit(unknown)).otherwise(token)


def histogram(df: DataFrame, column: str, absent: str = "UNKNOWN", top: int | None = None) -> DataFrame:
    """(column, n) by falling n and then value; null counts as `absent`. `top` keeps that many."""
    out = df.groupBy(F.coalesce(F.col(column), F.lit(absent)).alias(column)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return out.limit(top) if top else out


def width_histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """(bin, n) over equal widths between the least and largest value; the last bin has its upper edge. Equal values are all in bin 0."""
    edges = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    place = F.floor(F.try_divide((F.col(column) - F.col("low")) * bins, F.col("high") - F.col("low")))
    number = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), place)).otherwise(0).cast("int")
    return df.where(F.col(column).isNotNull()).join(F.broadcast(edges)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
