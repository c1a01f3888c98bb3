"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_records(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def json_splits(df: DataFrame, path: str, split: str = "split", mode: str = "error", combined: str | None = None) -> None:
    """One folder for each split; with `combined` also a folder of that path with the rows of all, their split a column."""
    df.write.mode(mode).partitionBy(split).json(path)
    if combined:
        df.write.mode(mode).json(combined)


def csv_table(df: DataFrame, path: str, mode: str = "error", mark: bool = False) -> None:
    """Each file has a header; with `mark` a byte order mark before it, by which spreadsheets know UTF-8."""
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], f"\ufeff{df.columns[0]}")
    df.write.mode(mode).csv(path, header=True)


def text_lists(df: DataFrame, path: str, group: str, value: str, mode: str = "error") -> None:
    """One folder of lines for each group; a group without rows has none."""
    df.select(group, F.col(value).cast("string").alias("value")).write.mode(mode).partitionBy(group).text(path)


def appended(df: DataFrame, path: str) -> None:
    """Adds rows to a Parquet table; earlier rows are never written again."""
    df.write.mode("append").parquet(path)


def markdown_report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table. More than `most` rows are an error, as none is left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    show = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"
