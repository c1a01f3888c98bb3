"""Access to the tables that the registered queries read, to the shared checkpoint folder, and to free column names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which spark.checkpoint.dir names.

    Where none is set, a session on one machine takes a temporary one; on a
    cluster, whose executors would not share it, this is an error.
    """
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerloom-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder and read back, so that lost executors cost no earlier work."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like `cut`, as a table of the checkpoint folder: for loops of joins.

    A checkpoint keeps the size that Spark guessed for its plan, and a join's
    guess is the product of its sides', so in a loop that number gets as many
    digits as there are rows; a table has the size of its files.
    """
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that the table hasn't: those wanted, with underscores before them as needed."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
