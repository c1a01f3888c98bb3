"""Files into a store under names that are never overwritten: a sink for streams and tables.

Each row (name, content) is put if its name is free. A name that is taken keeps
what it has, a file that fails is recorded, and the batch goes on. What became of
each file stands in the log, a folder for each batch, and a batch counts once its
commit is there; one that runs again finds its own files in place and ends alike.
"""

from __future__ import annotations

import contextlib
import importlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import Row, StructType

# What may become of a file.
PUT, KEPT, FAILED = "put", "kept", "failed"
FORMAT = "put_if_absent"
OUTCOME = "name string, status string, error string"


class Store(Protocol):
    """Where files go. `put` gives whether the name now has this content by a put; false where it was taken by another."""

    def put(self, name: str, content: bytes) -> bool: ...


class FolderStore:
    """A folder that all executors share. A file appears whole under its name or not at all, and only where none was."""

    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")

    def put(self, name: str, content: bytes) -> bool:
        target = os.path.normpath(os.path.join(self.path, name))
        if not name or target != self.path and not target.startswith(os.path.normpath(self.path) + os.sep):
            raise ValueError(f"a name outside the store: {name!r}")
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = f"{target}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "xb") as out:
                out.write(content)
            os.link(part, target)  # fails where the name is taken, be it by another task at this moment
            return True
        except FileExistsError:
            with open(target, "rb") as there:
                return there.read() == content
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(part)


@dataclass
class _Done(WriterCommitMessage):
    counts: dict[str, int]


class _Writer(DataSourceStreamWriter, DataSourceWriter):
    """options: path of the store, log (a shared folder), store (module:class, made with the path; a folder by default)."""

    def __init__(self, options: dict[str, str], schema: StructType, number: str | None) -> None:
        self.path, self.log, self.number = options["path"], FolderStore(options["log"]).path, number
        self.store, self.at = options.get("store"), [schema.names.index("name"), schema.names.index("content")]

    def _made(self) -> Store:
        if not self.store:
            return FolderStore(self.path)
        module, _, name = self.store.partition(":")
        return getattr(importlib.import_module(module), name)(self.path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, counts = self._made(), dict.fromkeys((PUT, KEPT, FAILED), 0)
        context = TaskContext.get()
        os.makedirs(f"{self.log}/parts", exist_ok=True)
        # a task's attempts have files of their own; the commit names those that count
        part = f"{context.partitionId()}-{uuid.uuid4().hex}.json"
        with open(f"{self.log}/parts/{part}", "x", encoding="utf-8") as out:
            for row in iterator:
                name, content = (row[k] for k in self.at)
                error = None
                try:
                    if name is None or content is None:
                        raise ValueError("no name" if name is None else "no content")
                    status = PUT if store.put(name, bytes(content)) else KEPT
                except Exception as problem:  # noqa: BLE001  the file fails, the batch goes on
                    status, error = FAILED, str(problem) or type(problem).__name__
                counts[status] += 1
                out.write(json.dumps({"name": name, "status": status, "error": error}) + "\n")
        return _Done({**counts, part: 1})

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int | None = None) -> None:  # noqa: N803
        """Names the batch's parts: one small file, which appears whole; of a batch that runs again the last one counts."""
        number = self.number or str(batchId)
        parts = [p for m in messages if isinstance(m, _Done) for p in m.counts if p.endswith(".json")]
        totals = {s: sum(m.counts[s] for m in messages if isinstance(m, _Done)) for s in (PUT, KEPT, FAILED)}
        os.makedirs(f"{self.log}/commits", exist_ok=True)
        part = f"{self.log}/commits/.{uuid.uuid4().hex}"
        with open(part, "x", encoding="utf-8") as out:
            out.write("".join(json.dumps({"batch": number, "part": p, **totals}) + "\n" for p in parts))
        os.replace(part, f"{self.log}/commits/{number}.json")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int | None = None) -> None:  # noqa: N803
        pass  # what was put stays: the batch runs again and finds it


class PutIfAbsent(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, self.options.get("batch") or f"table-{uuid.uuid4().hex}")

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _Writer(self.options, schema, None)


def put(files: DataFrame, path: str, log: str, store: str | None = None, batch: str | None = None) -> None:
    """Puts a table's files (name, content). Of rows with one name one is put; `batch` names the commit, for a run that may be repeated."""
    files.sparkSession.dataSource.register(PutIfAbsent)
    writer = files.select("name", "content").write.format(FORMAT).mode("append").option("path", path).option("log", log)
    for key, value in (("store", store), ("batch", batch)):
        writer = writer.option(key, value) if value else writer
    writer.save()


def putting(files: DataFrame, path: str, log: str, checkpoint: str, store: str | None = None) -> DataStreamWriter:
    """The same for a stream, a commit for each micro-batch; start it as any stream."""
    files.sparkSession.dataSource.register(PutIfAbsent)
    writer = files.select("name", "content").writeStream.format(FORMAT).option("path", path).option("log", log).option("checkpointLocation", checkpoint)
    return writer.option("store", store) if store else writer


def outcomes(spark: SparkSession, log: str) -> DataFrame:
    """(name, status, error, batch) of every file of the batches that are committed."""
    parts = spark.read.schema("batch string, part string").json(f"{log}/commits/*.json")
    rows = spark.read.schema(OUTCOME).json(f"{log}/parts").withColumn("part", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.join(parts, "part").select("name", "status", "error", "batch")
