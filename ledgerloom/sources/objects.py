"""Objects of a store that is reached by a client: listed by executors, a task a folder, and read by as many tasks as are wanted.

The driver learns the folders only, neither names nor contents. A folder is
listed page by page, by suffix and up to a cap, so of a capped folder only the
pages are asked for that the cap needs. Contents are read from a listing that has
been dealt out anew, so one large folder does not keep a task busy with reading.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "object_listing"
LISTING = "folder string, name string, path string, length bigint"
# The endings of images.
IMAGES = (".png", ".jpg", ".jpeg")
#: Names that a client is asked for at once, and objects whose contents are held at once.
PAGE, HELD = 1000, 16


class ObjectStore(Protocol):
    """A client, made with the store's address in each task that needs one."""

    def folders(self) -> list[str]: ...

    def page(self, folder: str, after: str | None, most: int) -> list[tuple[str, int]]:
        """(name, length) of up to `most` objects of the folder in the order of their names, from the first behind `after`."""
        ...

    def read(self, folder: str, name: str) -> bytes: ...


class SharedFolder:
    """A store in a folder that all executors share; its folders are those directly inside."""

    def __init__(self, address: str) -> None:
        self.address = address.removeprefix("file://") if address.startswith("file://") else address.removeprefix("file:")

    def folders(self) -> list[str]:
        with os.scandir(self.address) as entries:
            return sorted(e.name for e in entries if e.is_dir())

    def page(self, folder: str, after: str | None, most: int) -> list[tuple[str, int]]:
        with os.scandir(os.path.join(self.address, folder)) as entries:
            names = sorted((e.name, e.stat().st_size) for e in entries if e.is_file() and (after is None or e.name > after))
        return names[:most]

    def read(self, folder: str, name: str) -> bytes:
        with open(os.path.join(self.address, folder, name), "rb") as found:
            return found.read()


def _client(store: str | None, address: str) -> ObjectStore:
    if not store:
        return SharedFolder(address)
    module, _, name = store.partition(":")
    return getattr(importlib.import_module(module), name)(address)


@dataclass
class _Folder(InputPartition):
    name: str

    def __post_init__(self) -> None:
        super().__init__(self.name)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.address, self.store = options["path"], options.get("store")
        self.wanted = [f for f in options.get("folders", "").split("\n") if f]
        self.suffixes = tuple(s for s in options.get("suffixes", "").split("\n") if s)
        self.most = int(options["most"]) if options.get("most") else None

    def partitions(self) -> list[InputPartition]:
        return [_Folder(f) for f in self.wanted or _client(self.store, self.address).folders()]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        client, after, left = _client(self.store, self.address), None, self.most
        while left is None or left > 0:
            page = client.page(partition.name, after, PAGE)
            found = [(n, size) for n, size in page if not self.suffixes or n.endswith(self.suffixes)][:left]
            left = None if left is None else left - len(found)
            if found:
                base = self.address.rstrip("/")
                columns = [[partition.name] * len(found), [n for n, _ in found], [f"{base}/{partition.name}/{n}" for n, _ in found], [size for _, size in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["folder", "name", "path", "length"])
            if len(page) < PAGE:
                return
            after = page[-1][0]


class ObjectListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def listed(spark: SparkSession, address: str, folders: tuple[str, ...] = (), suffixes: tuple[str, ...] = IMAGES, most: int | None = None, store: str | None = None) -> DataFrame:
    """(folder, name, path, length) of the objects with one of the suffixes; `most` keeps the first by name of each folder.

    `store` names a client class as module:class; a shared folder is the
    default. Without `folders` all of the store's are listed; one that is empty
    has no rows, one that fails fails the task, which Spark tries again.
    """
    spark.dataSource.register(ObjectListing)
    options = {"path": address, "folders": "\n".join(folders), "suffixes": "\n".join(suffixes)} | ({"store": store} if store else {}) | ({"most": str(most)} if most is not None else {})
    return spark.read.format(FORMAT).options(**options).load()


def with_contents(listing: DataFrame, address: str, tasks: int = 32, store: str | None = None) -> DataFrame:
    """The listing with `content` and `error`: an object that can't be read has an error in place of its content, and the others go on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for batch in batches:
            client = client or _client(store, address)
            for start in range(0, batch.num_rows, HELD):
                part, content, error = batch.slice(start, HELD), [], []
                for folder, name in zip(part.column("folder").to_pylist(), part.column("name").to_pylist(), strict=True):
                    try:
                        content.append(client.read(folder, name))
                        error.append(None)
                    except Exception as problem:  # noqa: BLE001  the object fails, the others go on
                        content.append(None)
                        error.append(str(problem) or type(problem).__name__)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(content, pa.binary()), pa.array(error, pa.string())], names=[*part.schema.names, "content", "error"])

    schema = StructType(listing.schema.fields).add("content", "binary").add("error", "string")
    return listing.repartition(tasks, F.xxhash64("path")).mapInArrow(read, schema)
