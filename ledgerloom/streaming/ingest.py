"""Continuous ingestion of uploads from a landing folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from ledgerloom.functions.text import path_name
from ledgerloom.sources.files import IMAGES


def uploads(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """(path, name, template, modified, length, content): images as they land; the template is the name of their folder. `per_trigger` paces the stream."""
    rows = spark.readStream.format("binaryFile").option("pathGlobFilter", IMAGES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").load(folder)
    template = F.element_at(F.split("path", "/"), -2)
    return rows.select("path", path_name(F.col("path")).alias("name"), template.alias("template"), F.col("modificationTime").alias("modified"), "length", "content")


def table_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def once_each(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key. With an event time the state of keys older than `delay` is dropped; without, it is kept."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


class _UntilDone(StatefulProcessor):
    """Keeps for each key whether it is done, and lets rows through until it is."""

    def __init__(self, columns: list[str], order: list[str], error: str, milliseconds: int) -> None:
        self.columns, self.order, self.error, self.milliseconds = columns, order, error, milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "done boolean", self.milliseconds)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done, held = self.done.exists() and self.done.get()[0], None
        by = [*self.order, *(c for c in self.columns if c not in self.order)]
        for frame in rows:  # of the rows so far those up to the first that went well are held
            if not done:
                held = frame if held is None else pd.concat([held, frame], ignore_index=True)
                held = held.sort_values(by, kind="stable")
                well = held[self.error].isna().to_numpy()
                held = held.iloc[: int(well.argmax()) + 1] if well.any() else held
        if held is not None:
            done = bool(held[self.error].isna().any())
            yield held[self.columns]
        self.done.update((done,))

    def close(self) -> None:
        pass


def until_done(stream: DataFrame, keys: list[str], order: list[str], error: str = "error", keep: str = "30 days") -> DataFrame:
    """The rows of each key up to its first one without an error: what failed is taken again, what is done is not.

    The state of a key is whether it is done; it goes when no row of the key has
    come for `keep`, so a key that comes back later begins anew. Rows of a
    micro-batch are taken by `order`, ties by the other columns. Null keys are one
    key. A micro-batch that runs again gives the same rows, as its state is that
    of the one before. Start the stream with `started`, which sets the state store
    that this needs.
    """
    milliseconds = int(pd.Timedelta(keep).total_seconds() * 1000)
    processor = _UntilDone(stream.columns, order, error, milliseconds)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, stream.schema, "append", "ProcessingTime")


# States of any kind are kept in RocksDB; a stream that takes what is there ends after it, though states may run out later.
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Starts a stream that takes all there is and then ends; its settings hold for this stream only."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        return writer.trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def into_table(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Appends what has arrived to a Parquet table, then stops; a run after a crash goes on where the last one got to.

    Each micro-batch writes a folder of its own, named by the query's id, which
    its checkpoint keeps, and its number. So one that runs again overwrites what
    it wrote, and another stream, or one whose checkpoint was lost, does not.
    """

    def write(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{path}/query={query}/batch={number}")

    return started(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), stream.sparkSession)
