"""Calls to outside services that fail at times: attempts kept as a table, waits as data, a paced rate.

Two tables below one folder hold all there is to know, so a run that dies goes on
where it was. `attempts` has a row for each call, in a folder for each round.
`open` has the items that are not through yet, with the time before which each
isn't tried again; a round writes it anew in the other one of two folders. A
round depends on the round before and its own new items alone, so one that is run
again after a crash writes the same folders over. Only items that are due reach
the service, and what is through or given up is in no later round.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

# Seconds to wait after a failure of this code, first and from one attempt to the next; attempts in all; pause between two calls.
WAITS = {"503": (1.0, 2.0), "429": (15.0, 1.0)}
OTHER_WAIT = (5.0, 1.0)
MOST = 8
PAUSE = 4.5

#: What a call adds to the item's columns.
OUTCOME = "answer string, code string, error string"


class ServiceError(Exception):
    """A call's failure, with the service's code."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.code = code


#: Makes a function from an item (its columns, and `attempt` from 1) to its answer; called once in each task.
Service = Callable[[], Callable[[dict], str]]


class Bucket:
    """Lets through `rate` calls a second, and up to `burst` at once after a rest."""

    def __init__(self, rate: float, burst: int = 1, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self.now, self.sleep = rate, burst, now, sleep
        self.tokens, self.at = float(burst), now()

    def take(self) -> None:
        at = self.now()
        self.tokens, self.at = min(self.burst, self.tokens + (at - self.at) * self.rate), at
        if self.tokens < 1:
            self.sleep((1 - self.tokens) / self.rate)
            self.tokens, self.at = 1.0, self.now()
        self.tokens -= 1


def wait(code: Column, failures: Column, waits: dict[str, tuple[float, float]] = WAITS, other: tuple[float, float] = OTHER_WAIT) -> Column:
    """Seconds until the next attempt after so many failures: first * factor ^ (failures - 1), by the last failure's code."""
    rows = F.create_map(*(x for c, (first, factor) in waits.items() for x in (F.lit(c), F.struct(F.lit(first).alias("first"), F.lit(factor).alias("factor"))))) if waits else F.lit(None).cast("map<string,struct<first:double,factor:double>>")
    row = F.coalesce(F.try_element_at(rows, code), F.struct(F.lit(other[0]).alias("first"), F.lit(other[1]).alias("factor")))
    return row["first"] * F.pow(row["factor"], failures - 1)


def called(items: DataFrame, service: Service, tasks: int, rate: float | None, burst: int = 1) -> DataFrame:
    """The items (with `attempt`) and answer, code, error of one call each; code and error are null where it went well.

    The items are dealt evenly to `tasks` tasks, which share the rate: together
    they make at most `rate` calls a second (null: unpaced). Any exception is the
    item's own failure, with code `error` unless it is a ServiceError.
    """
    schema = T.StructType([*items.schema.fields, *T._parse_datatype_string(OUTCOME).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, bucket = None, Bucket(rate / tasks, burst) if rate else None
        for batch in batches:
            call = call or service()
            rows = []
            for item in batch.to_dict("records"):
                if bucket:
                    bucket.take()
                try:
                    rows.append((call(item), None, None))
                except ServiceError as error:
                    rows.append((None, error.code, str(error)))
                except Exception as error:  # noqa: BLE001  the item fails, the batch goes on
                    rows.append((None, "error", str(error) or type(error).__name__))
            yield batch.assign(**{c: pd.Series([r[k] for r in rows], index=batch.index, dtype=object) for k, c in enumerate(("answer", "code", "error"))})

    return items.repartition(tasks).mapInPandas(run, schema)


class Attempts:
    """The tables of one folder, and the rounds that write them.

    `keys` name an item. now: the time in seconds, by which items fall due.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], service: Service, *, tasks: int = 8, rate: float | None = 1 / PAUSE, most: int = MOST,
                 waits: dict[str, tuple[float, float]] = WAITS, other: tuple[float, float] = OTHER_WAIT, now: Callable[[], float] = time.time) -> None:
        self.spark, self.folder, self.keys, self.service = spark, folder.rstrip("/"), keys, service
        self.tasks, self.rate, self.most, self.waits, self.other, self.now = tasks, rate, most, waits, other, now

    def _there(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _open(self, number: int) -> str:
        return f"{self.folder}/open/{number % 2}"

    def log(self) -> DataFrame | None:
        """All attempts: the items' columns, attempt, at, answer, code, error, round; null before the first round."""
        return self.spark.read.option("mergeSchema", False).parquet(f"{self.folder}/attempts") if self._there(f"{self.folder}/attempts") else None

    def waiting(self, number: int) -> DataFrame | None:
        """The items open after round `number`: their columns, failures, due (seconds)."""
        return self.spark.read.parquet(self._open(number)) if number >= 0 and self._there(self._open(number)) else None

    def answers(self) -> DataFrame:
        """The items that are through, with their answers."""
        return self.log().where("code IS NULL").drop("code", "error", "at", "round")

    def given_up(self) -> DataFrame:
        """The items that failed `most` times since they last came, with the last code and error."""
        return self.log().where((F.col("attempt") >= self.most) & F.col("code").isNotNull()).drop("answer", "at")

    def round(self, new: DataFrame | None, number: int) -> None:
        """Takes in new items, tries what is due, and writes what stays open.

        An item that comes again while it is open, or after it got through, is
        left out; one that was given up is taken anew. Of items that come twice
        in a round one counts.
        """
        now, before, log = self.now(), self.waiting(number - 1), self.log()
        items = before
        if new is not None:
            new = new.dropDuplicates(self.keys)
            if log is not None:
                new = new.join(log.where((F.col("round") < number) & F.col("code").isNull()).select(*self.keys), self.keys, "left_anti")
            if before is not None:
                new = new.join(before.select(*self.keys), self.keys, "left_anti")
            new = new.withColumns({"failures": F.lit(0), "due": F.lit(float(now))})
            items = new if before is None else before.unionByName(new.select(*before.columns))
        if items is None:
            return
        due = items.where(F.col("due") <= now).withColumn("attempt", F.col("failures") + 1).drop("failures", "due")
        place = f"{self.folder}/attempts/round={number}"
        called(due, self.service, self.tasks, self.rate).withColumn("at", F.lit(float(now))).write.mode("overwrite").parquet(place)
        tried = self.spark.read.parquet(place)
        again = tried.where(F.col("code").isNotNull() & (F.col("attempt") < self.most))
        later = F.col("at") + wait(F.col("code"), F.col("attempt"), self.waits, self.other)
        again = again.withColumns({"failures": F.col("attempt"), "due": later}).select(*items.columns)
        items.where(F.col("due") > now).unionByName(again).write.mode("overwrite").parquet(self._open(number))

    def until_done(self, items: DataFrame, sleep: Callable[[float], None] = time.sleep) -> int:
        """Rounds until no item is open, with a rest until the next is due; returns their number. Goes on with what an earlier run left open."""
        log = self.log()
        number = 0 if log is None else (log.agg(F.max("round")).first()[0] or 0) + 1
        new: DataFrame | None = items
        while True:
            self.round(new, number)
            new, number = None, number + 1
            left = self.waiting(number - 1)
            due = left.agg(F.min("due")).first()[0] if left is not None else None
            if due is None:
                return number
            sleep(max(0.0, due - self.now()))

    def stream(self, arriving: DataFrame, checkpoint: str, seconds: float = 1.0, clock: DataFrame | None = None) -> StreamingQuery:
        """Rounds for a stream of items, one a micro-batch; a clock stream keeps them coming while items wait.

        The clock gives a row each `seconds`; it carries no item. Micro-batches are
        numbered from 0 and run again under their number after a crash.
        """
        ticks = clock if clock is not None else self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in arriving.schema.fields]
        both = arriving.withColumn("__item", F.lit(True)).unionByName(ticks.select(*empty, F.lit(False).alias("__item")))

        def one(batch: DataFrame, number: int) -> None:
            self.round(batch.where("__item").drop("__item"), number)

        return both.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
