"""Attempts with waits, and items that are taken until they are done: results, times, replays and restarts."""

from __future__ import annotations

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import attempts, ingest
from ledgerloom.streaming.attempts import Attempts, Bucket, ServiceError


class Clock:
    def __init__(self):
        self.at = 100.0

    def __call__(self):
        return self.at

    def sleep(self, seconds):
        assert seconds >= 0
        self.at += seconds


CODES = ["503", "429", "500"]


def _service():
    def flaky():  # inside a function, so that it goes to the workers by value
        def call(item):
            if item["attempt"] <= item["fails"]:
                if item["code_no"] == 3:
                    raise OSError("no network")
                raise ServiceError(CODES[item["code_no"]], "busy")
            return f"answer {item['id']}"

        return call

    return flaky


flaky = _service()


def items(spark, rows):
    return spark.createDataFrame(rows, "id long, fails int, code_no int")


def waits(code_no, failures):
    return [2.0 ** (failures - 1), 15.0, 5.0, 5.0][code_no]


def test_attempts_end_right_and_wait(spark, tmp_path):
    rng, clock = random.Random(4), Clock()
    rows = [(k, rng.choice([0, 0, 1, 2, 7, 8, 20]), rng.randint(0, 3)) for k in range(60)]
    calls = Attempts(spark, str(tmp_path), ["id"], flaky, tasks=3, rate=None, now=clock)
    calls.until_done(items(spark, rows), clock.sleep)
    times = defaultdict(list)
    for r in calls.log().orderBy("id", "attempt").collect():
        times[r.id].append((r.attempt, r.at, r.code))
    for k, fails, code_no in rows:
        at, want = 100.0, []
        for n in range(1, min(fails + 1, 8) + 1):
            want.append((n, at, None if n > fails else [*CODES, "error"][code_no]))
            at += waits(code_no, n)
        assert times[k] == want, k
    assert sorted((r.id, r.answer) for r in calls.answers().collect()) == [(k, f"answer {k}") for k, fails, _ in rows if fails < 8]
    assert sorted(r.id for r in calls.given_up().collect()) == [k for k, fails, _ in rows if fails >= 8]


def test_a_round_that_runs_again_changes_nothing(spark, tmp_path):
    clock = Clock()
    calls = Attempts(spark, str(tmp_path), ["id"], flaky, tasks=2, rate=None, now=clock)
    first, second = items(spark, [(k, k % 3, 2) for k in range(9)]), items(spark, [(k, 1, 2) for k in range(6, 12)])
    show = lambda: (sorted(map(tuple, calls.log().select("id", "attempt", "at", "code", "round").collect()), key=str), sorted(map(tuple, calls.waiting(n).select("id", "failures", "due").collect())))
    for n, new in enumerate((first, second, None)):
        calls.round(new, n)
        before = show()
        calls.round(new, n)  # as after a crash before the round was committed
        assert show() == before
        clock.sleep(5)
    calls.until_done(first.limit(0), clock.sleep)  # goes on with what is open
    assert sorted(r.id for r in calls.answers().collect()) == list(range(12))


def test_a_crash_between_the_tables_loses_nothing(spark, tmp_path, monkeypatch):
    clock = Clock()
    calls = Attempts(spark, str(tmp_path), ["id"], flaky, tasks=2, rate=None, now=clock)
    calls.round(items(spark, [(k, 1, 2) for k in range(5)]), 0)
    clock.sleep(5)
    with monkeypatch.context() as m:
        m.setattr(attempts, "wait", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            calls.round(items(spark, [(9, 0, 0)]), 1)
    again = Attempts(spark, str(tmp_path), ["id"], flaky, tasks=2, rate=None, now=clock)
    again.round(items(spark, [(9, 0, 0)]), 1)
    assert sorted(r.id for r in again.answers().collect()) == [0, 1, 2, 3, 4, 9]
    assert again.waiting(1).count() == 0


def test_what_comes_again(spark, tmp_path):
    clock = Clock()
    calls = Attempts(spark, str(tmp_path), ["id"], flaky, tasks=1, rate=None, most=2, now=clock)
    calls.until_done(items(spark, [(1, 0, 0), (1, 0, 0), (2, 9, 0)]), clock.sleep)
    assert calls.log().count() == 3
    calls.until_done(items(spark, [(1, 0, 0), (2, 0, 0)]), clock.sleep)  # 1 is done, 2 was given up
    assert sorted((r.id, r.attempt) for r in calls.answers().collect()) == [(1, 1), (2, 1)]


def test_the_bucket_keeps_the_rate():
    clock = Clock()
    bucket, times = Bucket(2.0, 3, clock, clock.sleep), []
    for k in range(12):
        bucket.take()
        times.append(clock.at)
        clock.at += 0.1 if k % 2 else 0.0
    assert times[0] == times[1] == 100.0
    for i in range(len(times)):
        for j in range(i, len(times)):
            assert j - i + 1 <= 3 + 2.0 * (times[j] - times[i]) + 1e-6


def test_calls_are_paced(spark):
    rows = spark.range(10).withColumn("attempt", F.lit(1))
    began = time.time()
    assert attempts.called(rows, lambda: lambda item: str(item["id"]), tasks=2, rate=10.0).count() == 10
    assert time.time() - began > 0.7  # five calls of a task at five a second


def test_attempts_of_a_stream(spark, tmp_path):
    schema = "id long, fails int, code_no int"
    for n, rows in enumerate(([(1, 0, 0), (2, 2, 2), (3, 9, 2)], [(2, 2, 2), (4, 1, 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    calls = Attempts(spark, f"{tmp_path}/calls", ["id"], flaky, tasks=2, rate=None, most=3, other=(0.5, 1.0))
    for stop_at in (2, 5):  # the second run goes on from the first one's checkpoint
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = calls.stream(arriving, f"{tmp_path}/state", 0.2)
        until = time.time() + 60
        done = lambda: calls.log().where("code IS NULL").count() + calls.given_up().count() if calls.log() is not None else 0
        while time.time() < until and query.isActive:
            if query.lastProgress and query.lastProgress["batchId"] >= stop_at and (stop_at == 2 or done() == 4):
                break
            time.sleep(0.3)
        query.stop()
        assert query.exception() is None
    assert sorted((r.id, r.attempt) for r in calls.answers().collect()) == [(1, 1), (2, 3), (4, 2)]
    assert [r.id for r in calls.given_up().collect()] == [3]


LOG = "key string, at int, error string, note string"


def until_done(rows):
    out, done = [], set()
    for batch in rows:
        for r in sorted(batch, key=lambda r: (r[1], r[2] is None, r[2] or "")):
            if r[0] not in done:
                out.append(r)
                if r[2] is None:
                    done.add(r[0])
    return out


def test_failed_items_are_taken_again_and_done_ones_not(spark, tmp_path):
    rng = random.Random(8)
    batches = [[(rng.choice(["a", "b", "c", "d", None]), 1000 * n + i, rng.choice([None, "E", "F", "E"]), f"n{i}") for i in range(rng.randint(1, 12))] for n in range(4)]
    batches[2].append(("never", 2500, "E", "x"))
    batches[3].append(("never", 3500, "E", "x"))

    def run():
        stream = ingest.table_stream(spark, f"{tmp_path}/in/*", LOG)
        ingest.into_table(ingest.until_done(stream, ["key"], ["at"]), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        return sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("key", "at", "error", "note").collect()), key=str)

    for n, batch in enumerate(batches):  # each run is a restart
        spark.createDataFrame(batch, LOG).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        assert run() == sorted(until_done(batches[: n + 1]), key=str)
    assert run() == sorted(until_done(batches), key=str)


def test_two_streams_into_one_table(spark, tmp_path):
    for name in ("one", "two"):
        spark.createDataFrame([(name,)], "name string").write.parquet(f"{tmp_path}/{name}")
        ingest.into_table(ingest.table_stream(spark, f"{tmp_path}/{name}", "name string"), f"{tmp_path}/out", f"{tmp_path}/state-{name}").awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["one", "two"]
