"""Files that are put under free names only: taken names, failures, replays, restarts, two tasks at one name."""

from __future__ import annotations

import os
import threading

from pyspark.sql import functions as F

from ledgerloom.streaming import ingest, uploads
from ledgerloom.streaming.uploads import FolderStore

SCHEMA = "content binary, name string, other int"


def table(spark, rows):
    return spark.createDataFrame([(c, n, 1) for n, c in rows], SCHEMA)


def outcomes(spark, log):
    return sorted(((r.name, r.status, r.error, r.batch) for r in uploads.outcomes(spark, str(log)).collect()), key=str)


def files(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names}


def test_a_table_of_files(spark, tmp_path):
    store, log = tmp_path / "store", tmp_path / "log"
    (store / "cafe").mkdir(parents=True)
    (store / "cafe/old.jpg").write_bytes(b"old")
    rows = [("cafe/new.jpg", b"1"), ("cafe/old.jpg", b"2"), ("empty", b""), ("bad", None), (None, b"x"), ("../out", b"x"), ("", b"x"), ("cafe", b"a folder")]
    for _ in range(2):  # the second run is a replay
        uploads.put(table(spark, rows).repartition(3), str(store), f"file://{log}", batch="first")
        got = outcomes(spark, log)
        assert [(n, s, b) for n, s, _, b in got if s != "failed"] == [("cafe/new.jpg", "put", "first"), ("cafe/old.jpg", "kept", "first"), ("empty", "put", "first")]
        assert sorted((str(n), bool(e)) for n, s, e, _ in got if s == "failed") == [("", True), ("../out", True), ("None", True), ("bad", True), ("cafe", True)]
        assert files(store) == {"cafe/new.jpg": b"1", "cafe/old.jpg": b"old", "empty": b""}
    assert not (tmp_path / "out").exists()


def test_many_rows_of_one_name(spark, tmp_path):
    rows = spark.range(64).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("content"), F.lit("one").alias("name")).repartition(8)
    uploads.put(rows, str(tmp_path / "store"), str(tmp_path / "log"))
    assert sorted(s for _, s, _, _ in outcomes(spark, tmp_path / "log")) == ["kept"] * 63 + ["put"]
    assert len(files(tmp_path / "store")) == 1


def test_two_at_one_name(tmp_path):
    store, found = FolderStore(str(tmp_path)), []
    threads = [threading.Thread(target=lambda k=k: found.append(store.put("x", bytes([k]) * 100_000))) for k in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(found) == 1 and len(set(files(tmp_path)["x"])) == 1 and len(files(tmp_path)) == 1


def test_a_stream_of_files_and_its_restart(spark, tmp_path):
    def run():
        stream = ingest.table_stream(spark, f"{tmp_path}/in/*", SCHEMA)
        query = ingest.started(uploads.putting(stream, str(tmp_path / "store"), str(tmp_path / "log"), str(tmp_path / "state")), spark)
        query.awaitTermination()
        assert query.exception() is None
        return outcomes(spark, tmp_path / "log")

    table(spark, [("a", b"1"), ("b", None)]).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    first = run()
    assert [(n, s, b) for n, s, _, b in first] == [("a", "put", "0"), ("b", "failed", "0")]
    table(spark, [("a", b"other"), ("c", b"3")]).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    second = run()
    assert [(n, s, b) for n, s, _, b in second if b == "1"] == [("a", "kept", "1"), ("c", "put", "1")]
    for name in ("1", ".1.crc"):
        os.unlink(tmp_path / "state/commits" / name)  # a crash before the stream knew that the batch was through
    again = run()
    assert again == second and files(tmp_path / "store") == {"a": b"1", "c": b"3"}




def test_any_store(spark, tmp_path, monkeypatch):
    (tmp_path / "their_store.py").write_text("from ledgerloom.streaming.uploads import FolderStore\n\n\nclass Refusing(FolderStore):\n    def put(self, name, content):\n        if name.startswith('no'):\n            raise PermissionError('refused by policy')\n        return super().put(name, content)\n")
    spark.sparkContext.addPyFile(str(tmp_path / "their_store.py"))
    uploads.put(table(spark, [("no.jpg", b"1"), ("yes.jpg", b"2")]), str(tmp_path / "store"), str(tmp_path / "log"), store="their_store:Refusing", batch="b")
    assert outcomes(spark, tmp_path / "log") == [("no.jpg", "failed", "refused by policy", "b"), ("yes.jpg", "put", None, "b")]
