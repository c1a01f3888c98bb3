"""Objects of a slow store, listed and read by tasks; engines as a table function."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.recognise import register_engines
from ledgerloom.sources import objects

#: A store of 5 folders, the last of 2500 objects, that writes down what it is asked for and fails on some objects.
SLOW = '''
import os, time, uuid

class Slow:
    def __init__(self, address):
        self.log = address

    def note(self, what):
        open(f"{self.log}/{uuid.uuid4().hex}", "w").write(f"{os.getpid()} {what}")

    def folders(self):
        self.note("folders")
        return [f"f{k}" for k in range(5)]

    def names(self, folder):
        k = int(folder[1:])
        return sorted(f"{i:05d}{('.jpg', '.PNG', '.png', '.txt')[i % 4]}" for i in range([0, 3, 1000, 1001, 2500][k]))

    def page(self, folder, after, most):
        self.note(f"page {folder}")
        time.sleep(0.01)
        return [(n, int(n[:5])) for n in self.names(folder) if after is None or n > after][:most]

    def read(self, folder, name):
        time.sleep(0.001)
        if name.startswith("00008"):
            raise TimeoutError("slow")
        return f"{folder}/{name}".encode()
'''


@pytest.fixture
def slow(spark, tmp_path):
    (tmp_path / "slow_store.py").write_text(SLOW)
    spark.sparkContext.addPyFile(str(tmp_path / "slow_store.py"))
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def asked(log, what):
    return [p.read_text().split(" ", 1) for p in log.iterdir() if p.read_text().split(" ", 1)[1].startswith(what)]


def names(folder):
    return [f"{i:05d}{('.jpg', '.PNG', '.png', '.txt')[i % 4]}" for i in range([0, 3, 1000, 1001, 2500][folder])]


def test_a_slow_store(spark, slow):
    rows = objects.listed(spark, str(slow), store="slow_store:Slow")
    want = sorted((f"f{k}", n, f"{slow}/f{k}/{n}", int(n[:5])) for k in range(5) for n in names(k) if n.endswith((".jpg", ".png")))
    assert sorted(map(tuple, rows.collect())) == want
    assert len(asked(slow, "page")) == 1 + 1 + 2 + 2 + 3
    assert not {p for p, _ in asked(slow, "folders")} & {p for p, _ in asked(slow, "page")}  # names are asked for by tasks
    found = objects.with_contents(rows.where("folder = 'f3'"), str(slow), tasks=4, store="slow_store:Slow").withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in found}) == 4
    assert {(r.name, bytes(r.content)) for r in found if r.error is None} == {(n, f"f3/{n}".encode()) for n in names(3) if n.endswith((".jpg", ".png")) and not n.startswith("00008")}
    assert [(r.name, r.content, r.error) for r in found if r.error] == [("00008.jpg", None, "slow")]


def test_a_cap_asks_for_no_more_pages(spark, slow):
    rows = objects.listed(spark, str(slow), ("f4", "f1"), (".jpg",), most=7, store="slow_store:Slow")
    assert sorted((r.folder, r.name) for r in rows.collect()) == [("f1", "00000.jpg"), *(("f4", f"{4 * i:05d}.jpg") for i in range(7))]
    assert len(asked(slow, "page")) == 2 and not asked(slow, "folders")
    assert objects.listed(spark, str(slow), ("f0",), store="slow_store:Slow").count() == 0
    assert objects.listed(spark, str(slow), ("f4",), most=0, store="slow_store:Slow").count() == 0


def test_a_shared_folder(spark, tmp_path):
    for folder, name in (("a", "x.jpg"), ("a", "y.txt"), ("b", "z.png"), ("b", "w.jpeg")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(name.encode())
    rows = objects.with_contents(objects.listed(spark, f"file://{tmp_path}"), f"file://{tmp_path}", 2)
    assert sorted((r.folder, r.name, bytes(r.content), r.length) for r in rows.collect()) == [("a", "x.jpg", b"x.jpg", 5), ("b", "w.jpeg", b"w.jpeg", 6), ("b", "z.png", b"z.png", 5)]


def engines():
    def words():
        return lambda image: [([[0.0, 0.0], [float(n), 1.0]], w, 0.5) for n, w in enumerate(image.decode().split(" "))]

    def whole():
        def read(image):
            if image == b"broken":
                raise OSError("not an image")
            return [([[0.0, 0.0]], image.decode(), 1.0)]

        return read

    return {"words": words, "whole": whole}


def test_engines_from_sql(spark):
    register_engines(spark, engines())
    rows = [(1, "a", b"one  two"), (2, None, b"broken"), (3, "c", None), (4, "d", b""), (5, "e", " ".encode())]
    spark.createDataFrame(rows, "id int, path string, content binary").repartition(3).createOrReplaceTempView("some_files")
    got = spark.sql("SELECT id, path, line_no, poly, text, conf, error FROM recognise(TABLE(some_files), engine => 'words')").collect()
    assert sorted(map(tuple, got)) == [(1, "a", 0, [[0.0, 0.0], [0.0, 1.0]], "one", 0.5, None), (1, "a", 2, [[0.0, 0.0], [2.0, 1.0]], "two", 0.5, None), (2, None, 0, [[0.0, 0.0], [0.0, 1.0]], "broken", 0.5, None)]
    got = spark.sql("SELECT id, text, error FROM recognise(TABLE(SELECT * FROM some_files WHERE id < 4), engine => 'whole')").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "one  two", None), (2, None, "not an image")]


@pytest.mark.parametrize("statement", ["SELECT * FROM recognise(TABLE(SELECT 1 AS id, X'00' AS content), engine => 'none')", "SELECT * FROM recognise(TABLE(SELECT 1 AS id), engine => 'whole')", "SELECT * FROM recognise(TABLE(SELECT 1 AS text, X'00' AS content), engine => 'whole')"])
def test_wrong_calls_are_found_by_the_analysis(spark, statement):
    register_engines(spark, engines())
    with pytest.raises(Exception, match="no engine|a column content|columns that the table has"):
        spark.sql(statement)
