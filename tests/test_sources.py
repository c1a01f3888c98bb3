from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.annotations import exploded_results, labelled_regions
from ledgerloom.sources import files, sinks
from ledgerloom.streaming import ingest


def test_images_and_lists(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        for name in ("x.jpg", "y.PNG", "z.txt"):
            (tmp_path / folder / name).write_bytes(b"1")
    rows = files.images(spark, [f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/a"])
    assert sorted((r["name"], r["folder_no"]) for r in rows.collect()) == [("x.jpg", 0), ("x.jpg", 1), ("y.PNG", 0), ("y.PNG", 1)]
    (tmp_path / "list.txt").write_text("one\n\n two \n")
    assert sorted(r[0] for r in files.list_file(spark, f"{tmp_path}/list.txt").collect()) == ["one", "two"]
    assert files.object_listing(spark, str(tmp_path), [".jpg"], 1).count() == 1
    read = lambda: lambda content: [([[0.0, 0.0]], "text", 0.5), ([[0.0, 0.0]], " ", 0.1)]
    assert files.recognised(files.images(spark, [f"{tmp_path}/a"], content=True), read).count() == 2


def test_labels_and_metadata(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    label = {"file_name": "a.png", "image_width": 10, "image_height": 20, "annotations": [{"label": "SELLER", "text": "x", "box": [1, 2, 3, 4]}]}
    (tmp_path / "labels/a.json").write_text(json.dumps(label))
    (tmp_path / "labels/broken.json").write_text("{")
    (tmp_path / "labels/metadata.json").write_text(json.dumps([{"id": 1}]))
    rows = files.label_files(spark, f"{tmp_path}/labels")
    assert [r["file_name"] for r in rows.collect()] == ["a.png"]
    (tmp_path / "meta.json").write_text(json.dumps([{"id": 1, "label_path": "labels/a.json"}, {"id": 2, "label_path": "labels/none.json"}]))
    joined = files.labelled_metadata(files.metadata(spark, f"{tmp_path}/meta.json"), rows, f"{tmp_path}/")
    assert [(r["id"], r["image_width"]) for r in joined.collect()] == [(1, 10)]


def test_csv_and_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text('img_id;anno_texts\n1;"[""a"", ""b""]"\n')
    row = files.sniffed_csv(spark, f"{tmp_path}/a.csv").first()
    assert (row["image"], row["annotation"]) == ("1", '["a", "b"]')
    task = {"id": 7, "data": {"image": "x.jpg"}, "annotations": [{"result": [
        {"id": "r", "type": "rectanglelabels", "value": {"x": 1, "y": 2, "width": 3, "height": 4, "rectanglelabels": ["SELLER"]}},
        {"id": "r", "type": "textarea", "value": {"text": ["shop"]}}]}, {"result": []}]}
    (tmp_path / "export.json").write_text(json.dumps([task, {"id": 8, "data": {"image": "y.jpg"}}]))
    tasks = files.annotation_export(spark, f"{tmp_path}/export.json")
    assert tasks.count() == 2
    assert [tuple(r) for r in labelled_regions(exploded_results(tasks)).collect()] == [(7, "r", 0, "SELLER", "shop")]
    (tmp_path / "ocr.json").write_text(json.dumps({"p.jpg": [[[[0, 0], [1, 1]], ["hi", 0.5]]]}))
    assert tuple(files.ocr_cache_json(spark, f"{tmp_path}/ocr.json").first()) == ("p.jpg", 0, [[0.0, 0.0], [1.0, 1.0]], "hi", 0.5)


def test_page_fields(spark):
    html = '<div><span class="x kie-field" data-label="store_name"><b>My</b>\n Shop</span><p class="kie-field" data-label="date"> </p></div>'
    rows = files.page_fields(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r["label"], r["text"]) for r in rows] == [("store_name", "My Shop")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", 1.5, "a"), ("val", None, "b|")], "split string, v double, t string")
    sinks.json_splits(df, f"{tmp_path}/j")
    sinks.csv_table(df, f"{tmp_path}/c")
    sinks.text_lists(df, f"{tmp_path}/t", "split", "t")
    sinks.json_records(df, f"{tmp_path}/r")
    sinks.appended(df, f"{tmp_path}/p")
    sinks.appended(df, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    assert "| val |  | b\\| |" in sinks.markdown_report(df, "T")


def test_streams(spark, tmp_path):
    (tmp_path / "in/cafe").mkdir(parents=True)
    (tmp_path / "in/cafe/a.jpg").write_bytes(b"1")
    stream = ingest.once_each(ingest.uploads(spark, f"{tmp_path}/in"), ["name"])

    def run():
        ingest.into_table(stream, f"{tmp_path}/out", f"{tmp_path}/state", lambda d: d.select("name", "template", F.length("content").alias("n"))).awaitTermination()
        return sorted((r["name"], r["template"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [("a.jpg", "cafe", 1)]
    (tmp_path / "in/cafe/b.jpg").write_bytes(b"12")
    assert run() == [("a.jpg", "cafe", 1), ("b.jpg", "cafe", 2)]
    assert run() == [("a.jpg", "cafe", 1), ("b.jpg", "cafe", 2)]


def test_a_report_leaves_no_row_out(spark):
    assert sinks.markdown_report(spark.range(5), "t", most=5).count("\n| ") == 7
    with pytest.raises(ValueError):
        sinks.markdown_report(spark.range(6), "t", most=5)


def test_the_delimiter_may_stand_below_the_first_line(spark, tmp_path):
    (tmp_path / "late.csv").write_text("img_id\n1\n2;x\n")
    with pytest.raises(ValueError):
        files.sniffed_csv(spark, f"{tmp_path}/late.csv")  # one column, parted by ";"
    (tmp_path / "far.csv").write_text("img_id,anno_text\n" + "1,a\n" * 600 + "2,b;c\n")  # beyond the first 2048 characters
    assert files.sniffed_csv(spark, f"{tmp_path}/far.csv").count() == 601


def test_located_takes_the_best_placed_file(spark):
    wanted = spark.createDataFrame([("a.jpg",), ("b.jpg",)], "file_name string")
    present = spark.createDataFrame([("x/a.jpg", 2), ("y/a.jpg", 1), ("z/c.jpg", 0)], "path string, priority int")
    assert sorted(map(tuple, files.located(wanted, present).collect()), key=str) == [("a.jpg", "y/a.jpg"), ("b.jpg", None)]


def test_a_combined_set_and_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("train", "é"), ("val", None), ("train", "b")], "split string, t string")
    sinks.json_splits(df, f"{tmp_path}/parts", combined=f"{tmp_path}/all")
    assert sorted(map(str, spark.read.schema("split string, t string").json(f"{tmp_path}/all").collect())) == sorted(map(str, df.collect()))
    sinks.csv_table(df.coalesce(1), f"{tmp_path}/csv", mark=True)
    (file,) = (tmp_path / "csv").glob("*.csv")
    assert file.read_bytes().startswith(b"\xef\xbb\xbfsplit,t\n")
    assert file.read_text(encoding="utf-8-sig").splitlines()[0] == "split,t"


def test_white_space_of_any_kind_is_trimmed(spark, tmp_path):
    from ledgerloom.functions import text as X

    rows = [("\n```json\n{\"k\": 1}\n```\n",), ("\t ```\r\n{\"k\": 2}\n ```",), ("\u00a0{\"k\": 3}\u2003\n",), (" \t\n",), (None,)]
    df = spark.createDataFrame(rows, "a string")
    got = df.select(X.without_fence(F.col("a")).alias("body"), X.parsed_answer(F.col("a"), "struct<k:int>")["k"].alias("k"), X.blank_to_null(F.col("a")).isNull().alias("blank")).collect()
    assert [r.body for r in got] == ['{"k": 1}', '{"k": 2}', '{"k": 3}', "", None]
    assert [r.k for r in got] == [1, 2, 3, None, None] and [r.blank for r in got] == [False, False, False, True, True]
    (tmp_path / "list.txt").write_text("\tone \n \t \ntwo\u00a0\n")
    assert sorted(r[0] for r in files.list_file(spark, f"{tmp_path}/list.txt").collect()) == ["one", "two"]
