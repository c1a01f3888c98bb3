from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import annotations as A
from ledgerloom.operators import evaluate as E
from ledgerloom.operators import invoice as I
from ledgerloom.operators import labels as L
from ledgerloom.operators import plugins as P
from ledgerloom.operators import rules as R
from ledgerloom.operators import sequence as S


def test_line_label(spark):
    rows = [("NGÀY 1", 0), ("12/3", 50), ("Tổng tiền 100", 50), ("Coffee shop", 17.9), ("Coffee shop", 18.0), ("Quận 1", 50), ("x", 1), ("Tổng tiền 1:2", 9)]
    got = [r[0] for r in spark.createDataFrame([(t, float(y)) for t, y in rows], "t string, y double").select(R.line_label(F.col("t"), F.col("y"))).collect()]
    assert got == ["TIMESTAMP", "TIMESTAMP", "TOTAL_COST", "SELLER", "OTHER", "ADDRESS", "OTHER", "TIMESTAMP"]


def test_chains(spark):
    df = spark.createDataFrame([("lotte winmart",), ("go  mall",), ("nothing",)], "t string").withColumn("chain", R.chain_label(F.col("t")))
    assert [r["chain"] for r in df.collect()] == ["VinCommerce / WinMart / VinMart", "Big C / Go!", R.UNMATCHED]
    stats = R.chain_statistics(df).collect()
    assert len(stats) == 17
    assert sum(r["n"] for r in stats) == 3
    assert [r["rule_no"] for r in stats[:3]] == [0, 6, 16]


def test_rule_extraction(spark):
    docs = {
        1: ["Shop", "Đ/C: 5 Lê Lợi", "01/02/2024 10:20", "Tổng tiền 1.000 2.000"],
        2: ["A", "Total", "12.345"],
        3: ["B", "total"],
        4: ["total", "none", "Total 7"],
        5: ["C", "date 01/02/2024"],
    }
    rows = [(d, n, t) for d, lines in docs.items() for n, t in enumerate(lines)]
    got = {r["doc_id"]: r for r in R.extracted_fields(spark.createDataFrame(rows, "doc_id long, line_no int, text string")).collect()}
    assert tuple(got[1]) == (1, "Shop", "5 Lê Lợi", "01/02/2024 10:20", "2.000")
    assert [got[d]["total_cost"] for d in (2, 3, 4, 5)] == ["12.345", None, "7", None]
    assert got[5]["timestamp"] is None


def _tagged(spark, docs):
    rows = [(d, n, f"w{n}", t) for d, tags in docs.items() for n, t in enumerate(tags)]
    return spark.createDataFrame(rows, "doc_id long, word_no long, word string, tag string")


def _random_tags(n_docs):
    rng = random.Random(3)
    tags = ["O", "B-SELLER", "I-SELLER", "B-ADDRESS", "I-ADDRESS", "B-OTHER", "I-OTHER"]
    return {d: [rng.choice(tags) for _ in range(rng.randint(1, 14))] for d in range(n_docs)}


def _lenient(tags):
    out, label, words = {}, None, []
    for n, t in enumerate([*tags, "O"]):
        now = None if t == "O" or t.endswith("-OTHER") else t[2:]
        if label and (now != label or t[0] == "B"):
            out.setdefault(label, []).extend(words)
            words = []
        if now:
            words.append(f"w{n}")
        label = now
    return {k: " ".join(v) for k, v in out.items()}


def _flushing(tags, fields):
    out, label, words = [], None, []
    for n, t in enumerate(tags):
        if t.startswith("B-"):
            if words:
                out.append((label, list(words)))
            if t[2:] in fields:
                label, words = t[2:], [f"w{n}"]
        elif t.startswith("I-") and t[2:] == label:
            words.append(f"w{n}")
        else:
            if words:
                out.append((label, list(words)))
            label, words = None, []
    if words:
        out.append((label, list(words)))
    found = {}
    for k, w in out:
        found.setdefault(k, []).append(" ".join(w))
    return {k: " ".join(v) for k, v in found.items()}


def test_decoders_against_loops(spark):
    docs = _random_tags(60)
    tags = _tagged(spark, docs)
    got = {}
    for r in S.decoded(tags, "B").collect():
        got.setdefault(r["doc_id"], {})[r["label"]] = r["text"]
    assert all(got.get(d, {}) == _lenient(t) for d, t in docs.items())
    got = {}
    for r in S.decoded(tags, "C").collect():
        got.setdefault(r["doc_id"], {})[r["label"]] = r["text"]
    for d, t in docs.items():
        want = _flushing(t, L.FIELDS)
        assert got[d] == {f: want.get(f) for f in L.FIELDS}


def test_decoder_cases(spark):
    docs = {1: ["B-ADDRESS", "I-SELLER", "I-ADDRESS"], 2: ["I-ADDRESS", "O"], 3: ["B-ADDRESS", "B-OTHER", "O"], 4: ["O"]}
    tags = _tagged(spark, docs)
    a = {(r["doc_id"], r["label"]): r["text"] for r in S.decoded(tags, "A").collect()}
    assert a == {(1, "ADDRESS"): "w0 w2", (3, "ADDRESS"): "w0"}
    c = {(r["doc_id"], r["label"]): r["text"] for r in S.decoded(tags, "C4").collect()}
    assert c[3, "ADDRESS"] == "w0 w0"
    assert c[4, "ADDRESS"] is None
    d = {(r["doc_id"], r["label"]): r["text"] for r in S.decoded(tags, "D").collect()}
    assert d[4, "STORE_NAME"] == "" and len(d) == 16
    with pytest.raises(ValueError):
        S.decoded(tags, "Z")


def test_emission_round_trip(spark):
    rows = [(1, n, f"w{n}", lab, k) for n, (lab, k) in enumerate([("SELLER", 0), ("SELLER", 1), ("ADDRESS", 0), ("OTHER", 0), ("SELLER", 0)])]
    df = spark.createDataFrame(rows, "doc_id long, word_no long, word string, label string, k int").withColumn("tag", S.emitted_tag(F.col("label"), F.col("k"))).drop("label")
    spans = sorted((r["label"], r["start"], r["end"]) for r in S.spans_lenient(df).collect())
    assert spans == [("ADDRESS", 2, 2), ("SELLER", 0, 1), ("SELLER", 4, 4)]


def test_votes(spark):
    rows = [(1, 0, "O"), (1, 1, "B-X"), (2, 0, "O"), (2, 1, "O"), (3, 0, "B-Y"), (3, 1, "B-X")]
    df = spark.createDataFrame(rows, "w int, token_no int, label string")
    assert {r["w"]: r["label"] for r in S.first_vote(df, ["w"], skip_outside=True).collect()} == {1: "B-X", 2: "O", 3: "B-Y"}
    assert {r["w"]: r["label"] for r in S.first_vote(df, ["w"]).collect()} == {1: "O", 2: "O", 3: "B-Y"}
    row = spark.createDataFrame([([0.1, 0.9, 0.9], [None, 0, 0, 1], [5, 6])], "s array<double>, w array<int>, l array<int>").select(S.best_class(F.col("s")), S.aligned_labels(F.col("w"), F.col("l"))).first()
    assert tuple(row) == (1, [-100, 5, -100, 6])


def test_reading_order_against_a_loop(spark):
    rng = random.Random(5)
    docs = {d: [(rng.uniform(0, 200), rng.uniform(0, 100), rng.uniform(5, 20)) for _ in range(rng.randint(1, 20))] for d in range(25)}
    rows = [(d, i, f"t{i}", x, y, y + h) for d, boxes in docs.items() for i, (x, y, h) in enumerate(boxes)]
    got = {}
    for r in S.reading_order(spark.createDataFrame(rows, "doc_id long, pos long, text string, x1 double, y1 double, y2 double")).orderBy("doc_id", "line_no", "place").collect():
        got.setdefault(r["doc_id"], []).append((r["line_no"], r["text"]))
    for d, boxes in docs.items():
        near = 0.5 * median(h for _, _, h in boxes)
        items = sorted(((y + y + h) / 2, i, x) for i, (x, y, h) in enumerate(boxes))
        lines = []
        for cy, i, x in items:
            if lines and abs(cy - sum(c for c, _, _ in lines[-1]) / len(lines[-1])) <= near:
                lines[-1].append((cy, i, x))
            else:
                lines.append([(cy, i, x)])
        want = [(n, f"t{i}") for n, line in enumerate(lines) for _, i, _ in sorted(line, key=lambda v: (v[2], v[0], v[1]))]
        assert got[d] == want


def test_region_join(spark):
    rows = [
        (1, "a", 0, "rectanglelabels", "SELLER", None), (1, "a", 1, "textarea", None, "x"), (1, "a", 2, "rectanglelabels", "ADDRESS", None), (1, "a", 3, "textarea", None, "y"),
        (1, "b", 4, "rectanglelabels", "SELLER", None), (1, "c", 5, "textarea", None, "z"),
    ]
    df = spark.createDataFrame(rows, "task_id long, region_id string, place int, type string, label string, text string")
    assert [tuple(r) for r in A.labelled_regions(df).collect()] == [(1, "a", 0, "ADDRESS", "y")]


def test_resume_and_paths(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "f string")
    done = spark.createDataFrame([("a", None), ("b", "x")], "f string, error string")
    assert sorted(r["f"] for r in A.remaining(items, done, ["f"]).collect()) == ["b", "c"]
    files = spark.createDataFrame([("d2/a", 1), ("d1/a", 0), ("d2/?d=x/b", 1)], "path string, dir_no int")
    got = {r["file_name"]: r["path"] for r in A.resolved_paths(items.withColumnRenamed("f", "file_name"), files).collect()}
    assert got == {"a": "d1/a", "b": "d2/?d=x/b", "c": "images/c"}


def test_splits(spark):
    df = spark.createDataFrame([("g", i) for i in range(133)] + [("h", 0)], "g string, i int")
    counts = {(r["g"], r["split"]): r["count"] for r in A.stratified_split(df, ["g"], ["i"]).groupBy("g", "split").count().collect()}
    assert counts == {("g", "train"): 106, ("g", "val"): 27, ("h", "val"): 1}
    dealt = A.round_robin(df.where("g = 'g'"), ["g"], ["i"], ["x", "y", "z"]).groupBy("member").count().collect()
    assert sorted(r["count"] for r in dealt) == [44, 44, 45]
    numbers = A.renumbered([df, df.limit(3)], ["g", "i"]).orderBy("source_rank", "g", "i").select("new_id").collect()
    assert [r["new_id"] for r in numbers] == list(range(1, 138))


def test_predictions_become_annotations(spark):
    df = spark.createDataFrame([(1, [("r",)], None)], "id long, predictions array<struct<result:string>>, annotations string").drop("annotations")
    df = df.withColumn("predictions", F.transform("predictions", lambda p: F.struct(F.array(p["result"]).alias("result"))))
    assert A.predictions_as_annotations(df).first()["annotations"][0]["result"] == ["r"]


def test_scores(spark):
    rows = [("a", "abcde", "abcde"), ("a", "abcde", "vwxyz"), ("a", "x", None), ("a", None, "y"), ("a", " ", ""), ("b", None, None)]
    t = spark.createDataFrame([(k, i, v) for i, (k, v, _) in enumerate(rows)], "field string, doc int, value string")
    p = spark.createDataFrame([(k, i, v) for i, (k, _, v) in enumerate(rows)], "field string, doc int, value string")
    from ledgerloom.functions.text import edit_similarity

    pairs = E.field_pairs(t, p, ["field", "doc"])
    counts = E.confusion(pairs, edit_similarity(F.col("truth"), F.col("predicted")), ["field"])
    got = {r["field"]: (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"], r["f1"]) for r in E.scores(counts).collect()}
    assert got == {"a": (1, 2, 2, 33.33, 33.33, 33.33), "b": (0, 0, 0, 0.0, 0.0, 0.0)}
    assert [r["field"] for r in E.scores(counts, "epsilon").collect()] == ["a"]
    edge = spark.createDataFrame([("f", "abcde", "abcdx")], "field string, truth string, predicted string")
    sim = edit_similarity(F.col("truth"), F.col("predicted"))
    assert E.confusion(edge, sim, ["field"]).first()["tp"] == 1
    assert E.confusion(edge, sim, ["field"], strict=True).first()["tp"] == 0


def test_totals_and_profiles(spark):
    items = spark.createDataFrame([(1, 3, 333, 5, 8), (1, 1, 1, 5, 8), (2, 1, 99, 0, 10)], "inv int, qty int, price long, discount_rate int, vat_rate int")
    got = {r["inv"]: tuple(r)[1:] for r in I.totals(items, ["inv"]).collect()}
    assert got == {1: (1000, 50, 76, 1026), 2: (99, 0, 9, 108)}
    profiles = spark.createDataFrame([("cafe", "C"), ("default", "D")], "template string, store string")
    rows = I.with_profile(spark.createDataFrame([("cafe",), ("else",)], "template string"), profiles).collect()
    assert {r["template"]: r["profile"]["store"] for r in rows} == {"cafe": "C", "else": "D"}
    row = spark.createDataFrame([("Đà Nẵng",), ("Huế",)], "c string").select(F.size(I.districts_of(F.col("c"), ["Quận 1"]))).collect()
    assert [r[0] for r in row] == [4, 1]


def test_labels(spark):
    df = spark.createDataFrame([("Item_Qty_3",), ("seller",), ("phone",), (None,)], "l string")
    assert [r[0] for r in df.select(L.canonical_label(F.col("l"))).collect()] == ["ITEM_QTY", "SELLER", "OTHER", "OTHER"]
    assert [r[0] for r in df.select(L.canonical_label(F.col("l"), "drop")).collect()] == ["ITEM_QTY", "SELLER", None, None]
    tags = spark.createDataFrame([("B-X",), ("O",), (None,)], "t string")
    assert [r[0] for r in tags.select(L.tag_label(F.col("t"))).collect()] == ["X", "O", "OTHER"]
    assert [r[0] for r in tags.select(L.label_id(F.col("t"), ["O", "B-X"])).collect()] == [1, 0, None]
    one = spark.createDataFrame([(5,), (5,)], "v int")
    assert [tuple(r) for r in L.width_histogram(one, "v").collect()] == [(0, 2)]


def test_plugins(spark):
    class First:
        def predict(self, words, boxes):
            return {"SELLER": words[0] if words else None}

    docs = spark.createDataFrame([(1, ["a", "b"], [[0.0], [1.0]]), (2, [], [])], "doc_id long, words array<string>, boxes array<array<double>>")
    assert sorted((r["doc_id"], r["value"]) for r in P.extracted(docs, {"first": First}, "first").collect()) == [(1, "a"), (2, None)]
    assert P.extracted(docs, {}, "first").count() == 0
    rows = P.encoded(docs.withColumnRenamed("doc_id", "id"), lambda: lambda w: [1, 2], length=3).orderBy("id").collect()
    assert (rows[0]["token_ids"], rows[0]["word_ids"]) == ([1, 2, 1], [0, 0, 1])


def test_images_that_fail_stay_as_they_were(spark):
    def make():
        def change(content):
            if content == b"bad":
                raise ValueError("no image")
            return content[::-1]

        return change

    files = spark.createDataFrame([("a", b"abc", 3), ("b", b"bad", 3), ("c", None, 0), ("d", b"", 0)], "path string, content binary, length long")
    got = {r["path"]: (None if r["content"] is None else bytes(r["content"]), r["length"]) for r in P.transformed_images(files, make).collect()}
    assert got == {"a": (b"cba", 3), "b": (b"bad", 3), "c": (None, 0), "d": (b"", 0)}
    assert P.transformed_images(files.limit(0), make).count() == 0


def test_a_pick_hangs_on_the_keys_alone(spark):
    df = spark.range(4000).select("id", F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("v"))
    one = {r["id"]: r["p"] for r in df.select("id", I.pick(F.col("v"), F.col("id")).alias("p")).collect()}
    two = {r["id"]: r["p"] for r in df.repartition(5).select("id", I.pick(F.col("v"), F.col("id")).alias("p")).collect()}
    assert one == two
    assert all(1200 < list(one.values()).count(name) < 1470 for name in "xyz")
    other = {r["id"]: r["p"] for r in df.select("id", I.pick(F.col("v"), F.col("id"), F.lit("city")).alias("p")).collect()}
    assert sum(one[k] != other[k] for k in one) > 2000
    assert spark.range(1).select(I.pick(F.array(F.lit("only")), F.lit(None).cast("int")).alias("p")).first()["p"] == "only"


def test_a_shuffled_order_is_fixed_and_whole(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    first, again, other = ([r["doc_id"] for r in A.shuffled(rows, "doc_id", seed=s).collect()] for rows, s in ((df, 42), (df.repartition(9), 42), (df, 1)))
    assert first == again and sorted(first) == list(range(500))
    assert first != sorted(first) and first != other


def test_places_in_groups_are_counted_by_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(300) if rng.random() < 0.95 else None, k) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, v long, k long")
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (n + 1, len(own)) for n, r in enumerate(own)}
    got = {r["k"]: (r["__place"], r["__size"]) for r in A._placed(df, ["g"], ["v", "k"]).collect()}
    assert got == want
    texts = df.withColumn("v", F.col("v").cast("string"))
    assert A._placed(texts, ["g"], ["v", "k"]).where("__place = 1").count() == 3


def test_score_tables_are_ordered(spark):
    df = spark.createDataFrame([("m2", "d1", 50.0), ("m1", "d1", 40.0), ("m1", "d0", 1.0)], "model string, dataset string, f1 double")
    assert [r[0] + r[1] for r in E.score_table(df).collect()] == ["m1d0", "m1d1", "m2d1"]
    assert [r[0] + r[1] for r in E.score_table(df, by="f1").collect()] == ["m1d0", "m2d1", "m1d1"]
