from __future__ import annotations

import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import geometry as G
from ledgerloom.functions import money as M
from ledgerloom.functions import text as X
from ledgerloom.functions.register import register


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_number_words(spark):
    golden = {
        0: "không đồng", 5: "Năm đồng", 10: "Mười đồng", 11: "Mười một đồng", 15: "Mười lăm đồng", 21: "Hai mươi mốt đồng", 25: "Hai mươi lăm đồng", 101: "Một trăm lẻ một đồng",
        105: "Một trăm lẻ năm đồng", 1000: "Một nghìn đồng", 1005: "Một nghìn không trăm lẻ năm đồng".replace("không trăm", " trăm"), 1000000: "Một triệu đồng", 10**12: None, -1: None, None: None,
    }
    got = values(spark, [(k,) for k in golden], "n long", M.number_words(F.col("n")))
    assert dict(zip(golden, got, strict=True)) == golden


def test_currency_cash_dates(spark):
    rows = [(1234567, "receipt_c45_bb"), (1234567, "supermarket_lotte"), (1234567, "cafe")]
    assert values(spark, rows, "a long, l string", M.currency_text(F.col("a"), F.col("l"))) == ["1.234.567", "1,234,567.00", "1,234,567"]
    rows = [(12345, M.CASH, "cafe"), (20000, M.CASH, "cafe"), (12345, "Ví MoMo", "cafe"), (12345, M.CASH, "pos_slip")]
    assert values(spark, rows, "t long, p string, l string", M.cash_received(F.col("t"), F.col("p"), F.col("l"))) == [20000, 20000, 12345, 12345]
    import datetime as d

    rows = [(d.datetime(2024, 3, 5, 7, 8, 9), x) for x in ("supermarket_lotte", "receipt_c45_bb", "cafe")]
    assert values(spark, rows, "t timestamp, l string", M.receipt_date(F.col("t"), F.col("l"))) == ["05/03/2024 07:08:09", "Ngày 05 tháng 03 năm 2024", "05/03/2024 07:08"]


def test_tokens(spark):
    texts = ["1.234.567", "120000", "no number", "a 12 b 3,400", None]
    assert values(spark, [(t,) for t in texts], "t string", X.last_money(F.col("t"))) == ["1.234.567", "000", None, "3,400", None]
    texts = ["on 01/02/2024 10:20:30.", "10:20 01-02-2024", "01/02/2024", None]
    assert values(spark, [(t,) for t in texts], "t string", X.date_token(F.col("t"))) == ["01/02/2024 10:20:30", "10:20 01-02-2024", None, None]
    assert values(spark, [("Đ/C: - số 12A hai-bà",)], "t string", X.address_text(F.col("t"))) == ["Số 12A Hai-Bà"]


def test_paths_and_names(spark):
    paths = ["/data/local-files/?d=C:/Users/x/abc.jpg", "images/abc.jpg", "abc.jpg", "C:\\a\\b.jpg", None]
    assert values(spark, [(p,) for p in paths], "t string", X.path_name(F.col("t"))) == ["abc.jpg", "abc.jpg", "abc.jpg", "b.jpg", None]
    names = [("Big C / Go!",), ("7-Eleven",), ("Bách Hóa Xanh",), ("Saigon Co.op (Co.opmart / Co.op Food)",)]
    assert values(spark, names, "t string", X.slug(F.col("t"))) == ["big_c_go!", "7-eleven", "bách_hóa_xanh", "saigon_coop_coopmart_coop_food"]


def test_lists_and_answers(spark):
    texts = ['["a", "b c"]', "['a', 'b']", "[a, 'b', ]", "plain", "", None]
    assert values(spark, [(t,) for t in texts], "t string", X.parsed_list(F.col("t"))) == [["a", "b c"], ["a", "b"], ["a", "b"], ["plain"], [], []]
    texts = ['```json\n{"k": 1}\n```', '{"k": 2}', '{"k": 3}}{', "nothing", None]
    got = values(spark, [(t,) for t in texts], "t string", X.parsed_answer(F.col("t"), "struct<k:int>")["k"])
    assert got == [1, 2, None, None, None]


def test_fuzzy_ratio(spark):
    pairs = [(None, ""), ("", None), ("a", None), ("A b", "ab"), ("tide", "diet"), ("diet", "tide"), ("x" * 250 + "y", "y" + "x" * 250)]
    expected = [1.0, 1.0, 0.0, 1.0, *(difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs[4:])]
    assert values(spark, pairs, "a string, b string", X.fuzzy_ratio(F.col("a"), F.col("b"))) == pytest.approx(expected)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-50, 1200)] * 4, st.integers(1, 1000), st.integers(1, 1000)), min_size=1, max_size=30))
def test_normalized_boxes(spark, rows):
    c = F.col
    df = spark.createDataFrame(rows, "x1 int, y1 int, x2 int, y2 int, w int, h int")
    got = df.select(G.normalized(c("x1"), c("y1"), c("x2"), c("y2"), c("w"), c("h")).alias("b"), G.normalized(c("x1"), c("y1"), c("x2"), c("y2"), c("w"), c("h"), False).alias("r")).collect()
    for (x1, y1, x2, y2, w, h), r in zip(rows, got, strict=True):
        raw = [int(1000 * (x1 / w)), int(1000 * (y1 / h)), int(1000 * (x2 / w)), int(1000 * (y2 / h))]
        assert r["r"] == raw
        assert r["b"] == [max(0, min(1000, v)) for v in raw]


def test_round_trip_error(spark):
    rows = [(x, x + 7, 640, 480) for x in range(0, 400, 13)]
    c = F.col
    df = spark.createDataFrame(rows, "a int, b int, w int, h int").withColumn("n", G.normalized(c("a"), c("a"), c("b"), c("b"), c("w"), c("h")))
    for r in df.withColumn("back", G.denormalized(c("n"), c("w"), c("h"))).collect():
        assert all(abs(x - y) <= 1 for x, y in zip(r["back"], (r["a"], r["a"], r["b"], r["b"]), strict=True))


@pytest.mark.parametrize("policy", ["proportional", "equal", "per_char"])
def test_split_words(spark, policy):
    def expected(text, x1, x2):
        w = text.split()
        out, at = [], x1
        for i, t in enumerate(w):
            if policy == "proportional":
                width = len(t) / max(1, sum(map(len, w))) * (x2 - x1)
                out.append((t, at, at + width))
                at += width + (x2 - x1) * 0.02
            elif policy == "equal":
                share = (x2 - x1) / len(w)
                out.append((t, int(x1 + i * share), int(x1 + (i + 1) * share)))
            else:
                share = (x2 - x1) / max(1, len(text))
                out.append((t, int(at), int(at + len(t) * share)))
                at += len(t) * share + share
        return out

    c = F.col
    rows = [("one two three", 10, 110), ("", 0, 5), ("solo", 3, 10), (" a  bb ", 0, 70)]
    df = spark.createDataFrame(rows, "t string, x1 int, x2 int")
    got = [r[0] for r in df.select(G.split_words(c("t"), c("x1"), F.lit(1), c("x2"), F.lit(9), policy)).collect()]
    for (text, x1, x2), words in zip(rows, got, strict=True):
        want = expected(text, x1, x2)
        assert [w["word"] for w in words] == [t for t, _, _ in want]
        assert [v for w in words for v in (w["box"][0], w["box"][2])] == pytest.approx([v for _, a, b in want for v in (a, b)])


def test_points_and_sizes(spark):
    points = [[[100.0, 10.0], [5.0, 8.0], [3.0, 60.0], [110.0, 70.0]]]
    df = spark.createDataFrame([(p,) for p in points], "p array<array<double>>").withColumn("o", G.ordered_points(F.col("p")))
    row = df.select("o", G.warp_size(F.col("o")).alias("s"), G.box_of(F.col("p")).alias("b")).first()
    assert row["o"] == [[5.0, 8.0], [100.0, 10.0], [110.0, 70.0], [3.0, 60.0]]
    assert row["b"] == [3.0, 8.0, 110.0, 70.0]
    assert (row["s"]["width"], row["s"]["height"]) == (107, 60)


def test_percent_boxes_differ_left_of_the_page(spark):
    df = spark.createDataFrame([(-10.0, 0.0, 40.0, 20.0, 100.0, 50.0)], "x1 double, y1 double, x2 double, y2 double, w double, h double")
    args = [F.col(c) for c in ("x1", "y1", "x2", "y2", "w", "h")]
    row = df.select(G.percent_box_clamped_first(*args).alias("a"), G.percent_box_clamped_last(*args).alias("b")).first()
    assert row["a"] == pytest.approx([0, 0, 40, 40])
    assert row["b"] == pytest.approx([0, 0, 50, 40])


def test_moved_boxes(spark):
    df = spark.createDataFrame([([10.0, 20.0, 60.0, 40.0],), ([0.0, 0.0, 2.0, 2.0],)], "b array<double>")
    same = [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    got = [r[0] for r in df.select(G.perspective_box(F.col("b"), same, F.lit(50), F.lit(100))).collect()]
    assert [[int(v) for v in b] for b in got] == [[10, 20, 49, 40], [0, 0, 2, 2]]
    assert [r[0] for r in df.select(G.large_enough(F.col("b"))).collect()] == [True, False]
    folded = [r[0] for r in df.select(G.folded_box(F.col("b"), [(True, 30.0, 5.0, 1.0)], F.lit(200.0), F.lit(100.0))).collect()]
    assert [int(v) for v in folded[1]] == [0, 0, 2, 2]


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT last_money('a 1.000') m, canonical_label('item_qty_4') l, normalized_coordinate(50D, 100D) n, file_name_of('a/b.jpg') f, python_title('xin chào') t, sequence_ratio('ab', 'ab') r, blank_to_null(' ') b, date_token('01/02/2024 10:20') d").first()
    assert tuple(row) == ("1.000", "ITEM_QTY", 500, "b.jpg", "Xin Chào", 1.0, None, "01/02/2024 10:20")


def test_templates_maps_and_areas(spark):
    df = spark.createDataFrame([("{{ shop }}: {{total}} {{ other }}", "A$1\\", None)], "t string, s string, n string")
    assert df.select(X.rendered(F.col("t"), {"shop": F.col("s"), "total": F.col("n")})).first()[0] == "A$1\\:  {{ other }}"
    df = spark.createDataFrame([({"b/x.jpg": 2, "a/x.jpg": 1},)], "m map<string,int>")
    assert tuple(df.select(X.value_by_part(F.col("m"), F.lit("x.jpg")), X.value_by_part(F.col("m"), F.lit("q"))).first()) == (1, None)
    df = spark.createDataFrame([([[0.0, 0.0, 1.0, 1.0], [0.0, 0.0, 3.0, 1.0], [1.0, 1.0, 4.0, 2.0]],)], "b array<array<double>>")
    assert df.select(G.largest_boxes(F.col("b"), 2)).first()[0] == [[0.0, 0.0, 3.0, 1.0], [1.0, 1.0, 4.0, 2.0]]
    assert len(df.select(G.word_rows(F.array(F.lit("w")), F.col("b"), F.array(F.lit("O")))).first()[0]) == 3


def test_lists_of_blank_pieces(spark):
    texts = ["", "  ", "[a, '', \"q\"]", "[x,  , y", "[x,  , y]"]
    assert values(spark, [(t,) for t in texts], "t string", X.parsed_list(F.col("t"))) == [[], [""], ["a", "", "q"], ["[x,  , y"], ["x", "y"]]
