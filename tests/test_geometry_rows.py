"""Projections worked out row by row against 8 by 8 solves, and reading order against a plain loop."""

from __future__ import annotations

import random
import statistics
import time

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.functions import geometry as G
from ledgerloom.operators.sequence import reading_order


def solved(source, target):
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0]


def quad(rng, size):
    spread = lambda: rng.uniform(0, 0.3) * size
    return [[spread(), spread()], [size - spread(), spread()], [size - spread(), size - spread()], [spread(), size - spread()]]


def test_homographies(spark):
    rng = random.Random(2)
    rows = [(k, quad(rng, 500), quad(rng, 800), [rng.uniform(0, 500) for _ in range(2)]) for k in range(200)]
    line = [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [5.0, 0.0]]
    odd = [(900, line, rows[0][2], [1.0, 1.0]), (901, rows[0][1], line, [1.0, 1.0]), (902, None, rows[0][2], [1.0, 1.0]), (903, rows[0][1], [[1.0, None], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]], [1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "k int, a array<array<double>>, b array<array<double>>, p array<double>")
    df, m = df.withColumn("m", G.homography(F.col("a"), F.col("b"))), F.col("m")
    got = {r.k: r for r in df.select("k", "m", G.projected(F.col("p"), m).alias("q"), F.transform("a", lambda p: G.projected(p, m)).alias("corners")).collect()}
    for k, a, b, p in rows:
        want = solved(a, b)
        assert np.allclose(got[k].m, want, rtol=1e-6, atol=1e-9)
        assert np.allclose(got[k].corners, b)
        x, y, z = np.array(want).reshape(3, 3) @ [*p, 1]
        assert np.allclose(got[k].q, [x / z, y / z])
    assert all(got[k].m is None for k in (900, 901, 902, 903))


def test_boxes_under_their_own_projection(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(100, 900), rng.randint(100, 900), quad(rng, 400), sorted(rng.uniform(0, 90) for _ in range(4))) for k in range(80)]
    df = spark.createDataFrame(rows, "k int, w int, h int, q array<array<double>>, v array<double>")
    box = F.array(F.col("v")[0], F.col("v")[1], F.col("v")[2], F.col("v")[3])
    m = G.homography(G.page_quad(F.col("w"), F.col("h")), F.col("q"))
    got = {r.k: r.b for r in df.select("k", G.perspective_box(box, m, F.col("w"), F.col("h")).alias("b")).collect()}
    for k, w, h, q, v in rows:
        matrix = np.array(solved([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], q)).reshape(3, 3)
        points = np.array([[v[0], v[1], 1], [v[2], v[1], 1], [v[2], v[3], 1], [v[0], v[3], 1]]) @ matrix.T
        points = points[:, :2] / points[:, 2:]
        want = [max(0, int(points[:, 0].min())), max(0, int(points[:, 1].min())), min(w - 1, int(points[:, 0].max())), min(h - 1, int(points[:, 1].max()))]
        assert got[k] == want


def test_a_page_is_made_upright(spark):
    df = spark.createDataFrame([([[410.0, 30.0], [20.0, 10.0], [30.0, 300.0], [400.0, 320.0]],)], "p array<array<double>>")
    df = df.withColumns({"m": G.warp_matrix(F.col("p")), "o": G.ordered_points(F.col("p"))})
    row = df.select(G.warp_size(F.col("o")).alias("s"), F.transform("o", lambda p: G.projected(p, F.col("m"))).alias("c")).first()
    w, h = row.s.width - 1, row.s.height - 1
    assert np.allclose(row.c, [[0, 0], [w, 0], [w, h], [0, h]], atol=1e-6)


def ordered(boxes, share):
    near = statistics.median(y2 - y1 for *_, y1, y2 in boxes) * share
    items = sorted(((y1 + y2) / 2, pos, x1, text) for pos, text, x1, y1, y2 in boxes)
    lines = []
    for cy, pos, x1, text in items:
        if lines and abs(cy - sum(b[1] for b in lines[-1]) / len(lines[-1])) <= near:
            lines[-1].append((x1, cy, pos, text))
        else:
            lines.append([(x1, cy, pos, text)])
    return [(n, place, text, x1, cy) for n, line in enumerate(lines) for place, (x1, cy, _, text) in enumerate(sorted(line))]


def test_reading_order_of_many_documents(spark):
    rng = random.Random(6)
    docs = {k: [(i, rng.choice(["a", None, "b"]), float(rng.randint(0, 9)), y := rng.randint(0, 60), y + rng.randint(4, 12)) for i in range(rng.randint(1, 40))] for k in [None, *range(60)]}
    df = spark.createDataFrame([(k, *b) for k, boxes in docs.items() for b in boxes], "doc_id int, pos int, text string, x1 double, y1 int, y2 int")
    got = reading_order(df.repartition(7)).collect()
    show = lambda rows: sorted(rows, key=str)
    assert show(tuple(r) for r in got) == show((k, *r) for k, boxes in docs.items() for r in ordered(boxes, 0.5))


def test_reading_order_is_linear(spark):
    df = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.lit("x").alias("text"), (F.col("id") % 10).cast("double").alias("x1"), (F.floor(F.col("id") / 10) * 20).alias("y1")).withColumn("y2", F.col("y1") + 10)
    began = time.time()
    row = reading_order(df).agg(F.count("*").alias("n"), F.max("line_no").alias("lines"), F.max("place").alias("places")).first()
    assert tuple(row) == (100_000, 9_999, 9) and time.time() - began < 30


def test_split_words_measures_a_line_once(spark):
    """One line of 40,000 words: a length of the whole line for each word would take 40,000 walks through 280,000 characters."""
    from time import perf_counter

    rows = spark.range(4).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(39_999)), lambda k: F.concat(F.lit("é"), k))).alias("text"))
    rows = rows.withColumns({"x1": F.lit(10), "x2": F.length("text") * 8 + 10, "y1": F.lit(0), "y2": F.lit(16)})
    c = F.col
    for policy in ("per_char", "proportional", "equal"):
        words = G.split_words(c("text"), c("x1"), c("y1"), c("x2"), c("y2"), policy)
        start = perf_counter()
        assert rows.select(F.sum(F.size(words))).first()[0] == 160_000
        found = rows.limit(1).select(F.element_at(words, -1)["box"].alias("b"), "x2").first()
        assert perf_counter() - start < 12
        assert policy == "proportional" or abs(found.b[2] - found.x2) <= 1
