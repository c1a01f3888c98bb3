"""Boxes, polygons and word splits as Column expressions. A box is array<double> [x1, y1, x2, y2] unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bound, words


# Fixed value: how far a fold reaches, as a share of the page.
FOLD_REACH = 0.08


def _whole(c: Column) -> Column:
    """Cut towards zero."""
    return c.cast("long")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def box_of(polygon: Column) -> Column:
    """The upright box around array<array<double>> points."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def normalized(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, clamped: bool = True) -> Column:
    """The box on a page of 1000 by 1000, cut to whole numbers; clamped to the page unless told otherwise."""
    scaled = [_whole(F.lit(1000) * (v / size)) for v, size in ((x1, width), (y1, height), (x2, width), (y2, height))]
    return F.array(*(clamp(v, 0, 1000).cast("long") if clamped else v for v in scaled))


def denormalized(box: Column, width: Column, height: Column) -> Column:
    return F.array(*(_whole(width * (box[k] / 1000) if k % 2 == 0 else height * (box[k] / 1000)) for k in range(4)))


def normalized_polygon(polygon: Column, width: Column, height: Column) -> Column:
    """Eight whole numbers; the product is taken first."""
    return F.flatten(F.transform(polygon, lambda p: F.array(_whole(p[0] * 1000 / width), _whole(p[1] * 1000 / height))))


def percent_box_clamped_first(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """[x, y, w, h] in percent; the corners are brought into the page before dividing."""
    zero = F.lit(0.0)
    a, c = (F.greatest(zero, F.least(width, v)) for v in (x1, x2))
    b, d = (F.greatest(zero, F.least(height, v)) for v in (y1, y2))
    return F.array(a / width * 100, b / height * 100, (c - a) / width * 100, (d - b) / height * 100)


def percent_box_clamped_last(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, digits: int = 4) -> Column:
    """[x, y, w, h] in percent; divided, brought into 0-100, w and h cut at the page's edge, rounded half to even."""
    x, y = clamp(x1 / width * 100, 0.0, 100.0), clamp(y1 / height * 100, 0.0, 100.0)
    w = F.greatest(F.lit(0.0), F.least((x2 - x1) / width * 100, F.lit(100.0) - x))
    h = F.greatest(F.lit(0.0), F.least((y2 - y1) / height * 100, F.lit(100.0) - y))
    return F.array(*(F.bround(v, digits) for v in (x, y, w, h)))


def ordered_points(points: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left, by their sums and differences; the first of equals."""
    keyed = lambda sign, f: F.array_min(F.transform(points, lambda p, i: F.struct((f(p) * sign).alias("k"), i.alias("i"), p.alias("p"))))["p"]
    total, across = (lambda p: p[0] + p[1]), (lambda p: p[1] - p[0])
    return F.array(keyed(1, total), keyed(1, across), keyed(-1, total), keyed(-1, across))


def warp_size(points: Column) -> Column:
    """(width, height) of the upright picture of four ordered points: the longer of each two facing edges."""
    edge = lambda a, b: F.sqrt(F.pow(points[a][0] - points[b][0], 2) + F.pow(points[a][1] - points[b][1], 2))
    longer = lambda a, b, c, d: F.greatest(_whole(edge(a, b)), _whole(edge(c, d)))
    return F.struct(longer(2, 3, 1, 0).alias("width"), longer(1, 2, 0, 3).alias("height"))


def split_words(text: Column, x1: Column, y1: Column, x2: Column, y2: Column, policy: str = "proportional") -> Column:
    """array<struct<word, box>>: a line's words, each with a share of the line's box.

    "proportional": width by letters, and a gap of 2 % of the line after each
    word, so the last may pass the edge. "equal": equal widths, whole numbers.
    "per_char": width by characters with blanks counted, whole numbers.
    """
    if policy not in ("proportional", "equal", "per_char"):
        raise ValueError(f"unknown policy {policy}")
    width = x2 - x1

    def share_of(w: Column, ends: Column) -> Column:
        """The width of a letter, a word or a character; for once a line, as a text's length takes a walk through it."""
        parts = {"proportional": lambda: F.get(ends, F.size(w)), "equal": lambda: F.size(w), "per_char": lambda: F.length(text)}[policy]()
        return width / F.greatest(F.lit(1), parts)

    def placed(w: Column, ends: Column, share: Column) -> Column:
        """w: the words; ends: letters up to and with each word, led by 0."""
        before = lambda i: F.get(ends, i)
        if policy == "proportional":
            left = lambda i: x1 + before(i) * share + i * (width * 0.02)
            box = lambda t, i: F.array(left(i), y1, left(i) + F.length(t) * share, y2)
        elif policy == "equal":
            box = lambda t, i: F.array(_whole(x1 + i * share), y1, _whole(x1 + (i + 1) * share), y2)
        else:
            left = lambda i: x1 + (before(i) + i) * share
            box = lambda t, i: F.array(_whole(left(i)), _whole(y1), _whole(left(i) + F.length(t) * share), _whole(y2))
        return F.transform(w, lambda t, i: F.struct(t.alias("word"), box(t, i).alias("box")))

    parts = words(text)
    if policy == "equal":
        return bound(parts, lambda w: bound(share_of(w, w), lambda share: placed(w, w, share)))
    ends = _running(F.transform(parts, F.length))
    return bound(F.struct(parts.alias("w"), ends.alias("e")), lambda both: bound(share_of(both["w"], both["e"]), lambda share: placed(both["w"], both["e"], share)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _running(lengths: pd.Series) -> pd.Series:
    """Sums of each list's first numbers, of none of them first: Spark has no running sum over a list but by copying it at each step."""
    return lengths.map(lambda x: np.concatenate([[0], np.cumsum(x)]).astype(np.int32), na_action="ignore")


def padded(box: Column, pad: int, width: Column, height: Column) -> Column:
    """A crop rectangle widened by `pad` and cut at the page's edges."""
    zero = F.lit(0.0)
    return F.array(F.greatest(zero, box[0] - pad), F.greatest(zero, box[1] - pad), F.least(width, box[2] + pad), F.least(height, box[3] + pad))


def vertical_percent(y: Column, height: Column) -> Column:
    return y / height * 100


def centre_and_height(box: Column) -> Column:
    return F.struct(((box[0] + box[2]) / 2).alias("cx"), ((box[1] + box[3]) / 2).alias("cy"), (box[3] - box[1]).alias("height"))


def corners(box: Column) -> Column:
    return F.array(F.array(box[0], box[1]), F.array(box[2], box[1]), F.array(box[2], box[3]), F.array(box[0], box[3]))


def _on_page(points: Column, width: Column, height: Column) -> Column:
    box = box_of(points)
    low, zero = F.lit(1), F.lit(0)
    return F.array(F.greatest(zero, _whole(box[0])), F.greatest(zero, _whole(box[1])), F.least(width - low, _whole(box[2])), F.least(height - low, _whole(box[3])))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solved(points: pd.Series) -> pd.Series:
    """The projections of a batch, from eight points' coordinates each: one system of 8 equations a row, all solved at once."""
    whole = points.map(lambda p: p is not None and len(p) == 16 and bool(np.isfinite(p).all())).to_numpy(bool)
    out = np.full(len(points), None, object)
    if whole.any():
        both = np.stack(points[whole].to_numpy()).astype(float).reshape(-1, 2, 4, 2)
        a, b, c = (both[:, :, list(k)] for k in ((0, 1, 2, 3), (1, 2, 3, 0), (2, 3, 0, 1)))
        turn = (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (c[..., 0] - a[..., 0]) * (b[..., 1] - a[..., 1])
        x, y, u, v = both[:, 0, :, 0], both[:, 0, :, 1], both[:, 1, :, 0], both[:, 1, :, 1]
        one, none = np.ones_like(x), np.zeros_like(x)
        rows = np.concatenate([np.stack([x, y, one, none, none, none, -u * x, -u * y], -1), np.stack([none, none, none, x, y, one, -v * x, -v * y], -1)], 1)
        good = (turn != 0).all((1, 2))
        good[good] = np.linalg.det(rows[good]) != 0
        found = np.linalg.solve(rows[good], np.concatenate([u, v], 1)[good][..., None])[..., 0]
        for at, m in zip(np.flatnonzero(whole)[good], found, strict=True):
            out[at] = np.append(m, 1.0)
    return pd.Series(out)


def homography(source: Column, target: Column) -> Column:
    """The projection (nine numbers row by row, the last 1) that takes four points to four others, worked out for each row.

    Points are arrays [x, y], in the same order around both quads, as
    ordered_points gives them. Null where three points of a quad are in line, or
    where a point is null or missing. Make it a column of its own before a lambda
    uses it.
    """
    flat = lambda quad: F.transform(F.flatten(quad), lambda v: v.cast("double"))
    return _solved(F.concat(flat(source), flat(target)))


def page_quad(width: Column, height: Column) -> Column:
    """The corners of a page's outermost pixels."""
    zero, right, low = F.lit(0.0), (width - 1).cast("double"), (height - 1).cast("double")
    return F.array(F.array(zero, zero), F.array(right, zero), F.array(right, low), F.array(zero, low))


def warp_matrix(points: Column) -> Column:
    """The projection that makes a page's four corners, in any order, an upright page of warp_size."""
    found = ordered_points(points)
    size = warp_size(found)
    return homography(found, page_quad(size["width"], size["height"]))


def projected(point: Column, m: Column) -> Column:
    """A point under a projection of nine numbers; null where it is moved beyond all bounds."""
    across = lambda r: point[0] * m[3 * r] + point[1] * m[3 * r + 1] + m[3 * r + 2]
    return F.array(F.try_divide(across(0), across(2)), F.try_divide(across(1), across(2)))


def perspective_box(box: Column, m: Column | list[list[float]], width: Column, height: Column) -> Column:
    """The upright whole-number box around a box's corners under a projection, cut at the page.

    m: a column of nine numbers, so each row may have its own, or one matrix of
    three rows for all. Null under a null projection.
    """
    if not isinstance(m, Column):
        m = F.array(*(F.lit(float(v)) for row in m for v in row))
    points = [projected(F.array(box[i], box[j]), m) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    low, zero = F.lit(1), F.lit(0)
    first = [F.greatest(zero, _whole(F.least(*v))) for v in (xs, ys)]
    last = [F.least(size - low, _whole(F.greatest(*v))) for size, v in ((width, xs), (height, ys))]
    return F.when(m.isNotNull(), F.array(*first, *last))


def folded_box(box: Column, folds: list[tuple[bool, float, float, float]], width: Column, height: Column) -> Column:
    """A box after folds of (horizontal?, position, amplitude, frequency); a box left too small keeps its old place."""

    def moved(p: Column) -> Column:
        x, y = p[0], p[1]
        for horizontal, at, amplitude, frequency in folds:
            along, size, across = (p[0], width, p[1]) if horizontal else (p[1], height, p[0])
            sigma = (height if horizontal else width) * FOLD_REACH
            shift = F.lit(amplitude) * F.sin(F.lit(2 * 3.141592653589793 * frequency) * along / size) * F.exp(-F.abs(across - F.lit(at)) / sigma)
            x, y = (x, y + shift) if horizontal else (x + shift, y)
        return F.array(x, y)

    new = _on_page(F.transform(corners(box), moved), width, height)
    return F.when(large_enough(new), new).otherwise(F.transform(box, lambda v: v.cast("long")))


def large_enough(box: Column, least: int = 2) -> Column:
    return (box[2] - box[0] > least) & (box[3] - box[1] > least)


def folded_angle(degrees: Column) -> Column:
    """A line's angle brought within 45 degrees of level."""
    turned = F.pmod(degrees, F.lit(90.0))
    return F.when(turned > 45, turned - 90).otherwise(turned)


def area(box: Column) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def largest_boxes(boxes: Column, most: int = 1) -> Column:
    """The boxes of the largest area, largest first; the earlier of equals first."""
    keyed = F.transform(boxes, lambda b, i: F.struct((-area(b)).alias("k"), i.alias("i"), b.alias("b")))
    return F.transform(F.slice(F.array_sort(keyed), 1, most), lambda x: x["b"])


def word_rows(words: Column, boxes: Column, tags: Column) -> Column:
    """array<struct<words, boxes, tags>> of a row's parallel arrays; where one is shorter its values are null."""
    return F.arrays_zip(words.alias("words"), boxes.alias("boxes"), tags.alias("tags"))
