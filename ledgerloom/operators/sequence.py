"""Tag sequences: emission, decoding, votes, and reading order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import bound, stripped

from .labels import FIELDS

# The vocabulary of the reset-on-unknown decoder.
GUIDE_FIELDS = ["STORE_NAME", "ADDRESS", "DATE", "TOTAL_AMOUNT", "ITEM_NAME", "ITEM_PRICE", "ITEM_QTY", "ITEM_TOTAL"]
FORM_FIELDS = ["STORE_NAME", "ADDRESS", "DATE", "TOTAL_AMOUNT"]


def emitted_tag(label: Column, place: Column) -> Column:
    """B- for the first word of an annotation, I- for the others; OTHER words have O."""
    return F.when(label.isNull() | label.isin("OTHER", "O"), "O").when(place == 0, F.concat(F.lit("B-"), label)).otherwise(F.concat(F.lit("I-"), label))


def _label(tag: Column) -> Column:
    return F.when(tag.startswith("B-") | tag.startswith("I-"), F.substr(tag, F.lit(3)))


def spans_lenient(tags: DataFrame, key: str = "doc_id", place: str = "word_no", word: str = "word", tag: str = "tag") -> DataFrame:
    """(key, label, start, end, text): an I- tag without its beginning, or with another label, begins a new entity; OTHER counts as outside."""
    order = Window.partitionBy(key).orderBy(place)
    label = F.when(_label(F.col(tag)) != "OTHER", _label(F.col(tag)))
    rows = tags.withColumn("label", label)
    starts = F.col("label").isNotNull() & (F.col(tag).startswith("B-") | ~F.col("label").eqNullSafe(F.lag("label").over(order)))
    rows = rows.withColumn("__start", starts.cast("int")).withColumn("__span", F.sum("__start").over(order)).where("label IS NOT NULL")
    return _gathered(rows, [key, "__span", "label"], place, word).select(key, "label", "start", "end", "text")


def spans_strict(tags: DataFrame, key: str = "doc_id", place: str = "word_no", word: str = "word", tag: str = "tag") -> DataFrame:
    """(key, label, start, end, text): an entity goes on over I- tags of other labels, whose words it leaves out; an I- tag without a beginning is dropped."""
    order = Window.partitionBy(key).orderBy(place)
    rows = tags.withColumn("__span", F.sum(F.when(F.col(tag).startswith("I-"), 0).otherwise(1)).over(order))
    head = F.first(F.col(tag)).over(Window.partitionBy(key, "__span").orderBy(place))
    rows = rows.withColumn("__head", head).where(F.col("__head").startswith("B-")).withColumn("label", _label(F.col("__head")))
    rows = rows.where(_label(F.col(tag)) == F.col("label")).where("label <> 'OTHER'")
    return _gathered(rows, [key, "__span", "label"], place, word).select(key, "label", "start", "end", "text")


def _gathered(rows: DataFrame, keys: list[str], place: str, word: str) -> DataFrame:
    """Words of a group joined in order, and the first and last place."""
    items = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(word).alias("w"))))
    return rows.groupBy(*keys).agg(F.min(place).alias("start"), F.max(place).alias("end"), F.array_join(F.transform(items, lambda x: x["w"]), " ").alias("text"))


def spans_flushing(tags: DataFrame, key: str = "doc_id", place: str = "word_no", word: str = "word", tag: str = "tag", fields: list[str] = FIELDS) -> DataFrame:
    """(key, position, label, text): entities as a decoder writes them out that keeps one open.

    A beginning of a known field writes the open entity out and opens one; one
    of an unknown field writes the open entity out too, but leaves it open, so it
    is written again by whatever closes it. Any tag that doesn't go on with the
    open entity closes it.
    """
    label, t = F.substr(F.col(tag), F.lit(3)), F.col(tag)
    begins = t.startswith("B-")
    opens = F.coalesce(begins & label.isin(list(fields)), F.lit(False))
    in_text, in_segment = Window.partitionBy(key).orderBy(place), Window.partitionBy(key, "__segment").orderBy(place)
    # from one opening to the next; what stands before the first has no open entity
    rows = tags.withColumns({"__opens": opens, "__again": F.coalesce(begins, F.lit(False)) & ~opens}).withColumn("__segment", F.sum(F.col("__opens").cast("int")).over(in_text)).where("__segment > 0")
    rows = rows.withColumn("label", F.first(label).over(in_segment))
    longer = F.coalesce(t.startswith("I-") & (label == F.col("label")), F.lit(False))
    rows = rows.withColumn("__word", F.col("__opens") | longer)
    closed = F.sum((~F.col("__word") & ~F.col("__again")).cast("int")).over(in_segment)
    rows = rows.withColumns({"__closed": closed, "__n": F.sum(F.col("__word").cast("int")).over(in_segment)}).where("__closed = 0")
    of = lambda where, value: F.array_sort(F.collect_list(F.when(F.col(where), F.struct(F.col(place).alias("p"), value.alias("v")))))
    held = rows.groupBy(key, "__segment", "label").agg(of("__word", F.col(word)).alias("__words"), of("__again", F.col("__n")).alias("__again"))
    words, again = (F.transform(c, lambda x: x["v"]) for c in ("__words", "__again"))
    ends = F.concat(again, F.array(F.size("__words").cast("long")))
    written = held.select(key, "__segment", "label", words.alias("__words"), F.posexplode(ends).alias("__no", "__n"))
    position = F.row_number().over(Window.partitionBy(key).orderBy("__segment", "__no")) - 1
    return written.select(key, position.alias("position"), "label", F.array_join(F.slice("__words", F.lit(1), F.col("__n").cast("int")), " ").alias("text"))


def joined_fields(spans: DataFrame, key: str = "doc_id", order: str = "start") -> DataFrame:
    """(key, label, text): the entities of each field joined in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("p"), F.col("text").alias("t"))))
    return spans.groupBy(key, "label").agg(stripped(F.array_join(F.transform(items, lambda x: x["t"]), " ")).alias("text"))


def decoded(tags: DataFrame, variant: str = "B", key: str = "doc_id", place: str = "word_no", word: str = "word", tag: str = "tag", fields: list[str] | None = None) -> DataFrame:
    """Tags to fields by one of five decoders; all but B and A give a row for each of their fields.

    B: lenient spans. A: strict spans, of the labelling guide's fields. C: the
    flushing fold, null for a field without text; C4: of four fields. D: as A, of
    the form's four fields, "" for a field without text.
    """
    args = (key, place, word, tag)
    if variant == "B":
        return joined_fields(spans_lenient(tags, *args), key)
    if variant in ("A", "D"):
        own = fields or (GUIDE_FIELDS if variant == "A" else FORM_FIELDS)
        out = joined_fields(spans_strict(tags, *args).where(F.col("label").isin(own)), key)
        return out if variant == "A" else _every_field(tags, out, key, own, F.lit(""))
    if variant in ("C", "C4"):
        own = fields or (FIELDS if variant == "C" else FIELDS[:4])
        out = joined_fields(spans_flushing(tags, *args), key, "position")
        return _every_field(tags, out.where(F.col("label").isin(own)), key, own, F.lit(None).cast("string"))
    raise ValueError(f"unknown variant {variant}")


def _every_field(tags: DataFrame, found: DataFrame, key: str, fields: list[str], absent: Column) -> DataFrame:
    grid = tags.select(key).distinct().withColumn("label", F.explode(F.array(*map(F.lit, fields))))
    return grid.join(found, [key, "label"], "left").select(key, "label", F.coalesce(F.nullif("text", F.lit("")), absent).alias("text"))


# --- the same decoders over lists: a text's words and tags in order are one row, and nothing is shuffled or sorted


def _positions(c: Column) -> Column:
    """0, 1, ... of a list that isn't empty."""
    return F.sequence(F.lit(0), F.size(c) - 1)


def _span(label: Column, start: Column, end: Column, words: Column) -> Column:
    return F.struct(label.alias("label"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.array_join(words, " ").alias("text"))


def lenient_list(words: Column, tags: Column, texts: bool = True) -> Column:
    """array<struct<label, start, end, text>>: spans_lenient() of one text whose words and tags are lists of one length, not empty; `texts` false: null for each text."""

    def found(x: Column) -> Column:
        at = lambda i: F.get(x["l"], i)
        starts = lambda i: at(i).isNotNull() & (F.get(x["t"], i).startswith("B-") | ~at(i).eqNullSafe(at(i - 1)))
        heads = F.filter(_positions(x["t"]), starts)
        ends = F.filter(_positions(x["t"]), lambda i: at(i).isNotNull() & (at(i + 1).isNull() | starts(i + 1)))
        return F.transform(F.arrays_zip(heads.alias("s"), ends.alias("e")), lambda p: _span(at(p["s"]), p["s"], p["e"], F.slice(x["w"], p["s"] + 1, p["e"] - p["s"] + 1) if texts else F.lit(None).cast("array<string>")))

    named = lambda t: F.when(_label(t) != "OTHER", _label(t))
    return bound(F.struct(words.alias("w"), tags.alias("t")), lambda x: bound(F.struct(x["w"].alias("w"), x["t"].alias("t"), F.transform(x["t"], named).alias("l")), found))


def _segments(x: Column, begins, use) -> Column:
    """use(first, after) of each stretch of positions from one that begins to before the next, nulls left out."""
    size = F.size(x["t"])
    parts = bound(F.filter(_positions(x["t"]), begins), lambda b: F.transform(b, lambda s, k: F.struct(s.alias("s"), F.coalesce(F.get(b, k + 1), size).alias("e"))))
    return F.filter(F.transform(parts, lambda p: use(p["s"], p["e"])), lambda v: v.isNotNull())


def strict_list(words: Column, tags: Column) -> Column:
    """array<struct<label, start, end, text>>: spans_strict() of one text whose words and tags are lists of one length, not empty."""

    def found(x: Column) -> Column:
        at = lambda i: F.get(x["t"], i)

        def entity(s: Column, e: Column) -> Column:
            places = F.filter(F.sequence(s, e - 1), lambda i: _label(at(i)) == _label(at(s)))
            made = bound(places, lambda own: _span(_label(at(s)), s, F.element_at(own, -1), F.transform(own, lambda i: F.get(x["w"], i))))
            return F.when(at(s).startswith("B-") & (_label(at(s)) != "OTHER"), made)

        return _segments(x, lambda i: ~F.coalesce(at(i).startswith("I-"), F.lit(False)), entity)

    return bound(F.struct(words.alias("w"), tags.alias("t")), found)


def flushing_list(words: Column, tags: Column, fields: list[str] = FIELDS) -> Column:
    """array<struct<label, text>>: spans_flushing() of one text, in the order of their position."""

    def found(x: Column) -> Column:
        at = lambda i: F.get(x["t"], i)
        name = lambda i: F.substr(at(i), F.lit(3))
        begins = lambda i: F.coalesce(at(i).startswith("B-"), F.lit(False))
        opens = lambda i: begins(i) & name(i).isin(list(fields))

        def written(s: Column, e: Column) -> Column:
            goes_on = lambda i: (i == s) | F.coalesce(at(i).startswith("I-") & (name(i) == name(s)), F.lit(False))
            stop = F.coalesce(F.get(F.filter(F.sequence(s, e - 1), lambda i: ~goes_on(i) & ~begins(i)), F.lit(0)), e)
            return bound(stop, lambda until: bound(F.sequence(s, until - 1), lambda held: bound(F.filter(held, goes_on), lambda own: F.transform(
                F.concat(F.filter(held, lambda i: ~goes_on(i)), F.array(until)),
                lambda end: F.struct(name(s).alias("label"), F.array_join(F.transform(F.filter(own, lambda i: i < end), lambda i: F.get(x["w"], i)), " ").alias("text")),
            ))))

        return F.flatten(_segments(x, opens, written))

    return bound(F.struct(words.alias("w"), tags.alias("t")), found)


def decoded_list(words: Column, tags: Column, variant: str = "B", fields: list[str] | None = None) -> Column:
    """array<struct<label, text>>: decoded() of one text whose words and tags are lists of one length, not empty."""
    if variant not in ("A", "B", "C", "C4", "D"):
        raise ValueError(f"unknown variant {variant}")
    own = fields or {"A": GUIDE_FIELDS, "B": None, "C": FIELDS, "C4": FIELDS[:4], "D": FORM_FIELDS}[variant]
    spans = lenient_list(words, tags) if variant == "B" else strict_list(words, tags) if variant in ("A", "D") else flushing_list(words, tags)

    def joined(x: Column) -> Column:
        present = F.array_distinct(F.transform(x, lambda s: s["label"]))
        names = F.array(*map(F.lit, own)) if own else present
        if variant == "A":
            names = F.array_intersect(names, present)
        text = lambda f: stripped(F.array_join(F.transform(F.filter(x, lambda s: s["label"] == f), lambda s: s["text"]), " "))
        absent = F.lit(None).cast("string") if variant in ("C", "C4") else F.lit("")
        value = (lambda f: text(f)) if variant in ("A", "B") else (lambda f: F.coalesce(F.nullif(text(f), F.lit("")), absent))
        return F.transform(names, lambda f: F.struct(f.alias("label"), value(f).alias("text")))

    return bound(spans, joined)


def first_vote_list(tokens: Column, place: str = "token_no", label: str = "label", skip_outside: bool = False) -> Column:
    """first_vote() of one word whose tokens are a list of structs."""
    votes = lambda x: x[label].isNotNull() & x[place].isNotNull() & ((x[label] != "O") if skip_outside else F.lit(True))
    return F.coalesce(F.array_min(F.transform(F.filter(tokens, votes), lambda x: F.struct(x[place], x[label])))[label], F.lit("O"))


def first_vote(tokens: DataFrame, keys: list[str], place: str = "token_no", label: str = "label", skip_outside: bool = False) -> DataFrame:
    """(keys, label): the label of each word's first token, or of its first token that isn't outside; O without one."""
    where = F.col(label).isNotNull() & ((F.col(label) != "O") if skip_outside else F.lit(True))
    return tokens.groupBy(*keys).agg(F.coalesce(F.min_by(label, F.when(where, F.col(place))), F.lit("O")).alias("label"))


def best_class(scores: Column) -> Column:
    """The place of the largest score, from 0; the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def aligned_labels(word_ids: Column, labels: Column, ignore: int = -100) -> Column:
    """A label for each token: that of its word at the word's first token, `ignore` elsewhere and for special tokens."""
    earlier = lambda i: F.try_element_at(word_ids, F.greatest(i, F.lit(1)).cast("int"))
    inner = lambda w, i: (i > 0) & w.eqNullSafe(earlier(i))
    return F.transform(word_ids, lambda w, i: F.when(w.isNull() | inner(w, i), ignore).otherwise(F.get(labels, w)))


def truncated(tokens: Column, length: int) -> Column:
    return F.slice(tokens, 1, length)


def reading_order(boxes: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """(key, line_no, place, text, x1, cy): boxes in lines from top to bottom, and from left to right inside a line.

    Taken by their centres' height, a box joins the current line while it lies
    within `share` of the document's median box height of the mean centre of
    the line so far; ties keep the order of `pos`. boxes: key, pos, text, x1,
    y1, y2. One shuffle by document; the sorted boxes pass through a task one by
    one and only the current line is held, so a document may have any number.
    """
    cy, height = (F.col("y1") + F.col("y2")) / 2, F.col("y2") - F.col("y1")
    near = F.median(height).over(Window.partitionBy(key)) * share
    rows = boxes.select(key, F.col(text).alias("text"), F.col("x1").cast("double").alias("x1"), cy.cast("double").alias("cy"), F.col("pos").cast("long").alias("__pos"), near.alias("__near"))
    rows = rows.sortWithinPartitions(key, "cy", "__pos")  # the window has brought a document's boxes together
    of = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([T.StructField(key, of[key]), T.StructField("line_no", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("text", of["text"]), T.StructField("x1", T.DoubleType()), T.StructField("cy", T.DoubleType())])

    def lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line: list[tuple] = []  # x1, cy, pos, text
        doc, number, total, out = None, 0, 0.0, []

        def end() -> None:
            line.sort(key=lambda b: (b[0] is not None, b[0] or 0.0, b[1], b[2]))
            out.extend((doc, number, place, text, x1, cy) for place, (x1, cy, _, text) in enumerate(line))
            line.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

        shape: pa.Schema | None = None
        for part in batches:
            shape = shape or pa.schema([(key, part.schema.field(0).type), ("line_no", pa.int32()), ("place", pa.int32()), ("text", part.schema.field(1).type), ("x1", pa.float64()), ("cy", pa.float64())])
            for at, text, x1, cy, pos, near in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if line and at != doc:
                    end()
                    number = 0
                elif line and not (cy is not None and abs(cy - total / len(line)) <= near):
                    end()
                    number += 1
                if not line:
                    doc, total = at, 0.0
                line.append((x1, cy, pos, text))
                total += cy if cy is not None else 0.0
            yield batch()
        if line:
            end()
            yield batch()

    return rows.mapInArrow(lined, schema)
