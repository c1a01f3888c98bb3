"""Annotation records: joins by region, assignment, splits, merging, resuming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import path_name, stripped


def labelled_regions(results: DataFrame, key: str = "task_id", region: str = "region_id", place: str = "place") -> DataFrame:
    """(key, region, place, label, text): rectangle and text records of one region joined; of repeats the last counts.

    results: key, place, region, type, label, text. A rectangle without a text
    is dropped. The place is that of the region's first rectangle.
    """
    rectangle, area = F.col("type") == "rectanglelabels", F.col("type") == "textarea"
    at = lambda which: F.when(which, F.col(place))
    out = results.groupBy(key, region).agg(
        F.min(at(rectangle)).alias(place), F.max_by("label", at(rectangle)).alias("label"), F.max_by("text", at(area)).alias("text")
    )
    return out.where(F.col(place).isNotNull() & F.col("label").isNotNull() & F.col("text").isNotNull())


def exploded_results(tasks: DataFrame, key: str = "id") -> DataFrame:
    """The records of each task's first annotation, a row each, as labelled_regions() takes them."""
    first = F.get(F.col("annotations"), F.lit(0))["result"]
    rows = tasks.select(F.col(key).alias("task_id"), F.posexplode(first).alias("place", "r"))
    return rows.select("task_id", "place", F.col("r.id").alias("region_id"), F.col("r.type").alias("type"), F.get("r.value.rectanglelabels", F.lit(0)).alias("label"), F.get("r.value.text", F.lit(0)).alias("text"))


def predictions_as_annotations(tasks: DataFrame) -> DataFrame:
    """Each prediction's records become an annotation; the predictions go."""
    empty = F.array().cast(tasks.schema["predictions"].dataType.elementType["result"].dataType)
    made = F.transform("predictions", lambda p: F.struct(F.coalesce(p["result"], empty).alias("result")))
    return tasks.withColumn("annotations", F.coalesce(made, F.array().cast(made_type(tasks)))).drop("predictions")


def made_type(tasks: DataFrame) -> str:
    return f"array<struct<result:{tasks.schema['predictions'].dataType.elementType['result'].dataType.simpleString()}>>"


def with_first_match(left: DataFrame, right: DataFrame, keys: list[str], priority: str, values: list[str]) -> DataFrame:
    """A left join to the row of the least priority for each key; null values without one."""
    best = right.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(priority, *values)).alias("__best"))
    return left.join(best, keys, "left").select(*left.columns, *(F.col(f"__best.{v}").alias(v) for v in values))


def resolved_paths(names: DataFrame, files: DataFrame, name: str = "file_name", path: str = "path", priority: str = "dir_no") -> DataFrame:
    """(names' columns, path): the file of that name in the first folder that has one, else images/<name>."""
    found = with_first_match(names, files.withColumn(name, path_name(F.col(path))), [name], priority, [path])
    return found.withColumn(path, F.coalesce(path, F.concat(F.lit("images/"), name)))


def remaining(items: DataFrame, done: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """Items not yet done; what ended in an error is done again."""
    return items.join(done.where(F.col(error).isNull()).select(*keys), keys, "left_anti")


def existing(items: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(present.select(*keys), keys, "left_semi")


#: Ranges into which the rows of a large group are cut for numbering: two to the power of this.
RANGE_BITS = 8
#: Hexadecimal digits of a text that its place among the ranges goes by, after what all texts of the group begin with.
DIGITS = 14


def _with_group(items: DataFrame, table: DataFrame, group: list[str]) -> DataFrame:
    """Each item with the row of its group, whose columns are __g0, __g1, ...; null groups meet."""
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)))
    return items.join(table, same, "left").drop(*(f"__g{i}" for i in range(len(group))))


def _ranged(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The items with `__range`, one of 256 in their group that rise with the order, of about as many rows each.

    The cuts are quantiles, by a sketch of bounded size, of a number that doesn't
    fall as the first order column rises: of its value, or of the first digits of
    a text behind what the group's first and last text have in common. Equal
    values share a range, as do texts alike in these digits; nulls have their own.
    """
    kind, first = items.schema[order[0]].dataType, F.col(order[0])
    own = [F.col(c).alias(f"__g{i}") for i, c in enumerate(group)]
    if isinstance(kind, T.StringType):
        ends = items.groupBy(*own).agg(F.hex(F.min(first)).alias("__low"), F.hex(F.max(first)).alias("__high"))
        short = F.least(F.length("__low"), F.length("__high"))
        alike = F.size(F.filter(F.sequence(F.lit(1), short), lambda n: F.left(F.col("__low"), n) == F.left(F.col("__high"), n)))
        items = _with_group(items, ends.withColumn("__head", F.when(short > 0, alike).otherwise(0)).drop("__low", "__high"), group)
        digits = F.rpad(F.substr(F.hex(first), F.col("__head") + 1, F.lit(DIGITS)), DIGITS, "0")
        code = F.conv(digits, 16, 10).cast("long")
    elif isinstance(kind, T.NumericType):
        code = first if isinstance(kind, T.IntegralType) else first.cast("double")
    elif isinstance(kind, T.DateType | T.BooleanType | T.TimestampType):
        code = F.unix_date(first) if isinstance(kind, T.DateType) else F.unix_micros(first) if isinstance(kind, T.TimestampType) else first.cast("int")
    else:
        code = F.lit(0)  # one range
    rows = items.withColumn("__code", code)
    shares = [k / (1 << RANGE_BITS) for k in range(1, 1 << RANGE_BITS)]
    cuts = rows.groupBy(*own).agg(F.percentile_approx("__code", shares, 4 << RANGE_BITS).alias("__cuts"))
    below = F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(range(RANGE_BITS)))), F.lit(0), lambda at, step: at + F.when(F.get(F.col("__cuts"), at + step - 1) < F.col("__code"), step).otherwise(0))
    return _with_group(rows, cuts, group).withColumn("__range", F.when(F.col("__code").isNull(), -1).otherwise(below)).drop("__code", "__cuts", "__head")


def _placed(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The items with `__place`, their number from 1 in their group, and `__size`, that of their group.

    No task takes a whole group: rows are numbered inside a range of their
    group, and the counts of the ranges before it are added.
    """
    ranged = _ranged(items, group, order)
    counts = ranged.groupBy(*(F.col(c).alias(f"__g{i}") for i, c in enumerate(group)), F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*(f"__g{i}" for i in range(len(group))))
    before = F.sum("__n").over(whole.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumns({"__before": F.coalesce(before, F.lit(0)), "__size": F.sum("__n").over(whole)}).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*order))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)), F.col("__range") == F.col("__r"))
    numbered = ranged.withColumn("__inside", inside).join(counts, same)
    return numbered.select(*items.columns, (F.col("__before") + F.col("__inside")).alias("__place"), "__size")


def round_robin(items: DataFrame, group: list[str], order: list[str], members: list[str]) -> DataFrame:
    """The items of each group dealt to the members in turn: column `member`."""
    turn = ((F.col("__place") - 1) % len(members)).cast("int")
    return _placed(items, group, order).select(*items.columns, F.element_at(F.array(*map(F.lit, members)), turn + 1).alias("member"))


def assigned_counts(dealt: DataFrame, by: list[str], done: str | None = None) -> DataFrame:
    """(by, n[, succeeded, failed]): how many items each member or split has, and of these how many `done` says went well."""
    ok = F.coalesce(F.col(done), F.lit(False)) if done else None
    counts = {"succeeded": F.count_if(ok), "failed": F.count_if(~ok)} if done else {}
    return dealt.groupBy(*by).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in counts.items()))


def stratified_split(items: DataFrame, group: list[str], order: list[str], percent: int = 80) -> DataFrame:
    """Column `split`: the first `percent` of each group, rounded down, are train, the others val."""
    size = F.col("__size")
    train = F.col("__place") * 100 <= size * percent - (size * percent) % 100
    return _placed(items, group, order).select(*items.columns, F.when(train, "train").otherwise("val").alias("split"))


def first_in_group(items: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group; Spark cuts each task's rows to these before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return items.withColumn("__n", place).where(F.col("__n") <= most).drop("__n")


def renumbered(sources: list[DataFrame], order: list[str], name: str = "new_id") -> DataFrame:
    """All rows of the sources, one source after another, numbered from 1 without gaps.

    Numbers come from counts by range, so no task sees all rows of a source, and
    no job runs before the result is asked for.
    """
    out = None
    for rank, df in enumerate(sources):
        now = df.withColumn("source_rank", F.lit(rank))
        out = now if out is None else out.unionByName(now, allowMissingColumns=True)
    sizes = out.groupBy(F.col("source_rank").alias("__rank")).agg(F.count("*").alias("__n"))  # a row a source
    before = F.sum("__n").over(Window.orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__rank", F.coalesce(before, F.lit(0)).alias("__offset"))
    placed = _placed(out, ["source_rank"], order).join(F.broadcast(offsets), F.col("source_rank") == F.col("__rank"))
    return placed.withColumn(name, F.col("__offset") + F.col("__place")).drop("__rank", "__offset", "__place", "__size")


def rekeyed_metadata(sources: list[DataFrame], split: str = "test", order: list[str] | None = None, name: str = "file_name") -> DataFrame:
    """Metadata rows of several splits as one: new ids from 1 in source order, image and label paths below `split`, no PDF."""
    rows = renumbered([df.drop("id", "image_path", "label_path", "pdf_path") for df in sources], order or [name], "id")
    label = F.replace(F.col(name), F.lit(".png"), F.lit(".json"))
    return rows.drop("source_rank").withColumns({
        "image_path": F.concat(F.lit(f"{split}/images/"), F.col(name)), "label_path": F.concat(F.lit(f"{split}/labels/"), label), "pdf_path": F.lit(None).cast("string"),
    })


def shuffled(items: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A fixed random order: by a hash of the key."""
    return items.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def joined_texts(items: DataFrame, keys: list[str], place: str = "place", text: str = "text", every: dict[str, list[str]] | None = None) -> DataFrame:
    """(keys, texts, text): each group's texts in order, as a list and joined; an empty text is null.

    `every` names one of the keys and its values: a group of the other keys has a
    row for each of these values, null lists and texts where it has no text.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(text).alias("t")))), lambda x: x["t"])
    out = items.groupBy(*keys).agg(ordered.alias("texts"))
    for key, values in (every or {}).items():
        others = [k for k in keys if k != key]
        grid = items.select(*others).distinct().withColumn(key, F.explode(F.array(*map(F.lit, values))))
        out = grid.join(out, keys, "left").select(*keys, "texts")
    return out.withColumn("text", F.nullif(stripped(F.array_join("texts", " ")), F.lit("")))
