"""Readers of images, labels, annotation exports, lists and recognised lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import path_name, stripped

from . import dom, schemas

#: Characters of a delimited file that tell its delimiter.
HEAD = 2048
IMAGES = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def images(spark: SparkSession, folders: list[str], content: bool = False) -> DataFrame:
    """(path, name, folder_no, length[, content]) of the images in the folders; a path that comes twice counts once, for its first folder."""
    out = None
    for number, folder in enumerate(folders):
        rows = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).load(folder)
        rows = rows.select("path", path_name(F.col("path")).alias("name"), F.lit(number).alias("folder_no"), "length", *(["content"] if content else []))
        out = rows if out is None else out.unionByName(rows)
    first = out.groupBy("path").agg(F.min("folder_no").alias("folder_no"))
    return out.join(first, ["path", "folder_no"], "left_semi").dropDuplicates(["path"])


def label_files(spark: SparkSession, folder: str, skip: str = "metadata") -> DataFrame:
    """Label records of all JSON files below the folder, with their path; files named like `skip` and broken files are left out."""
    rows = spark.read.schema(f"{schemas.LABEL_FILE}, _corrupt STRING").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"))
    return rows.where(~F.contains(path_name(F.col("path")), F.lit(skip)) & F.col("_corrupt").isNull() & F.col("annotations").isNotNull()).drop("_corrupt")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a dataset's metadata array."""
    return spark.read.schema(schemas.METADATA).option("multiLine", True).json(path)


def labelled_metadata(rows: DataFrame, labels: DataFrame, base: str = "") -> DataFrame:
    """Metadata rows with their label file's annotations; rows whose file is missing are left out."""
    named = labels.select(F.regexp_replace("path", "^file:/+", "/").alias("__path"), "image_width", "image_height", "annotations")
    return rows.withColumn("__path", F.concat(F.lit(base), F.col("label_path"))).join(named, "__path").drop("__path")


def sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """(image, annotation) of a delimited file whose delimiter and columns are found out from its head.

    The delimiter is ";" if the first HEAD characters have one, else ",". The image column
    is the first whose name holds img or id, the text column the first that
    holds text, else anno.
    """
    lines = spark.read.text(path).limit(HEAD).collect()  # lines of one character and its end at least
    sep = ";" if ";" in "\n".join(r[0] for r in lines)[:HEAD] else ","
    rows = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"')
    find = lambda *keys: next((c for k in keys for c in rows.columns if k in c.lower()), None)
    image, text = next((c for c in rows.columns if "img" in c.lower() or "id" in c.lower()), None), find("text", "anno")
    if image is None or text is None:
        raise ValueError(f"{path}: no image or text column among {rows.columns}")
    return rows.select(F.col(image).alias("image"), F.col(text).alias("annotation"))


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a list, trimmed, without blank ones."""
    return spark.read.text(path).select(stripped(F.col("value")).alias("value")).where("value <> ''")


def annotation_export(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of annotation exports, with the file each is from; files that aren't arrays of tasks give no rows."""
    rows = spark.read.schema(schemas.ANNOTATION_TASK).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("source_file")).where("data IS NOT NULL")


def ocr_cache(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, poly, text, conf): recognised lines kept as Parquet by image path."""
    return spark.read.schema(schemas.OCR_LINE).parquet(path)


def ocr_cache_json(spark: SparkSession, path: str) -> DataFrame:
    """The same from a JSON map of image path to lines [polygon, [text, confidence]]."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("path", "lines")).select("path", F.posexplode("lines").alias("line_no", "line"))
    part = lambda at, kind: F.from_json(F.get_json_object("line", at), kind)
    return rows.select("path", "line_no", part("$[0]", "array<array<double>>").alias("poly"), F.get_json_object("line", "$[1][0]").alias("text"), F.get_json_object("line", "$[1][1]").cast("double").alias("conf"))


def object_listing(spark: SparkSession, folder: str, suffixes: list[str], most: int | None = None) -> DataFrame:
    """(path, length) of the files of an object store's folder with one of the suffixes; `most` keeps the first of them by path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    rows = rows.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    return rows.orderBy("path").limit(most) if most else rows


def located(wanted: DataFrame, files: DataFrame, name: str = "file_name", priority: str = "priority") -> DataFrame:
    """Each wanted name with the path of the best-placed file of that name; null where none is."""
    from ledgerloom.operators.annotations import with_first_match

    return with_first_match(wanted, files.withColumn(name, path_name(F.col("path"))), [name], priority, ["path"])


def found_images(wanted: DataFrame, files: DataFrame, upload: str, others: list[str] = (), shared: str = "/data/upload/", location: str = "image") -> DataFrame:
    """The wanted rows with `found`, the path of the first place of each image that exists, null without one; web addresses are found as they are.

    The places in order: the location itself, its name in the upload folder, its
    name in each other folder, the location with the shared prefix replaced by
    the upload folder, any file of that name below the upload folder (the first
    by path). `files` lists the paths that exist.
    """
    name = path_name(F.col(location))
    at = lambda folder: F.concat(F.lit(folder.rstrip("/") + "/"), name)
    moved = F.when(F.col(location).startswith(shared), F.replace(F.col(location), F.lit(shared), F.lit(upload.rstrip("/") + "/")))
    places = F.array(F.col(location), at(upload), *map(at, others), moved)
    local = F.regexp_replace("path", "^file:/+", "/")
    listed = files.select(local.alias("__path")).distinct()
    web = F.col(location).rlike("^https?://")
    keyed = wanted.select(location).distinct().where(~web)
    tried = keyed.select(location, F.posexplode(places).alias("__no", "__path")).join(listed, "__path")
    below = listed.where(F.col("__path").startswith(upload.rstrip("/") + "/")).groupBy(path_name(F.col("__path")).alias("__name")).agg(F.min("__path").alias("__path"))
    last = keyed.withColumn("__name", name).join(below, "__name").select(location, F.lit(len(others) + 3).alias("__no"), "__path")
    best = tried.select(location, "__no", "__path").unionByName(last).groupBy(location).agg(F.min_by("__path", "__no").alias("__found"))
    return wanted.join(best, location, "left").select(*wanted.columns, F.when(web, F.replace(F.col(location), F.lit("localhost"), F.lit("127.0.0.1"))).otherwise(F.col("__found")).alias("found"))


def recognised(files: DataFrame, engine: Callable[[], Callable[[bytes], list[tuple[list[list[float]], str, float]]]]) -> DataFrame:
    """(path, line_no, poly, text, conf) of images by any recognition engine.

    `engine` makes a function from an image's bytes to its lines; it is called
    once in each task. Lines without text are left out, an image that can't be
    read has no lines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine()
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    lines = read(content) or []
                except (ValueError, OSError):
                    lines = []
                rows += [(path, n, poly, text, conf) for n, (poly, text, conf) in enumerate(lines) if text and text.strip()]
            yield pd.DataFrame(rows, columns=["path", "line_no", "poly", "text", "conf"])

    return files.select("path", "content").mapInPandas(run, schemas.OCR_LINE)


# How generated pages mark a field, and where they name it.
FIELD_CLASS, FIELD_LABEL = "kie-field", "data-label"


def page_fields(pages: DataFrame, key: str = "page_id", html: str = "html", blank: bool = False) -> DataFrame:
    """(key, place, label, text) of the marked fields of web pages; a field inside another is in both. Fields without text only if `blank`."""
    rows = dom.elements(pages, css_class=FIELD_CLASS, key=key, html=html)
    rows = rows.select(key, "place", F.try_element_at("attributes", F.lit(FIELD_LABEL)).alias("label"), "text")
    return rows if blank else rows.where("text <> ''")


def page_elements(pages: DataFrame, tags: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, place, label, text) of the elements with one of the tags; the label is the tag."""
    return dom.elements(pages, tuple(tags), key=key, html=html).select(key, "place", F.col("tag").alias("label"), "text")


def flat_elements(pages: DataFrame, tags: list[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """The same by a pattern on the JVM, for pages whose elements are closed and hold none of their kind: entities stay, inner tags become blanks."""
    names = "|".join(tags)
    pattern = F.lit(rf"(?is)<({names})\b[^>]*>(.*?)</(?:{names})>")
    rows = pages.select(key, F.posexplode(F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("label"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("text"))).alias("place", "f"))
    return rows.select(key, F.col("place").cast("long").alias("place"), F.lower("f.label").alias("label"), F.trim(F.regexp_replace(F.regexp_replace("f.text", "<[^>]*>", " "), r"\s+", " ")).alias("text"))
