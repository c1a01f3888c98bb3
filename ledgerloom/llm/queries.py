"""The registered queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, fertility, importance, langid, linkgraph, merkle, packing, pipeline, ppm, sharding, simhash, substring, toxicity
from .tables import table

#: Small enough that even the small tables are split; their SQL row shows it.
SHARD_BYTES = 256 << 10


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(spark, sf_dir, "documents"), max_bytes=SHARD_BYTES)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    docs = table(spark, sf_dir, "documents").withColumn("train", fold != 2).withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))
    return ppm.scored(docs, "train", carry=("held_out",))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    found = langid.identified(docs.withColumn("held_out", F.coalesce(fold == 0, F.lit(False))), docs.where(fold != 0), carry=("held_out",))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return importance.resampled(table(spark, sf_dir, "documents"), target)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    lower = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))
    claimed = merkle.leaf(*(lower if c == "text" else F.col(c) for c in columns))
    found = merkle.manifest(docs.withColumn("claimed", claimed), columns, carry=("claimed",))
    root = merkle.folded(F.col("claimed"), F.col("proof"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def op12_linkgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judged(table(spark, sf_dir, "pages"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def ppm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op5's rows SQL can express."""
    rows = op5_ppm(spark, sf_dir)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def fertility_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10's rows SQL can express."""
    return op10_fertility(spark, sf_dir).select("doc_id", *fertility.BASE_COLUMNS)


def queries() -> dict:
    made = (op1_sharding, op2_decontamination, op3_simhash, op4_substring, op5_ppm, op6_toxicity, op7_language, op8_importance, op9_packing, op10_fertility, op11_merkle, op12_linkgraph, op13_collocations, ppm_base, fertility_base)
    return {f.__name__: f for f in made} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    made = {"op1_sharding": sharding.OP1_SQL.format(limit=SHARD_BYTES), "op2_decontamination": decontamination.OP2_SQL, "op11_merkle": merkle.OP11_SQL}
    made |= {"op12_linkgraph": linkgraph.OP12_SQL, "op13_collocations": collocations.OP13_SQL}
    made |= {"ppm_base": ppm.BASE_SQL, "fertility_base": fertility.BASE_SQL}
    return made | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
