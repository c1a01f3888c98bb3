"""Makes the functions callable from SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ledgerloom.operators.labels import BASE_FIELDS, ITEM_FIELDS

from .text import DATE_TIME, MONEY, WHITE, _literal_list, _sequence_ratio, python_title


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_ITEM = f"^({'|'.join(ITEM_FIELDS)})"

#: SQL functions: name, parameters, type, body. All are JVM-side.
SQL_FUNCTIONS = [
    ("blank_to_null", "v STRING", "STRING", "CASE WHEN btrim(v, '" + WHITE + "') <> '' THEN v END"),
    ("last_money", "v STRING", "STRING", f"try_element_at(regexp_extract_all(v, r'{MONEY}', 0), -1)"),
    ("date_token", "v STRING", "STRING", f"nullif(regexp_extract(v, r'{DATE_TIME}', 1), '')"),
    ("canonical_label", "v STRING", "STRING", f"CASE WHEN upper(v) IN ({_listed(BASE_FIELDS)}) THEN upper(v) WHEN upper(v) RLIKE '{_ITEM}' THEN regexp_extract(upper(v), '{_ITEM}', 0) ELSE 'OTHER' END"),
    ("normalized_coordinate", "v DOUBLE, size DOUBLE", "BIGINT", "greatest(0, least(1000, CAST(1000 * (v / size) AS BIGINT)))"),
    ("edit_similarity", "a STRING, b STRING", "DOUBLE", "1.0D - levenshtein(replace(lower(coalesce(a, '')), ' ', ''), replace(lower(coalesce(b, '')), ' ', '')) / greatest(1, length(replace(coalesce(a, ''), ' ', '')), length(replace(coalesce(b, ''), ' ', '')))"),
    ("file_name_of", "v STRING", "STRING", r"substring_index(translate(CASE WHEN contains(v, '/data/local-files/?d=') THEN substring_index(v, '?d=', -1) ELSE v END, '\\', '/'), '/', -1)"),
]


def register(spark: SparkSession) -> None:
    for name, parameters, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("python_title", python_title)
    spark.udf.register("literal_list", _literal_list)
    spark.udf.register("sequence_ratio", _sequence_ratio)
