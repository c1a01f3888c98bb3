"""Text functions as Column expressions; Python only where Spark has no equal."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that decide which tokens count as a time stamp or an amount.
DATE_TIME = r"(\d{2}[/-]\d{2}[/-]\d{4}\s+\d{2}:\d{2}(:\d{2})?|\d{2}:\d{2}\s+\d{2}[/-]\d{2}[/-]\d{4})"
MONEY = r"\d{1,3}(?:[.,]\d{3})*"
ADDRESS_PREFIX = r"^(đ/c|địa chỉ)[:\s\-]*"
# Fixed value: the characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """The text without white space at its ends, be it blanks, line ends or others."""
    return F.btrim(c, F.lit(WHITE))


def blank_to_null(c: Column) -> Column:
    """Texts of white space only become null, the single form of an absent value."""
    return F.when(stripped(c) != "", c)


def contains_any(c: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(c, F.lit(needle))
    return found


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(c: Column) -> Column:
    """Tokens between white space, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def date_token(c: Column) -> Column:
    """The first date with a time, in either order; null without one."""
    return F.when(F.contains(c, F.lit(":")), F.nullif(F.regexp_extract(c, DATE_TIME, 1), F.lit("")))


def money_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(MONEY), F.lit(0))


def last_money(c: Column) -> Column:
    return F.try_element_at(money_tokens(c), F.lit(-1))


@F.pandas_udf(T.StringType())
def python_title(s: pd.Series) -> pd.Series:
    """Title case in which every letter after a non-letter begins a word."""
    return s.str.title()


def address_text(c: Column) -> Column:
    return python_title(F.regexp_replace(F.lower(c), ADDRESS_PREFIX, ""))


def path_name(c: Column) -> Column:
    """The last part of a path or URL, that of the ?d= argument where a local-file URL has one."""
    local = F.when(F.contains(c, F.lit("/data/local-files/?d=")), F.substring_index(c, "?d=", -1)).otherwise(c)
    return F.substring_index(F.translate(local, "\\", "/"), "/", -1)


# What a name's file name has in place of these, one after another.
SLUG_PARTS = [(" / ", "_"), (" (", "_"), (")", ""), (".", ""), (" ", "_")]


def slug(c: Column) -> Column:
    """The file name of a chain's list: lower case, with a few characters replaced; letters with accents, hyphens and others stay."""
    out = F.lower(c)
    for old, new in SLUG_PARTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def numbered_name(prefix: Column, split: Column, number: Column) -> Column:
    return F.format_string("%s_%s_%03d", prefix, split, number)


def without_fence(c: Column) -> Column:
    """The body of a fenced answer without white space at its ends; other text only without that."""
    trimmed = stripped(c)
    body = F.regexp_replace(F.regexp_replace(trimmed, r"^```(json)?", ""), r"```$", "")
    return F.when(trimmed.startswith("```"), stripped(body)).otherwise(trimmed)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal_list(s: pd.Series) -> pd.Series:
    def one(v):
        try:
            found = ast.literal_eval(v)
            return [None if x is None else str(x) for x in found] if isinstance(found, list | tuple) else None
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return s.map(one, na_action="ignore")


def parsed_list(c: Column) -> Column:
    """A list written as text: as JSON, else as a Python literal, else cut at commas; other text is a list of one."""
    trimmed = stripped(c)
    listed = trimmed.startswith("[") & trimmed.endswith("]")
    from_json = F.from_json(F.when(listed, trimmed), "array<string>", {"mode": "PERMISSIVE"})
    pieces = F.filter(F.split(F.regexp_replace(F.regexp_replace(trimmed, r"^\[", ""), r"\]$", ""), ","), lambda p: stripped(p) != "")
    simple = F.transform(pieces, lambda p: F.regexp_replace(stripped(p), "^['\"]+|['\"]+$", ""))
    literal = _literal_list(F.when(listed & from_json.isNull(), trimmed))
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).when(listed, F.coalesce(from_json, literal, simple)).otherwise(F.array(trimmed))


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def fuzzy_ratio(truth: Column, predicted: Column) -> Column:
    """Matching-blocks ratio of two texts without case and blanks; 1 for two absent texts, 0 for one.

    Only pairs that differ and are both there reach Python.
    """
    a = F.coalesce(F.regexp_replace(F.lower(truth), " ", ""), F.lit(""))
    b = F.coalesce(F.regexp_replace(F.lower(predicted), " ", ""), F.lit(""))
    hard = (a != b) & (a != "") & (b != "")
    return F.when(a == b, F.lit(1.0)).when(hard, _sequence_ratio(F.when(hard, a), F.when(hard, b))).otherwise(F.lit(0.0))


def edit_similarity(truth: Column, predicted: Column) -> Column:
    """1 less the edit distance over the longer length, without case and blanks: the JVM-side match."""
    a = F.coalesce(F.replace(F.lower(truth), F.lit(" "), F.lit("")), F.lit(""))
    b = F.coalesce(F.replace(F.lower(predicted), F.lit(" "), F.lit("")), F.lit(""))
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b)))


def parsed_answer(c: Column, kind: str) -> Column:
    """A model's JSON answer with its fence removed, as a value of that type; null where it isn't one JSON value."""
    # inside an array, what follows the value makes it malformed or longer
    values = F.from_json(F.concat(F.lit("["), without_fence(c), F.lit("]")), f"array<{kind}>", {"mode": "PERMISSIVE"})
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def answer_error(c: Column, kind: str, message: str = "not JSON") -> Column:
    """The error of a model's answer that isn't one JSON value of that type; null for an answer that is."""
    return F.when(parsed_answer(c, kind).isNull(), F.lit(message))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """A template with each {{ name }} replaced by its value; null values become empty, other names stay."""
    out = template
    for name, value in values.items():
        # what the value holds is taken as it is, not as a pattern's reference
        literal = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"([\\$])", r"\\$1")
        out = F.regexp_replace(out, F.lit(r"\{\{\s*" + name + r"\s*\}\}"), literal)
    return out


def value_by_part(entries: Column, part: Column) -> Column:
    """The map value of the first key, in key order, that holds the text; null without one."""
    keys = F.array_sort(F.filter(F.map_keys(entries), lambda k: F.contains(k, part)))
    return F.try_element_at(entries, F.get(keys, F.lit(0)))
