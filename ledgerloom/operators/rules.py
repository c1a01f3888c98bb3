"""Rule-based classification and field extraction over text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X

# Keywords and patterns that decide labels.
TIME_WORDS = ["NGÀY", "GIỜ", "THỜI GIAN", "DATE", "TIME"]
TOTAL_WORDS = ["TỔNG TIỀN", "TỔNG CỘNG", "THANH TOÁN", "CỘNG TIỀN", "TOTAL COST", "GRAND TOTAL"]
SELLER_WORDS = ["WINMART", "GS25", "COOPMART", "CO.OPMART", "PHARMACITY", "COFFEE", "CAFE", "SIÊU THỊ", "CỬA HÀNG", "NHÀ THUỐC"]
PLACE_WORDS = ["ĐỊA CHỈ", "Đ/C", "ĐC:", "ADDRESS", "QUẬN", "PHƯỜNG", "ĐƯỜNG", "THÀNH PHỐ", "TP.", "TỈNH"]
ADDRESS_KEYS = ["đ/c", "địa chỉ", "tầng", "số", "phường", "quận", "đường"]
TOTAL_KEYS = ["tổng tiền", "tổng cộng", "thanh toán", "cần thanh toán", "tổng thanh toán", "total"]
CHAINS: list[tuple[str, list[str]]] = [
    ("VinCommerce / WinMart / VinMart", ["VINCOMMERCE", "VINMART", "WINMART", "VCM", "VIN COM", "WIN MART"]),
    ("Saigon Co.op (Co.opmart / Co.op Food)", ["COOPMART", r"CO\.OPMART", "COOP MART", r"CO\.OP MART", "SAIGON COOP", r"SAIGON CO\.OP", "COOP FOOD", r"CO\.OP FOOD"]),
    ("Bách Hóa Xanh", ["BÁCH HÓA XANH", "BACH HOA XANH", "BHX", "BACHHOAXANH"]),
    ("Circle K", ["CIRCLE K", "CIRCLE-K", "CIRCLEK"]),
    ("GS25", ["GS25", "GS 25"]),
    ("Lotte Mart", ["LOTTE"]),
    ("Big C / Go!", ["BIG C", "BIGC", "GO!", r"GO\s+MALL"]),
    ("Pharmacity", ["PHARMACITY", "PHARMA CITY"]),
    ("Guardian", ["GUARDIAN"]),
    ("7-Eleven", ["7-ELEVEN", "7 ELEVEN", "7ELEVEN"]),
    ("Highlands Coffee", ["HIGHLANDS", "HIGHLAND"]),
    ("Phúc Long", ["PHÚC LONG", "PHUC LONG"]),
    ("KFC", ["KFC", "KENTUCKY"]),
    ("Jollibee", ["JOLLIBEE"]),
    ("Trung Nguyên Legend / E-Coffee", ["TRUNG NGUYÊN", "TRUNG NGUYEN", "LEGEND"]),
    ("The Coffee House", ["THE COFFEE HOUSE", "COFFEE HOUSE"]),
]
UNMATCHED = "Other / Unmatched"


def line_label(text: Column, y_percent: Column, seller_under: float = 18) -> Column:
    """The label of a line by the first rule that holds; `seller_under` is the lowest place of a seller, in percent."""
    upper = F.upper(text)
    dated = upper.rlike("[0-9]") & (F.contains(upper, F.lit("/")) | F.contains(upper, F.lit(":")))
    return (
        F.when(X.contains_any(upper, TIME_WORDS) | dated, "TIMESTAMP")
        .when(X.contains_any(upper, TOTAL_WORDS), "TOTAL_COST")
        .when((y_percent < seller_under) & X.contains_any(upper, SELLER_WORDS), "SELLER")
        .when(X.contains_any(upper, PLACE_WORDS), "ADDRESS")
        .otherwise("OTHER")
    )


def chain_label(text: Column, chains: list[tuple[str, list[str]]] = CHAINS, default: str = UNMATCHED) -> Column:
    """The first chain, in order, of which a pattern occurs in the upper-cased text."""
    upper = F.upper(text)
    found = F.lit(default)
    for name, patterns in reversed(chains):
        found = F.when(upper.rlike("|".join(f"(?:{p})" for p in patterns)), name).otherwise(found)
    return found


def chain_statistics(labelled: DataFrame, column: str = "chain", chains: list[tuple[str, list[str]]] = CHAINS, default: str = UNMATCHED) -> DataFrame:
    """(rule_no, chain, n, percent) of every chain, those without a row included, by falling n and then rule order."""
    spark = labelled.sparkSession
    names = [*(name for name, _ in chains), default]
    rules = spark.createDataFrame(list(enumerate(names)), f"rule_no int, {column} string")
    counts = labelled.groupBy(column).agg(F.count("*").alias("n"))
    total = labelled.agg(F.count("*").alias("total"))
    filled = F.broadcast(rules).join(counts, column, "left").select("rule_no", column, F.coalesce("n", F.lit(0)).alias("n"))
    percent = F.coalesce(F.try_divide(F.lit(100.0) * F.col("n"), F.col("total")), F.lit(0.0))
    return filled.join(F.broadcast(total)).select("rule_no", column, "n", percent.alias("percent")).orderBy(F.desc("n"), "rule_no")


def extracted_fields(lines: DataFrame, key: str = "doc_id", number: str = "line_no", text: str = "text", title: bool = True) -> DataFrame:
    """(key, seller, address, timestamp, total_cost) by rules over each document's lines in order.

    Seller: the first line. Address: the first line with an address word, lower
    case, its prefix cut, in title case unless `title` is false. Time stamp: the
    first that matches. Total: the last amount of the first line with a total
    word, or of the line after it, that has one.
    """
    order = Window.partitionBy(key).orderBy(number)
    least = F.min(number).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = lines.select(
        key, number, text, F.lead(text).over(order).alias("__next"), F.lower(text).alias("__lower"),
        F.coalesce(F.row_number().over(order) == 1, F.lit(False)).alias("__leads"), F.coalesce(F.col(number) == least, F.lit(False)).alias("__least"),
    )
    lower = F.col("__lower")
    rows = ahead.select(
        key, number, text, "__leads", "__least",
        F.when(X.contains_any(lower, ADDRESS_KEYS), lower).alias("__address"), X.date_token(F.col(text)).alias("__date"),
        F.when(X.contains_any(lower, TOTAL_KEYS), F.coalesce(X.last_money(F.col(text)), X.last_money(F.col("__next")))).alias("__total"),
    )
    # of each document one row at least, and those that can decide a field
    rows = rows.where("__leads OR __least OR __address IS NOT NULL OR __date IS NOT NULL OR __total IS NOT NULL")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(number)))
    out = rows.groupBy(key).agg(F.min_by(text, number).alias("seller"), first("__address").alias("__address"), first("__date").alias("timestamp"), first("__total").alias("total_cost"))
    address = F.regexp_replace("__address", X.ADDRESS_PREFIX, "")
    return out.select(key, "seller", (X.python_title(address) if title else address).alias("address"), "timestamp", "total_cost")


def long_fields(wide: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) with a row for each field; blank values become null."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), X.blank_to_null(F.col(f).cast("string")).alias("value")) for f in fields))
    return wide.select(key, F.explode(pairs).alias("p")).select(key, "p.field", "p.value")


def filled_fields(long: DataFrame, key: str, fields: list[str], default: str = "") -> DataFrame:
    """One row per document with a column per field; missing ones take the default."""
    wide = long.groupBy(key).pivot("field", fields).agg(F.first("value"))
    return wide.select(key, *(F.coalesce(F.col(f), F.lit(default)).alias(f) for f in fields))
