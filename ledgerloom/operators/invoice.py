"""Invoice arithmetic over item rows; amounts are whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import cash_received

# Districts of the cities that have a list of their own.
DISTRICTS = {
    "Hà Nội": ["Quận Cầu Giấy", "Quận Đống Đa", "Quận Ba Đình", "Quận Hai Bà Trưng", "Quận Hoàn Kiếm", "Quận Thanh Xuân"],
    "TP. Hồ Chí Minh": ["Quận 1", "Quận 3", "Quận 7", "Quận 10", "Quận Bình Thạnh", "Quận Tân Bình", "Thành phố Thủ Đức"],
    "Đà Nẵng": ["Quận Hải Châu", "Quận Thanh Khê", "Quận Sơn Trà", "Quận Ngũ Hành Sơn"],
}


def percent_of(amount: Column, rate: Column) -> Column:
    """A rate of a whole amount, cut to a whole number."""
    return F.floor(amount * rate / 100).cast("long")


def totals(items: DataFrame, keys: list[str], qty: str = "qty", price: str = "price", discount_rate: str = "discount_rate", vat_rate: str = "vat_rate") -> DataFrame:
    """(keys, subtotal, discount_amount, vat_amount, total_amount); the rates are those of the invoice, on each of its items."""
    sums = items.groupBy(*keys).agg(F.sum(F.col(qty).cast("long") * F.col(price).cast("long")).alias("subtotal"), F.max(discount_rate).cast("long").alias("__d"), F.max(vat_rate).cast("long").alias("__v"))
    rows = sums.withColumn("discount_amount", percent_of(F.col("subtotal"), F.col("__d")))
    rows = rows.withColumn("vat_amount", percent_of(F.col("subtotal") - F.col("discount_amount"), F.col("__v")))
    return rows.withColumn("total_amount", F.col("subtotal") - F.col("discount_amount") + F.col("vat_amount")).drop("__d", "__v")


def with_cash(invoices: DataFrame, payment: str = "payment_method", layout: str = "template") -> DataFrame:
    """Adds cash_received and cash_returned."""
    rows = invoices.withColumn("cash_received", cash_received(F.col("total_amount"), F.col(payment), F.col(layout)).cast("long"))
    return rows.withColumn("cash_returned", F.col("cash_received") - F.col("total_amount"))


def nested_items(items: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """(keys, items): each invoice's items in order, as an array of structs."""
    return items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *(f for f in fields if f != order)))).alias("items"))


def districts_of(city: Column, default: list[str]) -> Column:
    """The districts of a city, or the default where it has no list."""
    out = F.array(*map(F.lit, default))
    for name, names in DISTRICTS.items():
        out = F.when(city == name, F.array(*map(F.lit, names))).otherwise(out)
    return out


def with_profile(invoices: DataFrame, profiles: DataFrame, key: str = "template", default: str = "default") -> DataFrame:
    """Each invoice with its template's profile, or the default one. The profiles are a small fixed table."""
    named = profiles.select(F.col(key).alias("__template"), F.struct(*(c for c in profiles.columns if c != key)).alias("profile"))
    fallback = named.where(F.col("__template") == default).select(F.col("profile").alias("__default"))
    joined = invoices.join(F.broadcast(named), invoices[key] == named["__template"], "left").join(F.broadcast(fallback), how="left")
    return joined.withColumn("profile", F.coalesce("profile", "__default")).drop("__template", "__default")


def pick(values: Column, *keys: Column) -> Column:
    """A choice from an array that depends on the keys alone: the seeded random of a distributed job."""
    return F.element_at(values, (F.pmod(F.xxhash64(*keys), F.size(values).cast("long")) + 1).cast("int"))
