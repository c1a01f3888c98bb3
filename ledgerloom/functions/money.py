"""Amounts and dates as receipts print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which receipt layouts write amounts in which way, and the words of numbers.
DOT_LAYOUTS = ["supermarket_winmart", "minimart_anan", "nhasach_campha", "cuahang_namoanh", "toll_ticket", "receipt_c45_bb"]
DECIMAL_LAYOUTS = ["supermarket_lotte"]
SECONDS_LAYOUTS = ["supermarket_lotte"]
LONG_DATE_LAYOUTS = ["receipt_c45_bb"]
NO_CASH_LAYOUTS = ["pos_slip", "toll_ticket"]
CASH = "Tiền mặt"
DIGITS = ["", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín"]
GROUPS = ["", "nghìn", "triệu", "tỷ"]
HUNDRED, TEN, TENS, ODD, ONE_AFTER_TENS, FIVE_AFTER_TEN, ZERO, CURRENCY = "trăm", "mười", "mươi", "lẻ", "mốt", "lăm", "không", "đồng"


def currency_text(amount: Column, layout: Column) -> Column:
    """Thousands with dots or commas, or with two decimals, by layout."""
    whole = F.format_number(amount, 0)
    return F.when(layout.isin(DOT_LAYOUTS), F.translate(whole, ",", ".")).when(layout.isin(DECIMAL_LAYOUTS), F.format_number(amount, 2)).otherwise(whole)


def _group_words(n: int, inner: bool) -> str:
    """The words of 0-999; an inner group names its hundreds even at zero, a leading one begins with a capital."""
    hundreds, tens, ones = n // 100, n // 10 % 10, n % 10
    spoken = hundreds > 0 or inner
    parts = [
        f"{DIGITS[hundreds]} {HUNDRED}" if spoken else "",
        TEN if tens == 1 else f"{DIGITS[tens]} {TENS}" if tens else ODD if spoken and ones else "",
        ONE_AFTER_TENS if ones == 1 and tens > 1 else FIVE_AFTER_TEN if ones == 5 and tens else DIGITS[ones],
    ]
    said = " ".join(p for p in parts if p)
    return said if inner else said[:1].upper() + said[1:]


def number_words(n: Column) -> Column:
    """A whole number below 10^12 in words, with the currency; the first letter is capital except for zero.

    Groups of a thousand that are zero are left out. Null, negative and larger
    numbers have null.
    """
    n = n.cast("long")
    # the split of a constant is a constant, so a group costs one look into an array
    table = F.split(F.lit("|".join(_group_words(g, inner) for inner in (False, True) for g in range(1000))), "[|]")
    parts = []
    for k in (3, 2, 1, 0):
        group = F.floor(n / 1000**k) % 1000
        said = F.element_at(table, (group + F.when(n < 1000 ** (k + 1), 1).otherwise(1001)).cast("int"))
        parts.append(F.when(group > 0, F.concat(said, F.lit(f" {GROUPS[k]}" if GROUPS[k] else ""))))
    return F.when(n == 0, f"{ZERO} {CURRENCY}").when((n > 0) & (n < 10**12), F.concat_ws(" ", *parts, F.lit(CURRENCY)))


def cash_received(total: Column, payment: Column, layout: Column) -> Column:
    """Cash is rounded up to ten thousand; other payments, and layouts without cash, take the exact total."""
    rounded = F.floor((total + 9999) / 10000) * 10000
    return F.when((payment == CASH) & ~layout.isin(NO_CASH_LAYOUTS), rounded).otherwise(total)


def receipt_date(t: Column, layout: Column) -> Column:
    long = F.format_string("Ngày %02d tháng %02d năm %d", F.dayofmonth(t), F.month(t), F.year(t))
    return F.when(layout.isin(SECONDS_LAYOUTS), F.date_format(t, "dd/MM/yyyy HH:mm:ss")).when(layout.isin(LONG_DATE_LAYOUTS), long).otherwise(F.date_format(t, "dd/MM/yyyy HH:mm"))
