"""Amounts and dates as texts, and prices per month (FN-01..06, FN-15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is taken off an amount.
SYMBOLS = "$€£¥₹₩"
CODES = ["USD", "EUR", "GBP", "CAD", "AUD", "NZD", "JPY", "CNY", "INR", "CHF", "SEK", "NOK", "DKK", "MXN", "BRL", "ZAR", "SGD", "HKD", "KRW", "PLN"]
PRICE = "decimal(38,18)"


def parsed_amount(raw: Column) -> Column:
    """A text as decimal(18,4); null unless it is one number with its currency marks (FN-04..06)."""
    euro = F.contains(raw, F.lit("€"))
    t = F.regexp_replace(raw, f"[{SYMBOLS.replace('$', chr(92) + '$')}]", "")
    t = F.trim(F.regexp_replace(t, r"(?i)\b(" + "|".join(CODES) + r")\b", ""))
    negative = t.startswith("(") & t.endswith(")")
    t = F.regexp_replace(t, r"[()+ ]", "")
    comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    comma_last = t.rlike(r",[^.]*$")
    no_dots, no_commas = F.regexp_replace(t, r"\.", ""), F.regexp_replace(t, ",", "")
    european = F.regexp_replace(no_dots, ",", ".")
    plain = (
        F.when(comma & dot, F.when(comma_last, european).otherwise(no_commas))
        .when(comma, F.when(t.rlike(r"^[^,]*,[^,]{1,2}$"), F.regexp_replace(t, ",", ".")).otherwise(no_commas))
        .when(dot & (t.rlike(r"\..*\.") | (euro & t.rlike(r"^[^.]*\.[^.]{3}$"))), no_dots)
        .otherwise(t)
    )
    value = F.when(plain.rlike(r"^-?\d+(\.\d+)?$"), plain.try_cast("decimal(18,4)"))
    return F.when(negative, -value).otherwise(value).cast("decimal(18,4)")


#: Years of two digits from this one on are of the last century.
PIVOT = 70


def parsed_date(raw: Column, day_first: bool = False) -> Column:
    """A text as a date (FN-01..03); slashes, dots and hyphens, years of two or four digits, a time is ignored."""
    t = F.regexp_replace(F.trim(raw), r"[T ]\d{1,2}:\d{2}.*$", "")
    year_first = F.regexp_extract(t, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", 0) != ""
    parts = F.split(t, r"[-/.]")
    number = lambda i: parts[i].try_cast("int")
    numeric = t.rlike(r"^\d{1,2}[-/.]\d{1,2}[-/.](\d{2}|\d{4})$")
    year = F.when(F.length(parts[2]) == 2, number(2) + F.when(number(2) < PIVOT, 2000).otherwise(1900)).otherwise(number(2))

    def valid(y: Column, m: Column, d: Column) -> Column:
        padded = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        return F.try_to_timestamp(padded, F.lit("yyyy-MM-dd")).cast("date")

    a, b = (number(1), number(0)) if day_first else (number(0), number(1))
    named = F.coalesce(
        *[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("MMM d, yyyy", "MMM d yyyy", "d MMM yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyyMMdd")]
    )
    return F.when(year_first, valid(number(0), number(1), number(2))).when(numeric, F.coalesce(valid(year, a, b), valid(year, b, a))).otherwise(named)


def per_month(cadence: Column, price: Column) -> Column:
    """A price as its share of a month, decimal(38,18) (FN-15)."""
    p = price.cast(PRICE)
    return (
        F.when(cadence == "weekly", (p * 52 / 12).cast(PRICE))
        .when(cadence == "biweekly", (p * 26 / 12).cast(PRICE))
        .when(cadence == "quarterly", (p / 3).cast(PRICE))
        .when(cadence == "semiannual", (p / 6).cast(PRICE))
        .when(cadence == "annual", (p / 12).cast(PRICE))
        .otherwise(p)
    )
