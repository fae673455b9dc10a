"""Free-text fields to numbers, buckets and domains, as column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.functions import fixed_values as fixed
from adsift.functions.text import strip, text_of

# All decimal digits beyond ASCII, and their values, by rule.
_DIGITS = [
    c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None
]
_DIGITS_FROM = "".join(_DIGITS)
_DIGITS_TO = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)

NUMBER = r"[0-9]+\.?[0-9]*"
WHOLE_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def ascii_digits(col: Column) -> Column:
    """Decimal digits of every script as ``0``-``9``; for short fields."""
    return F.translate(col, _DIGITS_FROM, _DIGITS_TO)


def to_number(col: Column) -> Column:
    """The whole trimmed text as a double, null where it is no number.

    The pattern keeps out what a bare cast would let pass (``5d``, ``NaN``).
    """
    text = strip(col)
    return F.when(text.rlike(WHOLE_NUMBER), text.try_cast("double"))


def numbers_in(col: Column) -> Column:
    """Array of the unsigned decimal numbers in a text, in order."""
    found = F.regexp_extract_all(col, F.lit(NUMBER), F.lit(0))
    return found.try_cast("array<double>")


def _without(col: Column, *parts: str) -> Column:
    for part in parts:
        col = F.replace(col, F.lit(part), F.lit(""))
    return col


def add_label_salary(df: DataFrame, low: str, high: str) -> DataFrame:
    """Lower and upper salary as the labelling rules read them.

    With the unit in the text the rest must be one number, an open ``n+``
    (upper bound doubled) or exactly ``a-b``; without it the first two numbers
    count.  The steps are columns of their own, so that each is computed once.
    """
    text, amount = F.col("_text"), F.col("_amount")
    ends, free = F.col("_ends"), F.col("_free")
    first, single = F.get(free, F.lit(0)), F.col("_single")
    is_pair = (F.size(ends) == 2) & (F.size(F.array_compact(ends)) == 2)
    with_unit = text.contains("lpa")
    is_open, is_range = amount.contains("+"), amount.contains("-")
    steps = (
        df.withColumn("_text", _without(ascii_digits(F.lower("salary_range")), " "))
        .withColumns({"_amount": _without(text, "lpa"), "_free": numbers_in(text)})
        .withColumns(
            {
                "_single": to_number(_without(amount, "+")),
                "_ends": F.transform(F.split(amount, "-", -1), to_number),
            }
        )
    )
    return steps.withColumns(
        {
            low: F.when(~with_unit, first)
            .when(is_open, single)
            .when(is_range, F.when(is_pair, F.get(ends, F.lit(0))))
            .otherwise(single),
            high: F.when(~with_unit, F.coalesce(F.get(free, F.lit(1)), first))
            .when(is_open, single * 2)
            .when(is_range, F.when(is_pair, F.get(ends, F.lit(1))))
            .otherwise(single),
        }
    ).drop("_text", "_amount", "_free", "_single", "_ends")


def add_first_two(
    df: DataFrame, source: Column, low: str, high: str, span: int = 0
) -> DataFrame:
    """First two numbers of a text; a single one is followed by itself plus
    ``span``."""
    found = F.col("_numbers")
    first = F.get(found, F.lit(0))
    return (
        df.withColumn("_numbers", numbers_in(ascii_digits(source)))
        .withColumns({low: first, high: F.coalesce(F.get(found, F.lit(1)), first + span)})
        .drop("_numbers")
    )


def add_feature_salary(df: DataFrame, low: str, high: str) -> DataFrame:
    """Lower and upper salary as the features read them."""
    text = _without(F.lower("salary_range"), "lpa", "inr", "₹")
    return add_first_two(df, text, low, high)


def add_experience(df: DataFrame, low: str, high: str) -> DataFrame:
    return add_first_two(df, F.col("experience_required"), low, high, span=2)


def _first_digits(col: Column) -> Column:
    return F.regexp_extract(ascii_digits(col), "[0-9]+", 0)


def years_of_experience(col: Column) -> Column:
    return _first_digits(col).try_cast("bigint")


def company_size_bucket(col: Column) -> Column:
    """Ordered tests on the text, then on its first number."""
    text = F.lower(text_of(col))
    digits = _first_digits(text)
    staff = digits.try_cast("bigint")
    return (
        F.when(
            text.contains("small") | (text.contains("1") & text.contains("50")), "Small"
        )
        .when(text.contains("large") | text.contains("500"), "Large")
        .when(text.contains("medium"), "Medium")
        .when(digits == "", "Unknown")
        .when(staff <= fixed.SMALL_COMPANY_STAFF, "Small")
        .when(staff <= fixed.MEDIUM_COMPANY_STAFF, "Medium")
        .otherwise("Large")
    )


def email_domain(col: Column) -> Column:
    """Lowercase text after the last ``@``; empty where there is none."""
    text = F.lower(strip(text_of(col)))
    return F.when(text.contains("@"), F.substring_index(text, "@", -1)).otherwise("")


# Date formats tried in order, each behind a shape test: a failing parse throws
# inside the JVM, which is far dearer than a regex on a short text.
_TIME = r"\d{2}:\d{2}:\d{2}"
# Texts with a zone are read as the wall clock that they show.
_ZONE = r"(?:Z|[+-]\d{2}:\d{2})$"
DATE_FORMATS = [
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (rf"^\d{{4}}-\d{{2}}-\d{{2}} {_TIME}$", "yyyy-MM-dd HH:mm:ss"),
    (rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_TIME}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (rf"^\d{{4}}-\d{{2}}-\d{{2}} {_TIME}\.\d{{1,6}}$", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_TIME}\.\d{{1,6}}$", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_TIME}{_ZONE}", "yyyy-MM-dd'T'HH:mm:ss"),
    (rf"^\d{{4}}-\d{{2}}-\d{{2}} {_TIME}{_ZONE}", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2} \d{4}$", "MMMM d yyyy"),
]


def parse_date(col: Column, formats=None) -> Column:
    """Timestamp by the first format that fits; null where none does."""
    formats = DATE_FORMATS if formats is None else formats
    clock = F.regexp_replace(col, _ZONE, "")
    return F.coalesce(
        *[
            F.when(
                col.rlike(shape),
                F.try_to_timestamp(clock if shape.endswith(_ZONE) else col, F.lit(fmt)),
            )
            for shape, fmt in formats
        ]
    )
