"""Decimal arithmetic, period labels and value parsing as Columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import vocab

AMOUNT = "decimal(22,6)"
PERCENT = "decimal(18,2)"

# A number with optional currency, sign, scale word, percent sign and parentheses.
VALUE_PATTERN = (
    r"(\()?\s*"
    r"(US\$|\$|€|£|¥|USD|EUR|GBP|JPY|CAD|AUD|CNY|RMB)?\s*"
    r"(-)?\s*"
    r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)"
    r"(?:(bn|mn|mm|[kmbt])\b|\s+(thousand|million|billion|trillion)s?\b)?"
    r"\s*(%|percent\b)?"
    r"\s*(\))?"
)


def amount(c: Column) -> Column:
    return c.cast(AMOUNT)


def period_label(year: Column, quarter: Column) -> Column:
    return (
        F.when(year.isNull(), F.lit("UNKNOWN"))
        .when(F.coalesce(quarter, F.lit(0)) != 0, F.concat(F.lit("Q"), quarter, F.lit(" "), year))
        .otherwise(F.concat(F.lit("FY"), year))
    )


def period_order(year: Column, quarter: Column) -> Column:
    """Chronological position; an annual report counts as the fourth quarter."""
    return year * 4 + F.coalesce(quarter, F.lit(4))


def fixed(c: Column, places: int, *, sign: bool = False) -> Column:
    """A decimal with a fixed number of places, half to even, optionally always signed."""
    size = F.bround(F.abs(c), places).cast(f"decimal(38,{places})").cast("string")
    mark = F.when(c < 0, F.lit("-")).otherwise(F.lit("+" if sign else ""))
    return F.concat(mark, size)


def percent_change(current: Column, previous: Column) -> Column:
    """(current - previous) / previous * 100, two places, half to even; NULL on a zero base."""
    ratio = F.try_divide((current - previous).cast("decimal(22,6)") * F.lit(100).cast("decimal(3,0)"),
                         previous)
    return F.bround(ratio, 2).cast(PERCENT)


def change_flags(current: Column, previous: Column) -> Column:
    flag = (
        F.when(current.isNull() | previous.isNull(), F.lit("missing_value"))
        .when(previous == 0, F.lit("division_by_zero"))
        .when(previous < 0, F.lit("negative_base"))
    )
    return F.array_compact(F.array(flag))


def mapping(values: dict[str, str]) -> Column:
    """A fixed dictionary as one constant map column."""
    return F.from_json(F.lit(json.dumps({"v": values}, ensure_ascii=False)), "v map<string,string>")["v"]


def currency_code(c: Column) -> Column:
    s = F.trim(c)
    return F.coalesce(
        mapping(vocab.CURRENCY_SYMBOLS)[s], mapping(vocab.CURRENCY_CODES)[F.lower(s)]
    )


def scale_factor(label: Column) -> Column:
    out = F.lit(1).cast("decimal(13,0)")
    for name, power in vocab.SCALE_POWERS.items():
        out = F.when(label == name, F.lit(10 ** power).cast("decimal(13,0)")).otherwise(out)
    return out


def find_values(text: Column) -> Column:
    """Every value in a text, in order: raw, value, currency, unit, is_percent, marked.

    ``marked`` is true when a currency, a scale word or a percent sign is present.
    """
    # no capture in the scan itself; the parts are taken from each short match
    flat = "(?iu)" + VALUE_PATTERN
    raws = F.regexp_extract_all(text, F.lit(flat), F.lit(0))

    def part(raw: Column, group: int) -> Column:
        return F.regexp_extract(raw, flat, group)

    def build(raw: Column) -> Column:
        percent = F.length(part(raw, 7)) > 0
        label = F.when(
            ~percent,
            mapping(vocab.TEXT_SCALES)[F.lower(F.concat(part(raw, 5), part(raw, 6)))],
        )
        code = F.when(~percent, currency_code(part(raw, 2)))
        number = F.replace(part(raw, 4), F.lit(","), F.lit("")).try_cast("decimal(22,6)")
        negative = (F.length(part(raw, 3)) > 0) | (
            (F.length(part(raw, 1)) > 0) & (F.length(part(raw, 8)) > 0)
        )
        scaled = number * scale_factor(label)  # decimal(36,6), which holds every product
        return F.struct(
            F.trim(raw).alias("raw"),
            F.when(negative, -scaled).otherwise(scaled).alias("value"),
            code.alias("currency"),
            F.when(percent, F.lit("PERCENT")).otherwise(F.coalesce(label, F.lit("ABSOLUTE"))).alias("unit"),
            percent.alias("is_percent"),
            (percent | code.isNotNull() | label.isNotNull()).alias("marked"),
        )

    return F.transform(raws, build)


def parse_year(c: Column) -> Column:
    return F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def parse_quarter(c: Column) -> Column:
    return F.regexp_extract(c, r"(?i)\bQ([1-4])\b", 1).try_cast("int")
