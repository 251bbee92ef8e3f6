"""Column functions: text parsing, calendar arithmetic and presentation formats.

Strict parsers raise on bad text whatever `spark.sql.ansi.enabled` says; with
`strict=False` bad text becomes null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.settings import ZONE, ZONE_LABELS

ISO_DATE = "yyyy-MM-dd"
US_DATE = "M/d/yyyy"


def _strict(parsed: Column, text: Column, what: str) -> Column:
    failed = F.raise_error(F.concat(F.lit(f"not a {what}: "), text))
    return F.coalesce(parsed, F.when(text.isNotNull(), failed))


def parse_date(text: Column, pattern: str, strict: bool = True) -> Column:
    parsed = F.try_to_date(text, pattern)
    return _strict(parsed, text, f"date ({pattern})") if strict else parsed


def parse_iso_date(text: Column, strict: bool = True) -> Column:
    return parse_date(text, ISO_DATE, strict)


def parse_us_date(text: Column, strict: bool = True) -> Column:
    """Month/day/year, with or without leading zeros."""
    return parse_date(text, US_DATE, strict)


def clean_number(text: Column, strict: bool = True) -> Column:
    """Whole number from text with thousands commas; empty text is null."""
    digits = F.nullif(F.translate(text, ",", ""), F.lit(""))
    number = digits.try_cast("bigint")
    return _strict(number, digits, "whole number") if strict else number


def month_end(day: Column) -> Column:
    return F.last_day(day)


def month_length(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def horizon_days(latest: Column, as_of: Column) -> Column:
    """Days from `latest` to the end of the month that holds `as_of`."""
    return F.datediff(month_end(as_of), latest)


def local_today(zone: str = ZONE) -> Column:
    """Today's date on the wall clock of `zone`, whatever the session zone is."""
    return F.convert_timezone(None, F.lit(zone), F.localtimestamp()).cast("date")


def null_out(mask: Column, value: Column) -> Column:
    """Null where `mask` is true; a null mask keeps the value."""
    return F.when(~F.coalesce(mask, F.lit(False)), value)


def compound(level: Column, growth: Column) -> Column:
    return level * (F.lit(1.0) + growth)


def format_day(day: Column) -> Column:
    return day.cast("date").cast("string")


def format_local(
    utc: Column, zone: str = ZONE, labels: Mapping[int, str] = ZONE_LABELS
) -> Column:
    """`yyyy-MM-dd HH:mm:ss LABEL` in `zone`, for a zone-less timestamp that is in UTC."""
    utc = utc.cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    label = F.lit(None).cast("string")
    for minutes, text in labels.items():
        label = F.when(local - utc == F.make_dt_interval(mins=F.lit(minutes)), text).otherwise(label)
    return F.concat_ws(" ", F.substring(local.cast("string"), 1, 19), label)


def thousands(value: Column, whole: bool = False) -> Column:
    """Digits grouped by comma: all decimals of a double (at least one), none of a whole number."""
    pattern = "#,##0" if whole else "#,##0.0" + "#" * 15
    return F.call_function("format_number", value, F.lit(pattern))
