"""Time predicates: validity, intervals, calendar expressions, precision."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.values import temporal_status


def at(value: str | datetime) -> Column:
    return F.lit(value).cast("timestamp")


def valid_at(moment: Column, start: Column, end: Column) -> Column:
    """Whether ``moment`` lies within the closed interval; a null end is open."""
    return (start.isNull() | (start <= moment)) & (end.isNull() | (end >= moment))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    return (start.isNull() | (start <= high)) & (end.isNull() | (end >= low))


def as_of_match(start: Column, end: Column, status: Column) -> Column:
    return F.when(start.isNotNull() | end.isNotNull(), "validity_match").when(temporal_status(status) == "timeless", "timeless").otherwise("uncertain")


def effective_time(event_start: Column, valid_from: Column, created_at: Column) -> Column:
    return F.coalesce(event_start, valid_from, created_at)


#: Numeric calendar expressions, longest first.
CALENDAR = r"(20\d{2})\s*(?:年|[-/])\s*(\d{1,2})\s*(?:月|[-/])\s*(\d{1,2})\s*日?|(20\d{2})\s*(?:年|[-/])\s*(\d{1,2})\s*月?|(?<!\d)(\d{1,2})\s*月\s*(\d{1,2})\s*日|(?<!\d)(20\d{2})\s*年"


def calendar_expression(text: Column, year: int, zone: str = "UTC") -> Column:
    """Struct (shape, start, end) of the only calendar expression in ``text``; null if there is none, more than one, or no such date.

    A day stands for noon of that day; a month or a year for its closed interval. A month and day take ``year``.
    """
    one = F.regexp_extract_all(text, F.lit(CALENDAR), F.lit(0))
    part = lambda g: F.nullif(F.regexp_extract(text, CALENDAR, g), F.lit("")).cast("int")
    y, m, d = F.coalesce(part(1), F.when(part(6).isNotNull(), F.lit(year))), F.coalesce(part(2), part(6)), F.coalesce(part(3), part(7))
    utc = lambda c: F.to_utc_timestamp(c, zone)
    day = lambda yy, mm, dd: F.try_to_timestamp(F.format_string("%04d-%02d-%02d", yy, mm, dd), F.lit("yyyy-MM-dd"))
    noon = utc(day(y, m, d) + F.expr("interval 12 hours"))
    month = day(part(4), part(5), F.lit(1))
    first = F.coalesce(month, day(part(8), F.lit(1), F.lit(1)))
    after = F.when(month.isNotNull(), F.add_months(month, 1).cast("timestamp")).otherwise(F.add_months(first, 12).cast("timestamp"))
    point = F.when(noon.isNotNull(), F.struct(F.lit("point").alias("shape"), noon.alias("start"), noon.alias("end")))
    span = F.when(d.isNull() & first.isNotNull(), F.struct(F.lit("interval").alias("shape"), utc(first).alias("start"), utc(after - F.expr("interval 1 second")).alias("end")))
    return F.when(F.size(one) == 1, F.coalesce(point, span))


def precision_mismatch(start: Column, end: Column, precision: Column) -> Column:
    """Whether an event's length doesn't suit its stated precision, give or take an hour."""
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    low, high = F.when(precision == "day", 1).when(precision == "month", 28).when(precision == "year", 365), F.when(precision == "day", 1).when(precision == "month", 31).when(precision == "year", 366)
    return F.coalesce((seconds < low * 86400 - 3601) | (seconds > high * 86400 + 3600), F.lit(False))
