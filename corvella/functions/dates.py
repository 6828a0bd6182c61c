"""Calendar arithmetic and date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def months_between(start: Column, end: Column) -> Column:
    """Whole months from start to end, one less if end's day is earlier in its month; null if unknown or end is before start."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - F.when(F.day(end) < F.day(start), 1).otherwise(0)
    return F.when(end >= start, months)


def days_left(today: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(end, today))


def service_status(enlisted: Column, discharge: Column, today: Column) -> Column:
    """struct(months_served, days_left): accrual stops at discharge; both null where discharge is before enlistment."""
    sane = discharge.isNull() | (discharge >= enlisted)
    until = F.least(today, F.coalesce(discharge, today))
    return F.struct(F.when(sane, months_between(enlisted, until)).alias("months_served"), F.when(sane, days_left(today, discharge)).alias("days_left"))


def dotted_date(text: Column, pivot: int = 26) -> Column:
    """First DD.MM.YY or DD.MM.YYYY as an ISO text; two-digit years up to the pivot are 20YY. The calendar isn't checked."""
    pattern = r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4}|[0-9]{2})"
    d, m, y = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    year = F.when(F.length(y) == 4, y).otherwise(F.concat(F.when(y.cast("int") <= pivot, "20").otherwise("19"), y))
    return F.when(d != "", F.concat_ws("-", year, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))


def built_date(year: Column, month: Column, day: Column, today: Column) -> Column:
    """A date no later than today, day 1 where the day is unknown; null where there is no such date."""
    made = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, F.coalesce(day, F.lit(1))), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(made <= today, made)


def badge(date: Column, month_only: Column) -> Column:
    """Display form; none before 2010."""
    return F.when(F.year(date) >= 2010, F.when(month_only, F.date_format(date, "MM/yyyy")).otherwise(F.date_format(date, "dd/MM/yyyy")))
