"""Dates kept as text in sources, parsed without ever failing a query."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """ISO by its first ten characters, else an e-mail date; no shift of time zone."""
    iso = F.try_to_date(F.left(F.trim(text), F.lit(10)), "yyyy-MM-dd")
    mail = F.regexp_extract(F.trim(text), "^(?:[A-Za-z]{3},\\s*)?(\\d{1,2} [A-Za-z]{3} \\d{4})", 1)
    return F.coalesce(iso, F.try_to_date(F.nullif(mail, F.lit("")), "d MMM yyyy"))


def date_of_parts(year: Column, month: Column, day: Column) -> Column:
    """A date of up to three numbers; absent months and days are 1, impossible dates null."""
    return F.try_make_timestamp(year, F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1)), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def month_start(month: Column) -> Column:
    return F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")


def window_start(month: Column, lookback_days: int = 45) -> Column:
    return F.date_sub(month_start(month), lookback_days)


def window_end(month: Column) -> Column:
    return F.last_day(month_start(month))


def in_month(date: Column, month: Column) -> Column:
    """False for a null date."""
    return F.coalesce(date.between(month_start(month), window_end(month)), F.lit(False))


def in_window(date: Column, start: Column, end: Column, null_passes: bool) -> Column:
    return F.coalesce(date.between(start, end), F.lit(null_passes))


def best_harvest_date(dates: Column, stamp: Column, start: Column, end: Column) -> Column:
    """First date in the window, else the stamp if it is in it, else the first date."""
    inside = F.try_element_at(F.filter(dates, lambda d: d.between(start, end)), F.lit(1))
    first = F.try_element_at(F.filter(dates, lambda d: d.isNotNull()), F.lit(1))
    return F.coalesce(inside, F.when(stamp.between(start, end), stamp), first, stamp)


def date_of_filename(name: Column) -> Column:
    """A yyyy-mm-dd, yyyymmdd or yyyy-mm in a file name; impossible dates are null."""
    full = F.regexp_extract(name, "((?:19|20)\\d{2})[-_]?(\\d{2})[-_]?(\\d{2})", 0)
    part = lambda p, k: F.try_to_number(F.nullif(F.regexp_extract(name, p, k), F.lit("")), F.lit("9999")).cast("int")
    day = "((?:19|20)\\d{2})[-_]?(\\d{2})[-_]?(\\d{2})"
    month = "((?:19|20)\\d{2})[-_](\\d{2})"
    return F.when(full != "", date_of_parts(part(day, 1), part(day, 2), part(day, 3))).otherwise(date_of_parts(part(month, 1), part(month, 2), F.lit(1)))
