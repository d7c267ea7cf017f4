"""Date expressions on timestamps without a time zone."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_month(month: int) -> None:
    """V3: a month outside 1..12 always raises."""
    if not 1 <= month <= 12:
        raise ValueError(f"month must be between 1 and 12, got {month}")


def month_limits(year: int, month: int) -> tuple[dt.datetime, dt.datetime]:
    """F4 for plain arguments: the first and the last second of the month."""
    check_month(month)
    last = calendar.monthrange(year, month)[1]
    return dt.datetime(year, month, 1), dt.datetime(year, month, last, 23, 59, 59)


def ntz(moment: dt.datetime) -> Column:
    """A literal without a time zone, whatever the session's zone is."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def month_start(year: Column, month: Column) -> Column:
    """F4 for columns; an impossible month raises in ANSI mode."""
    return F.make_date(year, month, F.lit(1)).cast("timestamp_ntz")


def month_end(year: Column, month: Column) -> Column:
    """F4 for columns: 23:59:59 of the last day."""
    last = F.last_day(F.make_date(year, month, F.lit(1))).cast("timestamp_ntz")
    return last + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def month_name(year: Column, month: Column) -> Column:
    """the full English name of the month."""
    return F.date_format(F.make_date(year, month, F.lit(1)), "MMMM")


def iso_text(timestamp: Column) -> Column:
    """ISO text; a fraction of a second is shown only where there is one."""
    text = F.translate(timestamp.cast("timestamp_ntz").cast("string"), " ", "T")
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)
