"""Date/time helpers.

All timestamps are TIMESTAMP_NTZ (wall clock, no zone); durations in days are
fractional and computed from whole microseconds, so both sides of the oracle
start from the same exact integer.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_DAY = 86_400_000_000


def ts_lit(value: str) -> Column:
    """A TIMESTAMP_NTZ literal from 'YYYY-MM-DD[ HH:MM:SS]' (constant-folded)."""
    return F.lit(value).cast("timestamp_ntz")


def date_lit(value: str) -> Column:
    return F.lit(_dt.date.fromisoformat(value))


def micros_between(start: Column, end: Column) -> Column:
    """end - start in whole microseconds (NULL if either side is NULL)."""
    return F.timestamp_diff("MICROSECOND", start, end)


def days_between(start: Column, end: Column) -> Column:
    """end - start in fractional days, like a Julian-day difference."""
    return micros_between(start, end) / F.lit(float(US_PER_DAY))


def in_half_open(ts: Column, lo: str | None, hi: str | None) -> Column:
    """lo <= ts < hi. A date-only upper bound excludes that whole day, which is
    what comparing text timestamps against a date string did in the reference."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (ts >= ts_lit(lo))
    if hi is not None:
        cond = cond & (ts < ts_lit(hi))
    return cond


def weekday_sun0(ts: Column) -> Column:
    """Weekday number with Sunday = 0 ... Saturday = 6."""
    return F.dayofweek(ts) - 1


def weekday_abbrev(ts: Column) -> Column:
    """Three-letter English weekday name ('Sun', 'Mon', ...)."""
    return F.date_format(ts, "EEE")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def day_number(ts: Column, epoch: str) -> Column:
    """Whole days from ``epoch`` to the calendar day of ``ts``."""
    return F.datediff(F.to_date(ts), date_lit(epoch))


def days_between_dates(a: str, b: str) -> int:
    """b - a in days for two ISO dates, folded on the driver (a constant)."""
    return (_dt.date.fromisoformat(b) - _dt.date.fromisoformat(a)).days
