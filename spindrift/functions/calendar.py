"""Days of instants given in microseconds, in UTC whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def date_of(us: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / DAY_US).cast("int"))


def day_of(us: Column) -> Column:
    return date_of(us).cast("string")


def week_of(day: Column) -> Column:
    """The Monday of a date's week."""
    return F.date_sub(day, F.weekday(day))


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp without time zone, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
