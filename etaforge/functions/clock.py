"""Time arithmetic on `timestamp` columns (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 6e7
SECONDS_PER_DAY = 86_400


def elapsed_minutes(start: Column, end: Column) -> Column:
    """Minutes from `start` to `end`, exact to the microsecond."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(MICROS_PER_MINUTE)


def floor_second(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts).cast("long")


def day_of_week(ts: Column) -> Column:
    """0 is Monday, 6 is Sunday."""
    return F.weekday(ts).cast("long")


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def parse_iso(text: Column) -> Column:
    """ISO date or date-time text to timestamp; NULL, not an error, for anything else. A year, a
    month or a time alone is no date."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text))


def format_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * 1_000_000)
