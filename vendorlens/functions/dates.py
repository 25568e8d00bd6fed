"""UTC calendar columns that do not depend on the session time zone."""

from pyspark.sql import Column, functions as F

DAY_MS = 86_400_000


def utc_day(ms: Column) -> Column:
    """Calendar day of epoch milliseconds."""
    return F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int"))


def utc_month(ms: Column) -> Column:
    return F.substring(utc_day(ms).cast("string"), 1, 7)


def day_start_ms(day: Column) -> Column:
    """Epoch milliseconds of UTC midnight of a day or ISO date text; null when unreadable."""
    return F.unix_date(day.try_cast("date")).cast("bigint") * DAY_MS
