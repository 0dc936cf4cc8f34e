"""Date and time functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def work_day(ts: Column, start_hour: int = 4) -> Column:
    """The date that a time belongs to, where days begin at start_hour."""
    return F.to_date(ts - F.make_dt_interval(hours=F.lit(start_hour)))


def cutoff(now: Column, days: int) -> Column:
    """now less so many calendar days; null, which nothing is older than, if days <= 0."""
    return (now - F.make_interval(days=F.lit(days))) if days > 0 else F.lit(None).cast("timestamp")


def backoff_seconds(attempts: Column) -> Column:
    """30 s, doubled per attempt after the first, an hour at most."""
    return F.least(F.lit(3600.0), 30 * F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1)) - 1)).cast("long")


def due_again(last: Column, every_days: int, now: Column) -> Column:
    """Whether a job that was last done at the time that `last` tells (text) is
    due: never done, no time, or `every_days` ago or longer."""
    at = F.try_to_timestamp(last)
    return at.isNull() | (at + F.make_interval(days=F.lit(every_days)) <= now)


def utc_text(ts: Column) -> Column:
    """A time as the tables write it: UTC, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
