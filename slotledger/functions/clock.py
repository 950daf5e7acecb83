"""Time windows and calendar parts.

Calendar parts are taken from epoch seconds, so they are UTC whatever the
session time zone is, and stay inside code generation.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_PARTITION = "dt"


def resolve(as_of: datetime | None) -> datetime:
    """``as_of`` as an aware UTC time; the current time when it is not given."""
    if as_of is None:
        return datetime.now(timezone.utc)
    return as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)


def _day(time: datetime) -> Column:
    return F.lit(time.astimezone(timezone.utc).date())


def between(
    df: DataFrame,
    column: str,
    start: datetime | None,
    end: datetime | None,
    inclusive: bool = False,
) -> DataFrame:
    """Rows later than ``start`` (or from it on) and not later than ``end``; None is no bound.

    Day partitions are pruned where the table has them: the optimizer does not
    derive a filter on them from one on the time stamp.
    """
    time, by_day = F.col(column), DAY_PARTITION in df.columns
    if start is not None:
        bound = F.lit(start)
        df = df.where(time >= bound if inclusive else time > bound)
        if by_day:
            df = df.where(F.col(DAY_PARTITION) >= _day(start))
    if end is not None:
        df = df.where(time <= F.lit(end))
        if by_day:
            df = df.where(F.col(DAY_PARTITION) <= _day(end))
    return df


def last_days(
    df: DataFrame, column: str, as_of: datetime | None, days: int | None
) -> DataFrame:
    """Rows of the ``days`` up to ``as_of``, strictly later than the start.

    Without ``days`` there is no start, without both every row counts.
    """
    if days is None:
        return between(df, column, None, as_of and resolve(as_of))
    end = resolve(as_of)
    return between(df, column, end - timedelta(days=days), end)


def utc_date(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def utc_hour(ts: Column) -> Column:
    return F.pmod(epoch_hour(ts), F.lit(24)).cast("int")


def utc_minute(ts: Column) -> Column:
    """Start of the minute that holds ``ts``."""
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(60)))


def epoch_hour(ts: Column) -> Column:
    """Hours since the epoch."""
    return F.floor(F.unix_seconds(ts) / 3600)


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from ``start`` to ``end``, truncated toward zero."""
    return F.timestamp_diff("MILLISECOND", start, end)


def seconds_between(start: Column, end: Column) -> Column:
    return millis_between(start, end) / F.lit(1000.0)
