"""Time buckets, windows that hang on an explicit ``as_of``, and text forms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_FORMAT = "yyyy-MM-dd"


def moment(as_of: str | datetime | Column) -> Column:
    """``as_of`` as a UTC timestamp literal."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def interval(days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    return F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))


def within(ts: str | Column, as_of, **width: int) -> Column:
    """``as_of - width <= ts < as_of``; folds to two literals that reach the scan."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    end = moment(as_of)
    return (ts >= end - interval(**width)) & (ts < end)


def minute_of(ts: str) -> Column:
    return F.date_trunc("minute", F.col(ts))


def hour_of(ts: str) -> Column:
    return F.date_trunc("hour", F.col(ts))


def day_of(ts: str) -> Column:
    return F.to_date(F.col(ts))


def month_of(ts: str | Column) -> Column:
    """``yyyyMM`` as text, the partition value of the span table."""
    return F.date_format(ts, "yyyyMM")


def format_ts(ts: str | Column) -> Column:
    return F.date_format(ts, TS_FORMAT)


def format_date(ts: str | Column) -> Column:
    return F.date_format(ts, DATE_FORMAT)


def tick_of(ts: str | Column, step_seconds: int) -> Column:
    """End of the ``step_seconds`` bucket holding ``ts``, in epoch seconds."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = F.floor(F.unix_micros(ts) / F.lit(1_000_000 * step_seconds)) * step_seconds
    return (seconds + step_seconds).cast("long")
