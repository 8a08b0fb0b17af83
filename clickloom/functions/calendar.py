"""Calendar and epoch parts of the click time. All follow the wall clock, whatever the session time zone."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.schema import CONTEST_ORIGIN


def day_of_week(ts: Column) -> Column:
    """0 = Monday."""
    return F.weekday(ts)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def epoch_seconds(ts: Column, origin: dt.datetime = CONTEST_ORIGIN) -> Column:
    """Whole seconds since `origin`, rounded down (negative before it)."""
    origin_second = origin.hour * 3600 + origin.minute * 60 + origin.second
    days = F.datediff(F.to_date(ts), F.lit(origin.date()))
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return days.cast("bigint") * 86400 + second - origin_second


def epoch_between(ts: Column, low: int | None = None, high: int | None = None, origin: dt.datetime = CONTEST_ORIGIN) -> Column:
    """True where the whole seconds since `origin` are in [low, high]: a range of the time itself, which scans take as a filter."""
    at = lambda s: F.lit((origin + dt.timedelta(seconds=s)).isoformat(sep=" ")).cast("timestamp_ntz")
    bounds = ([ts >= at(low)] if low is not None else []) + ([ts < at(high + 1)] if high is not None else [])
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def with_calendar(df: DataFrame, ts: str = "click_time") -> DataFrame:
    return df.withColumns({"dayofweek": day_of_week(F.col(ts)), "hourofday": hour_of_day(F.col(ts))})


def with_epoch(df: DataFrame, ts: str = "click_time", origin: dt.datetime = CONTEST_ORIGIN) -> DataFrame:
    return df.withColumn("epoch_time", epoch_seconds(F.col(ts), origin))


def minute_parts(epoch: Column) -> dict[str, Column]:
    """`seconds`, `epoch_minute`, `minutes`, rounding down so that they stay in range before the origin."""
    epoch_minute = F.floor(epoch / 60)
    return {
        "seconds": F.pmod(epoch, F.lit(60)).cast("int"),
        "epoch_minute": epoch_minute,
        "minutes": F.pmod(epoch_minute, F.lit(60)).cast("int"),
    }


def time_details(df: DataFrame, ts: str = "click_time", origin: dt.datetime = CONTEST_ORIGIN) -> DataFrame:
    """Epoch second and its minute parts, in one call."""
    return with_epoch(df, ts, origin).withColumns(minute_parts(F.col("epoch_time")))


def time_bucket(epoch: Column, seconds: int) -> Column:
    """Epoch time on a coarser grain."""
    return F.floor(epoch / seconds)
