"""Time. Broadcast times are UTC; posted_at is the wall clock at UTC+9, kept as it is; no function reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE

# The names of the days from Sunday, and the texts of ages in minutes, hours and days.
WEEKDAYS = ("일", "월", "화", "수", "목", "금", "토")
AGES = ("방금", "분 전", "시간 전", "일 전")


def _as_column(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def broadcast_day(ts: Column) -> Column:
    """The broadcast day, a date, that a UTC time falls in: it runs from 06:00 to 06:00 at UTC+9, so from 21:00 UTC of the day before."""
    return (ts.cast("timestamp_ntz") + F.expr("INTERVAL 3 HOURS")).cast("date")


def day_bounds(as_of, offset=0) -> tuple[Column, Column]:
    """Start (inclusive) and end (exclusive), in UTC, of the broadcast day `offset` days after that of as_of."""
    day = F.date_add(broadcast_day(_as_column(as_of)), offset)
    start = day.cast("timestamp_ntz") - F.expr("INTERVAL 3 HOURS")
    return start, start + F.expr("INTERVAL 1 DAY")


def day_label(day: Column, names: tuple[str, ...] = WEEKDAYS) -> Column:
    """struct<date, day_name> of a date."""
    return F.struct(F.date_format(day, "yyyy-MM-dd").alias("date"), F.element_at(F.array(*map(F.lit, names)), F.dayofweek(day)).alias("day_name"))


def parse_iso(text: Column) -> Column:
    """An ISO time in UTC, cut to whole seconds; null, empty or unreadable gives null."""
    return F.date_trunc("second", F.try_to_timestamp(F.nullif(text, F.lit("")))).cast("timestamp_ntz")


def to_iso(ts: Column) -> Column:
    """yyyy-MM-ddTHH:mm:ss.SSSZ of a UTC time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def compose_local(date: Column, time: Column) -> Column:
    """The UTC time of a date and a time at UTC+9; null if either is missing, empty or unreadable."""
    local = F.try_to_timestamp(F.concat_ws(" ", F.nullif(date, F.lit("")), F.nullif(time, F.lit(""))))
    ready = F.nullif(date, F.lit("")).isNotNull() & F.nullif(time, F.lit("")).isNotNull()
    return F.when(ready, local.cast("timestamp_ntz") - F.expr("INTERVAL 9 HOURS"))


def local_date(as_of) -> Column:
    """The date at UTC+9."""
    return (_as_column(as_of) + F.expr("INTERVAL 9 HOURS")).cast("date")


def to_local(ts: Column) -> Column:
    """A UTC time on the clock at UTC+9."""
    return ts + F.expr("INTERVAL 9 HOURS")


def short_date(ts: Column, zone: str = "UTC") -> Column:
    """MM.dd HH:mm of a UTC time in a zone."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "MM.dd HH:mm")


def minutes_since(ts: Column, as_of) -> Column:
    return F.floor(F.timestamp_diff("SECOND", ts, _as_column(as_of)) / 60)


def time_ago(ts: Column, as_of, ages: tuple[str, str, str, str] = AGES) -> Column:
    """Just now, or whole minutes, hours or days with their word."""
    minutes = minutes_since(ts, as_of)
    number = lambda n: F.floor(minutes / n).cast("string")
    return (
        F.when(ts.isNull(), None)
        .when(minutes < 1, ages[0])
        .when(minutes < 60, F.concat(number(1), F.lit(ages[1])))
        .when(minutes < 1440, F.concat(number(60), F.lit(ages[2])))
        .otherwise(F.concat(number(1440), F.lit(ages[3])))
    )


def is_fresh(ts: Column, as_of, hours: int = 3) -> Column:
    return ts > _as_column(as_of) - F.expr(f"INTERVAL {hours} HOURS")


def within(ts: Column, as_of, days: int = 3) -> Column:
    """Not older than `days`; the two clocks are compared as they are."""
    return ts >= _as_column(as_of) - F.expr(f"INTERVAL {days} DAYS")


def synthetic_key(as_of) -> Column:
    """Milliseconds since 1970, the post number of schedules added by hand."""
    return F.unix_millis(_as_column(as_of).cast("timestamp"))


def day_offset(text: Column) -> Column:
    """The whole number that a text starts with; 0 if there is none."""
    return F.coalesce(F.try_to_number(F.regexp_extract(text, rf"^[{WHITE}]*([+-]?\d{{1,9}})", 1), F.lit("S999999999")).cast("int"), F.lit(0))
