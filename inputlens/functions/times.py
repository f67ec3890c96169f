"""Time expressions. Instants are TIMESTAMP; results hold in any session time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(value: Column | dt.datetime | str) -> Column:
    """An "as of" argument as a column: a column, a time, or ISO text."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds to timestamp, to the nearest microsecond; NaN, infinite and out-of-range values give null instead
    of an error."""
    return F.when(seconds.between(-6.2e10, 2.5e11), F.timestamp_micros(F.round(seconds * 1e6).cast("long")))


def parse_iso(text: Column) -> Column:
    """ISO time with Z, an offset, or neither (then UTC); null if it isn't one."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")


def local(ts: Column, tz: str) -> Column:
    """Wall-clock time in ``tz`` (no zone)."""
    return F.convert_timezone(F.current_timezone(), F.lit(tz), ts.cast("timestamp_ntz"))


def instant(wall: Column, tz: str) -> Column:
    """The instant of a wall-clock time in ``tz``."""
    return F.convert_timezone(F.lit(tz), F.current_timezone(), wall.cast("timestamp_ntz")).cast("timestamp")


def day_key(ts: Column, tz: str) -> Column:
    """yyyy-MM-dd in ``tz``."""
    return F.date_format(local(ts, tz), "yyyy-MM-dd")


def midnight(ts: Column, tz: str) -> Column:
    """Start of the local day of ``ts``."""
    return instant(local(ts, tz).cast("date"), tz)


def end_of_day(day: Column, tz: str) -> Column:
    """Exclusive end of a local day (a date or its key): 23, 24 or 25 hours after its start."""
    return instant(F.date_add(day.cast("date"), 1), tz)


def monday(day: Column) -> Column:
    """Monday of the week of a date."""
    return F.date_sub(day, F.weekday(day))


def bucket(ts: Column, width_s: int) -> Column:
    """Number of the bucket of ``width_s`` seconds since the epoch."""
    return F.floor(F.unix_micros(ts) / F.lit(width_s * 1_000_000)).cast("long")


def bucket_start(number: Column, width_s: int) -> Column:
    return F.timestamp_seconds(number * F.lit(width_s))


def gap_us(later: Column, earlier: Column) -> Column:
    """Whole microseconds between two timestamps."""
    return F.unix_micros(later) - F.unix_micros(earlier)


def duration_minutes(start: Column, end: Column, live: Column, as_of: Column) -> Column:
    """Length of a session in minutes, 1 at least: rounded when over, counting up (floored) while live."""
    over = F.round(gap_us(end, start) / 60_000_000)
    running = F.floor(gap_us(as_of, start) / 60_000_000)
    return F.greatest(F.lit(1), F.when(live, running).otherwise(over).cast("long"))


def staleness(newest: Column, as_of: Column, pending_after: int = 30) -> tuple[Column, Column]:
    """Minutes since ``newest``, rounded, and whether a batch run is overdue."""
    minutes = F.round(gap_us(as_of, newest) / 60_000_000).cast("long")
    return minutes, minutes > pending_after
