"""Time as integer ticks.

Spark's timestamps count microseconds; series stored at nanosecond precision keep
an exact ``BIGINT`` column of ticks.  All time arithmetic of the engine runs on
ticks, so both kinds behave alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"ns": 1e-3, "us": 1, "ms": 1_000}


def micros(time: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp of either kind (session in UTC)."""
    c = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(c.cast("timestamp_ltz"))


def from_micros(ticks: Column) -> Column:
    """The timestamp without zone for microseconds since the epoch."""
    return F.timestamp_micros(ticks).cast("timestamp_ntz")


def from_nanos(ticks: Column) -> Column:
    """The timestamp for nanoseconds since the epoch, cut to microseconds (rounded down)."""
    return from_micros(F.floor(ticks / F.lit(1000).cast("decimal(20,0)")).cast("long"))


def seconds_ticks(text: str) -> int:
    """Microseconds of a width such as ``10 minutes``; months and years have no fixed width and are refused."""
    unit = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
    number, _, name = text.strip().partition(" ")
    name = name.strip().lower().rstrip("s")
    if name in ("month", "year"):
        raise ValueError("a window needs a width of fixed length, not months or years")
    if name not in unit:
        raise ValueError(f"unknown unit of time: {text!r}")
    return int(float(number) * unit[name])
