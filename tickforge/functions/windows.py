"""Tumbling and sliding windows in time, and bins.

A sliding window emits a row per window that holds it; both that and the
``compat`` reading are one ``explode`` of a short array, so no join is made and
the following aggregation combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.ticks import from_micros, micros, seconds_ticks

MAX_OVERLAP = 100
MAX_WIDTH = 365 * 86_400_000_000


def window_limits(width: str | int, slide: str | int | None, start: str | int | None) -> tuple[int, int, int]:
    """Width, slide and offset in microseconds, if they are within the limits of windows."""
    w = width if isinstance(width, int) else seconds_ticks(width)
    s = w if slide is None else slide if isinstance(slide, int) else seconds_ticks(slide)
    o = 0 if start is None else start if isinstance(start, int) else seconds_ticks(start)
    if not 0 < w <= MAX_WIDTH or s <= 0:
        raise ValueError("a window is longer than nothing and at most 365 days long")
    if -(-w // s) > MAX_OVERLAP:
        raise ValueError(f"at most {MAX_OVERLAP} windows may overlap")
    return w, s, o


def time_window(df: DataFrame, time: str, width: str | int, slide: str | int | None = None, start: str | int | None = None, name: str = "_window", mode: str = "contain", ticks: bool = False) -> DataFrame:
    """Add ``name`` = ``struct<start, end>``; a row appears once per window, rows without a time are dropped.

    ``mode='contain'`` emits exactly the windows with ``start <= t < end``.
    ``mode='compat'`` keeps every one of the ``ceil(width / slide)`` candidates of a
    row that its latest window contains, even those that end before it.  With
    ``ticks`` the time column holds integer ticks and so do the bounds.
    """
    if mode not in ("contain", "compat"):
        raise ValueError(f"unknown mode: {mode}")
    w, s, o = window_limits(width, slide, start)
    t = F.col(time).cast("long") if ticks else micros(time)
    origin = F.lit(o % w if mode == "compat" else o % s)
    latest = t - F.pmod(t - origin, F.lit(s))
    bound = (lambda c: c) if ticks else from_micros
    windows = F.transform(F.sequence(F.lit(0), F.lit(-(-w // s) - 1)), lambda i: (latest - i * F.lit(s)).alias("a"))
    if mode == "contain":
        windows = F.filter(windows, lambda a: a + F.lit(w) > t)
    else:
        windows = F.when(latest + F.lit(w) > t, windows)
    rows = df.where(F.col(time).isNotNull())
    if s == w:
        return rows.withColumn(name, F.struct(bound(latest).alias("start"), bound(latest + w).alias("end")))
    return rows.withColumn("__a", F.explode(windows)).withColumn(name, F.struct(bound(F.col("__a")).alias("start"), bound(F.col("__a") + w).alias("end"))).drop("__a")


def date_bin(width: str | int, time: Column | str, origin: int = 0) -> Column:
    """The start of the bin of ``width`` that holds ``time``; bins are counted from ``origin`` (microseconds)."""
    w = width if isinstance(width, int) else seconds_ticks(width)
    t = micros(time)
    return from_micros(t - F.pmod(t - F.lit(origin), F.lit(w)))


def gap_fill(df: DataFrame, keys: list[str], time: str, width: str | int, aggregates: list[Column]) -> DataFrame:
    """Aggregate per key and bin and add the empty bins between a key's first and last (an extension)."""
    w = width if isinstance(width, int) else seconds_ticks(width)
    bins = df.withColumn("bin", date_bin(w, time)).groupBy(*keys, "bin").agg(*aggregates)
    span = bins.groupBy(*keys).agg(F.min(micros("bin")).alias("a"), F.max(micros("bin")).alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b", F.lit(w))).alias("t")).select(*keys, from_micros(F.col("t")).alias("bin"))
    return grid.join(bins, [*keys, "bin"], "left")
