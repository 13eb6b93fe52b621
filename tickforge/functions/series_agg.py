"""Aggregates over ordered points: first, last, increase, gauge and state.

Where Spark has no aggregate with bounded state, the points of a series are
ranked by a window (which spills) and only the few that matter are aggregated;
no series is collected into an array except the periods of ``state_agg``, which
are its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.ticks import micros


MAX_SAMPLE = 2000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first(time: Column | str, value: Column | str) -> Column:
    """The value at the smallest time; points without a value do not count."""
    return F.min_by(_c(value), F.when(_c(value).isNotNull(), _c(time)))


def last(time: Column | str, value: Column | str) -> Column:
    """The value at the largest time; points without a value do not count."""
    return F.max_by(_c(value), F.when(_c(value).isNotNull(), _c(time)))


def mode(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value per key, the smallest of equals; two aggregations, both combined before the shuffle."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(name))


def increase(df: DataFrame, keys: list[str], time: str, value: str, name: str = "increase") -> DataFrame:
    """The sum of rises of a counter per key; after a reset the new value counts in full."""
    w = Window.partitionBy(*keys).orderBy(time)
    steps = df.where(F.col(value).isNotNull() & F.col(time).isNotNull()).withColumn("__before", F.lag(value).over(w))
    v, b = F.col(value), F.col("__before")
    step = F.when(b.isNull() | (v == b), F.lit(0).cast(df.schema[value].dataType)).when(v > b, v - b).otherwise(v)
    return steps.groupBy(*keys).agg(F.sum(step).alias(name))


def sample(df: DataFrame, keys: list[str], value: str, k: int, name: str = "sample", seed: int | None = None) -> DataFrame:
    """``k`` random values per key (1 to 2000) as an array: the smallest random numbers, cut before the shuffle."""
    if not 0 < k <= MAX_SAMPLE:
        raise ValueError(f"k must be from 1 to {MAX_SAMPLE}")
    w = Window.partitionBy(*keys).orderBy("__r")
    picked = df.where(F.col(value).isNotNull()).select(*keys, value, F.rand(seed).alias("__r")).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k)
    return picked.groupBy(*keys).agg(F.collect_list(value).alias(name))


_POINTS = ("first", "second", "penultimate", "last")


def gauge_agg(df: DataFrame, keys: list[str], time: str, value: str, name: str = "gauge", ticks: bool = False) -> DataFrame:
    """Per key ``struct<first, second, penultimate, last: struct<ts, val>, num_elements>``; ``ts`` in ticks.

    A series of one point has all four equal.
    """
    t = F.col(time).cast("long") if ticks else micros(time)
    points = df.where(F.col(value).isNotNull() & F.col(time).isNotNull()).select(*keys, t.alias("__t"), F.col(value).cast("double").alias("__v"))
    up = Window.partitionBy(*keys).orderBy("__t", "__v")
    ranked = points.withColumn("__i", F.row_number().over(up)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    edge = ranked.where((F.col("__i") <= 2) | (F.col("__i") >= F.col("__n") - 1))
    point = F.struct(F.col("__t").alias("ts"), F.col("__v").alias("val"))
    place = {"first": F.lit(1), "second": F.least(F.lit(2), F.col("__n")), "penultimate": F.greatest(F.lit(1), F.col("__n") - 1), "last": F.col("__n")}
    return edge.groupBy(*keys).agg(F.struct(*(F.max(F.when(F.col("__i") == place[p], point)).alias(p) for p in _POINTS), F.max("__n").alias("num_elements")).alias(name))


def delta(g: str) -> Column:
    return F.col(f"{g}.last.val") - F.col(f"{g}.first.val")


def time_delta(g: str) -> Column:
    """In ticks; ``make_dt_interval`` or a timestamp difference show it as an interval."""
    return F.col(f"{g}.last.ts") - F.col(f"{g}.first.ts")


def rate(g: str) -> Column:
    """Change per tick; null if no time passes."""
    return F.when(time_delta(g) != 0, delta(g) / time_delta(g))


def first_time(g: str) -> Column:
    return F.col(f"{g}.first.ts")


def first_val(g: str) -> Column:
    return F.col(f"{g}.first.val")


def last_time(g: str) -> Column:
    return F.col(f"{g}.last.ts")


def last_val(g: str) -> Column:
    return F.col(f"{g}.last.val")


def idelta_left(g: str) -> Column:
    return F.col(f"{g}.second.val") - F.col(f"{g}.first.val")


def idelta_right(g: str) -> Column:
    return F.col(f"{g}.last.val") - F.col(f"{g}.penultimate.val")


def _spells(df: DataFrame, keys: list[str], time: str, state: str, ticks: bool) -> DataFrame:
    """Maximal stretches of one state: ``(keys, state, start, end)``; the last point of a series opens none."""
    t = F.col(time).cast("long") if ticks else micros(time)
    points = df.where(F.col(state).isNotNull() & F.col(time).isNotNull()).select(*keys, t.alias("start"), F.col(state).alias("state"))
    w = Window.partitionBy(*keys).orderBy("start", "state")
    changes = points.withColumn("__b", F.lag("state").over(w)).withColumn("__end", F.max("start").over(Window.partitionBy(*keys))).where(F.col("__b").isNull() | (F.col("__b") != F.col("state")))
    return changes.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("__end"))).select(*keys, "state", "start", "end")


def state_agg(df: DataFrame, keys: list[str], time: str, state: str, name: str = "states", ticks: bool = False, compact: bool = False) -> DataFrame:
    """Per key an array of ``struct<state, duration[, periods]>``, sorted by state; durations and periods in ticks."""
    spells = _spells(df, keys, time, state, ticks)
    per = spells.groupBy(*keys, "state").agg(F.sum(F.col("end") - F.col("start")).alias("duration"), *([] if compact else [F.array_sort(F.collect_list(F.struct("start", "end"))).alias("periods")]))
    fields = ["state", "duration"] + ([] if compact else ["periods"])
    return per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def duration_in(states: str, state: Column | str | object, start: int | Column | None = None, interval: int | Column | None = None) -> Column:
    """Time spent in ``state``; with ``start`` (and ``interval``) only what overlaps ``[start, start + interval)``."""
    want = state if isinstance(state, Column) else F.lit(state)
    mine = F.filter(F.col(states), lambda s: s["state"] == want)
    zero = F.lit(0).cast("long")
    if start is None:
        return F.coalesce(F.aggregate(mine, zero, lambda a, s: a + s["duration"]), zero)
    low = start if isinstance(start, Column) else F.lit(start)
    high = None if interval is None else low + (interval if isinstance(interval, Column) else F.lit(interval))
    periods = F.flatten(F.transform(mine, lambda s: s["periods"]))
    return F.coalesce(F.aggregate(periods, zero, lambda a, p: a + F.greatest(zero, (p["end"] if high is None else F.least(p["end"], high)) - F.greatest(p["start"], low))), zero)


def state_at(states: str, at: int | Column) -> Column:
    """The state whose period ``[start, end)`` holds ``at``; null outside."""
    t = at if isinstance(at, Column) else F.lit(at)
    held = F.filter(F.col(states), lambda s: F.exists(s["periods"], lambda p: (p["start"] <= t) & (t < p["end"])))
    return F.get(F.transform(held, lambda s: s["state"]), 0)


def exact_count(value: Column | str) -> Column:
    """A count that is never answered from statistics; here any count is exact."""
    return F.count(value)
