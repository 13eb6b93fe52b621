"""Kernels applied per series: data-quality scores, time and value repair, value filling.

Each series (the rows of one key) is one group where an algorithm follows the
order of a whole series, and is held by one Python worker; key by the tags that identify a series.  The fills
``mean``, ``previous`` and ``linear``, and :func:`validity`, are window expressions and
aggregations and have no such bound.
"""

from __future__ import annotations

from typing import Any
from urllib.parse import parse_qsl

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tickforge.functions import kernels as K
from tickforge.functions.ticks import micros


def parse_options(text: str | None, known: dict[str, type]) -> dict[str, object]:
    """The options of a call such as ``method=median&start_mode=mode``; unknown and repeated keys are refused."""
    out: dict[str, object] = {}
    for key, value in parse_qsl(text or "", keep_blank_values=True, strict_parsing=bool(text)):
        if key not in known:
            raise ValueError(f"Fail to parse argument: unknown field `{key}`")
        if key in out:
            raise ValueError(f"Fail to parse argument: duplicate field `{key}`")
        out[key] = known[key](value)
    return out


def _points(df: DataFrame, keys: list[str], time: str, value: str, ticks: bool) -> DataFrame:
    t = F.col(time).cast("long") if ticks else micros(time)
    key = [F.col(k) for k in keys] or [F.lit(0).alias("__all")]
    return df.where(F.col(time).isNotNull()).select(*key, t.alias("t"), F.col(value).cast("double").alias("v"))


def _keys_ddl(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def data_quality(df: DataFrame, keys: list[str], time: str, value: str, ticks: bool = False) -> DataFrame:
    """``completeness, consistency, timeliness, validity`` per series; rows without a value are left out."""

    points = _points(df, keys, time, value, ticks).where("v is not null")
    scored = points.groupBy(*(keys or ["__all"])).agg(_SCORE("t", "v").alias("__q"))
    return scored.select(*keys, *(F.col("__q")[i].alias(name) for i, name in enumerate(QUALITY)))


def validity(df: DataFrame, keys: list[str], time: str, value: str, ticks: bool = False) -> DataFrame:
    """The validity score per series, by windows and medians; rows without a value are left out.

    A quarter of the share of outliers (further than three scaled median deviations from the median)
    among values, steps, speeds and changes of speed is taken from 1.  Values that are not finite
    are replaced on the line through their neighbours; a series without two finite values has the score NULL.
    """
    key = keys or ["__all"]
    p = _points(df, keys, time, value, ticks).where("v is not null")
    order = Window.partitionBy(*key).orderBy("t", "v")
    # the two finite points that the line goes through: one on each side, or beyond the ends the two nearest
    good = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.struct("t", "v"))
    p = p.withColumn("g", good)
    # what follows is what precedes in descending order: a frame without end would be computed anew for each row
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key).orderBy(F.desc("t"), F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    finite = F.count("g").over(Window.partitionBy(*key))
    p = p.withColumns({"a": F.last("g", True).over(before), "b": F.last("g", True).over(after), "n": F.count("*").over(Window.partitionBy(*key)), "finite": finite})
    p = p.withColumns({"a2": F.last(F.when(F.col("g").isNotNull(), F.col("a")), True).over(before), "b2": F.last(F.when(F.col("g").isNotNull(), F.col("b")), True).over(after)})
    one, two = F.coalesce(F.when(F.col("b").isNull(), F.col("a2")).otherwise(F.col("a")), F.col("b")), F.when(F.col("a").isNull(), F.col("b2")).otherwise(F.coalesce("b", "a"))
    line = one["v"] + (two["v"] - one["v"]) * ((F.col("t") - one["t"]) / (two["t"] - one["t"]))
    p = p.where("finite >= 2").select(*key, "t", "n", F.when(F.col("g").isNotNull(), F.col("v")).otherwise(line).alias("v"))
    order = Window.partitionBy(*key).orderBy("t", "v")
    p = p.withColumns({"dv": F.col("v") - F.lag("v").over(order), "dt": F.col("t") - F.lag("t").over(order)})
    p = p.withColumn("sp", F.when(F.col("dt") != 0, F.col("dv") / F.col("dt")))
    p = p.withColumn("ds", F.col("sp") - F.lag("sp").over(order))
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), F.col(c).alias("x")) for i, c in enumerate(("v", "dv", "sp", "ds"))))
    long = p.select(*key, "n", F.explode(kinds).alias("m")).select(*key, "n", "m.*").where("x is not null")
    # medians per series and kind: two aggregations, joined back by series
    middle = long.groupBy(*key, "kind").agg(F.median("x").alias("mid"), F.first("n").alias("n"))
    away = long.drop("n").join(middle, [*key, "kind"]).withColumn("away", F.abs(F.col("x") - F.col("mid")))
    spread = away.groupBy(*key, "kind").agg(F.median("away").alias("mad"))
    bad = away.join(spread, [*key, "kind"]).groupBy(*key).agg(F.sum(F.when(F.col("away") > 3.0 * K.MAD_FACTOR * F.col("mad"), 1).otherwise(0)).alias("bad"), F.first("n").alias("n"))
    scores = bad.select(*key, (1.0 - 0.25 * F.col("bad") / F.col("n")).alias("validity"))
    every = _points(df, keys, time, value, ticks).where("v is not null").select(*key).distinct()
    return every.join(scores, key, "left").select(*keys, "validity")


def _generated(df: DataFrame, keys: list[str], time: str, value: str, ticks: bool, work) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        t, v = work(pdf["t"].to_numpy(np.int64), pdf["v"].to_numpy(np.float64))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(t) for k in keys}, "time": t, "value": v})

    return _points(df, keys, time, value, ticks).groupBy(*(keys or ["__all"])).applyInPandas(run, _keys_ddl(df, keys) + "time long, value double")


def timestamp_repair(df: DataFrame, keys: list[str], time: str, value: str, options: str | None = None, ticks: bool = False, ticks_per_ms: int = 1000) -> DataFrame:
    """Points moved onto a regular grid; ``time`` in ticks.  Options: ``method``, ``interval`` (ms), ``start_mode``."""
    o = parse_options(options, {"method": str, "interval": int, "start_mode": str})
    interval = None if "interval" not in o else int(o["interval"]) * ticks_per_ms
    return _generated(df, keys, time, value, ticks, lambda t, v: K.repair_times(t, v, str(o.get("method", "median")).lower(), interval, str(o.get("start_mode", "mode")).lower(), 100_000 * ticks_per_ms))


def value_fill(df: DataFrame, keys: list[str], time: str, value: str, options: str | None = None, ticks: bool = False) -> DataFrame:
    """Gaps (null or NaN) filled by place in the series.  Option: ``method``."""
    method = str(parse_options(options, {"method": str}).get("method", "linear")).lower()
    if method in ("mean", "previous", "linear"):
        return fill_by_window(df, keys, time, value, method, ticks)
    return _generated(df, keys, time, value, ticks, lambda t, v: (t, K.fill_values(v, method)))


def fill_by_window(df: DataFrame, keys: list[str], time: str, value: str, method: str, ticks: bool = False) -> DataFrame:
    """The fills that need no Python: windows over the series."""
    key = keys or ["__all"]
    p = _points(df, keys, time, value, ticks)
    good = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    order = Window.partitionBy(*key).orderBy("t")
    before, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    after = Window.partitionBy(*key).orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0)
    if method == "mean":
        out = F.coalesce(good, F.avg(good).over(whole))
    elif method == "previous":
        out = F.coalesce(F.last(good, True).over(before), F.lit(float("nan")))
    else:
        p = p.withColumn("__i", F.row_number().over(order))
        at = F.when(good.isNotNull(), F.struct("__i", "v"))
        left, right = F.last(at, True).over(before), F.last(at, True).over(after)
        p = p.withColumns({"__l": left, "__r": right})
        a, b = F.col("__l"), F.col("__r")
        line = a["v"] + (b["v"] - a["v"]) * ((F.col("__i") - a["__i"]) / (b["__i"] - a["__i"]))
        out = F.coalesce(F.when(good.isNotNull(), F.col("v")), F.when(a.isNotNull() & b.isNotNull(), line), a["v"], b["v"], F.lit(float("nan")))
    return p.select(*keys, F.col("t").alias("time"), out.alias("value"))


def value_repair(df: DataFrame, keys: list[str], time: str, value: str, options: str | None = None, ticks: bool = False) -> DataFrame:
    """Values repaired by ``screen`` (speed limits) or ``lsgreedy``.  Options: ``method, min_speed, max_speed, center, sigma``."""
    o = parse_options(options, {"method": str, "min_speed": float, "max_speed": float, "center": float, "sigma": float})
    method = str(o.get("method", "screen")).lower()
    if method == "screen":
        work = lambda t, v: (t, K.repair_screen(t, v, o.get("min_speed"), o.get("max_speed")))
    elif method == "lsgreedy":
        work = lambda t, v: (t, K.repair_greedy(t, v, o.get("center", 0.0), o.get("sigma")))
    else:
        raise ValueError(f"Invalid method: {method}")
    return _generated(df, keys, time, value, ticks, work)


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, p: float, name: str = "percentile") -> DataFrame:
    """The value at share ``p`` of the total weight: running weights over the ordered values, no collection."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).withColumn("__v", F.col(value).cast("double"))
    key = keys or ["__all"]
    rows = rows if keys else rows.withColumn("__all", F.lit(0))
    order = Window.partitionBy(*key).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("__run", F.sum(weight).over(order)).withColumn("__total", F.sum(weight).over(Window.partitionBy(*key)))
    return run.where(F.col("__run") >= F.col("__total") * p).groupBy(*key).agg(F.min("__v").alias(name)).select(*keys, name)


QUALITY = ("completeness", "consistency", "timeliness", "validity")


def _scores(t: pa.Array, v: pa.Array) -> Any:
    """The scores of :data:`QUALITY`, in that order, of points in any order; those without a time or a value do not count.

    One call makes all four, and the points are copied once, to sort them: a series may be long.
    """
    if t.null_count or v.null_count:
        keep = pc.and_(t.is_valid(), v.is_valid())
        t, v = t.filter(keep), v.filter(keep)
    times, values = t.to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False)
    if (times[1:] < times[:-1]).any():
        order = np.argsort(times, kind="stable")
        times, values = times[order], values[order]
        del order
    found = K.quality(times, values)
    return [found[name] for name in QUALITY]


_SCORE = F.arrow_udf(_scores, ArrayType(DoubleType()))


def register(spark: SparkSession) -> None:
    """The quality scores as one SQL aggregate ``tf_quality(ticks, value)``, an array in the order of :data:`QUALITY`."""
    spark.udf.register("tf_quality", _SCORE)
