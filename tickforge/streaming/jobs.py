"""Streaming tables and windowed aggregation into an upsert sink.

State lives in Spark's state store and offsets in its checkpoint, so a job
resumes exactly where it stopped; results are upserted by key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tickforge.functions.ticks import from_nanos

TRIGGER = "6 seconds"


@dataclass(frozen=True)
class StreamTable:
    """A streaming view: files of a table, its event-time column and how late rows may come."""

    path: str
    schema: StructType
    event_time: str
    delay: str = "0 seconds"
    fmt: str = "parquet"
    nanos: str | None = None  # a column of nanoseconds that stands for the event time

    def __post_init__(self) -> None:
        if self.nanos is not None:
            return
        if self.event_time not in self.schema.names:
            raise ValueError("the event-time column is not in the table")
        if self.schema[self.event_time].dataType.typeName() not in ("timestamp", "timestamp_ntz"):
            raise ValueError("the event-time column must be a timestamp")

    def read(self, spark: SparkSession) -> DataFrame:
        pattern = f"{self.path[:-1]}[{self.path[-1]}]"  # a pattern, as a stream takes no single file by its plain name
        stream = spark.readStream.format(self.fmt).schema(self.schema).load(pattern)
        if self.nanos is not None:
            stream = stream.select(from_nanos(F.col(self.nanos)).alias(self.event_time), *(c for c in self.schema.names if c != self.nanos))
        return stream.withColumn(self.event_time, F.col(self.event_time).cast("timestamp_ltz")).withWatermark(self.event_time, self.delay)


def windowed(stream: DataFrame, time: str, width: str, keys: list[str], aggregates: list[Column], slide: str | None = None) -> DataFrame:
    """One windowed aggregation of a stream, with the window's bounds as columns."""
    w = F.window(time, width, slide or width)
    counted = stream.groupBy(w.alias("w"), *keys).agg(*aggregates)
    values = counted.columns[1 + len(keys) :]
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), *keys, *values)


REFUSED = {"Join": "joins", "GlobalLimit": "limits", "LocalLimit": "limits", "Sort": "sorting"}


def check_stream(df: DataFrame) -> None:
    """Refuse what a stream job may not hold: joins, limits, sorting, more than one aggregation."""
    plan = df._jdf.queryExecution().analyzed().toString()
    nodes = [line.lstrip(" :+-~").split(" ")[0] for line in plan.split("\n")]
    for node in nodes:
        if node in REFUSED:
            raise ValueError(f"{REFUSED[node]} are not supported on streams")
    if nodes.count("Aggregate") > 1:
        raise ValueError("a stream takes one aggregation")


def upsert_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps every version of a key with its batch number; :func:`read_upserts` takes the newest.

    Writing a batch again replaces that batch only, so a replay after a failure changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "__batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "__batch").alias("v"))
    return newest.select(*keys, "v.*")


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, name: str | None = None) -> StreamingQuery:
    """Run a stream in update mode; ``once`` handles what is there and stops."""
    check_stream(df)
    writer = df.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()


def show_queries(spark: SparkSession) -> list[tuple[str, str | None, bool]]:
    return [(q.id, q.name, q.isActive) for q in spark.streams.active]


def kill_query(spark: SparkSession, query_id: str) -> None:
    spark.streams.get(query_id).stop()
