"""The time-series data model: roles of columns, upsert reads, series, deletes and updates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISIONS = ("ns", "us", "ms")


@dataclass(frozen=True)
class SeriesTable:
    """A table with one time column, tags that name a series, and fields."""

    name: str
    tags: tuple[str, ...]
    fields: dict[str, str] = field(default_factory=dict)
    time: str = "time"
    precision: str = "ns"

    def __post_init__(self) -> None:
        names = [self.time, *self.tags, *self.fields]
        if len(names) != len(set(names)):
            raise ValueError("a column name occurs twice")
        if not self.fields:
            raise ValueError("a table needs a field")
        if self.precision not in PRECISIONS:
            raise ValueError(f"unknown precision: {self.precision}")


def latest(df: DataFrame, tags: list[str], time: str, fields: list[str], seq: str) -> DataFrame:
    """Upsert on read: per series and time, each field's newest value that is not null.

    One aggregation with bounded state per field, combined before the shuffle.
    """
    return df.groupBy(*tags, time).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields))


def written_rows(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows that may be written: those with at least one field; the rest raise when read."""
    some = F.coalesce(*(F.col(f).isNotNull().cast("int") for f in fields)) if len(fields) == 1 else F.greatest(*(F.col(f).isNotNull().cast("int") for f in fields))
    return df.where(F.when(some == 1, True).otherwise(F.raise_error(F.lit("a row needs at least one field")).cast("boolean")))


def series_key(name: str, tags: list[str]) -> Column:
    """``table,tag=value,…`` of the tags that are not null."""
    return F.concat_ws(",", F.lit(name), *(F.when(F.col(t).isNotNull(), F.concat(F.lit(f"{t}="), F.col(t))) for t in sorted(tags)))


def show_series(df: DataFrame, name: str, tags: list[str], where: Column | str | None = None) -> DataFrame:
    """The distinct series of a table as ``key``; a filter takes tags and time."""
    rows = df if where is None else df.where(where)
    return rows.select(*tags).distinct().select(series_key(name, tags).alias("key"))


def show_tag_values(df: DataFrame, tags: list[str], where: Column | str | None = None) -> DataFrame:
    """Distinct ``(key, value)`` of the named tags, nulls left out; one pass over the table."""
    rows = df if where is None else df.where(where)
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("key"), F.col(t).cast("string").alias("value")) for t in tags)))
    return rows.select(pairs.alias("p")).select("p.key", "p.value").where("value is not null").distinct()


def within_ttl(df: DataFrame, time: str, ttl_days: float, now: Column | None = None) -> DataFrame:
    """Rows younger than a time to live."""
    edge = (now if now is not None else F.current_timestamp()).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(int(ttl_days)))
    return df.where(F.col(time) >= edge)


def delete_where(df: DataFrame, predicate: str, table: SeriesTable) -> DataFrame:
    """The table after DELETE: rows for which the predicate is not true.  Only time and tags may be named."""
    used = _columns(df, predicate)
    bad = used - {table.time, *table.tags}
    if bad:
        raise ValueError(f"a delete may only use time and tags, not {sorted(bad)}")
    return df.where(~F.coalesce(F.expr(predicate), F.lit(False)))


def _columns(df: DataFrame, predicate: str) -> set[str]:
    """Columns that a predicate names (those whose absence makes it fail)."""
    out = set()
    for c in df.columns:
        try:
            df.drop(c).select(F.expr(predicate)).schema  # noqa: B018
        except Exception:  # the analyser has several kinds of error here
            out.add(c)
    return out


def update(df: DataFrame, assignments: dict[str, str], predicate: str, table: SeriesTable) -> DataFrame:
    """The table after UPDATE of fields, or of tags (whose predicate may name tags only); time never changes."""
    kinds = {"tag" if c in table.tags else "field" if c in table.fields else "time" if c == table.time else "unknown" for c in assignments}
    if kinds == {"tag"}:
        if _columns(df, predicate) - set(table.tags):
            raise ValueError("the filter of a tag update may only use tags")
    elif kinds != {"field"}:
        raise ValueError("an update sets either fields or tags, and never the time")
    hit = F.coalesce(F.expr(predicate), F.lit(False))
    return df.withColumns({c: F.when(hit, F.expr(e)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, e in assignments.items()})
