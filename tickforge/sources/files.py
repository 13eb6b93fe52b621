"""External files, COPY and result formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("csv", "parquet", "json", "avro", "orc")


def read_files(spark: SparkSession, path: str, fmt: str, schema: str | None = None, header: bool = False, delimiter: str = ",", compression: str | None = None) -> DataFrame:
    """A listing table over files; a stated schema avoids the pass that infers one."""
    fmt = fmt.lower()
    if fmt == "arrow":
        raise NotImplementedError("Arrow files are not supported")
    if fmt not in FORMATS:
        raise ValueError(f"unknown file format: {fmt}")
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", "true")
    if fmt == "csv":
        reader = reader.option("header", str(header).lower()).option("sep", delimiter)
    if compression:
        reader = reader.option("compression", compression)
    return reader.load(path)


def by_name(source: DataFrame, target: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``source`` in the shape of ``target``: columns by name (or in the order listed), missing ones null."""
    names = columns or source.columns
    if len(names) != len(source.columns):
        raise ValueError(f"{len(names)} columns are named, {len(source.columns)} are given")
    extra = [n for n in names if n not in target.columns]
    if extra:
        raise ValueError(f"unknown columns: {extra}")
    renamed = source.toDF(*names)
    return renamed.select(*((F.col(f"`{f.name}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields))


def copy_into_location(df: DataFrame, path: str, fmt: str = "csv", header: bool = True, delimiter: str = ",", mode: str = "errorifexists") -> None:
    """COPY INTO 'uri': write a table or query as files."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", str(header).lower()).option("sep", delimiter)
    writer.save(path)


def result_lines(df: DataFrame, fmt: str) -> DataFrame:
    """Rows as lines of ``csv``, ``tsv`` or ``ndjson`` text (``json`` consumers join the lines), still distributed."""
    fmt = fmt.lower()
    if fmt in ("ndjson", "json"):
        return df.select(F.to_json(F.struct("*")).alias("value"))
    sep = {"csv": ",", "tsv": "\t"}.get(fmt)
    if sep is None:
        raise ValueError(f"unknown result format: {fmt}")
    return df.select(F.to_csv(F.struct(*(F.col(f"`{c}`").cast("string") for c in df.columns)), {"sep": sep}).alias("value"))
