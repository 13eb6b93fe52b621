"""Ingest of metric and log text.

Every parser takes a DataFrame with one string column of lines (as
``spark.read.text`` gives) and is a narrow, partition-parallel step.  Metric
parsers return points ``(measurement, tags map, fields map, time)``; field values are
kept as text with their type letter and typed by :func:`measurement`.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "measurement string, tags map<string,string>, fields map<string,struct<kind:string,value:string>>, time long"
#: Nanoseconds per unit of a stated precision.
PRECISION = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}


class LineError(ValueError):
    """A line that is not in the protocol."""


def _split(text: str, stop: str, quotes: bool = False) -> list[str]:
    """Split on an unescaped character, outside double quotes if those count; escapes stay."""
    if "\\" not in text and not (quotes and '"' in text):
        return text.split(stop)
    out, start, quoted, i = [], 0, False, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if quotes and c == '"':
            quoted = not quoted
        elif c == stop and not quoted:
            out.append(text[start:i])
            start = i + 1
        i += 1
    if quoted:
        raise LineError("a quoted value does not end")
    return [*out, text[start:]]


def _plain(text: str, escaped: str) -> str:
    for c in escaped:
        text = text.replace("\\" + c, c)
    return text


def _field(text: str) -> dict[str, str]:
    if len(text) >= 2 and text[0] == '"' and text[-1] == '"':
        return {"kind": "string", "value": _plain(text[1:-1], '"\\')}
    if text in ("t", "T", "true", "True", "TRUE"):
        return {"kind": "boolean", "value": "true"}
    if text in ("f", "F", "false", "False", "FALSE"):
        return {"kind": "boolean", "value": "false"}
    kind, body = ("bigint", text[:-1]) if text.endswith("i") else ("bigint unsigned", text[:-1]) if text.endswith("u") else ("double", text)
    try:
        value = float(body) if kind == "double" else int(body)
    except ValueError as e:
        raise LineError(f"not a field value: {text!r}") from e
    if kind == "bigint unsigned" and value < 0:
        raise LineError(f"not a field value: {text!r}")
    return {"kind": kind, "value": repr(value)}


def parse_line(line: str, default_time: int, scale: int = 1) -> dict | None:
    """One line ``measurement[,tag=value…] field=value[,…] [time]``; blank lines and comments give nothing."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    parts = [p for p in _split(line, " ", quotes=True) if p]
    if not 2 <= len(parts) <= 3:
        raise LineError(f"expected series, fields and time: {line[:80]!r}")
    name, *pairs = _split(parts[0], ",")
    if not name:
        raise LineError("no measurement")

    def pair(text: str, quotes: bool = False) -> tuple[str, str]:
        cut = _split(text, "=", quotes)
        if len(cut) < 2 or not cut[0]:
            raise LineError(f"expected name=value: {text[:80]!r}")
        return _plain(cut[0], ",= "), "=".join(cut[1:])

    tags = {k: _plain(v, ",= ") for k, v in map(pair, pairs)}
    fields = {k: _field(v) for k, v in (pair(p, True) for p in _split(parts[1], ",", quotes=True))}
    try:
        time = int(parts[2]) * scale if len(parts) == 3 else default_time
    except ValueError as e:
        raise LineError(f"not a time: {parts[2]!r}") from e
    return {"measurement": _plain(name, ", "), "tags": tags, "fields": fields, "time": time}


def line_protocol(lines: DataFrame, default_time: int = 0, precision: str = "ns", column: str = "value") -> DataFrame:
    """Points of line-protocol text; times in nanoseconds."""
    scale = PRECISION[precision]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [p for x in pdf.iloc[:, 0] if x is not None and (p := parse_line(x, default_time, scale)) is not None]
            yield pd.DataFrame(rows, columns=["measurement", "tags", "fields", "time"])

    return lines.select(column).mapInPandas(run, POINT)


def opentsdb_telnet(lines: DataFrame, column: str = "value") -> DataFrame:
    """Points of ``[put] metric time value tag=value …``; seconds and milliseconds are told apart by their size.  SQL only."""
    line = F.regexp_replace(F.trim(column), "^put\\s+", "")
    words = F.split(line, "\\s+")
    tags = F.filter(F.slice("w", 4, 1 << 20), lambda x: F.contains(x, F.lit("=")))
    t = F.col("w")[1].cast("long")
    nanos = F.when(t < 10**11, t * 10**9).when(t < 10**14, t * 10**6).otherwise(t)
    return lines.where(F.length(F.trim(column)) > 0).select(words.alias("w")).select(
        F.col("w")[0].alias("measurement"),
        F.map_from_arrays(F.transform(tags, lambda x: F.split_part(x, F.lit("="), F.lit(1))), F.transform(tags, lambda x: F.split_part(x, F.lit("="), F.lit(2)))).alias("tags"),
        F.create_map(F.lit("value"), F.struct(F.lit("double").alias("kind"), F.col("w")[2].cast("double").cast("string").alias("value"))).alias("fields"),
        nanos.alias("time"),
    )


def opentsdb_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Points of JSON objects or arrays ``{metric, timestamp, value, tags}``.  SQL only."""
    shape = "array<struct<metric:string,timestamp:long,value:double,tags:map<string,string>>>"
    text = F.trim(column)
    listed = F.from_json(F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), shape)
    p = lines.where(F.length(text) > 0).select(F.explode(listed).alias("p"))
    t = F.col("p.timestamp")
    nanos = F.when(t < 10**11, t * 10**9).when(t < 10**14, t * 10**6).otherwise(t)
    return p.select(F.col("p.metric").alias("measurement"), F.col("p.tags").alias("tags"), F.create_map(F.lit("value"), F.struct(F.lit("double").alias("kind"), F.col("p.value").cast("string").alias("value"))).alias("fields"), nanos.alias("time"))


def measurement(points: DataFrame, name: str, tags: list[str], fields: dict[str, str]) -> DataFrame:
    """The points of one measurement as a table: ``time`` (ns ticks), tag columns, typed field columns."""
    typed = lambda f, t: F.col("fields")[f]["value"].cast({"bigint unsigned": "decimal(20,0)"}.get(t, t)).alias(f)
    return points.where(F.col("measurement") == name).select("time", *(F.col("tags")[t].alias(t) for t in tags), *(typed(f, t) for f, t in fields.items()))


def inferred(points: DataFrame, name: str) -> tuple[list[str], dict[str, str]]:
    """Tags and field types that a measurement's points hold (one small aggregation)."""
    mine = points.where(F.col("measurement") == name)
    tags = [r[0] for r in mine.select(F.explode(F.map_keys("tags"))).distinct().orderBy(F.col("col")).collect()]
    kinds = mine.select(F.explode("fields").alias("f", "v")).groupBy("f").agg(F.collect_set("v.kind").alias("k")).orderBy("f").collect()
    for r in kinds:
        if len(r.k) > 1:
            raise LineError(f"field {r.f} has values of different types: {sorted(r.k)}")
    return tags, {r.f: r.k[0] for r in kinds}


def flatten(value: object, name: str = "") -> dict[str, object]:
    """Leaves of nested JSON by dotted path; items of arrays by their number."""
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    if items is None:
        return {name: value}
    out: dict[str, object] = {}
    for key, v in items:
        out |= {(f"{name}.{k}" if name else k): x for k, x in flatten(v, str(key)).items()}
    return out


def _text(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


def ndjson_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Flattened fields of one JSON object per line: ``fields map<string, string>``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"fields": [{k: _text(v) for k, v in flatten(json.loads(x)).items()} for x in pdf.iloc[:, 0] if x and x.strip()]})

    return lines.select(column).mapInPandas(run, "fields map<string,string>")


loki_logs = ndjson_logs


def bulk_logs(requests: DataFrame, column: str = "value") -> DataFrame:
    """Logs of bulk requests (a text per request): each action line, then its fields: ``(action, index, id, fields)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf.iloc[:, 0]:
                lines = [x for x in (text or "").split("\n") if x.strip()]
                if len(lines) % 2:
                    raise LineError("a bulk request is pairs of an action and its fields")
                for head, body in zip(lines[::2], lines[1::2]):
                    (action, where), = json.loads(head).items()
                    rows.append((action, (where or {}).get("_index"), (where or {}).get("_id"), {k: _text(v) for k, v in flatten(json.loads(body)).items()}))
            yield pd.DataFrame(rows, columns=["action", "index", "id", "fields"])

    return requests.select(column).mapInPandas(run, "action string, index string, id string, fields map<string,string>")


def prom_filter(matchers: list[tuple[str, str, str]], start_ms: int, end_ms: int, time_ms: Column) -> tuple[str, str, Column]:
    """Of remote-read matchers ``(label, op, value)``: kind and value of the metric-name matcher, and the row filter.

    Operators are ``= != =~ !~``; the metric name takes ``=`` and ``=~`` only.
    """
    kind, name, keep = "", "", (time_ms >= start_ms) & (time_ms <= end_ms)
    for label, op, value in matchers:
        if label == "__name__":
            if op not in ("=", "=~"):
                raise ValueError("the metric name takes equal and regex matchers only")
            kind, name = op, value
            continue
        c = F.col(label)
        keep &= {"=": lambda: c == value, "!=": lambda: c != value, "=~": lambda: c.rlike(value), "!~": lambda: ~c.rlike(value)}[op]()
    if not kind:
        raise ValueError("a read names its metric")
    return kind, name, keep


def prom_read(tables: dict[str, DataFrame], matchers: list[tuple[str, str, str]], start_ms: int, end_ms: int, time: str = "time") -> dict[str, DataFrame]:
    """Remote read: rows per metric table in time order."""
    import re

    time_ms = F.unix_millis(F.col(time).cast("timestamp_ltz"))
    kind, name, keep = prom_filter(matchers, start_ms, end_ms, time_ms)
    chosen = [name] if kind == "=" else [t for t in sorted(tables) if re.search(name, t)]
    missing = [t for t in chosen if t not in tables]
    if missing:
        raise KeyError(f"no such table: {missing[0]}")
    return {t: tables[t].where(keep).orderBy(time) for t in chosen}


# -- Prometheus remote write ---------------------------------------------------------------------
def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise LineError("a message ends inside a number")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number, and a whole number or the bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise LineError(f"unknown wire type: {wire}")
        if at > len(data):
            raise LineError("a message ends inside a field")
        yield tag >> 3, value


def parse_write_request(body: bytes) -> list[tuple[str, dict[str, str], int, float]]:
    """The samples ``(metric, labels, time in ms, value)`` of a snappy-compressed write request."""
    size, _ = _varint(body, 0)
    plain = pa.Codec("snappy").decompress(body, decompressed_size=size, asbytes=True) if size else b""
    out = []
    for number, series in _message(plain):
        if number != 1:
            continue
        labels, samples = {}, []
        for part, value in _message(series):
            if part == 1:
                pair = dict(_message(value))
                labels[pair.get(1, b"").decode()] = pair.get(2, b"").decode()
            elif part == 2:
                pair = dict(_message(value))
                at = pair.get(2, 0)
                samples.append((at - (1 << 64) if at >= 1 << 63 else at, struct.unpack("<d", pair.get(1, bytes(8)))[0]))
        if "__name__" not in labels:
            raise LineError("a series names its metric")
        name = labels.pop("__name__")
        out += [(name, labels, at, value) for at, value in samples]
    return out


def prom_write(requests: DataFrame, column: str = "value") -> DataFrame:
    """Samples of remote-write requests (a binary each): ``(metric, labels map, time_ms, value)``, partition by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for body in batch.column(0) if body.is_valid for r in parse_write_request(body.as_py())]
            metric, labels, at, value = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(metric, pa.string()), pa.array([list(x.items()) for x in labels], pa.map_(pa.string(), pa.string())), pa.array(at, pa.int64()), pa.array(value, pa.float64())], names=["metric", "labels", "time_ms", "value"])

    return requests.select(column).mapInArrow(run, "metric string, labels map<string,string>, time_ms long, value double")


# -- OTLP traces and queries over them ----------------------------------------------------------------
# The JSON form of an export request, as far as spans need it.
_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},status:struct<code:string,message:string>>"
OTLP = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<{_SPAN}>>>>>"


def _attributes(pairs: Column) -> Column:
    """Attributes as a map of text; of a key that comes twice the last counts."""
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    last = F.filter(F.coalesce(pairs, F.array().cast(_ATTRIBUTES)), lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"].alias("key"), value(x["value"]).alias("value"))))


def otlp_spans(requests: DataFrame, column: str = "value") -> DataFrame:
    """Spans of OTLP export requests in JSON (a text each), one row a span; built-in functions only."""
    parsed = requests.select(F.from_json(column, OTLP).alias("r")).select(F.explode("r.resourceSpans").alias("r"))
    scoped = parsed.select(_attributes(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeSpans").alias("s")).select("resource", F.col("s.scope.name").alias("scope"), F.explode("s.spans").alias("p"))
    ns = lambda c: F.col(c).cast("long")
    return scoped.select(
        F.col("p.traceId").alias("trace_id"),
        F.col("p.spanId").alias("span_id"),
        F.nullif(F.col("p.parentSpanId"), F.lit("")).alias("parent_span_id"),
        F.coalesce(F.col("resource")["service.name"], F.lit("unknown")).alias("service_name"),
        F.col("p.name").alias("operation"),
        F.col("p.kind").alias("kind"),
        "scope",
        ns("p.startTimeUnixNano").alias("start_ns"),
        (ns("p.endTimeUnixNano") - ns("p.startTimeUnixNano")).alias("duration_ns"),
        F.col("p.status.code").alias("status"),
        _attributes(F.col("p.attributes")).alias("tags"),
        "resource",
    )


def trace_services(spans: DataFrame) -> DataFrame:
    return spans.select("service_name").distinct()


def trace_operations(spans: DataFrame, service: str, kind: str | None = None) -> DataFrame:
    rows = spans.where(F.col("service_name") == service)
    return (rows if kind is None else rows.where(F.col("kind") == kind)).select("operation", "kind").distinct()


def find_traces(spans: DataFrame, service: str, operation: str | None = None, tags: dict[str, str] | None = None, start_ns: int | None = None, end_ns: int | None = None, min_duration_ns: int | None = None, max_duration_ns: int | None = None, limit: int | None = None) -> DataFrame:
    """All spans of the traces that hold a span as asked for; with ``limit`` of the newest so many traces."""
    keep = F.col("service_name") == service
    for given, test in ((operation, F.col("operation") == operation), (start_ns, F.col("start_ns") >= start_ns), (end_ns, F.col("start_ns") <= end_ns), (min_duration_ns, F.col("duration_ns") >= min_duration_ns), (max_duration_ns, F.col("duration_ns") <= max_duration_ns)):
        keep = keep if given is None else keep & test
    for key, value in (tags or {}).items():
        keep &= F.coalesce(F.col("tags")[key], F.col("resource")[key]) == value
    chosen = spans.where(keep).groupBy("trace_id").agg(F.max("start_ns").alias("newest"))
    if limit is not None:
        chosen = chosen.orderBy(F.desc("newest"), "trace_id").limit(limit)
    return spans.join(chosen.select("trace_id"), "trace_id", "left_semi")
