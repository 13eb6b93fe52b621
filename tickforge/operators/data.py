"""Ingest, files, statements, geometry and streaming, as registered queries."""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from tickforge import model
from tickforge.operators.registry import query, sql, table
from tickforge.plans.engine import Engine
from tickforge.session import scratch_dir
from tickforge.sources import files, protocols
from tickforge.streaming import jobs

# -- ingest protocols -----------------------------------------------------------------
_POINTS = "SELECT epoch_us(ts) * 1000 AS time, user_id::VARCHAR AS user_id, event_type, event_id AS id, value FROM events"


@query("ingest_line_protocol", _POINTS)
def ingest_line_protocol(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.expr("concat('events,user_id=', user_id, ',event_type=', event_type, ' id=', event_id, 'i,value=', value, ' ', unix_micros(CAST(ts AS TIMESTAMP_LTZ)) * 1000)").alias("value"))
    return protocols.measurement(protocols.line_protocol(lines), "events", ["user_id", "event_type"], {"id": "bigint", "value": "double"})


@query("ingest_opentsdb_telnet", "SELECT epoch_us(ts) // 1000 * 1000000 AS time, user_id::VARCHAR AS user_id, value FROM events")
def ingest_opentsdb_telnet(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.expr("concat('put events ', unix_millis(CAST(ts AS TIMESTAMP_LTZ)), ' ', value, ' user_id=', user_id)").alias("value"))
    return protocols.measurement(protocols.opentsdb_telnet(lines), "events", ["user_id"], {"value": "double"})


@query("ingest_opentsdb_json", "SELECT epoch_us(ts) // 1000 * 1000000 AS time, event_type, value FROM events")
def ingest_opentsdb_json(spark, sf_dir):
    point = F.struct(F.lit("events").alias("metric"), F.expr("unix_millis(CAST(ts AS TIMESTAMP_LTZ))").alias("timestamp"), "value", F.struct("event_type").alias("tags"))
    lines = table(spark, sf_dir, "events").select(F.to_json(point).alias("value"))
    return protocols.measurement(protocols.opentsdb_json(lines), "events", ["event_type"], {"value": "double"})


@query("ingest_ndjson", "SELECT event_id, event_type AS kind, user_id AS who FROM events")
def ingest_ndjson(spark, sf_dir):
    line = F.to_json(F.struct("event_id", F.struct(F.col("event_type").alias("kind"), F.array("user_id").alias("who")).alias("meta")))
    logs = protocols.ndjson_logs(table(spark, sf_dir, "events").select(line.alias("value")))
    return logs.select(F.col("fields")["event_id"].cast("long").alias("event_id"), F.col("fields")["meta.kind"].alias("kind"), F.col("fields")["meta.who.0"].cast("long").alias("who"))


@query("ingest_bulk", "SELECT 'index' AS action, 'ev' AS index, event_id::VARCHAR AS id, event_type AS kind FROM events")
def ingest_bulk(spark, sf_dir):
    request = F.concat(F.to_json(F.struct(F.struct(F.lit("ev").alias("_index"), F.col("event_id").cast("string").alias("_id")).alias("index"))), F.lit("\n"), F.to_json(F.struct(F.col("event_type").alias("kind"))))
    return protocols.bulk_logs(table(spark, sf_dir, "events").select(request.alias("value"))).select("action", "index", "id", F.col("fields")["kind"].alias("kind"))


@query("prom_read", "SELECT event_id, ts, value FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND regexp_matches(user_id::VARCHAR, '^1') AND epoch_us(ts) // 1000 BETWEEN 1704200000000 AND 1705200000000")
def prom_read(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("user_id", F.col("user_id").cast("string"))
    kind = e.agg(F.min("event_type")).first()[0]
    found = protocols.prom_read({"events": e}, [("__name__", "=", "events"), ("event_type", "=", kind), ("user_id", "=~", "^1")], 1704200000000, 1705200000000, "ts")
    return found["events"].select("event_id", "ts", "value")


def _write_requests(batches):
    """A remote-write request per event, as a client sends it."""
    number = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)
    held = lambda tag, body: bytes([tag << 3 | 2]) + number(len(body)) + body
    for batch in batches:
        out = []
        for kind, user, ms, value in zip(*(c.to_pylist() for c in batch.columns)):
            labels = b"".join(held(1, held(1, k.encode()) + held(2, v.encode())) for k, v in (("__name__", "activity"), ("kind", kind), ("user", user)))
            out.append(pa.Codec("snappy").compress(held(1, labels + held(2, b"\x09" + struct.pack("<d", value) + b"\x10" + number(ms))), asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


@query("prom_write", "SELECT 'activity' AS metric, event_type AS kind, user_id::VARCHAR AS user_name, epoch_us(ts) // 1000 AS time_ms, value FROM events")
def prom_write(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string"), F.unix_millis(F.col("ts").cast("timestamp_ltz")), "value")
    found = protocols.prom_write(events.mapInArrow(_write_requests, "value binary"))
    return found.select("metric", F.col("labels")["kind"].alias("kind"), F.col("labels")["user"].alias("user_name"), "time_ms", "value")


def _spans(spark, sf_dir):
    """Spans made of the events: a trace per user, a service per kind of event."""
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp_ltz")) * 1000
    span = F.struct(F.col("user_id").cast("string").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.lit("").alias("parentSpanId"), F.concat(F.lit("op"), F.col("event_id") % 3).alias("name"), F.lit("2").alias("kind"), start.cast("string").alias("startTimeUnixNano"), (start + F.col("event_id")).cast("string").alias("endTimeUnixNano"), F.array(text("parity", (F.col("event_id") % 2).cast("string"))).alias("attributes"))
    request = F.struct(F.array(F.struct(F.struct(F.array(text("service.name", F.col("event_type"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return protocols.otlp_spans(e.select(F.to_json(request).alias("value")))


@query("ingest_otlp", "SELECT user_id::VARCHAR AS trace_id, event_id::VARCHAR AS span_id, event_type AS service_name, 'op' || event_id % 3 AS operation, epoch_us(ts) * 1000 AS start_ns, event_id AS duration_ns, (event_id % 2)::VARCHAR AS parity FROM events")
def ingest_otlp(spark, sf_dir):
    return _spans(spark, sf_dir).select("trace_id", "span_id", "service_name", "operation", "start_ns", "duration_ns", F.col("tags")["parity"].alias("parity"))


@query("find_traces", "WITH s AS (SELECT user_id::VARCHAR AS trace_id, event_id::VARCHAR AS span_id, event_type AS k, event_id, epoch_us(ts) AS t FROM events), c AS (SELECT trace_id, max(t) AS m FROM s WHERE k = (SELECT min(event_type) FROM events) AND event_id % 3 = 1 AND event_id % 2 = 1 AND event_id >= 100 GROUP BY trace_id ORDER BY m DESC, trace_id LIMIT 5) SELECT trace_id, span_id FROM s WHERE trace_id IN (SELECT trace_id FROM c)")
def find_traces(spark, sf_dir):
    kind = table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    return protocols.find_traces(_spans(spark, sf_dir), kind, "op1", {"parity": "1"}, min_duration_ns=100, limit=5).select("trace_id", "span_id")


# -- files ----------------------------------------------------------------------------------
def _round_trip(fmt: str, **options: object):
    def build(spark, sf_dir):
        path = f"{scratch_dir(spark)}/{fmt}"
        source = table(spark, sf_dir, "supplier")
        files.copy_into_location(source, path, fmt, header=True, delimiter=str(options.get("delimiter", ",")))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
        return files.read_files(spark, path, fmt, schema, header=True, delimiter=str(options.get("delimiter", ",")))

    return build


for _fmt, _options in (("csv", {"delimiter": "|"}), ("json", {}), ("parquet", {}), ("orc", {})):
    query(f"external_{_fmt}", "SELECT * FROM supplier")(_round_trip(_fmt, **_options))


@query("adhoc_file_query", "SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")
def adhoc_file_query(spark, sf_dir):
    return spark.sql(f"SELECT count(*) AS n FROM parquet.`{sf_dir}/nation.parquet` WHERE n_regionkey = 1")


@query("result_csv", "SELECT r_regionkey || ',' || r_name AS value FROM region")
def result_csv(spark, sf_dir):
    return files.result_lines(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "csv")


# -- statements ---------------------------------------------------------------------------------
def _engine(spark, sf_dir) -> Engine:
    """An engine with a table of the events, written twice in part: the second value of a point wins."""
    e = Engine(spark, scratch_dir(spark), database=f"db{uuid.uuid4().hex[:8]}")
    e.sql("CREATE TABLE points(id BIGINT, value DOUBLE, TAGS(user_id, event_type))")
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("time"), F.col("user_id").cast("string").alias("user_id"), "event_type", F.col("event_id").alias("id"), "value")
    e.insert("points", rows)
    e.insert("points", rows.where("id % 3 = 0").withColumn("value", F.when(F.col("id") % 2 == 0, F.col("value") + 1)).withColumn("id", F.when(F.col("id") % 2 == 0, F.col("id"))).where("id is not null"))
    return e


_MERGED = "(SELECT event_id AS id, ts AS time, user_id::VARCHAR AS user_id, event_type, CASE WHEN event_id % 6 = 0 THEN value + 1 ELSE value END AS value FROM events)"


@query("upsert_read", f"SELECT time, user_id, event_type, id, value FROM {_MERGED}")
def upsert_read(spark, sf_dir):
    return _engine(spark, sf_dir).table("points")


@query("insert_select", f"SELECT time, user_id, count(*) AS n FROM {_MERGED} WHERE value > 0 GROUP BY time, user_id")
def insert_select(spark, sf_dir):
    e = _engine(spark, sf_dir)
    e.sql("CREATE TABLE counts(n BIGINT, TAGS(user_id))")
    e.sql("INSERT INTO counts(time, user_id, n) SELECT time, user_id, count(*) FROM points WHERE value > 0 GROUP BY time, user_id")
    return e.sql("SELECT time, user_id, n FROM counts")


@query("delete", f"SELECT time, user_id, event_type, id, value FROM {_MERGED} WHERE NOT (user_id = '1' AND time < TIMESTAMP '2024-01-15 00:00:00')")
def delete(spark, sf_dir):
    e = _engine(spark, sf_dir)
    e.sql("DELETE FROM points WHERE user_id = '1' AND time < '2024-01-15 00:00:00'")
    return e.table("points")


@query("update_field", f"SELECT time, user_id, event_type, id, CASE WHEN user_id = '2' THEN -value ELSE value END AS value FROM {_MERGED}")
def update_field(spark, sf_dir):
    e = _engine(spark, sf_dir)
    e.sql("UPDATE points SET value = -value WHERE user_id = '2'")
    return e.table("points")


@query("update_tag", f"SELECT time, CASE WHEN user_id = '3' THEN 'three' ELSE user_id END AS user_id, event_type, id, value FROM {_MERGED}")
def update_tag(spark, sf_dir):
    e = _engine(spark, sf_dir)
    e.sql("UPDATE points SET user_id = 'three' WHERE user_id = '3'")
    return e.table("points")


@query("copy_into", f"SELECT time, user_id, id FROM {_MERGED} WHERE id % 2 = 0")
def copy_into(spark, sf_dir):
    e, path = _engine(spark, sf_dir), f"{scratch_dir(spark)}/copy"
    e.sql(f"COPY INTO '{path}' FROM (SELECT time, user_id, id FROM points WHERE id % 2 = 0) FILE_FORMAT = (TYPE = 'PARQUET')")
    e.sql("CREATE TABLE copied(id BIGINT, TAGS(user_id))")
    e.sql(f"COPY INTO copied FROM '{path}' FILE_FORMAT = (TYPE = 'PARQUET') COPY_OPTIONS = (AUTO_INFER_SCHEMA = true)")
    return e.sql("SELECT time, user_id, id FROM copied")


@query("show_series_sql", f"SELECT DISTINCT 'points,event_type=' || event_type || ',user_id=' || user_id AS key FROM {_MERGED} WHERE user_id = '1'")
def show_series_sql(spark, sf_dir):
    return _engine(spark, sf_dir).sql("SHOW SERIES FROM points WHERE user_id = '1' ORDER BY key")


@query("show_tag_values_sql", f"SELECT DISTINCT 'event_type' AS key, event_type AS value FROM {_MERGED}")
def show_tag_values_sql(spark, sf_dir):
    return _engine(spark, sf_dir).sql("SHOW TAG VALUES FROM points WITH KEY = event_type")


@query("information_schema", "SELECT column_name, column_type FROM (VALUES ('time', 'TIME'), ('user_id', 'TAG'), ('event_type', 'TAG'), ('id', 'FIELD'), ('value', 'FIELD')) AS t(column_name, column_type)")
def information_schema(spark, sf_dir):
    return _engine(spark, sf_dir).sql("SELECT column_name, column_type FROM information_schema.columns WHERE table_name = 'points' ORDER BY ordinal_position")


@query("nanosecond_points", "SELECT n, f FROM (VALUES (1, 10), (2, 20), (3, 33), (1000, 40)) AS t(n, f)")
def nanosecond_points(spark, sf_dir):
    """Points that differ by a nanosecond stay apart, and one at the same nanosecond replaces the other."""
    e = Engine(spark, scratch_dir(spark), database=f"db{uuid.uuid4().hex[:8]}")
    e.sql("CREATE TABLE fine(n BIGINT, f BIGINT)")
    e.sql("INSERT INTO fine(time, n, f) VALUES (1, 1, 10), (2, 2, 20), (3, 3, 30), (1000, 1000, 40)")
    e.sql("INSERT INTO fine(time, f) VALUES (3, 33)")
    return e.sql("SELECT CAST(n AS INT) AS n, CAST(f AS INT) AS f FROM fine")


@query("qualified_names", f"SELECT p.user_id, count(*) AS n FROM {_MERGED} AS p GROUP BY p.user_id")
def qualified_names(spark, sf_dir):
    """A table of another database by its full name, read by a second engine that knows it from the catalog."""
    root, db = scratch_dir(spark), f"db{uuid.uuid4().hex[:8]}"
    e = Engine(spark, root)
    e.sql(f"CREATE DATABASE {db} WITH TTL 'INF' PRECISION 'us'")
    e.sql(f"CREATE TABLE {db}.points(id BIGINT, value DOUBLE, TAGS(user_id, event_type))")
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("time"), F.col("user_id").cast("string").alias("user_id"), "event_type", F.col("event_id").alias("id"), "value")
    e.insert(f"{db}.points", rows)
    return Engine(spark, root).sql(f"SELECT points.user_id, count(*) AS n FROM {db}.points GROUP BY points.user_id")


@query("information_schema_tables", "SELECT 'points' AS table_name, 'BASE TABLE' AS table_type, 'NS' AS precision, '3d' AS ttl")
def information_schema_tables(spark, sf_dir):
    e = _engine(spark, sf_dir)
    e.sql(f"ALTER DATABASE {e.database} SET TTL '3d' SHARD 6")
    return e.sql("SELECT t.table_name, t.table_type, d.precision, d.ttl FROM information_schema.tables AS t JOIN information_schema.databases AS d ON t.table_database = d.database_name")


@query("topk_sql", f"SELECT value, id FROM {_MERGED} ORDER BY value DESC NULLS LAST LIMIT 7")
def topk_sql(spark, sf_dir):
    return _engine(spark, sf_dir).sql("SELECT topk(value, 7), id FROM points")


@query("ttl", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-21 00:00:00'")
def ttl(spark, sf_dir):
    kept = model.within_ttl(table(spark, sf_dir, "events"), "ts", 10, F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")))
    return kept.agg(F.count("*").alias("n"))


# -- geometry ---------------------------------------------------------------------------------------
_POINT = "concat('POINT(', user_id % 20, ' ', event_id % 15, ')')"
_BOX = "'POLYGON((2 2, 12 2, 12 10, 2 10, 2 2))'"
sql("gis_distance", f"SELECT event_id, round(st_distance({_POINT}, 'POINT(3 4)'), 9) AS d FROM events", "SELECT event_id, round(sqrt((user_id % 20 - 3) ** 2 + (event_id % 15 - 4) ** 2), 9) AS d FROM events")
sql("gis_area", "SELECT n_nationkey, st_area(concat('POLYGON((0 0, ', n_nationkey + 1, ' 0, ', n_nationkey + 1, ' 4, 0 4, 0 0))')) AS a FROM nation", "SELECT n_nationkey, ((n_nationkey + 1) * 4)::DOUBLE AS a FROM nation")
sql("gis_contains_within", f"SELECT event_id, st_contains({_BOX}, {_POINT}) AS c, st_within({_POINT}, {_BOX}) AS w FROM events", "SELECT event_id, user_id % 20 > 2 AND user_id % 20 < 12 AND event_id % 15 > 2 AND event_id % 15 < 10 AS c, user_id % 20 > 2 AND user_id % 20 < 12 AND event_id % 15 > 2 AND event_id % 15 < 10 AS w FROM events")
sql("gis_intersects_disjoint", f"SELECT event_id, st_intersects({_BOX}, {_POINT}) AS i, st_disjoint({_BOX}, {_POINT}) AS d FROM events", "SELECT event_id, user_id % 20 BETWEEN 2 AND 12 AND event_id % 15 BETWEEN 2 AND 10 AS i, NOT (user_id % 20 BETWEEN 2 AND 12 AND event_id % 15 BETWEEN 2 AND 10) AS d FROM events")
sql("gis_equals", "SELECT n_nationkey, st_equals(concat('LINESTRING(0 0, ', n_nationkey + 1, ' 0)'), 'LINESTRING(7 0, 0 0)') AS e FROM nation", "SELECT n_nationkey, n_nationkey = 6 AS e FROM nation")
sql("gis_binary", f"SELECT DISTINCT st_geomfromwkb_wkt(st_asbinary_wkt({_POINT})) AS g, st_asbinary_wkt('nonsense') IS NULL AS bad FROM events", "SELECT DISTINCT 'POINT(' || user_id % 20 || ' ' || event_id % 15 || ')' AS g, true AS bad FROM events")


# -- streaming --------------------------------------------------------------------------------------------
def _stream(spark, sf_dir, width: str, slide: str | None):
    source = jobs.StreamTable(f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema, "ts", "40 days")
    base = scratch_dir(spark)
    counted = jobs.windowed(source.read(spark), "ts", width, ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s")], slide)
    jobs.start(counted, jobs.upsert_parquet(f"{base}/out"), f"{base}/checkpoint", once=True).awaitTermination()
    return jobs.read_upserts(spark, f"{base}/out", ["window_start", "window_end", "event_type"])


@query("stream_tumbling", "SELECT make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000) AS window_start, make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000 + 3600000000) AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    return _stream(spark, sf_dir, "1 hour", None)


@query("stream_sliding", "SELECT make_timestamp(t) AS window_start, make_timestamp(t + 7200000000) AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS s FROM (SELECT event_type, value, epoch_us(ts) - epoch_us(ts) % 3600000000 - unnest([0, 1]) * 3600000000 AS t FROM events) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    return _stream(spark, sf_dir, "2 hours", "1 hour")
