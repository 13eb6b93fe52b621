"""Statements of the SQL front-end, against worked examples."""

import datetime as dt

import pytest

from tickforge.functions import gis, series_agg, series_ops, windows
from tickforge.plans import rewrite
from tickforge.plans.engine import Engine
from tickforge.plans.tokens import SqlError, tokenize
from tickforge.sources import protocols


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.sql("CREATE TABLE test(f0 BIGINT, f1 STRING, TAGS(t0, t1, t2))")
    e.sql("INSERT INTO test(TIME, t0, t1, t2, f0, f1) VALUES (0, 'a', 'b', 'c', 1, '2'), (1000, 'a', NULL, NULL, 1, NULL), (2000, NULL, 'b', NULL, NULL, '2'), (3000, NULL, NULL, 'c', 1, NULL), (4000, 'a', 'b', NULL, 1, NULL), (5000, NULL, 'b', 'c', 1, NULL), (6000, '', NULL, NULL, 1, NULL)")
    return e


# The statements, inputs and results below are worked examples of the dialect.
def rows(df):
    return [tuple(r) for r in df.collect()]


def test_show_series(engine):
    assert [r[0] for r in rows(engine.sql("SHOW SERIES FROM test ORDER BY key"))] == ["test,t0=", "test,t0=a", "test,t0=a,t1=b", "test,t0=a,t1=b,t2=c", "test,t1=b", "test,t1=b,t2=c", "test,t2=c"]
    with pytest.raises(SqlError):
        engine.sql("SHOW SERIES FROM test WHERE f0 = 1")


def test_show_tag_values(engine):
    assert sorted(rows(engine.sql("SHOW TAG VALUES FROM test WITH KEY IN (t0, t1, t2)"))) == [("t0", ""), ("t0", "a"), ("t1", "b"), ("t2", "c")]
    assert sorted(rows(engine.sql("SHOW TAG VALUES FROM test WITH KEY NOT IN (t0)"))) == [("t1", "b"), ("t2", "c")]


def test_upsert_keeps_newest_value_per_field(engine):
    engine.sql("INSERT INTO test(time, t0, t1, t2, f0) VALUES (0, 'a', 'b', 'c', 9)")
    assert rows(engine.sql("SELECT f0, f1 FROM test WHERE t2 = 'c' AND t0 = 'a'")) == [(9, "2")]


def test_rejected_writes(engine):
    with pytest.raises(Exception, match="at least one field"):
        engine.sql("INSERT INTO test(time, t0) VALUES (1, 'x')")
    with pytest.raises(SqlError, match="time"):
        engine.sql("INSERT INTO test(t0, f0) VALUES ('x', 1)")
    for bad in ("DELETE FROM test WHERE f0 = 1", "UPDATE test SET time = 1 WHERE t0 = 'a'", "UPDATE test SET t0 = 'x' WHERE f0 = 1"):
        with pytest.raises(ValueError):
            engine.sql(bad)


def test_update_delete_alter(engine):
    engine.sql("UPDATE test SET f0 = 5 WHERE t0 = 'a'")
    engine.sql("DELETE FROM test WHERE t1 = 'b'")
    assert sorted(rows(engine.sql("SELECT t0, f0 FROM test")), key=str) == [("", 1), ("a", 5), (None, 1)]
    engine.sql("ALTER TABLE test ADD FIELD f2 DOUBLE")
    assert engine.sql("SELECT * FROM test").columns[-1] == "f2"
    for bad in ("ALTER TABLE test DROP t0", "ALTER TABLE test RENAME COLUMN time TO x"):
        with pytest.raises(SqlError):
            engine.sql(bad)


def test_selectors_and_generated_series(engine):
    assert [r[0] for r in rows(engine.sql("SELECT topk(f0, 2), t0 FROM test"))] == [1, 1]
    with pytest.raises(ValueError):
        engine.sql("SELECT topk(f0, 256) FROM test")
    with pytest.raises(SqlError):
        engine.sql("SELECT value_fill(time, f0), t0 FROM test")
    with pytest.raises(ValueError, match="unknown field"):
        engine.sql("SELECT value_fill(time, f0, 'a=b') FROM test")
    assert len(rows(engine.sql("SELECT value_fill(time, f0, 'method=mean') FROM test"))) == 7


def test_dialect_differences(engine):
    q = "SELECT 7 / 2, 7.0 / 2, concat('a', NULL), log(100), to_timestamp(1000000000), substr('alphabet', 0, 3), left('abc', -1), 'ab' ~ '^a', date_part('dow', TIMESTAMP_NTZ '2024-01-07 00:00:00')"
    assert rows(engine.sql(q)) == [(3, 3.5, "a", 2.0, dt.datetime(1970, 1, 1, 0, 0, 1), "al", "ab", True, 0.0)]
    with pytest.raises(SqlError):
        engine.sql("SELECT @@nothing")


def test_null_order_is_written_out():
    assert rewrite.select('SELECT "x" FROM t ORDER BY a, b DESC LIMIT 1') == "SELECT `x` FROM t ORDER BY a NULLS LAST, b DESC NULLS FIRST LIMIT 1"
    with pytest.raises(SqlError):
        tokenize("SELECT \x00")


def test_geometry_columns(engine):
    engine.sql("CREATE TABLE geo(loc GEOMETRY(POINT, 0))")
    engine.sql("INSERT INTO geo(time, loc) VALUES (1000, 'POINT(1 2)')")
    with pytest.raises(Exception, match="not a POINT"):
        engine.sql("INSERT INTO geo(time, loc) VALUES (2000, 'LINESTRING(1 2, 3 4)')")
    with pytest.raises(SqlError):
        engine.sql("CREATE TABLE bad(loc GEOMETRY(POINT, 4326))")


def test_sliding_windows_compat(spark):
    """Four points 5 ms apart, windows of 10 ms every 6 ms: eight rows, some before the point."""
    t = spark.createDataFrame([(i,) for i in (0, 5, 10, 15)], "time long")
    compat = windows.time_window(t, "time", 10, 6, ticks=True, mode="compat").select("time", "_window.start", "_window.end")
    assert sorted(rows(compat)) == [(0, -6, 4), (0, 0, 10), (5, -6, 4), (5, 0, 10), (10, 0, 10), (10, 6, 16), (15, 6, 16), (15, 12, 22)]
    exact = windows.time_window(t, "time", 10, 6, ticks=True)
    assert exact.count() == 6
    with pytest.raises(ValueError):
        windows.time_window(t, "time", "1 month")


def test_counter_and_gauge(spark):
    points = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 2, 3, 4, 1, 2, 3, 4])], "k string, time long, v long")
    assert rows(series_agg.increase(points, ["k"], "time", "v")) == [("a", 7)]
    g = series_agg.gauge_agg(points.where("time = 0"), ["k"], "time", "v", ticks=True).select(series_agg.delta("gauge"), series_agg.rate("gauge"), "gauge.num_elements")
    assert rows(g) == [(0.0, None, 1)]


def test_states(spark):
    s = spark.createDataFrame([(0, "run"), (10, "stop"), (30, "run"), (60, "run"), (100, "stop")], "time long, state string")
    a = series_agg.state_agg(s, [], "time", "state", ticks=True)
    got = a.select(series_agg.duration_in("states", "run"), series_agg.duration_in("states", "run", 5), series_agg.duration_in("states", "run", 5, 30), series_agg.duration_in("states", "x"), series_agg.state_at("states", 30), series_agg.state_at("states", 100))
    assert rows(got) == [(80, 75, 10, 0, "run", None)]


def test_quality_scores_in_sql_are_one_aggregate(spark, engine):
    """All four scores of a series come from one pass over its points, in any order, nulls left out."""
    t = [1, 3, 4, 6, 10, 13, 14, 16, 18, 19, 22, 24, 26, 31, 33]
    v = [12.34, 34.54, 1.43, 14.03, 12.30, 11.54, 112.20, 14.44, 134.02, 116.34, 1234.45, 10.36, 124.21, 6.34, float("nan")]
    points = [("a", x, y) for x, y in zip(t, v)] + [("a", 5, None), ("a", None, 5.0)] + [("b", x, y) for x, y in zip(t, v)]
    frame = spark.createDataFrame(points[::-1], "k string, t long, v double")
    worked = (0.823529412, 0.866666667, 0.933333333, 0.8)
    assert sorted(rows(series_ops.data_quality(frame, ["k"], "t", "v", ticks=True).selectExpr("k", *(f"round({c}, 9)" for c in series_ops.QUALITY)))) == [("a", *worked), ("b", *worked)]
    frame.selectExpr("k", "CAST(timestamp_micros(t) AS TIMESTAMP_NTZ) AS ts", "v").createOrReplaceTempView("points_of_quality")
    got = spark.sql(rewrite.select("SELECT k, " + ", ".join(f"round({c}(ts, v), 9) AS {c}" for c in series_ops.QUALITY) + " FROM points_of_quality GROUP BY k"))
    assert sorted(rows(got)) == [("a", *worked), ("b", *worked)]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    made = next(line for line in plan.splitlines() if "Aggregate" in line)
    assert made.split("], [")[1].count("tf_quality(") == 1, plan


def test_options():
    with pytest.raises(ValueError, match="duplicate"):
        series_ops.parse_options("method=AR&method=MA", {"method": str})


def test_line_protocol():
    p = protocols.parse_line(r'wea\ ther,loc=us\,west t=82.5,n=3i,s="a \"b\", c",ok=t 17', 0)
    assert p == {"measurement": "wea ther", "tags": {"loc": "us,west"}, "fields": {"t": {"kind": "double", "value": "82.5"}, "n": {"kind": "bigint", "value": "3"}, "s": {"kind": "string", "value": 'a "b", c'}, "ok": {"kind": "boolean", "value": "true"}}, "time": 17}
    assert protocols.parse_line("# note", 0) is None
    for bad in ("m", "m,x f=1", "m f=abc", 'm f="x'):
        with pytest.raises(protocols.LineError):
            protocols.parse_line(bad, 0)


@pytest.mark.parametrize(
    ("f", "a", "b", "wanted"),
    [
        ("contains", "POLYGON((0 0,0 3,3 0,0 0))", "POLYGON((0 0,0 1,1 0,0 0))", True),
        ("contains", "POLYGON((150 350, 100 350, 210 160, 290 350, 250 350, 200 250, 150 350))", "POLYGON((250 310, 150 310, 150 280, 250 280, 250 310))", False),
        ("contains", "LINESTRING (0 0, 2 0, 2 2)", "POINT (2 0)", True),
        ("contains", "LINESTRING (0 0, 2 0, 2 2)", "POINT (2 2)", False),
        ("contains", "LINESTRING EMPTY", "POINT (2 1)", False),
        ("contains", "POLYGON((0 0,9 0,9 9,0 9,0 0),(3 3,6 3,6 6,3 6,3 3))", "POINT(4 4)", False),
        ("equals", "LINESTRING(0 0, 2 0)", "LINESTRING(2 0, 1 0, 0 0)", True),
        ("intersects", "LINESTRING(0 0, 2 2)", "LINESTRING(0 2, 2 0)", True),
        ("intersects", "POLYGON((0 0,9 0,9 9,0 9,0 0))", "LINESTRING(4 4, 5 5)", True),
        ("distance", "POINT(0 0)", "LINESTRING(3 4, 3 9)", 5.0),
        ("distance", "POLYGON((0 0,1 0,1 1,0 1,0 0))", "POINT(3 1)", 2.0),
    ],
)
def test_geometry(f, a, b, wanted):
    assert getattr(gis, f)(gis.parse_wkt(a), gis.parse_wkt(b)) == wanted


def test_geometry_rejections():
    with pytest.raises(gis.GeometryError, match="not supported"):
        gis.distance(gis.parse_wkt("MULTIPOINT(0 0, 1 1)"), gis.parse_wkt("LINESTRING(0 0, 1 1)"))
    for bad in ("POINT EMPTY", "POINT(1)", "CIRCLE(1 2)", "POINT(1 2"):
        with pytest.raises(gis.GeometryError):
            gis.parse_wkt(bad)
    for text in ("POINT(1 2)", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1.5))"):
        g = gis.parse_wkt(text)
        assert gis.to_wkt(gis.parse_wkb(gis.to_wkb(g))) == text == gis.to_wkt(g)


def test_stream_table(engine):
    engine.sql("CREATE STREAM TABLE src WITH (db = 'public', table = 'test', event_time_column = 'time', watermark_delay = '1 day') ENGINE = files")
    engine.sql("CREATE TABLE counts(n BIGINT, TAGS(t0))")
    with pytest.raises(SqlError):
        engine.sql("SELECT * FROM src")
    with pytest.raises(ValueError, match="sorting"):
        engine.sql("INSERT INTO counts(time, t0, n) SELECT time, t0, f0 FROM src ORDER BY time")
    engine.once = True
    job = engine.sql("INSERT INTO counts(time, t0, n) SELECT w.start, t0, n FROM (SELECT time_window(time, INTERVAL '1 minute') AS w, t0, count(*) AS n FROM src GROUP BY w, t0)")
    (key,) = rows(job)[0]
    for q in engine.spark.streams.active:
        if q.id == key:
            q.awaitTermination()
    assert sorted(rows(engine.sql("SELECT t0, n FROM counts")), key=str) == [("", 1), ("a", 3), (None, 3)]
    with pytest.raises(SqlError):
        engine.sql("CREATE STREAM TABLE bad WITH (table = 'test') ENGINE = files")


def test_nanoseconds_stay_apart(engine):
    """Three points a nanosecond apart are three rows, also after DELETE, UPDATE and ALTER."""
    engine.sql("CREATE TABLE fine(f BIGINT, TAGS(t))")
    engine.sql("INSERT INTO fine(time, t, f) VALUES (1, 'a', 1), (2, 'a', 2), (3, 'a', 3), (3, 'b', 4)")
    assert sorted(r[0] for r in rows(engine.sql("SELECT f FROM fine"))) == [1, 2, 3, 4]
    engine.sql("UPDATE fine SET f = f + 10 WHERE t = 'a'")
    engine.sql("DELETE FROM fine WHERE t = 'b'")
    engine.sql("ALTER TABLE fine ADD FIELD g DOUBLE")
    engine.sql("INSERT INTO fine(time, t, f) VALUES (2, 'a', 99)")
    assert sorted(r[0] for r in rows(engine.sql("SELECT f FROM fine"))) == [11, 13, 99]


def test_precision_of_a_database(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.sql("CREATE DATABASE m WITH PRECISION 'ms'")
    e.sql("CREATE TABLE m.t(f BIGINT)")
    e.sql("INSERT INTO m.t(time, f) VALUES (1, 1), (2, 2)")
    e.sql("INSERT INTO m.t(time, f) VALUES ('1970-01-01 00:00:00.0021', 3)")
    assert sorted(rows(e.sql("SELECT time, f FROM m.t"))) == [(dt.datetime(1970, 1, 1, 0, 0, 0, 1000), 1), (dt.datetime(1970, 1, 1, 0, 0, 0, 2000), 3)]
    with pytest.raises(SqlError):
        e.sql("ALTER DATABASE m SET PRECISION 'ns'")


def test_catalog_names_and_ttl(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.sql("CREATE DATABASE d2")
    e.sql("CREATE TABLE d2.t(f BIGINT CODEC(DELTA), TAGS(a))")
    e.insert("d2.t", spark.sql("SELECT current_timestamp() - make_dt_interval(i) AS time, 'x' AS a, CAST(i AS BIGINT) AS f FROM (SELECT explode(sequence(0, 9)) AS i)"))
    other = Engine(spark, f"file://{tmp_path}")
    assert rows(other.sql("DESCRIBE TABLE d2.t")) == [("time", "TIMESTAMP", "TIME"), ("a", "STRING", "TAG"), ("f", "BIGINT", "FIELD")]
    assert rows(other.sql("SELECT count(*) FROM d2.t AS x WHERE x.f > 3")) == [(6,)]
    other.sql("ALTER DATABASE d2 SET TTL '5d'")
    assert rows(other.sql("SELECT max(t.f) FROM d2.t")) == [(4,)]
    assert rows(other.sql("SHOW SERIES ON d2 FROM t")) == [("t,a=x",)]
    assert rows(other.sql("SELECT column_name, compression_codec, data_type FROM information_schema.columns WHERE database_name = 'd2' ORDER BY ordinal_position")) == [("time", "DEFAULT", "TIMESTAMP(NS)"), ("a", "DEFAULT", "STRING"), ("f", "DELTA", "BIGINT")]
    other.sql("COMPACT DATABASE d2")
    assert "Aggregate" not in other.table("d2.t")._jdf.queryExecution().optimizedPlan().toString()
    assert "rows: 5" in rows(other.sql("EXPLAIN ANALYZE SELECT * FROM d2.t"))[0][0]
    other.sql("DROP TABLE d2.t")
    for bad in ("SELECT * FROM d2.t", "CREATE TABLE nowhere.t(f BIGINT)", "ALTER DATABASE d2 SET TTL 'soon'"):
        with pytest.raises(Exception):
            other.sql(bad)


def test_stream_table_after_a_rewrite(engine):
    """A stream reads the folder of the moment it starts, and rewrites wait for it."""
    engine.sql("CREATE STREAM TABLE src2 WITH (db = 'public', table = 'test', event_time_column = 'time') ENGINE = files")
    engine.sql("DELETE FROM test WHERE t0 = 'a' AND t1 = 'b'")
    engine.sql("INSERT INTO test(time, t0, f0) VALUES (9000, 'z', 7)")
    engine.sql("CREATE TABLE copied(f0 BIGINT, TAGS(t0))")
    engine.once = True
    (key,) = rows(engine.sql("INSERT INTO copied(time, t0, f0) SELECT time, t0, f0 FROM src2 WHERE f0 IS NOT NULL"))[0]
    for q in engine.spark.streams.active:
        if q.id == key:
            q.awaitTermination()
    assert sorted(rows(engine.sql("SELECT t0, f0 FROM copied")), key=str) == [("", 1), ("a", 1), ("z", 7), (None, 1), (None, 1)]
    engine.once = False
    (key,) = rows(engine.sql("INSERT INTO copied(time, t0, f0) SELECT time, t0, f0 FROM src2 WHERE f0 IS NOT NULL"))[0]
    with pytest.raises(SqlError, match="stream job"):
        engine.sql("DELETE FROM test WHERE t0 = 'z'")
    engine.sql(f"KILL QUERY '{key}'")
    engine.sql("DELETE FROM test WHERE t0 = 'z'")


def test_dialect_limits_and_names(engine):
    for bad in ("SELECT time_window(time, INTERVAL '1000 seconds', INTERVAL '1 second') FROM test", "SELECT time_window(time, INTERVAL '366 days') FROM test", "SELECT sample(f0, 5000) FROM test", "SELECT locf(f0) FROM test", "SELECT duration_in(compact_state_agg(time, f1), '2', '1970-01-01') FROM test", "SELECT state_at(compact_state_agg(time, f1), '1970-01-01') FROM test"):
        with pytest.raises(ValueError):
            engine.sql(bad)
    q = "SELECT regexp_match('ab12', '([a-z]+)([0-9]+)'), regexp_match('x', '[0-9]'), regexp_match('a1', '[0-9]'), regexp_replace('a.b.c', '\\.', '$'), ST_AsBinary('POINT(1 2)') IS NOT NULL, ST_GeomFromWKB(ST_AsBinary('POINT(1 2)'))"
    assert rows(engine.sql(q)) == [(["ab", "12"], None, ["1"], "a$b.c", True, "POINT(1 2)")]


def test_partitioned_external_table(engine, tmp_path):
    engine.spark.sql("SELECT 1 AS a, 'x' AS p UNION ALL SELECT 2, 'y'").write.partitionBy("p").parquet(f"{tmp_path}/parted")
    engine.sql(f"CREATE EXTERNAL TABLE parted(a INT) STORED AS PARQUET PARTITIONED BY (p) LOCATION 'file://{tmp_path}/parted'")
    assert rows(engine.sql("SELECT a FROM parted WHERE p = 'y'")) == [(2,)]
    with pytest.raises(SqlError, match="connection"):
        engine.sql("COPY INTO test FROM 's3://b/x' CONNECTION = (nothing = 'x') FILE_FORMAT = (TYPE = 'CSV')")


def test_accounts(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    for q in ("CREATE TENANT t1 WITH comment = 'first'", "CREATE USER u1 WITH PASSWORD = 'hidden', comment = 'x'", "CREATE USER IF NOT EXISTS u1", "CREATE ROLE r1 INHERIT member", "CREATE ROLE r2", "ALTER TENANT default ADD USER u1 AS r1", "GRANT READ ON DATABASE public TO ROLE r1", "GRANT ALL ON DATABASE public TO r2", "ALTER TENANT t1 SET comment = 'other'"):
        e.sql(q)
    e = Engine(spark, f"file://{tmp_path}")
    assert rows(e.sql("SELECT * FROM cluster_schema.tenants ORDER BY tenant_name")) == [("default", "comment=system tenant"), ("t1", "comment=other")]
    assert rows(e.sql("SELECT * FROM cluster_schema.users ORDER BY user_name")) == [("root", True, "granted_admin=true"), ("u1", False, "comment=x,password=*****")]
    assert rows(e.sql("SELECT * FROM information_schema.roles ORDER BY role_name")) == [("member", "system", None), ("owner", "system", None), ("r1", "custom", "member"), ("r2", "custom", None)]
    assert rows(e.sql("SELECT * FROM information_schema.members ORDER BY user_name")) == [("root", "owner"), ("u1", "r1")]
    assert rows(e.sql("SELECT database_name, privilege_type, role_name FROM information_schema.database_privileges ORDER BY role_name")) == [("public", "Read", "r1"), ("public", "All", "r2")]
    e.sql("REVOKE ALL ON DATABASE public FROM r2")
    e.sql("DROP ROLE r1")
    assert rows(e.sql("SELECT * FROM information_schema.database_privileges")) == [] and rows(e.sql("SELECT user_name FROM information_schema.members")) == [("root",)]
    for bad in ("CREATE ROLE r3 INHERIT r2", "DROP USER nobody", "GRANT READ ON DATABASE public TO owner", "GRANT READ ON DATABASE nowhere TO r2", "ALTER TENANT t1 ADD USER nobody AS owner", "CREATE TENANT t1"):
        with pytest.raises(SqlError):
            e.sql(bad)


def test_recover_database(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.sql("CREATE DATABASE gone")
    e.sql("CREATE TABLE gone.t(f BIGINT)")
    e.sql("INSERT INTO gone.t(time, f) VALUES (1, 5)")
    e.sql("DROP DATABASE gone AFTER '7d'")
    with pytest.raises(Exception):
        e.sql("SELECT * FROM gone.t")
    e = Engine(spark, f"file://{tmp_path}")
    e.sql("RECOVER DATABASE gone")
    assert rows(e.sql("SELECT f FROM gone.t")) == [(5,)]
    e.sql("DROP DATABASE gone")
    with pytest.raises(SqlError):
        e.sql("RECOVER DATABASE gone")


def test_remote_write_rejections():
    import pyarrow as pa

    assert protocols.parse_write_request(pa.Codec("snappy").compress(b"", asbytes=True)) == []
    for bad in (b"\x0a\x7f", b"\x0b", b"\x0a\x00"):
        with pytest.raises(protocols.LineError):
            protocols.parse_write_request(pa.Codec("snappy").compress(bad, asbytes=True))


def test_sliding_windows_in_sql(engine):
    """Four points 5 ms apart, windows of 10 ms every 6 ms: eight rows; with a start of 1 ms they move with it."""
    engine.sql("CREATE TABLE m2(f0 BIGINT, TAGS(t0))")
    engine.sql("INSERT INTO m2(time, t0, f0) VALUES ('1999-12-31 00:00:00.000', 'a', 111), ('1999-12-31 00:00:00.005', 'b', 222), ('1999-12-31 00:00:00.010', 'c', 333), ('1999-12-31 00:00:00.015', 'd', 444)")
    day = dt.datetime(1999, 12, 31)
    ms = lambda t: round((t - day).total_seconds() * 1000)
    q = "WITH tmp AS (SELECT time_window(time, interval '10 milliseconds', interval '6 milliseconds'{}) AS window, * FROM m2) SELECT * FROM tmp ORDER BY window.start, time"
    got = engine.sql(q.format(""))
    assert got.columns == ["window", "time", "t0", "f0"]
    assert [(ms(r.window.start), ms(r.window.end), ms(r.time)) for r in got.collect()] == [(-6, 4, 0), (-6, 4, 5), (0, 10, 0), (0, 10, 5), (0, 10, 10), (6, 16, 10), (6, 16, 15), (12, 22, 15)]
    got = engine.sql(q.format(", '1970-01-01T00:00:00.001Z'"))
    assert [(ms(r.window.start), ms(r.time)) for r in got.collect()] == [(-11, 0), (-5, 0), (-5, 5), (1, 5), (1, 10), (7, 10), (7, 15), (13, 15)]
    assert sorted((ms(r[0].start), r[1]) for r in engine.sql("SELECT time_window(time, INTERVAL '10 milliseconds', INTERVAL '6 milliseconds') AS w, count(*) AS n FROM m2 WHERE f0 > 111 GROUP BY w").collect()) == [(-6, 1), (0, 2), (6, 2), (12, 1)]


def test_epoch_in_whole_numbers_is_exact(engine):
    """Microseconds that a double of the seconds, times a million, falls short of."""
    ticks = [520_500, 132_822_423, 2_118_539_003_609, 2_120_937_460_005, 8_742_425_620_101, -2_118_539_003_609]
    for t in ticks:
        at = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=t)).isoformat(" ")
        e = f"extract(epoch FROM TIMESTAMP_NTZ '{at}')"
        assert rows(engine.sql(f"SELECT bigint(1000000 * {e}), CAST(({e} + 1) * 1000000 AS BIGINT), bigint({e}), bigint({e} / 2), {e}")) == [(t, t + 1_000_000, int(t / 1e6), int(t / 1e6 / 2), t / 1e6)]
