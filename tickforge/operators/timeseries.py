"""Time-series operators over ``events``: time ``ts``, tags ``user_id`` and ``event_type``, field ``value``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.functions import selectors, series_agg, series_ops, windows
from tickforge.functions.ticks import micros
from tickforge.model import show_series, show_tag_values
from tickforge.operators.registry import query, sql, table

_GAPS = "CASE WHEN event_id % 7 <> 0 THEN value END"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


# -- windows ------------------------------------------------------------------------
@query("window_tumbling", "SELECT make_timestamp(epoch_us(ts) - epoch_us(ts) % 600000000) AS start, event_type, count(*) AS n, round(avg(value), 6) AS a FROM events GROUP BY ALL")
def window_tumbling(spark, sf_dir):
    return windows.time_window(_events(spark, sf_dir), "ts", "10 minutes").groupBy(F.col("_window.start").alias("start"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("a"))


sql("window_tumbling_sql", "SELECT w.start AS start, count(*) AS n FROM (SELECT time_window(ts, INTERVAL '1 hour') AS w, value FROM events) t GROUP BY w.start", "SELECT make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000) AS start, count(*) AS n FROM events GROUP BY 1")

_SLIDES = "(SELECT epoch_us(ts) AS t, value, unnest([0, 1, 2]) AS i FROM events)"


@query("window_sliding", f"SELECT make_timestamp(t - t % 240000000 - i * 240000000) AS start, count(*) AS n, round(sum(value), 4) AS s FROM {_SLIDES} WHERE t - t % 240000000 - i * 240000000 + 600000000 > t GROUP BY 1")
def window_sliding(spark, sf_dir):
    return windows.time_window(_events(spark, sf_dir), "ts", "10 minutes", "4 minutes").groupBy(F.col("_window.start").alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"))


@query("window_sliding_compat", f"SELECT make_timestamp(t - t % 240000000 - i * 240000000) AS start, count(*) AS n FROM {_SLIDES} GROUP BY 1")
def window_sliding_compat(spark, sf_dir):
    return windows.time_window(_events(spark, sf_dir), "ts", "10 minutes", "4 minutes", mode="compat").groupBy(F.col("_window.start").alias("start")).agg(F.count("*").alias("n"))


sql("window_sliding_sql", "SELECT w.start AS start, count(*) AS n FROM (SELECT time_window(ts, INTERVAL '10 minutes', INTERVAL '4 minutes') AS w, * FROM events WHERE value > 0) t GROUP BY w.start", f"SELECT make_timestamp(t - t % 240000000 - i * 240000000) AS start, count(*) AS n FROM {_SLIDES} WHERE value > 0 GROUP BY 1")


@query("date_bin", "SELECT make_timestamp(epoch_us(ts) - (epoch_us(ts) - 60000000) % 300000000) AS bin, count(*) AS n FROM events GROUP BY 1")
def date_bin(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(windows.date_bin("5 minutes", "ts", 60_000_000).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "window_gap_fill",
    "WITH b AS (SELECT user_id, epoch_us(ts) - epoch_us(ts) % 21600000000 AS t, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT user_id, unnest(generate_series(min(t), max(t), 21600000000)) AS t FROM b GROUP BY user_id) SELECT user_id, make_timestamp(g.t) AS bin, n FROM g LEFT JOIN b USING (user_id, t)",
)
def window_gap_fill(spark, sf_dir):
    return windows.gap_fill(_events(spark, sf_dir), ["user_id"], "ts", "6 hours", [F.count("*").alias("n")])


# -- ordered aggregates -----------------------------------------------------------------
@query("first_last", f"SELECT user_id, arg_min(v, ts) AS f, arg_max(v, ts) AS l FROM (SELECT *, {_GAPS} AS v FROM events) WHERE v IS NOT NULL GROUP BY user_id")
def first_last(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("v", F.expr(_GAPS)).groupBy("user_id").agg(series_agg.first("ts", "v").alias("f"), series_agg.last("ts", "v").alias("l")).where("f IS NOT NULL")


sql("first_last_sql", "SELECT event_type, first(ts, value) AS f, last(ts, value) AS l FROM events GROUP BY event_type", "SELECT event_type, arg_min(value, ts) AS f, arg_max(value, ts) AS l FROM events GROUP BY event_type")


@query("mode", "SELECT user_id, k AS mode FROM (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, k) AS i FROM (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY user_id, event_type)) WHERE i = 1")
def mode(spark, sf_dir):
    return series_agg.mode(_events(spark, sf_dir), ["user_id"], "event_type")


@query("increase", "SELECT user_id, round(sum(CASE WHEN b IS NULL OR v = b THEN 0 WHEN v > b THEN v - b ELSE v END), 6) AS increase FROM (SELECT user_id, value AS v, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) GROUP BY user_id")
def increase(spark, sf_dir):
    return series_agg.increase(_events(spark, sf_dir), ["user_id"], "ts", "value").select("user_id", F.round("increase", 6).alias("increase"))


sql("increase_sql", "SELECT user_id, round(increase(ts, value ORDER BY ts), 6) AS i FROM events GROUP BY user_id", "SELECT user_id, round(sum(CASE WHEN b IS NULL OR v = b THEN 0 WHEN v > b THEN v - b ELSE v END), 6) AS i FROM (SELECT user_id, value AS v, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) GROUP BY user_id")


@query("sample", "SELECT event_type, least(count(*), 50) AS n, true AS members FROM events GROUP BY event_type")
def sample(spark, sf_dir):
    e = _events(spark, sf_dir)
    picked = series_agg.sample(e, ["event_type"], "event_id", 50, seed=7)
    found = picked.select("event_type", F.explode("sample").alias("event_id")).join(e.select("event_type", "event_id"), ["event_type", "event_id"])
    return found.groupBy("event_type").agg(F.count("*").alias("n"), (F.count_distinct("event_id") == F.count("*")).alias("members"))


_SORTED = "SELECT user_id, list(value ORDER BY ts) AS v, list(epoch_us(ts) ORDER BY ts) AS t FROM events GROUP BY user_id"


@query("gauge", f"SELECT user_id, len(v) AS n, round(v[-1] - v[1], 9) AS delta, t[-1] - t[1] AS time_delta, round((v[-1] - v[1]) / nullif(t[-1] - t[1], 0) * 1e6, 12) AS rate, t[1] AS first_time, v[1] AS first_val, t[-1] AS last_time, v[-1] AS last_val, round(v[least(2, len(v))] - v[1], 9) AS idelta_left, round(v[-1] - v[greatest(1, len(v) - 1)], 9) AS idelta_right FROM ({_SORTED})")
def gauge(spark, sf_dir):
    g = series_agg.gauge_agg(_events(spark, sf_dir), ["user_id"], "ts", "value")
    round9 = lambda c: F.round(c, 9)
    return g.select("user_id", F.col("gauge.num_elements").alias("n"), round9(series_agg.delta("gauge")).alias("delta"), series_agg.time_delta("gauge").alias("time_delta"), F.round(series_agg.rate("gauge") * 1e6, 12).alias("rate"), series_agg.first_time("gauge").alias("first_time"), series_agg.first_val("gauge").alias("first_val"), series_agg.last_time("gauge").alias("last_time"), series_agg.last_val("gauge").alias("last_val"), round9(series_agg.idelta_left("gauge")).alias("idelta_left"), round9(series_agg.idelta_right("gauge")).alias("idelta_right"))


sql("gauge_sql", "SELECT user_id, round(delta(g), 9) AS d, bigint(1000000 * extract(epoch FROM (TIMESTAMP_NTZ '1970-01-01 00:00:00' + time_delta(g)))) AS td, round(rate(g) * 1e9, 6) AS p, first_time(g) AS ft, last_time(g) AS lt, round(idelta_right(g), 9) AS r FROM (SELECT user_id, gauge_agg(ts, value ORDER BY ts) AS g FROM events GROUP BY user_id) t", f"SELECT user_id, round(v[-1] - v[1], 9) AS d, t[-1] - t[1] AS td, CASE WHEN t[-1] <> t[1] THEN round((v[-1] - v[1]) / (t[-1] - t[1]) * 1e6, 6) END AS p, make_timestamp(t[1]) AS ft, make_timestamp(t[-1]) AS lt, round(v[-1] - v[greatest(1, len(v) - 1)], 9) AS r FROM ({_SORTED})")

sql("gauge_ends_sql", "SELECT user_id, round(d, 9) AS d, ft, round(lv, 9) AS lv, round(p * 1e9, 6) AS p FROM (SELECT user_id, delta(gauge_agg(ts, value)) AS d, first_time(gauge_agg(ts, value ORDER BY ts)) AS ft, last_val(gauge_agg(ts, value)) AS lv, rate(gauge_agg(ts, value)) AS p FROM events GROUP BY user_id) t", f"SELECT user_id, round(v[-1] - v[1], 9) AS d, make_timestamp(t[1]) AS ft, round(v[-1], 9) AS lv, CASE WHEN t[-1] <> t[1] THEN round((v[-1] - v[1]) / (t[-1] - t[1]) * 1e6, 6) END AS p FROM ({_SORTED})")

_SPANS = "SELECT user_id, event_type AS state, epoch_us(ts) AS a, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts), epoch_us(ts)) AS b FROM events"


@query("state_durations", f"SELECT user_id, state, sum(b - a)::BIGINT AS duration FROM ({_SPANS}) GROUP BY ALL")
def state_durations(spark, sf_dir):
    s = series_agg.state_agg(_events(spark, sf_dir), ["user_id"], "ts", "event_type", compact=True)
    return s.select("user_id", F.explode("states").alias("s")).select("user_id", "s.state", "s.duration")


_LOW, _SPAN = 1_704_500_000_000_000, 864_000_000_000


@query("state_duration_in", f"SELECT user_id, sum(CASE WHEN state = s THEN b - a ELSE 0 END)::BIGINT AS total, sum(CASE WHEN state = s THEN greatest(0, b - greatest(a, {_LOW})) ELSE 0 END)::BIGINT AS since, sum(CASE WHEN state = s THEN greatest(0, least(b, {_LOW + _SPAN}) - greatest(a, {_LOW})) ELSE 0 END)::BIGINT AS within FROM ({_SPANS}), (SELECT min(event_type) AS s FROM events) GROUP BY user_id")
def state_duration_in(spark, sf_dir):
    e = _events(spark, sf_dir)
    s = series_agg.state_agg(e, ["user_id"], "ts", "event_type").withColumn("want", e.agg(F.min("event_type")).scalar())
    want = F.col("want")
    return s.select("user_id", series_agg.duration_in("states", want).alias("total"), series_agg.duration_in("states", want, _LOW).alias("since"), series_agg.duration_in("states", want, _LOW, _SPAN).alias("within"))


@query("state_at", f"SELECT user_id, max(CASE WHEN a <= {_LOW} AND {_LOW} < b THEN state END) AS state FROM ({_SPANS}) GROUP BY user_id")
def state_at(spark, sf_dir):
    return series_agg.state_agg(_events(spark, sf_dir), ["user_id"], "ts", "event_type").select("user_id", series_agg.state_at("states", _LOW).alias("state"))


sql("state_sql", "SELECT user_id, duration_in(s, 'click') AS total, duration_in(s, 'click', TIMESTAMP_NTZ '2024-01-10 00:00:00', INTERVAL '10' DAY) AS within, state_at(s, TIMESTAMP_NTZ '2024-01-10 00:00:00') AS state FROM (SELECT user_id, state_agg(ts, event_type) AS s FROM events GROUP BY user_id) t", f"SELECT user_id, sum(CASE WHEN state = 'click' THEN b - a ELSE 0 END)::BIGINT AS total, sum(CASE WHEN state = 'click' THEN greatest(0, least(b, 1705708800000000) - greatest(a, 1704844800000000)) ELSE 0 END)::BIGINT AS within, max(CASE WHEN a <= 1704844800000000 AND 1704844800000000 < b THEN state END) AS state FROM ({_SPANS}) GROUP BY user_id")


# -- selectors ------------------------------------------------------------------------------
@query("topk", "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 10")
def topk(spark, sf_dir):
    return selectors.topk(_events(spark, sf_dir), "value", 10, ["event_id"]).select("event_id", "value")


@query("bottom", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 10")
def bottom(spark, sf_dir):
    return selectors.bottom(_events(spark, sf_dir), "value", 10, ["event_id"]).select("event_id", "value")


# -- data quality and repair ------------------------------------------------------------------
def _outliers(of: str, rows: str) -> str:
    return f"(SELECT k, count(*) FILTER (WHERE abs(x - m) > 3 * 1.4826 * d) AS n FROM (SELECT k, x, m, median(abs(x - m)) OVER (PARTITION BY k) AS d FROM (SELECT user_id AS k, {of} AS x, median({of}) OVER (PARTITION BY user_id) AS m FROM {rows} WHERE {of} IS NOT NULL)) GROUP BY k)"


@query(
    "quality_validity",
    "WITH p AS (SELECT user_id, epoch_us(ts)::DOUBLE AS t, value AS v, lag(value) OVER w AS pv, lag(epoch_us(ts)) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, v - pv AS dv, (v - pv) / (t - pt) AS sp FROM p), q AS (SELECT *, sp - lag(sp) OVER (PARTITION BY user_id ORDER BY t) AS ds FROM s), c AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY user_id) "
    f"SELECT c.k AS user_id, CASE WHEN c.n > 1 THEN round(1 - 0.25 * (a.n + b.n + d.n + coalesce(e.n, 0)) / c.n, 9) END AS validity FROM c LEFT JOIN {_outliers('v', 'q')} a ON a.k = c.k LEFT JOIN {_outliers('dv', 'q')} b ON b.k = c.k LEFT JOIN {_outliers('sp', 'q')} d ON d.k = c.k LEFT JOIN {_outliers('ds', 'q')} e ON e.k = c.k",
)
def quality_validity(spark, sf_dir):
    e = _events(spark, sf_dir)
    return series_ops.validity(e, ["user_id"], "ts", "value").select("user_id", F.round("validity", 9).alias("validity"))


@query("quality_scores")
def quality_scores(spark, sf_dir):
    """Completeness, consistency and timeliness: a sliding scan that SQL does not express; tested on worked examples."""
    return series_ops.data_quality(_events(spark, sf_dir), ["event_type"], "ts", "value")


sql("quality_sql", "SELECT event_type, validity(ts, value) <= 1.0 AS v, completeness(ts, value) <= 1.0 AS c, consistency(ts, value) <= 1.0 AS k, timeliness(ts, value) <= 1.0 AS t FROM events GROUP BY event_type", "SELECT DISTINCT event_type, true AS v, true AS c, true AS k, true AS t FROM events")


@query("value_fill_linear", f"WITH p AS (SELECT user_id, epoch_us(ts) AS time, {_GAPS} AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), q AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS a, min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM p) SELECT q.user_id, q.time, round(CASE WHEN q.v IS NOT NULL THEN q.v WHEN l.v IS NULL THEN coalesce(r.v, 'NaN'::DOUBLE) WHEN r.v IS NULL THEN l.v ELSE l.v + (r.v - l.v) * (q.i - q.a) / (q.b - q.a) END, 8) AS value FROM q LEFT JOIN p l ON l.user_id = q.user_id AND l.i = q.a LEFT JOIN p r ON r.user_id = q.user_id AND r.i = q.b")
def value_fill_linear(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("v", F.expr(_GAPS))
    return series_ops.value_fill(e, ["user_id"], "ts", "v").withColumn("value", F.round("value", 8))


@query("value_fill_previous", f"SELECT user_id, epoch_us(ts) AS time, coalesce(last_value({_GAPS} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts), 'NaN'::DOUBLE) AS value FROM events")
def value_fill_previous(spark, sf_dir):
    return series_ops.value_fill(_events(spark, sf_dir).withColumn("v", F.expr(_GAPS)), ["user_id"], "ts", "v", "method=previous")


@query("value_fill_mean", f"SELECT user_id, epoch_us(ts) AS time, round(coalesce({_GAPS}, avg({_GAPS}) OVER (PARTITION BY user_id)), 8) AS value FROM events")
def value_fill_mean(spark, sf_dir):
    return series_ops.value_fill(_events(spark, sf_dir).withColumn("v", F.expr(_GAPS)), ["user_id"], "ts", "v", "method=mean").withColumn("value", F.round("value", 8))


@query("value_fill_ar")
def value_fill_ar(spark, sf_dir):
    return series_ops.value_fill(_events(spark, sf_dir).withColumn("v", F.expr(_GAPS)), ["event_type"], "ts", "v", "method=ar")


@query("value_fill_ma")
def value_fill_ma(spark, sf_dir):
    return series_ops.value_fill(_events(spark, sf_dir).withColumn("v", F.expr(_GAPS)), ["event_type"], "ts", "v", "method=ma")


@query("timestamp_repair")
def timestamp_repair(spark, sf_dir):
    """Iterative grid repair per user; tested on worked examples."""
    return series_ops.timestamp_repair(_events(spark, sf_dir), ["user_id"], "ts", "value")


@query("value_repair_screen")
def value_repair_screen(spark, sf_dir):
    return series_ops.value_repair(_events(spark, sf_dir), ["user_id"], "ts", "value", "method=screen")


@query("value_repair_greedy")
def value_repair_greedy(spark, sf_dir):
    return series_ops.value_repair(_events(spark, sf_dir), ["user_id"], "ts", "value", "method=lsgreedy")


# Worked examples of the dialect, series and results.
_FILL = "(VALUES (2, NULL), (3, 101.0), (4, 102.0), (6, 104.0), (8, 126.0), (10, 108.0), (14, NULL), (15, 113.0), (16, 114.0), (18, 116.0), (20, NULL), (22, NULL), (26, 124.0), (28, 126.0), (30, 128.0)) AS s(t, v)"
_GRID = "(VALUES (0, 1.0), (10, 2.0), (19, 3.0), (30, 4.0), (40, 5.0), (50, 6.0), (61, 7.0), (71, 8.0), (81, 9.0), (91, 10.0)) AS s(t, v)"
_SCORED = "(VALUES (1, 12.34), (3, 34.54), (4, 1.43), (6, 14.03), (10, 12.30), (13, 11.54), (14, 112.20), (16, 14.44), (18, 134.02), (19, 116.34), (22, 1234.45), (24, 10.36), (26, 124.21), (31, 6.34), (33, CAST('NaN' AS DOUBLE))) AS s(t, v)"
_AR = {2: 114.72727273, 14: 110.81413694, 20: 117.33359859, 22: 118.42039170}
_MA = {2: 102.33333333, 14: 108.2, 20: 110.5, 22: 110.5}


def _series(spark, values: str, nanos: bool = False):
    return spark.sql(f"SELECT CAST(t AS BIGINT){' * 1000000000' if nanos else ''} AS t, CAST(v AS DOUBLE) AS v FROM {values}")


def _filled(known: dict[int, float]) -> str:
    cases = " ".join(f"WHEN t = {t} THEN {v}::DOUBLE" for t, v in known.items())
    return f"SELECT t::BIGINT AS t, CASE {cases} ELSE v::DOUBLE END AS v FROM {_FILL}"


@query("quality_worked", "SELECT 0.823529412::DOUBLE AS completeness, 0.866666667::DOUBLE AS consistency, 0.933333333::DOUBLE AS timeliness, 0.8::DOUBLE AS validity, 0.8::DOUBLE AS by_windows")
def quality_worked(spark, sf_dir):
    s = _series(spark, _SCORED)
    scores = series_ops.data_quality(s, [], "t", "v", ticks=True).select(*(F.round(c, 9).alias(c) for c in series_ops.QUALITY))
    return scores.withColumn("by_windows", series_ops.validity(s, [], "t", "v", ticks=True).select(F.round("validity", 9)).scalar())


@query("value_fill_ar_worked", _filled(_AR))
def value_fill_ar_worked(spark, sf_dir):
    return series_ops.value_fill(_series(spark, _FILL), [], "t", "v", "method=AR", ticks=True).select(F.col("time").alias("t"), F.round("value", 8).alias("v"))


@query("value_fill_ma_worked", _filled(_MA))
def value_fill_ma_worked(spark, sf_dir):
    return series_ops.value_fill(_series(spark, _FILL), [], "t", "v", "method=MA", ticks=True).select(F.col("time").alias("t"), F.round("value", 8).alias("v"))


@query("timestamp_repair_worked", "SELECT (10 * i)::BIGINT AS t, CASE WHEN i < 10 THEN i + 1.0::DOUBLE END AS v FROM range(11) AS r(i)")
def timestamp_repair_worked(spark, sf_dir):
    out = series_ops.timestamp_repair(_series(spark, _GRID, nanos=True), [], "t", "v", ticks=True, ticks_per_ms=1_000_000)
    return out.select((F.col("time") / 1_000_000_000).cast("long").alias("t"), F.nanvl("value", F.lit(None).cast("double")).alias("v"))


_REPAIRED = "SELECT t::BIGINT AS t, (98 + t)::DOUBLE AS v FROM " + _FILL


@query("value_repair_screen_worked", _REPAIRED)
def value_repair_screen_worked(spark, sf_dir):
    return series_ops.value_repair(_series(spark, _FILL), [], "t", "v", "method=screen", ticks=True).select(F.col("time").alias("t"), F.round("value", 8).alias("v"))


@query("value_repair_greedy_worked", _REPAIRED)
def value_repair_greedy_worked(spark, sf_dir):
    return series_ops.value_repair(_series(spark, _FILL), [], "t", "v", "method=lsgreedy", ticks=True).select(F.col("time").alias("t"), F.round("value", 8).alias("v"))


@query("weighted_percentile", "WITH r AS (SELECT event_type, value, sum(user_id) OVER (PARTITION BY event_type ORDER BY value) AS run, sum(user_id) OVER (PARTITION BY event_type) AS total FROM events WHERE user_id > 0) SELECT event_type, min(value) AS percentile FROM r WHERE run >= total * 0.9 GROUP BY event_type")
def weighted_percentile(spark, sf_dir):
    return series_ops.weighted_percentile(_events(spark, sf_dir), ["event_type"], "value", "user_id", 0.9)


# -- series ---------------------------------------------------------------------------------------
@query("show_series", "SELECT DISTINCT 'events,event_type=' || event_type || ',user_id=' || user_id AS key FROM events")
def show_series_(spark, sf_dir):
    return show_series(_events(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("string")), "events", ["user_id", "event_type"])


@query("show_tag_values", "SELECT DISTINCT 'event_type' AS key, event_type AS value FROM events UNION ALL SELECT DISTINCT 'user_id', user_id::VARCHAR FROM events")
def show_tag_values_(spark, sf_dir):
    return show_tag_values(_events(spark, sf_dir), ["user_id", "event_type"])


@query("window_per_device", "SELECT user_id, day, count(*) AS active_hours FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, epoch_us(ts) // 3600000000 AS h FROM events GROUP BY ALL HAVING avg(value) > 1) GROUP BY ALL")
def window_per_device(spark, sf_dir):
    """Bins per device and day whose mean passes a threshold: the average-activity pattern of fleet dashboards."""
    bins = _events(spark, sf_dir).groupBy("user_id", F.date_trunc("day", "ts").alias("day"), F.floor(micros("ts") / 3_600_000_000).alias("h")).agg(F.avg("value").alias("a")).where("a > 1")
    return bins.groupBy("user_id", F.col("day").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("active_hours"))
