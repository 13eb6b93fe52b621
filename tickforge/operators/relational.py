"""Relational core: scans, predicates, joins, aggregation, windows, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickforge.operators.registry import query, sql, table

# -- scans, projection, predicates ------------------------------------------------
sql("scan_pruned", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05")
sql("count_pushdown", "SELECT count(*) AS n, count(l_orderkey) AS n_key, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem")
sql("exact_count", "SELECT exact_count(o_orderkey) AS n FROM orders", "SELECT count(o_orderkey) AS n FROM orders")
sql("values_relation", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b)")
sql("predicate_partition", "SELECT count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0) UNION ALL SELECT c_custkey FROM customer WHERE (c_acctbal > 0) IS NULL) t")
sql("like_ilike_regex", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_brand ILIKE 'BRAND%' AND p_type ~ '^[A-Za-z]' AND p_name !~ 'zzz'", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_brand ILIKE 'BRAND%' AND regexp_matches(p_type, '^[A-Za-z]') AND NOT regexp_matches(p_name, 'zzz')")
sql("between_in", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000.5 AND o_orderstatus IN ('O', 'F') AND o_orderkey NOT IN (1, 2, 3)")
sql("is_truth", "SELECT c_custkey FROM customer WHERE (c_acctbal > 100) IS TRUE OR (c_acctbal < -900) IS NOT FALSE")
sql("bitwise_modulo", "SELECT o_orderkey, o_orderkey & 7 AS a, o_orderkey | 8 AS o, o_orderkey ^ 5 AS x, o_orderkey % 10 AS m, -o_orderkey AS neg, o_orderstatus || '-' || o_orderpriority AS s FROM orders", "SELECT o_orderkey, o_orderkey & 7 AS a, o_orderkey | 8 AS o, xor(o_orderkey, 5) AS x, o_orderkey % 10 AS m, -o_orderkey AS neg, o_orderstatus || '-' || o_orderpriority AS s FROM orders")
sql("integer_division", "SELECT o_orderkey / 7 AS q, o_orderkey / 2.0 AS h FROM orders", "SELECT o_orderkey // 7 AS q, o_orderkey / 2.0::DOUBLE AS h FROM orders")
sql("case_cast", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band, CAST(l_quantity AS BIGINT) AS q, l_tax::STRING IS NULL AS t FROM lineitem")
sql("int_float_compare", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber = 1.0 AND l_quantity >= 10")
sql("system_variables", "SELECT @@server_version AS v, @@node_id AS n, current_tenant() AS t, current_role() AS r", "SELECT '1.0' AS v, '1' AS n, 'default' AS t, 'owner' AS r")

# -- joins --------------------------------------------------------------------------
sql("join_inner", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND o_totalprice > 100000")
sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
sql("join_right", "SELECT s_suppkey, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey")
sql("join_full", "SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_custkey < 50) c FULL OUTER JOIN (SELECT * FROM supplier WHERE s_suppkey > 5) s ON c_custkey = s_suppkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_using", "SELECT k, x, y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b USING (k)")
sql("join_natural", "SELECT k, x, y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b")
sql("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("join_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
sql("join_scalar_subquery", "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
sql("join_self_residual", "SELECT DISTINCT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey AND a.l_linenumber < b.l_linenumber AND b.l_shipdate > a.l_shipdate")
sql("join_lateral", "SELECT n_name, m FROM nation, LATERAL (SELECT max(s_acctbal) AS m FROM supplier WHERE s_nationkey = n_nationkey) t")

# -- aggregation --------------------------------------------------------------------
sql("group_having", "SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 10")
sql("group_expression_alias", "SELECT o_custkey % 10 AS k, sum(o_orderkey) AS s FROM orders GROUP BY k", "SELECT o_custkey % 10 AS k, sum(o_orderkey)::BIGINT AS s FROM orders GROUP BY k")
sql("distinct_aggregates", "SELECT l_returnflag AS f, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
sql("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("aggregate_filter", "SELECT l_linestatus AS s, count(*) FILTER (WHERE l_quantity > 25) AS big, round(avg(l_discount) FILTER (WHERE l_tax > 0.02), 6) AS d FROM lineitem GROUP BY l_linestatus")
sql("rollup", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("cube", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, grouping(l_returnflag)::TINYINT AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("grouping_sets", "SELECT l_returnflag AS f, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())")
sql("basic_aggregates", "SELECT l_returnflag AS f, count(l_tax) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag")
sql("statistics", "SELECT event_type AS k, round(corr(value, user_id), 8) AS r, round(covar(value, user_id), 6) AS cs, round(covar_pop(value, user_id), 6) AS cp, round(stddev(value), 6) AS sd, round(stddev_pop(value), 6) AS sp, round(var(value), 4) AS v, round(var_pop(value), 4) AS vp FROM events GROUP BY event_type", "SELECT event_type AS k, round(corr(value, user_id), 8) AS r, round(covar_samp(value, user_id), 6) AS cs, round(covar_pop(value, user_id), 6) AS cp, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sp, round(var_samp(value), 4) AS v, round(var_pop(value), 4) AS vp FROM events GROUP BY event_type")
sql("median", "SELECT event_type AS k, round(median(value), 8) AS m FROM events GROUP BY event_type")
sql("bool_bit_aggregates", "SELECT l_returnflag AS f, bit_and(l_orderkey) AS a, bit_or(l_linenumber) AS o, bit_xor(l_partkey) AS x, bool_and(l_quantity > 0) AS ba, bool_or(l_quantity > 49) AS bo FROM lineitem GROUP BY l_returnflag")
sql("array_agg_sorted", "SELECT n_regionkey AS k, array_join(array_sort(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS k, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
# sketches differ between engines, so the answer is whether the error bound holds
sql("approx_distinct_bound", "SELECT event_type AS k, abs(approx_distinct(user_id) - count(DISTINCT user_id)) <= 0.2 * count(DISTINCT user_id) AS ok FROM events GROUP BY event_type", "SELECT DISTINCT event_type AS k, true AS ok FROM events")
sql("approx_percentile_bound", "SELECT event_type AS k, abs(approx_percentile_cont(value, 0.9) - percentile(value, 0.9)) <= 0.02 * (max(value) - min(value)) AS ok, abs(approx_median(value) - median(value)) <= 0.02 * (max(value) - min(value)) AS mid FROM events GROUP BY event_type", "SELECT DISTINCT event_type AS k, true AS ok, true AS mid FROM events")

# -- windows, sorting, sets --------------------------------------------------------------
sql("window_ranks", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
sql("window_offsets", "SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER w AS a, lead(o_orderkey, 2) OVER w AS b, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql("window_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS a, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events")
sql("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
sql("null_order", "SELECT k, row_number() OVER (ORDER BY v) AS up, row_number() OVER (ORDER BY v DESC) AS down FROM (VALUES (1, 5), (2, NULL), (3, 1)) AS t(k, v)", "SELECT k, row_number() OVER (ORDER BY v ASC NULLS LAST) AS up, row_number() OVER (ORDER BY v DESC NULLS FIRST) AS down FROM (VALUES (1, 5), (2, NULL), (3, 1)) AS t(k, v)")
sql("last_point", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 1")
sql("union_all", "SELECT n_name AS x FROM nation UNION ALL SELECT r_name AS x FROM region")
sql("union_distinct", "SELECT n_regionkey AS x FROM nation UNION SELECT r_regionkey AS x FROM region", "SELECT n_regionkey::BIGINT AS x FROM nation UNION SELECT r_regionkey::BIGINT AS x FROM region")
sql("intersect_except", "SELECT 'i' AS op, x FROM (SELECT o_custkey AS x FROM orders INTERSECT SELECT c_custkey AS x FROM customer) a UNION ALL SELECT 'e' AS op, x FROM (SELECT c_custkey AS x FROM customer EXCEPT SELECT o_custkey AS x FROM orders) b")
sql("set_all", "SELECT 'i' AS op, x FROM (SELECT l_linenumber AS x FROM lineitem INTERSECT ALL SELECT n_regionkey AS x FROM nation) a UNION ALL SELECT 'e' AS op, x FROM (SELECT n_regionkey AS x FROM nation EXCEPT ALL SELECT r_regionkey AS x FROM region) b", "SELECT 'i' AS op, x::BIGINT AS x FROM (SELECT l_linenumber AS x FROM lineitem INTERSECT ALL SELECT n_regionkey AS x FROM nation) a UNION ALL SELECT 'e' AS op, x::BIGINT FROM (SELECT n_regionkey AS x FROM nation EXCEPT ALL SELECT r_regionkey AS x FROM region) b")
sql("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 300000) SELECT c_name FROM customer JOIN top ON c_custkey = o_custkey")

# -- star-schema queries -------------------------------------------------------------------
sql("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
sql("shipping_priority", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
sql("local_supplier_volume", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name")
sql("forecast_revenue", "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
sql("returned_items", "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name")
sql("order_priority", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority")
sql("customer_distribution", "SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) t GROUP BY n")
sql("large_orders", "SELECT o_orderkey, c_name, round(sum(l_quantity), 2) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY o_orderkey, c_name")

# -- scalar functions -------------------------------------------------------------------------
sql("strings_1", "SELECT p_partkey, ascii(p_name) AS a, bit_length(p_name) AS bl, btrim('  ' || p_name || ' ') AS bt, concat(p_name, NULL, '!') AS cc, concat_ws('-', p_brand, NULL, p_type) AS cw, initcap(lower(p_type)) AS ic, left(p_name, 3) AS l3, left(p_name, -2) AS l2, length(p_name) AS n, lpad(p_brand, 14, '*') AS lp, md5(p_name) AS md FROM part",
    "SELECT p_partkey, ascii(p_name) AS a, bit_length(p_name)::INTEGER AS bl, trim('  ' || p_name || ' ') AS bt, concat(p_name, NULL, '!') AS cc, concat_ws('-', p_brand, NULL, p_type) AS cw, array_to_string(list_transform(regexp_extract_all(lower(p_type), '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda w: upper(w[1]) || w[2:]), '') AS ic, left(p_name, 3) AS l3, left(p_name, -2) AS l2, length(p_name)::INTEGER AS n, lpad(p_brand, 14, '*') AS lp, md5(p_name) AS md FROM part")
sql("strings_2", "SELECT p_partkey, octet_length(p_name) AS ol, replace(p_name, 'a', '_') AS rp, reverse(p_name) AS rv, right(p_name, 4) AS r4, right(p_name, -3) AS r3, rpad(p_brand, 12, '.') AS rd, split_part(p_type, ' ', 1) AS sp, starts_with(p_name, 'a') AS sw, repeat('ab', 3) AS rt, strpos(p_name, 'e') AS po, substr(p_name, 2) AS s2, substr(p_name, 0, 4) AS s04, to_hex(p_partkey) AS hx, translate(p_name, 'abc', 'xyz') AS tr, upper(p_name) AS up, chr(65 + p_size) AS ch FROM part",
    "SELECT p_partkey, octet_length(encode(p_name))::INTEGER AS ol, replace(p_name, 'a', '_') AS rp, reverse(p_name) AS rv, right(p_name, 4) AS r4, right(p_name, -3) AS r3, rpad(p_brand, 12, '.') AS rd, split_part(p_type, ' ', 1) AS sp, starts_with(p_name, 'a') AS sw, repeat('ab', 3) AS rt, instr(p_name, 'e') AS po, substr(p_name, 2) AS s2, substr(p_name, 1, 3) AS s04, lower(to_hex(p_partkey)) AS hx, translate(p_name, 'abc', 'xyz') AS tr, upper(p_name) AS up, chr(65 + p_size) AS ch FROM part")
sql("digests", "SELECT p_partkey, lower(hex(sha256(p_name))) AS a, lower(hex(digest(p_name, 'md5'))) AS m FROM part", "SELECT p_partkey, sha256(p_name) AS a, md5(p_name) AS m FROM part")
sql("regexp_replace", "SELECT p_partkey, regexp_replace(p_brand, '([A-Za-z]+)(.*)', 'x\\1-\\2$', 'g') AS r, regexp_replace(p_name, '[aeiou]', '_') AS one, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every FROM part", "SELECT p_partkey, regexp_replace(p_brand, '([A-Za-z]+)(.*)', 'x\\1-\\2$', 'g') AS r, regexp_replace(p_name, '[aeiou]', '_') AS one, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every FROM part")
sql("regexp_match", "SELECT p_partkey, regexp_match(p_brand, '([A-Za-z]+)#([0-9])')[0] AS a, regexp_match(p_brand, '([A-Za-z]+)#([0-9])')[1] AS b, regexp_match(p_name, 'xyzzy') IS NULL AS none FROM part", "SELECT p_partkey, regexp_extract(p_brand, '([A-Za-z]+)#([0-9])', 1) AS a, regexp_extract(p_brand, '([A-Za-z]+)#([0-9])', 2) AS b, true AS none FROM part")
sql("extract_parts", "SELECT event_id, extract(dow FROM ts) AS d, extract(epoch FROM ts) AS e, extract(hour FROM ts + INTERVAL '1' HOUR) AS h, extract(doy FROM ts) AS y FROM events", "SELECT event_id, date_part('dow', ts)::DOUBLE AS d, epoch_us(ts) / 1000000.0::DOUBLE AS e, date_part('hour', ts + INTERVAL 1 HOUR)::DOUBLE AS h, date_part('doy', ts)::DOUBLE AS y FROM events")
sql("to_timestamp_typed", "SELECT event_id, to_timestamp(s) AS a, to_timestamp(n) AS b, to_timestamp('2024-01-02T03:04:05Z') AS c FROM (SELECT event_id, CAST(ts AS STRING) AS s, event_id * 1000 AS n FROM events) t", "SELECT event_id, ts::TIMESTAMP AS a, make_timestamp(event_id) AS b, TIMESTAMP '2024-01-02 03:04:05' AS c FROM events")
sql("weighted_percentile_sql", "SELECT event_type, approx_percentile_cont_with_weight(id, w, 0.5) AS p FROM (SELECT event_type, event_id AS id, event_id % 3 + 1 AS w FROM events) t GROUP BY event_type", "SELECT event_type, quantile_cont(id, 0.5) AS p FROM (SELECT event_type, event_id AS id, unnest(range(event_id % 3 + 1)) AS k FROM events) GROUP BY event_type")
sql("mode_sql", "SELECT event_type, mode(x) AS m FROM (SELECT event_type, event_id % 5 AS x FROM events) t GROUP BY event_type", "SELECT event_type, x AS m FROM (SELECT event_type, event_id % 5 AS x, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, event_id % 5) AS k FROM events GROUP BY event_type, event_id % 5) WHERE k = 1")
sql("math_1", "SELECT event_id, abs(value) AS a, round(acos(value / 1e9), 10) AS ac, round(asin(value / 1e9), 10) AS si, round(atan(value), 10) AS atn, round(atan2(value, 2.0), 10) AS a2, round(cbrt(value), 8) AS cb, ceil(value) AS ce, floor(value) AS fl, round(cos(value), 8) AS co, round(sin(value), 8) AS sn, round(tan(value / 1e6), 10) AS tn, signum(value) AS sg, trunc(value) AS tc, round(sqrt(abs(value)), 8) AS sq FROM events",
    "SELECT event_id, abs(value) AS a, round(acos(value / 1e9), 10) AS ac, round(asin(value / 1e9), 10) AS si, round(atan(value), 10) AS atn, round(atan2(value, 2.0), 10) AS a2, round(cbrt(value), 8) AS cb, ceil(value) AS ce, floor(value) AS fl, round(cos(value), 8) AS co, round(sin(value), 8) AS sn, round(tan(value / 1e6), 10) AS tn, sign(value)::DOUBLE AS sg, trunc(value) AS tc, round(sqrt(abs(value)), 8) AS sq FROM events")
sql("math_2", "SELECT p_partkey, round(ln(p_retailprice), 9) AS l, round(log(p_retailprice), 9) AS l10, round(log2(p_retailprice), 9) AS l2, round(log(2.0, p_retailprice), 9) AS lb, round(exp(p_size / 10.0), 6) AS e, round(pi(), 10) AS p, round(radians(p_size), 10) AS rd, round(degrees(p_size / 10.0), 8) AS dg, round(power(p_size, 2.0), 4) AS pw, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS m, round(sinh(p_size / 10.0), 6) AS sh, round(cosh(p_size / 10.0), 6) AS ch, round(tanh(p_size / 10.0), 10) AS th, round(asinh(p_size), 10) AS ah, round(acosh(p_size + 1), 10) AS ach, round(atanh(p_size / 100.0), 10) AS ath FROM part",
    "SELECT p_partkey, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS l10, round(log2(p_retailprice), 9) AS l2, round(ln(p_retailprice) / ln(2.0), 9) AS lb, round(exp(p_size / 10.0), 6) AS e, round(pi(), 10) AS p, round(radians(p_size), 10) AS rd, round(degrees(p_size / 10.0), 8) AS dg, round(power(p_size, 2.0), 4) AS pw, gcd(p_partkey, p_size)::BIGINT AS g, lcm(p_partkey, p_size)::BIGINT AS m, round(sinh(p_size / 10.0), 6) AS sh, round(cosh(p_size / 10.0), 6) AS ch, round(tanh(p_size / 10.0), 10) AS th, round(asinh(p_size), 10) AS ah, round(acosh(p_size + 1), 10) AS ach, round(atanh(p_size / 100.0), 10) AS ath FROM part")
sql("dates", "SELECT event_id, date_part('year', ts) AS y, date_part('dow', ts) AS dw, date_part('hour', ts) AS h, date_part('doy', ts) AS dy, date_trunc('hour', ts) AS th, date_trunc('week', ts) AS tw, date_bin(INTERVAL '15 minutes', ts) AS b, ts + INTERVAL '1' DAY AS nx FROM events",
    "SELECT event_id, date_part('year', ts)::DOUBLE AS y, date_part('dow', ts)::DOUBLE AS dw, date_part('hour', ts)::DOUBLE AS h, date_part('doy', ts)::DOUBLE AS dy, date_trunc('hour', ts)::TIMESTAMP AS th, date_trunc('week', ts)::TIMESTAMP AS tw, make_timestamp(epoch_us(ts) - epoch_us(ts) % 900000000) AS b, ts + INTERVAL 1 DAY AS nx FROM events")
sql("epochs", "SELECT event_id, from_unixtime(event_id) AS a, to_timestamp(event_id * 1000000000) AS b, to_timestamp_seconds(event_id) AS c, to_timestamp_millis(event_id) AS d, to_timestamp_micros(event_id) AS e FROM events",
    "SELECT event_id, make_timestamp(event_id * 1000000) AS a, make_timestamp(event_id * 1000000) AS b, make_timestamp(event_id * 1000000) AS c, make_timestamp(event_id * 1000) AS d, make_timestamp(event_id) AS e FROM events")
sql("conditional", "SELECT p_partkey, coalesce(nullif(p_size, 10), -1) AS a, nullif(p_brand, 'Brand#11') AS b FROM part")


@query("explain_pushdown", "SELECT true AS filters_reach_scan, true AS columns_pruned")
def explain_pushdown(spark, sf_dir):
    """The plan of a selective scan: its filter and its two columns reach the Parquet reader."""
    plan = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    return spark.range(1).select(F.lit("GreaterThan(l_quantity,45.0)" in plan).alias("filters_reach_scan"), F.lit("l_comment" not in plan and "l_tax" not in plan).alias("columns_pruned"))
