"""A query for every family of operators, as SQL for the engine and, where DuckDB can say the same, as its SQL.

Values come out as integers, doubles, booleans and text, so that both sides can be compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_queries
from .engine import Engine
from .plans.parser import parse
from .sources.kafka import bounds_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: name -> SQL that both sides run as it is.
SHARED = {
    "flagship": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity) * 100)::bigint AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)))::bigint AS revenue, count(*) AS n
        FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 0 ORDER BY 1, 2""",
    "scan_project": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, flag AS flag FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag AS flag FROM lineitem) t",
    "star_qualified": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "filter_predicates": "SELECT o_orderkey FROM orders WHERE (o_totalprice > 1000 AND o_orderstatus = 'F') OR NOT (o_orderpriority <> '1-URGENT')",
    "is_null_case": "SELECT c_custkey, CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NULL THEN 'none' WHEN c_acctbal < 0 THEN 'owes' ELSE 'has' END AS kind, CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS nk FROM customer",
    "in_list_3vl": "SELECT c_custkey, c_nationkey IN (1, 2, NULL) AS a, c_nationkey NOT IN (1, 2) AS b, c_nationkey NOT IN (1, NULL) AS c FROM customer",
    "between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 10 AND p_retailprice NOT BETWEEN 920 AND 980",
    "like_ilike": "SELECT p_partkey, p_name LIKE '%a_e%' AS a, p_name ILIKE 'P%' AS b, p_type NOT LIKE '%BRASS' AS c FROM part",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10",
    "topk": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50",
    "order_by_label": "SELECT n_regionkey AS n_nationkey, n_name FROM nation ORDER BY n_nationkey, n_name LIMIT 7",
    "order_by_source": "SELECT n_nationkey AS k, n_name FROM nation ORDER BY n_regionkey * -1, n_name LIMIT 9",
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000",
    "join_right": "SELECT c.c_custkey, n.n_name FROM customer c RIGHT JOIN nation n ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_nationkey = c.c_nationkey AND s.s_suppkey = c.c_custkey",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_comma": "SELECT s.s_name, n.n_name FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_using": "SELECT k, a.n AS an, b.n AS bn FROM (SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey > 9) b USING (k)",
    "join_natural": "SELECT k, x, y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b",
    "self_join": "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey",
    "three_way_join": "SELECT c.c_name, n.n_name, r.r_name FROM customer c JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON c.c_nationkey = n.n_nationkey",
    "derived_table": "SELECT t.k, t.total FROM (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) t(k, total) WHERE t.total > 12",
    "join_aggregate": "SELECT n.n_name, count(*) AS n, round(sum(o.o_totalprice))::bigint AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "agg_global": "SELECT count(*) AS n, count(o_orderstatus) AS m, min(o_orderdate) AS first, max(o_totalprice) AS most, min(o_orderpriority) AS p FROM orders",
    "agg_empty": "SELECT count(*) AS n, min(o_orderkey) AS m, max(o_orderstatus) AS x FROM orders WHERE o_orderkey < 0",
    "agg_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING max(l_quantity) > 49 AND count(*) > 20",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY l_returnflag",
    "agg_expr_key": "SELECT p_size * 2 AS twice, count(*) AS n, max(upper(p_brand)) AS b FROM part GROUP BY p_size * 2",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "setop_precedence": "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT 3",
    "setop_order": "(SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey DESC LIMIT 3) UNION ALL SELECT r_regionkey FROM region ORDER BY k LIMIT 6",
    "values": "SELECT column1 AS a, b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) t(column1, b)",
    "cte_chain": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 50000), per(k, n) AS (SELECT o_custkey, count(*) FROM big GROUP BY o_custkey) SELECT k, n FROM per WHERE n > 3",
    "cte_shadow": "WITH nation AS (SELECT 1 AS n_nationkey) SELECT n_nationkey FROM nation",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)",
    "scalar_subquery_empty": "SELECT r_regionkey, (SELECT n_name FROM nation WHERE n_nationkey < 0) AS nothing FROM region",
    "exists": "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)",
    "not_exists": "SELECT r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 200)",
    "in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "not_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "not_in_subquery_null": "SELECT 'nulls' AS what, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders) UNION ALL SELECT 'empty', count(*) FROM customer WHERE nullif(c_custkey, 5) NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 0) UNION ALL SELECT 'null argument', count(*) FROM customer WHERE nullif(c_custkey, 5) NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "in_subquery_value": "SELECT c_custkey, c_custkey IN (SELECT nullif(o_custkey, 7) FROM orders) AS has FROM customer",
    "any_subquery": "SELECT p_partkey FROM part WHERE p_size > ANY (SELECT p_size FROM part WHERE p_size > 40)",
    "all_subquery": "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part WHERE p_size < 10)",
    "some_subquery_value": "SELECT r_regionkey, r_regionkey = SOME (SELECT n_nationkey FROM nation) AS a, r_regionkey < ALL (SELECT n_nationkey FROM nation WHERE n_nationkey > 2) AS b FROM region",
    "numeric_arith": "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - l_discount AS b, -l_tax AS c, l_extendedprice / 4 AS d FROM lineitem",
    "mod": "SELECT o_orderkey, mod(o_orderkey, 7) AS a, mod(-o_orderkey, 7) AS b, abs(mod(-o_custkey, 5)) AS c FROM orders",
    "string_trim_pad": "SELECT c_custkey, trim(concat('xx', c_mktsegment, 'xy'), 'xy') AS a, ltrim(c_name, 'C') AS b, rtrim(c_mktsegment, 'GY') AS c, lpad(c_mktsegment, 4, '*') AS d, rpad(c_mktsegment, 14, 'ab') AS e FROM customer",
    "string_slice": "SELECT p_partkey, substr(p_name, 2, 3) AS a, substring(p_name, 3) AS b, left(p_name, 4) AS c, left(p_name, -2) AS d, right(p_name, 3) AS e, right(p_name, -3) AS f, length(p_name) AS n FROM part",
    "string_search": "SELECT p_partkey, strpos(p_name, 'a') AS a, strpos(p_name, '') AS b, replace(p_type, 'A', 'aa') AS c, reverse(p_brand) AS d, repeat(p_brand, 2) AS e, upper(p_name) AS f, lower(p_type) AS g FROM part",
    "concat_nullskip": "SELECT n_nationkey, concat(n_name, NULL, '-', n_nationkey) AS a, n_name || '/' || n_nationkey AS b, n_name || nullif(n_nationkey, 3) AS c FROM nation",
    "chr_ascii": "SELECT n_nationkey, chr(65 + n_nationkey) AS a, chr(8364) AS b, ascii(n_name) AS c FROM nation",
    "coalesce_nullif": "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS a, nullif(n_nationkey, n_regionkey) AS b, greatest(n_nationkey, n_regionkey, 3) AS c, least(n_nationkey, nullif(n_regionkey, 0)) AS d FROM nation",
    "date_literals": "SELECT o_orderkey, o_orderdate::date AS d, o_orderdate < timestamp '1998-01-01 00:00:00' AS early, o_orderdate::date >= date '1997-06-01' AS late FROM orders",
    "date_arith": "SELECT o_orderkey, (o_orderdate::date + 30)::text AS a, (o_orderdate::date - 1)::text AS b FROM orders",
    "date_trunc": "SELECT o_orderkey, date_trunc('month', o_orderdate)::text AS a, date_trunc('quarter', o_orderdate)::text AS b, date_trunc('week', o_orderdate)::text AS c, date_trunc('year', o_orderdate)::text AS d, date_trunc('decade', o_orderdate)::text AS e FROM orders",
    "interval_add": "SELECT o_orderkey, (o_orderdate + interval '1 month')::text AS a, (o_orderdate - interval '10 days')::text AS b, (o_orderdate + interval '90 minutes')::text AS c FROM orders",
    "make_date": "SELECT n_nationkey, make_date(2000 + n_nationkey, 1 + mod(n_nationkey, 12), 28)::text AS d FROM nation",
}

#: name -> (the engine's SQL, DuckDB's SQL or None).
PAIRS = {
    "order_nulls": ("SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r DESC, n_nationkey LIMIT 10", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r DESC NULLS FIRST, n_nationkey LIMIT 10"),
    "order_nulls_asc": ("SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r, n_nationkey OFFSET 15", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r NULLS LAST, n_nationkey OFFSET 15"),
    "agg_group": ("SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS s, avg(l_linenumber)::float8 AS a, min(l_shipdate) AS f, max(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS s, avg(l_linenumber) AS a, min(l_shipdate) AS f, max(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus"),
    "agg_sum_avg_distinct": ("SELECT l_returnflag, sum(DISTINCT l_linenumber) AS s, avg(DISTINCT l_linenumber)::float8 AS a FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag"),
    "agg_expression": ("SELECT n_regionkey, abs(0 - sum(n_nationkey)) AS s, CASE WHEN count(*) > 4 THEN 'many' ELSE 'few' END AS c FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(abs(0 - sum(n_nationkey)) AS BIGINT) AS s, CASE WHEN count(*) > 4 THEN 'many' ELSE 'few' END AS c FROM nation GROUP BY n_regionkey"),
    "agg_numeric": ("SELECT l_returnflag, sum(l_discount::numeric(10,2))::float8 AS s, max(l_tax::numeric(6,3))::text AS m FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(CAST(l_discount AS DECIMAL(10,2))) AS DOUBLE) AS s, CAST(max(CAST(l_tax AS DECIMAL(6,3))) AS VARCHAR) AS m FROM lineitem GROUP BY l_returnflag"),
    "int_division": ("SELECT o_orderkey, o_orderkey / 7 AS a, -o_orderkey / 7 AS b, o_custkey / 2 AS c FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS a, -o_orderkey // 7 AS b, o_custkey // 2 AS c FROM orders"),
    "numeric_division_double": ("SELECT n_nationkey, (n_nationkey::numeric(10,2) / 7)::float8 AS a FROM nation", "SELECT n_nationkey, CAST(round(CAST(n_nationkey AS DOUBLE) / 7, 16) AS DOUBLE) AS a FROM nation"),
    "casts": ("SELECT l_orderkey, l_linenumber, l_extendedprice::int AS a, l_quantity::bigint AS b, (l_quantity / 2)::int AS c, l_linenumber::text AS d, l_linenumber::float8 AS e, (l_linenumber > 3)::int AS f, l_linenumber::boolean AS g FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS INTEGER) AS a, CAST(l_quantity AS BIGINT) AS b, CAST(l_quantity / 2 AS INTEGER) AS c, CAST(l_linenumber AS VARCHAR) AS d, CAST(l_linenumber AS DOUBLE) AS e, CAST(l_linenumber > 3 AS INTEGER) AS f, CAST(l_linenumber AS BOOLEAN) AS g FROM lineitem"),
    "cast_text": ("SELECT n_nationkey, ('00' || n_nationkey)::int AS a, ('1.5' || n_nationkey)::float8 AS b, CASE WHEN n_nationkey > 9 THEN 'yes' ELSE 'off' END::boolean AS c, '2020-01-05'::date::text AS d FROM nation", "SELECT n_nationkey, CAST('00' || n_nationkey AS INTEGER) AS a, CAST('1.5' || n_nationkey AS DOUBLE) AS b, n_nationkey > 9 AS c, '2020-01-05' AS d FROM nation"),
    "math_round": ("SELECT l_orderkey, l_linenumber, round(l_quantity / 2) AS a, floor(l_extendedprice) AS b, ceil(l_extendedprice) AS c, trunc(-l_extendedprice) AS d, round(l_extendedprice::numeric(12,2), 1)::float8 AS e, sign(l_linenumber - 3) AS f, abs(-l_quantity) AS g FROM lineitem", "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS a, floor(l_extendedprice) AS b, ceil(l_extendedprice) AS c, trunc(-l_extendedprice) AS d, CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)), 1) AS DOUBLE) AS e, CAST(sign(l_linenumber - 3) AS INTEGER) AS f, abs(-l_quantity) AS g FROM lineitem"),
    "math_transcendental": ("SELECT p_partkey, round((sqrt(p_retailprice) * 1000000)) AS a, round(ln(p_retailprice) * 1000000) AS b, round(log(p_retailprice) * 1000000) AS c, round(power(p_size, 2)) AS d, round(exp(p_size / 10.0::float8) * 1000) AS e, round(pi() * 1000000) AS f FROM part", "SELECT p_partkey, round_even(sqrt(p_retailprice) * 1000000, 0) AS a, round_even(ln(p_retailprice) * 1000000, 0) AS b, round_even(log10(p_retailprice) * 1000000, 0) AS c, round_even(power(p_size, 2), 0) AS d, round_even(exp(p_size / CAST(10.0 AS DOUBLE)) * 1000, 0) AS e, round_even(pi() * 1000000, 0) AS f FROM part"),
    "extract": (
        "SELECT o_orderkey, extract(year FROM o_orderdate)::int AS y, extract(month FROM o_orderdate)::int AS mo, extract(day FROM o_orderdate)::int AS d, extract(quarter FROM o_orderdate)::int AS q, extract(dow FROM o_orderdate)::int AS dow, extract(isodow FROM o_orderdate)::int AS isodow, extract(doy FROM o_orderdate)::int AS doy, extract(week FROM o_orderdate)::int AS w, extract(isoyear FROM o_orderdate)::int AS iy, extract(century FROM o_orderdate)::int AS c, extract(decade FROM o_orderdate)::int AS de, extract(millennium FROM o_orderdate)::int AS mi, extract(epoch FROM o_orderdate)::bigint AS e FROM orders",
        "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, CAST(extract(month FROM o_orderdate) AS INTEGER) AS mo, CAST(extract(day FROM o_orderdate) AS INTEGER) AS d, CAST(extract(quarter FROM o_orderdate) AS INTEGER) AS q, CAST(extract(dow FROM o_orderdate) AS INTEGER) AS dow, CAST(extract(isodow FROM o_orderdate) AS INTEGER) AS isodow, CAST(extract(doy FROM o_orderdate) AS INTEGER) AS doy, CAST(extract(week FROM o_orderdate) AS INTEGER) AS w, CAST(extract(isoyear FROM o_orderdate) AS INTEGER) AS iy, CAST(extract(century FROM o_orderdate) AS INTEGER) AS c, CAST(extract(decade FROM o_orderdate) AS INTEGER) AS de, CAST(extract(millennium FROM o_orderdate) AS INTEGER) AS mi, CAST(epoch(o_orderdate) AS BIGINT) AS e FROM orders",
    ),
    "extract_clock": ("SELECT event_id, extract(hour FROM ts)::int AS h, extract(minute FROM ts)::int AS m, extract(microseconds FROM ts)::bigint AS us, date_part('second', ts) AS s FROM events", "SELECT event_id, CAST(extract(hour FROM ts) AS INTEGER) AS h, CAST(extract(minute FROM ts) AS INTEGER) AS m, CAST(extract(microseconds FROM ts) AS BIGINT) AS us, extract(microseconds FROM ts) / 1000000.0 AS s FROM events"),
    "date_diff": ("SELECT o_orderkey, date '2000-01-01' - o_orderdate::date AS days FROM orders", "SELECT o_orderkey, CAST(date '2000-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS days FROM orders"),
    "timestamp_diff": ("SELECT event_id, extract(day FROM ts - timestamp '2024-01-01 00:00:00')::int AS d, extract(epoch FROM ts - timestamp '2024-01-01 00:00:00')::float8 AS s FROM events", "SELECT event_id, CAST(floor(epoch_us(ts - timestamp '2024-01-01 00:00:00') / 86400000000) AS INTEGER) AS d, (epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) / 1000000.0 AS s FROM events"),
    "age_parts": ("SELECT o_orderkey, extract(year FROM a)::int AS y, extract(month FROM a)::int AS m, extract(day FROM a)::int AS d FROM (SELECT o_orderkey, age(timestamp '2003-03-31 00:00:00', o_orderdate) AS a FROM orders) t", "SELECT o_orderkey, CAST(datepart('year', a) AS INTEGER) AS y, CAST(datepart('month', a) AS INTEGER) AS m, CAST(datepart('day', a) AS INTEGER) AS d FROM (SELECT o_orderkey, age(timestamp '2003-03-31 00:00:00', o_orderdate) AS a FROM orders) t"),
    "interval_group": ("SELECT extract(epoch FROM v)::bigint / 86400 AS days, n FROM (SELECT v, count(*) AS n FROM (VALUES (interval '1 month'), (interval '30 days'), (interval '1 day'), (interval '24 hours'), (interval '2 days')) t(v) GROUP BY v) g", "SELECT * FROM (VALUES (CAST(30 AS BIGINT), CAST(2 AS BIGINT)), (1, 2), (2, 1)) t(days, n)"),
    "justify_parts": ("SELECT n_nationkey, extract(month FROM justify_days(make_interval(0, 0, 0, n_nationkey * 7)))::int AS m, extract(day FROM justify_days(make_interval(0, 0, 0, n_nationkey * 7)))::int AS d, extract(day FROM justify_hours(make_interval(0, 0, 0, 0, n_nationkey * 5)))::int AS hd FROM nation", "SELECT n_nationkey, CAST((n_nationkey * 7) // 30 AS INTEGER) AS m, CAST((n_nationkey * 7) % 30 AS INTEGER) AS d, CAST((n_nationkey * 5) // 24 AS INTEGER) AS hd FROM nation"),
    "to_char_date": ("SELECT o_orderkey, to_char(o_orderdate, 'YYYY-MM-DD HH24:MI:SS') AS a, to_char(o_orderdate, 'FMDay, DD FMMonth YYYY') AS b, to_char(o_orderdate, 'IYYY-IW DDD Q') AS c FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate, '%A, %d %B %Y') AS b, strftime(o_orderdate, '%G-%V %j ') || quarter(o_orderdate) AS c FROM orders"),
    "to_char_number": ("SELECT l_orderkey, l_linenumber, to_char(l_extendedprice::numeric(12,2), 'FM999,999,990.00') AS a FROM lineitem", "SELECT l_orderkey, l_linenumber, format('{:,.2f}', CAST(l_extendedprice AS DOUBLE)) AS a FROM lineitem"),
    "to_date_parse": ("SELECT o_orderkey, to_date(to_char(o_orderdate, 'DD Mon YYYY'), 'DD Mon YYYY')::text AS d FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders"),
    "to_timestamp_epoch": ("SELECT event_id, extract(epoch FROM to_timestamp(event_id * 1000))::bigint AS e FROM events", "SELECT event_id, event_id * 1000 AS e FROM events"),
    "at_time_zone": ("SELECT event_id, to_char(ts AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC', 'YYYY-MM-DD HH24:MI:SS.US') AS a FROM events", "SELECT event_id, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS a FROM events"),
    "time_of_day": ("SELECT event_id, extract(hour FROM ts::time + interval '20 hours')::int AS h FROM events", "SELECT event_id, CAST((extract(hour FROM ts) + 20) % 24 AS INTEGER) AS h FROM events"),
    "initcap": ("SELECT p_partkey, initcap(p_name || '-x ' || p_type) AS a FROM part", "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || '-x ' || p_type, '[a-zA-Z0-9]+|[^a-zA-Z0-9]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS a FROM part"),
    "agg_float": ("SELECT l_returnflag, round(avg(l_quantity) * 1000000) AS a, round(avg(DISTINCT l_discount) * 1000000) AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round_even(avg(l_quantity) * 1000000, 0) AS a, round_even(avg(DISTINCT l_discount) * 1000000, 0) AS d FROM lineitem GROUP BY l_returnflag"),
    "runtime_fields": ("SELECT o_orderkey, date_part(CASE WHEN mod(o_orderkey, 2) = 0 THEN 'year' ELSE 'doy' END, o_orderdate) AS p, date_trunc(CASE WHEN mod(o_orderkey, 2) = 0 THEN 'month' ELSE 'year' END, o_orderdate)::text AS t, to_char(o_orderdate, CASE WHEN mod(o_orderkey, 2) = 0 THEN 'YYYY-MM' ELSE 'FMMonth DDD' END) AS c FROM orders", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) ELSE dayofyear(o_orderdate) END AS DOUBLE) AS p, strftime(CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('month', o_orderdate) ELSE date_trunc('year', o_orderdate) END, '%Y-%m-%d %H:%M:%S') AS t, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%B %j') END AS c FROM orders"),
    "trim_unicode": ("SELECT n_nationkey, btrim('  ' || n_name || '  ') AS a, length(ltrim('   ' || n_name)) AS b FROM nation", "SELECT n_nationkey, n_name AS a, length(n_name) AS b FROM nation"),
    "natural_no_common": ("SELECT r_name, x FROM region NATURAL JOIN (VALUES (1), (2)) v(x)", "SELECT r_name, x FROM region CROSS JOIN (VALUES (1), (2)) v(x)"),
    "values_untyped": ("VALUES (1, 'a'), (2.5, NULL)", "SELECT CAST(column1 AS VARCHAR) AS column1, column2 FROM (VALUES ('1.0', 'a'), ('2.5', NULL)) t(column1, column2)"),
}


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        engine.register_parquet(sf_dir, *(t for t in TABLES if t in text))
        out = engine.sql(text)
        decimals = {n for n, k in out.dtypes if k.startswith("decimal")}
        return out.select(*(F.col(n).cast("string").alias(n) if n in decimals else F.col(n) for n in out.columns))

    return run


def dml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE, INSERT, UPDATE, DELETE and a rolled-back block, and what is left."""
    engine = Engine(spark)
    engine.execute(
        """CREATE TABLE t (id int4, name text, qty int8);
        INSERT INTO t VALUES (1, 'a', 10), (2, 'b', NULL), (3, 'c', 30); INSERT INTO t (name, id) VALUES ('d', 4);
        UPDATE t SET qty = coalesce(qty, 0) + id, name = upper(name) WHERE id <> 3; DELETE FROM t WHERE qty > 10;
        BEGIN; DELETE FROM t; INSERT INTO t VALUES (9, 'z', 9); ROLLBACK"""
    )
    return engine.sql("SELECT id, name, qty FROM t")


def kafka_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset bounds that filters give to a topic's reader."""
    wheres = ["_partition = 0 AND _offset >= 1", "_partition = 2 AND _offset BETWEEN 5 AND 9", "_offset > 3", "_partition = 1 OR _offset = 2", "7 > _offset AND 1 = _partition"]
    rows = []
    for i, w in enumerate(wheres):
        found = bounds_of(parse(f"SELECT 1 FROM t WHERE {w}")[0].body.where)
        for p, (lo, hi) in (found.partitions if found else {None: (None, None)}).items():
            rows.append((i, p, lo, hi))
    return spark.createDataFrame(rows, "id int, part int, low long, high long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    sql = SHARED | {k: v[0] for k, v in PAIRS.items()}
    return {k: _sql(v) for k, v in sql.items()} | {"dml_round_trip": dml_round_trip, "kafka_bounds": kafka_bounds} | fixed_queries.queries()


def oracle_sql() -> dict[str, str]:
    out = dict(SHARED) | {k: v[1] for k, v in PAIRS.items() if v[1]}
    out["flagship"] = out["flagship"].replace("round(sum(l_quantity) * 100)", "round_even(sum(l_quantity) * 100, 0)").replace("round(sum(l_extendedprice * (1 - l_discount)))", "round_even(sum(l_extendedprice * (1 - l_discount)), 0)")
    out["dml_round_trip"] = "SELECT CAST(id AS INTEGER) AS id, name, CAST(qty AS BIGINT) AS qty FROM (VALUES (2, 'B', 2), (4, 'D', 4)) t(id, name, qty)"
    out["kafka_bounds"] = "SELECT CAST(id AS INTEGER) AS id, CAST(part AS INTEGER) AS part, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high FROM (VALUES (0, 0, 1, NULL), (1, 2, 5, 10), (2, NULL, NULL, NULL), (3, NULL, NULL, NULL), (4, 1, NULL, 7)) t(id, part, low, high)"
    return out | fixed_queries.oracle_sql()
