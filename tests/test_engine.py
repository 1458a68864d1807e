"""Statements and what they give; expected values follow PostgreSQL."""

import datetime as dt
import random
from decimal import Decimal as D

import duckdb
import pytest
from pyspark.sql import functions as F

from pelago import fixed_queries
from pelago.engine import Engine
from pelago.functions import formatting
from pelago.types import TEXT, PgType, Val

TABLES = """
CREATE TABLE staff (id int4, who text, unit_id int4); INSERT INTO staff VALUES (4, 'dora', 70), (5, 'eli', 80), (6, 'fay', NULL);
CREATE TABLE unit (id int4, title text); INSERT INTO unit VALUES (70, 'press'), (80, 'field'), (90, 'depot');
CREATE TABLE stock (id int4, wood text); INSERT INTO stock VALUES (5, 'oak'), (6, 'elm'), (6, 'elm'), (7, 'fir');
CREATE TABLE shelf (id int4, wood text); INSERT INTO shelf VALUES (6, 'elm'), (7, 'fir'), (8, 'yew');
CREATE TABLE marks (p int4, q int4, tag text); INSERT INTO marks VALUES (11, 70, 'm'), (12, 60, 'n'), (13, 80, 'o'), (11, 90, 'p');
CREATE TABLE takings (place text, total int4); INSERT INTO takings VALUES ('quay', 15), ('quay', 25), ('mall', 6), ('mall', 6), ('park', 120);
"""


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.execute(TABLES)
    return e


ROWS = [
    ("SELECT s.who, u.title FROM staff s JOIN unit u ON s.unit_id = u.id ORDER BY 1", [("dora", "press"), ("eli", "field")]),
    ("SELECT s.who, u.title FROM staff s LEFT JOIN unit u ON s.unit_id = u.id ORDER BY s.id", [("dora", "press"), ("eli", "field"), ("fay", None)]),
    ("SELECT s.who, u.title FROM staff s RIGHT JOIN unit u ON s.unit_id = u.id ORDER BY u.id", [("dora", "press"), ("eli", "field"), (None, "depot")]),
    ("SELECT s.who, u.title FROM staff s FULL JOIN unit u ON s.unit_id = u.id ORDER BY u.id, s.id", [("dora", "press"), ("eli", "field"), (None, "depot"), ("fay", None)]),
    ("SELECT count(*) FROM staff, unit", [(9,)]),
    ("SELECT id, stock.wood, shelf.wood FROM stock FULL JOIN shelf USING (id) WHERE id <> 6 ORDER BY id", [(5, "oak", None), (7, "fir", "fir"), (8, None, "yew")]),
    ("SELECT * FROM stock NATURAL JOIN shelf ORDER BY id", [(6, "elm"), (6, "elm"), (7, "fir")]),
    ("SELECT id, wood FROM stock UNION SELECT id, wood FROM shelf ORDER BY id", [(5, "oak"), (6, "elm"), (7, "fir"), (8, "yew")]),
    ("SELECT id FROM stock INTERSECT ALL SELECT id FROM shelf ORDER BY 1", [(6,), (7,)]),
    ("SELECT id FROM stock EXCEPT ALL SELECT id FROM shelf ORDER BY 1", [(5,), (6,)]),
    ("SELECT 1 UNION SELECT 2 INTERSECT SELECT 3", [(1,)]),
    ("SELECT NULL UNION SELECT 1 ORDER BY 1", [(1,), (None,)]),
    ("SELECT '2' UNION SELECT 1 ORDER BY 1", [(1,), (2,)]),
    ("SELECT p AS q FROM marks ORDER BY q + 0", [(12,), (11,), (13,), (11,)]),
    ("SELECT p AS q FROM marks ORDER BY q", [(11,), (11,), (12,), (13,)]),
    ("SELECT DISTINCT p AS x FROM marks ORDER BY p DESC", [(13,), (12,), (11,)]),
    ("SELECT unit_id FROM staff ORDER BY unit_id", [(70,), (80,), (None,)]),
    ("SELECT unit_id FROM staff ORDER BY unit_id DESC LIMIT 2 OFFSET 0", [(None,), (80,)]),
    ("SELECT place, sum(total), avg(total)::float8, count(DISTINCT total) FROM takings GROUP BY place HAVING sum(total) > 11 ORDER BY place", [("mall", 12, 6.0, 1), ("park", 120, 120.0, 1), ("quay", 40, 20.0, 2)]),
    ("SELECT count(*), sum(total), min(place) FROM takings WHERE false", [(0, None, None)]),
    ("SELECT sum(total) FROM takings HAVING count(*) > 99", []),
    ("SELECT abs(0 - sum(total)) + count(*) FROM takings", [(177,)]),
    ("SELECT total * 2 AS d, count(*) FROM takings GROUP BY total * 2 ORDER BY d LIMIT 1", [(12, 2)]),
    ("SELECT id FROM staff WHERE unit_id IN (SELECT id FROM unit) ORDER BY id", [(4,), (5,)]),
    ("SELECT id FROM unit WHERE id NOT IN (SELECT unit_id FROM staff)", []),
    ("SELECT id, id IN (SELECT unit_id FROM staff) FROM unit ORDER BY id", [(70, True), (80, True), (90, None)]),
    ("SELECT id > ALL (SELECT 4), id > ALL (SELECT id FROM unit WHERE false), id < ANY (VALUES (5), (NULL)) FROM staff ORDER BY id", [(False, True, True), (True, True, None), (True, True, None)]),
    ("SELECT 1 = ALL (VALUES (1), (1)), 1 <> ANY (VALUES (1), (2)), 1 = ANY (VALUES (2), (NULL))", [(True, True, None)]),
    ("SELECT (SELECT max(id) FROM unit), EXISTS (SELECT 1 FROM staff WHERE id > 8), (SELECT id FROM staff WHERE id > 9)", [(90, False, None)]),
    ("WITH x AS (SELECT 1 AS n), y(m) AS (SELECT n + 1 FROM x) SELECT * FROM x, y", [(1, 2)]),
    ("VALUES (1, 'a'), (2.5, NULL) ORDER BY 1 DESC", [(D("2.5"), None), (D("1.0"), "a")]),
    ("SELECT t.y FROM (VALUES (1, 2)) t(x, y)", [(2,)]),
    ("SELECT 7 / 2, -7 / 2, mod(-7, 3), 7 / 2.0::float8, -(-3)", [(3, -3, -1, 3.5, 3)]),
    ("SELECT 1.5 + 1, 1.10 * 2, 1e3, 1.0 / 3", [(D("2.5"), D("2.20"), D("1000"), D("0.33333333333333333333"))]),
    ("SELECT 2.5::int, 2.5::float8::int, 3.5::float8::int, -2.5::int, round(2.5::float8), round(2.5)", [(3, 2, 4, -3, 2.0, D("3"))]),
    ("SELECT round(1234.567, 1), round(1234.567, -2), trunc(-1.99, 1), sign(-2.5::float8), sign(-3), ceil(1.2), floor(-1.2::float8)", [(D("1234.6"), D("1200"), D("-1.90"), -1.0, -1, D("2"), -2.0)]),
    ("SELECT 'yes'::bool, 'off'::boolean, true::int, 0::bool, true::text, 1.50::text, 0.1::float8::text, ' 12 '::int", [(True, False, 1, False, "true", "1.50", "0.1", 12)]),
    ("SELECT NULL AND false, NULL OR true, NOT NULL, 1 IN (2, NULL), 1 NOT IN (1, NULL), 3 BETWEEN 5 AND 1", [(False, True, None, None, False, False)]),
    ("SELECT 'abc' LIKE 'a%', 'a%c' LIKE 'a\\%c', 'abc' LIKE 'a\\%c', 'ABC' ILIKE 'a_c', 'É' ILIKE 'é', NULL LIKE 'x'", [(True, True, False, True, False, None)]),
    ("SELECT 'a' || 1 || true, 'a' || NULL, concat('a', NULL, 1, true), concat()", [("a1t", None, "a1t", "")]),
    ("SELECT substr('abcdef', 0, 2), substr('abcdef', -1, 3), substring('abcdef' FROM 2 FOR 3), substr('abc', 2)", [("a", "a", "bcd", "bc")]),
    ("SELECT left('abc', -1), right('abc', -1), left('abc', 9), right('abc', 2), lpad('abc', 2), rpad('a', 3, 'xy'), lpad('a', 0), repeat('ab', -1)", [("ab", "bc", "abc", "bc", "ab", "axy", "", "")]),
    ("SELECT initcap('hello-wORLD 3d'), chr(8364), ascii('€'), strpos('abc', ''), strpos('abc', 'z'), reverse('añb'), replace('aaa', '', 'b'), btrim('xxaxx', 'x')", [("Hello-World 3d", "€", 8364, 1, 0, "bña", "aaa", "a")]),
    ("SELECT coalesce(NULL, 1, 2.5), nullif(1, 1), greatest(1, NULL, 3), least('b', 'a'), greatest(NULL)", [(D("1.0"), None, 3, "a", None)]),
    ("SELECT CASE WHEN false THEN 1 END, CASE 3 WHEN 3 THEN 1.5 ELSE 2 END, CASE NULL WHEN NULL THEN 1 ELSE 0 END", [(None, D("1.5"), 0)]),
    ("SELECT log(100), ln(1), power(2, 10), sqrt(16), pi() > 3.14, exp(0)", [(2.0, 0.0, 1024.0, 4.0, True, 1.0)]),
    ("SELECT sqrt(4.0)::text, ln(2.0)::text, power(2.0, 3)::text, round(ln(2.0), 10)", [("2.000000000000000", "0.6931471805599453", "8.0000000000000000", D("0.6931471806"))]),
    ("SELECT date '2024-01-31' + 1, date '2024-03-01' - date '2024-02-01', date '2024-01-31' + interval '1 month'", [(dt.date(2024, 2, 1), 29, dt.datetime(2024, 2, 29))]),
    ("SELECT interval '1 month' = interval '30 days', interval '1 day' < interval '25 hours', (interval '1 month' * 1.5)::text, (interval '1 day' / 3)::text, (-interval '2 days')::text", [(True, True, "1 mon 15 days", "08:00:00", "-2 days")]),
    ("SELECT '1 year 2 mons 3 days 04:05:06.5'::interval::text, '1.5 days'::interval::text, '-1 day +02:00'::interval::text, '500 ms'::interval::text", [("1 year 2 mons 3 days 04:05:06.5", "1 day 12:00:00", "-1 days +02:00:00", "00:00:00.5")]),
    ("SELECT count(*) FROM (SELECT v FROM (VALUES (interval '1 month'), (interval '30 days'), (interval '1 day'), (interval '24 hours'), (interval '2 days')) t(v) GROUP BY v) g", [(3,)]),
    ("SELECT age(timestamp '2024-03-01 00:00:00', timestamp '2023-12-31 12:00:00')::text, age(timestamp '2001-04-10 00:00:00', timestamp '1957-06-13 00:00:00')::text", [("2 mons 12:00:00", "43 years 9 mons 27 days")]),
    ("SELECT extract(dow FROM date '2024-01-07')::int, extract(century FROM date '2000-12-31')::int, extract(isoyear FROM date '2024-12-30')::int, extract(epoch FROM interval '1 day 2 hours')::int, extract(second FROM time '10:00:03.5')::float8, date_part('hour', timestamp '2024-01-01 05:00:00')", [(0, 20, 2025, 93600, 3.5, 5.0)]),
    ("SELECT date_trunc('century', timestamp '2024-02-15 10:00:00'), date_trunc('week', date '2024-02-15'), date_trunc('hour', interval '3 hours 20 minutes')::text", [(dt.datetime(2001, 1, 1), dt.datetime(2024, 2, 12), "03:00:00")]),
    ("SELECT (time '23:30' + interval '1 hour')::text, (time '10:00' - time '09:30')::text, date '2024-01-01' + time '12:30'", [("00:30:00", "00:30:00", dt.datetime(2024, 1, 1, 12, 30))]),
    ("SELECT timestamp '2024-01-01 00:00:00' AT TIME ZONE 'America/New_York' = timestamptz '2024-01-01 05:00:00+00', timestamptz '2024-07-01 12:00:00Z' AT TIME ZONE 'Asia/Tokyo'", [(True, dt.datetime(2024, 7, 1, 21))]),
    ("SELECT make_date(2024, 2, 29), make_time(1, 2, 3.5)::text, make_interval(1, 2, 3, 4)::text, make_timestamp(2024, 1, 2, 3, 4, 5.5)", [(dt.date(2024, 2, 29), "01:02:03.5", "1 year 2 mons 25 days", dt.datetime(2024, 1, 2, 3, 4, 5, 500000))]),
    ("SELECT justify_days(interval '35 days')::text, justify_hours(interval '27 hours')::text, justify_interval(interval '1 mon -1 hour')::text", [("1 mon 5 days", "1 day 03:00:00", "29 days 23:00:00")]),
    ("SELECT to_char(timestamp '2024-01-07 15:04:05.678', 'YYYY-MM-DD HH12:MI:SS.MS AM'), to_char(date '2024-01-07', 'FMDay DDth \"of\" FMMonth, IYYY-IW'), to_char(interval '100 hours 5 min', 'HH24:MI'), to_char(date '2024-03-02', 'RM|Mon|DY')", [("2024-01-07 03:04:05.678 PM", "Sunday 07th of January, 2024-01", "100:05", "III |Mar|SAT")]),
    ("SELECT to_char(1234.5, '9,999.99'), to_char(-5, 'S999'), to_char(0.5, '9.9'), to_char(12, 'FM999'), to_char(-12, '99MI'), to_char(12345, '999'), to_char(12.45, '99V9'), to_char(22, '99th'), to_char(148.5, 'FM999.990'), to_char(5, 'FM9.'), to_char(0, '0000.00')", [(" 1,234.50", "  -5", "  .5", "12", "12-", " ###", " 125", " 22nd", "148.500", "5.", " 0000.00")]),
    ("SELECT to_date('07 Jan 2024', 'DD Mon YYYY'), to_timestamp('2024-01-07 03:04 PM', 'YYYY-MM-DD HH12:MI AM')::text, extract(epoch FROM to_timestamp(1.5))::float8", [(dt.date(2024, 1, 7), "2024-01-07 15:04:00+00", 1.5)]),
    ("SELECT now() = current_timestamp, current_date = now()::date, localtimestamp = now()::timestamp, clock_timestamp() >= now()", [(True, True, True, True)]),
]


@pytest.mark.parametrize(("sql", "rows"), ROWS, ids=[str(i) for i in range(len(ROWS))])
def test_rows(engine, sql, rows):
    found = [tuple(r) for r in engine.sql(sql).collect()]
    if " ORDER BY " in sql.upper():
        assert found == rows
    else:
        assert sorted(found, key=repr) == sorted(rows, key=repr)


STATES = [
    ("SELECT 1 / 0", "22012"), ("SELECT mod(1, 0)", "22012"), ("SELECT 1.0 / 0", "22012"), ("SELECT 2147483647 + 1", "22003"), ("SELECT 3000000000::int", "22003"), ("SELECT 'abc'::int", "22P02"), ("SELECT 'maybe'::bool", "22P02"),
    ("SELECT '2024-13-01'::date", "22008"), ("SELECT 'x'::date", "22007"), ("SELECT interval '5 fortnights'", "22007"), ("SELECT make_date(2023, 2, 29)", "22008"), ("SELECT sqrt(-1)", "2201F"), ("SELECT ln(0)", "2201E"), ("SELECT power(0, -1)", "2201F"),
    ("SELECT chr(0)", "54000"), ("SELECT substr('a', 1, -1)", "22011"), ("SELECT 'a' LIKE 'a\\'", "22025"), ("SELECT x FROM staff", "42703"), ("SELECT e.x FROM staff e", "42703"), ("SELECT q.id FROM staff", "42P01"), ("SELECT * FROM nosuch", "42P01"),
    ("SELECT id FROM stock, shelf", "42702"), ("SELECT 1 FROM stock, stock", "42712"), ("SELECT who FROM staff GROUP BY id", "42803"), ("SELECT sum(count(*)) FROM staff", "42803"), ("SELECT 1 FROM staff WHERE count(*) > 1", "42803"), ("SELECT nosuch(1)", "42883"), ("SELECT upper(1)", "42883"),
    ("SELECT sum(who) FROM staff", "42883"), ("SELECT DISTINCT p FROM marks ORDER BY q", "42P10"), ("SELECT p FROM marks ORDER BY 2", "42P10"), ("SELECT p AS q, q FROM marks ORDER BY q", "42702"), ("SELECT 1 UNION SELECT 1, 2", "42601"), ("SELECT 1 UNION SELECT true", "42804"),
    ("SELECT 1 AND true", "42804"), ("SELECT who = id FROM staff", "42804"), ("SELECT (SELECT id FROM staff)", "21000"), ("SELECT (SELECT id, who FROM staff)", "42601"), ("SELEC 1", "42601"), ("SELECT 1 FROM", "42601"), ("SELECT $1", "0A000"), ("WITH RECURSIVE x AS (SELECT 1) SELECT 1", "0A000"),
    ("SELECT 1::float8::bool", "42846"), ("SELECT 1::nosuch", "42704"), ("SELECT extract(fortnight FROM date '2024-01-01')", "22023"), ("SELECT upper(DISTINCT 'a')", "42809"), ("SELECT *", "0A000"), ("CREATE TABLE staff (id int4)", "42P07"), ("INSERT INTO staff VALUES (1, 2, 3)", "42804"),
    ("INSERT INTO staff VALUES (1, 'a', 3, 4)", "42601"), ("INSERT INTO staff (nosuch) VALUES (1)", "42703"), ("UPDATE staff SET id = (SELECT 1)", "0A000"), ("DROP TABLE nosuch", "42P01"), ("SELECT " + "(" * 60 + "1" + ")" * 60, "54001"), ("SELECT to_date('2024-02-30', 'YYYY-MM-DD')", "22008"), ("SELECT 12345678::numeric(5,2)", "22003"),
]


@pytest.mark.parametrize(("sql", "state"), STATES, ids=[str(i) for i in range(len(STATES))])
def test_sqlstates(engine, sql, state):
    assert engine.state_of(sql) == state


def test_writes_and_transactions(spark, tmp_path):
    for warehouse in (None, str(tmp_path)):
        e = Engine(spark, warehouse)
        assert e.execute("CREATE TABLE t (id int4, v numeric(6,2)); INSERT INTO t VALUES (1, 1.005), (2, NULL); INSERT INTO t (id) VALUES (3)") == ["CREATE TABLE", "INSERT 0 2", "INSERT 0 1"]
        assert e.execute("UPDATE t SET v = id, id = id + 10 WHERE v IS NULL; DELETE FROM t WHERE v > 2.5") == ["UPDATE 2", "DELETE 1"]
        assert sorted(map(tuple, e.sql("SELECT id, v FROM t").collect())) == [(1, D("1.01")), (12, D("2.00"))]
        before = e.sql("SELECT count(*) FROM t")
        e.execute("BEGIN; DELETE FROM t")
        assert e.sql("SELECT count(*) FROM t").collect()[0][0] == 0 and before.collect()[0][0] == 2
        assert e.state_of("SELECT nosuch") == "42703" and e.state_of("SELECT 1") == "25P02"
        assert e.execute("COMMIT") == ["ROLLBACK"] and e.sql("SELECT count(*) FROM t").collect()[0][0] == 2


def test_time_zone(spark):
    e = Engine(spark)
    try:
        e.execute("SET TIME ZONE 'America/New_York'")
        assert e.sql("SHOW timezone").collect()[0][0] == "America/New_York"
        row = e.sql("SELECT timestamptz '2024-03-09 12:00:00+00'::text, (timestamptz '2024-03-09 12:00:00-05' + interval '1 day')::text, to_char(timestamptz '2024-07-01 12:00:00+00', 'HH24:MI TZH')").collect()[0]
        assert tuple(row) == ("2024-03-09 07:00:00-05", "2024-03-10 12:00:00-04", "08:00 -04")
        assert e.state_of("SET TIME ZONE 'Nowhere/Land'") == "22023"
    finally:
        e.execute("RESET timezone")


def test_set_in_a_block(spark):
    e = Engine(spark)
    zone = lambda: e.sql("SHOW TIME ZONE").collect()[0][0]
    try:
        e.execute("BEGIN; SET TIME ZONE 'Asia/Tokyo'; ROLLBACK")
        assert zone() == "UTC"
        e.execute("BEGIN; SET LOCAL TIME ZONE 'Asia/Tokyo'")
        assert zone() == "Asia/Tokyo"
        e.execute("COMMIT")
        assert zone() == "UTC"
        e.execute("BEGIN; SET TIME ZONE 'Asia/Tokyo'; COMMIT")
        assert zone() == "Asia/Tokyo"
    finally:
        e.execute("RESET timezone")


def test_describe_runs_nothing(engine):
    assert engine.describe("SELECT id / 0 AS a, avg(id), min(who), NULL AS n, (SELECT max(id) FROM unit) AS m, interval '1 day' AS i, count(*) FROM staff GROUP BY id") == [("a", "int4"), ("avg", "numeric(38,16)"), ("min", "text"), ("n", "text"), ("m", "int4"), ("i", "interval"), ("count", "int8")]


def test_names_of_columns(engine):
    assert engine.sql("SELECT id, id + 1, upper(who), count(*) AS n, 1::int8, 'x' FROM staff GROUP BY id, upper(who)").columns == ["id", "?column?", "upper", "n", "int8", "?column?"]
    assert engine.sql("VALUES (1, 2)").columns == ["column1", "column2"]
    assert engine.sql('SELECT 1 AS "Mixed Case"').columns == ["Mixed Case"]


@pytest.mark.parametrize("name", ["numeric_arith", "to_char_number"])
def test_number_queries_take_every_row(spark, name):
    from pelago import queries

    folder = "/root/testdata/sf0.01"
    assert queries.queries()[name](spark, folder).count() == spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert "WHERE" not in queries.oracle_sql()[name]


@pytest.mark.parametrize("name", [*fixed_queries.EXPRESSIONS, *fixed_queries.ROWS, "sqlstates", "described", "foreign_table"])
def test_fixed_answers(spark, name):
    found = fixed_queries.queries()[name](spark, "/root/testdata/sf0.001")
    want = duckdb.sql(fixed_queries.oracle_sql()[name])
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_number_templates_as_columns_and_row_by_row(spark):
    rng = random.Random(6)
    marks = ["9", "9", "9", "0", ",", ".", "S", "MI", "PL", "SG", "PR", "FM", "TH", "th", "$", "V", "B", "x"]
    templates = {"".join(rng.choice(marks) for _ in range(rng.randint(1, 9))) for _ in range(150)}
    templates = sorted(t for t in templates if t.count(".") <= 1)[:100]
    values = [D(x) for x in ("0", "0.004", "-0.004", "0.5", "-0.5", "1", "-1", "12", "-12.345", "21.995", "112", "999.999", "-999.995", "12345.678", "-100000", "7.1")] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(12,3)")
    columns = [formatting.to_char_number(Val(F.col("v"), PgType("numeric", 12, 3)), Val(F.lit(t), TEXT, t)).alias(f"c{i}") for i, t in enumerate(templates)]
    for at in range(0, len(columns), 20):
        for r in df.select("v", *columns[at : at + 20]).collect():
            for i, got in enumerate(r[1:], at):
                want = None if r.v is None else formatting.NumberTemplate.parse(templates[i]).format(r.v)
                assert got == want, (templates[i], r.v)


def test_nulls_and_volatile_values(spark):
    e = Engine(spark)
    assert e.sql("SELECT to_char(v, 'FM99.0') AS c FROM (VALUES (1.25), (NULL)) t(v)").collect()[1][0] is None
    first, second = e.sql("WITH c AS (SELECT clock_timestamp() AS t) SELECT a.t, b.t FROM c a CROSS JOIN c b").collect()[0]
    assert first == second


@pytest.mark.parametrize("on", ["a.k = b.k AND a.v < b.v", "b.v <= a.v AND b.w = a.w AND a.k = b.k", "a.k = b.k AND a.v > b.v", "a.v >= b.v AND a.k = b.k"])
def test_pairs_of_a_tables_rows_by_order(spark, on):
    """Keys with several blocks, one row and none; equal values, nulls, NaN, both zeros."""
    rng = random.Random(7)
    odd = [None, float("nan"), -0.0, 0.0, float("inf")]
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), rng.choice([0.0, -0.0, None]), rng.choice(odd) if i % 9 == 0 else float(rng.randrange(300)), rng.choice([None, f"n{i}"])) for i in range(800)] + [(-1, "z", 0.0, 1.0, None)]
    e = Engine(spark)
    e.register("t", spark.createDataFrame(rows, "id int, k string, w double, v double, name string"))

    def order(v):
        return (v != v, 0 if v != v else v)

    compared = {"<": lambda a, b: order(a) < order(b), "<=": lambda a, b: order(b) <= order(a), ">": lambda a, b: order(a) > order(b), ">=": lambda a, b: order(a) >= order(b)}[on.split(".v ")[1].split()[0]]
    same = [1, 2] if "w" in on else [1]
    want = sorted((a[0], b[0]) for a in rows for b in rows if None not in [x[i] for x in (a, b) for i in (*same, 3)] and all(a[i] == b[i] for i in same) and compared(a[3], b[3]))
    found = e.sql(f"SELECT a.*, b.id AS other, b.w AS ow, b.v AS ov, b.name AS oname FROM t a JOIN t b ON {on}").collect()
    assert sorted((r.id, r.other) for r in found) == want
    by_id = {r[0]: r for r in rows}
    assert all(repr(tuple(r)) == repr((*by_id[r.id], r.other, *by_id[r.other][2:])) for r in found)


def test_pairs_of_one_key_are_made_by_several_tasks(spark):
    e = Engine(spark)
    e.register("t", spark.range(0, 3000, 1, 1).select("id", F.lit("k").alias("k")))
    parts = [r["count"] for r in e.sql("SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.k = b.k AND a.id < b.id").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 3000 * 2999 // 2 and max(parts) < 0.6 * sum(parts)


def test_other_self_joins_keep_their_filters_below(spark):
    e = Engine(spark)
    e.register("t", spark.range(100).select("id", (F.col("id") % 3).alias("k")))
    join = "SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.k = b.k AND a.id < b.id"
    for text in (f"{join} WHERE a.id = 90", f"SELECT * FROM ({join}) p WHERE x = 90", f"WITH p AS ({join}) SELECT x, y FROM p WHERE x = 90"):
        df = e.sql(text)
        assert sorted(map(tuple, df.collect())) == [(90, 93), (90, 96), (90, 99)]
        assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
