"""Queries whose answers PostgreSQL fixes: expressions over constants and small tables, with the texts they must show.

Each family is a list of (expression, text); a query returns a row for each, and its SQL for DuckDB is the list itself.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .sources.foreign import ForeignCatalog
from .types import PgType

_AT = "timestamp '2024-01-07 15:04:05.678901'"
_ZONED = "timestamptz '2024-07-01 12:00:00+00'"

#: family -> [(expression, its text)]
EXPRESSIONS: dict[str, list[tuple[str, str | None]]] = {
    "temporal_arith": [
        ("date '2024-01-31' + 1", "2024-02-01"), ("5 + date '2024-02-27'", "2024-03-03"), ("date '2024-03-01' - 1", "2024-02-29"), ("date '2024-03-01' - date '2024-02-01'", "29"),
        ("date '2024-01-31' + interval '1 month'", "2024-02-29 00:00:00"), ("interval '2 days' + date '2024-01-31'", "2024-02-02 00:00:00"), ("date '2024-03-31' - interval '1 month'", "2024-02-29 00:00:00"),
        ("date '2024-01-01' + time '12:30'", "2024-01-01 12:30:00"), ("time '01:02:03' + date '2024-01-01'", "2024-01-01 01:02:03"),
        ("timestamp '2024-01-31 10:00:00' + interval '1 month 1 day 2 hours'", "2024-03-01 12:00:00"), ("interval '90 minutes' + timestamp '2024-01-01 23:00:00'", "2024-01-02 00:30:00"), ("timestamp '2024-03-30 00:00:00' - interval '1 mon'", "2024-02-29 00:00:00"),
        ("timestamp '2024-01-11 02:03:04' - timestamp '2024-01-01 00:00:00'", "10 days 02:03:04"), ("timestamp '2024-01-01 00:00:00' - timestamp '2024-01-02 01:00:00'", "-1 days -01:00:00"),
        ("timestamptz '2024-03-09 12:00:00+00' + interval '1 day'", "2024-03-10 12:00:00+00"), ("timestamptz '2024-03-09 12:00:00+00' - interval '36 hours'", "2024-03-08 00:00:00+00"), ("timestamptz '2024-03-09 12:00:00+02' - timestamptz '2024-03-08 00:00:00+00'", "1 day 10:00:00"),
        ("time '23:30' + interval '1 hour'", "00:30:00"), ("time '00:15' - interval '30 minutes'", "23:45:00"), ("interval '15 min' + time '10:00'", "10:15:00"), ("time '10:00' - time '09:30'", "00:30:00"),
        ("interval '1 day' + interval '2 hours'", "1 day 02:00:00"), ("interval '1 month' - interval '2 days'", "1 mon -2 days"), ("-interval '1 mon 2 days'", "-1 mons -2 days"),
        ("interval '1 month' * 1.5", "1 mon 15 days"), ("2 * interval '1 day 2 hours'", "2 days 04:00:00"), ("interval '1 day' / 3", "08:00:00"), ("interval '7 days' * 0.5::float8", "3 days 12:00:00"),
        ("interval '1 month' = interval '30 days'", "true"), ("interval '1 day' < interval '25 hours'", "true"), ("interval '2 days' >= interval '49 hours'", "false"), ("date '2024-01-01' < timestamp '2024-01-01 00:00:01'", "true"),
    ],
    "casts_temporal": [
        ("'10:11:12.5'::time", "10:11:12.5"), ("'7:05'::time", "07:05:00"), ("'2024-01-02 03:04:05'::timestamp", "2024-01-02 03:04:05"), ("'2024-01-02T03:04:05.25'::timestamp", "2024-01-02 03:04:05.25"), ("'2024-01-02 03:04:05+02'::timestamptz", "2024-01-02 01:04:05+00"), ("'2024-01-02 03:04:05Z'::timestamptz", "2024-01-02 03:04:05+00"),
        ("'1 year 2 months'::interval", "1 year 2 mons"), ("'1 year 2 mons 3 days 04:05:06.5'::interval", "1 year 2 mons 3 days 04:05:06.5"), ("'3 days ago'::interval", "-3 days"), ("'1.5 weeks'::interval", "10 days 12:00:00"), ("'500 ms'::interval", "00:00:00.5"), ("'-1 day +02:00'::interval", "-1 days +02:00:00"),
        ("date '2024-01-02'::timestamp", "2024-01-02 00:00:00"), ("timestamp '2024-01-02 03:04:05'::date", "2024-01-02"), ("timestamp '2024-01-02 03:04:05.5'::time", "03:04:05.5"), ("timestamp '2024-01-02 03:04:05'::timestamptz", "2024-01-02 03:04:05+00"), ("timestamptz '2024-01-02 03:04:05+01'::timestamp", "2024-01-02 02:04:05"),
        ("timestamptz '2024-01-02 23:04:05-03'::date", "2024-01-03"), ("timestamptz '2024-01-02 03:04:05+00'::time", "03:04:05"), ("time '01:02:03'::interval", "01:02:03"), ("date '2024-01-02'::timestamptz", "2024-01-02 00:00:00+00"),
    ],
    "casts_scalar": [
        ("'12.50'::numeric", "12.50"), ("'-0.001'::numeric", "-0.001"), ("'12.345'::numeric(6,2)", "12.35"), ("1.005::numeric(6,2)", "1.01"), ("2.5::int", "3"), ("-2.5::int", "-3"), ("2.5::float8::int", "2"), ("3.5::float8::int", "4"), ("true::int", "1"), ("0::boolean", "false"),
        ("'on'::boolean", "true"), ("'F'::boolean", "false"), ("' 12 '::int", "12"), ("'-9223372036854775808'::int8", "-9223372036854775808"), ("'1e3'::float8", "1000"), ("'NaN'::float8", "NaN"), ("0.1::float8", "0.1"), ("1.50", "1.50"), ("7::numeric", "7"), ("NULL::int", None), ("'x'::text", "x"),
    ],
    "numeric_division": [
        ("1.0 / 3", "0.33333333333333333333"), ("10 / 4.0", "2.5000000000000000"), ("2 / 3.0", "0.66666666666666666667"), ("100000.0 / 3", "33333.333333333333"), ("-1 / 3.0", "-0.33333333333333333333"), ("0 / 7.0", "0.00000000000000000000"), ("1.0 / 3 + 1", "1.33333333333333333333"), ("7 / 2", "3"), ("-7 / 2", "-3"), ("7 / 2.0::float8", "3.5"),
    ],
    "numeric_transcendental": [
        ("sqrt(2::numeric)", "1.414213562373095"), ("sqrt(4::numeric)", "2.000000000000000"), ("ln(2::numeric)", "0.6931471805599453"), ("ln(10::numeric)", "2.3025850929940457"), ("ln(1000000::numeric)", "13.815510557964274"), ("log(100::numeric)", "2.0000000000000000"), ("log(1000000::numeric)", "6.000000000000000"),
        ("exp(0::numeric)", "1.0000000000000000"), ("exp(1::numeric)", "2.7182818284590452"), ("exp(10::numeric)", "22026.465794806717"), ("power(2::numeric, 10::numeric)", "1024.0000000000000"), ("power(2::numeric, 3::numeric)", "8.0000000000000000"), ("power(2::numeric, 100::numeric)", "1267650600228229401496703205376"),
        ("power(-2::numeric, 3::numeric)", "-8.0000000000000000"), ("power(5::numeric, -2::numeric)", "0.04000000000000000"), ("power(2::numeric, 0.5::numeric)", "1.4142135623730950"), ("power(0.1, 2)", "0.010000000000000000"), ("sqrt(16)", "4"), ("power(2, 10)", "1024"), ("log(1000)", "3"),
    ],
    "numeric_functions": [
        ("round(1234.567, 1)", "1234.6"), ("round(1234.567, -2)", "1200"), ("round(2.5)", "3"), ("round(-2.5)", "-3"), ("round(2.5::float8)", "2"), ("trunc(1234.567, 2)", "1234.56"), ("ceil(1.2)", "2"), ("floor(-1.2)", "-2"), ("trunc(-1.9)", "-1"), ("sign(-2.5)", "-1"), ("abs(-2.50)", "2.50"), ("mod(7.5, 2)", "1.5"), ("mod(-7, 3)", "-1"),
        ("1.5 + 1", "2.5"), ("1.10 * 2.5", "2.750"), ("0.1 + 0.2", "0.3"), ("-(-3)", "3"), ("greatest(1, NULL, 3)", "3"), ("least(2.5, 2)", "2.0"),
    ],
    "to_char_fields": [
        *((f"to_char({_AT}, '{t}')", v) for t, v in (
            ("YYYY YYY YY Y", "2024 024 24 4"), ("Y,YYY", "2,024"), ("IYYY IYY IY I", "2024 024 24 4"), ("IDDD ID IW", "007 7 01"), ("CC", "21"), ("AD BC ad bc A.D. B.C. a.d. b.c.", "AD AD ad ad A.D. A.D. a.d. a.d."), ("MM|Month|MONTH|month|Mon|MON|mon", "01|January  |JANUARY  |january  |Jan|JAN|jan"),
            ("RM|rm|FMRM", "I   |i   |I"), ("DDD DD D", "007 07 1"), ("Day|DAY|day|Dy|DY|dy", "Sunday   |SUNDAY   |sunday   |Sun|SUN|sun"), ("WW W Q", "01 1 1"), ("HH24:HH12:HH:MI:SS", "15:03:03:04:05"), ("SSSS SSSSS", "54245 54245"), ("MS US", "678 678901"), ("FF1 FF2 FF3 FF4 FF5 FF6", "6 67 678 6789 67890 678901"),
            ("AM PM am pm A.M. P.M. a.m. p.m.", "PM PM pm pm P.M. P.M. p.m. p.m."), ("FMDD FMMM FMHH12", "7 1 3"), ("DDth DDTH", "07th 07TH"), ('"at "HH24"h"', "at 15h"), ("YYYY-MM-DD\"T\"HH24:MI:SS", "2024-01-07T15:04:05"),
        )),
        (f"to_char({_ZONED}, 'TZH:TZM OF')", "+00:00 +00"), ("to_char(date '2024-12-30', 'IYYY-IW-ID')", "2025-01-1"), ("to_char(date '2024-03-22', 'FMDDth')", "22nd"), ("to_char(date '1999-12-31', 'CC Q WW')", "20 4 53"), ("to_char(time '09:08:07', 'HH24:MI:SS')", "09:08:07"),
        ("to_char(interval '100 hours 5 min', 'HH24:MI')", "100:05"), ("to_char(interval '1 year 2 mons 3 days 4 hours', 'YYYY MM DD HH24')", "0001 02 03 04"), ("to_char(NULL::date, 'YYYY')", None),
    ],
    "to_char_numbers": [
        *((f"to_char({n}, '{t}')", v) for n, t, v in (
            ("-0.1", "99.99", "  -.10"), ("-0.1", "FM9.99", "-.1"), ("0.1", "0.9", " 0.1"), ("12", "9990999.9", "    0012.0"), ("12", "FM9990999.9", "0012."), ("485", "999", " 485"), ("-485", "999", "-485"), ("1485", "9,999", " 1,485"), ("148.5", "999.999", " 148.500"), ("148.5", "FM999.999", "148.5"), ("148.5", "FM999.990", "148.500"), ("3148.5", "9G999D999", " 3,148.500"),
            ("-485", "999S", "485-"), ("485", "S999", "+485"), ("-5", "S999", "  -5"), ("-485", "999MI", "485-"), ("485", "999MI", "485 "), ("485", "FM999MI", "485"), ("485", "PL999", "+ 485"), ("485", "SG999", "+485"), ("-485", "SG999", "-485"), ("-485", "999PR", "<485>"), ("485", "999PR", " 485 "), ("482", "999th", " 482nd"), ("482", "999TH", " 482ND"), ("-482", "999th", "-482"),
            ("12", "99V999", " 12000"), ("12.4", "99V999", " 12400"), ("12.45", "99V9", " 125"), ("12345", "999", " ###"), ("0", "0000.00", " 0000.00"), ("0", "999", "   0"), ("1234567.891", "FM9,999,999.00", "1,234,567.89"), ("12", "FM999", "12"), ("5", "FM9.", "5."), ("1.45", "9.9", " 1.5"), ("-1.45", "9.9", "-1.5"), ("22::int8", "99th", " 22nd"), ("0.5::float8", "9.9", "  .5"),
            ("123456789012345678901234567890", "FM" + "9" * 31, "123456789012345678901234567890"),
        )),
        ("to_char(NULL::int, '999')", None),
    ],
    "dates_made": [
        ("make_date(2024, 2, 29)", "2024-02-29"), ("make_time(1, 2, 3.5)", "01:02:03.5"), ("make_timestamp(2024, 1, 2, 3, 4, 5.5)", "2024-01-02 03:04:05.5"), ("make_timestamptz(2024, 1, 2, 3, 4, 5)", "2024-01-02 03:04:05+00"), ("make_timestamptz(2024, 7, 2, 3, 4, 5, 'America/New_York')", "2024-07-02 07:04:05+00"), ("make_interval(1, 2, 3, 4, 5, 6, 7.5)", "1 year 2 mons 25 days 05:06:07.5"),
        ("to_date('07 Jan 2024', 'DD Mon YYYY')", "2024-01-07"), ("to_timestamp('2024-01-07 03:04 PM', 'YYYY-MM-DD HH12:MI AM')", "2024-01-07 15:04:00+00"), ("to_timestamp(1.5)", "1970-01-01 00:00:01.5+00"), ("timezone('America/New_York', timestamp '2024-01-01 00:00:00')", "2024-01-01 05:00:00+00"), ("timezone('Asia/Tokyo', timestamptz '2024-07-01 12:00:00Z')", "2024-07-01 21:00:00"),
        ("age(timestamp '2024-03-01 00:00:00', timestamp '2023-12-31 12:00:00')", "2 mons 12:00:00"), ("age(timestamp '2001-04-10 00:00:00', timestamp '1957-06-13 00:00:00')", "43 years 9 mons 27 days"), ("justify_days(interval '35 days')", "1 mon 5 days"), ("justify_hours(interval '27 hours')", "1 day 03:00:00"), ("justify_interval(interval '1 mon -1 hour')", "29 days 23:00:00"),
        ("date_trunc('century', timestamp '2024-02-15 10:00:00')", "2001-01-01 00:00:00"), ("date_trunc('millennium', timestamp '2024-02-15 10:00:00')", "2001-01-01 00:00:00"), ("date_trunc('hour', interval '1 day 3 hours 20 minutes')", "1 day 03:00:00"), ("date_trunc('day', timestamptz '2024-07-01 02:00:00+00', 'America/New_York')", "2024-06-30 04:00:00+00"),
        ("extract(epoch FROM interval '1 day 2 hours')", "93600.000000"), ("extract(second FROM time '10:00:03.5')", "3.500000"), ("extract(milliseconds FROM interval '1.25 s')", "1250.000000"), ("extract(quarter FROM interval '7 mons')", "3"), ("extract(isoyear FROM date '2024-12-30')", "2025"), ("extract(timezone_hour FROM timestamptz '2024-07-01 12:00:00Z')", "0"),
        ("date_part('hour', timestamp '2024-01-01 05:00:00')", "5"), ("date_part(lower('HOUR'), timestamp '2024-01-01 05:00:00')", "5"), ("date_trunc(lower('MONTH'), timestamp '2024-02-15 10:00:00')", "2024-02-01 00:00:00"), ("to_char(timestamp '2024-02-15 10:00:00', concat('YYYY', '-', 'FMMonth DDth'))", "2024-February 15th"),
    ],
    "string_functions": [
        ("substr('abcdef', 0, 2)", "a"), ("substr('abcdef', -1, 3)", "a"), ("substring('abcdef' FROM 2 FOR 3)", "bcd"), ("left('abc', -1)", "ab"), ("right('abc', -1)", "bc"), ("lpad('abc', 2)", "ab"), ("rpad('a', 3, 'xy')", "axy"), ("repeat('ab', -1)", ""), ("initcap('hello-wORLD 3d')", "Hello-World 3d"), ("chr(8364)", "€"), ("ascii('€')", "8364"), ("strpos('abc', '')", "1"),
        ("reverse('añb')", "bña"), ("replace('aaa', '', 'b')", "aaa"), ("btrim('xxaxx', 'x')", "a"), ("concat()", ""), ("concat('a', NULL, 1, true)", "a1t"), ("'a' || 1 || true", "a1t"), ("'a' || NULL", None), ("'abc' LIKE 'a\\%c'", "false"), ("'a%c' LIKE 'a\\%c'", "true"), ("'É' ILIKE 'é'", "false"), ("upper('ß')", "SS"), ("length('añ€')", "3"),
    ],
    "clock_functions": [
        ("now() = transaction_timestamp()", "true"), ("now() = current_timestamp", "true"), ("statement_timestamp() >= now()", "true"), ("clock_timestamp() >= statement_timestamp()", "true"), ("current_date = now()::date", "true"), ("localtimestamp = now()::timestamp", "true"), ("localtime = now()::time", "true"), ("current_time = localtime", "true"), ("clock_timestamp() < now() + interval '1 hour'", "true"),
    ],
    "three_valued": [
        ("NULL AND false", "false"), ("NULL AND true", None), ("NULL OR true", "true"), ("NOT NULL", None), ("1 IN (2, NULL)", None), ("1 NOT IN (1, NULL)", "false"), ("3 BETWEEN 5 AND 1", "false"), ("3 NOT BETWEEN 5 AND 1", "true"), ("NULL IS NULL", "true"), ("CASE NULL WHEN NULL THEN 1 ELSE 0 END", "0"), ("CASE 3 WHEN 3 THEN 1.5 ELSE 2 END", "1.5"), ("nullif(1, 1)", None), ("coalesce(NULL, 1, 2.5)", "1.0"),
        ("1 > ALL (SELECT 1 WHERE false)", "true"), ("1 = ANY (VALUES (2), (NULL))", None), ("1 < ANY (VALUES (2), (NULL))", "true"), ("2 IN (SELECT 1 UNION SELECT 2)", "true"), ("EXISTS (SELECT 1 WHERE false)", "false"), ("(SELECT 1 WHERE false) IS NULL", "true"),
    ],
}

#: name -> (the engine's SQL, the rows it must give as VALUES, their column names)
ROWS: dict[str, tuple[str, str, str]] = {
    "interval_setops": (
        """SELECT 'and' AS op, extract(epoch FROM v)::int8 / 86400 AS days FROM (SELECT v FROM (VALUES (interval '1 month'), (interval '1 day'), (NULL)) a(v) INTERSECT SELECT v FROM (VALUES (interval '30 days'), (interval '24 hours'), (NULL)) b(v)) x
        UNION ALL SELECT 'but', extract(epoch FROM v)::int8 / 86400 FROM (SELECT v FROM (VALUES (interval '1 month'), (interval '2 days'), (NULL)) a(v) EXCEPT SELECT v FROM (VALUES (interval '30 days'), (NULL)) b(v)) x
        UNION ALL SELECT 'and all', extract(epoch FROM v)::int8 / 86400 FROM (SELECT v FROM (VALUES (interval '1 month'), (interval '30 days'), (interval '720 hours'), (interval '1 day')) a(v) INTERSECT ALL SELECT v FROM (VALUES (interval '30 days'), (interval '1 month'), (interval '3 days')) b(v)) x
        UNION ALL SELECT 'but all', extract(epoch FROM v)::int8 / 86400 FROM (SELECT v FROM (VALUES (interval '1 month'), (interval '30 days'), (interval '720 hours'), (interval '1 day')) a(v) EXCEPT ALL SELECT v FROM (VALUES (interval '30 days'), (interval '5 days')) b(v)) x
        UNION ALL SELECT 'or', extract(epoch FROM v)::int8 / 86400 FROM (SELECT v FROM (VALUES (interval '1 month'), (interval '1 day')) a(v) UNION SELECT v FROM (VALUES (interval '30 days'), (interval '3 days')) b(v)) x""",
        "('and', 30), ('and', 1), ('and', NULL), ('but', 2), ('and all', 30), ('and all', 30), ('but all', 30), ('but all', 30), ('but all', 1), ('or', 30), ('or', 1), ('or', 3)",
        "op, days",
    ),
    "interval_quantified": (
        """SELECT n::int8 AS n, v > ANY (SELECT w FROM (VALUES (interval '1 month'), (interval '45 days')) b(w)) AS more, v < ALL (SELECT w FROM (VALUES (interval '1 month'), (interval '45 days')) b(w)) AS least,
            v IN (SELECT w FROM (VALUES (interval '1 month'), (interval '45 days')) b(w)) AS here, v NOT IN (SELECT w FROM (VALUES (interval '1 month'), (NULL)) b(w)) AS nowhere, v = ALL (SELECT interval '720 hours') AS same
        FROM (VALUES (1, interval '40 days'), (2, interval '30 days'), (3, interval '29 days 23 hours'), (4, NULL)) a(n, v)""",
        "(1, true, false, false, NULL, false), (2, false, false, true, false, true), (3, false, true, false, NULL, false), (4, NULL, NULL, NULL, NULL, NULL)",
        "n, more, least, here, nowhere, same",
    ),
    "interval_filters": (
        """SELECT n::int8 AS n FROM (VALUES (1, interval '40 days'), (2, interval '30 days'), (3, interval '24 hours')) a(n, v) WHERE v NOT IN (SELECT w FROM (VALUES (interval '1 month')) b(w)) AND v <> ALL (SELECT interval '1 day')""",
        "(1)", "n",
    ),
    "interval_order": (
        "SELECT count(*) AS n, count(DISTINCT v) AS d, min(v)::text AS lo, max(v)::text AS hi FROM (VALUES (interval '1 month'), (interval '30 days'), (interval '31 days'), (interval '719 hours'), (NULL)) a(v)",
        "(5, 3, '719:00:00', '31 days')", "n, d, lo, hi",
    ),
    "numeric_columns": (
        "SELECT id::int8 AS id, sqrt(x)::text AS s, ln(x)::text AS l, (x / 3)::text AS d, (-x)::text AS m FROM (VALUES (1, 2::numeric), (2, 4), (3, 100), (5, 1000000)) t(id, x)",
        "(1, '1.414213562373095', '0.6931471805599453', '0.6666666666666667', '-2'), (2, '2.000000000000000', '1.3862943611198906', '1.3333333333333333', '-4'), (3, '10.000000000000000', '4.6051701859880914', '33.3333333333333333', '-100'), (5, '1000.0000000000000', '13.815510557964274', '333333.333333333333', '-1000000')",
        "id, s, l, d, m",
    ),
    "aggregates_typed": (
        "SELECT avg(x)::text AS a, sum(x)::text AS s, avg(y)::text AS f, sum(y)::text AS g, avg(ALL z)::text AS z, sum(ALL z) AS t, count(ALL z) AS n FROM (VALUES (1, 1.5::float8, 1), (2, 2.5, 2), (NULL, NULL, 4)) t(x, y, z)",
        "('1.5000000000000000', '3', '2', '4', '2.3333333333333333', 7, 3)", "a, s, f, g, z, t, n",
    ),
    "output_names": (
        "SELECT upper, count, \"?column?\", \"case\", int8, extract::int8 AS extract FROM (SELECT upper('a'), count(*), 1 + 1, CASE WHEN true THEN 'y' END, 5::int8, extract(year FROM date '2024-05-06')) t",
        "('A', 1, 2, 'y', 5, 2024)", "upper, count, \"?column?\", \"case\", int8, extract",
    ),
    "subquery_positions": (
        """SELECT k::int8 AS k, CASE WHEN k IN (SELECT 2) THEN 'two' ELSE 'other' END AS c, (SELECT max(w) FROM (VALUES (7), (9)) u(w)) + k::int8 AS s, count(*) AS n FROM (VALUES (1), (2), (2), (3)) t(k)
        WHERE NOT (k IN (SELECT 3)) GROUP BY k HAVING count(*) >= (SELECT 1) ORDER BY (SELECT 0), k""",
        "(1, 'other', 10, 1), (2, 'two', 11, 2)", "k, c, s, n",
    ),
    "subquery_bodies": (
        """SELECT x::int8 AS x FROM (SELECT x FROM (VALUES (3), (1), (2)) a(x) ORDER BY x DESC LIMIT 2) b WHERE x IN (WITH w(y) AS (SELECT 2 UNION ALL SELECT 3) SELECT y FROM w INTERSECT VALUES (3), (4)) OR EXISTS ((SELECT 1 WHERE false) UNION SELECT 1 WHERE false)""",
        "(3)", "x",
    ),
    "setop_coercion": (
        "SELECT a::text AS a, b::text AS b FROM (SELECT 1 AS a, date '2024-01-01' AS b UNION ALL SELECT 2.5, timestamp '2024-01-02 03:00:00' UNION ALL SELECT NULL, NULL) t",
        "('1.0', '2024-01-01 00:00:00'), ('2.5', '2024-01-02 03:00:00'), (NULL, NULL)", "a, b",
    ),
    "nested_bodies": (
        "SELECT k::int8 AS k FROM (((SELECT 1 AS k UNION SELECT 2) EXCEPT (SELECT 2)) UNION ALL (VALUES (5), (4) ORDER BY 1 LIMIT 1)) t ORDER BY k DESC",
        "(4), (1)", "k",
    ),
    "volatile_cte": (
        "WITH c AS (SELECT clock_timestamp() AS t) SELECT a.t = b.t AS same FROM c a CROSS JOIN c b",
        "(true)", "same",
    ),
    "using_chain": (
        "SELECT k::int8 AS k, a.x AS ax, b.x AS bx, c.x AS cx FROM (VALUES (1, 'a'), (2, 'b')) a(k, x) FULL JOIN (VALUES (2, 'c'), (3, 'd')) b(k, x) USING (k) LEFT JOIN (VALUES (3, 'e'), (1, 'f')) c(k, x) USING (k)",
        "(1, 'a', NULL, 'f'), (2, 'b', 'c', NULL), (3, NULL, 'd', 'e')", "k, ax, bx, cx",
    ),
}

#: (statement, the SQLSTATE it ends with)
STATES = [
    ("SELECT 1 / 0", "22012"), ("SELECT 2147483647 + 1", "22003"), ("SELECT 'abc'::int", "22P02"), ("SELECT '2024-13-01'::date", "22008"), ("SELECT sqrt(-1.0)", "2201F"), ("SELECT ln(0)", "2201E"), ("SELECT x FROM (VALUES (1)) t(y)", "42703"), ("SELECT * FROM nosuch", "42P01"), ("SELECT nosuch(1)", "42883"),
    ("SELECT 1 UNION SELECT 1, 2", "42601"), ("SELECT 1 UNION SELECT true", "42804"), ("SELECT k FROM (VALUES (1, 2)) t(k, v) GROUP BY v", "42803"), ("SELECT (SELECT 1 UNION SELECT 2)", "21000"), ("SELECT $1", "0A000"), ("WITH RECURSIVE x AS (SELECT 1) SELECT 1", "0A000"), ("SELECT 1::float8::bool", "42846"), ("SELECT DISTINCT k FROM (VALUES (1, 2)) t(k, v) ORDER BY v", "42P10"),
    ("SELECT " + "(" * 60 + "1" + ")" * 60, "54001"), ("(" * 300 + "SELECT 1" + ")" * 300, "54001"), ("SELECT 1 FROM " + "(SELECT 1 FROM " * 300 + "(VALUES (1)) t" + ") t" * 300, "54001"), ("SELECT " + "NOT " * 500 + "true", "54001"), ("SELECT 1" + " + 1" * 400, "54001"), ("SELECT 1", None),
]


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _expressions(items: list[tuple[str, str | None]]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = ", ".join(f"({i}, ({e})::text)" for i, (e, _) in enumerate(items))
        return Engine(spark).sql(f"SELECT n::int8 AS n, v FROM (VALUES {rows}) t(n, v)")

    return run


def _rows(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark).sql(sql)


def sqlstates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements end with."""
    engine = Engine(spark)
    return spark.createDataFrame([(i, engine.state_of(text)) for i, (text, _) in enumerate(STATES)], "n long, state string")


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of a query's columns, which are known without running it."""
    engine = Engine(spark)
    engine.register_parquet(sf_dir, "nation")
    found = engine.describe("SELECT n_nationkey, avg(n_nationkey), min(n_name), NULL AS nothing, (SELECT max(n_regionkey) FROM nation) AS m, interval '1 day' AS i, count(*), 1.50 AS d FROM nation GROUP BY n_nationkey")
    return spark.createDataFrame([(i, *x) for i, x in enumerate(found)], "n long, name string, type string")


def foreign_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic of registry-framed JSON values as a foreign table, joined and filtered; records come from a given reader."""

    def reader(spark: SparkSession, options: dict, bounds) -> DataFrame:
        values = [{"id": 1, "amount": 7.25, "tag": "a", "more": {"x": 1}}, {"id": 2, "amount": 1}, None, {"id": 3, "tag": "c", "other": 5}]
        rows = [(i % 2, i, dt.datetime(2024, 1, 1, 0, 0, i), bytearray(b"k%d" % i), None if v is None else bytearray(b"\0\0\0\0\x07" + json.dumps(v).encode()), [("h", bytearray(b"\x01\xff"))] if i else None) for i, v in enumerate(values)]
        if bounds:
            rows = [r for r in rows if r[0] in bounds.partitions]
        return spark.createDataFrame(rows, "partition int, offset long, timestamp timestamp, key binary, value binary, headers array<struct<key: string, value: binary>>")

    engine = Engine(spark, foreign=ForeignCatalog(reader=reader, topics=lambda options: {"clicks": ("raw", {"value": PgType("bytea")}), "__own": ("raw", {})}))
    engine.execute("CREATE FOREIGN DATA WRAPPER w; CREATE SERVER s FOREIGN DATA WRAPPER w OPTIONS (bootstrap 'h:1'); CREATE FOREIGN TABLE topic (id int4, amount float8, tag text, more text) SERVER s OPTIONS (topic 't', value_format 'json')")
    engine.execute("IMPORT FOREIGN SCHEMA public FROM SERVER s")
    return engine.sql(
        """SELECT t._partition::int8 AS part, t._offset AS place, t._timestamp::text AS stamp, t._key::text AS k, t._headers AS headers, id::int8 AS id, amount, tag, more, c.n
        FROM topic t CROSS JOIN (SELECT count(*) AS n FROM clicks WHERE _partition = 1) c WHERE t._offset >= 0"""
    )


_FOREIGN_ROWS = """(0, 0, '2024-01-01 00:00:00+00', '\\x6b30', '{}', 1, 7.25, 'a', '{"x":1}', 2), (1, 1, '2024-01-01 00:00:01+00', '\\x6b31', '{"h":"\\\\x01ff"}', 2, 1, NULL, NULL, 2),
    (0, 2, '2024-01-01 00:00:02+00', '\\x6b32', '{"h":"\\\\x01ff"}', NULL, NULL, NULL, NULL, 2), (1, 3, '2024-01-01 00:00:03+00', '\\x6b33', '{"h":"\\\\x01ff"}', 3, NULL, 'c', NULL, 2)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _expressions(v) for k, v in EXPRESSIONS.items()} | {k: _rows(v[0]) for k, v in ROWS.items()} | {"sqlstates": sqlstates, "described": described, "foreign_table": foreign_table}


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, items in EXPRESSIONS.items():
        rows = ", ".join(f"({i}, {_quoted(v)})" for i, (_, v) in enumerate(items))
        out[k] = f"SELECT CAST(n AS BIGINT) AS n, CAST(v AS VARCHAR) AS v FROM (VALUES {rows}) t(n, v)"
    for k, (_, rows, names) in ROWS.items():
        wide = {"days", "n", "id", "d", "k", "s", "t", "x", "count", '"?column?"', "int8", "extract"}
        text = {"numeric_columns": {"s", "d"}, "aggregates_typed": {"s"}}.get(k, set())
        whole = {'"?column?"'} if k == "output_names" else set()
        shown = ", ".join(f"CAST({n} AS {'INTEGER' if n in whole else 'BIGINT'}) AS {n}" if n in wide - text else n for n in names.split(", "))
        out[k] = f"SELECT {shown} FROM (VALUES {rows}) t({names})"
    out["sqlstates"] = "SELECT CAST(n AS BIGINT) AS n, CAST(state AS VARCHAR) AS state FROM (VALUES " + ", ".join(f"({i}, {_quoted(s)})" for i, (_, s) in enumerate(STATES)) + ") t(n, state)"
    types = [("n_nationkey", "int4"), ("avg", "numeric(38,16)"), ("min", "text"), ("nothing", "text"), ("m", "int4"), ("i", "interval"), ("count", "int8"), ("d", "numeric(3,2)")]
    out["described"] = "SELECT CAST(n AS BIGINT) AS n, name, type FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(types)) + ") t(n, name, type)"
    out["foreign_table"] = f"SELECT CAST(part AS BIGINT) AS part, CAST(place AS BIGINT) AS place, stamp, k, headers, CAST(id AS BIGINT) AS id, CAST(amount AS DOUBLE) AS amount, tag, more, CAST(n AS BIGINT) AS n FROM (VALUES {_FOREIGN_ROWS}) t(part, place, stamp, k, headers, id, amount, tag, more, n)"
    return out
