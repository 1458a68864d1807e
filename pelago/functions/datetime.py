"""Date and time functions and operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SqlError
from ..types import DATE, FLOAT8, INT4, INT8, INTERVAL, TIME, TIMESTAMP, TIMESTAMPTZ, PgType, Val, fail, is_number
from . import interval as iv
from .casts import cast, micros_of_day, zone_minutes

_EXACT = PgType("numeric", 38, 6)


def epoch_micros(stamp: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), stamp)


Fields = dict[str, Callable[[], Column]]


def _date_fields(local: Column) -> Fields:
    """Integer fields of a date, each made when it is asked for."""
    return {
        "year": lambda: F.year(local), "month": lambda: F.month(local), "day": lambda: F.dayofmonth(local), "quarter": lambda: F.quarter(local), "doy": lambda: F.dayofyear(local),
        "dow": lambda: F.dayofweek(local) - 1, "isodow": lambda: F.weekday(local) + 1, "week": lambda: F.weekofyear(local), "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), local),
        "century": lambda: F.ceil(F.year(local) / 100).cast("int"), "decade": lambda: F.floor(F.year(local) / 10).cast("int"), "millennium": lambda: F.ceil(F.year(local) / 1000).cast("int"),
    }


def _clock_fields(micros: Column) -> Fields:
    """Fields of a time of day; ``second`` and ``milliseconds`` in microseconds."""
    return {
        "hour": lambda: F.floor(micros / 3_600_000_000).cast("int"), "minute": lambda: (F.floor(micros / 60_000_000) % 60).cast("int"),
        "second": lambda: micros % 60_000_000, "milliseconds": lambda: micros % 60_000_000, "microseconds": lambda: micros % 60_000_000,
    }


_SPELLINGS = {"years": "year", "months": "month", "mon": "month", "days": "day", "hours": "hour", "minutes": "minute", "seconds": "second", "sec": "second", "millisecond": "milliseconds", "ms": "milliseconds", "microsecond": "microseconds", "us": "microseconds", "weeks": "week", "centuries": "century", "decades": "decade", "millennia": "millennium"}


#: Fields with a fraction, and how many microseconds one of their units has.
_FRACTIONS = {"second": 1_000_000, "milliseconds": 1000, "epoch": 1_000_000}


def _fields(v: Val) -> Fields:
    """What ``extract`` knows of a type: integers, and microseconds for the fields with a fraction."""
    if v.type in (DATE, TIMESTAMP, TIMESTAMPTZ):
        local = v.col.cast("timestamp_ntz")
        found = _date_fields(local) | _clock_fields(micros_of_day(local))
        if v.type != TIMESTAMPTZ:
            return found | {"epoch": lambda: epoch_micros(local)}
        return found | {
            "epoch": lambda: F.unix_micros(v.col), "timezone": lambda: zone_minutes(v.col) * 60, "timezone_hour": lambda: (zone_minutes(v.col) / 60).cast("int"), "timezone_minute": lambda: zone_minutes(v.col) % 60,
        }
    if v.type == TIME:
        return _clock_fields(v.col) | {"epoch": lambda: v.col}
    if v.type != INTERVAL:
        raise SqlError("42883", f"function extract({v.type}) does not exist")
    months, micros = v.col["months"], v.col["micros"]

    def year(by: int = 1) -> Column:
        return F.call_function("div", F.call_function("div", months, F.lit(12)), F.lit(by)).cast("int")

    def epoch() -> Column:
        days = F.call_function("div", months, F.lit(12)).cast("decimal(20,0)") * 31_557_600 + (months % 12).cast("decimal(20,0)") * 2_592_000 + v.col["days"].cast("decimal(20,0)") * 86_400
        return (days * 1_000_000 + micros).cast("decimal(32,0)")

    return {
        "millennium": lambda: year(1000), "century": lambda: year(100), "decade": lambda: year(10), "year": year, "quarter": lambda: (F.call_function("div", months % 12, F.lit(3)) + 1).cast("int"), "month": lambda: months % 12, "day": lambda: v.col["days"],
        "hour": lambda: F.call_function("div", micros, F.lit(3_600_000_000)), "minute": lambda: F.call_function("div", micros, F.lit(60_000_000)) % 60,
        "second": lambda: micros % 60_000_000, "milliseconds": lambda: micros % 60_000_000, "microseconds": lambda: micros % 60_000_000, "epoch": epoch,
    }


def _field(field: str, v: Val) -> tuple[str, Column]:
    name, known = _SPELLINGS.get(field.lower(), field.lower()), _fields(v)
    if name not in known:
        raise SqlError("22023", f'unit "{field}" not recognized for type {v.type}')
    return name, known[name]()


def extract(field: str, v: Val) -> Val:
    """``extract(field from v)`` as a numeric; fractions of seconds stay, other fields are integers on the way too."""
    name, found = _field(field, v)
    if name not in _FRACTIONS:
        return Val(found.cast("decimal(38,0)"), PgType("numeric", 38, 0), whole=found)
    return Val((found.cast("decimal(32,0)") / F.lit(_FRACTIONS[name]).cast("decimal(7,0)")).cast("decimal(38,6)"), _EXACT)


def date_part(field: str, v: Val) -> Val:
    name, found = _field(field, v)
    value = found.cast("double")
    return Val(value / _FRACTIONS[name] if name in _FRACTIONS else value, FLOAT8)


def _chosen(name: Column, known: list[str], make: Callable[[str], Column], what: str) -> Column:
    """One of several results by a name that is no constant; 22023 for an unknown one."""
    low = F.lower(name)
    out = F.when(low.isNull(), F.lit(None))
    for k in known:
        spelled = [k, *(s for s, of in _SPELLINGS.items() if of == k)]
        out = out.when(low.isin(*spelled), make(k))
    return out.otherwise(F.raise_error(F.concat(F.lit('22023: unit "'), name, F.lit(f'" not recognized for type {what}'))))


def date_part_by(name: Column, v: Val) -> Val:
    return Val(iv.let(v.col, lambda x: _chosen(name, list(_fields(v)), lambda k: date_part(k, Val(x, v.type)).col, str(v.type))), FLOAT8)


def date_trunc_by(name: Column, v: Val, zone: Column | None) -> Val:
    units = [u for u in _TRUNCATED if not (v.type == INTERVAL and u == "week")]
    kind = date_trunc("day", v, zone).type
    return Val(iv.let(v.col, lambda x: _chosen(name, units, lambda k: date_trunc(k, Val(x, v.type), zone).col, str(v.type))), kind)


_TRUNCATED = ("microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium")


def date_trunc(unit: str, v: Val, zone: Column | None = None) -> Val:
    unit = _SPELLINGS.get(unit.lower(), unit.lower())
    if unit not in _TRUNCATED:
        raise SqlError("22023", f'unit "{unit}" not recognized')
    if v.type == INTERVAL:
        return Val(_trunc_interval(unit, v.col), INTERVAL)
    if v.type not in (DATE, TIMESTAMP, TIMESTAMPTZ):
        raise SqlError("42883", f"function date_trunc(text, {v.type}) does not exist")
    if v.type == TIMESTAMPTZ:
        if zone is None:
            return Val(_trunc(unit, v.col.cast("timestamp_ntz")).cast("timestamp_ltz"), TIMESTAMPTZ)
        local = F.convert_timezone(F.current_timezone(), zone, v.col.cast("timestamp_ntz"))
        return Val(F.convert_timezone(zone, F.current_timezone(), _trunc(unit, local)).cast("timestamp_ltz"), TIMESTAMPTZ)
    return Val(_trunc(unit, v.col.cast("timestamp_ntz")), TIMESTAMP)


def _trunc(unit: str, local: Column) -> Column:
    if unit in ("decade", "century", "millennium"):
        year = F.year(local)
        first = {"decade": F.floor(year / 10) * 10, "century": F.floor((year - 1) / 100) * 100 + 1, "millennium": F.floor((year - 1) / 1000) * 1000 + 1}[unit]
        return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    name = {"microseconds": "microsecond", "milliseconds": "millisecond"}.get(unit, unit)
    return F.date_trunc(name, local).cast("timestamp_ntz")


def _trunc_interval(unit: str, v: Column) -> Column:
    steps = {"year": 12, "decade": 120, "century": 1200, "millennium": 12000, "quarter": 3}
    if unit == "week":
        raise SqlError("0A000", "interval units weeks are not supported")
    months, days, micros = v["months"], v["days"], v["micros"]
    zero = F.lit(0)
    if unit in steps:
        return iv.struct((months / steps[unit]).cast("int") * steps[unit], zero, zero)
    if unit == "month":
        return iv.struct(months, zero, zero)
    if unit == "day":
        return iv.struct(months, days, zero)
    size = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "milliseconds": 1000, "microseconds": 1}[unit]
    return iv.struct(months, days, micros - micros % size)


def age(a: Column, b: Column) -> Column:
    """Years, months and days between two timestamps, borrowed from the calendar, and the rest of a day."""
    return iv.let(a, lambda x: iv.let(b, lambda y: _age(x, y)))


def _age(a: Column, b: Column) -> Column:
    later = a >= b
    hi, lo = F.when(later, a).otherwise(b), F.when(later, b).otherwise(a)
    micros = micros_of_day(hi) - micros_of_day(lo)
    borrow_day = F.when(micros < 0, 1).otherwise(0)
    days = F.dayofmonth(hi) - F.dayofmonth(lo) - borrow_day
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
    # a day that is missing comes from the month of the earlier date, or from the one before the later date if reversed
    length = F.when(later, F.dayofmonth(F.last_day(lo))).otherwise(F.dayofmonth(F.last_day(F.add_months(F.trunc(hi.cast("date"), "month"), -1))))
    borrow_month = F.when(days < 0, 1).otherwise(0)
    months, days = months - borrow_month, days + borrow_month * length
    micros = micros + borrow_day * F.lit(iv.DAY)
    sign = F.when(later, 1).otherwise(-1)
    return F.when(a.isNotNull() & b.isNotNull(), iv.struct(months * sign, days * sign, micros * sign))


def timezone(zone: Column, v: Val) -> Val:
    """``v AT TIME ZONE zone``."""
    if v.type == TIMESTAMPTZ:
        return Val(F.convert_timezone(F.current_timezone(), zone, v.col.cast("timestamp_ntz")), TIMESTAMP)
    if v.type in (TIMESTAMP, DATE):
        local = F.convert_timezone(zone, F.current_timezone(), v.col.cast("timestamp_ntz"))
        return Val(local.cast("timestamp_ltz"), TIMESTAMPTZ)
    raise SqlError("42883", f"function timezone(text, {v.type}) does not exist")


def operate(op: str, a: Val, b: Val) -> Val | None:
    """Temporal arithmetic; None where this pair of types has none."""
    x, y = a.type, b.type
    sign = -1 if op == "-" else 1
    if op == "+" and (y == DATE and (x in (INT4, INT8) or x in (TIME, INTERVAL)) or x == INTERVAL and y in (TIMESTAMP, TIMESTAMPTZ, TIME)):
        return operate(op, b, a)
    if op in "+-":
        if x == DATE and y in (INT4, INT8):
            return Val(F.date_add(a.col, (b.col * sign).cast("int")), DATE)
        if x == DATE and y == DATE and op == "-":
            return Val(F.date_diff(a.col, b.col), INT4)
        if x == DATE and y == TIME and op == "+":
            return Val(F.timestamp_add("MICROSECOND", b.col, a.col.cast("timestamp_ntz")), TIMESTAMP)
        if x in (DATE, TIMESTAMP) and y == INTERVAL:
            return Val(iv.add_to_stamp(a.col.cast("timestamp_ntz"), b.col, sign), TIMESTAMP)
        if x == TIMESTAMPTZ and y == INTERVAL:
            wall = iv.add_to_stamp(a.col.cast("timestamp_ntz"), iv.struct(b.col["months"], b.col["days"], F.lit(0)), sign).cast("timestamp_ltz")
            return Val(F.timestamp_micros(F.unix_micros(wall) + b.col["micros"] * sign), TIMESTAMPTZ)
        if x == TIME and y == INTERVAL:
            return Val(F.pmod(a.col + b.col["micros"] * sign, F.lit(iv.DAY)), TIME)
        if x == INTERVAL and y == INTERVAL:
            return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), iv.add(a.col, b.col, sign)), INTERVAL)
        if op == "-" and x == TIME and y == TIME:
            return Val(F.when(a.col.isNotNull() & b.col.isNotNull(), iv.struct(F.lit(0), F.lit(0), a.col - b.col)), INTERVAL)
        if op == "-" and x in (TIMESTAMP, DATE, TIMESTAMPTZ) and y in (TIMESTAMP, DATE, TIMESTAMPTZ):
            if TIMESTAMPTZ in (x, y):
                p, q = cast(a, TIMESTAMPTZ).col, cast(b, TIMESTAMPTZ).col
                micros = F.unix_micros(p) - F.unix_micros(q)
                days = (micros.cast("decimal(20,0)") / iv.DAY).cast("long")
                return Val(F.when(micros.isNotNull(), iv.struct(F.lit(0), days, micros - days * iv.DAY)), INTERVAL)
            return Val(iv.between(a.col.cast("timestamp_ntz"), b.col.cast("timestamp_ntz")), INTERVAL)
    if op == "*" and x == INTERVAL and is_number(y):
        return Val(iv.multiply(a.col, b.col.cast("double")), INTERVAL)
    if op == "*" and y == INTERVAL and is_number(x):
        return operate(op, b, a)
    if op == "/" and x == INTERVAL and is_number(y):
        d = b.col.cast("double")
        return Val(F.when(d == 0, fail("22012", "division by zero")).otherwise(iv.multiply(a.col, 1 / F.when(d != 0, d))), INTERVAL)
    return None


def make_date(y: Column, m: Column, d: Column) -> Column:
    made = F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")
    ok = y.isNull() | m.isNull() | d.isNull()
    return F.when(ok, F.lit(None).cast("date")).when((y >= 1) & m.between(1, 12) & d.between(1, 31) & made.isNotNull(), made).otherwise(fail("22008", "date field value out of range"))


def make_time(h: Column, m: Column, s: Column) -> Column:
    micros = (h.cast("long") * 3600 + m * 60) * 1_000_000 + F.rint(s.cast("double") * 1_000_000).cast("long")
    ok = h.between(0, 24) & m.between(0, 59) & (s >= 0) & (s <= 60) & (micros <= iv.DAY)
    return F.when(micros.isNull(), F.lit(None).cast("long")).when(ok, micros).otherwise(fail("22008", "time field value out of range"))


def make_timestamp(parts: list[Column]) -> Column:
    return F.timestamp_add("MICROSECOND", make_time(*parts[3:6]), make_date(*parts[:3]).cast("timestamp_ntz"))


def make_interval(parts: list[Column]) -> Column:
    y, mo, w, d, h, mi, s = (parts + [F.lit(0)] * 7)[:7]
    micros = (h.cast("long") * 3600 + mi * 60) * 1_000_000 + F.rint(s.cast("double") * 1_000_000).cast("long")
    whole = iv.struct(y * 12 + mo, w * 7 + d, micros)
    nulls = F.lit(False)
    for p in parts:
        nulls = nulls | p.isNull()
    return F.when(~nulls, whole)
