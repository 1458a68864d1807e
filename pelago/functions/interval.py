"""Intervals as (months, days, microseconds): parsing, text, arithmetic, and the canonical key they compare by."""

from __future__ import annotations

import re
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SqlError
from ..types import INTERVAL_STRUCT

DAY = 86_400_000_000
# Unit spellings as months, days or microseconds.
_UNITS = {
    "microsecond": (0, 0, 1), "us": (0, 0, 1), "usec": (0, 0, 1), "millisecond": (0, 0, 1000), "ms": (0, 0, 1000), "msec": (0, 0, 1000),
    "second": (0, 0, 1_000_000), "sec": (0, 0, 1_000_000), "s": (0, 0, 1_000_000), "minute": (0, 0, 60_000_000), "min": (0, 0, 60_000_000), "m": (0, 0, 60_000_000),
    "hour": (0, 0, 3_600_000_000), "hr": (0, 0, 3_600_000_000), "h": (0, 0, 3_600_000_000), "day": (0, 1, 0), "d": (0, 1, 0), "week": (0, 7, 0), "w": (0, 7, 0),
    "month": (1, 0, 0), "mon": (1, 0, 0), "year": (12, 0, 0), "yr": (12, 0, 0), "y": (12, 0, 0), "decade": (120, 0, 0), "century": (1200, 0, 0), "centurie": (1200, 0, 0), "millennium": (12000, 0, 0), "millennia": (12000, 0, 0),
}
_TERM = re.compile(r"\s*(?:([+-]?)(\d+):(\d{2})(?::(\d{2}(?:\.\d+)?))?|([+-]?(?:\d+(?:\.\d*)?|\.\d+))\s*([a-zA-Z]+))\s*")


def spill(months: Fraction, days: Fraction, micros: Fraction) -> tuple[int, int, int]:
    """Whole parts stay; a fraction of a month goes to 30-day days, a fraction of a day to microseconds."""
    whole_months = int(months)
    days += (months - whole_months) * 30
    whole_days = int(days)
    micros += (days - whole_days) * DAY
    return whole_months, whole_days, round(micros)


def parse(text: str) -> tuple[int, int, int]:
    """``<quantity> <unit>`` terms and clock terms; 22007 for anything else."""
    months = days = micros = Fraction(0)
    at, ago = 0, False
    body = text.strip()
    if body.lower().endswith(" ago"):
        body, ago = body[:-4], True
    if not body:
        raise SqlError("22007", f'invalid input syntax for type interval: "{text}"')
    while at < len(body):
        m = _TERM.match(body, at)
        if not m:
            raise SqlError("22007", f'invalid input syntax for type interval: "{text}"')
        at = m.end()
        if m[2]:
            value = (int(m[2]) * 3600 + int(m[3]) * 60 + Fraction(m[4] or 0)) * 1_000_000
            micros += -value if m[1] == "-" else value
            continue
        unit = m[6].lower()
        parts = _UNITS.get(unit) or _UNITS.get(unit[:-1] if unit.endswith("s") else "")
        if parts is None:
            raise SqlError("22007", f'invalid input syntax for type interval: "{text}"')
        amount = Fraction(m[5])
        add = spill(amount * parts[0], amount * parts[1], amount * parts[2])
        months, days, micros = months + add[0], days + add[1], micros + add[2]
    out = (int(months), int(days), int(micros))
    return tuple(-x for x in out) if ago else out


def let(v: Column, make: Callable[[Column], Column]) -> Column:
    """``make(v)``, with a long expression bound to a name: it is planned and evaluated once, however often it is used."""
    return make(v) if len(repr(v)) < 100 else F.element_at(F.transform(F.array(v), make), 1)


def literal(value: tuple[int, int, int]) -> Column:
    return struct(*(F.lit(x) for x in value))


def struct(months: Column, days: Column, micros: Column) -> Column:
    return F.struct(months.cast("int").alias("months"), days.cast("int").alias("days"), micros.cast("long").alias("micros"))


def parse_column(text: Column) -> Column:
    """Interval text that is no constant, in Arrow batches."""

    @F.pandas_udf(INTERVAL_STRUCT)
    def run(values: pd.Series) -> pd.DataFrame:
        rows = [parse(x) if x is not None else (None, None, None) for x in values]
        return pd.DataFrame(rows, columns=["months", "days", "micros"])

    return F.when(text.isNotNull(), run(text))


def key(v: Column) -> Column:
    """What intervals compare, group and sort by: 30-day months and 24-hour days, in microseconds."""
    return let(v, lambda x: ((x["months"].cast("decimal(38,0)") * 30 + x["days"]) * DAY + x["micros"]).cast("decimal(38,0)"))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    if sign < 0:
        return struct(a["months"] - b["months"], a["days"] - b["days"], a["micros"] - b["micros"])
    return struct(a["months"] + b["months"], a["days"] + b["days"], a["micros"] + b["micros"])


def negate(v: Column) -> Column:
    return struct(-v["months"], -v["days"], -v["micros"])


def _whole(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def multiply(v: Column, factor: Column) -> Column:
    """Fractions of a month become 30-day days, fractions of a day seconds, each rounded at six digits."""
    months, days = v["months"].cast("double") * factor, v["days"].cast("double") * factor
    over = F.round((months - _whole(months)) * 30, 6)
    seconds = F.round((days - _whole(days) + over - _whole(over)) * 86_400, 6)
    extra = F.when(F.abs(seconds) >= 86_400, _whole(seconds / 86_400)).otherwise(0.0)
    micros = F.rint(v["micros"].cast("double") * factor + (seconds - extra * 86_400) * 1_000_000)
    return F.when(v.isNotNull() & factor.isNotNull(), struct(_whole(months), _whole(days) + _whole(over) + extra, micros))


def add_to_stamp(stamp: Column, v: Column, sign: int = 1) -> Column:
    """Months (clamped to the month's end), then days, then microseconds, on a timestamp without zone."""
    months = v["months"] * sign
    days = v["days"] * sign
    moved = stamp + F.make_ym_interval(F.lit(0), months)
    moved = F.timestamp_add("DAY", days, moved)
    return F.timestamp_add("MICROSECOND", v["micros"] * sign, moved)


def between(a: Column, b: Column) -> Column:
    """``a - b`` of two timestamps: whole days and the rest."""
    micros = F.timestamp_diff("MICROSECOND", b, a)
    days = F.when(micros >= 0, F.floor(micros / DAY)).otherwise(F.ceil(micros / DAY))
    return F.when(micros.isNotNull(), struct(F.lit(0), days, micros - days * DAY))


def justify_days(v: Column) -> Column:
    return let(v, _justify_days)


def _justify_days(v: Column) -> Column:
    carry = (v["days"] / 30).cast("int")
    months, days = v["months"] + carry, v["days"] - carry * 30
    fix = F.when((months > 0) & (days < 0), -1).when((months < 0) & (days > 0), 1).otherwise(0)
    return F.when(v.isNotNull(), struct(months + fix, days - fix * 30, v["micros"]))


def justify_hours(v: Column) -> Column:
    return let(v, _justify_hours)


def _justify_hours(v: Column) -> Column:
    carry = F.when(v["micros"] >= 0, F.floor(v["micros"] / DAY)).otherwise(F.ceil(v["micros"] / DAY))
    days, micros = v["days"] + carry, v["micros"] - carry * DAY
    fix = F.when((days > 0) & (micros < 0), -1).when((days < 0) & (micros > 0), 1).otherwise(0)
    return F.when(v.isNotNull(), struct(v["months"], days + fix, micros - fix * F.lit(DAY)))


def justify_interval(v: Column) -> Column:
    """Microseconds into days, days into months, and then one sign throughout."""
    return let(v, _justify_interval)


def _justify_interval(v: Column) -> Column:
    hours = F.when(v["micros"] >= 0, F.floor(v["micros"] / DAY)).otherwise(F.ceil(v["micros"] / DAY))
    days, micros = v["days"] + hours, v["micros"] - hours * DAY
    months_carry = F.when(days >= 0, F.floor(days / 30)).otherwise(F.ceil(days / 30))
    months, days = v["months"] + months_carry, days - months_carry * 30
    down = ((days < 0) | ((days == 0) & (micros < 0))) & (months > 0)
    up = ((days > 0) | ((days == 0) & (micros > 0))) & (months < 0)
    m_fix = F.when(down, -1).when(up, 1).otherwise(0)
    months, days = months + m_fix, days - m_fix * 30
    d_fix = F.when((days > 0) & (micros < 0), -1).when((days < 0) & (micros > 0), 1).otherwise(0)
    return F.when(v.isNotNull(), struct(months, days + d_fix, micros - d_fix * F.lit(DAY)))


def text(v: Column) -> Column:
    """``1 year 2 mons 3 days 04:05:06``; a positive part after a negative one gets its plus sign."""
    return let(v, _text)


def _text(v: Column) -> Column:
    years, months = (v["months"] / 12).cast("int"), v["months"] % 12
    after_year = years < 0
    after_month = F.when(months != 0, months < 0).otherwise(after_year)
    after_day = F.when(v["days"] != 0, v["days"] < 0).otherwise(after_month)

    def plus(n: Column, before: Column) -> Column:
        return F.when(before & (n > 0), F.lit("+")).otherwise(F.lit(""))

    def part(n: Column, before: Column, one: str, many: str) -> Column:
        return F.when(n != 0, F.concat(plus(n, before), n.cast("string"), F.when(n == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}"))))

    micros = F.abs(v["micros"])
    second = micros % 60_000_000
    fraction = F.rtrim(F.lpad((second % 1_000_000).cast("string"), 6, "0"), F.lit("0"))
    clock = F.concat(
        F.when(v["micros"] < 0, F.lit("-")).otherwise(plus(v["micros"], after_day)),
        F.format_string("%02d:%02d:%02d", F.floor(micros / 3_600_000_000).cast("long"), (F.floor(micros / 60_000_000) % 60).cast("long"), F.floor(second / 1_000_000).cast("long")),
        F.when(second % 1_000_000 != 0, F.concat(F.lit("."), fraction)).otherwise(F.lit("")),
    )
    nothing = (v["months"] == 0) & (v["days"] == 0)
    out = F.concat_ws(" ", part(years, F.lit(False), "year", "years"), part(months, after_year, "mon", "mons"), part(v["days"], after_month, "day", "days"), F.when((v["micros"] != 0) | nothing, clock))
    return F.when(v.isNotNull(), out)
