"""The cast matrix: explicit casts with PostgreSQL's rounding, spellings and errors."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SqlError
from ..types import BOOL, DATE, FLOAT8, INT4, INT8, INTERVAL, NUMERIC, TEXT, TIME, TIMESTAMP, TIMESTAMPTZ, UNKNOWN, PgType, Val, fail, is_number, numeric_literal, numeric_of
from . import interval as iv

_NUMBER = {"int4", "int8", "numeric", "float8"}
#: Casts besides identity, to and from text, and among numbers.
_ALLOWED = {("boolean", "int4"), ("int4", "boolean"), ("date", "timestamp"), ("date", "timestamptz"), ("timestamp", "date"), ("timestamp", "time"), ("timestamp", "timestamptz"), ("timestamptz", "date"), ("timestamptz", "time"), ("timestamptz", "timestamp"), ("time", "interval")}
_BOUNDS = {"int4": (-(2**31), 2**31 - 1), "int8": (-(2**63), 2**63 - 1)}
# Spellings of truth, any unambiguous beginning of the words.
_TRUE = ("t", "tr", "tru", "true", "y", "ye", "yes", "on", "1")
_FALSE = ("f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0")

DATE_TEXT = r"^\s*\d{4,6}-\d{1,2}-\d{1,2}\s*$"
TIME_TEXT = r"^\s*\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?\s*$"
STAMP_TEXT = r"^\s*\d{4,6}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?\s*$"
STAMPTZ_TEXT = r"^\s*\d{4,6}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?\s*(Z|z|[+-]\d{2}(:?\d{2}(:\d{2})?)?)?\s*$"


def allowed(a: PgType, b: PgType) -> bool:
    if a.name == b.name or a == UNKNOWN or "text" in (a.name, b.name):
        return True
    return a.name in _NUMBER and b.name in _NUMBER or (a.name, b.name) in _ALLOWED


def cast(v: Val, to: PgType) -> Val:
    """``v::to``; 42846 where the matrix has no such cast."""
    if not allowed(v.type, to):
        raise SqlError("42846", f"cannot cast type {v.type} to {to}")
    if v.type.name == to.name:
        if to.name == "numeric" and to != v.type and to.precision:
            return Val(_to_numeric(v.col, to), to)
        return Val(v.col, to, v.literal) if v.type.name != "numeric" else v
    if v.type == UNKNOWN or v.type == TEXT:
        plain = to.name == "numeric" and not to.precision and isinstance(v.literal, str) and re.fullmatch(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)\s*", v.literal)
        return numeric_literal(Decimal(v.literal.strip())) if plain else Val(_from_text(v, to), to)
    if to == TEXT:
        return Val(text_of(v, in_cast=True), TEXT)
    if to.name in ("int4", "int8"):
        return Val(_to_integer(v, to), to)
    if to.name == "numeric":
        return _number_to_numeric(v, to)
    if to == FLOAT8:
        return Val((v.col if v.whole is None else v.whole).cast("double"), to)
    if to == BOOL:
        return Val(v.col != 0, to)
    return Val(_temporal(v, to), to)


def _to_integer(v: Val, to: PgType) -> Column:
    if v.type == BOOL:
        return v.col.cast("int")
    low, high = _BOUNDS[to.name]
    if v.whole is not None:  # no way through decimals
        return v.whole.cast("long") if to == INT8 else v.whole.cast("int")
    whole = {"float8": lambda: F.rint(v.col), "numeric": lambda: F.round(numeric_of(v).col, 0)}.get(v.type.name, lambda: v.col)()
    if v.type.name in ("int4", "int8") and to == INT8:
        return v.col.cast("long")
    top = float(high) if v.type == FLOAT8 and to == INT8 else high
    inside = (whole >= low) & ((whole < top) if v.type == FLOAT8 and to == INT8 else (whole <= high))
    return F.when(whole.isNull() | inside, whole.cast(to.spark)).otherwise(fail("22003", f"{'integer' if to == INT4 else 'bigint'} out of range"))


def _to_numeric(col: Column, to: PgType) -> Column:
    rounded = F.round(col, to.scale)
    limit = 10 ** (to.precision - to.scale)
    return F.when(rounded.isNull() | (F.abs(rounded) < F.lit(limit).cast(T.DecimalType(38, 0))), rounded.cast(to.spark)).otherwise(fail("22003", "numeric field overflow"))


def _number_to_numeric(v: Val, to: PgType) -> Val:
    if v.type == FLOAT8:
        # 15 significant digits, as the text of a double shows
        shown = F.format_string("%.14e", v.col).cast("double").cast("string").cast(T.DecimalType(38, 18))
        col = F.when(v.col.isNull(), F.lit(None).cast(T.DecimalType(38, 18))).when(F.isnan(v.col) | (F.abs(v.col) > 1e20), fail("22003", "value out of range for numeric")).otherwise(shown)
        return Val(_to_numeric(col, to) if to.precision else col, to if to.precision else NUMERIC)
    exact = numeric_of(v)
    return Val(_to_numeric(exact.col, to), to) if to.precision else exact


def _from_text(v: Val, to: PgType) -> Column:
    text = v.col
    trimmed = F.trim(text)
    if to == TEXT:
        return text

    def checked(ok: Column, value: Column, state: str, what: str) -> Column:
        bad = F.raise_error(F.concat(F.lit(f'{state}: invalid input syntax for type {what}: "'), text, F.lit('"')))
        return F.when(text.isNull(), F.lit(None).cast(to.spark)).when(ok, value).otherwise(bad)

    if to == BOOL:
        low = F.lower(trimmed)
        return checked(low.isin(*_TRUE, *_FALSE), low.isin(*_TRUE), "22P02", "boolean")
    if to.name in ("int4", "int8"):
        low, high = _BOUNDS[to.name]
        wide = trimmed.try_cast(T.DecimalType(38, 0))
        ranged = F.when((wide >= low) & (wide <= high), wide.cast(to.spark)).otherwise(fail("22003", f"value is out of range for type {to}"))
        return checked(trimmed.rlike(r"^[+-]?\d{1,38}$"), ranged, "22P02", "integer" if to == INT4 else "bigint")
    if to == FLOAT8:
        ok = trimmed.rlike(r"^(?i)[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?$") | F.lower(trimmed).isin("nan", "infinity", "+infinity", "-infinity", "inf", "+inf", "-inf")
        return checked(ok, trimmed.cast("double"), "22P02", "double precision")
    if to.name == "numeric":
        value = trimmed.cast(T.DecimalType(38, max(18, to.scale or 0) if not to.precision or to.precision <= 38 - 18 + (to.scale or 0) else to.scale or 0))
        return checked(trimmed.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), _to_numeric(value, to) if to.precision else value, "22P02", "numeric")
    if to == DATE:
        return checked(text.rlike(DATE_TEXT), _in_field(trimmed.try_cast("date"), "date"), "22007", "date")
    if to == TIME:
        return checked(text.rlike(TIME_TEXT), time_micros(trimmed), "22007", "time")
    if to == TIMESTAMP:
        return checked(text.rlike(STAMP_TEXT), _in_field(trimmed.try_cast("timestamp_ntz"), "timestamp"), "22007", "timestamp")
    if to == TIMESTAMPTZ:
        compact = F.regexp_replace(trimmed, r"([+-]\d{2})(\d{2})$", "$1:$2")
        return checked(text.rlike(STAMPTZ_TEXT), _in_field(compact.try_cast("timestamp_ltz"), "timestamptz"), "22007", "timestamp with time zone")
    if to == INTERVAL:
        if v.literal is not None:
            return iv.literal(iv.parse(v.literal))
        return iv.parse_column(text)
    if to.name == "bytea":
        return F.when(text.startswith("\\x"), F.unhex(F.substring(text, 3, 1 << 30))).otherwise(F.encode(text, "UTF-8"))
    raise SqlError("42846", f"cannot cast type text to {to}")


def _in_field(value: Column, what: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(fail("22008", f"{what} field value out of range"))


def time_micros(text: Column) -> Column:
    """Microseconds since midnight of ``HH:MM[:SS[.ffffff]]``."""
    hour = F.regexp_extract(text, r"^(\d+):", 1).cast("long")
    minute = F.regexp_extract(text, r"^\d+:(\d+)", 1).cast("long")
    second = F.coalesce(F.nullif(F.regexp_extract(text, r"^\d+:\d+:(\d+(\.\d+)?)", 1), F.lit("")), F.lit("0")).cast("decimal(8,6)")
    value = (hour * 3600 + minute * 60) * 1_000_000 + (second * 1_000_000).cast("long")
    return F.when((hour <= 24) & (minute < 60) & (second < 60) & (value <= 86_400_000_000), value).otherwise(fail("22008", "time field value out of range"))


def micros_of_day(stamp: Column) -> Column:
    """Microseconds since midnight of a timestamp without zone."""
    return F.pmod(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), stamp), F.lit(86_400_000_000).cast("long"))


def _temporal(v: Val, to: PgType) -> Column:
    col = v.col
    if to in (DATE, TIMESTAMP, TIMESTAMPTZ):
        return col.cast(to.spark)
    if to == TIME:
        return micros_of_day(col.cast("timestamp_ntz"))
    return F.when(col.isNotNull(), iv.struct(F.lit(0), F.lit(0), col))  # time to interval


def time_text(micros: Column) -> Column:
    fraction = F.rtrim(F.lpad((micros % 1_000_000).cast("string"), 6, "0"), F.lit("0"))
    base = F.format_string("%02d:%02d:%02d", F.floor(micros / 3_600_000_000).cast("long"), (F.floor(micros / 60_000_000) % 60).cast("long"), (F.floor(micros / 1_000_000) % 60).cast("long"))
    return F.when(micros % 1_000_000 == 0, base).otherwise(F.concat(base, F.lit("."), fraction))


def _float_text(col: Column) -> Column:
    """Shortest digits that read back the same, without an exponent."""
    plain = F.regexp_replace(F.when(F.abs(col).between(1e-3, 9_999_999), col.cast("string")).otherwise(F.regexp_replace(col.cast("decimal(38,15)").cast("string"), r"0+$", "")), r"\.0*$", "")
    special = F.when(F.isnan(col), F.lit("NaN")).when(col == float("inf"), F.lit("Infinity")).when(col == float("-inf"), F.lit("-Infinity")).when(col == 0, F.lit("0"))
    return F.when(col.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(special, F.when(F.abs(col) < 1e22, plain).otherwise(F.format_string("%.0f", col))))


def text_of(v: Val, in_cast: bool = False) -> Column:
    """A value as text: booleans as t or f, but true or false in a cast."""
    col = v.col
    if v.type in (TEXT, UNKNOWN):
        return col.cast("string")
    if v.type == BOOL:
        yes, no = ("true", "false") if in_cast else ("t", "f")
        return F.when(col, F.lit(yes)).when(~col, F.lit(no))
    if v.type == FLOAT8:
        return _float_text(col)
    if v.type == TIME:
        return time_text(col)
    if v.type == INTERVAL:
        return iv.text(col)
    if v.type == TIMESTAMPTZ:
        return iv.let(col, _zoned_text)
    if v.type.name == "bytea":
        return F.concat(F.lit("\\x"), F.lower(F.hex(col)))
    if v.shown is not None:
        whole = col.cast("string")
        return F.when(v.shown <= 0, F.substring_index(whole, ".", 1)).otherwise(F.substring(whole, F.lit(1), F.instr(whole, ".") + v.shown))
    return col.cast("string")


def _zoned_text(col: Column) -> Column:
    def parts(minutes: Column) -> Column:
        offset = F.concat(F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")), F.format_string("%02d", F.floor(F.abs(minutes) / 60).cast("long")), F.when(F.abs(minutes) % 60 != 0, F.format_string(":%02d", (F.abs(minutes) % 60).cast("long"))).otherwise(F.lit("")))
        return F.concat(col.cast("timestamp_ntz").cast("string"), offset)

    return iv.let(zone_minutes(col), parts)


def zone_minutes(col: Column) -> Column:
    """The session zone's offset from UTC at an instant."""
    local = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col.cast("timestamp_ntz"))
    return F.floor((local - F.unix_micros(col)) / 60_000_000).cast("long")


def comparable(a: PgType, b: PgType) -> bool:
    if UNKNOWN in (a, b) or a.name == b.name:
        return True
    return is_number(a) and is_number(b) or {a.name, b.name} <= {"date", "timestamp", "timestamptz"}
