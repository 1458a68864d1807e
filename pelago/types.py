"""PostgreSQL types over Spark's, the numeric tower, and typed columns."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SqlError

#: Digits of a numeric without declared precision: Spark's widest decimal.
MAX_DIGITS, FREE_SCALE = 38, 18


@dataclass(frozen=True)
class PgType:
    name: str
    precision: int | None = None
    scale: int | None = None

    def __str__(self) -> str:
        return f"numeric({self.precision},{self.scale})" if self.precision else self.name

    @property
    def spark(self) -> T.DataType:
        if self.name == "numeric":
            return T.DecimalType(self.precision or MAX_DIGITS, self.scale if self.scale is not None else FREE_SCALE)
        return _SPARK[self.name]


BOOL, INT4, INT8, FLOAT8, TEXT, DATE, TIME, TIMESTAMP, TIMESTAMPTZ, INTERVAL, BYTEA, UNKNOWN = (
    PgType(n) for n in ("boolean", "int4", "int8", "float8", "text", "date", "time", "timestamp", "timestamptz", "interval", "bytea", "unknown")
)
NUMERIC = PgType("numeric")

#: An interval keeps its three parts; a time is microseconds since midnight.
INTERVAL_STRUCT = T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())])
_SPARK = {
    "boolean": T.BooleanType(), "int4": T.IntegerType(), "int8": T.LongType(), "float8": T.DoubleType(), "text": T.StringType(), "unknown": T.StringType(),
    "date": T.DateType(), "time": T.LongType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "interval": INTERVAL_STRUCT, "bytea": T.BinaryType(),
}

# Names that SQL text may use for the types.
_NAMES = {
    "bool": BOOL, "boolean": BOOL, "int": INT4, "integer": INT4, "int4": INT4, "bigint": INT8, "int8": INT8, "text": TEXT, "double": FLOAT8, "float8": FLOAT8, "float": FLOAT8,
    "date": DATE, "time": TIME, "timestamp": TIMESTAMP, "timestamptz": TIMESTAMPTZ, "interval": INTERVAL, "bytea": BYTEA, "numeric": NUMERIC, "decimal": NUMERIC,
}


def type_named(name: str, args: list[int]) -> PgType:
    if name not in _NAMES:
        raise SqlError("42704", f'type "{name}" does not exist')
    found = _NAMES[name]
    if args:
        if found != NUMERIC or len(args) > 2:
            raise SqlError("42601", f'type modifier is not allowed for type "{name}"')
        precision, scale = args[0], args[1] if len(args) > 1 else 0
        if not 1 <= precision <= MAX_DIGITS or scale > precision:
            raise SqlError("22023", f"numeric precision {precision} must be between 1 and {MAX_DIGITS}, and no less than the scale")
        return PgType("numeric", precision, scale)
    return found


def type_of(spark_type: T.DataType) -> PgType:
    """The PostgreSQL type of a stored column."""
    if isinstance(spark_type, T.DecimalType):
        return PgType("numeric", spark_type.precision, spark_type.scale)
    if isinstance(spark_type, T.StructType) and [f.name for f in spark_type] == ["months", "days", "micros"]:
        return INTERVAL
    for kind, pg in ((T.BooleanType, BOOL), (T.LongType, INT8), (T.DoubleType, FLOAT8), (T.FloatType, FLOAT8), (T.StringType, TEXT), (T.DateType, DATE), (T.TimestampNTZType, TIMESTAMP), (T.TimestampType, TIMESTAMPTZ), (T.BinaryType, BYTEA), (T.IntegerType, INT4), (T.ShortType, INT4), (T.ByteType, INT4)):
        if isinstance(spark_type, kind):
            return pg
    return TEXT


@dataclass(frozen=True)
class Val:
    """A column with its PostgreSQL type.

    ``literal`` holds a constant's value where it is known.  Of a numeric, ``shown`` is the number of digits after the
    point that its text has, where that depends on the value, and ``whole`` the same value as an integer column, where it
    is one.
    """

    col: Column
    type: PgType
    literal: object = None
    shown: Column | None = None
    whole: Column | None = None


def numeric_literal(v: Decimal) -> Val:
    """A constant with its own digits and scale; 22003 for more than a decimal holds."""
    scale = max(0, -v.as_tuple().exponent)
    precision = max(len(v.as_tuple().digits) + max(0, v.as_tuple().exponent), scale, 1)
    if precision > MAX_DIGITS:
        raise SqlError("22003", f"a numeric of more than {MAX_DIGITS} digits is not supported")
    return Val(F.lit(f"{v:f}").cast(T.DecimalType(precision, scale)), PgType("numeric", precision, scale), v)


_TOWER = {"int4": 0, "int8": 1, "numeric": 2, "float8": 3}


def is_number(t: PgType) -> bool:
    return t.name in _TOWER


def numeric_of(v: Val) -> Val:
    """Any exact number as a decimal without loss."""
    if v.type.name == "numeric":
        return Val(v.col.cast(v.type.spark), v.type, v.literal)
    digits = 10 if v.type == INT4 else 19
    return Val(v.col.cast(T.DecimalType(digits, 0)), PgType("numeric", digits, 0), v.literal)


def wider(a: PgType, b: PgType) -> PgType:
    """The common type of two numbers; decimals get room for both."""
    if _TOWER[a.name] < _TOWER[b.name]:
        a, b = b, a
    if a.name != "numeric":
        return a
    def digits(t: PgType) -> tuple[int, int]:
        return (t.precision or MAX_DIGITS, t.scale if t.scale is not None else FREE_SCALE) if t.name == "numeric" else (10 if t == INT4 else 19, 0)

    (p1, s1), (p2, s2) = digits(a), digits(b)
    scale = max(s1, s2)
    return PgType("numeric", min(MAX_DIGITS, max(p1 - s1, p2 - s2) + scale), scale)


def unify(types: list[PgType]) -> PgType:
    """One type for the branches of CASE, a set operation or VALUES; unknown literals take the others' type."""
    known = [t for t in types if t != UNKNOWN]
    if not known:
        return TEXT
    out = known[0]
    for t in known[1:]:
        if is_number(out) and is_number(t):
            out = wider(out, t)
        elif out.name == "date" and t.name in ("timestamp", "timestamptz"):
            out = t
        elif out.name in ("timestamp", "timestamptz") and t.name == "date":
            pass
        elif out.name == "timestamp" and t.name == "timestamptz":
            out = t
        elif out.name == "timestamptz" and t.name == "timestamp":
            pass
        elif out.name != t.name:
            raise SqlError("42804", f"types {out} and {t} cannot be matched")
    return out


def fail(state: str, message: str) -> Column:
    """A column that raises when it is evaluated."""
    return F.raise_error(F.lit(f"{state}: {message}"))
