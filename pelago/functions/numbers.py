"""Arithmetic and mathematical functions with PostgreSQL's result types, rounding and errors."""

from __future__ import annotations

import contextlib
import decimal
import math
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SqlError
from ..types import FLOAT8, INT4, INT8, MAX_DIGITS, NUMERIC, PgType, Val, fail, is_number, numeric_literal, numeric_of, wider

_ZERO = ("22012", "division by zero")


def _decimal(col: Column, precision: int, scale: int) -> Val:
    precision = min(MAX_DIGITS, precision)
    kind = PgType("numeric", precision, min(scale, precision))
    return Val(col.cast(kind.spark), kind)


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """``+ - * /`` and ``mod`` on two numbers."""
    if not (is_number(a.type) and is_number(b.type)):
        raise SqlError("42883", f"operator does not exist: {a.type} {op} {b.type}")
    kind = wider(a.type, b.type)
    if kind == FLOAT8:
        x, y = a.col.cast("double"), b.col.cast("double")
        if op == "mod":
            raise SqlError("42883", "function mod(double precision, double precision) does not exist")
        if op == "/":
            return Val(F.when(y == 0, fail(*_ZERO)).otherwise(_finite(x / F.when(y != 0, y), x, y)), FLOAT8)
        return Val(_finite({"+": x + y, "-": x - y, "*": x * y}[op], x, y), FLOAT8)
    if kind in (INT4, INT8):
        spark = kind.spark
        x, y = a.col.cast(spark), b.col.cast(spark)
        if op == "mod":
            return Val(F.when(y == 0, fail(*_ZERO)).otherwise(x % F.when(y != 0, y)).cast(spark), kind)
        if op == "/":
            low = -(2**31) if kind == INT4 else -(2**63)
            over = fail("22003", "integer out of range" if kind == INT4 else "bigint out of range")
            safe = F.when(y == 0, fail(*_ZERO)).when((x == low) & (y == -1), over).otherwise(_truncated(x, F.when((y != 0) & ~((x == low) & (y == -1)), y)))
            return Val(safe.cast(spark), kind)
        return Val({"+": x + y, "-": x - y, "*": x * y}[op], kind)
    x, y = numeric_of(a), numeric_of(b)
    (p1, s1), (p2, s2) = (_size(x.type), _size(y.type))
    if op in ("+", "-", "*") and _constant(a, b):
        with decimal.localcontext() as ctx:
            ctx.prec = 120
            p, q = Decimal(a.literal), Decimal(b.literal)
            return numeric_literal(p + q if op == "+" else p - q if op == "-" else p * q)
    if op in "+-":
        scale = max(s1, s2)
        return _decimal(x.col + y.col if op == "+" else x.col - y.col, max(p1 - s1, p2 - s2) + scale + 1, scale)
    if op == "*":
        return _decimal(x.col * y.col, p1 + p2, min(s1 + s2, MAX_DIGITS - 6))
    nonzero = F.when(y.col != 0, y.col)
    if op == "mod":
        scale = max(s1, s2)
        made = _decimal(x.col % nonzero, max(p1 - s1, p2 - s2) + scale, scale)
        return Val(F.when(y.col == 0, fail(*_ZERO)).otherwise(made.col), made.type)
    if _constant(a, b) and b.literal:
        return _fixed(lambda: Decimal(a.literal) / Decimal(b.literal), _constant_scale(Decimal(a.literal), Decimal(b.literal)))
    scale = max(s1 + s2, 16)
    scale = min(scale, 20)
    whole = x.col.cast(T.DecimalType(min(MAX_DIGITS, p1 + scale), min(scale + s2, MAX_DIGITS - max(1, p1 - s1))))
    quotient = F.round(whole / nonzero, scale)
    shown = F.least(division_scale(x, y), F.lit(scale))
    rounded = quotient
    for places in sorted({*range(0, scale, 4), min(s1 + s2, scale)} - {scale}, reverse=True):
        rounded = F.when(shown == places, F.round(quotient, places).cast(T.DecimalType(MAX_DIGITS, scale))).otherwise(rounded.cast(T.DecimalType(MAX_DIGITS, scale)))
    made = _decimal(rounded, MAX_DIGITS, scale)
    return Val(F.when(y.col == 0, fail(*_ZERO)).otherwise(made.col), made.type, shown=shown)


def _constant(*args: Val) -> bool:
    return all(isinstance(v.literal, (int, Decimal)) and not isinstance(v.literal, bool) for v in args)


def _fixed(value: Callable[[], Decimal], places: int) -> Val:
    """A constant rounded half away from zero at ``places``, as far as a decimal has room for them."""
    with decimal.localcontext() as ctx:
        ctx.prec = 120
        value = value()
        room = MAX_DIGITS - max(1, value.adjusted() + 1)
        return numeric_literal(value.quantize(Decimal(1).scaleb(-min(places, max(room, 0))), rounding=decimal.ROUND_HALF_UP))


# How many digits a quotient shows: sixteen significant ones, counted in groups of four.


def _group(v: Decimal) -> tuple[int, int]:
    """Weight of the first non-zero group of four digits, and that group."""
    if not v:
        return 0, 0
    weight = v.adjusted() // 4
    with decimal.localcontext() as ctx:
        ctx.prec = 120
        return weight, int(abs(v).scaleb(-4 * weight))


def _constant_scale(a: Decimal, b: Decimal) -> int:
    (w1, f1), (w2, f2) = _group(a), _group(b)
    return max(16 - 4 * (w1 - w2 - (f1 < f2)), sum(max(0, -x.as_tuple().exponent) for x in (a, b)), 0)


def division_scale(a: Val, b: Val) -> Column:
    """The same for columns, by comparisons with powers of ten thousand."""

    def parts(v: Val) -> tuple[Column, Column]:
        p, s = _size(v.type)
        x = F.abs(v.col)
        weight, lead = F.lit(0), F.lit(0).cast("long")
        for w in range(-(-s // 4) * -1, (p - s + 3) // 4 + 1):
            if 4 * w >= p - s or -4 * w > MAX_DIGITS - 1:
                continue
            step = F.lit(f"{Decimal(1).scaleb(4 * w):f}").cast(T.DecimalType(max(4 * w + 1, -4 * w + 1, 1), max(0, -4 * w)))
            here = x >= step
            weight = F.when(here, F.lit(w)).otherwise(weight)
            lead = F.when(here, F.floor(x / step).cast("long")).otherwise(lead)
        return weight, lead

    (w1, f1), (w2, f2) = parts(a), parts(b)
    groups = w1 - w2 - F.when(f1 < f2, 1).otherwise(0)
    return F.greatest(16 - groups * 4, F.lit(_size(a.type)[1] + _size(b.type)[1]), F.lit(0))


def _size(t: PgType) -> tuple[int, int]:
    return t.spark.precision, t.spark.scale


def _truncated(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _finite(value: Column, x: Column, y: Column) -> Column:
    huge = (F.abs(value) == float("inf")) & (F.abs(x) != float("inf")) & (F.abs(y) != float("inf"))
    return F.when(huge, fail("22003", "value out of range: overflow")).otherwise(value)


def rounding(name: str, v: Val) -> Val:
    """``round ceil floor trunc`` of one argument: same type as the argument; numerics lose their fraction."""
    if v.type in (INT4, INT8):
        return v
    if v.type == FLOAT8:
        col = v.col
        if name == "round":
            return Val(F.rint(col), FLOAT8)
        whole = {"ceil": F.ceil, "floor": F.floor}
        big = F.isnan(col) | (F.abs(col) >= 2.0**52)
        safe = F.when(big, F.lit(0.0)).otherwise(col)
        made = F.when(col >= 0, F.floor(safe)).otherwise(F.ceil(safe)) if name == "trunc" else whole[name](safe)
        return Val(F.when(big, col).otherwise(made.cast("double")), FLOAT8)
    x = numeric_of(v)
    p, s = _size(x.type)
    made = {"round": lambda: F.round(x.col, 0), "ceil": lambda: F.ceil(x.col), "floor": lambda: F.floor(x.col), "trunc": lambda: F.when(x.col >= 0, F.floor(x.col)).otherwise(F.ceil(x.col))}[name]()
    return _decimal(made, p - s + 1, 0)


def round_to(name: str, v: Val, n: Val) -> Val:
    """``round`` or ``trunc`` of a numeric to n places, which may be negative."""
    if v.type == FLOAT8:
        raise SqlError("42883", f"function {name}(double precision, integer) does not exist")
    x = numeric_of(v)
    p, s = _size(x.type)
    if isinstance(n.literal, int):
        places = n.literal
        if name == "round":
            return _decimal(F.round(x.col, places), p - s + 1 + max(places, 0), max(places, 0))
        if places >= s:
            return x
        step = Decimal(1).scaleb(-places)
        return _decimal(x.col - x.col % F.lit(step), p, max(places, 0))
    wide = x.col.cast(T.DecimalType(MAX_DIGITS, s))

    @F.pandas_udf(T.DecimalType(MAX_DIGITS, min(s, 18)))
    def run(values: pd.Series, places: pd.Series) -> pd.Series:
        mode = decimal.ROUND_HALF_UP if name == "round" else decimal.ROUND_DOWN
        return pd.Series([None if a is None or pd.isna(b) else _cut(_cut(a, int(b), mode), min(s, 18)) for a, b in zip(values, places, strict=True)])

    return Val(run(wide, n.col), PgType("numeric", MAX_DIGITS, min(s, 18)))


def sign(v: Val) -> Val:
    if v.type == FLOAT8:
        return Val(F.when(F.isnan(v.col), v.col).otherwise(F.signum(v.col)), FLOAT8)
    made = F.when(v.col > 0, 1).when(v.col < 0, -1).when(v.col == 0, 0)
    return _decimal(made, 1, 0) if v.type.name == "numeric" else Val(made.cast(v.type.spark), v.type)


def absolute(v: Val) -> Val:
    if not is_number(v.type):
        raise SqlError("42883", f"function abs({v.type}) does not exist")
    return Val(F.abs(v.col), v.type, shown=v.shown)


def _ln_weight(x: Decimal) -> int:
    """A lower estimate of the decimal weight of x's logarithm."""
    return max(0, math.floor(math.log10(abs(x.adjusted()) * math.log(10)))) if x.adjusted() else 0


def _transcendental(name: str, x: Decimal, y: Decimal | None) -> Decimal:
    """The value with as many digits after the point as it shows: sixteen significant ones by a rule for each function,
    and never fewer than the argument has (but for powers)."""
    own = max(0, -x.as_tuple().exponent)
    with decimal.localcontext() as ctx:
        ctx.prec = 120
        if name == "sqrt":
            out, places = x.sqrt(), max(16 - (2 * _group(x)[0] + 1), own)
        elif name == "exp":
            out, places = x.exp(), max(16 - int(float(x) * math.log10(math.e)), own)
        elif name in ("ln", "log"):
            out, places = x.ln() if name == "ln" else x.log10(), max(16 - _ln_weight(x), own)
        elif not x:
            out, places = Decimal(0 if y else 1), 16
        elif y == y.to_integral_value():
            out = x ** int(y)
            weight = out.adjusted()
            places = 16 - weight - (weight < 0 and out.normalize().as_tuple().digits != (1,))
        else:
            out, places = x**y, 16 - int(float(y) * x.adjusted())
        return out.quantize(Decimal(1).scaleb(-max(0, places)), rounding=decimal.ROUND_HALF_UP)


_SHOWN = T.StructType([T.StructField("value", T.DecimalType(38, 18)), T.StructField("shown", T.IntegerType())])


def _precise(name: str, args: list[Val]) -> Val:
    """A function of numerics, of constants here and else in Arrow batches; a column has room for 18 digits after the
    point and 20 before it (22003 beyond)."""
    if _constant(*args):
        with contextlib.suppress(ArithmeticError, ValueError):
            x, y = (*(Decimal(a.literal) for a in args), None)[:2]
            made = _transcendental(name, x, y)
            return _fixed(lambda: made, -made.as_tuple().exponent)

    def all_of(*columns: pd.Series) -> pd.DataFrame:
        values, shown = [], []
        for row in zip(*columns, strict=True):
            out = None if any(x is None for x in row) else _transcendental(name, row[0], row[1] if len(row) > 1 else None)
            if out is not None and out.adjusted() >= 20:
                raise SqlError("22003", "value overflows numeric format")
            shown.append(None if out is None else min(18, -out.as_tuple().exponent))
            values.append(None if out is None else _cut(out, 18))
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "shown": pd.Series(shown, dtype="Int32")})

    cols = [numeric_of(a).col for a in args]
    if len(cols) == 1:

        @F.pandas_udf(_SHOWN)
        def run(values: pd.Series) -> pd.DataFrame:
            return all_of(values)

    else:

        @F.pandas_udf(_SHOWN)
        def run(values: pd.Series, others: pd.Series) -> pd.DataFrame:
            return all_of(values, others)

    made = run(*cols)
    return Val(made["value"], NUMERIC, shown=made["shown"])


def _cut(v: Decimal, places: int, mode: str = decimal.ROUND_HALF_UP) -> Decimal:
    """``v`` at ``places`` digits after the point, whatever its size."""
    with decimal.localcontext() as ctx:
        ctx.prec = 120
        return v.quantize(Decimal(1).scaleb(-places), rounding=mode)


def function(name: str, v: Val) -> Val:
    """``sqrt exp ln log``: numeric for numerics, double for other numbers; log is to base 10."""
    guard = {
        "sqrt": (lambda c: c < 0, "2201F", "cannot take square root of a negative number"),
        "ln": (lambda c: c <= 0, "2201E", "cannot take logarithm of zero or a negative number"),
        "log": (lambda c: c <= 0, "2201E", "cannot take logarithm of zero or a negative number"),
        "exp": (lambda c: c > 709.782712893384, "22003", "value out of range: overflow"),
    }[name]
    bad = guard[0](v.col)
    if v.type.name == "numeric":
        if _constant(v) and not (v.literal < 0 if name == "sqrt" else v.literal <= 0 if name != "exp" else v.literal > 80):
            return _precise(name, [v])
        made = _precise(name, [Val(F.when(~bad, numeric_of(v).col), v.type)])
    else:
        x = F.when(~bad, v.col.cast("double"))
        made = Val({"sqrt": F.sqrt, "exp": F.exp, "ln": F.ln, "log": F.log10}[name](x), FLOAT8)
    return Val(F.when(bad, fail(guard[1], guard[2])).otherwise(made.col), made.type, shown=made.shown)


def power(a: Val, b: Val) -> Val:
    bad_zero, bad_root = (a.col == 0) & (b.col < 0), (a.col < 0) & (b.col.cast("double") != F.rint(b.col.cast("double")))
    if "numeric" in (a.type.name, b.type.name) and FLOAT8 not in (a.type, b.type):
        ok = ~(bad_zero | bad_root)
        if _constant(a, b) and not (a.literal == 0 and b.literal < 0 or a.literal < 0 and b.literal != int(b.literal)):
            return _precise("power", [a, b])
        made = _precise("power", [Val(F.when(ok, numeric_of(a).col), a.type if a.type.name == "numeric" else numeric_of(a).type), numeric_of(b)])
    else:
        x, y = a.col.cast("double"), b.col.cast("double")
        value = F.pow(x, y)
        made = Val(_finite(value, x, y), FLOAT8)
    return Val(F.when(bad_zero, fail("2201F", "zero raised to a negative power is undefined")).when(bad_root, fail("2201F", "a negative number raised to a non-integer power yields a complex result")).otherwise(made.col), made.type, shown=made.shown)


def negate(v: Val) -> Val:
    return Val(-v.col, v.type, -v.literal if isinstance(v.literal, (int, Decimal)) else None, v.shown)
