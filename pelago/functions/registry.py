"""Function names to typed expressions, with PostgreSQL's overloads and its 42883 for what has none."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..errors import SqlError
from ..types import BOOL, DATE, FLOAT8, INT4, INT8, INTERVAL, TEXT, TIME, TIMESTAMP, TIMESTAMPTZ, UNKNOWN, PgType, Val, fail, is_number, unify
from . import datetime as dt
from . import formatting, numbers, strings
from . import interval as iv
from .casts import cast, comparable, micros_of_day, text_of


@dataclass
class Context:
    """What is fixed for a statement: its instant, and the start of its transaction."""

    statement: object = None
    transaction: object = None
    zone: str = "UTC"
    extra: dict = field(default_factory=dict)


Function = Callable[[list[Val], Context], Val]
FUNCTIONS: dict[str, Function] = {}


def _no(name: str, args: list[Val]) -> SqlError:
    return SqlError("42883", f"function {name}({', '.join(str(a.type) for a in args)}) does not exist")


def define(*names: str, least: int, most: int | None = None):
    def add(f: Function) -> Function:
        for name in names:

            def checked(args: list[Val], ctx: Context, name=name) -> Val:
                if not least <= len(args) <= (most if most is not None else least):
                    raise _no(name, args)
                return f(args, ctx) if f.__code__.co_argcount == 2 else f(args, ctx, name)

            FUNCTIONS[name] = checked
        return f

    return add


def _text(name: str, args: list[Val], *at: int) -> list[Val]:
    for i in at or range(len(args)):
        if i < len(args) and args[i].type not in (TEXT, UNKNOWN):
            raise _no(name, args)
    return args


def _int(name: str, args: list[Val], *at: int) -> None:
    for i in at:
        if i < len(args) and args[i].type not in (INT4, INT8, UNKNOWN):
            raise _no(name, args)


@define("length", "char_length", "character_length", least=1)
def _length(a, ctx, name):
    return Val(F.length(_text(name, a)[0].col), INT4)


@define("upper", "lower", "reverse", "initcap", least=1)
def _case(a, ctx, name):
    s = _text(name, a)[0].col
    return Val({"upper": F.upper, "lower": F.lower, "reverse": F.reverse, "initcap": strings.initcap}[name](s), TEXT)


@define("btrim", "ltrim", "rtrim", "trim", least=1, most=2)
def _trim(a, ctx, name):
    _text(name, a)
    return Val(strings.trim(a[0].col, a[1].col if len(a) > 1 else None, name != "rtrim", name != "ltrim"), TEXT)


@define("substr", "substring", least=2, most=3)
def _substr(a, ctx, name):
    _text(name, a, 0)
    _int(name, a, 1, 2)
    return Val(strings.substring(a[0].col, a[1].col, a[2].col if len(a) > 2 else None), TEXT)


@define("replace", least=3)
def _replace(a, ctx, name):
    _text(name, a)
    return Val(strings.replace(*(x.col for x in a)), TEXT)


@define("concat", least=0, most=1000)
def _concat(a, ctx):
    return Val(F.concat_ws("", *(text_of(x) for x in a)) if a else F.lit(""), TEXT)


@define("lpad", "rpad", least=2, most=3)
def _pad(a, ctx, name):
    _text(name, a, 0, 2)
    _int(name, a, 1)
    return Val(strings.pad(a[0].col, a[1].col, a[2].col if len(a) > 2 else F.lit(" "), name == "lpad"), TEXT)


@define("left", "right", least=2)
def _ends(a, ctx, name):
    _text(name, a, 0)
    _int(name, a, 1)
    return Val((strings.left if name == "left" else strings.right)(a[0].col, a[1].col.cast("int")), TEXT)


@define("repeat", least=2)
def _repeat(a, ctx, name):
    _text(name, a, 0)
    _int(name, a, 1)
    return Val(strings.repeat(a[0].col, a[1].col.cast("int")), TEXT)


@define("strpos", least=2)
def _strpos(a, ctx, name):
    _text(name, a)
    return Val(F.when(a[1].col == "", F.when(a[0].col.isNotNull(), 1)).otherwise(F.instr(a[0].col, a[1].col)), INT4)


@define("ascii", least=1)
def _ascii(a, ctx, name):
    return Val(F.ascii(_text(name, a)[0].col), INT4)


@define("chr", least=1)
def _chr(a, ctx, name):
    _int(name, a, 0)
    return Val(strings.chr_(a[0].col), TEXT)


def _numbers(name: str, a: list[Val]) -> list[Val]:
    if not all(is_number(x.type) for x in a):
        raise _no(name, a)
    return a


@define("abs", least=1)
def _abs(a, ctx):
    return numbers.absolute(_numbers("abs", a)[0])


@define("sign", least=1)
def _sign(a, ctx):
    return numbers.sign(_numbers("sign", a)[0])


@define("mod", least=2)
def _mod(a, ctx):
    return numbers.arithmetic("mod", *_numbers("mod", a))


@define("floor", "ceil", "ceiling", "round", "trunc", least=1, most=2)
def _round(a, ctx, name):
    _numbers(name, a)
    if len(a) == 2:
        if name not in ("round", "trunc"):
            raise _no(name, a)
        _int(name, a, 1)
        return numbers.round_to(name, *a)
    return numbers.rounding("ceil" if name == "ceiling" else name, a[0])


@define("sqrt", "exp", "ln", "log", least=1)
def _math(a, ctx, name):
    return numbers.function(name, _numbers(name, a)[0])


@define("power", "pow", least=2)
def _power(a, ctx, name):
    return numbers.power(*_numbers(name, a))


@define("pi", least=0)
def _pi(a, ctx):
    return Val(F.pi(), FLOAT8)


@define("coalesce", least=1, most=1000)
def _coalesce(a, ctx):
    kind = unify([x.type for x in a])
    return Val(F.coalesce(*(cast(x, kind).col.cast(kind.spark) for x in a)), kind)


@define("greatest", "least", least=1, most=1000)
def _extreme(a, ctx, name):
    kind = unify([x.type for x in a])
    cols = [cast(x, kind).col.cast(kind.spark) for x in a]
    if kind == INTERVAL:
        keyed = [F.when(c.isNotNull(), F.struct(iv.key(c).alias("k"), c.alias("v"))) for c in cols]
        best = F.array_max(F.array(*keyed)) if name == "greatest" else F.array_min(F.filter(F.array(*keyed), lambda x: x.isNotNull()))
        return Val(best["v"], kind)
    if len(cols) == 1:
        return Val(cols[0], kind)
    return Val((F.greatest if name == "greatest" else F.least)(*cols), kind)


@define("nullif", least=2)
def _nullif(a, ctx):
    same = compare("=", a[0], a[1]).col
    kind = TEXT if a[0].type == UNKNOWN else a[0].type
    return Val(F.when(~F.coalesce(same, F.lit(False)), a[0].col), kind)


def compare(op: str, a: Val, b: Val) -> Val:
    """A comparison after the operands are brought to one type; unknown literals take the other's."""
    if not comparable(a.type, b.type):
        raise SqlError("42804", f"cannot compare {a.type} with {b.type}")
    if UNKNOWN in (a.type, b.type) and a.type != b.type:
        a, b = (cast(a, b.type), b) if a.type == UNKNOWN else (a, cast(b, a.type))
    x, y = a.col, b.col
    if INTERVAL in (a.type, b.type):
        x, y = iv.key(x), iv.key(y)
    elif a.type != b.type and not is_number(a.type):
        kind = unify([a.type, b.type])
        x, y = cast(a, kind).col, cast(b, kind).col
    elif FLOAT8 in (a.type, b.type):
        x, y = x.cast("double"), y.cast("double")
    return Val({"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op](), BOOL)


def concatenate(a: Val, b: Val) -> Val:
    if not {a.type, b.type} & {TEXT, UNKNOWN}:
        raise SqlError("42883", f"operator does not exist: {a.type} || {b.type}")
    return Val(F.concat(text_of(a), text_of(b)), TEXT)


def operate(op: str, a: Val, b: Val) -> Val:
    """``+ - * /`` for numbers and temporal types; an unknown literal takes the other's type."""
    if a.type == UNKNOWN and b.type != UNKNOWN:
        a = cast(a, INTERVAL if b.type in (DATE, TIMESTAMP, TIMESTAMPTZ, TIME) and op == "+" else b.type)
    elif b.type == UNKNOWN and a.type != UNKNOWN:
        b = cast(b, INTERVAL if a.type in (TIMESTAMP, TIMESTAMPTZ, TIME, INTERVAL) else a.type)
    found = dt.operate(op, a, b)
    return found if found is not None else numbers.arithmetic(op, a, b)


# -- date and time


def _now(ctx: Context, which: str):
    return F.lit(getattr(ctx, which)).cast("timestamp_ltz")


@define("now", "current_timestamp", "transaction_timestamp", "statement_timestamp", "clock_timestamp", least=0)
def _clock(a, ctx, name):
    if name == "clock_timestamp":
        # the JVM's clock, read for every row: ISO text in UTC
        return Val(F.java_method(F.lit("java.time.Instant"), F.lit("now")).cast("timestamp_ltz"), TIMESTAMPTZ)
    return Val(_now(ctx, "statement" if name == "statement_timestamp" else "transaction"), TIMESTAMPTZ)


@define("current_date", "current_time", "localtime", "localtimestamp", least=0)
def _local(a, ctx, name):
    local = _now(ctx, "transaction").cast("timestamp_ntz")
    if name == "current_date":
        return Val(local.cast("date"), DATE)
    return Val(local, TIMESTAMP) if name == "localtimestamp" else Val(micros_of_day(local), TIME)


@define("date_part", least=2)
def _date_part(a, ctx):
    _text("date_part", a, 0)
    return dt.date_part(a[0].literal, a[1]) if isinstance(a[0].literal, str) else dt.date_part_by(a[0].col, a[1])


@define("date_trunc", least=2, most=3)
def _date_trunc(a, ctx):
    _text("date_trunc", a, 0, 2)
    zone = a[2].col if len(a) > 2 else None
    return dt.date_trunc(a[0].literal, a[1], zone) if isinstance(a[0].literal, str) else dt.date_trunc_by(a[0].col, a[1], zone)


@define("age", least=1, most=2)
def _age(a, ctx):
    stamps = [cast(x, TIMESTAMP).col for x in a]
    if len(a) == 1:
        stamps.insert(0, _now(ctx, "transaction").cast("date").cast("timestamp_ntz"))
    return Val(dt.age(*stamps), INTERVAL)


@define("timezone", least=2)
def _timezone(a, ctx):
    v = cast(a[1], TIMESTAMPTZ) if a[1].type == UNKNOWN else a[1]
    return dt.timezone(a[0].col, v)


@define("to_char", least=2)
def _to_char(a, ctx):
    v, template = a
    if is_number(v.type):
        return Val(formatting.to_char_number(v, template), TEXT)
    if v.type not in (DATE, TIME, TIMESTAMP, TIMESTAMPTZ, INTERVAL):
        raise _no("to_char", a)
    _text("to_char", a, 1)
    made = formatting.to_char_temporal(v, template.literal) if isinstance(template.literal, str) else formatting.to_char_by(v, template.col)
    return Val(made, TEXT)


@define("to_timestamp", least=1, most=2)
def _to_timestamp(a, ctx):
    if len(a) == 1:
        return Val(formatting.from_epoch(_numbers("to_timestamp", a)[0].col), TIMESTAMPTZ)
    return Val(formatting.to_stamp(a[0].col, a[1].col).cast("timestamp_ltz"), TIMESTAMPTZ)


@define("to_date", least=2)
def _to_date(a, ctx):
    return Val(formatting.to_stamp(a[0].col, a[1].col).cast("date"), DATE)


@define("make_date", least=3)
def _make_date(a, ctx):
    return Val(dt.make_date(*(x.col for x in a)), DATE)


@define("make_time", least=3)
def _make_time(a, ctx):
    return Val(dt.make_time(*(x.col for x in a)), TIME)


@define("make_timestamp", least=6)
def _make_timestamp(a, ctx):
    return Val(dt.make_timestamp([x.col for x in a]), TIMESTAMP)


@define("make_timestamptz", least=6, most=7)
def _make_timestamptz(a, ctx):
    local = Val(dt.make_timestamp([x.col for x in a[:6]]), TIMESTAMP)
    return dt.timezone(a[6].col, local) if len(a) == 7 else cast(local, TIMESTAMPTZ)


@define("make_interval", least=0, most=7)
def _make_interval(a, ctx):
    return Val(dt.make_interval([x.col for x in a]), INTERVAL)


@define("justify_days", "justify_hours", "justify_interval", least=1)
def _justify(a, ctx, name):
    return Val(getattr(iv, name)(cast(a[0], INTERVAL).col), INTERVAL)


AGGREGATES = {"count", "sum", "avg", "min", "max"}

__all__ = ["AGGREGATES", "Context", "FUNCTIONS", "PgType", "compare", "concatenate", "fail", "operate"]
