"""``to_char``, ``to_date`` and ``to_timestamp``: templates are compiled to column expressions.

Dates, timestamps and intervals become a concatenation of pieces, exact numbers a layout of digits, blanks and marks.
Where the template is no constant, and for doubles, each distinct template of an Arrow batch is compiled once.
"""

from __future__ import annotations

import datetime as dt
import decimal
import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SqlError
from ..types import DATE, FLOAT8, INTERVAL, TIMESTAMPTZ, TIME, Val, numeric_of
from .casts import micros_of_day, zone_minutes
from .datetime import epoch_micros
from .interval import let

# Month and day names, Roman numerals, and template patterns, longest first where one begins another.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
PATTERNS = (
    "SSSSS SSSS Y,YYY YYYY IYYY IDDD MONTH Month month HH24 HH12 A.D. a.d. B.C. b.c. A.M. a.m. P.M. p.m. "
    "YYY IYY DDD DAY Day day MON Mon mon FF1 FF2 FF3 FF4 FF5 FF6 TZH TZM YY IY ID IW CC AD ad BC bc MM RM rm DD DY Dy dy WW HH MI SS MS US AM am PM pm OF TZ tz Y I D W Q"
).split()


@dataclass(frozen=True)
class Piece:
    pattern: str | None  # None: literal text
    text: str = ""
    fill: bool = True  # False: FM
    ordinal: str = ""


def compile_template(template: str) -> list[Piece]:
    out: list[Piece] = []
    at, fill = 0, True
    while at < len(template):
        if template.startswith("FM", at) or template.startswith("fm", at):
            fill, at = False, at + 2
            continue
        if template[at] == '"':
            end = template.find('"', at + 1)
            end = len(template) if end < 0 else end
            out.append(Piece(None, template[at + 1 : end]))
            at = end + 1
            continue
        found = next((p for p in PATTERNS if template.startswith(p, at)), None)
        if found is None:
            out.append(Piece(None, template[at]))
            at += 1
            continue
        at += len(found)
        ordinal = template[at : at + 2] if template[at : at + 2] in ("TH", "th") else ""
        at += len(ordinal)
        out.append(Piece(found, "", fill, ordinal))
        fill = True
    return out


class _Lazy(dict):
    """Columns by name, each made when it is first asked for."""

    def __missing__(self, name: str) -> Column | None:
        return self.setdefault(name, self.makers[name]())

    def __init__(self, makers: dict[str, Callable[[], Column | None]]):
        super().__init__()
        self.makers = makers


def _fields(v: Val) -> _Lazy:
    names = ("year", "month", "day", "isoyear", "isoweek", "isodow", "dow", "doy")
    makers: dict[str, Callable[[], Column | None]] = dict.fromkeys(names, lambda: F.lit(0)) | {"offset": lambda: None}
    if v.type == INTERVAL:
        months, micros = v.col["months"], v.col["micros"]
        makers |= {"year": lambda: F.call_function("div", months, F.lit(12)), "month": lambda: months % 12, "day": lambda: v.col["days"]}
        hours = F.call_function("div", micros, F.lit(3_600_000_000))
    elif v.type == TIME:
        micros, hours = v.col, F.floor(v.col / 3_600_000_000)
    else:
        local = v.col.cast("timestamp_ntz")
        micros = micros_of_day(local)
        hours = F.floor(micros / 3_600_000_000)
        makers |= {
            "year": lambda: F.year(local), "month": lambda: F.month(local), "day": lambda: F.dayofmonth(local), "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), local), "isoweek": lambda: F.weekofyear(local),
            "isodow": lambda: F.weekday(local) + 1, "dow": lambda: F.dayofweek(local) - 1, "doy": lambda: F.dayofyear(local), "offset": lambda: zone_minutes(v.col) if v.type == TIMESTAMPTZ else None,
        }
    rest = F.abs(micros) % 3_600_000_000
    out = _Lazy(makers)
    makers |= {"hour": lambda: hours, "minute": lambda: F.floor(rest / 60_000_000), "second": lambda: F.floor(rest % 60_000_000 / 1_000_000), "micro": lambda: rest % 1_000_000, "quarter": lambda: F.floor((out["month"] - 1) / 3) + 1}
    return out


def _zeros(value: Column, width: int) -> Column:
    """An integer with zeros up to ``width``; a longer one whole."""
    digits = value.cast("string")
    return F.when((value >= 0) & (value < 10**width), F.lpad(digits, width, "0")).when(value >= 0, digits).otherwise(F.format_string(f"%0{width}d", value.cast("long")))


def _number(value: Column, width: int, fill: bool) -> Column:
    value = value.cast("long")
    return _zeros(value, width) if fill and width > 1 else value.cast("string")


def _cased(names: tuple[str, ...], index: Column, pattern: str, short: int | None, width: int) -> Column:
    shown = [n[:short] if short else n for n in names]
    if pattern.isupper():
        shown = [n.upper() for n in shown]
    elif pattern.islower():
        shown = [n.lower() for n in shown]
    if width:
        shown = [n.ljust(width) for n in shown]
    return F.element_at(F.array(*map(F.lit, shown)), index.cast("int"))


def _piece(p: Piece, f: dict[str, Column]) -> Column:
    name, fill = p.pattern, p.fill
    if name in ("YYYY", "YYY", "YY", "Y", "IYYY", "IYY", "IY", "I"):
        year = f["isoyear"] if name[0] == "I" else f["year"]
        width = len(name)
        return _number(year if width == 4 else F.pmod(year, F.lit(10**width)), width, fill)
    if name == "Y,YYY":
        return F.format_string("%d,%03d", F.floor(f["year"] / 1000).cast("long"), (f["year"] % 1000).cast("long"))
    simple = {
        "IDDD": ((f["isoweek"] - 1) * 7 + f["isodow"], 3), "ID": (f["isodow"], 1), "IW": (f["isoweek"], 2), "CC": (F.ceil(f["year"] / 100), 2), "MM": (f["month"], 2), "DDD": (f["doy"], 3), "DD": (f["day"], 2), "D": (f["dow"] + 1, 1),
        "WW": (F.floor((f["doy"] - 1) / 7) + 1, 2), "W": (F.floor((f["day"] - 1) / 7) + 1, 1), "Q": (f["quarter"], 1), "HH24": (f["hour"], 2), "HH12": (F.pmod(f["hour"] + 11, F.lit(12)) + 1, 2), "HH": (F.pmod(f["hour"] + 11, F.lit(12)) + 1, 2),
        "MI": (f["minute"], 2), "SS": (f["second"], 2), "SSSS": (f["hour"] * 3600 + f["minute"] * 60 + f["second"], 1), "SSSSS": (f["hour"] * 3600 + f["minute"] * 60 + f["second"], 1), "MS": (F.floor(f["micro"] / 1000), 3), "US": (f["micro"], 6),
    }
    if name in simple:
        return _number(*simple[name], fill)
    if name[:2] == "FF":
        width = int(name[2])
        return _zeros(F.floor(f["micro"] / 10 ** (6 - width)).cast("long"), width)
    if name.lower() in ("month", "mon"):
        return _cased(MONTHS, f["month"], name, 3 if len(name) == 3 else None, 9 if fill and len(name) == 5 else 0)
    if name.lower() in ("day", "dy"):
        return _cased(DAYS, f["dow"] + 1, name, 3 if len(name) == 2 else None, 9 if fill and len(name) == 3 else 0)
    if name.lower() == "rm":
        return _cased(ROMAN, f["month"], name, None, 4 if fill else 0)
    plain = name.replace(".", "").upper()
    if plain in ("AD", "BC", "AM", "PM"):
        pair = ("AD", "BC") if plain in ("AD", "BC") else ("AM", "PM")
        if "." in name:
            pair = tuple(f"{x[0]}.{x[1]}." for x in pair)
        if name.islower():
            pair = tuple(x.lower() for x in pair)
        first = f["year"] >= 0 if plain in ("AD", "BC") else F.pmod(f["hour"], F.lit(24)) < 12
        return F.when(first, F.lit(pair[0])).otherwise(F.lit(pair[1]))
    offset = f["offset"]
    if offset is None:
        return F.lit("")
    sign, hours, minutes = F.when(offset < 0, F.lit("-")).otherwise(F.lit("+")), F.floor(F.abs(offset) / 60).cast("long"), (F.abs(offset) % 60).cast("long")
    if name == "TZM":
        return F.format_string("%02d", minutes)
    base = F.concat(sign, F.format_string("%02d", hours))
    return base if name == "TZH" else F.concat(base, F.when(minutes != 0, F.format_string(":%02d", minutes)).otherwise(F.lit("")))


def _ordinal(number: Column, case: str) -> Column:
    tail = F.pmod(F.regexp_replace(number, r"[^0-9]", "").cast("long"), F.lit(100))
    suffix = F.when(tail.between(11, 13), "th").when(tail % 10 == 1, "st").when(tail % 10 == 2, "nd").when(tail % 10 == 3, "rd").otherwise("th")
    return F.upper(suffix) if case == "TH" else suffix


def to_char_temporal(v: Val, template: str) -> Column:
    return let(v.col, lambda x: _to_char_temporal(Val(x, v.type), template))


def _to_char_temporal(v: Val, template: str) -> Column:
    f = _fields(v)
    parts = []
    for p in compile_template(template):
        if p.pattern is None:
            parts.append(F.lit(p.text))
            continue
        shown = _piece(p, f)
        parts.append(F.concat(shown, _ordinal(shown, p.ordinal)) if p.ordinal else shown)
    return F.when(v.col.isNotNull(), F.concat(*parts) if parts else F.lit(""))


def to_char_by(v: Val, template: Column) -> Column:
    """``to_char`` by a template that is no constant: all values a pattern may stand for are made once as columns, and
    each row's template picks among them in Arrow batches, compiled once for each distinct one."""
    names = {(pattern, fill): f"p{2 * i + fill}" for i, pattern in enumerate(PATTERNS) for fill in (True, False)}

    def pieces(x: Column) -> Column:
        fields = _fields(Val(x, v.type))
        return F.struct(*(_piece(Piece(pattern, "", fill), fields).alias(name) for (pattern, fill), name in names.items()))

    @F.pandas_udf("string")
    def run(values: pd.DataFrame, templates: pd.Series) -> pd.Series:
        columns = {key: values[name].tolist() for key, name in names.items()}
        out = []
        for i, t in enumerate(templates):
            if t is None:
                out.append(None)
                continue
            parts = []
            for p in _compiled(t):
                text = p.text if p.pattern is None else columns[p.pattern, p.fill][i]
                parts.append(text + (_suffix(text, p.ordinal) if p.ordinal and p.pattern else ""))
            out.append("".join(parts))
        return pd.Series(out, dtype=object)

    return F.when(v.col.isNotNull(), run(let(v.col, pieces), template))


@functools.lru_cache(maxsize=256)
def _compiled(template: str) -> list[Piece]:
    return compile_template(template)


def _suffix(number: str, case: str) -> str:
    n = int("".join(c for c in number if c.isdigit()) or 0) % 100
    suffix = "th" if 11 <= n <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return suffix.upper() if case == "TH" else suffix


# -- numbers


@dataclass
class NumberTemplate:
    """A template's slots and marks.

    A layout is built from the left: every slot is a digit, a blank, or a mark; a floating sign stands right before the
    first thing shown.
    """

    whole: list[str] = field(default_factory=list)  # "9", "0" or ","
    fraction: list[str] = field(default_factory=list)
    point: bool = False
    shift: int = 0
    sign: str = ""  # "", "S<", "S>", "MI<", "MI>", "PL<", "PL>", "SG<", "SG>", "PR"
    money: str = ""  # "", "<" or ">"
    fill: bool = True
    ordinal: str = ""

    _TOKEN = re.compile(r"(?i)FM|MI|PL|SG|PR|TH|[90.,DGSLVB$]|\"[^\"]*\"?|.", re.S)

    @classmethod
    @functools.lru_cache(maxsize=256)
    def parse(cls, template: str) -> NumberTemplate:
        t = cls()
        shifting = False
        for token in cls._TOKEN.findall(template):
            name = token.upper()
            begun = bool(t.whole or t.fraction or t.point)
            if name in ("9", "0"):
                if t.point:
                    t.fraction.append(name)
                else:
                    t.whole.append(name)
                    t.shift += shifting
            elif name in (",", "G"):
                if not t.point:
                    t.whole.append(",")
            elif name in (".", "D"):
                if t.point:
                    raise SqlError("42601", "multiple decimal points")
                t.point = True
            elif name == "V":
                shifting = True
            elif name in ("S", "MI", "PL", "SG"):
                t.sign = name + (">" if begun else "<")
            elif name == "PR":
                t.sign = "PR"
            elif name in ("L", "$"):
                t.money = ">" if begun else "<"
            elif name == "FM":
                t.fill = False
            elif name == "TH":
                t.ordinal = token
        return t

    def _digits(self, value: Decimal) -> tuple[str, str, bool]:
        """Digits before and after the point, and whether they fit."""
        places = len(self.fraction)
        with decimal.localcontext() as ctx:
            ctx.prec = 400  # a double has up to 309 digits before the point
            shown = abs(value.scaleb(self.shift)).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP)
        before, _, after = f"{shown:f}".partition(".")
        before = before.lstrip("0")
        room = sum(c != "," for c in self.whole)
        return before, after, len(before) <= room and bool(room)

    def _whole(self, digits: str) -> str:
        """The slots before the point, blanks included."""
        slots = [c for c in self.whole if c != ","]
        force = slots.index("0") if "0" in slots else len(slots)
        first = min(len(slots) - len(digits), force)
        if first == len(slots) and slots and not self.fraction:
            first -= 1  # a lone zero shows where there is no fraction
        padded = digits.rjust(len(slots), "0")
        out, i = [], 0
        for c in self.whole:
            if c == ",":
                out.append("," if i > first else " ")
            else:
                out.append(padded[i] if i >= first else " ")
                i += 1
        return "".join(out)

    def format(self, value: Decimal) -> str:
        before, after, fits = self._digits(value)
        negative = value < 0 and (not fits or bool(before.strip("0") or after.strip("0")))
        if fits:
            body = self._whole(before)
        else:
            body = "".join("," if c == "," else "#" for c in self.whole)
            after = "#" * len(self.fraction)
        tail = ("." if self.point else "") + after
        if not self.fill:
            body = body.replace(" ", "")
            if fits:
                keep = max((i + 1 for i, c in enumerate(self.fraction) if c == "0"), default=0)
                stripped = after.rstrip("0")
                tail = ("." if self.point else "") + after[: max(len(stripped), keep)]
        number = body + tail
        lead = len(number) - len(number.lstrip(" "))
        if self.sign in ("S<", ""):
            mark = "-" if negative else "+" if self.sign else " " if self.fill else ""
            number = " " * lead + mark + number[lead:]
        elif self.sign == "S>":
            number += "-" if negative else "+"
        elif self.sign[:2] == "MI":
            mark = "-" if negative else " " if self.fill else ""
            number = mark + number if self.sign[2] == "<" else number + mark
        elif self.sign[:2] == "SG":
            mark = "-" if negative else "+"
            number = mark + number if self.sign[2] == "<" else number + mark
        elif self.sign[:2] == "PL":
            inner = " " * lead + ("-" if negative else " " if self.fill else "") + number[lead:]
            mark = " " if negative and self.fill else "" if negative else "+"
            number = mark + inner if self.sign[2] == "<" else inner + mark
        elif self.sign == "PR":
            opened, closed = ("<", ">") if negative else (" ", " ") if self.fill else ("", "")
            number = " " * lead + opened + number[lead:] + closed
        if self.money:
            number = "$" + number if self.money == "<" else number + "$"
        if self.ordinal and fits and not negative:
            n = int(before or "0") % 100
            suffix = "th" if 11 <= n <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
            number += suffix.upper() if self.ordinal == "TH" else suffix
        return number


    def columns(self, value: Column, kind: T.DecimalType) -> Column | None:
        """The same layout as a column expression; None where a decimal has no room for the digits."""
        places, before_point = len(self.fraction), kind.precision - kind.scale + self.shift + 1
        if before_point + max(places, kind.scale) > 38:
            return None
        wide = T.DecimalType(before_point + max(places, kind.scale), max(places, kind.scale))  # no wider than need be: up to 18 digits are a long
        shown = F.round(F.abs(value).cast(wide) * F.lit(10**self.shift).cast(T.DecimalType(self.shift + 1, 0)) if self.shift else F.abs(value).cast(wide), places).cast(T.DecimalType(before_point + places, places))
        digits = shown.cast("string")
        before = F.ltrim(F.substring_index(digits, ".", 1), F.lit("0"))
        after = F.substring_index(digits, ".", -1) if places else F.lit("")
        return self._layout(before, after, value < 0, shown != 0)

    def _layout(self, before: Column, after: Column, below: Column, some: Column) -> Column:
        places = len(self.fraction)
        slots = [c for c in self.whole if c != ","]
        width, size = len(slots), F.length(before)
        fits = (size <= width) & F.lit(bool(width))
        negative = below & (~fits | some)
        force = slots.index("0") if "0" in slots else width
        first = F.least(width - size, F.lit(force))
        if slots and not self.fraction and force == width:
            first = F.least(first, F.lit(width - 1))  # a lone zero shows where there is no fraction
        padded = F.lpad(before, width, "0")
        parts, blanks, at, run = [], [], 0, 0
        for c in [*self.whole, ""]:
            if c in (",", ""):
                parts += ([F.substring(padded, at - run + 1, run)] if run else []) + ([F.lit(",")] if c else [])
                run = 0
            else:
                at, run = at + 1, run + 1
        for n in range(width + 1):  # blanks if the first n slots are
            seen, count = 0, 0
            for c in self.whole:
                count += seen <= n if c == "," else seen < n
                seen += c != ","
            blanks.append(count)
        lead = F.when(fits, F.element_at(F.array(*map(F.lit, blanks)), F.greatest(first, F.lit(0)) + 1)).otherwise(0)
        body = F.concat(*parts) if parts else F.lit("")
        body = F.when(fits, F.substring(body, lead + 1, F.lit(len(self.whole)))).otherwise(F.lit("".join("," if c == "," else "#" for c in self.whole)))
        tail = F.when(fits, after).otherwise(F.lit("#" * places))
        if not self.fill:
            keep = max((i + 1 for i, c in enumerate(self.fraction) if c == "0"), default=0)
            trimmed = F.rtrim(after, F.lit("0"))
            tail = F.when(fits, F.substring(after, F.lit(1), F.greatest(F.length(trimmed), F.lit(keep)))).otherwise(tail)
        spaces = F.repeat(F.lit(" "), lead) if self.fill else F.lit("")
        core = F.concat(body, F.lit("." if self.point else ""), tail)

        def mark(yes: str, no: str) -> Column:
            return F.when(negative, F.lit(yes)).otherwise(F.lit(no))

        blank = " " if self.fill else ""
        side = self.sign[-1:]
        if self.sign in ("", "S<"):
            out = F.concat(spaces, mark("-", "+" if self.sign else blank), core)
        elif self.sign == "PR":
            out = F.concat(spaces, mark("<", blank), core, mark(">", blank))
        elif self.sign[:2] == "PL":
            inner = F.concat(spaces, mark("-", blank), core)
            plus = mark(blank, "+")
            out = F.concat(plus, inner) if side == "<" else F.concat(inner, plus)
        else:
            sign = mark("-", "+" if self.sign[0] == "S" else blank)
            out = F.concat(sign, spaces, core) if side == "<" else F.concat(spaces, core, sign)
        if self.money:
            out = F.concat(F.lit("$"), out) if self.money == "<" else F.concat(out, F.lit("$"))
        if self.ordinal:
            out = F.when(fits & ~negative, F.concat(out, _ordinal(F.concat(F.lit("0"), before), self.ordinal))).otherwise(out)
        return out


def to_char_number(v: Val, template: Val) -> Column:
    """A constant template becomes a column expression; one that is none, and doubles, go in Arrow batches."""
    if isinstance(template.literal, str) and v.type != FLOAT8:
        exact = numeric_of(v)
        made = NumberTemplate.parse(template.literal).columns(exact.col, exact.type.spark)
        if made is not None:
            return F.when(v.col.isNotNull(), made)
    as_text = v.col.cast("string")

    @F.pandas_udf("string")
    def run(values: pd.Series, templates: pd.Series) -> pd.Series:
        out = []
        for value, template in zip(values, templates, strict=True):
            if value is None or template is None:
                out.append(None)
            elif value in ("NaN", "Infinity", "-Infinity"):
                out.append(value)
            else:
                out.append(NumberTemplate.parse(template).format(Decimal(value)))
        return pd.Series(out, dtype=object)

    return run(as_text, template.col)


# -- parsing

_WIDTHS = {"Y,YYY": 5, "YYYY": 4, "YYY": 3, "YY": 2, "Y": 1, "MM": 2, "DD": 2, "DDD": 3, "HH24": 2, "HH12": 2, "HH": 2, "MI": 2, "SS": 2, "MS": 3, "US": 6}


def parse_stamp(text: str, template: str) -> dt.datetime:
    """A timestamp from text by a template; 22007 for a bad shape, 22008 for a value out of range."""
    got = {"year": 1, "month": 1, "day": 1, "hour": 0, "minute": 0, "second": 0, "micro": 0}
    half, at = None, 0

    def bad() -> SqlError:
        return SqlError("22007", f'invalid value "{text[at:]}" for the template "{template}"')

    def name_of(names: tuple[str, ...], short: bool) -> int:
        nonlocal at
        for i, n in enumerate(names):
            n = n[:3] if short else n
            if text[at : at + len(n)].lower() == n.lower():
                at += len(n)
                return i
        raise bad()

    for p in compile_template(template):
        if p.pattern is None:
            for c in p.text:
                if at < len(text) and (text[at] == c or not c.isalnum() and not text[at].isalnum()):
                    at += 1
            continue
        while at < len(text) and text[at] == " ":
            at += 1
        low = p.pattern.lower()
        if low in ("month", "mon"):
            got["month"] = name_of(MONTHS, low == "mon") + 1
        elif low in ("day", "dy"):
            name_of(DAYS, low == "dy")
        elif low.replace(".", "") in ("am", "pm"):
            m = re.compile(r"([ap])\.?m\.?", re.I).match(text, at)
            if not m:
                raise bad()
            half, at = m[1].lower(), m.end()
        elif p.pattern in _WIDTHS:
            m = re.compile(r"[+-]?\d{1,%d}" % _WIDTHS[p.pattern]).match(text, at)
            if not m:
                raise bad()
            at = m.end()
            n = int(m[0])
            digits = len(m[0].lstrip("+-"))
            part = {"Y": "year", "M": "month", "D": "day", "H": "hour", "S": "second", "U": "micro"}[p.pattern[0]]
            part = {"MI": "minute", "MS": "micro"}.get(p.pattern, part)
            got[part] = n * 10 ** (6 - digits) if part == "micro" else n
            if p.pattern in ("HH", "HH12"):
                half = half or ""
        else:
            raise SqlError("0A000", f'template pattern "{p.pattern}" is not read')
    if half:
        if not 1 <= got["hour"] <= 12:
            raise SqlError("22008", "hour is out of range for a 12-hour clock")
        got["hour"] = got["hour"] % 12 + (12 if half == "p" else 0)
    try:
        return dt.datetime(got["year"], got["month"], got["day"], got["hour"], got["minute"], got["second"], got["micro"])
    except ValueError as e:
        raise SqlError("22008", f'date/time field value out of range: "{text}"') from e


def to_stamp(text: Column, template: Column) -> Column:
    """A timestamp without zone, in Arrow batches."""

    @F.pandas_udf("long")
    def run(values: pd.Series, templates: pd.Series) -> pd.Series:
        first = dt.datetime(1970, 1, 1)
        one = dt.timedelta(microseconds=1)
        return pd.Series([None if a is None or b is None else (parse_stamp(a, b) - first) // one for a, b in zip(values, templates, strict=True)], dtype="Int64")

    return F.timestamp_add("MICROSECOND", run(text, template), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros(F.rint(seconds.cast("double") * 1_000_000).cast("long"))


__all__ = ["DATE", "NumberTemplate", "compile_template", "epoch_micros", "from_epoch", "parse_stamp", "to_char_number", "to_char_temporal", "to_stamp"]
