"""Uncorrelated subqueries in expressions; Spark plans each once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SqlError
from ..functions import interval as iv
from ..functions.casts import cast
from ..functions.registry import compare
from ..types import BOOL, INTERVAL, UNKNOWN, PgType, Val
from .relation import Relation


def _only(r: Relation):
    if len(r.shown) != 1:
        raise SqlError("42601", "subquery must return only one column")
    return r.shown[0]


def scalar(r: Relation) -> Val:
    """The value of a one-column query; null without rows, 21000 with several."""
    b = _only(r)
    return Val(r.df.select(b.column).scalar(), b.type)


def exists(r: Relation) -> Val:
    return Val(r.df.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar() > 0, BOOL)


def _summary(r: Relation, column: Column, **more: Column) -> Column:
    """One row about a subquery's values, as a struct."""
    parts = {"c": F.count(F.lit(1)), "nn": F.count(column), **more}
    return r.df.agg(F.struct(*(v.alias(k) for k, v in parts.items())).alias("s")).scalar()


def matched(a: Val, r: Relation) -> tuple[Val, Val]:
    """``a`` and the subquery's column as operands of one comparison; intervals as their canonical lengths."""
    b = Val(F.col(_only(r).column), _only(r).type)
    if UNKNOWN in (a.type, b.type) and a.type != b.type:
        a, b = (cast(a, b.type), b) if a.type == UNKNOWN else (a, cast(b, a.type))
    compare("=", a, b)  # the types must match
    if INTERVAL in (a.type, b.type):
        length = PgType("numeric", 38, 0)
        return Val(iv.key(a.col), length), Val(iv.key(b.col), length)
    return a, b


def never_null(a: Val, r: Relation) -> Column:
    """Whether ``a NOT IN (r)`` is true for an ``a`` that equals no value of ``r``."""
    a, b = matched(a, r)
    s = _summary(r, b.col)
    return (s["c"] == 0) | (a.col.isNotNull() & (s["nn"] == s["c"]))


def member(a: Val, r: Relation, negated: bool, semi: Column) -> Val:
    """``a [NOT] IN (r)`` in three-valued logic, given whether an equal value exists."""
    a, b = matched(a, r)
    s = _summary(r, b.col)
    unknown = a.col.isNull() | (s["nn"] < s["c"])
    value = F.when(semi, True).when(s["c"] == 0, False).when(unknown, F.lit(None).cast("boolean")).otherwise(False)
    return Val(~value if negated else value, BOOL)


def quantified(a: Val, op: str, every: bool, r: Relation) -> Val:
    """``a op ANY (r)`` and ``a op ALL (r)`` from the count, the count of non-nulls, the minimum and the maximum."""
    a, b = matched(a, r)
    s = _summary(r, b.col, mn=F.min(b.col), mx=F.max(b.col))
    low, high = Val(s["mn"], b.type), Val(s["mx"], b.type)

    def is_(op: str, v: Val) -> Column:
        return compare(op, a, v).col

    if every:
        bad = {">": lambda: is_("<=", high), ">=": lambda: is_("<", high), "<": lambda: is_(">=", low), "<=": lambda: is_(">", low), "=": lambda: is_("<>", low) | is_("<>", high)}[op]()
        return Val(F.when(s["c"] == 0, True).when(a.col.isNull(), F.lit(None).cast("boolean")).when(F.coalesce(bad, F.lit(False)), False).when(s["nn"] < s["c"], F.lit(None).cast("boolean")).otherwise(True), BOOL)
    good = {">": lambda: is_(">", low), ">=": lambda: is_(">=", low), "<": lambda: is_("<", high), "<=": lambda: is_("<=", high), "<>": lambda: is_("<>", low) | is_("<>", high)}[op]()
    return Val(F.when(s["c"] == 0, False).when(a.col.isNull(), F.lit(None).cast("boolean")).when(F.coalesce(good, F.lit(False)), True).when(s["nn"] < s["c"], F.lit(None).cast("boolean")).otherwise(False), BOOL)
