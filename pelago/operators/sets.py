"""UNION, INTERSECT and EXCEPT, each with and without ALL."""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..errors import SqlError
from ..functions import interval as iv
from ..functions.casts import cast
from ..types import INTERVAL, UNKNOWN, PgType, Val, unify
from .relation import Binding, Relation, distinct, fresh


def as_types(r: Relation, kinds: list[PgType], names: list[str]) -> Relation:
    """The relation's columns cast to ``kinds``."""
    scope = tuple(Binding(None, n, k, fresh()) for n, k in zip(names, kinds, strict=True))
    cols = [cast(b.val, k).col.cast(k.spark).alias(s.column) for b, k, s in zip(r.shown, kinds, scope, strict=True)]
    return Relation(r.df.select(*cols), scope)


def combine(op: str, every: bool, left: Relation, right: Relation) -> Relation:
    """Names come from the left side, types from both; nulls are equal."""
    if len(left.shown) != len(right.shown):
        raise SqlError("42601", f"each {op.upper()} query must have the same number of columns")
    kinds = [unify([a.type, b.type]) for a, b in zip(left.shown, right.shown, strict=True)]
    kinds = [UNKNOWN if a.type == b.type == UNKNOWN else k for a, b, k in zip(left.shown, right.shown, kinds, strict=True)]
    names = [b.name for b in left.shown]
    a, b = as_types(left, kinds, names), as_types(right, kinds, names)
    b = Relation(b.df.toDF(*a.df.columns), a.scope)
    if op == "union":
        both = Relation(a.df.union(b.df), a.scope)
        return both if every else distinct(both)
    if INTERVAL in kinds:
        return _by_length(op, every, a, b)
    if op == "intersect":
        return Relation(a.df.intersectAll(b.df) if every else a.df.intersect(b.df), a.scope)
    return Relation(a.df.exceptAll(b.df) if every else a.df.subtract(b.df), a.scope)


def _by_length(op: str, every: bool, a: Relation, b: Relation) -> Relation:
    """INTERSECT and EXCEPT of rows with intervals, which are equal by their canonical length; the left side's parts show.

    Both sides are counted by key first (and on the left by the parts), so no key's rows are gathered in one task."""
    names = [x.column for x in a.scope]

    def keyed(r: Relation):
        return r.df.select(*(F.col(c) for c in names), *((iv.key(F.col(c)) if x.type == INTERVAL else F.col(c)).alias(f"{c}_k") for c, x in zip(names, a.scope, strict=True)))

    keys = [f"{c}_k" for c in names]
    other, there = [fresh() for _ in keys], fresh()
    right = keyed(b).groupBy(*keys).agg(F.count(F.lit(1)).alias(there)).select(*(F.col(k).alias(o) for k, o in zip(keys, other, strict=True)), there)
    same = F.lit(True)
    for k, o in zip(keys, other, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(o))
    if not every:
        left = keyed(distinct(a))
        return Relation(left.join(right, same, "left_semi" if op == "intersect" else "left_anti").select(*names), a.scope)
    n, before = fresh(), fresh()
    earlier = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    left = keyed(a).groupBy(*keys, *names).agg(F.count(F.lit(1)).alias(n)).withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    shared = F.least(F.col(n), F.greatest(F.coalesce(F.col(there), F.lit(0)) - F.col(before), F.lit(0)))
    kept = (shared if op == "intersect" else F.col(n) - shared).cast("int")
    rows = left.join(right, same, "left").withColumn(n, kept).where(F.col(n) > 0)
    return Relation(rows.select(*names, F.explode(F.sequence(F.lit(1), F.col(n))).alias(before)).select(*names), a.scope)


def values(one_row, rows: list[list[Val]], apart: bool = False) -> Relation:
    """Rows of expressions as ``column1, column2, ...``, without a trip through the driver's memory.  Rows with subqueries
    stand ``apart``, each a projection of its own."""
    width = {len(r) for r in rows}
    if len(width) != 1:
        raise SqlError("42601", "VALUES lists must all be the same length")
    kinds = [unify([r[i].type for r in rows]) for i in range(width.pop())]
    kinds = [UNKNOWN if all(r[i].type == UNKNOWN for r in rows) else k for i, k in enumerate(kinds)]
    scope = tuple(Binding(None, f"column{i + 1}", k, fresh()) for i, k in enumerate(kinds))
    made = [[cast(v, k).col.cast(k.spark).alias(b.column) for v, k, b in zip(r, kinds, scope, strict=True)] for r in rows]
    if apart:
        return Relation(functools.reduce(lambda a, b: a.union(b), (one_row.select(*r) for r in made)), scope)
    return Relation(one_row.select(F.inline(F.array(*(F.struct(*r) for r in made)))), scope)


def known(r: Relation) -> Relation:
    """Literals that nothing gave a type are text."""
    return Relation(r.df, tuple(replace(b, type=PgType("text")) if b.type == UNKNOWN else b for b in r.scope))
