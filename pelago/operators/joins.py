"""Joins: conditions stay declarative, so Catalyst finds equi-keys and picks the strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SqlError
from ..functions.casts import cast
from ..functions.registry import compare
from ..types import Val, unify
from .relation import Binding, Relation, fresh

_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross"}

#: Rows of a key that ``join_pairs`` keeps together; the square of it is what a task makes from one of its rows.
BLOCK = 256


def merged_scope(left: Relation, right: Relation) -> tuple[Binding, ...]:
    both = {b.table for b in left.scope if b.table} & {b.table for b in right.scope if b.table}
    if both:
        raise SqlError("42712", f'table name "{sorted(both)[0]}" specified more than once')
    return left.scope + right.scope


def join_on(kind: str, left: Relation, right: Relation, condition: Column | None) -> Relation:
    scope = merged_scope(left, right)
    if condition is None:
        return Relation(left.df.crossJoin(right.df), scope)
    return Relation(left.df.join(right.df, condition, _HOW[kind]), scope)


def _blocks(r: Relation, keys: list[str], by: str) -> DataFrame:
    """The rows of each key in the order of ``by``, up to BLOCK in a row: an array for each column, so that those that
    nothing reads can be pruned.  Rows that equal or precede nothing are left out."""
    named = [f"{by}_key{i}" for i in range(len(keys))]
    df = r.df.select("*", *(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)))
    for n in (*named, by):
        df = df.where(F.col(n).isNotNull())
    place = F.row_number().over(Window.partitionBy(*named).orderBy(by))
    others = [F.collect_list(F.struct(F.col(b.column).alias("v"))).alias(b.column) for b in r.scope if b.column != by]  # structs: lists skip nulls
    df = df.withColumn(f"{by}_block", F.floor((place - 1) / BLOCK)).groupBy(*named, f"{by}_block")
    return df.agg(F.min(by).alias(f"{by}_low"), F.max(by).alias(f"{by}_high"), F.collect_list(by).alias(by), *others)


def join_pairs(left: Relation, right: Relation, keys: list[tuple[Binding, Binding]], op: str, a: Binding, b: Binding, partitions: int) -> Relation:
    """An inner join by equal ``keys`` and ``a`` < ``b`` (or what ``op`` is), for few keys with many rows each.

    A join by keys alone has a key's pairs made by one task, and makes those that the order refuses too.  Here blocks of
    rows meet, unless the order refuses all of their pairs, and pairs of blocks are dealt to tasks evenly.
    """
    scope = merged_scope(left, right)
    blocks = _blocks(left, [x.column for x, _ in keys], a.column), _blocks(right, [y.column for _, y in keys], b.column)
    least, most = ("low", "high") if op in ("<", "<=") else ("high", "low")
    meet = compare(op, Val(F.col(f"{a.column}_{least}"), a.type), Val(F.col(f"{b.column}_{most}"), b.type)).col
    same = [f"{a.column}_key{i}" for i in range(len(keys))]
    for i, k in enumerate(same):
        meet = meet & (F.col(k) == F.col(f"{b.column}_key{i}"))
    df = blocks[0].join(blocks[1], meet).repartition(partitions, *same, f"{a.column}_block", f"{b.column}_block")
    for x in (a, b):
        df = df.select("*", F.posexplode(x.column).alias(f"{x.column}_at", f"{x.column}_v"))
    df = df.where(compare(op, Val(F.col(f"{a.column}_v"), a.type), Val(F.col(f"{b.column}_v"), b.type)).col)
    columns = [F.col(f"{x.column}_v") if y is x else F.get(y.column, F.col(f"{x.column}_at")).getField("v") for x, side in ((a, left), (b, right)) for y in (x if z.column == x.column else z for z in side.scope)]
    return Relation(df.select(*(c.alias(y.column) for c, y in zip(columns, scope, strict=True))), scope)


def join_using(kind: str, left: Relation, right: Relation, names: tuple[str, ...]) -> Relation:
    """Each named column once and first, as the left value or else the right one; the sides' own stay reachable by
    their qualifiers."""
    merged_scope(left, right)
    condition, merged, used = F.lit(True), [], set()
    for name in names:
        a, b = left.resolve(name, None), right.resolve(name, None)
        kind_of = unify([a.type, b.type])
        condition = compare("=", a.val, b.val).col if not used else condition & compare("=", a.val, b.val).col
        both = F.coalesce(cast(a.val, kind_of).col.cast(kind_of.spark), cast(b.val, kind_of).col.cast(kind_of.spark))
        merged.append((Binding(None, name, kind_of, fresh()), both))
        used |= {a.column, b.column}
    df = left.df.join(right.df, condition, _HOW[kind])
    sides = left.scope + right.scope
    df = df.select(*(c.alias(b.column) for b, c in merged), *(F.col(b.column) for b in sides))
    scope = [b for b, _ in merged] + [Binding(b.table, b.name, b.type, b.column, b.hidden or b.column in used) for b in sides]
    return Relation(df, tuple(scope))


def join_natural(kind: str, left: Relation, right: Relation) -> Relation:
    """USING over the common names in the left side's order; without any, every pair."""
    have = {b.name for b in right.shown}
    names = tuple(b.name for b in left.shown if b.name in have)
    if not names:
        return join_on(kind, left, right, None if kind == "inner" else F.lit(True))
    return join_using(kind, left, right, names)
