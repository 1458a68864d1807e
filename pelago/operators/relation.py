"""Relations: a DataFrame whose columns have unique internal names, and the scope that maps SQL names to them."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SqlError
from ..functions import interval as iv
from ..types import INTERVAL, PgType, Val, type_of

_numbers = itertools.count()


def fresh() -> str:
    return f"_{next(_numbers)}"


@dataclass(frozen=True)
class Binding:
    table: str | None
    name: str
    type: PgType
    column: str
    hidden: bool = False  # reachable by its qualifier, but not part of ``*``

    @property
    def val(self) -> Val:
        return Val(F.col(self.column), self.type)


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    scope: tuple[Binding, ...]

    @property
    def shown(self) -> tuple[Binding, ...]:
        return tuple(b for b in self.scope if not b.hidden)

    def resolve(self, name: str, table: str | None) -> Binding:
        """42P01 for an unknown qualifier, 42703 for an unknown name, 42702 for one that is not unique."""
        if table is not None and not any(b.table == table for b in self.scope):
            raise SqlError("42P01", f'missing FROM-clause entry for table "{table}"')
        found = [b for b in self.scope if b.name == name and (b.table == table if table is not None else not b.hidden)]
        if not found:
            raise SqlError("42703", f'column "{name if table is None else table + "." + name}" does not exist')
        if len(found) > 1:
            raise SqlError("42702", f'column reference "{name}" is ambiguous')
        return found[0]

    def named(self, table: str, columns: tuple[str, ...] = ()) -> Relation:
        """The same rows under another qualifier, with the first columns renamed and all internal names new."""
        shown = self.shown
        if len(columns) > len(shown):
            raise SqlError("42601", f'table "{table}" has {len(shown)} columns available but {len(columns)} columns specified')
        scope = tuple(replace(b, table=table, name=columns[i] if i < len(columns) else b.name, column=fresh()) for i, b in enumerate(shown))
        return Relation(self.df.select(*(F.col(old.column).alias(new.column) for old, new in zip(shown, scope, strict=True))), scope)

    def output(self) -> DataFrame:
        """A DataFrame with the SQL names; equal names may repeat."""
        return self.df.select(*(F.col(b.column) for b in self.shown)).toDF(*(b.name for b in self.shown))


def scan(df: DataFrame, table: str, types: dict[str, PgType] | None = None) -> Relation:
    """A stored DataFrame as a relation; floats count as doubles."""
    scope, cols = [], []
    for f in df.schema.fields:
        kind = (types or {}).get(f.name) or type_of(f.dataType)
        scope.append(Binding(table, f.name, kind, fresh()))
        col = df[f"`{f.name}`"]
        cols.append((col if f.dataType == kind.spark else col.cast(kind.spark)).alias(scope[-1].column))
    return Relation(df.select(*cols), tuple(scope))


def sort_key(v: Val, descending: bool):
    """PostgreSQL's order: nulls last going up, first going down; intervals by their canonical length."""
    col = iv.key(v.col) if v.type == INTERVAL else v.col
    return col.desc_nulls_first() if descending else col.asc_nulls_last()


def distinct(r: Relation) -> Relation:
    """Distinct rows; equal intervals with different parts are one, shown by the least parts."""
    spans = [b for b in r.shown if b.type == INTERVAL]
    if not spans:
        return Relation(r.df.select(*(b.column for b in r.shown)).distinct(), r.shown)
    keys = [(iv.key(F.col(b.column)) if b.type == INTERVAL else F.col(b.column)).alias(b.column) for b in r.shown]
    kept = [F.min(F.col(f"{b.column}_v")).alias(f"{b.column}_v") for b in spans]
    df = r.df.select(*keys, *(F.col(b.column).alias(f"{b.column}_v") for b in spans)).groupBy(*(b.column for b in r.shown)).agg(*kept)
    return Relation(df.select(*(F.col(f"{b.column}_v" if b.type == INTERVAL else b.column).alias(b.column) for b in r.shown)), r.shown)


def limited(df: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
