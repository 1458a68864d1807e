"""The syntax tree.  Nodes are frozen, so equal expressions compare equal (GROUP BY matches by structure)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    value: object
    kind: str  # "null", "boolean", "number", "string"


@dataclass(frozen=True)
class Name:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Parameter:
    number: int


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class IsNull:
    arg: object
    negated: bool


@dataclass(frozen=True)
class InList:
    arg: object
    items: tuple
    negated: bool


@dataclass(frozen=True)
class Between:
    arg: object
    low: object
    high: object
    negated: bool


@dataclass(frozen=True)
class Like:
    arg: object
    pattern: object
    fold: bool
    negated: bool


@dataclass(frozen=True)
class Case:
    operand: object | None
    whens: tuple
    otherwise: object | None


@dataclass(frozen=True)
class Cast:
    arg: object
    type: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Extract:
    field: str
    arg: object


@dataclass(frozen=True)
class Scalar:
    query: object


@dataclass(frozen=True)
class Exists:
    query: object


@dataclass(frozen=True)
class InQuery:
    arg: object
    query: object
    negated: bool


@dataclass(frozen=True)
class Quantified:
    arg: object
    op: str
    every: bool
    query: object


# -- queries


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None


@dataclass(frozen=True)
class Star:
    table: str | None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Derived:
    query: object
    alias: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, full, cross
    left: object
    right: object
    on: object | None = None
    using: tuple[str, ...] | None = None
    natural: bool = False


@dataclass(frozen=True)
class Order:
    expr: object
    descending: bool


@dataclass(frozen=True)
class Select:
    distinct: bool
    items: tuple
    source: object | None
    where: object | None
    group: tuple
    having: object | None


@dataclass(frozen=True)
class Values:
    rows: tuple


@dataclass(frozen=True)
class SetOp:
    op: str
    every: bool
    left: object
    right: object


@dataclass(frozen=True)
class Cte:
    name: str
    columns: tuple[str, ...]
    query: object


@dataclass(frozen=True)
class Query:
    ctes: tuple[Cte, ...]
    body: object
    order: tuple[Order, ...]
    limit: int | None
    offset: int | None
    locking: bool = False


# -- statements


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple  # (name, type)


@dataclass(frozen=True)
class DropTable:
    name: str
    foreign: bool = False


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple
    where: object | None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object | None


@dataclass(frozen=True)
class Transaction:
    what: str  # begin, commit, rollback


@dataclass(frozen=True)
class SetVar:
    name: str
    value: str | None  # None: the default
    local: bool = False


@dataclass(frozen=True)
class Show:
    name: str


@dataclass(frozen=True)
class Foreign:
    """Definitions of foreign data: ``what`` is wrapper, server, mapping, table, import, drop_*, alter_*."""

    what: str
    name: str
    of: str | None = None
    columns: tuple = ()
    options: tuple = ()
    only: tuple[str, ...] = ()
    but: tuple[str, ...] = ()
