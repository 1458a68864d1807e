"""A session: tables by name, SQL statements in, DataFrames out."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import SqlError, sqlstate
from .functions.casts import cast
from .functions.registry import Context
from .operators.relation import scan
from .operators.sets import known
from .plans import syntax as s
from .plans.analyzer import Analyzer, Scope, walk
from .plans.parser import parse
from .sources.foreign import ForeignCatalog
from .sources.kafka import bounds_of
from .types import UNKNOWN, PgType, Val, is_number


@dataclass(frozen=True)
class Table:
    df: DataFrame
    types: dict[str, PgType]


def configure(spark: SparkSession) -> None:
    """Session settings that the semantics rest on."""
    spark.conf.set("spark.sql.ansi.enabled", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


class Engine:
    """PostgreSQL-flavoured SQL over Spark.

    Tables are registered DataFrames, Parquet folders, foreign tables, or made by CREATE TABLE.  A write makes a new
    version of its table (in ``warehouse``, if given, as Parquet; else as a plan) and swaps it in, so readers keep the
    version they began with and ROLLBACK swaps back.
    """

    def __init__(self, spark: SparkSession, warehouse: str | None = None, foreign: ForeignCatalog | None = None):
        configure(spark)
        self.spark, self.warehouse = spark, warehouse
        self.tables: dict[str, Table] = {}
        self.foreign = foreign or ForeignCatalog()
        self.saved: dict[str, Table] | None = None
        self.failed = False
        self.began: dt.datetime | None = None
        self.zones = (self._zone(),) * 2  # before the open block, and after it if it commits

    # -- tables

    def register(self, name: str, df: DataFrame, types: dict[str, PgType] | None = None) -> None:
        self.tables[name] = Table(df, types or {})

    def register_parquet(self, folder: str, *names: str) -> None:
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))

    def _lookup(self, name: str, where=None):
        if name in self.tables:
            return self.tables[name].df, self.tables[name].types
        return self.foreign.scan(self.spark, name, bounds_of(where)) if self.foreign.has(name) else None

    # -- statements

    def describe(self, text: str) -> list[tuple[str, str]]:
        """Names and types of a query's columns, without running it."""
        (query,) = parse(text)
        return [(b.name, str(b.type)) for b in known(self._analyzer().query(query)).shown]

    def sql(self, text: str) -> DataFrame:
        """The rows of one query."""
        out = self.execute(text)
        if len(out) != 1 or not isinstance(out[0], DataFrame):
            raise SqlError("42601", "one query is expected")
        return out[0]

    def execute(self, text: str) -> list[DataFrame | str]:
        """All statements in order: a DataFrame for a query, a command tag for others; stops at the first error."""
        return [self._one(statement) for statement in parse(text)]

    def state_of(self, text: str) -> str | None:
        """The SQLSTATE that running ``text`` ends with; None if it succeeds."""
        try:
            for out in self.execute(text):
                if isinstance(out, DataFrame):
                    out.collect()
        except Exception as e:  # noqa: BLE001
            return sqlstate(e)
        return None

    def _one(self, statement):
        if self.failed and not isinstance(statement, s.Transaction):
            raise SqlError("25P02", "current transaction is aborted, commands ignored until end of transaction block")
        try:
            return self._run(statement)
        except Exception:
            self.failed = self.saved is not None
            raise

    def _analyzer(self) -> Analyzer:
        now = dt.datetime.now(dt.timezone.utc)
        return Analyzer(self.spark, self._lookup, Context(now, self.began or now))

    def _run(self, st):
        if isinstance(st, s.Query):
            if st.locking and not (isinstance(st.body, s.Select) and isinstance(st.body.source, s.TableRef) and not st.body.group and not st.body.distinct and not st.ctes):
                raise SqlError("0A000", "FOR UPDATE and FOR SHARE need a plain query on one table")
            return self._analyzer().query(st).output()
        if isinstance(st, s.Transaction):
            return self._transaction(st.what)
        if isinstance(st, s.CreateTable):
            if st.name in self.tables or self.foreign.has(st.name):
                raise SqlError("42P07", f'relation "{st.name}" already exists')
            if len({n for n, _ in st.columns}) < len(st.columns):
                raise SqlError("42701", "a column is specified more than once")
            schema = T.StructType([T.StructField(n, k.spark) for n, k in st.columns])
            self.tables[st.name] = Table(self.spark.createDataFrame([], schema), dict(st.columns))
            return "CREATE TABLE"
        if isinstance(st, s.DropTable):
            if st.foreign or st.name not in self.tables:
                if not self.foreign.drop_table(st.name):
                    raise SqlError("42P01", f'table "{st.name}" does not exist')
                return "DROP FOREIGN TABLE"
            del self.tables[st.name]
            return "DROP TABLE"
        if isinstance(st, (s.Insert, s.Update, s.Delete)):
            if any(isinstance(n, (s.Scalar, s.Exists, s.InQuery, s.Quantified)) for n in walk(st)):
                raise SqlError("0A000", "subqueries in writes are not supported")
            return self._write(st)
        if isinstance(st, s.SetVar):
            return self._set(st)
        if isinstance(st, s.Show):
            if st.name != "timezone":
                raise SqlError("42704", f'unrecognized configuration parameter "{st.name}"')
            return self.spark.createDataFrame([(self._zone(),)], "TimeZone string")
        return self.foreign.run(st, self.spark)

    def _transaction(self, what: str) -> str:
        if what == "begin":
            if self.saved is None:
                self.saved, self.began = dict(self.tables), dt.datetime.now(dt.timezone.utc)
                self.zones = (self._zone(),) * 2
            return "BEGIN"
        back = what == "rollback" or self.failed
        if self.saved is not None:
            if back:
                self.tables = self.saved
            self.spark.conf.set("spark.sql.session.timeZone", self.zones[0 if back else 1])
        self.saved, self.failed, self.began = None, False, None
        return "ROLLBACK" if back else "COMMIT"

    def _zone(self) -> str:
        return self.spark.conf.get("spark.sql.session.timeZone")

    def _set(self, st: s.SetVar) -> str:
        """SET lasts to the end of the session, SET LOCAL to that of the block; a rollback undoes both."""
        if st.name == "timezone":
            try:
                self.spark.conf.set("spark.sql.session.timeZone", st.value or "UTC")
            except Exception as e:
                raise SqlError("22023", f'invalid value for parameter "TimeZone": "{st.value}"') from e
            if not st.local:
                self.zones = (self.zones[0], self._zone())
            return "SET"
        allowed = {"datestyle": ("iso, mdy", "iso"), "intervalstyle": ("postgres",)}
        if st.name in allowed and (st.value is None or st.value.lower() in allowed[st.name]):
            return "SET"
        raise SqlError("0A000" if st.name in allowed else "42704", f'parameter "{st.name}" cannot be set to that')

    # -- writes

    def _target(self, name: str) -> Table:
        if self.foreign.has(name):
            raise SqlError("42809", f'"{name}" is a foreign table and cannot be written')
        if name not in self.tables:
            raise SqlError("42P01", f'relation "{name}" does not exist')
        return self.tables[name]

    def _swap(self, name: str, df: DataFrame, types: dict[str, PgType]) -> None:
        if self.warehouse:
            path = f"{self.warehouse}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            df = self.spark.read.schema(df.schema).parquet(path)
        self.tables[name] = Table(df, types)

    @staticmethod
    def assign(v: Val, to: PgType, column: str) -> Val:
        """Assignment: literals and numbers adapt to the column, other types must match."""
        if v.type == UNKNOWN or v.type.name == to.name or is_number(v.type) and is_number(to) or {v.type.name, to.name} <= {"date", "timestamp", "timestamptz"}:
            return cast(v, to)
        raise SqlError("42804", f'column "{column}" is of type {to} but expression is of type {v.type}')

    def _write(self, st) -> str:
        table = self._target(st.table)
        base = scan(table.df, st.table, table.types)
        types = {b.name: b.type for b in base.scope}
        names = list(types)
        analyzer = self._analyzer()
        if isinstance(st, s.Insert):
            columns = list(st.columns) or names
            for c in columns:
                if c not in types:
                    raise SqlError("42703", f'column "{c}" of relation "{st.table}" does not exist')
            if len(set(columns)) < len(columns):
                raise SqlError("42701", "a column is specified more than once")
            structs = []
            scope = Scope(scan(self.spark.range(0, 1, 1, 1).select(), ""))
            for row in st.rows:
                if len(row) > len(columns) or st.columns and len(row) < len(columns):
                    raise SqlError("42601", "INSERT has another number of expressions than target columns")
                given = dict(zip(columns, row, strict=False))
                cols = [self.assign(analyzer.expr(given[n], scope, {}), k, n).col.cast(k.spark) if n in given else F.lit(None).cast(k.spark) for n, k in types.items()]
                structs.append(F.struct(*(c.alias(n) for c, n in zip(cols, names, strict=True))))
            rows = self.spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
            current = base.df.toDF(*names)
            self._swap(st.table, current.union(rows), types)
            return f"INSERT 0 {len(st.rows)}"
        scope = Scope(base)
        hit = F.coalesce(analyzer.condition(st.where, scope, {}, "WHERE"), F.lit(False)) if st.where is not None else F.lit(True)
        count = base.df.where(hit).count()
        if isinstance(st, s.Delete):
            self._swap(st.table, base.df.where(~hit).toDF(*names), types)
            return f"DELETE {count}"
        sets = dict(st.sets)
        if len(sets) < len(st.sets):
            raise SqlError("42601", "multiple assignments to one column")
        for c in sets:
            if c not in types:
                raise SqlError("42703", f'column "{c}" of relation "{st.table}" does not exist')
        new = [F.when(hit, self.assign(analyzer.expr(sets[b.name], scope, {}), b.type, b.name).col.cast(b.type.spark)).otherwise(F.col(b.column)).alias(b.name) if b.name in sets else F.col(b.column).alias(b.name) for b in base.scope]
        self._swap(st.table, base.df.select(*new), types)
        return f"UPDATE {count}"
