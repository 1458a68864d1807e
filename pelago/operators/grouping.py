"""Aggregates with PostgreSQL's result types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SqlError
from ..functions import interval as iv
from ..functions import numbers
from ..types import FLOAT8, INT4, INT8, INTERVAL, TEXT, UNKNOWN, PgType, Val, is_number


class Aggregate:
    """One aggregate call: the columns Spark aggregates, and the value made of their results."""

    def __init__(self, name: str, arg: Val | None, distinct: bool, column: str):
        self.name, self.column = name, column
        self.parts: list[Column] = []
        if name == "count":
            if arg is None:
                self._add(F.count(F.lit(1)))
            else:
                col = iv.key(arg.col) if arg.type == INTERVAL else arg.col
                self._add(F.count_distinct(col) if distinct else F.count(col))
            self.result = lambda p: Val(p[0], INT8)
            return
        kind = TEXT if arg.type == UNKNOWN else arg.type
        if name in ("min", "max"):
            if kind.name in ("boolean", "bytea"):
                raise SqlError("42883", f"function {name}({kind}) does not exist")
            pick = F.min if name == "min" else F.max
            if kind == INTERVAL:
                self._add(pick(F.when(arg.col.isNotNull(), F.struct(iv.key(arg.col).alias("k"), arg.col.alias("v")))))
                self.result = lambda p: Val(p[0]["v"], kind)
            else:
                self._add(pick(arg.col))
                self.result = lambda p: Val(p[0], kind)
            return
        if not is_number(kind) and kind != INTERVAL:
            raise SqlError("42883", f"function {name}({kind}) does not exist")
        add = F.sum_distinct if distinct else F.sum
        count = F.count_distinct if distinct else F.count
        if kind == INTERVAL:
            raise SqlError("42883", f"function {name}(interval) does not exist")
        if kind == FLOAT8:
            self._add(add(arg.col))
            if name == "avg":
                self._add(count(arg.col))
            self.result = lambda p: Val(p[0] if name == "sum" else p[0] / F.when(p[1] > 0, p[1]), FLOAT8)
        elif name == "sum":
            whole = kind in (INT4, INT8)
            total = PgType("numeric", 38, kind.spark.scale) if not whole else INT8
            self._add(add(arg.col.cast("long") if whole else arg.col.cast(kind.spark)))
            self.result = lambda p: Val(p[0].cast(total.spark), total)
        else:
            whole = kind in (INT4, INT8)
            scale = 0 if whole else kind.spark.scale
            self._add(add(arg.col.cast("decimal(20,0)" if whole else kind.spark)))
            self._add(count(arg.col))

            def mean(p):
                n = F.when(p[1] > 0, p[1])
                if scale:
                    return numbers.arithmetic("/", Val(p[0], PgType("numeric", 38 if kind.spark.precision > 28 else kind.spark.precision + 10, scale)), Val(n, INT8))
                # the whole part apart, so that sums of any size keep sixteen digits after the point
                rest = p[0] % n.cast("decimal(19,0)")
                quotient = ((p[0] - rest) / n.cast("decimal(19,0)")).cast("decimal(21,0)")
                made = quotient + F.round(rest.cast("decimal(37,18)") / n.cast("decimal(19,0)"), 16).cast("decimal(17,16)")
                return Val(made.cast("decimal(38,16)"), PgType("numeric", 38, 16))

            self.result = mean

    def _add(self, col: Column) -> None:
        self.parts.append(col.alias(f"{self.column}_{len(self.parts)}"))

    def value(self) -> Val:
        return self.result([F.col(f"{self.column}_{i}") for i in range(len(self.parts))])
