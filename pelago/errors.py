"""Errors that carry a five-character SQLSTATE, as PostgreSQL clients expect."""

from __future__ import annotations

import re


class SqlError(Exception):
    def __init__(self, state: str, message: str):
        super().__init__(f"{state}: {message}")
        self.state, self.message = state, message


#: Spark's error conditions that have another SQLSTATE than PostgreSQL gives the same fault.
CONDITION_STATES = {
    "DIVIDE_BY_ZERO": "22012",
    "REMAINDER_BY_ZERO": "22012",
    "ARITHMETIC_OVERFLOW": "22003",
    "BINARY_ARITHMETIC_OVERFLOW": "22003",
    "CAST_OVERFLOW": "22003",
    "NUMERIC_VALUE_OUT_OF_RANGE": "22003",
    "CAST_INVALID_INPUT": "22P02",
    "CANNOT_PARSE_TIMESTAMP": "22007",
    "DATETIME_FIELD_OUT_OF_BOUNDS": "22008",
    "SCALAR_SUBQUERY_TOO_MANY_ROWS": "21000",
    "TABLE_OR_VIEW_NOT_FOUND": "42P01",
    "UNRESOLVED_COLUMN": "42703",
    "INVALID_FORMAT": "22025",
}


def sqlstate(error: BaseException) -> str:
    """The SQLSTATE of any error that a query can end with; XX000 where there is none."""
    if isinstance(error, SqlError):
        return error.state
    text = str(error)
    worker = re.search(r"SqlError: ([0-9A-Z]{5}): ", text)
    if worker:
        return worker[1]
    if "[USER_RAISED_EXCEPTION]" in text:
        body = text.split("[USER_RAISED_EXCEPTION]", 1)[1].strip()
        if len(body) > 6 and body[5] == ":":
            return body[:5]
    name = (getattr(error, "getCondition", lambda: None)() or text.partition("[")[2].partition("]")[0]).split(".")[0]
    if name in CONDITION_STATES:
        return CONDITION_STATES[name]
    state = getattr(error, "getSqlState", lambda: None)()
    return state or "XX000"
