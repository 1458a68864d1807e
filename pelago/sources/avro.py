"""Avro values in Arrow batches, by writer schemas from a registry: no connector is needed.

A schema is compiled once in each worker to a function over bytes.  A value becomes JSON text whose fields a declared
column can take: numbers and booleans as they are, bytes in base64, decimals as text, dates in days, instants in
microseconds, and anything nested as JSON text.
"""

from __future__ import annotations

import base64
import json
import math
import struct
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SqlError

Reader = Callable[[bytes, int], tuple[object, int]]


def _long(data: bytes, at: int) -> tuple[int, int]:
    """A zigzag number of up to ten bytes."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return (value >> 1) ^ -(value & 1), at
        if shift > 63:
            raise ValueError("a number is too long")


def _bytes(data: bytes, at: int) -> tuple[bytes, int]:
    n, at = _long(data, at)
    if n < 0 or at + n > len(data):
        raise ValueError("a value ends before its bytes")
    return data[at : at + n], at + n


def _blocks(data: bytes, at: int, item: Reader) -> tuple[list, int]:
    """Arrays and maps: blocks of items, a negative count followed by the block's bytes."""
    out = []
    while True:
        n, at = _long(data, at)
        if not n:
            return out, at
        if n < 0:
            n, (_, at) = -n, _long(data, at)
        for _ in range(n):
            value, at = item(data, at)
            out.append(value)


def _float(code: str, size: int) -> Reader:
    return lambda data, at: (struct.unpack_from(code, data, at)[0], at + size)


_PRIMITIVE: dict[str, Reader] = {
    "null": lambda data, at: (None, at), "boolean": lambda data, at: (data[at] != 0, at + 1), "int": _long, "long": _long, "float": _float("<f", 4), "double": _float("<d", 8), "bytes": _bytes,
    "string": lambda data, at: (lambda b, end: (b.decode(), end))(*_bytes(data, at)),
}


class Days(int):
    """A date, in days."""


class Micros(int):
    """An instant, in microseconds."""


def compile_schema(schema, names: dict[str, Reader] | None = None) -> Reader:
    """A function (bytes, place) -> (value, next place) for a parsed schema."""
    names = {} if names is None else names
    if isinstance(schema, str):
        if schema not in _PRIMITIVE and schema not in names:
            raise ValueError(f'unknown Avro type "{schema}"')
        return _PRIMITIVE.get(schema) or (lambda data, at: names[schema](data, at))
    if isinstance(schema, list):
        branches = [compile_schema(s, names) for s in schema]

        def union(data: bytes, at: int):
            i, at = _long(data, at)
            return branches[i](data, at) if i >= 0 else branches[len(branches)](data, at)

        return union
    kind, logical = schema["type"], schema.get("logicalType")
    if kind in ("record", "enum", "fixed"):
        return _named(kind, schema, names)
    if kind in ("array", "map"):
        item = compile_schema(schema["items" if kind == "array" else "values"], names)
        if kind == "array":
            return lambda data, at: _blocks(data, at, item)

        def entry(data: bytes, at: int):
            key, at = _bytes(data, at)
            value, at = item(data, at)
            return (key.decode(), value), at

        return lambda data, at: (lambda pairs, end: (dict(pairs), end))(*_blocks(data, at, entry))
    return _logical(compile_schema(kind, names), logical, schema)


def _named(kind: str, schema: dict, names: dict[str, Reader]) -> Reader:
    name = schema["name"]
    full = name if "." in name or not schema.get("namespace") else f"{schema['namespace']}.{name}"

    def known(reader: Reader) -> Reader:
        names[full] = names[full.rpartition(".")[2]] = reader
        return reader

    if kind == "enum":
        symbols = schema["symbols"]
        return known(lambda data, at: (lambda i, end: (symbols[i], end))(*_long(data, at)))
    if kind == "fixed":
        size = schema["size"]
        return known(_logical(lambda data, at: (data[at : at + size], at + size), schema.get("logicalType"), schema))
    fields: list[tuple[str, Reader]] = []

    def record(data: bytes, at: int):
        out = {}
        for field, read in fields:
            out[field], at = read(data, at)
        return out, at

    known(record)
    fields += [(f["name"], compile_schema(f["type"], names)) for f in schema["fields"]]
    return record


def _logical(read: Reader, logical: str | None, schema: dict) -> Reader:
    if logical == "decimal":
        scale = schema.get("scale", 0)
        return lambda data, at: (lambda raw, end: (Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-scale), end))(*read(data, at))
    wrap = {"date": Days, "timestamp-millis": lambda v: Micros(v * 1000), "timestamp-micros": Micros}.get(logical or "")
    return (lambda data, at: (lambda v, end: (wrap(v), end))(*read(data, at))) if wrap else read


def _plain(value):
    """A value inside JSON text."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, bytes):
        return "\\x" + value.hex()
    if isinstance(value, Decimal):
        return f"{value:f}"
    return None if isinstance(value, float) and not math.isfinite(value) else value


def _field(value):
    """A value for a column."""
    if isinstance(value, (dict, list)):
        return json.dumps(_plain(value), separators=(",", ":"), ensure_ascii=False)
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    if isinstance(value, Decimal):
        return f"{value:f}"
    return str(value).replace("inf", "Infinity").replace("nan", "NaN") if isinstance(value, float) and not math.isfinite(value) else value


def to_json(data: bytes, schema_of: Callable[[int], Reader], frame: int) -> str:
    """A framed value as JSON text; ``null`` if it is no record."""
    if len(data) < frame or data[0]:
        raise SqlError("22P03", "a value has no schema frame")
    try:
        value, _ = schema_of(int.from_bytes(data[1:frame], "big"))(data, frame)
    except (ValueError, IndexError, struct.error, KeyError) as e:
        raise SqlError("22P03", f"a value does not fit its Avro schema: {e}") from e
    return json.dumps({k: _field(v) for k, v in value.items()}, ensure_ascii=False) if isinstance(value, dict) else "null"


def decoded(value: Column, registry, frame: int) -> Column:
    """JSON text of framed values; ``registry.schema(id)`` gives a writer schema, and is asked once for each in a worker."""
    readers: dict[int, Reader] = {}

    def schema_of(number: int) -> Reader:
        if number not in readers:
            readers[number] = compile_schema(json.loads(registry.schema(number)))
        return readers[number]

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else to_json(bytes(v), schema_of, frame) for v in values], dtype=object)

    return run(value)
