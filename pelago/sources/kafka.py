"""Kafka topics as finite batches: offset bounds from a filter, reader options, and decoding of values.

Spark's Kafka source is a separate connector; everything here but :func:`read_topic` works without it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SqlError
from ..plans import syntax as s
from ..types import BYTEA, INT4, INT8, TEXT, TIMESTAMPTZ, PgType
from . import avro

ENVELOPE = {"_partition": INT4, "_offset": INT8, "_timestamp": TIMESTAMPTZ, "_key": BYTEA, "_headers": TEXT}
#: A value framed by a schema registry: a zero byte and four bytes of schema id.
FRAME = 5


@dataclass
class Bounds:
    """Per partition, offsets from ``low`` (inclusive) to ``high`` (exclusive); only these partitions are read."""

    partitions: dict[int, tuple[int | None, int | None]] = field(default_factory=dict)

    def options(self, topic: str) -> dict[str, str]:
        starts = {str(p): -2 if lo is None else lo for p, (lo, _) in self.partitions.items()}
        ends = {str(p): -1 if hi is None else hi for p, (_, hi) in self.partitions.items()}
        return {"assign": json.dumps({topic: sorted(self.partitions)}), "startingOffsets": json.dumps({topic: starts}), "endingOffsets": json.dumps({topic: ends})}

    def plan(self, earliest: dict[int, int], latest: dict[int, int]) -> dict[int, tuple[int, int]]:
        """The ranges to fetch, given what the topic holds; empty ones are left out."""
        out = {}
        for p, (lo, hi) in self.partitions.items():
            if p in earliest:
                start, stop = max(earliest[p], earliest[p] if lo is None else lo), min(latest[p], latest[p] if hi is None else hi)
                if start < stop:
                    out[p] = (start, stop)
        return out


def _conjuncts(e) -> list:
    return _conjuncts(e.left) + _conjuncts(e.right) if isinstance(e, s.Binary) and e.op == "and" else [e]


def bounds_of(where) -> Bounds | None:
    """Bounds from the top-level conjuncts ``_partition = N`` and ranges of ``_offset``; None where no partition is named.

    The filter itself is still applied to what is read, so bounds only ever save work.
    """
    partition, low, high = None, None, None
    flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}
    for e in _conjuncts(where) if where is not None else []:
        tests = []
        if isinstance(e, s.Between) and not e.negated:
            tests = [(e.arg, ">=", e.low), (e.arg, "<=", e.high)]
        elif isinstance(e, s.Binary) and e.op in flip:
            tests = [(e.left, e.op, e.right) if isinstance(e.left, s.Name) else (e.right, flip[e.op], e.left)]
        for name, op, value in tests:
            if not isinstance(name, s.Name) or not isinstance(value, s.Literal) or not isinstance(value.value, int) or value.kind != "number":
                continue
            n = value.value
            if name.name == "_partition" and op == "=":
                partition = n
            elif name.name == "_offset":
                if op in (">=", ">", "="):
                    first = n + (op == ">")
                    low = first if low is None else max(low, first)
                if op in ("<=", "<", "="):
                    last = n + (op != "<")
                    high = last if high is None else min(high, last)
    return None if partition is None else Bounds({partition: (low, high)})


def reader_options(options: dict[str, str], bounds: Bounds | None) -> dict[str, str]:
    """Spark's options for a foreign table's; only committed records, up to the end of the topic as it is now."""
    out = {"kafka.bootstrap.servers": options["bootstrap"], "kafka.isolation.level": "read_committed", "includeHeaders": "true"}
    if "security_protocol" in options:
        out["kafka.security.protocol"] = options["security_protocol"]
    if "sasl_mechanism" in options:
        module = "scram.ScramLoginModule" if options["sasl_mechanism"].startswith("SCRAM") else "plain.PlainLoginModule"
        out["kafka.sasl.mechanism"] = options["sasl_mechanism"]
        out["kafka.sasl.jaas.config"] = f'org.apache.kafka.common.security.{module} required username="{options.get("username", "")}" password="{options.get("password", "")}";'
    if bounds is not None:
        return out | bounds.options(options["topic"])
    return out | {"subscribe": options["topic"], "startingOffsets": "earliest", "endingOffsets": "latest"}


def read_topic(spark: SparkSession, options: dict[str, str], bounds: Bounds | None = None) -> DataFrame:
    """The records of a topic: key, value, topic, partition, offset, timestamp, headers."""
    return spark.read.format("kafka").options(**reader_options(options, bounds)).load()


def shape(raw: DataFrame, columns: dict[str, PgType], value_format: str, registry=None) -> DataFrame:
    """The envelope, then the value's columns.  A record without a value has nulls in all of them; fields that the value
    lacks are null; nested fields are JSON text.  Avro values need the ``registry`` that has their schemas."""
    headers = F.to_json(F.map_from_entries(F.transform("headers", lambda h: F.struct(h["key"], F.concat(F.lit("\\x"), F.lower(F.hex(h["value"])))))))
    out = [
        F.col("partition").cast("int").alias("_partition"),
        F.col("offset").cast("long").alias("_offset"),
        F.col("timestamp").cast("timestamp_ltz").alias("_timestamp"),
        F.col("key").alias("_key"),
        F.coalesce(headers, F.lit("{}")).alias("_headers"),
    ]
    if value_format == "raw":
        return raw.select(*out, *(F.col("value").alias(c) for c in columns))
    if value_format == "json":
        framed = F.hex(F.substring("value", 1, 1)) == "00"
        body = F.decode(F.when(framed, F.expr(f"substring(value, {FRAME + 1})")).otherwise(F.col("value")), "UTF-8")
        schema = T.StructType([T.StructField(c, k.spark if k.name != "time" else T.StringType()) for c, k in columns.items()])
        value = F.from_json(body, schema)
        return raw.select(*out, *(value[c].alias(c) for c in columns))
    if value_format == "avro":
        if registry is None:
            raise SqlError("HV00D", 'server option "registry_url" is required for Avro values')
        # dates and instants come as numbers
        held = {"date": T.IntegerType(), "timestamptz": T.LongType(), "timestamp": T.LongType(), "time": T.StringType()}
        value = F.from_json(avro.decoded(F.col("value"), registry, FRAME), T.StructType([T.StructField(c, held.get(k.name, k.spark)) for c, k in columns.items()]))
        back = {"date": F.date_from_unix_date, "timestamptz": F.timestamp_micros, "timestamp": lambda x: F.timestamp_micros(x).cast("timestamp_ntz")}
        return raw.select(*out, value.alias("rec")).select(*ENVELOPE, *(back.get(k.name, lambda x: x)(F.col(f"rec.`{c}`")).alias(c) for c, k in columns.items()))
    if value_format == "protobuf":
        raise SqlError("0A000", "Protobuf values need a compiled schema; read them raw and decode with Spark's connector")
    raise SqlError("22023", f'unknown value format "{value_format}"')


# How the types of the three schema languages show as columns; anything nested is JSON text.
AVRO_TYPES = {"int": "int4", "long": "int8", "float": "float8", "double": "float8", "bytes": "bytea", "string": "text", "boolean": "boolean"}
AVRO_LOGICAL = {"timestamp-millis": "timestamptz", "timestamp-micros": "timestamptz", "date": "date", "decimal": "numeric"}
JSON_TYPES = {"boolean": "boolean", "integer": "int8", "number": "float8"}
PROTOBUF_TYPES = {"int32": "int4", "sint32": "int4", "sfixed32": "int4", "enum": "int4", "uint32": "int8", "fixed32": "int8", "int64": "int8", "sint64": "int8", "sfixed64": "int8", "uint64": "int8", "fixed64": "int8", "float": "float8", "double": "float8", "bool": "boolean", "string": "text", "bytes": "bytea"}


def avro_columns(schema: dict) -> dict[str, PgType]:
    """Columns of an Avro record; a union with null is its other branch, other unions are left out."""
    out = {}
    for f in schema["fields"]:
        kind = f["type"]
        if isinstance(kind, list):
            rest = [k for k in kind if k != "null"]
            if len(rest) != 1 or len(kind) != 2:
                continue
            kind = rest[0]
        if isinstance(kind, dict):
            logical = AVRO_LOGICAL.get(kind.get("logicalType", ""))
            if logical == "numeric":
                out[f["name"]] = PgType("numeric", kind["precision"], kind.get("scale", 0))
                continue
            kind = logical or kind["type"]
            out[f["name"]] = PgType(logical or AVRO_TYPES.get(kind, "text"))
        else:
            out[f["name"]] = PgType(AVRO_TYPES.get(kind, "text"))
    return out


def json_columns(schema: dict) -> dict[str, PgType]:
    return {n: PgType(JSON_TYPES.get(p.get("type"), "text")) for n, p in schema.get("properties", {}).items()}


def protobuf_columns(fields: dict[str, str]) -> dict[str, PgType]:
    return {n: PgType(PROTOBUF_TYPES.get(k, "text")) for n, k in fields.items()}


def imported(topic: str, registry) -> tuple[str, dict[str, PgType]]:
    """Value format and columns of a topic by the newest schema of its values; raw bytes where there is none to read."""
    if registry is not None:
        kind, text = registry.latest(f"{topic}-value")
        if kind == "AVRO" and isinstance(schema := json.loads(text), dict) and schema.get("type") == "record":
            return "avro", avro_columns(schema)
        if kind == "JSON":
            return "json", json_columns(json.loads(text))
    return "raw", {"value": BYTEA}


def list_topics(spark: SparkSession, options: dict[str, str]) -> list[str]:
    """The topics of a server, by the client that comes with Spark's Kafka connector; 0A000 without it."""
    jvm = spark._jvm
    try:
        settings = jvm.java.util.HashMap()
        for k, v in reader_options(options | {"topic": ""}, None).items():
            if k.startswith("kafka."):
                settings.put(k.removeprefix("kafka."), v)
        client = jvm.org.apache.kafka.clients.admin.AdminClient.create(settings)
    except TypeError as e:  # py4j takes a missing class for a package
        raise SqlError("0A000", "listing topics needs Spark's Kafka connector; or give the catalog a ``topics`` function") from e
    try:
        return sorted(client.listTopics().names().get())
    finally:
        client.close()
