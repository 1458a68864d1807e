import datetime as dt
import json
import struct
from decimal import Decimal as D

import pytest

from pelago.engine import Engine
from pelago.errors import SqlError
from pelago.plans.parser import parse
from pelago.sources import avro, kafka
from pelago.sources.foreign import ForeignCatalog
from pelago.sources.registry import SchemaRegistry
from pelago.types import PgType


def bounds(where):
    found = kafka.bounds_of(parse(f"SELECT 1 FROM t WHERE {where}")[0].body.where)
    return None if found is None else found.partitions


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("_partition = 0 AND _offset >= 1", {0: (1, None)}), ("_partition = 2 AND _offset BETWEEN 5 AND 9", {2: (5, 10)}), ("_partition = 1 AND _offset > 3 AND _offset <= 7 AND _offset < 6", {1: (4, 6)}),
        ("_offset > 3", None), ("_partition = 1 OR _offset = 2", None), ("7 > _offset AND 1 = _partition", {1: (None, 7)}), ("_partition = 1 AND _offset = 4", {1: (4, 5)}),
    ],
)
def test_bounds(where, want):
    assert bounds(where) == want


def test_plan_and_options():
    b = kafka.Bounds({0: (1, None), 1: (None, 5), 7: (0, 1)})
    assert b.plan({0: 0, 1: 2}, {0: 3, 1: 9}) == {0: (1, 3), 1: (2, 5)}
    assert json.loads(b.options("t")["startingOffsets"]) == {"t": {"0": 1, "1": -2, "7": 0}}
    o = kafka.reader_options({"bootstrap": "h:1", "topic": "t", "sasl_mechanism": "PLAIN", "username": "u", "password": "p", "security_protocol": "SASL_SSL"}, None)
    assert o["subscribe"] == "t" and o["endingOffsets"] == "latest" and o["kafka.isolation.level"] == "read_committed" and 'username="u"' in o["kafka.sasl.jaas.config"]


def test_schemas():
    avro = {"fields": [{"name": "id", "type": "int"}, {"name": "t", "type": ["null", {"type": "long", "logicalType": "timestamp-millis"}]}, {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}}, {"name": "r", "type": {"type": "record", "fields": []}}, {"name": "u", "type": ["int", "string"]}]}
    assert {k: str(v) for k, v in kafka.avro_columns(avro).items()} == {"id": "int4", "t": "timestamptz", "d": "numeric(9,2)", "r": "text"}
    assert {k: str(v) for k, v in kafka.json_columns({"properties": {"a": {"type": "integer"}, "b": {"type": "object"}}}).items()} == {"a": "int8", "b": "text"}
    assert {k: str(v) for k, v in kafka.protobuf_columns({"a": "uint32", "b": "Nested"}).items()} == {"a": "int8", "b": "text"}


def topic(spark, options, bounds):
    at = dt.datetime(2024, 1, 1)
    framed = b"\0\0\0\0\x07"
    rows = [(0, i, at, b"k", None if v is None else bytearray(framed + json.dumps(v).encode()), [("h", bytearray(b"\x01"))]) for i, v in enumerate([{"id": 1, "weight": 3.75, "more": {"x": 1}}, {"id": 2}, None])]
    return spark.createDataFrame([(p, o, t, bytearray(k), v, h) for p, o, t, k, v, h in rows], "partition int, offset long, timestamp timestamp, key binary, value binary, headers array<struct<key: string, value: binary>>")


def test_foreign_tables(spark):
    catalog = ForeignCatalog(reader=topic, topics=lambda o: {"__internal": ("raw", {}), "events": ("raw", {"value": PgType("bytea")}), "skip": ("raw", {})})
    e = Engine(spark, foreign=catalog)
    e.execute("CREATE FOREIGN DATA WRAPPER kafka; CREATE SERVER s FOREIGN DATA WRAPPER kafka OPTIONS (bootstrap 'h:9092'); CREATE USER MAPPING FOR public SERVER s OPTIONS (username 'u', password 'p')")
    e.execute("CREATE FOREIGN TABLE parcels (id int4, weight float8, more text) SERVER s OPTIONS (topic 'parcels', value_format 'json')")
    rows = e.sql("SELECT _partition, _offset, id, weight, more, _headers FROM parcels WHERE _offset >= 0 ORDER BY _offset").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 1, 3.75, '{"x":1}', '{"h":"\\\\x01"}'), (0, 1, 2, None, None, '{"h":"\\\\x01"}'), (0, 2, None, None, None, '{"h":"\\\\x01"}')]
    asked = []
    catalog.reader = lambda spark, options, bounds: (asked.append(bounds and bounds.partitions), topic(spark, options, bounds))[1]
    assert e.sql("SELECT count(*) FROM parcels WHERE _partition = 0 AND _offset >= 1").collect()[0][0] == 2
    assert e.sql("SELECT count(*) FROM parcels o JOIN parcels p ON o._offset = p._offset WHERE o._partition = 0").collect()[0][0] == 3
    assert asked == [{0: (1, None)}, None, None]
    e.execute("IMPORT FOREIGN SCHEMA public EXCEPT (skip) FROM SERVER s")
    assert sorted(catalog.tables) == ["events", "parcels"]
    assert e.state_of("INSERT INTO parcels VALUES (1)") == "42809" and e.state_of("CREATE SERVER s FOREIGN DATA WRAPPER kafka") == "42710" and e.state_of("ALTER SERVER s") == "0A000"
    assert e.execute("DROP FOREIGN TABLE parcels; DROP USER MAPPING FOR public SERVER s; DROP SERVER s; DROP FOREIGN DATA WRAPPER kafka")[0] == "DROP FOREIGN TABLE"


class Registry:
    """Two versions of one subject, as a registry would serve them."""

    SCHEMAS = {
        3: {"type": "record", "name": "Parcel", "fields": [{"name": "id", "type": "int"}, {"name": "note", "type": ["null", "string"]}]},
        4: {
            "type": "record", "name": "Parcel", "namespace": "x.y", "fields": [
                {"name": "id", "type": "int"}, {"name": "note", "type": ["null", "string"]}, {"name": "cost", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}}, {"name": "sent", "type": {"type": "long", "logicalType": "timestamp-millis"}},
                {"name": "due", "type": {"type": "int", "logicalType": "date"}}, {"name": "raw", "type": "bytes"}, {"name": "ok", "type": "boolean"}, {"name": "size", "type": "double"}, {"name": "kind", "type": {"type": "enum", "name": "Kind", "symbols": ["BOX", "BAG"]}},
                {"name": "stops", "type": {"type": "array", "items": {"type": "record", "name": "Stop", "fields": [{"name": "at", "type": "string"}, {"name": "codes", "type": {"type": "map", "values": "long"}}]}}}, {"name": "last", "type": ["null", "Stop"]},
            ],
        },
    }

    def __init__(self, url):
        assert url == "http://r"

    def schema(self, number):
        return json.dumps(self.SCHEMAS[number])

    def latest(self, subject):
        return {"parcels-value": ("AVRO", json.dumps(self.SCHEMAS[4])), "forms-value": ("JSON", json.dumps({"properties": {"n": {"type": "integer"}}})), "blobs-value": ("PROTOBUF", "message B {}")}[subject]


def number(n):
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def text(t):
    t = t if isinstance(t, bytes) else t.encode()
    return number(len(t)) + t


def avro_topic(spark, options, bounds):
    stop = text("ört") + number(1) + text("c") + number(-70000) + number(0)
    whole = number(7) + number(1) + text("fragile") + text((-1234).to_bytes(2, "big", signed=True)) + number(1704164645123) + number(19724) + text(b"\x00\xff") + b"\x01" + struct.pack("<d", float("inf")) + number(1)
    whole += number(-1) + number(len(stop)) + stop + number(0) + number(1) + stop
    values = [b"\0" + (4).to_bytes(4, "big") + whole, b"\0" + (3).to_bytes(4, "big") + number(8) + number(0), None]
    rows = [(0, i, dt.datetime(2024, 1, 1), None, None if v is None else bytearray(v), None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "partition int, offset long, timestamp timestamp, key binary, value binary, headers array<struct<key: string, value: binary>>")


def test_avro_values_and_imported_schemas(spark):
    e = Engine(spark, foreign=ForeignCatalog(reader=avro_topic, topics=lambda o: ["__own", "parcels", "forms", "blobs"], registry=Registry))
    e.execute("CREATE FOREIGN DATA WRAPPER k; CREATE SERVER s FOREIGN DATA WRAPPER k OPTIONS (bootstrap 'h:1', registry_url 'http://r'); IMPORT FOREIGN SCHEMA public FROM SERVER s")
    assert {n: str(t) for n, t in e.foreign.tables["parcels"].columns.items()} == {"id": "int4", "note": "text", "cost": "numeric(9,2)", "sent": "timestamptz", "due": "date", "raw": "bytea", "ok": "boolean", "size": "float8", "kind": "text", "stops": "text", "last": "text"}
    assert {n: str(t) for n, t in e.foreign.tables["forms"].columns.items()} == {"n": "int8"} and e.foreign.tables["blobs"].options["value_format"] == "raw"
    rows = e.sql("SELECT id, note, cost, sent::text, due, raw::text, ok, size::text, kind, stops FROM parcels ORDER BY _offset").collect()
    place = '{"at":"ört","codes":{"c":-70000}}'
    assert tuple(rows[0]) == (7, "fragile", D("-12.34"), "2024-01-02 03:04:05.123+00", dt.date(2024, 1, 2), "\\x00ff", True, "Infinity", "BAG", f"[{place}]")
    assert tuple(rows[1]) == (8, *[None] * 9) and tuple(rows[2]) == (None,) * 10
    e.execute("CREATE FOREIGN TABLE odd (last text, id text) SERVER s OPTIONS (topic 'parcels', value_format 'avro')")
    assert [tuple(r) for r in e.sql("SELECT last, id FROM odd ORDER BY _offset").collect()] == [(place, "7"), (None, "8"), (None, None)]
    with pytest.raises(SqlError):
        avro.to_json(b"\0\0\0\0\x03" + number(8) + number(5), lambda n: avro.compile_schema(Registry.SCHEMAS[n]), 5)
    assert Engine(spark, foreign=ForeignCatalog()).foreign.registry("http://127.0.0.1:9").timeout == 10
    with pytest.raises(SqlError, match="HV00N"):
        SchemaRegistry("http://127.0.0.1:9", 1).schema(1)


def test_listing_topics_without_the_connector(spark):
    e = Engine(spark)
    e.execute("CREATE FOREIGN DATA WRAPPER k; CREATE SERVER s FOREIGN DATA WRAPPER k OPTIONS (bootstrap 'h:1')")
    assert e.state_of("IMPORT FOREIGN SCHEMA public FROM SERVER s") == "0A000"
