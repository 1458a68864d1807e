"""Foreign tables: wrappers, servers, user mappings, and Kafka topics read as finite batches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import SqlError
from ..plans import syntax as s
from ..types import PgType
from . import kafka
from .registry import SchemaRegistry


@dataclass
class ForeignTable:
    server: str
    columns: dict[str, PgType]
    options: dict[str, str]


@dataclass
class ForeignCatalog:
    """Definitions by name.

    ``topics`` lists a server's topics for IMPORT FOREIGN SCHEMA: their names, or name -> (value format, columns).
    ``reader`` reads a topic's records, ``registry`` makes the schema registry of a server's ``registry_url``.
    """

    wrappers: set[str] = field(default_factory=set)
    servers: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)
    mappings: dict[str, dict[str, str]] = field(default_factory=dict)
    tables: dict[str, ForeignTable] = field(default_factory=dict)
    topics: object = None
    reader: object = None
    registry: object = SchemaRegistry

    def has(self, name: str) -> bool:
        return name in self.tables

    def drop_table(self, name: str) -> bool:
        return self.tables.pop(name, None) is not None

    def scan(self, spark: SparkSession, name: str, bounds: kafka.Bounds | None = None) -> tuple[DataFrame, dict[str, PgType]] | None:
        found = self.tables.get(name)
        if found is None:
            return None
        options = self.servers[found.server][1] | self.mappings.get(found.server, {}) | found.options
        read = self.reader or kafka.read_topic
        raw = read(spark, options, bounds)
        shaped = kafka.shape(raw, found.columns, options.get("value_format", "raw"), self._registry(options))
        return shaped, kafka.ENVELOPE | found.columns

    def _registry(self, options: dict[str, str]):
        return self.registry(options["registry_url"]) if "registry_url" in options else None

    def run(self, st: s.Foreign, spark: SparkSession | None = None) -> str:
        options = dict(st.options)
        if st.what == "wrapper":
            if st.name in self.wrappers:
                raise SqlError("42710", f'foreign-data wrapper "{st.name}" already exists')
            self.wrappers.add(st.name)
            return "CREATE FOREIGN DATA WRAPPER"
        if st.what == "server":
            if st.of not in self.wrappers:
                raise SqlError("42704", f'foreign-data wrapper "{st.of}" does not exist')
            if st.name in self.servers:
                raise SqlError("42710", f'server "{st.name}" already exists')
            if "bootstrap" not in options:
                raise SqlError("HV00D", 'server option "bootstrap" is required')
            self.servers[st.name] = (st.of, options)
            return "CREATE SERVER"
        if st.what in ("mapping", "table", "import", "drop_mapping") and st.of not in self.servers:
            raise SqlError("42704", f'server "{st.of}" does not exist')
        if st.what == "mapping":
            if st.of in self.mappings:
                raise SqlError("42710", "the user mapping already exists")
            self.mappings[st.of] = options
            return "CREATE USER MAPPING"
        if st.what == "table":
            if st.name in self.tables:
                raise SqlError("42P07", f'relation "{st.name}" already exists')
            if "topic" not in options:
                raise SqlError("HV00D", 'table option "topic" is required')
            self.tables[st.name] = ForeignTable(st.of, dict(st.columns), options)
            return "CREATE FOREIGN TABLE"
        if st.what == "import":
            options = self.servers[st.of][1] | self.mappings.get(st.of, {})
            found = self.topics(options) if self.topics else kafka.list_topics(spark, options)
            for topic in found:
                if topic.startswith("__") or st.only and topic not in st.only or topic in st.but:
                    continue
                form, columns = found[topic] if isinstance(found, dict) else kafka.imported(topic, self._registry(options))
                self.tables[topic] = ForeignTable(st.of, columns, {"topic": topic, "value_format": form})
            return "IMPORT FOREIGN SCHEMA"
        held = {"drop_wrapper": self.wrappers, "drop_server": self.servers, "drop_mapping": self.mappings}[st.what]
        key = st.of if st.what == "drop_mapping" else st.name
        if key not in held:
            raise SqlError("42704", f'"{key}" does not exist')
        held.discard(key) if isinstance(held, set) else held.pop(key)
        return st.what.upper().replace("_", " ")
