"""A schema registry over HTTP.  Anything with the same two methods may stand in for it."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass

from ..errors import SqlError


@dataclass(frozen=True)
class SchemaRegistry:
    url: str
    timeout: float = 10

    def _get(self, path: str) -> dict:
        try:
            with urllib.request.urlopen(f"{self.url.rstrip('/')}/{path}", timeout=self.timeout) as answer:
                return json.load(answer)
        except (urllib.error.URLError, OSError, ValueError) as e:
            raise SqlError("HV00N", f"schema registry: {e}") from e

    def schema(self, number: int) -> str:
        """The text of the schema with this id."""
        return self._get(f"schemas/ids/{number}")["schema"]

    def latest(self, subject: str) -> tuple[str, str]:
        """Kind (AVRO, JSON or PROTOBUF) and text of a subject's newest schema."""
        found = self._get(f"subjects/{urllib.parse.quote(subject, safe='')}/versions/latest")
        return found.get("schemaType", "AVRO"), found["schema"]
