"""Table schemas: attributes, primary key and label, with their JSON form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..functions.types import NUMERIC, SPARK, of_spark, type_name


@dataclass
class TableSchema:
    """Ordered (name, type) pairs besides ``id``, the primary key (``id`` by default) and a label (the namespace)."""

    attributes: list[tuple[str, str]] = field(default_factory=list)
    primary_key: str = "id"
    label: str = ""

    @classmethod
    def parse(cls, pairs: list[str], **more) -> TableSchema:
        """From ``name:type`` items; a repeated name or unknown type rejects all."""
        out: list[tuple[str, str]] = []
        for pair in pairs:
            name, colon, kind = (x.strip() for x in pair.partition(":"))
            if not name or not colon or name == "id" or any(name == n for n, _ in out):
                raise InvalidArgument(f"bad attribute {pair!r}")
            out.append((name, type_name(kind)))
        return cls(out, **more)

    @classmethod
    def of(cls, struct: T.StructType, key: str = "id", **more) -> TableSchema:
        """The schema of a DataFrame whose ``key`` column stands for ``id``."""
        return cls([(f.name, of_spark(f.dataType)) for f in struct.fields if f.name != key and not f.name.startswith("_")], **more)

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.attributes]

    def kind(self, name: str) -> str:
        """Type of an attribute; ``id`` is int and an undeclared one is string."""
        return "int" if name == "id" else dict(self.attributes).get(name, "string")

    def numeric_attribute(self) -> str | None:
        """``balance`` if it is an int, else the first int that is not the key."""
        ints = [n for n, k in self.attributes if k == "int" and n != self.primary_key]
        return "balance" if "balance" in ints else ints[0] if ints else None

    def is_numeric(self, name: str) -> bool:
        return self.kind(name) in NUMERIC

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField("id", T.IntegerType(), False), *(T.StructField(n, SPARK[k]) for n, k in self.attributes)])

    def to_json(self) -> str:
        return json.dumps({"attributes": self.attributes, "primary_key": self.primary_key, "label": self.label})

    @classmethod
    def from_json(cls, text: str) -> TableSchema:
        """From JSON; attributes of unknown types are dropped and a key that isn't there becomes ``id``."""
        data = json.loads(text)
        attributes = []
        for name, kind in data.get("attributes", ()):
            try:
                attributes.append((name, type_name(kind)))
            except InvalidArgument:
                continue
        key = data.get("primary_key", "id")
        return cls(attributes, key if key == "id" or key in dict(attributes) else "id", data.get("label", ""))

    def fingerprint(self) -> int:
        """A 64-bit FNV-1a hash of key and attributes, to tell statistics of another schema."""
        h = 0xCBF29CE484222325
        for byte in f"{self.primary_key}|{self.attributes}".encode():
            h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h
