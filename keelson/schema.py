"""Declared dataset schemas: five logical types, normalisation, null literals, and the union over layers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from .errors import InvalidData, InvalidRequest

FORMAT = "SCHEMA/1"
ROW_ID = "_row_id"
LOGICAL_TYPES = ("text", "unsigned", "signed", "boolean", "timestamp")
NORMALIZATIONS = ("none", "trim", "lowercase", "trim_lowercase")
U64_MAX, I64_MIN, I64_MAX = 2**64 - 1, -(2**63), 2**63 - 1

#: How values are stored. A timestamp is opaque text and is never parsed.
SPARK_TYPES: dict[str, T.DataType] = {"text": T.StringType(), "timestamp": T.StringType(), "unsigned": T.DecimalType(20, 0), "signed": T.LongType(), "boolean": T.BooleanType()}


@dataclass(frozen=True)
class Column:
    name: str
    logical_type: str = "text"
    nullable: bool = False
    normalization: str = "none"
    null_values: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "null_values", tuple(self.null_values))
        if self.logical_type not in LOGICAL_TYPES:
            raise InvalidData(f"unknown logical type {self.logical_type!r}")
        if self.normalization not in NORMALIZATIONS:
            raise InvalidData(f"unknown normalization {self.normalization!r}")

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.logical_type]

    def is_null_literal(self, raw: str) -> bool:
        """Null literals are compared with the raw text, before normalisation, and only where null is allowed."""
        return self.nullable and raw in self.null_values

    def normalize(self, raw: str) -> str:
        if self.normalization in ("trim", "trim_lowercase"):
            raw = raw.strip(_WHITE_SPACE)
        return raw.lower() if self.normalization in ("lowercase", "trim_lowercase") else raw

    def value(self, raw: str):
        """The stored value of a literal; raises for text that the type doesn't admit."""
        text = self.normalize(raw)
        if self.logical_type == "unsigned":
            if re.fullmatch(r"\+?[0-9]+", text) and int(text) <= U64_MAX:
                return int(text)
            raise InvalidRequest(f"column {self.name} expects an unsigned integer, got {raw!r}")
        if self.logical_type == "signed":
            if re.fullmatch(r"[+-]?[0-9]+", text) and I64_MIN <= int(text) <= I64_MAX:
                return int(text)
            raise InvalidRequest(f"column {self.name} expects a signed integer, got {raw!r}")
        if self.logical_type == "boolean":
            word = text.strip(_WHITE_SPACE).translate(_ASCII_LOWER)
            if word in ("true", "1", "false", "0"):
                return word in ("true", "1")
            raise InvalidRequest(f"column {self.name} expects a boolean, got {raw!r}")
        return text

    def literal(self, raw: str | None):
        """The stored value of a query literal: a null literal means null, and only a nullable column has nulls."""
        if raw is None:
            return None
        return None if self.is_null_literal(raw) else self.value(raw)

    def canonical(self, raw: str) -> str:
        v = self.value(raw)
        return str(v).lower() if isinstance(v, bool) else str(v)


#: Unicode's White_Space property.
_WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Schema:
    columns: tuple[Column, ...]
    format: str = field(default=FORMAT)

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        if not self.format.endswith(FORMAT):
            raise InvalidData(f"unsupported schema format {self.format!r}")
        if not self.columns:
            raise InvalidData("a schema needs at least one column")
        seen: set[str] = set()
        for c in self.columns:
            if not c.name.strip():
                raise InvalidData("column name is empty")
            if c.name in seen:
                raise InvalidData(f"duplicate column name {c.name}")
            if c.name.startswith("_"):
                raise InvalidData(f"column name {c.name} is reserved (leading underscore)")
            if not c.nullable and c.null_values:
                raise InvalidData(f"column {c.name} isn't nullable but lists null literals")
            seen.add(c.name)

    def __getitem__(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise InvalidRequest(f"unknown column {name}")

    def __contains__(self, name: str) -> bool:
        return any(c.name == name for c in self.columns)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, True) for c in self.columns])

    def widened(self, names: Iterable[str]) -> Schema:
        """With the named columns nullable."""
        wide = set(names)
        return Schema(tuple(replace(c, nullable=True) if c.name in wide else c for c in self.columns), self.format)

    def to_json(self) -> str:
        return json.dumps({"format": self.format, "columns": [asdict(c) | {"null_values": list(c.null_values)} for c in self.columns]}, indent=1)

    @classmethod
    def from_json(cls, text: str | dict) -> Schema:
        raw = json.loads(text) if isinstance(text, str) else text
        return cls(tuple(Column(**c) for c in raw["columns"]), raw.get("format", FORMAT))


def union(layers: list[Schema]) -> Schema:
    """The schema over a base and its layers in order.

    Shared columns must agree in type, normalisation and null literals;
    nullability is OR-ed, and a column absent from any layer is nullable.
    """
    out: dict[str, Column] = {}
    for schema in layers:
        for c in schema.columns:
            have = out.get(c.name)
            if have is None:
                out[c.name] = c
                continue
            if (have.logical_type, have.normalization, have.null_values) != (c.logical_type, c.normalization, c.null_values) and not (
                have.logical_type == c.logical_type and have.normalization == c.normalization and set(have.null_values) == set(c.null_values)
            ):
                raise InvalidData(f"column {c.name} conflicts with the existing schema")
            out[c.name] = replace(have, nullable=have.nullable or c.nullable)
    everywhere = set.intersection(*[set(s.names) for s in layers])
    return Schema(tuple(c if c.name in everywhere else replace(c, nullable=True) for c in out.values()))


def infer(header: list[str], rows: list[list[str]]) -> Schema:
    """A first guess from sample rows: digits, signed digits, booleans, else text; nullable where a blank was seen."""
    columns = []
    for i, name in enumerate(header):
        values = [r[i] if i < len(r) else "" for r in rows]
        full = [v.strip() for v in values if v.strip()]
        kind = "text"
        if full:
            if all(re.fullmatch(r"[0-9]+", v) for v in full):
                kind = "unsigned"
            elif all(re.fullmatch(r"-?[0-9]+", v) for v in full):
                kind = "signed"
            elif all(v.lower() in ("true", "false") for v in full):
                kind = "boolean"
        blank = len(full) < len(values)
        columns.append(Column(name.strip(), kind, blank, "trim", ("",) if blank else ()))
    return Schema(tuple(columns))
