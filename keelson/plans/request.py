"""Query requests: a conjunction of Eq, In and Range filters over one dataset.

Requests are parsed and checked against the schema on the driver, before any
job, and become ordinary column expressions on typed columns, which Spark
pushes to the Parquet scan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..schema import Column, Schema

DEFAULT_LIMIT, MAX_LIMIT = 100, 10_000
#: A single bounded integer range of at most so many values is answered as equalities (a label and an accounting rule here).
RANGE_VALUES = 256


@dataclass(frozen=True)
class Eq:
    column: str
    value: str | None


@dataclass(frozen=True)
class In:
    column: str
    values: tuple[str | None, ...]

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(self.values))


@dataclass(frozen=True)
class Range:
    column: str
    gte: str | None = None
    lte: str | None = None


Filter = Eq | In | Range


@dataclass(frozen=True)
class Request:
    filters: tuple[Filter, ...] = ()
    select: tuple[str, ...] = ()
    limit: int = DEFAULT_LIMIT
    after_row_id: int | None = None
    max_rows_examined: int | None = None
    timeout_ms: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "filters", tuple(self.filters))
        object.__setattr__(self, "select", tuple(self.select))

    @classmethod
    def from_json(cls, text: str | dict) -> Request:
        raw = dict(json.loads(text) if isinstance(text, str) else text)
        filters = []
        for f in raw.pop("filters", []):
            f = dict(f)
            kind = {"eq": Eq, "in": In, "range": Range}.get(f.pop("op", None))
            if kind is None:
                raise InvalidRequest("a filter's op is eq, in or range")
            try:
                filters.append(kind(**f))
            except TypeError as e:
                raise InvalidRequest(f"malformed filter: {e}") from None
        try:
            return cls(filters=tuple(filters), **{k: v for k, v in raw.items() if v is not None})
        except TypeError as e:
            raise InvalidRequest(f"malformed request: {e}") from None


@dataclass(frozen=True)
class Prepared:
    """A checked filter: the column and its stored values."""

    spec: Column
    op: str
    values: tuple = ()
    low: int | None = None
    high: int | None = None

    @property
    def column(self) -> SparkColumn:
        return F.col(f"`{self.spec.name}`")

    def _lit(self, v) -> SparkColumn:
        return F.lit(Decimal(v)).cast("decimal(20,0)") if self.spec.logical_type == "unsigned" else F.lit(v)

    def predicate(self) -> SparkColumn:
        c = self.column
        if self.op == "eq":
            v = self.values[0]
            return c.isNull() if v is None else c == self._lit(v)
        if self.op == "in":
            full = [v for v in self.values if v is not None]
            out = c.isin([Decimal(v) if self.spec.logical_type == "unsigned" else v for v in full]) if full else None
            if None in self.values:
                out = c.isNull() if out is None else out | c.isNull()
            return out
        out = None
        for bound, test in ((self.low, c.__ge__), (self.high, c.__le__)):
            if bound is not None:
                out = test(self._lit(bound)) if out is None else out & test(self._lit(bound))
        return out

    def matches(self, value) -> bool:
        """The same test in Python, on a stored value."""
        if self.op in ("eq", "in"):
            return value in self.values
        return value is not None and (self.low is None or value >= self.low) and (self.high is None or value <= self.high)


def prepare(filters: tuple[Filter, ...], schema: Schema) -> list[Prepared]:
    out = []
    for f in filters:
        spec = schema[f.column]
        if isinstance(f, Eq):
            out.append(Prepared(spec, "eq", (spec.literal(f.value),)))
        elif isinstance(f, In):
            if not f.values:
                raise InvalidRequest(f"IN on column {f.column} has no values")
            values = dict.fromkeys(spec.literal(v) for v in f.values)
            out.append(Prepared(spec, "in", tuple(sorted(values, key=lambda v: (v is not None, v if v is not None else 0)))))
        else:
            if spec.logical_type not in ("unsigned", "signed"):
                raise InvalidRequest(f"column {f.column} is {spec.logical_type}; only integers have ranges")
            if f.gte is None and f.lte is None:
                raise InvalidRequest(f"range on column {f.column} has no bound")
            low, high = (spec.value(b) if b is not None else None for b in (f.gte, f.lte))
            if low is not None and high is not None and low > high:
                raise InvalidRequest(f"range on column {f.column} is empty")
            out.append(Prepared(spec, "range", low=low, high=high))
    return out


def predicate(prepared: list[Prepared]) -> SparkColumn | None:
    """The conjunction of all filters, or None."""
    out = None
    for p in prepared:
        out = p.predicate() if out is None else out & p.predicate()
    return out


def projection(select: tuple[str, ...], schema: Schema) -> list[str]:
    """The columns to return: all for an empty list; order and duplicates are kept."""
    for name in select:
        schema[name]
    return list(select) or schema.names


def route(prepared: list[Prepared]) -> str:
    """The logical access route, first match wins: browse, equality, candidate_first, range_decomposed, scan."""
    if not prepared:
        return "browse"
    if all(p.op == "eq" for p in prepared):
        return "equality"
    if any(p.op == "eq" for p in prepared):
        return "candidate_first"
    if len(prepared) == 1 and prepared[0].op == "range" and None not in (prepared[0].low, prepared[0].high):
        if prepared[0].high - prepared[0].low < RANGE_VALUES:
            return "range_decomposed"
    return "scan"
