"""Column builders for the canonical form of values: all JVM-side, none a user function.

Each has a Python twin in ``schema.Column`` for literals, so that a bad literal
fails before a job starts.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..schema import I64_MAX, I64_MIN, U64_MAX, Column, Schema

#: Unicode white space, which trim() alone doesn't cover.
_TRIM = r"\A(?U:[\s\x85])+|(?U:[\s\x85])+\z"


def trim(c: SparkColumn) -> SparkColumn:
    return F.regexp_replace(c, _TRIM, "")


def normalize(c: SparkColumn, spec: Column) -> SparkColumn:
    if spec.normalization in ("trim", "trim_lowercase"):
        c = trim(c)
    return F.lower(c) if spec.normalization in ("lowercase", "trim_lowercase") else c


def is_null_literal(raw: SparkColumn, spec: Column) -> SparkColumn:
    if not spec.nullable or not spec.null_values:
        return F.lit(False)
    return F.coalesce(raw.isin(list(spec.null_values)), F.lit(False))


def typed(raw: SparkColumn, spec: Column) -> SparkColumn:
    """The stored value of text, or null where the text isn't valid for the type."""
    text = normalize(raw, spec)
    if spec.logical_type == "unsigned":
        digits = F.regexp_replace(text, r"\A\+?0*(?=[0-9])", "")
        wide = F.when(F.length(digits) <= 20, digits).try_cast("decimal(38,0)")
        return F.when(text.rlike(r"\A\+?[0-9]+\z") & (wide <= F.lit(Decimal(U64_MAX)).cast("decimal(38,0)")), wide.try_cast("decimal(20,0)"))
    if spec.logical_type == "signed":
        digits = F.regexp_replace(F.regexp_replace(text, r"\A[+-]", ""), r"\A0+(?=[0-9])", "")
        wide = F.when(F.length(digits) <= 19, F.concat(F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")), digits)).try_cast("decimal(38,0)")
        fits = wide.between(F.lit(Decimal(I64_MIN)).cast("decimal(38,0)"), F.lit(Decimal(I64_MAX)).cast("decimal(38,0)"))
        return F.when(text.rlike(r"\A[+-]?[0-9]+\z") & fits, wide.try_cast("bigint"))
    if spec.logical_type == "boolean":
        word = F.translate(trim(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.when(word.isin("true", "1"), F.lit(True)).when(word.isin("false", "0"), F.lit(False))
    return text


def stored(raw: SparkColumn, spec: Column) -> SparkColumn:
    """The stored value of an input cell: null for null, and for a null literal."""
    return F.when(~is_null_literal(raw, spec), typed(raw, spec))


def problem(raw: SparkColumn, spec: Column, literals: bool = True) -> SparkColumn:
    """What is wrong with an input cell, or null."""
    absent = raw.isNull() | (is_null_literal(raw, spec) if literals else F.lit(False))
    none = F.lit(None).cast("string")
    empty = F.lit(f"column {spec.name} is not nullable") if not spec.nullable else none
    bad = F.concat(F.lit(f"column {spec.name} expects {spec.logical_type}, got "), F.coalesce(raw, F.lit("")))
    return F.when(absent, empty).when(typed(raw, spec).isNull(), bad)


def text(c: SparkColumn, spec: Column) -> SparkColumn:
    """The canonical text of a stored value."""
    return c if spec.logical_type in ("text", "timestamp") else c.cast("string")


def texts(schema: Schema) -> list[SparkColumn]:
    return [text(F.col(f"`{c.name}`"), c).alias(c.name) for c in schema.columns]


def composite_key(parts: list[tuple[SparkColumn, int]]) -> SparkColumn:
    """Mixed-radix key of several numbers, each with its cardinality."""
    key = F.lit(0).cast("decimal(38,0)")
    for c, cardinality in parts:
        key = key * F.lit(cardinality) + c
    return key.cast("decimal(38,0)")


def json_scalar(value: SparkColumn, kind: SparkColumn) -> SparkColumn:
    """Text of a JSON scalar (given as raw JSON text and its kind); null for anything nested."""
    return F.when(kind.isin("string", "number", "boolean"), value)
