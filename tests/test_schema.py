"""Schemas, canonical values and their Python twins."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.errors import InvalidData, InvalidRequest
from keelson.functions import canonical
from keelson.schema import Column, Schema, infer, union


def test_validation():
    for bad in ([], [Column("a"), Column("a")], [Column(" ")], [Column("a", null_values=("x",))], [Column("_row_id")]):
        with pytest.raises(InvalidData):
            Schema(tuple(bad))
    with pytest.raises(InvalidData):
        Column("a", "float")
    s = Schema((Column("a", "unsigned", True, "trim", ("",)), Column("b")))
    assert Schema.from_json(s.to_json()) == s


def test_union():
    base, delta = Schema((Column("a"), Column("b", "signed"))), Schema((Column("b", "signed", True), Column("c")))
    u = union([base, delta])
    assert [(c.name, c.nullable) for c in u.columns] == [("a", True), ("b", True), ("c", True)]
    with pytest.raises(InvalidData):
        union([base, Schema((Column("a", "unsigned"),))])
    with pytest.raises(InvalidData):
        union([base, Schema((Column("a", normalization="trim"),))])


def test_infer():
    s = infer(["n", "s", "b", "t"], [["1", "-2", "true", "x"], ["02", "3", "FALSE", ""], ["3"]])
    assert [(c.logical_type, c.nullable) for c in s.columns] == [("unsigned", False), ("signed", True), ("boolean", True), ("text", True)]


EDGE = ["007", "+12", "-0", "", " 5", "5 ", "1e3", "18446744073709551615", "18446744073709551616", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "-9223372036854775809", "5\n", "TRUE", "0", "1", " false ", "yes", "٣", "NULL", "ΑΣ", "İx", "ẞ", " a　", "\t7\r\n", "\x85 8", "-", "+", "--1", "0" * 50 + "9", "ａ", "K"]


@pytest.mark.parametrize("kind", ["text", "unsigned", "signed", "boolean", "timestamp"])
@pytest.mark.parametrize("norm", ["none", "trim", "lowercase", "trim_lowercase"])
def test_columns_match_python(spark, kind, norm):
    spec = Column("x", kind, True, norm, ("NULL",))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(EDGE)], "i int, raw string")
    got = rows.select("i", canonical.text(canonical.stored(F.col("raw"), spec), spec).alias("v"), canonical.problem(F.col("raw"), spec).alias("p")).collect()
    for r in got:
        raw = EDGE[r.i]
        if spec.is_null_literal(raw):
            assert r.v is None and r.p is None
            continue
        try:
            want = spec.canonical(raw)
        except InvalidRequest:
            want = None
        assert r.v == want, (raw, r.v, want)
        assert (r.p is None) == (want is not None)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.integers(-(2**70), 2**70).map(str), st.text(max_size=6)))
def test_numbers_are_idempotent(raw):
    for kind in ("unsigned", "signed", "boolean"):
        spec = Column("x", kind, normalization="trim")
        try:
            once = spec.canonical(raw)
        except InvalidRequest:
            continue
        assert spec.canonical(once) == once
