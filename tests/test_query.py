"""Requests: semantics on literal tables, random conjunctions against plain Python, and plans."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.errors import InvalidRequest, LimitExceeded
from keelson.plans import query
from keelson.plans.request import Eq, In, Range, Request, predicate, prepare, route
from keelson.schema import ROW_ID, Column, Schema

SCHEMA = Schema((Column("country", normalization="trim_lowercase"), Column("age", "unsigned"), Column("debt", "signed", True, "trim", ("", "NULL")), Column("active", "boolean", True)))


def rows(n=400, seed=0):
    rng = random.Random(seed)
    return [(i * 3, rng.choice(["us", "de", "fr"]), rng.choice([0, 5, 7, 2**64 - 1]), rng.choice([None, -3, 0, 9]), rng.choice([None, True, False])) for i in range(n)]


@pytest.fixture(scope="module")
def view(spark):
    df = spark.createDataFrame([(a, b, str(c), d, e) for a, b, c, d, e in rows()], f"{ROW_ID} long, country string, age string, debt long, active boolean")
    return df.withColumn("age", F.col("age").cast("decimal(20,0)"))


def random_filter(rng):
    k = rng.randrange(7)
    if k == 0:
        return Eq("country", rng.choice([" US ", "de", "xx"]))
    if k == 1:
        return Eq("debt", rng.choice([None, "NULL", "-3", "+9"]))
    if k == 2:
        return In("country", tuple(rng.choices(["US", "de", "fr ", "none"], k=rng.randint(1, 3))))
    if k == 3:
        return In("active", tuple(rng.choices([None, "1", "false"], k=2)))
    if k == 4:
        return Range("age", rng.choice([None, "0", "006"]), rng.choice(["7", "18446744073709551615"]))
    if k == 5:
        return Range("debt", rng.choice(["-5", "0"]), rng.choice([None, "8", "0"]))
    return Eq("active", rng.choice([None, "TRUE", "0"]))


def test_random_conjunctions(view):
    data = [dict(zip([ROW_ID, *SCHEMA.names], r)) for r in rows()]
    rng = random.Random(7)
    for _ in range(40):
        filters = tuple(random_filter(rng) for _ in range(rng.randint(0, 4)))
        request = Request(filters=filters, limit=rng.choice([1, 5, 1000]), after_row_id=rng.choice([None, 0, 600, 10**6]))
        prepared = prepare(filters, SCHEMA)
        want = [r for r in data if all(p.matches(r[p.spec.name]) for p in prepared)]
        got = query.run(view, request, SCHEMA)
        assert got.stats.hits == len(want)
        after = [r for r in want if request.after_row_id is None or r[ROW_ID] > request.after_row_id][: request.limit]
        assert [i for i, _ in got.rows] == [r[ROW_ID] for r in after]
        assert got.next_cursor == (after[-1][ROW_ID] if len(after) == request.limit else None)


def test_errors():
    bad = [Eq("nope", "x"), Eq("age", "abc"), Eq("age", " 5"), In("age", ()), Range("country", "a"), Range("age"), Range("age", "9", "3"), Range("age", "-1"), Eq("active", "maybe")]
    for f in bad:
        with pytest.raises(InvalidRequest):
            prepare((f,), SCHEMA)
    for raw in ('{"filters":[{"op":"like","column":"a"}]}', '{"filters":[{"op":"eq","colum":"a"}]}', '{"filters":[],"sort":"x"}'):
        with pytest.raises(InvalidRequest):
            Request.from_json(raw)
    r = Request.from_json('{"filters":[{"op":"in","column":"age","values":["1",null]},{"op":"range","column":"age","gte":"1"}],"select":["age","age"],"limit":3,"after_row_id":7}')
    assert r == Request((In("age", ("1", None)), Range("age", "1")), ("age", "age"), 3, 7)


def test_limits_and_projection(view):
    with pytest.raises(InvalidRequest):
        query.page(view, Request(limit=0), SCHEMA)
    with pytest.raises(InvalidRequest):
        query.run(view, Request(limit=10_001), SCHEMA)
    with pytest.raises(InvalidRequest):
        query.page(view, Request(select=("nope",)), SCHEMA)
    with pytest.raises(LimitExceeded):
        query.run(view, Request(filters=(Range("age", gte="5"),), max_rows_examined=10), SCHEMA)
    assert query.run(view, Request(filters=(Eq("country", "us"),), max_rows_examined=0), SCHEMA).stats.rows_examined == 0
    p = query.run(view, Request(select=("active", "age", "active"), limit=2), SCHEMA)
    assert [c for c, _ in p.rows[0][1]] == ["active", "age", "active"] and p.rows[0][1][1][1] == str(rows()[0][2])


def test_routes():
    kind = lambda *f: route(prepare(f, SCHEMA))
    assert kind() == "browse" and kind(Eq("age", "1"), Eq("country", "x")) == "equality" and kind(Eq("age", "1"), In("age", ("1",))) == "candidate_first"
    assert kind(Range("age", "0", "255")) == "range_decomposed" and kind(Range("age", "0", "256")) == "scan" and kind(Range("age", "0")) == "scan" and kind(In("age", ("1",))) == "scan"


def test_plans(spark, data):
    """Filters reach the scan, only needed columns are read, pages are top-k, and counts have no single-partition window."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    df = spark.read.parquet(f"{data}/orders.parquet").withColumnRenamed("o_orderkey", ROW_ID)
    schema = Schema((Column("o_custkey", "signed"), Column("o_orderstatus", nullable=True)))
    found = query.page(df, Request(filters=(Eq("o_orderstatus", "F"), Range("o_custkey", "1", "50")), select=("o_custkey",), after_row_id=10), schema)
    plan = found._jdf.queryExecution().executedPlan().toString()
    for part in ("EqualTo(o_orderstatus,F)", "GreaterThanOrEqual(o_custkey,1)", "GreaterThan(o_orderkey,10)", "TakeOrderedAndProject"):
        assert part in plan
    assert "o_totalprice" not in plan and "Window" not in plan
    empty = df.where(predicate(prepare((Eq("o_orderstatus", "F"), Eq("o_orderstatus", "O")), schema)))
    assert "LocalTableScan <empty>" in empty._jdf.queryExecution().executedPlan().toString()
