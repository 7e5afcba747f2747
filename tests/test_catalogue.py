"""Every named query against its SQL, and the entry module's contract."""

import glob

import pytest

import __spark_entry__ as entry
from keelson.plans import catalogue, lifecycle  # noqa: F401

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, data, con, name):
    df = catalogue.QUERIES[name](spark, data)
    want = con.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr([norm(r[n]) for n in names]) for r in df.collect())
    assert got == sorted(repr([norm(v) for v in r]) for r in want.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "_row_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ordered_scan_is_whole(spark, data):
    got = [r["_row_id"] for r in entry.queries()["ordered_scan"](spark, data).collect()]
    assert got == sorted(r[0] for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey").collect())


def test_whole_filter_and_projection(spark):
    sf_dir = "/root/testdata/sf0.01"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert entry.queries()["filter_mixed_eq_range"](spark, sf_dir).count() == orders.where("o_orderstatus = 'F' AND o_custkey BETWEEN 10 AND 90").count() > 100
    whole = entry.queries()["project_reorder"](spark, sf_dir)
    assert whole.columns == ["_row_id", "o_orderpriority", "o_custkey"]
    assert whole.count() == orders.where("o_orderstatus = 'P'").count() > 50
