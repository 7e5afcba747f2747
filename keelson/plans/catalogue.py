"""Named queries over the star-schema tables, one or more per operator, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import buckets, indexes, mutation, telemetry, versioned
from ..operators.catalog import Catalog
from ..schema import ROW_ID, Column, Schema, union
from ..sources import attached, export, imports
from ..streaming.append import append_batch
from . import query as Q
from .request import Eq, In, Range, Request
from .shared import materialised, scratch
from .tables import SCHEMAS, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _found(spark: SparkSession, sf_dir: str, name: str, *filters) -> DataFrame:
    """All matches of a conjunction, with the row id."""
    df, schema = view(spark, sf_dir, name)
    return Q.matches(df, Request(filters=filters), schema)


def _page(spark: SparkSession, sf_dir: str, name: str, **request) -> DataFrame:
    df, schema = view(spark, sf_dir, name)
    return Q.page(df, Request(**request), schema)


_ORDERS = 'SELECT o_orderkey AS "_row_id", o_custkey, o_orderstatus, o_orderpriority FROM orders'
_EVENTS = "SELECT event_id AS _row_id, user_id, CASE WHEN event_type <> 'view' THEN event_type END AS event_type FROM events"
_CUSTOMER = 'SELECT c_custkey AS "_row_id", c_name, c_nationkey::BIGINT AS c_nationkey, lower(trim(c_mktsegment)) AS c_mktsegment FROM customer'
_PART = 'SELECT p_partkey AS "_row_id", p_name, p_brand, p_type, p_size::DECIMAL(20,0) AS p_size FROM part'
_LINES = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_returnflag, l_linestatus FROM lineitem"


# -- filters


@register(_ORDERS + " WHERE o_orderstatus = 'F'")
def filter_eq(spark, sf_dir):
    return _found(spark, sf_dir, "orders", Eq("o_orderstatus", "F"))


@register(f"SELECT * FROM ({_EVENTS}) WHERE event_type IS NULL")
def filter_eq_null(spark, sf_dir):
    return _found(spark, sf_dir, "events", Eq("event_type", None))


@register(f"SELECT * FROM ({_EVENTS}) WHERE event_type IS NULL")
def filter_eq_null_literal(spark, sf_dir):
    """A query literal that is a null literal of the column means null."""
    return _found(spark, sf_dir, "events", Eq("event_type", "view"))


@register(f"SELECT * FROM ({_CUSTOMER}) WHERE c_mktsegment = 'building'")
def filter_eq_canonical(spark, sf_dir):
    return _found(spark, sf_dir, "customer", Eq("c_mktsegment", "\t BUILDing　"))


@register(_ORDERS + " WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def filter_in(spark, sf_dir):
    return _found(spark, sf_dir, "orders", In("o_orderpriority", ("5-LOW", "1-URGENT", "5-LOW")))


@register(f"SELECT * FROM ({_EVENTS}) WHERE event_type IS NULL OR event_type = 'click'")
def filter_in_with_null(spark, sf_dir):
    return _found(spark, sf_dir, "events", In("event_type", ("click", None)))


@register(_LINES + " WHERE l_partkey BETWEEN 100 AND 150")
def filter_range_closed(spark, sf_dir):
    return _found(spark, sf_dir, "lineitem", Range("l_partkey", "100", "150")).drop(ROW_ID)


@register(_LINES + " WHERE l_linenumber >= 6")
def filter_range_open_hi(spark, sf_dir):
    return _found(spark, sf_dir, "lineitem", Range("l_linenumber", gte="+6")).drop(ROW_ID)


@register(_LINES + " WHERE l_suppkey <= 7")
def filter_range_open_lo(spark, sf_dir):
    return _found(spark, sf_dir, "lineitem", Range("l_suppkey", lte="007")).drop(ROW_ID)


@register(_ORDERS + " WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'")
def filter_conjunction(spark, sf_dir):
    return _found(spark, sf_dir, "orders", Eq("o_orderstatus", "O"), Eq("o_orderpriority", "2-HIGH"))


@register(_ORDERS + " WHERE o_orderstatus = 'O' AND o_orderstatus = 'F'")
def filter_contradiction(spark, sf_dir):
    return _found(spark, sf_dir, "orders", Eq("o_orderstatus", "O"), Eq("o_orderstatus", "F"))


@register(_ORDERS + " WHERE o_orderstatus = 'F' AND o_custkey BETWEEN 10 AND 90")
def filter_mixed_eq_range(spark, sf_dir):
    return _found(spark, sf_dir, "orders", Eq("o_orderstatus", "F"), Range("o_custkey", "10", "90"))


@register(_LINES + " WHERE l_returnflag = 'A' AND l_linestatus IN ('O', 'F') AND l_suppkey BETWEEN 5 AND 25")
def filter_mixed_eq_in_range(spark, sf_dir):
    return _found(spark, sf_dir, "lineitem", Eq("l_returnflag", "A"), In("l_linestatus", ("F", "O")), Range("l_suppkey", "5", "25")).drop(ROW_ID)


@register(f"SELECT * FROM ({_PART}) WHERE p_size BETWEEN 10 AND 20")
def range_decomposed_256(spark, sf_dir):
    return _found(spark, sf_dir, "part", Range("p_size", "10", "20"))


@register(_ORDERS + " WHERE o_custkey IS NULL")
def filter_is_null(spark, sf_dir):
    return _found(spark, sf_dir, "orders", Eq("o_custkey", None))


# -- projection, order, pages


@register("SELECT o_orderkey AS _row_id, o_orderpriority, o_custkey::VARCHAR AS o_custkey FROM orders WHERE o_orderstatus = 'P'")
def project_reorder(spark, sf_dir):
    """Every match as canonical text."""
    df, schema = view(spark, sf_dir, "orders")
    found = Q.matches(df, Request(filters=(Eq("o_orderstatus", "P"),)), schema)
    return found.select(ROW_ID, *[canonical.text(F.col(n), schema[n]).alias(n) for n in ("o_orderpriority", "o_custkey")])


@register(_ORDERS + " WHERE o_orderkey = 42")
def point_get(spark, sf_dir):
    df, _ = view(spark, sf_dir, "orders")
    return df.where(F.col(ROW_ID) == 42)


@register("SELECT n_nationkey AS _row_id, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation WHERE n_nationkey > 4 ORDER BY 1 LIMIT 7")
def browse_page(spark, sf_dir):
    return _page(spark, sf_dir, "nation", after_row_id=4, limit=7)


@register("SELECT o_orderkey AS _row_id, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderkey > 500 ORDER BY 1 LIMIT 25")
def cursor_page(spark, sf_dir):
    return _page(spark, sf_dir, "orders", filters=(Eq("o_orderstatus", "O"),), after_row_id=500, limit=25)


@register("SELECT o_orderkey AS _row_id, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_orderpriority FROM orders ORDER BY 1 LIMIT 10")
def limit_topk(spark, sf_dir):
    return _page(spark, sf_dir, "orders", limit=10)


@register("SELECT max(k) AS next_cursor, count(*) AS rows FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 33)")
def next_cursor(spark, sf_dir):
    df, schema = view(spark, sf_dir, "orders")
    found = Q.run(df, Request(filters=(Eq("o_orderstatus", "F"),), limit=33), schema)
    return spark.createDataFrame([(found.next_cursor, len(found.rows))], "next_cursor bigint, rows bigint")


@register("SELECT count(*) AS hits FROM orders WHERE o_orderstatus = 'F' AND o_custkey >= 100")
def hits_count(spark, sf_dir):
    return _found(spark, sf_dir, "orders", Eq("o_orderstatus", "F"), Range("o_custkey", gte="100")).agg(F.count("*").alias("hits"))


@register("""SELECT 'browse' AS route, 30::BIGINT AS rows_examined UNION ALL SELECT 'candidate_first', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'equality', 0 UNION ALL SELECT 'range_decomposed', 0 UNION ALL SELECT 'scan', (SELECT count(*) FROM orders)""")
def rows_examined_by_route(spark, sf_dir):
    df, schema = view(spark, sf_dir, "orders")
    eq, r = Eq("o_orderstatus", "F"), Range("o_custkey", "5", "2000")
    out = []
    for filters in ((), (eq,), (eq, r), (Range("o_custkey", "5", "260"),), (r,)):
        s = Q.run(df, Request(filters=filters, limit=30), schema).stats
        out.append((s.route, s.rows_examined))
    return spark.createDataFrame(out, "route string, rows_examined bigint")


# -- join-shaped operators and keys


@register("SELECT o_orderkey AS _row_id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderkey FROM orders WHERE o_custkey < 200")
def rowid_intersection(spark, sf_dir):
    a = _found(spark, sf_dir, "orders", Eq("o_orderstatus", "F")).select(ROW_ID)
    b = _found(spark, sf_dir, "orders", Range("o_custkey", lte="199")).select(ROW_ID)
    return a.join(b, ROW_ID, "left_semi")


@register("SELECT c_custkey AS _row_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def rowid_difference(spark, sf_dir):
    a, _ = view(spark, sf_dir, "customer")
    b = view(spark, sf_dir, "orders")[0].select(F.col("o_custkey").alias(ROW_ID))
    return a.select(ROW_ID).join(b, ROW_ID, "left_anti")


@register("SELECT ((l_linenumber::HUGEINT * 2 + (l_linestatus = 'O')::INT) * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::DECIMAL(38,0) AS key, count(*) AS n FROM lineitem GROUP BY 1")
def composite_key_count(spark, sf_dir):
    df, _ = view(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    key = canonical.composite_key([(F.col("l_linenumber"), 8), ((F.col("l_linestatus") == "O").cast("int"), 2), (flag, 3)])
    return df.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@register("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def key_histogram(spark, sf_dir):
    return indexes.key_histogram(view(spark, sf_dir, "orders")[0], ["o_orderstatus", "o_orderpriority"])


@register("SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def distinct_keys(spark, sf_dir):
    return indexes.distinct_keys(view(spark, sf_dir, "lineitem")[0], ["l_partkey", "l_suppkey"])


@register("SELECT k AS o_orderpriority, row_number() OVER (ORDER BY k) - 1 AS token, n FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1)")
def dictionary_encode(spark, sf_dir):
    """Dense tokens of a column's distinct values in byte order, joined back to every row."""
    orders, _ = view(spark, sf_dir, "orders")
    return indexes.encoded(orders, "o_orderpriority").groupBy("o_orderpriority", "token").agg(F.count("*").alias("n"))


@register("SELECT count(*) AS hits FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_custkey < 500")
def bitmap_conjunction(spark, sf_dir):
    """Row-id bitmaps of three predicates, and-ed bucket by bucket."""
    orders, _ = view(spark, sf_dir, "orders")
    predicates = [F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") < 500]
    return indexes.bitmap_hits(orders, predicates)


@register("SELECT o_orderkey AS _row_id, o_orderstatus FROM orders ORDER BY 1")
def ordered_scan(spark, sf_dir):
    """Every visible row in row-id order."""
    return view(spark, sf_dir, "orders")[0].select(ROW_ID, "o_orderstatus").orderBy(ROW_ID)


@register("SELECT DISTINCT l_suppkey FROM lineitem ORDER BY 1")
def distinct_sorted_values(spark, sf_dir):
    return view(spark, sf_dir, "lineitem")[0].select("l_suppkey").distinct().orderBy("l_suppkey")


@register("SELECT count(*) AS hits FROM orders WHERE o_custkey BETWEEN 20 AND 120")
def scan_count(spark, sf_dir):
    """The un-indexed count that other routes are held against."""
    return view(spark, sf_dir, "orders")[0].where("o_custkey >= 20 AND o_custkey <= 120").agg(F.count("*").alias("hits"))


# -- versions: customers split into a base and two delta layers


def _layers(spark, sf_dir) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """Base: all. Layer 1: every 7th row with another nation. Layer 2: every 21st with another segment. Deleted: every 10th."""
    base, _ = view(spark, sf_dir, "customer")
    one = base.where(F.col(ROW_ID) % 7 == 0).withColumn("c_nationkey", F.col("c_nationkey") + 100)
    two = base.where(F.col(ROW_ID) % 21 == 0).withColumn("c_mktsegment", F.lit("patched"))
    ids = base.select(ROW_ID)
    target = F.when(F.col(ROW_ID) % 10 == 0, versioned.DELETED).when(F.col(ROW_ID) % 21 == 0, 2).when(F.col(ROW_ID) % 7 == 0, 1)
    return [(0, base), (1, one), (2, two)], ids.select(ROW_ID, target.cast("int").alias(versioned.TARGET)).where(f"{versioned.TARGET} IS NOT NULL")


_VISIBLE = f"""SELECT "_row_id", c_name, CASE WHEN "_row_id" % 21 <> 0 AND "_row_id" % 7 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey,
CASE WHEN "_row_id" % 21 = 0 THEN 'patched' ELSE c_mktsegment END AS c_mktsegment FROM ({_CUSTOMER}) WHERE "_row_id" % 10 <> 0"""


@register(_VISIBLE)
def visible_view(spark, sf_dir):
    layers, visibility = _layers(spark, sf_dir)
    return versioned.visible(layers, visibility)


@register(_VISIBLE)
def latest_version_wins(spark, sf_dir):
    layers, visibility = _layers(spark, sf_dir)
    return versioned.latest(layers, visibility.where(f"{versioned.TARGET} = {versioned.DELETED}").select(ROW_ID))


@register(f"SELECT count(*) AS hits FROM ({_VISIBLE}) WHERE c_mktsegment = 'patched' AND c_nationkey <= 12")
def versioned_hits(spark, sf_dir):
    layers, visibility = _layers(spark, sf_dir)
    schema = SCHEMAS["customer"][1]
    found = Q.matches(versioned.visible(layers, visibility, schema), Request(filters=(Eq("c_mktsegment", "patched"), Range("c_nationkey", lte="12"))), schema)
    return found.agg(F.count("*").alias("hits"))


@register(f"""SELECT "_row_id", CASE "_row_id" WHEN 3 THEN 'renamed' ELSE c_name END AS c_name, CASE "_row_id" WHEN 5 THEN 77 ELSE c_nationkey END AS c_nationkey, c_mktsegment
FROM ({_CUSTOMER}) WHERE "_row_id" IN (3, 5)""")
def update_patch(spark, sf_dir):
    df, schema = view(spark, sf_dir, "customer")
    tx = mutation.prepare([mutation.Update(3, {"c_name": "x"}), mutation.Update(5, {"c_nationkey": "+77"}), mutation.Update(3, {"c_name": "renamed"})], schema)
    return mutation.patched(df, tx.updates, schema)


@register(f"SELECT count(*) AS hits FROM ({_VISIBLE}) WHERE c_mktsegment = 'building'")
def hits_minus_hidden(spark, sf_dir):
    """Hits of every layer, less the matches that a newer version or a tombstone hides."""
    layers, visibility = _layers(spark, sf_dir)
    rows = versioned.layered(layers).where(F.col("c_mktsegment") == "building")
    hidden = rows.join(visibility, ROW_ID).where(f"{versioned.TARGET} != {versioned.LAYER}")
    return rows.select(F.lit(1).alias("n")).unionByName(hidden.select(F.lit(-1).alias("n"))).agg(F.sum("n").alias("hits"))


def _customers(spark, sf_dir) -> Catalog:
    """The customers as a dataset on disk."""
    catalog = Catalog(spark, scratch(spark, "customers"))
    df, schema = view(spark, sf_dir, "customer")
    publish(catalog, df.drop(ROW_ID).orderBy("c_name"), schema)
    return catalog


def publish(catalog: Catalog, rows: DataFrame, schema: Schema) -> None:
    """Typed rows as the first generation, in their order."""
    import json

    from ..operators.catalog import Layer, Manifest

    with catalog.begin(empty=True) as staging:
        path = staging.write(versioned.dense_ids(materialised(rows)))
        n = staging.read(path).count()
        raw = json.loads(schema.to_json())
        staging.publish(Manifest(0, raw, [Layer(0, path, n, raw)], None, n, n - 1))


_BY_NAME = "SELECT row_number() OVER (ORDER BY c_name) - 1 AS _row_id, c_name, c_nationkey::BIGINT AS c_nationkey, lower(trim(c_mktsegment)) AS c_mktsegment FROM customer"
_MUTATED = f"""SELECT _row_id, c_name, CASE _row_id WHEN 4 THEN 99 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM ({_BY_NAME}) WHERE _row_id <> 2
UNION ALL SELECT count(*), 'New', 5, 'none' FROM customer"""


def _mutated(spark, sf_dir) -> Catalog:
    catalog = _customers(spark, sf_dir)
    mutation.apply(catalog, [mutation.Delete(2), mutation.Update(4, {"c_nationkey": "99"}), mutation.Insert({"c_name": "New", "c_nationkey": "5", "c_mktsegment": " NONE "})])
    return catalog


@register(_MUTATED)
def transaction(spark, sf_dir):
    return _mutated(spark, sf_dir).dataset().frame


@register(_MUTATED)
def compacted(spark, sf_dir):
    catalog = _mutated(spark, sf_dir)
    mutation.compact(catalog)
    return catalog.dataset().frame


@register("SELECT count(*) AS _row_id, 'New' AS c_name, 5::BIGINT AS c_nationkey, 'none' AS c_mktsegment FROM customer")
def insert_rows(spark, sf_dir):
    catalog = _mutated(spark, sf_dir)
    return catalog.dataset().frame.where(F.col("c_name") == "New")


@register(f"SELECT * FROM ({_BY_NAME}) WHERE _row_id % 3 <> 0")
def delete_tombstones(spark, sf_dir):
    layers = [(0, _customers(spark, sf_dir).dataset().frame)]
    gone = layers[0][1].where(F.col(ROW_ID) % 3 == 0).select(ROW_ID, F.lit(versioned.DELETED).alias(versioned.TARGET))
    return versioned.visible(layers, gone)


# -- schema evolution and set operations


@register("""SELECT c_custkey AS _row_id, c_name AS name, c_nationkey::BIGINT AS nation, c_mktsegment AS segment, NULL::BIGINT AS region FROM customer
UNION ALL SELECT n_nationkey + 1000000, n_name, NULL, NULL, n_regionkey FROM nation""")
def schema_evolution_union(spark, sf_dir):
    layers, schema = _evolved(spark, sf_dir)
    return versioned.visible(layers, None, schema)


def _evolved(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(ROW_ID), F.col("c_name").alias("name"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000000).cast("bigint").alias(ROW_ID), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"))
    schema = union([Schema((Column("name"), Column("nation", "signed"), Column("segment"))), Schema((Column("name"), Column("region", "signed")))])
    return [(0, a), (1, b)], schema


@register("SELECT n_nationkey + 1000000 AS _row_id, n_name AS name, NULL::BIGINT AS nation, NULL::VARCHAR AS segment, n_regionkey::BIGINT AS region FROM nation")
def layer_missing_column_is_null(spark, sf_dir):
    layers, schema = _evolved(spark, sf_dir)
    return Q.matches(versioned.visible(layers, None, schema), Request(filters=(Eq("segment", None),)), schema)


@register("""SELECT row_number() OVER (ORDER BY s, o_orderkey) - 1 AS _row_id, o_custkey, o_orderstatus, o_orderpriority FROM
(SELECT 0 AS s, * FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 1, * FROM orders WHERE o_orderstatus = 'F')""")
def bucket_combine(spark, sf_dir):
    return buckets.combined([_found(spark, sf_dir, "orders", Eq("o_orderstatus", s)) for s in ("P", "F")])


def _transferred(spark, sf_dir, move: bool) -> buckets.Buckets:
    """Nations of region 0 in the default bucket, of region 1 in another; the first two are transferred."""
    b = buckets.Buckets(spark, scratch(spark, "buckets"))
    b.create("other", "Other")
    schema = SCHEMAS["nation"][1]
    for bucket, region in (("default", 0), ("other", 1)):
        rows, _ = view(spark, sf_dir, "nation")
        publish(b.catalog(bucket), rows.where(F.col("n_regionkey") == region).orderBy(ROW_ID).drop(ROW_ID), schema)
    b.transfer("default", "other", [1, 0], move)
    return b


_NATIONS = "SELECT n_name, n_regionkey::BIGINT AS n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation"


@register(f"""WITH n AS ({_NATIONS}) SELECT i AS _row_id, n_name, n_regionkey FROM n WHERE n_regionkey = 1
UNION ALL SELECT i + (SELECT max(c) FROM n WHERE n_regionkey = 1), n_name, n_regionkey FROM n WHERE n_regionkey = 0 AND i < 2""")
def bucket_transfer_copy(spark, sf_dir):
    return _transferred(spark, sf_dir, False).catalog("other").dataset().frame


@register(f"SELECT i AS _row_id, n_name, n_regionkey FROM ({_NATIONS}) WHERE n_regionkey = 0 AND i >= 2")
def bucket_transfer_move(spark, sf_dir):
    return _transferred(spark, sf_dir, True).catalog().dataset().frame


# -- statistics


@register("""SELECT 'o_custkey' AS "column", count(DISTINCT o_custkey) AS cardinality FROM orders UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders""")
def column_cardinality(spark, sf_dir):
    return indexes.cardinalities(*view(spark, sf_dir, "orders"))


@register("""SELECT 'user_id' AS "column", count(DISTINCT user_id) AS cardinality FROM events UNION ALL SELECT 'event_type', count(DISTINCT event_type) FILTER (event_type <> 'view') + 1 FROM events""")
def column_cardinality_nullable(spark, sf_dir):
    return indexes.cardinalities(*view(spark, sf_dir, "events"))


@register("SELECT count(*) AS visible_rows, count(*) - 1 AS max_row_id, 3::BIGINT AS columns, 1::BIGINT AS layers FROM customer")
def dataset_stats(spark, sf_dir):
    s = _customers(spark, sf_dir).status()
    return spark.createDataFrame([(s["visible_rows"], s["max_row_id"], s["columns"], s["layers"])], "visible_rows bigint, max_row_id bigint, columns bigint, layers bigint")


# -- scalar functions


_EDGE = [
    (0, "007"), (1, "+12"), (2, "-0"), (3, ""), (4, " 5"), (5, "1e3"), (6, "18446744073709551615"), (7, "18446744073709551616"), (8, "9223372036854775807"), (9, "-9223372036854775808"),
    (10, "-9223372036854775809"), (11, "5\n"), (12, "TRUE"), (13, "0"), (14, " false "), (15, "yes"), (16, "٣"), (17, None), (18, "NULL"), (19, "00000000000000000000000000042"),
]


def _edge(spark, spec: Column) -> DataFrame:
    raw = spark.createDataFrame(_EDGE, "id bigint, raw string")
    return raw.select("id", canonical.text(canonical.stored(F.col("raw"), spec), spec).alias("value"), canonical.problem(F.col("raw"), spec).isNotNull().alias("bad"))


def _rows(values: dict[int, str | None], bad: set[int]) -> str:
    cells = [f"({i}::BIGINT, {'NULL' if values.get(i) is None else repr(values[i])}::VARCHAR, {i in bad})" for i, _ in _EDGE]
    return f"SELECT * FROM (VALUES {', '.join(cells)}) AS t(id, value, bad)"


_NUMBERS = {0: "7", 1: "12", 8: "9223372036854775807", 13: "0", 19: "42"}


@register(_rows(_NUMBERS | {6: "18446744073709551615"}, set(range(20)) - {0, 1, 6, 8, 13, 19}))
def canonical_unsigned(spark, sf_dir):
    return _edge(spark, Column("x", "unsigned"))


@register(_rows(_NUMBERS | {2: "0", 9: "-9223372036854775808"}, set(range(20)) - {0, 1, 2, 8, 9, 13, 19}))
def canonical_signed(spark, sf_dir):
    return _edge(spark, Column("x", "signed"))


@register(_rows({12: "true", 13: "false", 14: "false"}, set(range(20)) - {12, 13, 14, 17, 18}))
def canonical_boolean(spark, sf_dir):
    return _edge(spark, Column("x", "boolean", nullable=True, null_values=("NULL",)))


@register("SELECT c_custkey AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) END AS value FROM customer")
def null_literals(spark, sf_dir):
    spec = Column("x", "text", True, "lowercase", ("BUILDING",))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), canonical.stored(F.col("c_mktsegment"), spec).alias("value"))


@register("SELECT c_custkey AS id, c_name AS raw FROM customer")
def reject_invalid(spark, sf_dir):
    spec = Column("c_name", "unsigned")
    df = table(spark, sf_dir, "customer")
    return df.where(canonical.problem(F.col("c_name"), spec).isNotNull()).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("raw"))


# -- workload analytics: events as a query log


def _log(spark, sf_dir) -> DataFrame:
    shape = F.when(F.col("event_type") == "view", F.array(F.lit("a"), F.lit("b"))).when(F.col("event_type") == "click", F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.col("event_type")))
    return table(spark, sf_dir, "events").select(
        shape.alias("columns"), shape.alias("equality_columns"), F.when(F.col("user_id") % 2 == 0, F.array(F.lit("eq"))).otherwise(F.array(F.lit("eq"), F.lit("in"))).alias("operators"),
        F.round(F.col("value") * 1000).cast("bigint").alias("elapsed_micros"), F.col("user_id").alias("rows_examined"),
        F.when(F.col("event_type") == "view", F.array(F.lit("a+b"))).otherwise(F.array().cast("array<string>")).alias("used_indexes"),
    )


_LOG = """SELECT CASE event_type WHEN 'view' THEN ['a', 'b'] WHEN 'click' THEN ['b', 'c'] ELSE [event_type] END AS columns,
CASE WHEN user_id % 2 = 0 THEN ['eq'] ELSE ['eq', 'in'] END AS operators, round(value * 1000)::BIGINT AS t, user_id AS e, event_type FROM events"""
_AT = "list_sort(list(t))[cast(round((count(*) - 1) * {}) AS INT) + 1]"


@register(f"SELECT array_to_string(columns, ',') AS columns, array_to_string(operators, ',') AS operators, count(*) AS queries, {_AT.format(0.5)} AS p50_micros, {_AT.format(0.95)} AS p95_micros, {_AT.format(0.99)} AS p99_micros, avg(e) AS avg_rows_examined, max(e) AS max_rows_examined FROM ({_LOG}) GROUP BY columns, operators")
def workload_shapes(spark, sf_dir):
    found = telemetry.shapes(_log(spark, sf_dir))
    return found.withColumns({"columns": F.array_join("columns", ","), "operators": F.array_join("operators", ",")})


@register(f"SELECT count(*) AS query_count, {_AT.format(0.5)} AS p50_micros, {_AT.format(0.95)} AS p95_micros, {_AT.format(0.99)} AS p99_micros FROM ({_LOG})")
def workload_percentiles(spark, sf_dir):
    return telemetry.overall(_log(spark, sf_dir))


@register("SELECT 'a+b' AS index, count(*) AS queries FROM events WHERE event_type = 'view'")
def index_use(spark, sf_dir):
    return telemetry.index_use(_log(spark, sf_dir))


@register("SELECT 'b,c' AS columns, count(*) AS observed_queries, avg(user_id) AS avg_rows_examined, round(count(*) * ln(avg(user_id) + 2), 6) AS score FROM events WHERE event_type = 'click'")
def index_recommendations(spark, sf_dir):
    found = telemetry.recommendations(_log(spark, sf_dir), [["b", "a"]])
    return found.withColumns({"columns": F.array_join("columns", ","), "score": F.round("score", 6)})


# -- sources and sinks


@register("SELECT count(*) AS n, min(i) AS first, max(i) AS last, count(DISTINCT i) AS ids FROM (SELECT row_number() OVER () - 1 AS i FROM lineitem)")
def shard_global_row_id(spark, sf_dir):
    return attached.frame(spark, [f"{sf_dir}/lineitem.parquet"]).agg(F.count("*").alias("n"), F.min(ROW_ID).alias("first"), F.max(ROW_ID).alias("last"), F.count_distinct(ROW_ID).alias("ids"))


@register("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation WHERE n_name >= 'NATION_2' AND n_name <= 'NATION_5' AND n_regionkey IN (0, 1, 2)")
def attached_scan(spark, sf_dir):
    found = attached.Attached(spark, [f"{sf_dir}/nation.parquet"])
    request = Request(filters=(Range("n_name", "NATION_2", "NATION_5"), In("n_regionkey", ("0", "1", "2"))), select=("n_nationkey", "n_name"), limit=1000)
    return found.page(request).drop(ROW_ID)


@register("""SELECT '{"r_name":"' || r_name || '","r_regionkey":"' || r_regionkey || '"}' AS line FROM region""")
def export_jsonl_lines(spark, sf_dir):
    return export.jsonl_lines(table(spark, sf_dir, "region"), ["r_regionkey", "r_name", "r_name"])


@register("SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
def export_csv_lines(spark, sf_dir):
    return export.csv_lines(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


def _as_files(spark, sf_dir, kind: str) -> tuple[str, Schema]:
    """Customers as a CSV, JSON-lines, JSON or Parquet folder, for the imports."""
    schema = Schema((Column("c_custkey", "unsigned"), Column("c_name"), Column("c_mktsegment", nullable=True, normalization="trim_lowercase", null_values=("MACHINERY",))))
    df = table(spark, sf_dir, "customer").select("c_mktsegment", "c_name", "c_custkey")
    folder = scratch(spark, kind)
    if kind == "csv":
        df.coalesce(2).write.option("header", True).csv(folder)
    elif kind == "jsonl":
        df.write.json(folder)
    elif kind == "json":
        df.coalesce(1).select(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(folder)  # one small file, the format under test
    else:
        df.write.parquet(folder)
    return folder, schema


_IMPORTED = "SELECT c_custkey::DECIMAL(20,0) AS c_custkey, c_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN lower(c_mktsegment) END AS c_mktsegment FROM customer"
_KEPT = "SELECT c_custkey::DECIMAL(20,0) AS c_custkey, c_name, lower(c_mktsegment) AS c_mktsegment FROM customer"


def _imported(spark, sf_dir, kind: str) -> Catalog:
    folder, schema = _as_files(spark, sf_dir, kind)
    catalog = Catalog(spark, scratch(spark, "imported"))
    if kind == "csv":
        imports.import_csv(catalog, folder, schema, [["c_name", "c_mktsegment"]], initial=True)
    elif kind == "parquet":
        imports.import_parquet(catalog, [folder], schema)
    else:
        imports.import_external(catalog, folder, schema, kind)
    return catalog


@register(_IMPORTED)
def import_strict_csv(spark, sf_dir):
    return _imported(spark, sf_dir, "csv").dataset().frame.drop(ROW_ID)


@register(_IMPORTED)
def import_tolerant_csv(spark, sf_dir):
    folder, schema = _as_files(spark, sf_dir, "csv")
    catalog = Catalog(spark, scratch(spark, "imported"))
    imports.import_external(catalog, folder, schema, "csv")
    return catalog.dataset().frame.drop(ROW_ID)


@register(_KEPT)
def import_jsonl(spark, sf_dir):
    """Null literals don't apply to JSON strings."""
    return _imported(spark, sf_dir, "jsonl").dataset().frame.drop(ROW_ID)


@register(_KEPT)
def import_json(spark, sf_dir):
    return _imported(spark, sf_dir, "json").dataset().frame.drop(ROW_ID)


@register(_KEPT)
def import_parquet_shards(spark, sf_dir):
    return _imported(spark, sf_dir, "parquet").dataset().frame.drop(ROW_ID)


@register("SELECT count(*) AS rows, count(*) - 1 AS last, ceil(count(*) / 400.0)::BIGINT AS layers FROM customer")
def import_segmented(spark, sf_dir):
    folder, schema = _as_files(spark, sf_dir, "csv")
    catalog = Catalog(spark, scratch(spark, "segmented"))
    imports.import_segmented(catalog, folder, schema, rows_per_part=400)
    m = catalog.manifest()
    return catalog.dataset().frame.agg(F.count("*").alias("rows"), F.max(ROW_ID).alias("last")).withColumn("layers", F.lit(len(m.layers)).cast("bigint"))


@register("SELECT count(*) * 2 AS rows, count(*) * 2 - 1 AS last, count(*) AS without FROM customer")
def append_evolution(spark, sf_dir):
    catalog = _imported(spark, sf_dir, "csv")
    folder = scratch(spark, "more")
    table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_name", "c_custkey").coalesce(1).write.option("header", True).csv(folder)
    imports.append_csv(catalog, folder, Schema((Column("c_custkey", "unsigned"), Column("c_name"), Column("nation", "signed"))))
    d = catalog.dataset()
    lacking = Q.hits(d.frame, Request(filters=(Eq("nation", None),)), d.schema)
    return d.frame.agg(F.count("*").alias("rows"), F.max(ROW_ID).alias("last")).withColumn("without", F.lit(lacking).cast("bigint"))


@register("SELECT n_nationkey + 0 AS _row_id, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation UNION ALL SELECT n_nationkey + 25, n_name, n_regionkey FROM nation")
def stream_append(spark, sf_dir):
    """Two micro-batches, one of them repeated, become a base and one delta layer."""
    catalog = Catalog(spark, scratch(spark, "stream"))
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").drop("n_nationkey")
    for batch in (0, 1, 1):
        append_batch(catalog, rows, SCHEMAS["nation"][1], "s", batch)
    return catalog.dataset().frame


# -- candidates for accelerators


@register("SELECT 0::BIGINT AS place, '1,2' AS columns UNION ALL SELECT 1, '0,2' UNION ALL SELECT 2, '0,1'")
def index_portfolio(spark, sf_dir):
    found = indexes.portfolio([3, 5, 25], 3, 10, 200)
    return spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(found)], "place bigint, columns string")
