"""The named queries over the driver's tables and their SQL.

The tables stand in for a store: region, nation, customer and order are the levels of the
keys; customer segments, order prices and line quantities are variables of their levels;
events are a record log (event_type the variable, user_id the location, props the version
keys, ts the time, event_id the record).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalogue_store
from .functions import jsonmaps, keys as key_functions
from .functions.hashing import digest
from .operators import combos, filters, latest as newest, tables
from .plans import graph, lineage, state
from .schema import DatasetSchema
from .sources.store import checkpoint_folder
from .streaming import latest as stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SCHEMA = DatasetSchema(["o_custkey", "o_orderkey"])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return _QUERIES | catalogue_store.queries_and_sql()[0]


def oracle_sql() -> dict[str, str]:
    return _SQL | catalogue_store.queries_and_sql()[1]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LATEST = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts DESC, event_id DESC) AS rn FROM events {where}) WHERE rn = 1"


# --- latest versions -------------------------------------------------------------------


@query(_LATEST.format(cols="event_type, user_id, props, event_id, value", by="event_type, user_id, props", where=""))
def latest_per_variant(spark, sf_dir):
    log = _t(spark, sf_dir, "events")
    return newest.latest(log, ["event_type", "user_id", "props"], "ts", "event_id").select("event_type", "user_id", "props", "event_id", "value")


@query(_LATEST.format(cols="event_type, user_id, event_id, value", by="event_type, user_id", where=""))
def latest_per_location(spark, sf_dir):
    log = _t(spark, sf_dir, "events")
    return newest.latest(log, ["event_type", "user_id"], "ts", "event_id").select("event_type", "user_id", "event_id", "value")


@query(_LATEST.format(cols="event_type, user_id, event_id, value", by="event_type, user_id", where=""))
def stream_latest_per_location(spark, sf_dir):
    """The log arrives in files, in no order of time; the state goes from batch to batch."""
    folder, by = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}", ["event_type", "user_id"]
    log = _t(spark, sf_dir, "events").select("event_type", "user_id", "ts", "event_id", "value")
    log.repartition(8, "event_id").write.parquet(f"{folder}/log")
    stream.publish_latest(spark, f"{folder}/log", log.schema, f"{folder}/out", by, "ts", "event_id", f"{folder}/marks", files=3).awaitTermination()
    return stream.published(spark, f"{folder}/out", by, "ts", "event_id").select("event_type", "user_id", "event_id", "value")


@query(_LATEST.format(cols="event_type, user_id, event_id, value", by="event_type, user_id", where="WHERE event_type <> 'error' AND event_id % 7 <> 0"))
def latest_excluding(spark, sf_dir):
    log = _t(spark, sf_dir, "events")
    marks = log.where("event_type = 'error' OR event_id % 7 = 0").select("event_id", F.col("ts").alias("timestamp"), F.lit(True).alias("excluded"))
    return newest.latest(newest.excluded(log, marks, "event_id"), ["event_type", "user_id"], "ts", "event_id").select("event_type", "user_id", "event_id", "value")


@query(_LATEST.format(cols="event_type, user_id, event_id, value", by="event_type, user_id, props", where="WHERE user_id IN (1, 3, 5, 7, 11, 13)"))
def record_scan_in_list(spark, sf_dir):
    log = _t(spark, sf_dir, "events").where(F.col("user_id").isin(1, 3, 5, 7, 11, 13))
    return newest.latest(log, ["event_type", "user_id", "props"], "ts", "event_id").select("event_type", "user_id", "event_id", "value")


@query("SELECT event_type, user_id, event_id, value FROM (" + _LATEST.format(cols="*", by="event_type, user_id, props", where="") + ") WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) = 3")
def version_key_filter(spark, sf_dir):
    log = newest.latest(_t(spark, sf_dir, "events"), ["event_type", "user_id", "props"], "ts", "event_id")
    return log.where(F.get_json_object("props", "$.k") == "3").select("event_type", "user_id", "event_id", "value")


@query("SELECT event_id, event_type, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def head_n(spark, sf_dir):
    return newest.head(_t(spark, sf_dir, "events"), 10, "ts", "event_id").select("event_id", "event_type", "user_id", "value")


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3")
def topk_latest(spark, sf_dir):
    return newest.latest(_t(spark, sf_dir, "events"), ["event_type", "user_id"], "ts", "event_id", n=3).select("event_type", "user_id", "event_id")


@query("SELECT event_type, user_id, CAST(count(*) AS BIGINT) AS n_versions, max(event_id) AS newest_id FROM events GROUP BY event_type, user_id")
def list_versions(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n_versions"), F.max("event_id").alias("newest_id"))


# --- views and catalog -----------------------------------------------------------------


@query(
    """SELECT o_orderkey, c_custkey, c_mktsegment, n_name, r_name, o_totalprice FROM orders
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def variable_view(spark, sf_dir):
    o, c, n, r = (_t(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left").join(r, F.col("n_regionkey") == r.r_regionkey, "left")
    return joined.select("o_orderkey", "c_custkey", "c_mktsegment", "n_name", "r_name", "o_totalprice")


@query("SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL")
def distinct_values(spark, sf_dir):
    return combos.distinct_values(_t(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT DISTINCT event_type, user_id FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL")
def distinct_combos(spark, sf_dir):
    return combos.distinct_combos(_t(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("SELECT key FROM (SELECT CAST(c_nationkey AS VARCHAR) AS key FROM customer UNION SELECT CAST(s_nationkey AS VARCHAR) FROM supplier)")
def distinct_from_inputs(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"))
    return combos.distinct_from([c, s, _t(spark, sf_dir, "region")], "key")


@query("SELECT event_type AS variable, CAST(count(*) AS BIGINT) AS n_entries, CAST(count(DISTINCT user_id) AS BIGINT) AS n_locations FROM events GROUP BY event_type")
def variable_summary(spark, sf_dir):
    log = _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variable"))
    return log.agg(F.count(F.lit(1)).alias("n_entries"), F.countDistinct("user_id").alias("n_locations"))


# --- filters ---------------------------------------------------------------------------


def _orders(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")


def _values(spark, sf_dir):
    """The variables that filter: by name, their rows and their level."""
    o = _orders(spark, sf_dir)
    c = _t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    found = {
        "Segment": (c.select("o_custkey", F.col("c_mktsegment").alias("value")), ["o_custkey"]),
        "Balance": (c.select("o_custkey", F.col("c_acctbal").alias("value")), ["o_custkey"]),
        "Priority": (o.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("value")), ["o_custkey", "o_orderkey"]),
        "Price": (o.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("value")), ["o_custkey", "o_orderkey"]),
    }
    return found.__getitem__


def _filtered(spark, sf_dir, tree) -> DataFrame:
    return filters.resolve(tree, _orders(spark, sf_dir), SCHEMA, _values(spark, sf_dir), validate=False).select("o_orderkey", "o_totalprice")


_PRIORITY = filters.Compare("Priority", "value", "==", "1-URGENT")
_SEGMENT = filters.Compare("Segment", "value", "==", "BUILDING")
_PRICE = filters.Compare("Price", "value", ">", 200000.0)
_SEGMENT_SQL = "EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')"


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def filter_same_level(spark, sf_dir):
    return _filtered(spark, sf_dir, _PRIORITY)


@query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {_SEGMENT_SQL})")
def filter_coarse_to_fine(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    c = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")
    return filters.expand(line, filters.expand(o, c, ["o_custkey"]).select("l_orderkey"), ["l_orderkey"])


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND {_SEGMENT_SQL}")
def filter_and(spark, sf_dir):
    return _filtered(spark, sf_dir, _PRIORITY & _SEGMENT)


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 OR {_SEGMENT_SQL}")
def filter_or(spark, sf_dir):
    return _filtered(spark, sf_dir, _PRICE | _SEGMENT)


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE NOT ({_SEGMENT_SQL} AND o_totalprice > 200000)")
def filter_not(spark, sf_dir):
    return _filtered(spark, sf_dir, ~(_SEGMENT & _PRICE))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))")
def filter_isin(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.Compare("Segment", "value", "in", ("BUILDING", "MACHINERY")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE \"o_totalprice\" BETWEEN 50000 AND 90000 AND o_orderstatus <> 'F'")
def filter_raw_sql(spark, sf_dir):
    return _filtered(spark, sf_dir, filters.raw_sql("\"o_totalprice\" BETWEEN 50000 AND 90000 AND o_orderstatus <> 'F'"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def coverage_missing(spark, sf_dir):
    urgent = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return filters.uncovered(_t(spark, sf_dir, "customer"), urgent, ["c_custkey"])


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 40 OR NOT (p_brand = 'Brand#11')")
def where_col(spark, sf_dir):
    tree = (filters.Col("p_size") > 40) | ~(filters.Col("p_brand") == "Brand#11")
    return _t(spark, sf_dir, "part").where(filters.table_condition(tree)).select("p_partkey", F.col("p_size"))


@query("SELECT p_partkey, p_retailprice FROM part")
def column_selection(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", "p_retailprice")


# --- combinations, aggregation, joins --------------------------------------------------


@query(
    """SELECT t.event_type, u.user_id FROM (SELECT DISTINCT event_type FROM events) t CROSS JOIN (SELECT unnest([1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]) AS user_id) u
    WHERE EXISTS (SELECT 1 FROM events e WHERE e.event_type = t.event_type AND e.user_id = u.user_id)"""
)
def combo_product_existing(spark, sf_dir):
    log = _t(spark, sf_dir, "events").withColumn("user_id", F.col("user_id").cast("string"))
    wanted = combos.product(spark, {"event_type": combos.distinct_values(log, "event_type"), "user_id": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144.0]})
    return combos.existing(wanted, log, ["event_type", "user_id"]).select("event_type", F.col("user_id").cast("long").alias("user_id"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM orders GROUP BY o_custkey")
def aggregation_mode_partial(spark, sf_dir):
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(total, 2).alias("total"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, max(o_totalprice) AS most FROM orders")
def aggregation_mode_full(spark, sf_dir):
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return _t(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.round(total, 2).alias("total"), F.max("o_totalprice").alias("most"))


_L = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"


@query(f"SELECT a.event_type, a.user_id, round(a.value - b.value, 6) AS delta FROM {_L} a JOIN {_L} b ON a.user_id = b.user_id AND b.event_type = 'view'")
def fixed_baseline_delta(spark, sf_dir):
    now = newest.latest(_t(spark, sf_dir, "events"), ["event_type", "user_id"], "ts", "event_id").select("event_type", "user_id", "value")
    base = tables.fixed(now, {"event_type": "view"}).withColumnRenamed("value", "base")
    return now.join(base, "user_id").select("event_type", "user_id", F.round(F.col("value") - F.col("base"), 6).alias("delta"))


_P = "(SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE event_type = '{0}')"


@query(f"SELECT a.user_id, CAST(a.pos AS BIGINT) AS pos, a.value AS view_value, b.value AS click_value FROM {_P.format('view')} a JOIN {_P.format('click')} b USING (user_id, pos)")
def merge_positional(spark, sf_dir):
    log = _t(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sides = [
        log.where(F.col("event_type") == kind).select("user_id", F.row_number().over(order).cast("long").alias("pos"), F.col("value").alias(f"{kind}_value"))
        for kind in ("view", "click")
    ]
    return tables.merge_shared(sides)


@query("SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_broadcast(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return tables.merge_positional([o, c], ["o_custkey"], [["o_orderkey"], ["c_mktsegment"]]).select("o_orderkey", "o_totalprice", "c_mktsegment")


@query("SELECT n_nationkey, n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def merge_join_shared(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return tables.merge_shared([n, s])


@query(
    " UNION ALL ".join(f"SELECT user_id, '{v}' AS variant, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > {v} GROUP BY user_id" for v in (10, 50, 90))
)
def each_of_constants(spark, sf_dir):
    log = _t(spark, sf_dir, "events")
    return tables.concat_variants({str(v): log.where(F.col("value") > v).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")) for v in (10, 50, 90)})


@query(
    f"""SELECT o_orderkey, 'urgent' AS variant FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderkey, 'building' AS variant FROM orders WHERE {_SEGMENT_SQL}"""
)
def each_of_where(spark, sf_dir):
    return tables.concat_variants({"urgent": _filtered(spark, sf_dir, _PRIORITY).select("o_orderkey"), "building": _filtered(spark, sf_dir, _SEGMENT).select("o_orderkey")})


@query("SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS sample, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
def distribute_embedding(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("value"))
    out = tables.distribute(e, "value", "sample")
    return out.select("vec_id", F.col("sample").cast("long").alias("sample"), F.col("value").cast("double").alias("value"))


@query(
    """SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling
    FROM events WHERE event_type = 'view'"""
)
def rolling_mean(spark, sf_dir):
    log = _t(spark, sf_dir, "events").where("event_type = 'view'")
    return tables.rolling_mean(log, ["user_id"], ["ts", "event_id"], "value", 5, "mean").select("user_id", "event_id", F.round("mean", 6).alias("rolling"))


@query(
    """SELECT v.event_id, v.user_id, p.value AS last_purchase FROM events v ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON v.user_id = p.user_id AND v.ts >= p.ts WHERE v.event_type = 'view'"""
)
def as_of_join(spark, sf_dir):
    log = _t(spark, sf_dir, "events")
    views, bought = log.where("event_type = 'view'").select("event_id", "user_id", "ts"), log.where("event_type = 'purchase'")
    return tables.as_of(views, bought, ["user_id"], "ts", "value", "last_purchase").select("event_id", "user_id", "last_purchase")


# --- variants and JSON keys ------------------------------------------------------------


@query("SELECT event_type, props, CAST(count(DISTINCT event_id) AS BIGINT) AS n_records FROM events GROUP BY event_type, props")
def list_variants(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type", "props").agg(F.countDistinct("event_id").alias("n_records"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'k=' || json_extract_string(props, '$.k') || ', type=' || event_type AS label FROM events WHERE json_extract_string(props, '$.k') = '4'")
def branch_suffix_match(spark, sf_dir):
    log = _t(spark, sf_dir, "events")
    entries = F.map_from_arrays(F.array(F.lit("filter.k"), F.lit("filter.type")), F.array(F.get_json_object("props", "$.k"), F.col("event_type")))
    found = log.withColumn("params", entries).withColumn("hits", jsonmaps.suffix_matches(F.col("params"), "k"))
    return found.where((F.size("hits") == 1) & (F.map_values("hits")[0] == "4")).select("event_id", F.map_values("hits")[0].alias("k"), jsonmaps.variant_label(F.col("params")).alias("label"))


@query(
    """WITH c AS (SELECT event_id, user_id, json_extract_string(props, '$.k') AS k, CAST(floor(value) AS BIGINT) % 2 AS side FROM events WHERE event_type = 'click'),
    v AS (SELECT event_id AS parent, user_id, CASE WHEN event_id % 3 > 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 2 THEN CAST(floor(value) AS BIGINT) % 2 END AS side FROM events WHERE event_type = 'view')
    SELECT event_id, parent, CAST(n AS BIGINT) AS n FROM (
      SELECT c.event_id, v.parent, (v.k IS NOT NULL)::INT + (v.side IS NOT NULL)::INT AS n, row_number() OVER (PARTITION BY c.event_id ORDER BY (v.k IS NOT NULL)::INT + (v.side IS NOT NULL)::INT DESC, v.parent DESC) AS place
      FROM c JOIN v ON c.user_id = v.user_id AND (v.k IS NULL OR v.k = c.k) AND (v.side IS NULL OR v.side = c.side)) WHERE place = 1"""
)
def json_subset_best_match(spark, sf_dir):
    """Views with no parameter, one or two: each click's is the one with most of its parameters."""
    log = _t(spark, sf_dir, "events")
    k, side = F.get_json_object("props", "$.k"), F.floor("value").cast("long") % 2
    two = F.map_from_arrays(F.array(F.lit("f.k"), F.lit("g.side")), F.array(k, side.cast("string")))
    some = F.map_filter(two, lambda name, _: ((name == "f.k") & (F.col("event_id") % 3 > 0)) | ((name == "g.side") & (F.col("event_id") % 3 == 2)))
    children = log.where("event_type = 'click'").select(F.col("event_id").alias("child"), F.lit("x").alias("param"), F.lit("View").alias("input"), two.alias("own"), "user_id")
    views = log.where("event_type = 'view'").select(F.col("event_id").alias("record_id"), F.lit("View").alias("variable_name"), some.alias("params"), "user_id")
    found = lineage.best_parents(children, views, ["user_id"])
    return found.join(views.select(F.col("record_id").alias("parent"), F.size("params").cast("long").alias("n")), "parent").select(F.col("child").alias("event_id"), "parent", "n")


@query("SELECT DISTINCT event_type AS function_name, 'k' AS input, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS target FROM events")
def pipeline_structure(spark, sf_dir):
    log = _t(spark, sf_dir, "events").withColumn("inputs", F.array_sort(F.json_object_keys("props")))
    return log.select(F.col("event_type").alias("function_name"), F.array_join("inputs", ",").alias("input"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("target")).distinct()


# --- lineage and states ----------------------------------------------------------------

_EDGES_SQL = """edges AS (SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def _edges(spark, sf_dir) -> DataFrame:
    """The lineage of every order, customer and nation."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    o, c, n = (_t(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (
        o.select(name("o", "o_orderkey").alias("child"), name("c", "o_custkey").alias("parent"))
        .union(c.select(name("c", "c_custkey"), name("n", "c_nationkey")))
        .union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    )


_CLOSURE_SQL = f"""WITH RECURSIVE {_EDGES_SQL}, up(node, ancestor, hops) AS (SELECT child, parent, 1 FROM edges
    UNION ALL SELECT up.node, e.parent, hops + 1 FROM up JOIN edges e ON e.child = up.ancestor WHERE hops < 20)"""


@query(f"{_CLOSURE_SQL} SELECT node, ancestor, CAST(min(hops) AS BIGINT) AS hops FROM up WHERE node LIKE 'o%' GROUP BY node, ancestor")
def provenance_closure(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return lineage.ancestors(edges, hops=20, start=edges.where("child LIKE 'o%'").select(F.col("child").alias("node"))).select("node", "ancestor", F.col("hops").cast("long").alias("hops"))


@query(f"{_CLOSURE_SQL} SELECT node, bool_or(ancestor IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0)) AS superseded FROM up WHERE node LIKE 'o%' GROUP BY node")
def superseded_ancestors(spark, sf_dir):
    stale = _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("record_id"))
    return lineage.superseded(_edges(spark, sf_dir), stale, hops=50).where("node LIKE 'o%'")


_STATE_SQL = """SELECT c_custkey, CASE WHEN o.last IS NULL THEN 'missing' WHEN o.last < TIMESTAMP '1998-06-01' THEN 'stale' ELSE 'up_to_date' END AS state
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) o ON o_custkey = c_custkey"""


def _states(spark, sf_dir) -> DataFrame:
    expected = _t(spark, sf_dir, "customer").select("c_custkey", F.lit("1998-06-01").cast("timestamp_ntz").alias("input_time"), "c_nationkey")
    made = _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("output_time"))
    return state.combo_states(expected, made, ["c_custkey"])


@query(_STATE_SQL)
def combo_state(spark, sf_dir):
    return _states(spark, sf_dir).select("c_custkey", "state")


@query(
    f"""SELECT n_name AS node, CASE WHEN bool_or(state = 'stale') THEN 'red' WHEN bool_or(state = 'missing') AND NOT bool_or(state = 'up_to_date') THEN 'red'
    WHEN bool_or(state = 'missing') THEN 'grey' ELSE 'green' END AS state FROM ({_STATE_SQL}) s JOIN customer USING (c_custkey) JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""
)
def node_state(spark, sf_dir):
    named = _states(spark, sf_dir).join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("n_name", "node")
    return state.node_states(named, "node")


@query(
    """WITH RECURSIVE own AS (SELECT 'n' || n_nationkey AS node, CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank FROM nation
      UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey = 2 THEN 0 ELSE 2 END FROM region
      UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_acctbal < 0 THEN 1 ELSE 2 END FROM supplier),
    edges AS (SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
    up(node, ancestor) AS (SELECT node, node FROM own UNION ALL SELECT up.node, e.parent FROM up JOIN edges e ON e.child = up.ancestor)
    SELECT up.node, CASE min(rank) WHEN 0 THEN 'red' WHEN 1 THEN 'grey' ELSE 'green' END AS effective FROM up JOIN own ON own.node = up.ancestor GROUP BY up.node"""
)
def dag_propagate(spark, sf_dir):
    n, r, s = (_t(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    colour = lambda red, grey: F.when(red, "red").when(grey, "grey").otherwise("green")
    own = (
        n.select(name("n", "n_nationkey").alias("node"), colour(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") % 3 == 1).alias("state"))
        .union(r.select(name("r", "r_regionkey"), colour(F.col("r_regionkey") == 2, F.lit(False))))
        .union(s.select(name("s", "s_suppkey"), colour(F.lit(False), F.col("s_acctbal") < 0)))
    )
    edges = s.select(name("s", "s_suppkey").alias("child"), name("n", "s_nationkey").alias("parent")).union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    return graph.propagate(own, edges)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1998-06-01')")
def skip_computed(spark, sf_dir):
    fresh = _states(spark, sf_dir).where("state = 'up_to_date'")
    return combos.missing(_t(spark, sf_dir, "customer").select("c_custkey"), fresh, ["c_custkey"])


# --- identity, functions, pass-through SQL ---------------------------------------------


@query("SELECT substr(sha256(text), 1, 16) AS content_hash, min(doc_id) AS first_id, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def dedup_by_content_hash(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(digest(F.col("text")).alias("content_hash"), "doc_id")
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS key FROM part")
def key_normalization(spark, sf_dir):
    return key_functions.norm_keys(_t(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("key")), ["key"])


@query("SELECT 'data/' || n_name || '/' || s_suppkey || '.csv' AS path, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def path_template(spark, sf_dir):
    from .sources.paths import PathTemplate

    s = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(PathTemplate("data/{n_name}/{s_suppkey}.csv").column().alias("path"), "s_suppkey")


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean_balance, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment")
def sql_group_avg(spark, sf_dir):
    _t(spark, sf_dir, "customer").createOrReplaceTempView("Customer")
    return spark.sql("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean_balance, count(*) AS n FROM Customer GROUP BY c_mktsegment")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def sql_two_var_join(spark, sf_dir):
    _t(spark, sf_dir, "customer").createOrReplaceTempView("Customer")
    _t(spark, sf_dir, "orders").createOrReplaceTempView("Price")
    return spark.sql("SELECT c_custkey, o_orderkey, o_totalprice FROM Customer JOIN Price ON o_custkey = c_custkey WHERE o_totalprice > :least", args={"least": 300000})


@query("SELECT event_type, user_id, round(max(value) - min(value), 6) AS spread, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type, user_id")
def user_fn_grouped_map(spark, sf_dir):
    from .plans.foreach import for_each

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"spread": [round(float(rows["value"].max() - rows["value"].min()), 6)], "n": [len(rows)]})

    log = _t(spark, sf_dir, "events").select("event_type", "user_id", "value")
    return for_each(spread, {"rows": log}, ["event_type", "user_id"], schema="spread double, n long", as_table=True, errors="raise")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    return line.cube("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def set_except(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey").subtract(_t(spark, sf_dir, "orders").where("o_totalprice > 250000").select("o_custkey"))


@query("SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_intersect(spark, sf_dir):
    log = _t(spark, sf_dir, "events")
    return log.where("event_type = 'view'").select("user_id").intersect(log.where("event_type = 'purchase'").select("user_id"))
