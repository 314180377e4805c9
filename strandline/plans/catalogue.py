"""Every registered query of the core with its DuckDB counterpart; `_add` files both under one name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import logtext, sqltext, tags
from strandline.operators import admin, catalog, ddl, dml, logs, metrics, relational, versioned
from strandline.sources import store
from strandline.sources.store import DAY
from strandline.sources.tables import scratch_folder, table, within
from strandline.streaming import rollup as streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(sql: str):
    def file(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return file


# --- scans, projections, filters


@_add("SELECT l_orderkey AS okey, l_linenumber AS line, l_quantity * 2 AS double_quantity FROM lineitem")
def scan_project(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), (F.col("l_quantity") * 2).alias("double_quantity"))


@_add("SELECT * FROM nation")
def select_star(s, d):
    return table(s, d, "nation").select("*")


@_add("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 33")
def point_get(s, d):
    return relational.point_get(table(s, d, "orders"), o_orderkey=33).select("o_orderkey", "o_custkey", "o_totalprice")


@_add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def key_range_scan(s, d):
    return relational.scan(table(s, d, "orders"), ["o_orderkey", "o_totalprice"], lo=("o_orderkey", 100), hi=("o_orderkey", 900))


@_add("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_eq(s, d):
    return table(s, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@_add("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount > 0.05")
def filter_range(s, d):
    return table(s, d, "lineitem").filter((F.col("l_quantity") < 10) & (F.col("l_discount") > 0.05)).select("l_orderkey", "l_linenumber")


@_add("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 10 AND l_discount >= 0.05 AND l_returnflag != 'N'")
def filter_le_ge_ne(s, d):
    return table(s, d, "lineitem").filter((F.col("l_quantity") <= 10) & (F.col("l_discount") >= 0.05) & (F.col("l_returnflag") != "N")).select("l_orderkey", "l_linenumber")


@_add("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR o_orderpriority = '1-URGENT'")
def filter_and_or(s, d):
    return table(s, d, "orders").filter(((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)) | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@_add("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def filter_in(s, d):
    return table(s, d, "nation").filter(F.col("n_regionkey").isin(1, 3)).select("n_nationkey", "n_name")


@_add("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20")
def filter_between(s, d):
    return table(s, d, "part").filter(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@_add("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45")
def filter_not_between(s, d):
    return table(s, d, "part").filter(~F.col("p_size").between(5, 45)).select("p_partkey")


@_add("SELECT c_custkey, CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NULL THEN 'none' ELSE lower(c_mktsegment) END AS segment FROM customer WHERE NOT (c_name LIKE '%7') AND c_custkey NOT IN (1, 2, 3)")
def filter_extended(s, d):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return table(s, d, "customer").filter(~F.col("c_name").like("%7") & ~F.col("c_custkey").isin(1, 2, 3)).select("c_custkey", F.when(segment.isNull(), "none").otherwise(F.lower("c_mktsegment")).alias("segment"))


@_add("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(s, d):
    return table(s, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@_add("SELECT * FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def set_operations(s, d):
    c, u = table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier")
    return c.subtract(u.filter("s_acctbal > 5000").select("s_nationkey")).unionAll(c.intersect(u.select("s_nationkey")))


@_add("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 5) SELECT o_custkey, n FROM big")
def cte_having(s, d):
    return s.sql("WITH big AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1 HAVING count(*) > 5) SELECT o_custkey, n FROM big", orders=table(s, d, "orders"))


# --- joins


@_add("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_hash_inner(s, d):
    return relational.hash_join(table(s, d, "orders"), table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@_add("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_hash_left(s, d):
    return relational.hash_join(table(s, d, "customer"), table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@_add("SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_extendedprice * 4 > o_totalprice")
def join_residual(s, d):
    more = (F.col("l_shipdate") > F.col("o_orderdate")) & (F.col("l_extendedprice") * 4 > F.col("o_totalprice"))
    return relational.hash_join(table(s, d, "lineitem"), table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), residual=more).select("l_orderkey", "l_linenumber", "o_totalprice")


@_add("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey")
def join_theta(s, d):
    return relational.theta_join(table(s, d, "nation"), table(s, d, "region"), F.col("n_regionkey") < F.col("r_regionkey")).select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"))


@_add("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a LEFT JOIN region b ON a.n_regionkey > b.r_regionkey + 1")
def join_theta_left(s, d):
    return relational.theta_join(table(s, d, "nation"), table(s, d, "region"), F.col("n_regionkey") > F.col("r_regionkey") + 1, "left").select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"))


@_add("SELECT n_name, r_name FROM nation, region")
def join_cross(s, d):
    return relational.theta_join(table(s, d, "nation").select("n_name"), table(s, d, "region").select("r_name"), None)


@_add("SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_multiway(s, d):
    joined = relational.multiway_join(
        table(s, d, "region"), (table(s, d, "nation"), F.expr("r_regionkey = n_regionkey")), (table(s, d, "customer"), F.expr("n_nationkey = c_nationkey")), (table(s, d, "orders"), F.expr("c_custkey = o_custkey"))
    )
    return relational.aggregate(joined, ["r_name"], n=F.count("*"), total=F.round(F.sum("o_totalprice"), 2))


@_add("SELECT a.s_suppkey, b.n_name FROM (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) a LEFT JOIN (SELECT nullif(n_nationkey, 5) AS k, n_name FROM nation) b ON a.k = b.k")
def join_null_keys(s, d):
    a = table(s, d, "supplier").select("s_suppkey", F.expr("nullif(s_nationkey, 3)").alias("k"))
    b = table(s, d, "nation").select(F.expr("nullif(n_nationkey, 5)").alias("m"), "n_name")
    return relational.hash_join(a, b, F.col("k") == F.col("m"), "left").select("s_suppkey", "n_name")


@_add("SELECT o_orderkey, c_custkey FROM orders FULL JOIN customer ON o_custkey = c_custkey AND o_totalprice > 200000")
def join_full(s, d):
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > 200000)
    return table(s, d, "orders").join(table(s, d, "customer"), on, "full").select("o_orderkey", "c_custkey")


@_add("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 200000")
def join_right(s, d):
    return table(s, d, "orders").filter("o_totalprice > 200000").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("o_orderkey", "c_custkey")


@_add("SELECT c_custkey, 'with' AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi_anti(s, d):
    c, o = table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("kind", F.lit("with")).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("kind", F.lit("without")))


@_add("SELECT event_type, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM events JOIN orders ON user_id = o_custkey GROUP BY 1")
def join_across_engines(s, d):
    return table(s, d, "events").join(table(s, d, "orders"), F.col("user_id") == F.col("o_custkey")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- aggregation


@_add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2")
def agg_group(s, d):
    return relational.aggregate(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], n=F.count("*"), quantity=F.round(F.sum("l_quantity"), 2), lo=F.min("l_extendedprice"), hi=F.max("l_extendedprice"))


@_add("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def agg_global(s, d):
    return relational.aggregate(table(s, d, "orders"), [], n=F.count("*"), total=F.round(F.sum("o_totalprice"), 2), lo=F.min("o_totalprice"), hi=F.max("o_totalprice"))


@_add("SELECT count(*) AS n, sum(o_totalprice) AS total, min(o_orderstatus) AS lo FROM orders WHERE o_orderkey < 0")
def agg_global_empty(s, d):
    return relational.aggregate(table(s, d, "orders").filter("o_orderkey < 0"), [], n=F.count("*"), total=F.sum("o_totalprice"), lo=F.min("o_orderstatus"))


@_add("SELECT o_orderpriority, count(*) AS n_rows, count(nullif(o_orderstatus, 'F')) AS n_values FROM orders GROUP BY 1")
def agg_count_null(s, d):
    return relational.aggregate(table(s, d, "orders"), ["o_orderpriority"], n_rows=F.count("*"), n_values=F.count(F.expr("nullif(o_orderstatus, 'F')")))


@_add("SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS n FROM orders GROUP BY 1")
def agg_group_null_key(s, d):
    return relational.aggregate(table(s, d, "orders"), [F.expr("nullif(o_orderstatus, 'F')").alias("status")], n=F.count("*"))


@_add("SELECT c_mktsegment, min(c_name) AS first_name, max(c_name) AS last_name FROM customer GROUP BY 1")
def agg_minmax_string(s, d):
    return relational.aggregate(table(s, d, "customer"), ["c_mktsegment"], first_name=F.min("c_name"), last_name=F.max("c_name"))


@_add("SELECT p_brand, sum(p_size)::BIGINT AS sizes FROM part GROUP BY 1")
def agg_sum_integer(s, d):
    return relational.aggregate(table(s, d, "part"), ["p_brand"], sizes=F.sum("p_size"))


@_add("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def agg_keys_only(s, d):
    return relational.aggregate(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@_add("SELECT l_suppkey, round(avg(l_quantity), 4) AS mean, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def agg_avg_distinct(s, d):
    return relational.aggregate(table(s, d, "lineitem"), ["l_suppkey"], mean=F.round(F.avg("l_quantity"), 4), parts=F.count_distinct("l_partkey"))


@_add("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


# --- order


@_add("SELECT row_number() OVER (ORDER BY k ASC NULLS FIRST, c_custkey DESC NULLS LAST) AS place, c_custkey FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS k FROM customer) ORDER BY k ASC NULLS FIRST, c_custkey DESC NULLS LAST")
def sort_multi_nulls(s, d):
    c = table(s, d, "customer").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("k"))
    return relational.numbered(relational.sort(c, ("k", True), ("c_custkey", False)), "place", f"{scratch_folder(s)}/sorted-{uuid.uuid4().hex}").select("place", "c_custkey")


@_add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def limit_offset_topk(s, d):
    return relational.page(relational.sort(table(s, d, "orders").select("o_orderkey", "o_totalprice"), ("o_totalprice", False), ("o_orderkey", True)), 10, 5)


@_add("SELECT o_orderkey FROM orders LIMIT 0")
def limit_zero(s, d):
    return relational.page(table(s, d, "orders").select("o_orderkey"), 0)


@_add("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def topk_per_group(s, d):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(s, d, "orders").withColumn("r", r).filter("r <= 2").select("o_custkey", "o_orderkey")


# --- metrics

_POINTS = "(SELECT event_id, epoch_us(ts) // 1000000 AS time, 'event_type=' || event_type || ',user_id=' || user_id AS tags, event_type AS metric_name, value, user_id FROM events)"


def _points(s, d, extra: tuple[str, ...] = (), between: tuple[int | None, int | None] = (None, None)):
    """Events as points; `between` bounds the stored timestamp, which the reader can skip row groups by."""
    e = within(table(s, d, "events"), "ts", *between)
    shaped = e.select(*extra, F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), F.concat(F.lit("event_type="), "event_type", F.lit(",user_id="), F.col("user_id").cast("string")).alias("tags"), F.col("event_type").alias("metric_name"), "value")
    return shaped


@_add(f"SELECT time, tags, metric_name, value FROM {_POINTS}")
def metrics_shape(s, d):
    e = table(s, d, "events")
    return metrics.shape(e, F.unix_seconds(F.col("ts").cast("timestamp")), F.concat(F.lit("event_type="), "event_type", F.lit(",user_id="), F.col("user_id").cast("string")), F.col("value"), F.col("event_type"))


@_add(f"SELECT time, tags, metric_name, value FROM {_POINTS} WHERE time BETWEEN 1704672000 AND 1705276800")
def metrics_range(s, d):
    return metrics.range_scan(_points(s, d, between=(1704672000, 1705276800)), 1704672000, 1705276800)


@_add(f"SELECT time, tags, metric_name, value FROM {_POINTS} WHERE metric_name = 'click' AND user_id = 7")
def metrics_tag_filter(s, d):
    return metrics.range_scan(_points(s, d), tags={"event_type": "click", "user_id": "7"})


@_add(f"SELECT 'event_type' AS tag, metric_name AS tag_value, event_id FROM {_POINTS} UNION ALL SELECT 'user_id', user_id::VARCHAR, event_id FROM {_POINTS}")
def metrics_tag_postings(s, d):
    return metrics.tag_postings(_points(s, d, ("event_id",)), "event_id")


@_add(f"SELECT event_id, time, tags, metric_name, value FROM {_POINTS} WHERE metric_name = 'error' AND user_id = 11 AND time >= 1704672000")
def metrics_indexed_scan(s, d):
    points = _points(s, d, ("event_id",))
    return metrics.indexed_scan(points, metrics.tag_postings(points, "event_id"), "event_id", {"event_type": "error", "user_id": "11"}, start=1704672000)


@_add("SELECT event_id, event_type AS a, user_id::VARCHAR AS b, NULL::VARCHAR AS missing FROM events")
def metrics_tag_map(s, d):
    messy = F.concat(F.lit('{ event_type = "'), "event_type", F.lit('" ,junk, user_id=0, user_id = '), F.col("user_id").cast("string"), F.lit(" }"))
    m = table(s, d, "events").select("event_id", tags.tags_to_map(messy).alias("m"))
    return m.select("event_id", F.try_element_at("m", F.lit("event_type")).alias("a"), F.try_element_at("m", F.lit("user_id")).alias("b"), F.try_element_at("m", F.lit("none")).alias("missing"))


def _rollup_sql(seconds: int, by: str = "") -> str:
    return f"SELECT {by}time // {seconds} * {seconds} AS bucket, count(value) AS count, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max FROM {_POINTS} GROUP BY ALL"


@_add(_rollup_sql(60))
def rollup_1m(s, d):
    return metrics.rollup(_points(s, d), 60, digits=6)


@_add(_rollup_sql(300))
def rollup_5m(s, d):
    return metrics.rollup(_points(s, d), 300, digits=6)


@_add(f"SELECT *, 60 AS resolution_s FROM ({_rollup_sql(60)}) UNION ALL SELECT *, 300 FROM ({_rollup_sql(300)})")
def rollup_multi(s, d):
    return metrics.rollups(_points(s, d), (60, 300), digits=6)


@_add(_rollup_sql(3600, "metric_name, "))
def rollup_by_series(s, d):
    return metrics.rollup(_points(s, d), 3600, ["metric_name"], digits=6)


@_add(f"SELECT * FROM ({_rollup_sql(3600)}) WHERE bucket BETWEEN 1704672000 AND 1705276800")
def rollup_scan(s, d):
    return metrics.rollup_scan(metrics.rollup(_points(s, d), 3600, digits=6), 1704672000, 1705276800)


@_add("SELECT * FROM (VALUES (-60::BIGINT, 1::BIGINT), (0::BIGINT, 2::BIGINT)) t(bucket, n)")
def rollup_negative_time(s, d):
    points = s.createDataFrame([(-61, 1.0), (-5, 2.0), (59, 3.0)], "time long, value double")
    return metrics.rollup(points, 60).select("bucket", F.col("count").alias("n"))


@_add(f"SELECT time, tags, metric_name, value FROM {_POINTS} WHERE time BETWEEN 1704672000 AND 1705276800")
def metrics_store_range(s, d):
    path = f"{scratch_folder(s)}/points-{uuid.uuid4().hex}"
    store.append(_points(s, d), path)
    return store.read(s, path, 1704672000, 1705276800)


# --- logs


@_add("SELECT event_id, CASE event_type WHEN 'error' THEN 4 WHEN 'view' THEN 1 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 5 ELSE 2 END AS number, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'FATAL' ELSE 'INFO' END AS name FROM events")
def log_severity(s, d):
    text = F.expr("CASE event_type WHEN 'error' THEN 'Error' WHEN 'view' THEN 'debug' WHEN 'purchase' THEN 'WARNING' WHEN 'signup' THEN 'critical' ELSE 'what' END")
    number = logtext.parse_severity(text)
    return table(s, d, "events").select("event_id", number.alias("number"), logtext.severity_to_string(number).alias("name"))


_RAW = """CASE event_id % 6 WHEN 0 THEN '{"pid": ' || event_id || ', "level": "error", "message": "queue ' || event_type || '", "node": "n-17"}'
 WHEN 1 THEN '{"severity":"WARN","message":"cache nearly full"}' WHEN 2 THEN '{"level":"INFO","node":"n-17"}' WHEN 3 THEN 'plain ' || event_type
 WHEN 4 THEN '[1, 2]' ELSE '{"level": 5, "status": "DEBUG", "msg": "worker ready"}' END"""


@_add(f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'queue ' || event_type WHEN 1 THEN 'cache nearly full' WHEN 5 THEN 'worker ready' ELSE {_RAW} END AS body,
 CASE event_id % 6 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' WHEN 5 THEN 'DEBUG' ELSE 'INFO' END AS severity,
 CASE event_id % 6 WHEN 0 THEN '{{"node":"n-17","pid":' || event_id || '}}' WHEN 5 THEN '{{"level":5}}' ELSE '' END AS attributes FROM events""")
def log_payload(s, d):
    return table(s, d, "events").selectExpr("event_id", "event_type", f"{_RAW} AS raw").select("event_id", logtext.parse_log_payload(F.col("raw")).alias("p")).select("event_id", "p.body", "p.severity", "p.attributes")


@_add(f"""SELECT epoch_us(ts) // 1000000 AS time, CASE WHEN event_type = 'error' THEN 'FATAL' WHEN event_id % 6 = 0 THEN 'ERROR' WHEN event_id % 6 = 1 THEN 'WARN' WHEN event_id % 6 = 5 THEN 'DEBUG' ELSE 'INFO' END AS severity,
 CASE event_id % 6 WHEN 0 THEN '{{"node":"n-17","pid":' || event_id || '}}' WHEN 5 THEN '{{"level":5}}' ELSE '' END AS attributes,
 CASE event_id % 6 WHEN 0 THEN 'queue ' || event_type WHEN 1 THEN 'cache nearly full' WHEN 5 THEN 'worker ready' ELSE {_RAW} END AS body FROM events""")
def log_shape_override(s, d):
    e = table(s, d, "events").selectExpr("*", f"{_RAW} AS raw")
    return logs.shape(e, F.unix_seconds(F.col("ts").cast("timestamp")), F.col("raw"), severity=F.when(F.col("event_type") == "error", "FATAL"))


@_add("SELECT epoch_us(ts) // 1000000 AS time, event_id FROM events WHERE epoch_us(ts) // 1000000 BETWEEN 1704672000 AND 1705276800")
def log_range(s, d):
    return logs.range_scan(within(table(s, d, "events"), "ts", 1704672000, 1705276800).select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), "event_id"), 1704672000, 1705276800)


@_add("SELECT doc_id FROM documents WHERE contains(text, 'and the')")
def log_substring(s, d):
    return logs.search_substring(table(s, d, "documents"), "%and the%", "text").select("doc_id")


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda t: octet_length(encode(t)) >= 2))"


@_add(f"SELECT doc_id, len({_TOKENS}) AS n, list_sort({_TOKENS})[1] AS first_token FROM documents")
def log_tokens(s, d):
    t = table(s, d, "documents").select("doc_id", logtext.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.get(F.sort_array("t"), F.lit(0)).alias("first_token"))


@_add(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations) WHERE list_contains(t, 'the') AND list_contains(t, 'and')")
def log_token_search(s, d):
    return logs.search_tokens(table(s, d, "conversations"), "The, AND the", "text").select("conv_id", "turn")


@_add(f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'the') AND list_contains(t, 'license')")
def log_postings_intersect(s, d):
    path = f"{scratch_folder(s)}/postings-{uuid.uuid4().hex}"
    logs.write_postings(logs.token_postings(table(s, d, "documents"), "doc_id", "text"), path)
    return logs.search_postings(logs.read_postings(s, path, ["the", "license"]), "doc_id", ["the", "license"])


@_add("SELECT event_id FROM events WHERE epoch_us(ts) // 1000000 >= 1706572800 - 7 * 86400")
def log_retention(s, d):
    return logs.retain(within(table(s, d, "events"), "ts", 1706572800 - 7 * DAY).select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("time")), 1706572800).select("event_id")


@_add("SELECT event_id, epoch_us(ts) // 1000000 AS time FROM events WHERE epoch_us(ts) // 1000000 >= 1705968000")
def log_store_retention(s, d):
    path = f"{scratch_folder(s)}/logs-{uuid.uuid4().hex}"
    store.append(table(s, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("time")), path)
    store.drop_before(s, path, 1705968000)
    return store.read(s, path)


@_add(f"SELECT event_id, 'event_type' AS tag FROM {_POINTS} WHERE time >= 1706000000")
def index_expiry(s, d):
    points = _points(s, d, ("event_id",))
    postings = points.select("event_id", "time", F.explode(tags.tags_to_map(F.col("tags"))).alias("tag", "tag_value"))
    return logs.expire_postings(postings, 1706000000).filter("tag = 'event_type'").select("event_id", "tag")


# --- versioned tables and changes

_LOG = """(SELECT o_orderkey, o_totalprice, 1 AS v, false AS gone FROM orders UNION ALL SELECT o_orderkey, o_totalprice + 1, 2, false FROM orders WHERE o_orderkey % 10 < 5
 UNION ALL SELECT o_orderkey, o_totalprice + 2, 3, o_orderkey % 10 = 0 FROM orders WHERE o_orderkey % 10 < 2)"""


def _version_log(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice")
    out = versioned.append(o.withColumns({"_version": F.lit(0).cast("bigint"), "_deleted": F.lit(False)}).limit(0), o, 1)
    out = versioned.append(out, o.filter("o_orderkey % 10 < 5").withColumn("o_totalprice", F.col("o_totalprice") + 1), 2)
    out = versioned.append(out, o.filter("o_orderkey % 10 = 1").withColumn("o_totalprice", F.col("o_totalprice") + 2), 3)
    return versioned.append(out, o.filter("o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 2), 3, deleted=True)


_SNAPSHOT = "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY v DESC) AS r FROM {log} WHERE v <= {at}) WHERE r = 1 AND NOT gone"


@_add(_SNAPSHOT.format(log=_LOG, at=2))
def snapshot_asof(s, d):
    return versioned.snapshot(_version_log(s, d), ["o_orderkey"], 2)


@_add(_SNAPSHOT.format(log=_LOG, at=3))
def snapshot_latest(s, d):
    return versioned.snapshot(_version_log(s, d), ["o_orderkey"], 3)


@_add(f"""SELECT o_orderkey, v AS _version FROM (SELECT *, max(CASE WHEN v <= 2 THEN v END) OVER (PARTITION BY o_orderkey) AS keep, max(v) OVER (PARTITION BY o_orderkey) AS last FROM {_LOG})
 WHERE (v > 2 OR v = keep) AND NOT (gone AND v = last AND v <= 2)""")
def vacuum_versions(s, d):
    return versioned.vacuum(_version_log(s, d), ["o_orderkey"], 2).select("o_orderkey", F.col("_version").cast("int").alias("_version"))


@_add(f"SELECT * FROM ({_SNAPSHOT.format(log=_LOG, at=3)}) WHERE NOT (o_totalprice > 400000)")
def delete_where(s, d):
    log = versioned.delete(_version_log(s, d), ["o_orderkey"], 3, F.col("o_totalprice") > 400000, cap=None)
    return versioned.snapshot(log, ["o_orderkey"], 4)


@_add(f"SELECT o_orderkey, CASE WHEN o_orderkey < 200 THEN 7.5 ELSE o_totalprice END AS o_totalprice FROM ({_SNAPSHOT.format(log=_LOG, at=3)})")
def update_where(s, d):
    log = versioned.update(_version_log(s, d), ["o_orderkey"], 3, {"o_totalprice": 7.5}, F.col("o_orderkey") < 200)
    return versioned.snapshot(log, ["o_orderkey"], 4)


@_add("SELECT * FROM (VALUES (1::BIGINT, 'a', 0.5::DOUBLE), (2::BIGINT, 'b', 2.0::DOUBLE), (3::BIGINT, 'none', 0.5::DOUBLE)) t(id, name, val)")
def insert_values(s, d):
    schema = [dml.ColumnSpec("id", "bigint", True), dml.ColumnSpec("name", "string", default="none"), dml.ColumnSpec("val", "double", default=0.5)]
    a = dml.rows_of_values(s, schema, [(1, "a")], ["ID", "name"])
    b = dml.rows_of_values(s, schema, [("2", "b", 2)])
    return a.unionByName(b).unionByName(dml.rows_of_values(s, schema, [(3,)], ["id"]))


@_add("SELECT p_partkey::DOUBLE AS id, p_size::BIGINT AS size, p_name AS name FROM part")
def insert_select_coerce(s, d):
    schema = [dml.ColumnSpec("id", "double", True), dml.ColumnSpec("size", "bigint"), dml.ColumnSpec("name", "string", True)]
    return dml.rows_of_select(table(s, d, "part").select("p_partkey", "p_size", "p_name"), schema)


@_add("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey::BIGINT, r_name FROM region")
def insert_into_table(s, d):
    schema = [dml.ColumnSpec("id", "bigint", True), dml.ColumnSpec("name", "string")]
    path = f"{scratch_folder(s)}/insert-{uuid.uuid4().hex}"
    dml.insert(dml.rows_of_select(table(s, d, "nation").select("n_nationkey", "n_name"), schema), path)
    dml.insert(dml.rows_of_select(table(s, d, "region").select("r_regionkey", "r_name"), schema), path)
    return s.read.parquet(path)


# --- catalogue and SQL text


@_add("""SELECT u AS user_id, t AS table_id, a AS action FROM (VALUES (1, 1, 'READ'), (1, 2, 'READ'), (1, 3, 'READ'), (2, 2, 'WRITE'), (3, 1, 'READ'), (3, 1, 'WRITE'), (3, 1, 'DDL'), (3, 2, 'READ'), (3, 2, 'WRITE'), (3, 2, 'DDL'), (3, 3, 'READ'), (3, 3, 'WRITE'), (3, 3, 'DDL')) x(u, t, a)""")
def rbac_effective(s, d):
    make = s.createDataFrame
    return catalog.effective_permissions(
        make([(1,), (2,), (3,), (4,)], "user_id int"),
        make([(1, 10), (2, 20), (3, 30), (4, 99), (2, 98)], "user_id int, role_id int"),
        make([(10, False), (20, False), (30, True)], "role_id int, is_admin boolean"),
        make([(10, 0, "READ"), (20, 2, "WRITE"), (20, 7, "DDL"), (98, 1, "DDL")], "role_id int, table_id int, action string"),
        make([(1,), (2,), (3,)], "table_id int"),
    )


@_add("""SELECT * FROM (VALUES (1, 0, 'CREATE USER', 'ann'), (2, 0, 'CREATE ROLE', 'reader'), (3, 1, 'GRANT', 'READ on 0 to reader'), (4, 1, 'ASSIGN', 'reader to ann'), (5, 1, 'DROP ROLE', 'reader')) t(number, by_user, action, detail)""")
def audit_log(s, d):
    a, path = admin.Admin(), f"{scratch_folder(s)}/audit-{uuid.uuid4().hex}"
    ann, reader = a.add_user("ann"), a.add_role("reader")
    done = a.save_audit(s, path)
    a.grant(reader, "READ", by=ann)
    a.assign(ann, reader, by=ann)
    a.drop_role(reader, by=ann)
    a.save_audit(s, path, done)
    return s.read.parquet(path)


@_add("""SELECT * FROM (VALUES (1, 'CREATE', 'app_logs', 'logs'), (2, 'CREATE', 'cpu', 'metrics'), (3, 'CREATE', 'users', 'sql'), (4, 'DROP', 'users', 'sql')) t(version, action, name, engine)""")
def schema_history(s, d):
    r = catalog.Registry()
    r.for_insert("App_Logs")
    r.for_insert("cpu")
    r.create("Users", "sql", "id BIGINT, name STRING")
    r.drop("USERS")
    return r.history_frame(s).select("version", "action", "name", "engine")


@_add("SELECT o_orderkey, 'SELECT col1, ? FROM table2 WHERE o_orderkey = ? AND x > ? AND h = ?' AS clean, sha256('SELECT col1, ? FROM table2 WHERE o_orderkey = ? AND x > ? AND h = ?') AS mark FROM orders")
def sql_fingerprint(s, d):
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    sql = F.concat(F.lit("SELECT col1, '"), "o_orderpriority", F.lit("' FROM table2 /* c"), key, F.lit(" */ WHERE o_orderkey = "), key, F.lit(" AND x > -"), customer, F.lit(".5 AND h = 0xFF -- note"))
    return table(s, d, "orders").select("o_orderkey", sqltext.sanitize(sql).alias("clean"), sqltext.fingerprint(sql).alias("mark"))


# --- streams


@_add(_rollup_sql(60))
def rollup_stream_complete(s, d):
    name = f"rollup_{uuid.uuid4().hex}"
    events = streams.read_stream(s, d, s.read.parquet(f"{d}/events.parquet").schema, "events.parquet")
    return streams.run_to_table(streams.rollup_stream(events), f"{scratch_folder(s)}/{name}").withColumn("sum", F.round("sum", 6))


@_add("SELECT event_id, event_type, value FROM events")
def ingest_stream(s, d):
    where = f"{scratch_folder(s)}/ingest-{uuid.uuid4().hex}"
    events = streams.read_stream(s, d, s.read.parquet(f"{d}/events.parquet").schema, "events.parquet").select("event_id", "event_type", "value")
    streams.ingest(events, f"{where}/table", f"{where}/checkpoint").awaitTermination()
    return s.read.parquet(f"{where}/table")


# --- wider forms: windows over time and rows, joins by range and by time


@_add("""WITH w AS (SELECT epoch_us(ts) // 1000000 AS t, value FROM events), s AS (SELECT t // 300 * 300 - k * 300 AS bucket, t, value FROM w, (VALUES (0), (1)) x(k))
 SELECT bucket, count(value) AS count, round(sum(value), 6) AS sum FROM s WHERE t >= bucket AND t < bucket + 600 GROUP BY 1""")
def window_sliding(s, d):
    e = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("at"), "value")
    w = e.groupBy(F.window("at", "600 seconds", "300 seconds").alias("w")).agg(F.count("value").alias("count"), F.round(F.sum("value"), 6).alias("sum"))
    return w.select(F.unix_seconds("w.start").alias("bucket"), "count", "sum")


@_add("""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM e),
 n AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g)
 SELECT user_id, min(t) // 1000000 AS since, count(*) AS n FROM n GROUP BY user_id, session""")
def window_session(s, d):
    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    w = e.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_seconds("w.start").alias("since"), "n")


@_add("""SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def window_frames(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(s, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey").over(w).alias("after"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("mean"))


@_add("""SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o
 ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""")
def join_asof(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "ts")
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return relational.asof_join(e, o, ["user_id"], "ts", ["o_orderkey"]).select("event_id", "o_orderkey")


@_add("SELECT p_partkey, lo FROM part, (VALUES (1, 10), (8, 20), (40, 60)) t(lo, hi) WHERE p_size BETWEEN lo AND hi")
def join_range(s, d):
    return relational.range_join(table(s, d, "part").select("p_partkey", "p_size"), s.createDataFrame([(1, 10), (8, 20), (40, 60)], "lo int, hi int"), "p_size", "lo", "hi", 16).select("p_partkey", "lo")


@_add("SELECT n_name, s_name FROM nation JOIN (SELECT s_nationkey AS n_nationkey, s_name FROM supplier) USING (n_nationkey)")
def join_using(s, d):
    return table(s, d, "nation").join(table(s, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey").select("n_name", "s_name")


@_add("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def agg_grouping_sets(s, d):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return table(s, d, "lineitem").groupingSets([keys[:2], keys[2:], []], *keys).agg(F.count("*").alias("n"))


@_add("SELECT true AS near FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem)")
def agg_approx(s, d):
    """An approximate distinct count is within three times its error of the exact one."""
    both = table(s, d, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("n"))
    return both.select((F.abs(F.col("a") - F.col("n")) <= 0.06 * F.col("n")).alias("near"))


@_add("SELECT p_partkey, upper(p_brand) AS a, substr(p_name, 1, 3) AS b, abs(p_size - 25) AS c, coalesce(nullif(p_type, ''), 'none') AS d, length(p_name) AS e, replace(p_brand, '#', '-') AS f, p_size % 7 AS g FROM part")
def builtin_functions(s, d):
    return table(s, d, "part").selectExpr("p_partkey", "upper(p_brand) AS a", "substr(p_name, 1, 3) AS b", "abs(p_size - 25) AS c", "coalesce(nullif(p_type, ''), 'none') AS d", "length(p_name) AS e", "replace(p_brand, '#', '-') AS f", "p_size % 7 AS g")


@_add(f"SELECT time, tags, metric_name, value FROM {_POINTS} WHERE (time > 1704672000 AND time < 1705276800 AND value > 20) OR metric_name = 'error'")
def metrics_predicates(s, d):
    return _points(s, d).filter("(time > 1704672000 AND time < 1705276800 AND value > 20) OR metric_name = 'error'")


@_add("SELECT event_id FROM events WHERE epoch_us(ts) // 1000000 BETWEEN 1704672000 AND 1706276800 AND event_type = 'error' AND contains(props, '7')")
def log_predicates(s, d):
    e = within(table(s, d, "events"), "ts", 1704672000, 1706276800)
    shaped = e.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("severity"), F.col("props").alias("body"))
    return logs.search_substring(logs.range_scan(shaped, 1704672000, 1706276800).filter("severity = 'ERROR'"), "%7%").select("event_id")


@_add("SELECT n_nationkey::BIGINT AS id, n_name AS name, NULL::BIGINT AS rank FROM nation")
def ddl_create_alter(s, d):
    """CREATE, INSERT, ALTER, a view, TRUNCATE and DROP over the session's catalogue; what the view gives before the end."""
    r, name = catalog.Registry(), f"ddl_{uuid.uuid4().hex}"
    ddl.create_table(s, r, name, "id BIGINT, name STRING")
    table(s, d, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name")).write.insertInto(name)
    ddl.truncate_table(s, r, name)
    ddl.add_column(s, r, name, "rank BIGINT")
    rows = table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("bigint").alias("rank"))
    rows.write.insertInto(name)
    ddl.create_view(s, r, f"{name}_view", f"SELECT id, name, rank FROM {name}", [name])
    path = f"{scratch_folder(s)}/{name}"
    s.table(f"{name}_view").write.parquet(path)
    ddl.drop_view(s, r, f"{name}_view")
    ddl.drop_table(s, r, name)
    return s.read.parquet(path)


@_add("SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1")
def compact_files(s, d):
    """Many small files, checked and compacted to few; all rows are there."""
    path = f"{scratch_folder(s)}/compact-{uuid.uuid4().hex}"
    table(s, d, "orders").select("o_orderkey", "o_totalprice").repartition(12).write.parquet(path)
    versioned.check(s.read.parquet(path), ["o_orderkey"])
    versioned.compact(s, path, 2)
    return s.read.parquet(path).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@_add("SELECT * FROM (VALUES (1, 'app_logs', 'logs', 'CREATE'), (2, 'cpu', 'metrics', 'CREATE'), (3, 'users', 'sql', 'CREATE'), (4, 'users', 'sql', 'DROP')) t(version, name, engine, action)")
def system_tables(s, d):
    """The catalogue as append-only tables: what a second session reads after the first has gone."""
    path = f"{scratch_folder(s)}/catalogue-{uuid.uuid4().hex}"
    first = catalog.Registry()
    first.for_insert("App_Logs")
    first.for_insert("cpu")
    first.create("users", "sql", "id BIGINT")
    first.save(s, path)
    second = catalog.Registry.load(s, path)
    second.drop("USERS")
    second.save(s, path)
    return catalog.Registry.load(s, path).history_frame(s).select("version", "name", "engine", "action")
