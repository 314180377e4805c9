"""Kernels and guards on small fixtures."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import logtext, sqltext, tags
from strandline.operators import admin, catalog, ddl, dml, logs, metrics, relational, versioned


def one(spark, expr, **literals):
    return spark.range(1).select(expr(*[F.lit(v) for v in literals.values()]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "body", "severity", "attributes"),
    [
        ('{"level":"ERROR","message":"queue stalled","node":"n-4","port":77}', "queue stalled", "ERROR", '{"node":"n-4","port":77}'),
        ('{"port":5,"severity":"WARN","message":"cache nearly full"}', "cache nearly full", "WARN", '{"port":5}'),
        ('{"status":"DEBUG","msg":"worker ready"}', "worker ready", "DEBUG", ""),
        ("no braces in this one", "no braces in this one", "INFO", ""),
        ('{"level":"VERBOSE","message":"chatter"}', "chatter", "INFO", ""),
        ('{"level":"INFO","node":"n-4"}', '{"level":"INFO","node":"n-4"}', "INFO", ""),
        (' {"body":"x","a":{"z":1,"b":[2]}} ', "x", "INFO", '{"a":{"b":[2],"z":1}}'),
        ('{"a":1,"a":2}', '{"a":1,"a":2}', "INFO", ""),
        ('{"message":"open', '{"message":"open', "INFO", ""),
        ("[1]", "[1]", "INFO", ""),
        ("{}", "{}", "INFO", ""),
        ('{"level":3,"message":""}', '{"level":3,"message":""}', "INFO", ""),
        (None, None, "INFO", ""),
    ],
)
def test_payload(spark, raw, body, severity, attributes):
    got = spark.createDataFrame([(raw,)], "raw string").select(logtext.parse_log_payload(F.col("raw")).alias("p")).first()["p"]
    assert (got["body"], got["severity"], got["attributes"]) == (body, severity, attributes)


def test_tokens(spark):
    assert one(spark, logtext.tokenize, t="WARN: Slow-Query?? (table=t-77)") == ["warn", "slow", "query", "table", "77"]
    assert one(spark, logtext.tokenize, t="x yy z 4 55 zz") == ["yy", "55", "zz"]
    assert one(spark, logtext.tokenize, t="late late soon é") == ["late", "soon", "é"]


def test_severities(spark):
    for name, number in {"debug": 1, "Information": 2, "warning": 3, "ERROR": 4, "critical": 5, "": 2, "x": 2}.items():
        assert one(spark, logtext.parse_severity, t=name) == number


def test_tags(spark):
    assert one(spark, tags.tags_to_map, t='{ host = "a" , bad, host=b,region=x=y }') == {"host": "b", "region": "x=y"}
    assert one(spark, tags.tags_to_map, t='{"host":"a","region":"x"}') == {"host": "a", "region": "x"}
    assert one(spark, tags.tags_to_map, t="") == {}


def test_rollup_fixture(spark):
    points = spark.createDataFrame([(90, 4.0), (119, 6.5), (120, -1.0), (185, 2.0), (239, 8.0), (-1, 3.0)], "time long, value double")
    got = {r["bucket"]: (r["count"], r["sum"], r["min"], r["max"]) for r in metrics.rollup(points, 60).collect()}
    assert got == {60: (2, 10.5, 4.0, 6.5), 120: (1, -1.0, -1.0, -1.0), 180: (2, 10.0, 2.0, 8.0), 0: (1, 3.0, 3.0, 3.0)}
    multi = metrics.rollups(points, (60, 300, 90))
    assert {r["resolution_s"] for r in multi.collect()} == {60, 90, 300}
    assert multi.filter("resolution_s = 300").agg(F.sum("count")).first()[0] == 6


def test_tag_scan_equals_index(spark):
    points = spark.createDataFrame([(1, 100, "host=a,region=x"), (2, 200, "host=b,region=x"), (3, 300, "host=a,region=y"), (4, 400, "host=")], "id long, time long, tags string")
    postings = metrics.tag_postings(points, "id")
    for wanted in ({"host": "a"}, {"host": "a", "region": "x"}, {"host": ""}, {"zone": ""}):
        a = sorted(r["id"] for r in metrics.range_scan(points, tags=wanted).collect())
        assert a == sorted(r["id"] for r in metrics.indexed_scan(points, postings, "id", wanted).collect())
    assert metrics.range_scan(points, 200, 400).count() == 3


def test_searches(spark):
    df = spark.createDataFrame([(1, "queue stalled twice"), (2, "worker joined"), (3, "queue drained, stalled"), (4, "100%_x")], "time long, body string")
    assert logs.search_tokens(df, "stalled QUEUE").count() == 2
    assert logs.search_substring(df, "%%_x%").count() == 1
    assert logs.search_substring(df, "Queue").count() == 0
    assert logs.range_scan(df, 2).count() == 3


def test_sql_text(spark):
    a, b = "SELECT k FROM trips /* first */ WHERE n = 5", "SELECT k FROM trips WHERE n = 81 -- second"
    assert one(spark, sqltext.fingerprint, s=a) == one(spark, sqltext.fingerprint, s=b)
    assert one(spark, sqltext.sanitize, s="SELECT 'o\\'er -- x', part7 FROM leg3 WHERE a = -17 AND b = 0xA0 # c\nAND d = 2.25") == "SELECT ?, part7 FROM leg3 WHERE a = ? AND b = ? AND d = ?"
    assert one(spark, sqltext.strip_comments, s="SELECT '/* kept */' /* gone */") == "SELECT '/* kept */' "


def log_of(spark, rows):
    return spark.createDataFrame(rows, "id long, val long, _version long, _deleted boolean")


def test_versions(spark):
    log = log_of(spark, [(1, 11, 1, False), (1, 24, 2, False), (1, 37, 3, False), (2, 5, 1, False), (2, None, 2, True)])
    at = lambda v, df=log: {r["id"]: r["val"] for r in versioned.snapshot(df, ["id"], v).collect()}
    assert at(0) == {} and at(1) == {1: 11, 2: 5} and at(2) == {1: 24} and at(9) == {1: 37}
    small = versioned.vacuum(log, ["id"], 2)
    assert sorted((r["id"], r["_version"]) for r in small.collect()) == [(1, 2), (1, 3)]
    assert all(at(v, small) == at(v) for v in (2, 3, 4))


def test_mutation_guards(spark):
    log = log_of(spark, [(k, k, 1, False) for k in range(5)])
    with pytest.raises(versioned.MutationError):
        versioned.delete(log, ["id"], 1, None)
    with pytest.raises(versioned.MutationError):
        versioned.update(log, ["id"], 1, {"val": 0}, F.lit(True), cap=4)
    with pytest.raises(versioned.MutationError):
        versioned.update(log, ["id"], 1, {"id": 0}, F.lit(True))
    gone = versioned.delete(log, ["id"], 1, None, allow_all=True)
    assert versioned.snapshot(gone, ["id"], 2).count() == 0 and versioned.snapshot(gone, ["id"], 1).count() == 5


def test_inserts(spark):
    schema = [dml.ColumnSpec("id", "bigint", True), dml.ColumnSpec("val", "string", default="d")]
    assert [tuple(r) for r in dml.rows_of_values(spark, schema, [(1, "a"), (2, None)]).collect()] == [(1, "a"), (2, None)]
    for values, columns in (([(None, "a")], None), ([(1,)], None), ([(1, 2)], ["id", "ID"]), ([(1, 2)], ["id", "zzz"]), ([("x", "a")], None), ([(1.5, "a")], None), ([(k, "a") for k in range(1001)], None)):
        with pytest.raises(dml.InsertError):
            dml.rows_of_values(spark, schema, values, columns)
    with pytest.raises(dml.InsertError):
        dml.rows_of_select(spark.createDataFrame([("a", "b")], "x string, y string"), schema)
    with pytest.raises(Exception, match="NULL in column id"):
        dml.rows_of_select(spark.createDataFrame([(None, "b")], "x long, y string"), schema).collect()


def test_registry():
    r = catalog.Registry()
    assert r.for_insert("My_LOG")[1] == "logs" and r.for_insert("cpu")[1] == "metrics"
    r.create("users", "sql", "id BIGINT")
    assert r.route(["USERS"]) == "sql" and r.version == 3
    for call in (lambda: r.route(["users", "cpu"]), lambda: r.get("none"), lambda: r.create("Users", "sql", "")):
        with pytest.raises(catalog.CatalogError):
            call()
    for check, columns in ((metrics.validate_schema, {"time": "string"}), (metrics.validate_schema, {"time": "bigint"}), (logs.validate_schema, {"time": "bigint", "severity": "string"})):
        with pytest.raises(ValueError):
            check(columns)
    metrics.validate_schema({"Time": "bigint", "v": "double"})
    logs.validate_schema({"time": "bigint", "severity": "string", "body": "string"})


def test_joins_agree(spark):
    a = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "i long, k long")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z"), (3, "w")], "m long, s string")
    on = F.col("k") == F.col("m")
    for how in ("inner", "left"):
        plain = sorted(map(str, relational.theta_join(a, b, on, how).collect()))
        for strategy in (None, "shuffle_hash", "broadcast", "merge"):
            assert sorted(map(str, relational.hash_join(a, b, on, how, strategy=strategy).collect())) == plain
    assert relational.hash_join(a, b, on, residual=F.col("s") == "z").count() == 1
    assert relational.theta_join(a, b, None).count() == 12
    assert relational.page(a, 0).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_scans_push_down(spark):
    from strandline.sources.tables import table

    d = "/root/testdata/sf0.001"
    plan = plan_of(relational.scan(table(spark, d, "orders"), ["o_orderkey"], lo=("o_orderkey", 5), hi=("o_orderkey", 9)))
    assert "GreaterThanOrEqual(o_orderkey,5)" in plan and "LessThan(o_orderkey,9)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan
    plan = plan_of(table(spark, d, "nation").filter(F.col("n_regionkey").isin(1, 3)).select("n_name"))
    assert "In(n_regionkey, [1,3])" in plan
    plan = plan_of(relational.page(relational.sort(table(spark, d, "orders"), ("o_totalprice", False)), 3))
    assert "TakeOrderedAndProject" in plan


def test_rollup_aggregates_before_the_shuffle(spark):
    points = spark.range(100).selectExpr("id AS time", "cast(id AS double) AS value")
    plan = plan_of(metrics.rollup(points, 60))
    assert "partial_sum" in plan and plan.count("Exchange hashpartitioning") == 1


def test_day_store_prunes(spark, tmp_path):
    from strandline.sources import store

    rows = spark.range(100).selectExpr("id * 7200 AS time", "id")
    store.append(rows, str(tmp_path / "t"))
    store.append(rows.filter("id < 3"), str(tmp_path / "t"))
    got = store.read(spark, str(tmp_path / "t"), 2 * store.DAY, 3 * store.DAY - 1)
    assert got.count() == 12 and "PartitionFilters: [isnotnull(day" in plan_of(got)
    assert store.drop_before(spark, str(tmp_path / "t"), 2 * store.DAY + 5) == 2 and store.read(spark, str(tmp_path / "t")).count() == 76


def test_admin(spark):
    a = admin.Admin()
    ann, bob = a.add_user("ann"), a.add_user("bob")
    reader, root = a.add_role("reader"), a.add_role("root", True)
    a.grant(reader, "READ")
    a.grant(reader, "WRITE", 2)
    a.assign(ann, reader)
    a.assign(bob, root)
    tables = spark.createDataFrame([(1,), (2,)], "table_id int")
    asked = [(u, t, x) for u in (ann, bob) for t in (1, 2) for x in catalog.ACTIONS]
    got = {tuple(r) for r in catalog.effective_permissions(*a.frames(spark), tables).collect()}
    assert got == {q for q in asked if a.may(*q)} and (ann, 1, "WRITE") not in got
    a.drop_role(reader)
    assert not a.may(ann, 1, "READ") and not a.may(99, 1, "READ")
    with pytest.raises(catalog.CatalogError):
        a.grant(root, "FLY")
    with pytest.raises(catalog.CatalogError):
        a.add_user("ann")


def test_ddl(spark):
    r = catalog.Registry()
    ddl.create_table(spark, r, "Ddl_Test", "id BIGINT, name STRING")
    spark.sql("INSERT INTO ddl_test VALUES (1, 'a')")
    assert spark.table("ddl_test").count() == 1 and r.route(["ddl_TEST"]) == "sql"
    with pytest.raises(catalog.CatalogError):
        ddl.create_table(spark, r, "ddl_test", "id BIGINT")
    ddl.drop_table(spark, r, "DDL_test")
    assert not spark.catalog.tableExists("ddl_test")


def test_append_guards(spark):
    log = log_of(spark, [(1, 10, 4, False)])
    rows = lambda *xs: spark.createDataFrame(list(xs), "id long, val long")
    assert versioned.append_checked(log, rows((1, 2), (3, 4)), ["id"], 5).count() == 3
    for bad, version in ((rows((1, 2)), 4), (rows((1, 2), (1, 3)), 5), (rows((None, 2)), 5)):
        with pytest.raises(versioned.MutationError):
            versioned.append_checked(log, bad, ["id"], version)


def test_store_edges(spark, tmp_path):
    """A row without a time outlives retention; a store whose days have all gone is an empty table."""
    from strandline.sources import store

    rows, path = spark.createDataFrame([(None, 1), (5, 2), (store.DAY + 5, 3)], "time long, id long"), str(tmp_path / "t")
    store.append(rows, path, codec="snappy")
    assert store.drop_before(spark, path, 10 * store.DAY) == 2 and [tuple(r) for r in store.read(spark, path).collect()] == [(None, 1)]
    store.append(rows.filter("id = 2"), str(tmp_path / "u"))
    assert store.drop_before(spark, str(tmp_path / "u"), 10 * store.DAY) == 1
    gone = store.read(spark, str(tmp_path / "u"))
    assert gone.columns == ["time", "id"] and gone.count() == 0


def test_time_bounds_reach_the_reader(spark):
    from strandline.plans import catalogue

    for name in ("metrics_range", "log_range", "log_retention"):
        plan = plan_of(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "GreaterThanOrEqual(ts," in plan, name


def test_payload_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "raw string").select(logtext.parse_log_payload(F.col("raw")).alias("p"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_registry_is_kept(spark, tmp_path):
    path = str(tmp_path / "catalogue")
    a = catalog.Registry()
    a.create("T", "sql", "id BIGINT")
    a.save(spark, path)
    b, c = catalog.Registry.load(spark, path), catalog.Registry.load(spark, path)
    b.alter("t", "id BIGINT, x INT")
    b.save(spark, path)
    c.drop("t")
    with pytest.raises(catalog.CatalogError):
        c.save(spark, path)
    d = catalog.Registry.load(spark, path)
    assert d.get("T")[2] == "id BIGINT, x INT" and d.version == 2 and d.history_frame(spark).count() == 2


def test_compact(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(100).repartition(9).write.parquet(path)
    versioned.compact(spark, path, 2)
    assert spark.read.parquet(path).count() == 100 and len(list((tmp_path / "many").glob("*.parquet"))) == 2 and not (tmp_path / "many-before").exists()


def test_numbered(spark, tmp_path):
    df = spark.range(1000).repartition(7).selectExpr("id", "id % 13 AS k")
    got = [(r["place"], r["id"]) for r in relational.numbered(df.orderBy("k", "id"), "place", str(tmp_path / "t")).collect()]
    assert sorted(got) == list(enumerate(sorted(range(1000), key=lambda i: (i % 13, i)), 1))
