"""Snapshot tables end to end."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlake.operators.predicate import Always, col, to_column
from sparrowlake.operators.star import Edge, bounds, key_bounds
from sparrowlake.operators.transforms import Transform
from sparrowlake.session import Engine, EngineError, SessionOptions, demo
from sparrowlake.sources.catalog import CatalogError, MemoryCatalog, WarehouseCatalog
from sparrowlake.sources.table import SnapshotTable, TableError

NAN = float("nan")
ROWS = [(i, None if i % 7 == 0 else f"n{i % 5}", NAN if i % 11 == 0 else None if i % 13 == 0 else i / 2) for i in range(60)]


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def mixed(spark):
    return spark.createDataFrame(ROWS, "id bigint, name string, x double")


def keys(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


PREDICATES = [
    col("id", "<", 10), col("id", ">=", 55), col("id", "in", [1, 20, 400]), col("name", "is_null"), col("name", "=", "n3"), ~col("name", "=", "n3"), col("name", "starts_with", "n"), ~col("name", "starts_with", "n1"),
    col("x", ">", 20.0), col("x", "is_nan"), ~col("x", "is_nan"), col("x", "not_null"), ~(col("id", "<", 50) | col("x", "is_nan")), col("x", "<=", 3.0) & col("name", "!=", "n2"), col("name", "not_in", ["n0", "n1"]), Always(False),
]


@pytest.mark.parametrize("parts", [[], ["name"], [("id", "bucket[4]")], [("id", "truncate[10]")], [("name", "truncate[1]"), ("id", "truncate[25]")]])
def test_pruned_scan_equals_unpruned(spark, folder, parts):
    table = SnapshotTable.create(spark, "t", folder + "/t", mixed(spark).schema, parts)
    table.append(mixed(spark).where("id < 30").coalesce(1))
    table.append(mixed(spark).where("id >= 30").coalesce(1))
    whole = mixed(spark)
    skipped = 0
    for p in PREDICATES:
        scan = table.scan().where(p)
        skipped += len(table.scan().plan()) - len(scan.plan())
        assert keys(scan.to_df()) == keys(whole.where(to_column(p))), p
    assert skipped > 0


def test_snapshots_and_time_travel(spark, folder):
    table = SnapshotTable.create(spark, "t", folder + "/t", T._parse_datatype_string("foo1 int not null, foo2 string"))
    assert table.to_df().count() == 0 and table.snapshots().count() == 0 and table.manifests().count() == 0
    assert table.append(spark.createDataFrame([], table.metadata.schema.spark())) == 0
    assert table.snapshots().count() == 0
    assert table.append(spark.sql("SELECT * FROM VALUES (1, 'alan'), (2, 'turing') t(foo1, foo2)")) == 2
    first = table.metadata.current_snapshot["snapshot-id"]
    table.append(spark.sql("SELECT 3 AS foo1"))
    assert keys(table.to_df()) == ["(1, 'alan')", "(2, 'turing')", "(3, None)"]
    assert table.to_df(first).count() == 2
    with pytest.raises(TableError, match="not found in table"):
        table.to_df(12)
    snaps = table.snapshots().orderBy("committed_at").collect()
    assert [s.operation for s in snaps] == ["append", "append"] and snaps[1].parent_id == first and snaps[1].summary["total-records"] == "3"
    assert [m.added_data_files_count > 0 for m in table.manifests().collect()] == [True, True]
    static = SnapshotTable.open_static(spark, "s", table.metadata_path, first)
    assert static.to_df().count() == 2
    with pytest.raises(TableError, match="read-only"):
        static.append(spark.sql("SELECT 4 AS foo1"))
    with pytest.raises(TableError, match="no such columns"):
        table.append(spark.sql("SELECT 1 AS foo1, 2 AS other"))
    with pytest.raises(Exception, match="null in required column"):
        table.append(spark.sql("SELECT 'x' AS foo2"))
    table.set_ref("v1", first)
    assert table.metadata.raw["refs"]["v1"]["snapshot-id"] == first


def test_deletes_follow_sequence_numbers(spark, folder):
    df = spark.sql("SELECT id, CAST(id % 3 AS INT) AS k, IF(id = 5, NULL, 'v') AS v FROM range(12)")
    table = SnapshotTable.create(spark, "t", folder + "/t", df.schema, ["k"])
    table.append(df)
    table.delete_equal(spark.sql("SELECT CAST(NULL AS STRING) AS v"))
    table.append(spark.sql("SELECT 100L AS id, 1 AS k, CAST(NULL AS STRING) AS v"))
    assert table.delete_where(F.col("id").isin(1, 2)) == 2
    assert sorted(r.id for r in table.to_df().collect()) == [0, 3, 4, 6, 7, 8, 9, 10, 11, 100]
    assert sorted(r.id for r in table.scan().where(col("k", "=", 1)).select("id").to_df().collect()) == [4, 7, 10, 100]
    assert table.delete_where(F.col("id") > 1000) == 0


def test_evolution(spark, folder):
    table = SnapshotTable.create(spark, "t", folder + "/t", T._parse_datatype_string("a int, b string, c float"))
    table.append(spark.sql("SELECT 1 AS a, 'x' AS b, CAST(1.5 AS FLOAT) AS c"))
    before = table.metadata.current_snapshot["snapshot-id"]
    table.rename_column("b", "a2"), table.promote_column("a", "long"), table.promote_column("c", "double"), table.drop_column("c"), table.add_column("c", "string")
    table.append(spark.sql("SELECT 5000000000 AS a, 'y' AS a2, 'z' AS c"))
    assert keys(table.to_df()) == ["(1, 'x', None)", "(5000000000, 'y', 'z')"]
    assert table.to_df(before).columns == ["a", "b", "c"] and table.to_df(before).first().c == 1.5
    table.set_partitioning([("a", "bucket[2]")])
    table.append(spark.sql("SELECT 2L AS a"))
    assert table.scan().where(col("a", "=", 2)).to_df().count() == 1 and table.to_df().count() == 3


def test_concurrent_appends_all_land(spark, folder):
    table = SnapshotTable.create(spark, "t", folder + "/t", T._parse_datatype_string("a int"), properties={"commit.retry.num-retries": "20", "commit.retry.min-wait-ms": "5"})
    failed = []

    def add(i):
        try:
            SnapshotTable.open(spark, "t", folder + "/t").append(spark.range(1).selectExpr(f"{i} AS a"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=add, args=(i,)) for i in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert sorted(r.a for r in table.to_df().collect()) == [0, 1, 2, 3, 4]


def test_transform_columns_equal_values(spark):
    import datetime as dt
    from decimal import Decimal

    rows = [(None,) * 5, (-1, dt.datetime(1969, 12, 31, 23, 59, 59, 999999), "héé", dt.date(1970, 1, 1), Decimal("-1.25")), (34, dt.datetime(2024, 2, 29, 12, 0, 0, 1), "iceberg", dt.date(1900, 5, 5), Decimal("14.20")), (2**62, dt.datetime(1900, 1, 1), "", dt.date(2100, 1, 1), Decimal("0.00"))]
    df = spark.createDataFrame(rows, "l bigint, t timestamp_ntz, s string, d date, m decimal(9,2)")
    kinds = {"l": "long", "t": "timestamp", "s": "string", "d": "date", "m": "decimal(9,2)"}
    wanted = [("l", "bucket[7]"), ("l", "truncate[10]"), ("t", "bucket[7]"), ("t", "year"), ("t", "month"), ("t", "day"), ("t", "hour"), ("s", "bucket[7]"), ("s", "truncate[2]"), ("d", "bucket[7]"), ("d", "month"), ("d", "day"), ("m", "bucket[7]"), ("m", "truncate[50]"), ("l", "void")]
    for c, text in wanted:
        t = Transform.parse(text)
        got = [r.v for r in df.select(c, t.column(F.col(c), kinds[c]).alias("v")).collect()]
        assert got == [t.apply(r["l t s d m".split().index(c)]) for r in rows], (c, text)


def test_star_bounds(spark):
    dense, sparse = spark.range(100, 150), spark.range(0, 1000, 100)
    assert key_bounds(dense, "id", "k") == col("k", ">=", 100) & col("k", "<=", 149)
    assert key_bounds(sparse, "id", "k") == col("k", "in", list(range(0, 1000, 100)))
    assert key_bounds(sparse, "id", "k", most_keys=3) == Always(True)
    assert key_bounds(sparse.where("id < 0"), "id", "k") == Always(False)
    assert bounds([Edge(dense, "k", "id", "left")]) == Always(True)
    assert bounds([Edge(dense, "k", "id")], fact_rows=10) == Always(True)


def test_engine_sql(spark, folder):
    engine = Engine.from_warehouse(spark, folder, "demo")
    engine.create_namespace("demo")
    engine.create_table("Customers", demo(spark).schema)
    with pytest.raises(TableError, match="already exists"):
        engine.create_table("customers", demo(spark).schema)
    with pytest.raises(TableError):
        engine.create_table("other", demo(spark))
    got = engine.query("INSERT INTO customers VALUES (1, 'Alice', 'US'), (2, 'Bob', 'US'), (3, 'Carlos', 'EU')")
    assert got.rows == [(3,)]
    assert engine.query("SELECT region, count(*) AS n FROM demo.CUSTOMERS GROUP BY region ORDER BY region").rows == [("EU", 1), ("US", 2)]
    assert engine.query("SELECT c.name FROM local.demo.customers c WHERE c.id = 3").rows == [("Carlos",)]
    assert engine.query("SELECT operation FROM customers$snapshots").rows == [("append",)]
    assert engine.query("SELECT count(*) FROM demo.customers$manifests").rows == [(1,)]
    assert engine.query("show tables in demo;").rows == [("Customers",)]
    assert engine.query("SELECT column_name FROM information_schema.columns ORDER BY ordinal_position").rows == [("id",), ("name",), ("region",)]
    assert "Scan parquet" in engine.explain("SELECT * FROM customers") and "rows=3" in engine.explain_analyze("SELECT * FROM customers")
    with pytest.raises(EngineError, match="hint"):
        engine.query("SELECT * FROM nothing_there")
    with pytest.raises(EngineError):
        engine.query("DELETE FROM customers")
    path = engine.open_table("customers").metadata_path
    engine.register_external("outside", path)
    assert engine.query("SELECT count(*) FROM outside").rows == [(3,)]
    assert "NULL" in engine.query("SELECT NULL AS x").text()
    assert engine.drop_table("customers") and not engine.drop_table("customers")


def test_catalogs(spark, folder):
    memory = MemoryCatalog(spark, folder)
    memory.create_namespace("a", {"k": "v"})
    memory.create_table("A", "t", T._parse_datatype_string("x int"))
    assert memory.list_tables("a") == ["t"] and memory.table_exists("a", "T") and memory.namespace_properties("a") == {"k": "v"}
    memory.rename_table("a", "t", "u")
    assert memory.load_table("a", "U").name == "a.u"
    for bad in (lambda: memory.drop_namespace("a"), lambda: memory.create_namespace("A"), lambda: memory.load_table("a", "t"), lambda: memory.load_table("b", "t"), lambda: WarehouseCatalog(spark, "relative")):
        with pytest.raises(CatalogError):
            bad()
    assert memory.drop_table("a", "u") and not memory.drop_table("a", "u")


def test_cli(spark, folder, capsys):
    from sparrowlake.cli import main

    engine = Engine.from_warehouse(spark, folder, "public")
    engine.create_namespace("public")
    engine.create_table("t", "a int")
    assert main([], spark) == 0 and "nothing to run" in capsys.readouterr().out
    assert main(["-w", folder, "-e", "SELECT count(*) AS n FROM t"], spark) == 0 and "1 rows" in capsys.readouterr().out
    assert main(["-w", folder, "-e", "SELECT * FROM missing"], spark) == 1 and "plan sql" in capsys.readouterr().err
    assert main(["-w", folder, "-e", "SELECT * FROM t", "--explain", "--explain-analyze"], spark) == 0 and "analyzed_plan" in capsys.readouterr().out


def test_sql_filters_reach_file_planning(spark, tmp_path):
    import datetime as dt

    engine = Engine.from_warehouse(spark, str(tmp_path / "pruned"), "demo")
    engine.create_namespace("demo")
    engine.sql("CREATE TABLE visits (id BIGINT, day DATE, word STRING) PARTITIONED BY (month(day))")
    rows = [(i, dt.date(2023 + i // 12 % 2, i % 12 + 1, 5), f"w{i}") for i in range(48)]
    engine.insert("visits", spark.createDataFrame(rows, "id bigint, day date, word string"))
    files = lambda sql: len(set(engine.sql(sql).inputFiles()))
    n_all = files("SELECT * FROM visits")
    one = files("SELECT * FROM demo.visits WHERE day = DATE '2024-03-05'")
    assert n_all >= 24 and 0 < one <= n_all // 12
    # every occurrence counts, also in subqueries and under joins; what cannot be read as a predicate leaves files in
    cases = [
        ("SELECT a.id FROM visits a JOIN visits b ON a.word = b.word WHERE a.day = DATE '2024-03-05' AND b.day >= DATE '2024-02-01'", n_all),
        ("SELECT id FROM visits WHERE day = DATE '2024-03-05' AND id >= (SELECT min(id) FROM visits WHERE day < DATE '2023-02-01')", n_all // 3),
        ("SELECT id FROM visits WHERE day = DATE '2024-03-05' UNION ALL SELECT id FROM visits WHERE upper(word) = 'W1'", n_all + 1),
        ("SELECT id FROM visits WHERE day IN (DATE '2024-03-05', DATE '2023-01-05') OR day > DATE '2024-12-01'", n_all // 3),
        ("SELECT id FROM visits WHERE NOT (day <= DATE '2024-11-30') AND word LIKE 'w%'", n_all // 6),
        ("WITH v AS (SELECT * FROM visits) SELECT count(*) FROM v WHERE day = DATE '2024-03-05' AND id NOT IN (SELECT id FROM v WHERE id < 3)", n_all + 1),
    ]
    plain = spark.createDataFrame(rows, "id bigint, day date, word string")
    for sql, most in cases:
        got = sorted(tuple(r) for r in engine.sql(sql).collect())
        assert files(sql) < most, sql
        plain.createOrReplaceTempView("visits")
        assert got == sorted(tuple(r) for r in spark.sql(sql).collect()), sql


def test_sql_leaves_literals_alone(spark, tmp_path):
    engine = Engine.from_warehouse(spark, str(tmp_path / "words"), "demo")
    engine.create_namespace("demo")
    engine.create_table("customers", "id int")
    engine.sql("INSERT INTO customers VALUES (1)")
    got = engine.sql("SELECT 'demo.customers' AS a, \"information_schema.tables\" AS b, id FROM demo.customers -- demo.customers").collect()
    assert [tuple(r) for r in got] == [("demo.customers", "information_schema.tables", 1)]


def test_sql_ddl(spark, tmp_path):
    engine = Engine.from_warehouse(spark, str(tmp_path / "ddl"), "demo")
    engine.create_namespace("demo")
    engine.sql("CREATE TABLE t (id INT NOT NULL, price DECIMAL(10, 2), at TIMESTAMP_NTZ) PARTITIONED BY (bucket(4, id), day(at));")
    engine.sql("CREATE TABLE IF NOT EXISTS t (id INT)")
    table = engine.open_table("t")
    assert [f.name for f in table.metadata.schema.fields] == ["id", "price", "at"] and len(table.metadata.spec.fields) == 2
    engine.sql("INSERT INTO t VALUES (1, 2.50, TIMESTAMP_NTZ '2024-01-02 03:04:05')")
    engine.sql(f"CREATE EXTERNAL TABLE old LOCATION '{engine.open_table('t').metadata_path}'")
    engine.sql("INSERT INTO t VALUES (2, 3.50, NULL)")
    assert engine.sql("SELECT count(*) FROM old").first()[0] == 1 and engine.sql("SELECT count(*) FROM t").first()[0] == 2
    engine.sql("DROP TABLE old")
    engine.sql("DROP TABLE t")
    engine.sql("DROP TABLE IF EXISTS t")
    for wrong in ("DROP TABLE t", "SELECT * FROM t"):
        with pytest.raises(Exception):
            engine.sql(wrong)


LONG = ["a" * 20, "a" * 20 + "b", "a" * 16, "b" * 15 + "퟿" + "x", "\U0010ffff" * 20, "", None, "ab"]


@pytest.mark.parametrize("p", [col("s", op, v) for v in LONG if v is not None for op in ("=", "<", "<=", ">", ">=", "!=", "starts_with", "not_starts_with")], ids=repr)
def test_bounds_of_long_strings_are_cut_and_safe(long_table, p):
    got = {r.i for r in long_table.scan().where(p).to_df().collect()}
    assert got == {r.i for r in long_table.to_df().where(to_column(p)).collect()}


@pytest.fixture(scope="module")
def long_table(spark, tmp_path_factory):
    df = spark.createDataFrame(list(enumerate(LONG)), "i int, s string")
    table = SnapshotTable.create(spark, "t", str(tmp_path_factory.mktemp("long")) + "/t", df.schema)
    for i in range(len(LONG)):  # a file each, so that every bound is cut on its own
        table.append(df.where(F.col("i") == i))
    files = [t.file for t in table.scan().plan()]
    assert len(files) == len(LONG) and all(len(b) <= 16 for f in files for b in (f.columns[2].get("lower"), f.columns[2].get("upper")) if b)
    return table


@pytest.fixture
def star(spark, folder):
    engine = Engine.from_warehouse(spark, folder, "demo", options=SessionOptions(key_bounds_rows=0))
    engine.create_namespace("demo")
    fact = spark.range(4000).selectExpr("id", "CASE WHEN id % 50 <> 7 THEN id DIV 10 END AS k", "id % 3 AS v").repartitionByRange(8, "id")
    dim = spark.range(420).selectExpr("id AS k", "concat('n', id) AS name", "id % 2 AS half", "id DIV 100 AS g")
    for name, df in (("fact", fact), ("dim", dim)):
        engine.create_table(name, df.schema)
        engine.insert(name, df)
        df.createOrReplaceTempView(f"plain_{name}")
    return engine


@pytest.mark.parametrize(
    ("narrows", "sql"),
    [
        (True, "SELECT f.id, d.name FROM {fact} f JOIN {dim} d ON f.k = d.k WHERE d.name = 'n17'"),
        (True, "SELECT f.id, d.name FROM {fact} f JOIN {dim} d ON f.k = d.k WHERE d.g = 2 AND f.v = 1"),
        (True, "SELECT id FROM {fact} WHERE k IN (SELECT k FROM {dim} WHERE g = 3)"),
        (True, "SELECT count(*) AS n, d.half FROM (SELECT k + 0 AS other, k FROM {fact}) f, {dim} d WHERE d.k = f.k AND d.name = 'missing' GROUP BY d.half"),
        (False, "SELECT f.id, d.name FROM {fact} f LEFT JOIN {dim} d ON f.k = d.k AND d.name = 'n17'"),
        (False, "SELECT id FROM {fact} f WHERE NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.k = f.k AND d.name = 'n17')"),
        (False, "SELECT a.id, b.id AS other FROM {fact} a JOIN {dim} d ON a.k = d.k JOIN {fact} b ON b.id = a.id + 1 WHERE d.name = 'n17'"),
        (False, "SELECT u.x, d.name FROM (SELECT k AS x FROM {fact} UNION ALL SELECT id FROM {fact}) u JOIN {dim} d ON u.x = d.k WHERE d.name = 'n17'"),
        (False, "SELECT f.id FROM (SELECT id, k, row_number() OVER (ORDER BY id) AS r FROM {fact}) f JOIN {dim} d ON f.k = d.k WHERE d.name = 'n17' AND f.r > 5"),
        (False, "SELECT f.id FROM {fact} f JOIN {dim} d ON f.k = d.k"),
    ],
)
def test_join_keys_narrow_the_fact(spark, star, narrows, sql):
    got = star.sql(sql.format(fact="fact", dim="dim"))
    assert keys(got) == keys(spark.sql(sql.format(fact="plain_fact", dim="plain_dim")))
    paths = [t.file.path for t in star.open_table("fact").scan().plan()]
    read = [p for p in paths if any(f.endswith(p.rpartition("/")[2]) for f in got.inputFiles())]
    assert (len(read) < len(paths)) == narrows
