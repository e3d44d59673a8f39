"""Queries through the table layer: what is written, versioned, deleted, evolved and pruned must read as plain SQL says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowlake.operators.predicate import col
from sparrowlake.operators.star import Edge, bounds, star_join
from sparrowlake.operators.transforms import Transform
from sparrowlake.session import Engine, SessionOptions, demo
from sparrowlake.sources.scratch import scratch
from sparrowlake.sources.table import SnapshotTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):  # noqa: ANN201
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, df: DataFrame, name: str, **options) -> SnapshotTable:  # noqa: ANN003
    return SnapshotTable.create(spark, name, scratch(spark, name), df.schema, **options)


def filled(spark: SparkSession, df: DataFrame, name: str, **options) -> SnapshotTable:  # noqa: ANN003
    table = made(spark, df, name, **options)
    table.append(df)
    return table


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(ORDERS)
def tbl_append_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir)
    table = made(spark, df, "orders")
    table.append(df.where("o_orderstatus = 'F'"))
    table.append(df.where("o_orderstatus <> 'F'"))
    return table.to_df()


@query(ORDERS + " WHERE o_orderstatus = 'F'")
def tbl_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir)
    table = filled(spark, df.where("o_orderstatus = 'F'"), "orders")
    first = table.metadata.current_snapshot["snapshot-id"]
    table.append(df.where("o_orderstatus = 'O'"))
    return table.to_df(first)


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderstatus")
def tbl_partition_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = filled(spark, orders(spark, sf_dir), "orders", partition_by=["o_orderstatus"])
    return table.scan().where(col("o_orderstatus", "=", "P")).to_df().groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(ORDERS + " WHERE o_custkey IN (7, 11, 13)")
def tbl_partition_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = filled(spark, orders(spark, sf_dir), "orders", partition_by=[("o_custkey", "bucket[8]")])
    return table.scan().where(col("o_custkey", "in", [7, 11, 13])).to_df()


@query(ORDERS + " WHERE o_orderkey >= 100 AND o_orderkey < 1000")
def tbl_partition_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = filled(spark, orders(spark, sf_dir), "orders", partition_by=[("o_orderkey", "truncate[500]")])
    return table.scan().where(col("o_orderkey", ">=", 100) & col("o_orderkey", "<", 1000)).to_df()


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-05-01 00:00:00'")
def tbl_partition_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime as dt

    table = filled(spark, source(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "orders", partition_by=[("o_orderdate", "month")])
    return table.scan().where(col("o_orderdate", ">=", dt.datetime(1997, 3, 1)) & col("o_orderdate", "<", dt.datetime(1997, 5, 1))).to_df()


@query("SELECT r_regionkey, r_name, CASE WHEN r_regionkey > 2 THEN r_name ELSE NULL END AS note FROM region")
def tbl_schema_add_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "region")
    table = filled(spark, df.where("r_regionkey <= 2"), "region")
    table.add_column("note", "string")
    table.append(df.where("r_regionkey > 2").withColumn("note", F.col("r_name")))
    return table.to_df()


@query("SELECT r_regionkey AS id, r_name FROM region")
def tbl_schema_rename_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "region")
    table = filled(spark, df.where("r_regionkey <= 2"), "region")
    table.rename_column("r_regionkey", "id")
    table.append(df.where("r_regionkey > 2").withColumnRenamed("r_regionkey", "id"))
    return table.to_df()


@query("SELECT r_name FROM region")
def tbl_schema_drop_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = filled(spark, source(spark, sf_dir, "region"), "region")
    table.drop_column("r_regionkey")
    return table.to_df()


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation UNION ALL SELECT 5000000000, 'far'")
def tbl_type_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = filled(spark, source(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "nation")
    table.promote_column("n_nationkey", "long")
    table.append(spark.sql("SELECT 5000000000 AS n_nationkey, 'far' AS n_name"))
    return table.to_df()


@query(ORDERS + " WHERE o_custkey NOT IN (1, 2, 4, 5) OR o_orderstatus = 'P'")
def tbl_eq_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir)
    table = filled(spark, df.where("o_orderstatus <> 'P'"), "orders")
    table.delete_equal(spark.sql("SELECT explode(array(1L, 2L, 4L, 5L)) AS o_custkey"))
    table.append(df.where("o_orderstatus = 'P'"))  # later rows stay
    return table.to_df()


@query(ORDERS + " WHERE NOT (o_totalprice > 200000 AND o_orderkey < 3000)")
def tbl_pos_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = filled(spark, orders(spark, sf_dir), "orders")
    table.delete_where((F.col("o_totalprice") > 200000) & (F.col("o_orderkey") < 3000))
    return table.to_df()


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS street FROM customer")
def tbl_insert_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "named_struct('address', named_struct('street', c_mktsegment, 'zip', c_nationkey)) AS profile")
    return filled(spark, df, "people").to_df().selectExpr("id", "name", "profile.address.street AS street")


@query("SELECT region, count(*) AS n FROM (VALUES ('US'), ('US'), ('EU')) t(region) GROUP BY region")
def sql_insert_and_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.from_warehouse(spark, scratch(spark, "warehouse").removeprefix("file://"), "demo")
    engine.create_namespace("demo")
    engine.create_table("customers", demo(spark).schema)
    engine.sql("INSERT INTO customers SELECT * FROM (VALUES (1, 'Alice', 'US'), (2, 'Bob', 'US'), (3, 'Carlos', 'EU')) t(id, name, region)")
    return engine.sql("SELECT region, count(*) AS n FROM customers GROUP BY region")


@query(
    """SELECT n_nationkey, CAST(strpos(n_name, 'A') AS INT) AS p, starts_with(n_name, 'A') AS s, CAST(len([1, n_nationkey]) AS INT) AS n, [n_regionkey, 7][2] AS e, array_to_string([1, 2, n_nationkey], '-') AS j,
sha256(n_name) AS h, array_to_string([1, 2, 3, n_nationkey][2:3], ',') AS sl FROM nation"""
)
def fn_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.from_warehouse(spark, scratch(spark, "warehouse").removeprefix("file://"), "demo")
    engine.create_namespace("demo")
    engine.create_table("nation", source(spark, sf_dir, "nation").schema)
    engine.insert("nation", source(spark, sf_dir, "nation"))
    return engine.sql(
        """SELECT n_nationkey, strpos(n_name, 'A') AS p, starts_with(n_name, 'A') AS s, array_length(make_array(1, n_nationkey)) AS n, array_element(make_array(n_regionkey, 7), 2) AS e,
array_to_string(make_array(1, 2, n_nationkey), '-') AS j, sha256(n_name) AS h, array_to_string(array_slice(make_array(1, 2, 3, n_nationkey), 2, 3), ',') AS sl FROM demo.nation"""
    )


@query(
    """SELECT c_custkey, regexp_extract(c_name, '#0*([0-9]+)', 1) AS digits, 'no' AS missed, CAST(c_custkey AS DOUBLE) AS d, CAST(c_acctbal AS DECIMAL(12, 1)) AS dec, sha256(c_name) AS h, md5(c_name) AS m,
strftime(TIMESTAMP '2024-03-05 07:08:09' + INTERVAL 1 DAY * c_custkey, 'on %Y-%m-%d at %H:%M') AS day, TIMESTAMP '1970-01-01 00:00:00' + INTERVAL 1 SECOND * (c_custkey * 100000) AS at FROM customer"""
)
def fn_dialect_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, source(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "customer")
    return engine.sql(
        """SELECT c_custkey, regexp_match(c_name, '#0*([0-9]+)')[0] AS digits, CASE WHEN regexp_match(c_name, 'nothing like it') IS NULL THEN 'no' END AS missed, arrow_cast(c_custkey, 'Float64') AS d,
arrow_cast(c_acctbal, 'Decimal128(12, 1)') AS dec, lower(hex(digest(c_name, 'sha256'))) AS h, lower(hex(digest(c_name, 'md5'))) AS m,
to_char(TIMESTAMP_NTZ '2024-03-05 07:08:09' + make_dt_interval(c_custkey), 'on %Y-%m-%d at %H:%M') AS day, from_unixtime(c_custkey * 100000) AS at FROM customer"""
    )


@query("SELECT 'append' AS operation, parent_id IS NULL AS is_first, records FROM (VALUES (NULL, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')), (1, (SELECT count(*) FROM orders))) t(parent_id, records)")
def meta_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir)
    table = filled(spark, df.where("o_orderstatus = 'F'"), "orders")
    table.append(df.where("o_orderstatus <> 'F' OR o_orderstatus IS NULL"))
    return table.snapshots().selectExpr("operation", "parent_id IS NULL AS is_first", "CAST(summary['total-records'] AS BIGINT) AS records")


@query("SELECT CAST(0 AS INT) AS content, CAST(0 AS INT) AS deletes, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi, count(*) FILTER (WHERE o_orderstatus IS NULL) > 0 AS has_null FROM orders")
def meta_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filled(spark, orders(spark, sf_dir), "orders", partition_by=["o_orderstatus"]).manifests()
    part = "partition_summaries[0]"
    return found.selectExpr("content", "added_delete_files_count AS deletes", f"{part}.lower_bound AS lo", f"{part}.upper_bound AS hi", f"{part}.contains_null AS has_null")


@query("SELECT lower(column_name) AS column_name, CAST(pos AS INT) AS ordinal_position, 'YES' AS is_nullable FROM (VALUES (1, 'R_REGIONKEY'), (2, 'R_NAME')) t(pos, column_name)")
def information_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.from_warehouse(spark, scratch(spark, "warehouse").removeprefix("file://"), "demo")
    engine.create_namespace("demo")
    engine.sql("CREATE TABLE demo.region (R_REGIONKEY INT, R_NAME STRING)")
    return engine.sql("SELECT column_name, ordinal_position, is_nullable FROM information_schema.columns WHERE table_name = 'region'")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def copy_and_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows out to CSV, JSON and ORC and back."""
    rows = source(spark, sf_dir, "customer").select("c_custkey", "c_name").where("c_custkey % 2 = 0")
    for kind in ("csv", "json", "orc"):
        folder = scratch(spark, f"copy-{kind}")
        rows.write.format(kind).mode("overwrite").save(folder)
        rows = spark.read.schema(rows.schema).format(kind).load(folder)
    return rows


@query("SELECT 'customers' AS table_name")
def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.from_warehouse(spark, scratch(spark, "warehouse").removeprefix("file://"), "demo")
    engine.create_namespace("demo")
    engine.create_table("customers", demo(spark).schema)
    return engine.sql("SHOW TABLES IN demo;")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey BETWEEN 100 AND 120")
def prune_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    table = filled(spark, df.repartitionByRange(8, "l_orderkey"), "lineitem")
    return table.scan().where(col("l_orderkey", ">=", 100) & col("l_orderkey", "<=", 120)).to_df()


@query("SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 2 GROUP BY l_returnflag, l_linenumber")
def prune_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = filled(spark, source(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber"), "lineitem", partition_by=["l_returnflag"])
    found = table.scan().where(col("l_returnflag", "=", "R") & ~col("l_linenumber", "=", 2)).to_df()
    return found.groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"))


def _engine(spark: SparkSession, df: DataFrame, name: str, **options) -> Engine:  # noqa: ANN003
    engine = Engine.from_warehouse(spark, scratch(spark, "warehouse").removeprefix("file://"), "demo")
    engine.create_namespace("demo")
    engine.create_table(name, df.schema, **options)
    engine.insert(name, df)
    return engine


@query("SELECT l_returnflag, l_linenumber, count(*) AS n, 'demo.lineitem' AS source FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 2 GROUP BY l_returnflag, l_linenumber")
def sql_prune_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, source(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber"), "lineitem", partition_by=["l_returnflag"])
    return engine.sql("SELECT l_returnflag, l_linenumber, count(*) AS n, 'demo.lineitem' AS source FROM demo.lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 2 GROUP BY l_returnflag, l_linenumber")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey BETWEEN 100 AND 120 AND l_quantity > (SELECT avg(l_quantity) FROM lineitem WHERE l_orderkey < 50) GROUP BY l_orderkey")
def sql_prune_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, source(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").repartitionByRange(8, "l_orderkey"), "lineitem")
    return engine.sql("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey BETWEEN 100 AND 120 AND l_quantity > (SELECT avg(l_quantity) FROM lineitem WHERE l_orderkey < 50) GROUP BY l_orderkey")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def sql_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.from_warehouse(spark, scratch(spark, "warehouse").removeprefix("file://"), "demo")
    engine.create_namespace("demo")
    engine.sql("CREATE TABLE demo.region (r_regionkey INT, r_name STRING) PARTITIONED BY (bucket(4, r_regionkey))")
    engine.insert("region", source(spark, sf_dir, "region").selectExpr("CAST(r_regionkey AS INT) AS r_regionkey", "r_name"))
    engine.sql(f"CREATE EXTERNAL TABLE fixed LOCATION '{engine.open_table('region').metadata_path}'")
    engine.sql("DROP TABLE IF EXISTS demo.nothing")
    return engine.sql("SELECT r_regionkey, r_name FROM fixed WHERE r_regionkey > 1")


def _narrowed(spark: SparkSession, sf_dir: str, dimension: DataFrame) -> DataFrame:
    fact = filled(spark, source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").repartitionByRange(8, "l_orderkey"), "lineitem")
    edge = Edge(dimension, "l_orderkey", "o_orderkey")
    return star_join(fact.scan().where(bounds([edge])).to_df(), [edge]).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey BETWEEN 200 AND 260")
def fk_bounds_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _narrowed(spark, sf_dir, source(spark, sf_dir, "orders").where("o_orderkey BETWEEN 200 AND 260"))


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7")
def fk_bounds_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _narrowed(spark, sf_dir, source(spark, sf_dir, "orders").where("o_custkey = 7"))


STAR = "SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_custkey BETWEEN 5 AND 9 AND o_orderstatus = 'F' GROUP BY c_mktsegment"


@query(STAR)
def sql_star_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' keys narrow the orders, the orders' keys the lines, before any file is read for the join."""
    engine = Engine.from_warehouse(spark, scratch(spark, "warehouse").removeprefix("file://"), "demo", options=SessionOptions(key_bounds_rows=0))
    engine.create_namespace("demo")
    for name, columns, key in (("lineitem", ["l_orderkey", "l_extendedprice"], "l_orderkey"), ("orders", ["o_orderkey", "o_custkey", "o_orderstatus"], "o_custkey"), ("customer", ["c_custkey", "c_mktsegment"], "c_custkey")):
        df = source(spark, sf_dir, name).select(*columns).repartitionByRange(8, key)
        engine.create_table(name, df.schema)
        engine.insert(name, df)
    return engine.sql(STAR)


@query(
    """SELECT o_orderkey, CAST(floor(o_orderkey / 10.0) * 10 AS BIGINT) AS truncated, CAST(year(o_orderdate) - 1970 AS INT) AS y, CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS INT) AS m,
CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS d, CAST(date_diff('hour', TIMESTAMP '1970-01-01 00:00:00', o_orderdate) AS INT) AS h FROM orders"""
)
def fn_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.col("o_orderdate")
    of = lambda t, c, kind: Transform.parse(t).column(c, kind)
    return source(spark, sf_dir, "orders").select(
        "o_orderkey", of("truncate[10]", F.col("o_orderkey"), "long").alias("truncated"), *[of(t, when, "timestamp").alias(t[0]) for t in ("year", "month", "day", "hour")]
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
