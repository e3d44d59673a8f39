"""The engine: catalogs over one Spark session, SQL on snapshot tables."""

from __future__ import annotations

import io
import re
import time
from contextlib import redirect_stdout, suppress
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlake import sqlprep
from sparrowlake.config import Config, ConfigError, load
from sparrowlake.functions.dialect import translate
from sparrowlake.operators.predicate import IN_LIMIT, Always, Predicate, Test, conjuncts
from sparrowlake.operators.star import LARGE_ROWS, key_bounds
from sparrowlake.pushdown import KeyEdge, edges, filters, stand_in
from sparrowlake.sources.catalog import Catalog, CatalogError, MemoryCatalog, RestCatalog, WarehouseCatalog, match_name
from sparrowlake.sources.table import SnapshotTable, TableError


class EngineError(RuntimeError):
    pass


@dataclass(frozen=True)
class SessionOptions:
    target_partitions: int | None = None
    repartition_file_scans: bool = True
    join_dynamic_filters: bool = True
    repartition_joins: bool = True
    #: tables with fewer rows to read are not narrowed by the keys of their joins
    key_bounds_rows: int = LARGE_ROWS

    def settings(self) -> dict[str, str]:
        out = {"spark.sql.adaptive.enabled": "true", "spark.sql.optimizer.dynamicPartitionPruning.enabled": str(self.join_dynamic_filters).lower(), "spark.sql.optimizer.runtime.bloomFilter.enabled": str(self.join_dynamic_filters).lower()}
        if self.target_partitions:
            out["spark.sql.shuffle.partitions"] = str(self.target_partitions)
            if self.repartition_file_scans:
                out["spark.sql.files.minPartitionNum"] = str(self.target_partitions)
        if not self.repartition_joins:
            out["spark.sql.join.preferSortMergeJoin"] = "false"
        return out


@dataclass
class QueryResult:
    df: DataFrame
    columns: list[tuple[str, str]]
    elapsed_ms: float
    rows: list = field(default_factory=list)

    @property
    def row_count(self) -> int:
        return len(self.rows)

    def rows_as_strings(self, most: int = 5000) -> list[list[str]]:
        return [["NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r] for r in self.rows[:most]]

    def text(self) -> str:
        table = [[c for c, _ in self.columns], *self.rows_as_strings()]
        widths = [max(len(r[i]) for r in table) for i in range(len(self.columns))]
        return "\n".join(" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in table)


class Engine:
    def __init__(self, spark: SparkSession, catalogs: dict[str, Catalog], default_catalog: str, default_schema: str = "public", options: SessionOptions | None = None):
        self.spark, self.catalogs, self.options = spark, catalogs, options or SessionOptions()
        self.default_catalog, self.default_schema = default_catalog, default_schema
        self._external: dict[str, SnapshotTable] = {}
        for k, v in self.options.settings().items():
            spark.conf.set(k, v)

    # -- opening

    @classmethod
    def from_warehouse(cls, spark: SparkSession, path: str, schema: str = "public", catalog: str = "local", options: SessionOptions | None = None) -> Engine:
        return cls(spark, {catalog: WarehouseCatalog(spark, path)}, catalog, schema, options)

    @classmethod
    def from_config(cls, spark: SparkSession, config: Config | str | None = None, options: SessionOptions | None = None) -> Engine:
        own = config if isinstance(config, Config) else load(config)
        catalogs: dict[str, Catalog] = {}
        for name, c in own.catalogs.items():
            if c.type in ("hadoop", "warehouse"):
                catalogs[name] = WarehouseCatalog(spark, c.properties.get("warehouse", ""))
            elif c.type == "memory":
                catalogs[name] = MemoryCatalog(spark, c.properties.get("warehouse") or spark.conf.get("spark.sql.warehouse.dir"))
            elif c.type == "rest":
                catalogs[name] = RestCatalog(spark, c.properties.get("uri", ""))
            else:
                raise ConfigError(f"unknown catalog type {c.type}")
        return cls(spark, catalogs, own.default_catalog, own.default_schema, options)

    @property
    def catalog(self) -> Catalog:
        return self.catalogs[self.default_catalog]

    def set_default_catalog(self, name: str, schema: str | None = None) -> None:
        """Options stay as they are."""
        found = match_name(name, list(self.catalogs))
        if found is None:
            raise EngineError(f"no catalog {name} among {sorted(self.catalogs)}")
        self.default_catalog = found
        self.default_schema = schema or self.default_schema

    # -- tables

    def _parts(self, name: str) -> tuple[Catalog, str, str]:
        parts = [sqlprep.unquoted(p) for p in re.findall(r"`[^`]*`|\"[^\"]*\"|[^.]+", name)]
        catalog = self.catalog
        if len(parts) == 3:
            found = match_name(parts[0], list(self.catalogs))
            if found is None:
                raise EngineError(f"no catalog {parts[0]}")
            catalog, parts = self.catalogs[found], parts[1:]
        return (catalog, *(parts if len(parts) == 2 else (self.default_schema, parts[0])))

    def open_table(self, name: str) -> SnapshotTable:
        if name.lower() in self._external:
            return self._external[name.lower()]
        catalog, namespace, table = self._parts(name)
        return catalog.load_table(namespace, table)

    def table(self, name: str, snapshot_id: int | None = None) -> DataFrame:
        """The current rows, or those of a snapshot; columns in lower case."""
        df = self.open_table(name).to_df(snapshot_id)
        return df.toDF(*[c.lower() for c in df.columns])

    def create_namespace(self, name: str) -> None:
        self.catalog.create_namespace(name)

    def create_table(self, name: str, schema: T.StructType | DataFrame | str, **options) -> SnapshotTable:  # noqa: ANN003
        """An empty table; a DataFrame gives its schema and must have no rows."""
        if isinstance(schema, DataFrame):
            if not schema.isEmpty():
                raise TableError("create_table takes a schema, not rows; append them afterwards")
            schema = schema.schema
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        catalog, namespace, table = self._parts(name)
        return catalog.create_table(namespace, table, schema, **options)

    def drop_table(self, name: str) -> bool:
        catalog, namespace, table = self._parts(name)
        self.spark.catalog.dropTempView(table)
        return catalog.drop_table(namespace, table)

    def register_external(self, name: str, metadata_path: str, snapshot_id: int | None = None) -> SnapshotTable:
        """A read-only table from a metadata file."""
        found = SnapshotTable.open_static(self.spark, name, metadata_path, snapshot_id)
        self._external[name.lower()] = found
        return found

    def insert(self, name: str, df: DataFrame) -> DataFrame:
        n = self.open_table(name).append(df)
        return self.spark.createDataFrame([(n,)] if n else [], "count long")

    def show_tables(self, namespace: str | None = None) -> DataFrame:
        wanted = namespace or self.default_schema
        own = match_name(wanted, self.catalog.list_namespaces())
        if own is None:
            raise EngineError(sqlprep.hint(f"namespace {wanted} not found"))
        return self.spark.createDataFrame([(t,) for t in self.catalog.list_tables(own)], "table_name string")

    def information_schema(self) -> tuple[DataFrame, DataFrame]:
        """Tables and columns of the default catalog."""
        tables, columns = [], []
        for namespace in self.catalog.list_namespaces():
            for t in self.catalog.list_tables(namespace):
                tables.append((self.default_catalog, namespace, t, "BASE TABLE"))
                for i, f in enumerate(self.catalog.load_table(namespace, t).metadata.schema.fields):
                    columns.append((self.default_catalog, namespace, t, f.name.lower(), i + 1, "NO" if f.required else "YES", str(f.type) if isinstance(f.type, str) else type(f.type).__name__.lower()))
        return (
            self.spark.createDataFrame(tables, "table_catalog string, table_schema string, table_name string, table_type string"),
            self.spark.createDataFrame(columns, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string"),
        )

    # -- SQL

    def _register(self, sql: str) -> str:
        """Make views of the tables that the statement names, at their current snapshots and without files that its filters exclude; the statement with names Spark finds."""
        sql = sqlprep.quote_metadata_tables(translate(sql))
        pieces = sqlprep.outside_quotes(sql)
        words = {w.lower() for quoted, x in pieces if not quoted or x[:1] == "`" for w in re.findall(r"[\w$]+", x)}
        names: dict[str, str] = {}
        if "information_schema" in words:
            for view, df in zip(("tables", "columns"), self.information_schema(), strict=True):
                df.createOrReplaceTempView(f"information_schema_{view}")
                names[rf"information_schema\.{view}()"] = f"information_schema_{view}"
        views: dict[str, SnapshotTable] = {}
        for label, catalog in self.catalogs.items():
            for namespace in catalog.list_namespaces():
                for t in catalog.list_tables(namespace):
                    if not ({t.lower(), f"{t.lower()}$snapshots", f"{t.lower()}$manifests"} & words):
                        continue
                    own = catalog is self.catalog and namespace.lower() == self.default_schema.lower()
                    view = t.lower() if own else f"{label}__{namespace}__{t}".lower()
                    self._views(view, catalog.load_table(namespace, t), words, t.lower(), views)
                    for prefix in ([rf"{label}\.{namespace}\."] + ([rf"{namespace}\."] if catalog is self.catalog else [])):
                        names[prefix + rf"`?{re.escape(t)}(\$snapshots|\$manifests)?`?"] = view
        for name, found in self._external.items():
            if name in words:
                self._views(name, found, words, name, views)
        for pattern, view in sorted(names.items(), key=lambda x: -len(x[0])):
            sql = sqlprep.renamed(sql, pattern, view)
        self._prune(sql, views)
        return sql

    def _views(self, view: str, table: SnapshotTable, words: set[str], name: str, views: dict[str, SnapshotTable]) -> None:
        if f"{name}$snapshots" in words:
            table.snapshots().createOrReplaceTempView(f"`{view}$snapshots`")
        if f"{name}$manifests" in words:
            table.manifests().createOrReplaceTempView(f"`{view}$manifests`")
        if name in words or f"{name}$snapshots" not in words:
            views[view] = table.refresh()

    def _prune(self, sql: str, views: dict[str, SnapshotTable]) -> None:
        """Views of the tables' scans; which files they read follows from the statement's own filters."""
        lower = lambda shape: T.StructType([T.StructField(f.name.lower(), f.dataType, f.nullable, f.metadata) for f in shape.fields])
        found: dict[str, Predicate] = {}
        if views:
            for view, table in views.items():
                stand_in(self.spark, lower(table.scan().schema.spark()), view).createOrReplaceTempView(view)
            with suppress(AnalysisException, ParseException):  # the statement itself says what is wrong with it
                planned = self.spark.sql(sql.rstrip().rstrip(";"))
                found = filters(planned)
                if self.options.join_dynamic_filters:
                    found = self._narrowed(views, found, edges(planned))
        for view, table in views.items():
            df = table.scan().where(found.get(view, Always(True))).to_df()
            df.toDF(*[c.lower() for c in df.columns]).createOrReplaceTempView(view)

    def _narrowed(self, views: dict[str, SnapshotTable], found: dict[str, Predicate], joins: list[KeyEdge]) -> dict[str, Predicate]:
        """The filters, and for large tables the bounds of the keys of small, filtered tables that they are joined to; smallest first."""
        scan = lambda view: views[view].scan().where(found.get(view, Always(True)))
        rows = {view: sum(t.file.rows for t in scan(view).plan()) for view in {v for e in joins for v in (e.fact, e.dimension)}}
        found = dict(found)
        for e in sorted(joins, key=lambda e: rows[e.dimension]):
            filtered = any(not isinstance(p, Test) or p.op != "not_null" for p in conjuncts(found.get(e.dimension, Always(True))) if p != Always(True))
            if filtered and rows[e.fact] >= self.options.key_bounds_rows and rows[e.dimension] <= min(LARGE_ROWS, rows[e.fact]):
                found[e.fact] = found.get(e.fact, Always(True)) & key_bounds(scan(e.dimension).to_df(), e.dimension_key, e.fact_key, most_keys=IN_LIMIT)
        return found

    def sql(self, sql: str) -> DataFrame:
        is_show, namespace = sqlprep.parse_show_tables(sql)
        if is_show:
            return self.show_tables(namespace)
        try:
            if found := sqlprep.parse_insert(sql):
                name, columns, source = found
                rows = self.spark.sql(self._register(source))
                table = self.open_table(name)
                wanted = columns or [f.name for f in table.metadata.schema.fields]
                if len(wanted) != len(rows.columns):
                    raise EngineError(f"INSERT gives {len(rows.columns)} columns for {len(wanted)}")
                return self.insert(name, rows.toDF(*wanted))
            if ddl := sqlprep.parse_ddl(sql):
                return self._define(ddl)
            if re.match(r"\s*insert\s+overwrite\b|\s*(delete|update|merge)\b", sql, re.IGNORECASE):
                raise EngineError("only INSERT INTO changes tables by SQL; see SnapshotTable for deletes")
            return self.spark.sql(self._register(sql).rstrip().rstrip(";"))
        except (AnalysisException, ParseException, CatalogError) as e:
            raise EngineError(sqlprep.hint(str(e))) from e

    def _define(self, ddl: sqlprep.Definition) -> DataFrame:
        """CREATE TABLE, CREATE EXTERNAL TABLE and DROP TABLE; no rows."""
        if ddl.kind == "drop":
            if self._external.pop(ddl.name.lower(), None) is None:
                try:
                    dropped = self.drop_table(ddl.name)
                except CatalogError:
                    dropped = False
                if not dropped and not ddl.lenient:
                    raise EngineError(sqlprep.hint(f"table {ddl.name} not found"))
        elif ddl.kind == "external":
            self.register_external(ddl.name, ddl.location or "")
        else:
            try:
                self.create_table(ddl.name, ddl.columns, partition_by=ddl.partition_by)
            except (CatalogError, TableError):
                if not ddl.lenient:
                    raise
        return self.spark.createDataFrame([], "count long")

    def query(self, sql: str) -> QueryResult:
        began = time.perf_counter()
        df = self.sql(sql)
        rows = [tuple(r) for r in df.collect()]
        return QueryResult(df, [(f.name, f.dataType.simpleString()) for f in df.schema.fields], (time.perf_counter() - began) * 1000, rows)

    def explain(self, sql: str) -> str:
        df, text = self.sql(sql), io.StringIO()
        with redirect_stdout(text):
            df.explain("formatted")
        return f"=== logical_plan ===\n{df._jdf.queryExecution().optimizedPlan().toString()}\n\n=== physical_plan ===\n{text.getvalue()}"

    def explain_analyze(self, sql: str) -> str:
        """Run the statement; its plan with rows and times of each operator."""
        df = self.sql(sql)
        execution = df._jdf.queryExecution()
        began = time.perf_counter()
        rows = execution.executedPlan().executeCollect()
        took = (time.perf_counter() - began) * 1000
        lines: list[str] = []

        def walk(node, depth: int) -> None:  # noqa: ANN001
            plan = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
            if "QueryStage" in plan.nodeName():
                plan = plan.plan()
            shown, it = [], plan.metrics().iterator()
            while it.hasNext():
                pair = it.next()
                if pair._2().value() > 0:
                    shown.append(f"{pair._1()}={pair._2().value()}")
            lines.append("  " * depth + plan.nodeName() + (f" [{', '.join(sorted(shown))}]" if shown else ""))
            children = plan.children()
            for i in range(children.size()):
                walk(children.apply(i), depth + 1)

        walk(execution.executedPlan(), 0)
        return f"=== analyzed_plan ===\n" + "\n".join(lines) + f"\n\nrows={len(rows)} elapsed_ms={took:.1f}"


def demo(spark: SparkSession) -> DataFrame:
    """Three customers, for a first query."""
    return spark.createDataFrame([(1, "Alice", "US"), (2, "Bob", "US"), (3, "Carlos", "EU")], "id int not null, name string not null, region string not null")


__all__ = ["Engine", "EngineError", "F", "QueryResult", "SessionOptions", "demo"]
