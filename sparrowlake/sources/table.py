"""Snapshot tables: scans with file pruning, time travel, metadata tables, appends, deletes, evolution."""

from __future__ import annotations

import json
import math
import random
import re
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowlake.operators.predicate import Always, Predicate, bind, may_match, project, to_column, without_not
from sparrowlake.operators.transforms import Transform
from sparrowlake.sources import avro, manifests
from sparrowlake.sources.fileio import AlreadyExists, FileIO, resolve
from sparrowlake.sources.metadata import DATA, EQUALITY_DELETES, POSITION_DELETES, DataFile, Manifest, MetadataError, PartitionSpec, TableMetadata, now_ms, sort_orders, summarise
from sparrowlake.sources.schema import Schema, field_to_spark

#: Reads by field id: a renamed column is found, a column that a file lacks is null.
READ_SETTINGS = {"spark.sql.parquet.fieldId.read.enabled": "true", "spark.sql.parquet.fieldId.read.ignoreMissing": "true", "spark.sql.parquet.fieldId.write.enabled": "true"}
SNAPSHOTS_SCHEMA = "committed_at timestamp not null, snapshot_id long not null, parent_id long, operation string, manifest_list string, summary map<string,string>"
MANIFESTS_SCHEMA = (
    "content int not null, path string not null, length long not null, partition_spec_id int not null, added_snapshot_id long not null, added_data_files_count int not null, existing_data_files_count int not null, "
    "deleted_data_files_count int not null, added_delete_files_count int not null, existing_delete_files_count int not null, deleted_delete_files_count int not null, "
    "partition_summaries array<struct<contains_null: boolean not null, contains_nan: boolean, lower_bound: string, upper_bound: string>> not null"
)

#: Field ids of the columns of positional deletes.
PATH_ID, POSITION_ID = 2147483546, 2147483545

#: Bounds of strings are cut after so many characters, upper ones rounded up.
BOUND_CHARS = 16


#: In place of a spec id: the spec without fields, whose deletes reach every partition.
EVERYWHERE = -1


class CommitFailed(RuntimeError):
    pass


class TableError(ValueError):
    pass


#: Manifests and their lists never change; what was read stays while the files together are no larger.
CACHE_BYTES = 32_000_000
_CACHE: OrderedDict[str, tuple[int, dict[str, str] | None, list[dict]]] = OrderedDict()


def _records(io: FileIO, path: str) -> tuple[dict[str, str] | None, list[dict]]:
    """What an Avro file says about itself, and its records; lines of JSON, as earlier versions wrote, say nothing."""
    if path in _CACHE:
        _CACHE.move_to_end(path)
        return _CACHE[path][1:]
    data = io.read_bytes(path)
    about, records = avro.load(data) if data[:4] == avro.MAGIC else (None, [json.loads(line) for line in data.decode().splitlines()])
    _CACHE[path] = (len(data), about, records)
    while len(_CACHE) > 1 and sum(size for size, _, _ in _CACHE.values()) > CACHE_BYTES:
        _CACHE.popitem(last=False)
    return about, records


def _listed(io: FileIO, path: str, meta: TableMetadata) -> list[Manifest]:
    about, records = _records(io, resolve(path))
    return [Manifest.from_json(x) for x in records] if about is None else manifests.load_list(records, meta)


def _files(io: FileIO, manifest: Manifest, meta: TableMetadata) -> list[DataFile]:
    about, records = _records(io, manifest.path)
    return [DataFile.from_json(x) for x in records] if about is None else manifests.load_entries(about, records, manifest, meta)


@dataclass(frozen=True)
class ScanTask:
    file: DataFile
    deletes: tuple[DataFile, ...]


@dataclass(frozen=True)
class TableScan:
    """Built step by step: ``table.scan().select(...).where(...).at(snapshot_id).to_df()``."""

    table: SnapshotTable
    columns: tuple[str, ...] | None = None
    predicate: Predicate = Always(True)
    snapshot_id: int | None = None
    rows: int | None = None
    prune: bool = True

    def select(self, *columns: str) -> TableScan:
        return replace(self, columns=columns)

    def select_all(self) -> TableScan:
        return replace(self, columns=None)

    def select_empty(self) -> TableScan:
        return replace(self, columns=())

    def where(self, predicate: Predicate) -> TableScan:
        return replace(self, predicate=self.predicate & predicate)

    def at(self, snapshot_id: int | None) -> TableScan:
        return replace(self, snapshot_id=snapshot_id)

    def limit(self, rows: int) -> TableScan:
        return replace(self, rows=rows)

    def with_pruning(self, on: bool) -> TableScan:
        return replace(self, prune=on)

    @property
    def snapshot(self) -> dict | None:
        meta = self.table.metadata
        if self.snapshot_id is None:
            return meta.current_snapshot
        found = meta.snapshot(self.snapshot_id)
        if found is None:
            raise TableError(f"snapshot id {self.snapshot_id} not found in table {self.table.name}")
        return found

    @property
    def schema(self) -> Schema:
        """That of the snapshot when one is named, else the current one."""
        meta, snapshot = self.table.metadata, self.snapshot
        return meta.schemas[snapshot.get("schema-id", meta.schema.schema_id)] if self.snapshot_id is not None and snapshot else meta.schema

    def plan(self) -> list[ScanTask]:
        """Files that may hold matching rows, each with the delete files that apply to it: later ones of its partition, or of all."""
        snapshot = self.snapshot
        if snapshot is None:
            return []
        predicate = without_not(bind(self.predicate, self.schema))
        data: list[DataFile] = []
        deletes: list[DataFile] = []
        for manifest in self.table.listed(snapshot):
            spec = self.table.metadata.specs[manifest.spec_id]
            implied = _implied(predicate, spec)
            if manifest.content == DATA and self.prune and not may_match(implied, manifest.stats()):
                continue
            for f in _files(self.table.io, manifest, self.table.metadata):
                if f.content != DATA:
                    deletes.append(f)
                elif not self.prune or (may_match(implied, f.partition_stats()) and may_match(predicate, f.stats()) and f.rows > 0):
                    data.append(f)
        placed: dict[tuple | None, list[DataFile]] = {}
        for d in deletes:
            placed.setdefault(_place(d) if d.partition else None, []).append(d)
        return [ScanTask(f, tuple(d for d in placed.get(None, []) + (placed.get(_place(f), []) if f.partition else []) if _follows(d, f))) for f in data]

    def to_df(self) -> DataFrame:
        spark, schema = self.table.spark, self.schema
        tasks = self.plan()
        shape = schema.spark()
        groups: dict[tuple[str, ...], list[ScanTask]] = {}
        for task in tasks:
            groups.setdefault(tuple(sorted(d.path for d in task.deletes)), []).append(task)
        out: DataFrame | None = None
        for paths, group in groups.items():
            part = self._read(group, {d.path: d for t in group for d in t.deletes}, paths, shape)
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = spark.createDataFrame([], shape)
        if self.predicate != Always(True):
            out = out.where(to_column(self.predicate))  # files are pruned, rows are decided here
        if self.columns is not None:
            out = out.select(*[F.col(f"`{schema.find(c).name}`") for c in self.columns])
        return out if self.rows is None else out.limit(self.rows)

    def _read(self, group: list[ScanTask], deletes: dict[str, DataFile], paths: tuple[str, ...], shape: T.StructType) -> DataFrame:
        spark = self.table.spark
        files = [t.file.path for t in group]
        read = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(*files)
        if not paths:
            return read
        keyed = read.select("*", _plain_path(F.col("_metadata.file_path")).alias("__path"), F.col("_metadata.row_index").alias("__pos"))
        positional = [deletes[p].path for p in paths if deletes[p].content == POSITION_DELETES]
        if positional:
            gone = spark.read.option("recursiveFileLookup", "true").schema("file_path string, pos long").parquet(*positional)
            keyed = keyed.join(gone.select(F.col("file_path").alias("__path"), F.col("pos").alias("__pos")).distinct(), ["__path", "__pos"], "left_anti")
        by_keys: dict[tuple[int, ...], list[str]] = {}
        for p in paths:
            if deletes[p].content == EQUALITY_DELETES:
                by_keys.setdefault(deletes[p].equality_ids, []).append(p)
        for ids, own in by_keys.items():
            fields = [self.schema.by_id(i) for i in ids]
            gone = spark.read.option("recursiveFileLookup", "true").schema(T.StructType([field_to_spark(replace(f, required=False)) for f in fields])).parquet(*own)
            gone = gone.toDF(*[f"__d{i}" for i in ids]).distinct()
            match = None
            for f in fields:
                one = keyed[f.name].eqNullSafe(gone[f"__d{f.id}"])
                match = one if match is None else match & one
            keyed = keyed.join(gone, match, "left_anti")
        return keyed.drop("__path", "__pos")

    def explain(self) -> str:
        tasks = self.plan()
        shown = ", ".join(self.columns) if self.columns is not None else ", ".join(f.name for f in self.schema.fields)
        return f"SnapshotTableScan planned_files={len(tasks)} projection:[{shown}] predicate:[{show(self.predicate)}]"


def show(p: Predicate) -> str:
    if isinstance(p, Always):
        return "" if p.value else "false"
    if hasattr(p, "kind"):
        return f"({show(p.left)}) {p.kind.upper()} ({show(p.right)})"
    if hasattr(p, "inner"):
        return f"NOT ({show(p.inner)})"
    words = {"is_null": "IS NULL", "not_null": "IS NOT NULL", "is_nan": "IS NAN", "not_nan": "IS NOT NAN", "starts_with": "STARTS WITH", "not_starts_with": "NOT STARTS WITH", "in": "IN", "not_in": "NOT IN"}
    tail = "" if p.value is None else f" {p.value!r}"
    return f"{p.column} {words.get(p.op, p.op)}{tail}"


def _above(bound: Row) -> str | None:
    """What no string with this beginning exceeds: the beginning itself if it is whole, else the next greater one."""
    head = bound.head
    if head is None or not bound.cut:
        return head
    while head:
        n = ord(head[-1]) + 1
        if n <= 0x10FFFF:
            return head[:-1] + chr(0xE000 if n == 0xD800 else n)
        head = head[:-1]
    return None


def _plain_path(path: Column) -> Column:
    """As paths are stored: without file: and with one leading slash."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), r"\+", "%2B"))


def _implied(p: Predicate, spec: PartitionSpec) -> Predicate:
    """What the predicate says about partition values: the conjunction over the spec's fields."""
    out: Predicate = Always(True)
    for f in spec.fields:
        out = out & project(p, f.source_id, f.transform, f.field_id)
    return out


def _place(f: DataFile) -> tuple:
    return (f.spec_id, *sorted(f.partition.items()))


def _follows(delete: DataFile, data: DataFile) -> bool:
    """Positional deletes reach their own commit and earlier data, equality deletes earlier data only."""
    return delete.sequence >= data.sequence if delete.content == POSITION_DELETES else delete.sequence > data.sequence


def _sort_fields(schema: Schema, columns: list[str | tuple[str, ...]]) -> list[dict]:
    out = []
    for c in columns:
        name, direction, nulls = ((c,) if isinstance(c, str) else tuple(c)) + (None,) * (2 if isinstance(c, str) else 3 - len(c))
        direction = direction or "asc"
        nulls = nulls or ("nulls-first" if direction == "asc" else "nulls-last")
        if direction not in ("asc", "desc") or nulls not in ("nulls-first", "nulls-last"):
            raise TableError(f"not a sort order: {c}")
        out.append({"source-id": schema.find(name).id, "transform": "identity", "direction": direction, "null-order": nulls})
    return out


def _sorted_by(x: dict, schema: Schema) -> Column:
    source = schema.by_id(x["source-id"])
    c = Transform.parse(x["transform"]).column(F.col(f"c{source.id}"), source.type)
    return getattr(c, f"{x['direction']}_{x['null-order'].replace('-', '_')}")()


class SnapshotTable:
    """A handle on a table. ``static`` handles never reload and cannot be written."""

    def __init__(self, spark: SparkSession, name: str, metadata: TableMetadata, metadata_path: str, *, static: bool = False, snapshot_id: int | None = None):
        self.spark, self.name, self._metadata, self.metadata_path, self.static, self.snapshot_id = spark, name, metadata, metadata_path, static, snapshot_id
        self.io = _io(spark)
        for k, v in READ_SETTINGS.items():
            spark.conf.set(k, v)
        if any(not isinstance(f.type, str) for f in metadata.schema.fields):
            # pruned structs lose the ids of their columns, and with them the columns
            spark.conf.set("spark.sql.optimizer.nestedSchemaPruning.enabled", "false")
        if snapshot_id is not None:
            self.scan()  # an unknown snapshot is an error at once
            _ = self.scan().snapshot

    # -- opening and creating

    @classmethod
    def create(
        cls, spark: SparkSession, name: str, location: str, schema: T.StructType | Schema, partition_by: list[tuple[str, str] | str] | None = None, properties: dict[str, str] | None = None, sort_order: list[str | tuple[str, ...]] | None = None
    ) -> SnapshotTable:
        own = schema if isinstance(schema, Schema) else Schema.from_spark(schema)
        order = _sort_fields(own, sort_order or [])
        meta = TableMetadata.new(resolve(location), own, PartitionSpec.build(own, partition_by or []), properties, order)
        path = f"{resolve(location).rstrip('/')}/metadata/v1.metadata.json"
        try:
            _io(spark).create(path, meta.text())
        except AlreadyExists:
            raise TableError(f"Table {name} already exists") from None
        table = cls(spark, name, meta, path)
        table._hint(1)
        return table

    @classmethod
    def open(cls, spark: SparkSession, name: str, location: str) -> SnapshotTable:
        path = latest_metadata(_io(spark), resolve(location))
        if path is None:
            raise TableError(f"no table metadata at {location}")
        return cls(spark, name, TableMetadata.parse(_io(spark).read(path)), path)

    @classmethod
    def open_static(cls, spark: SparkSession, name: str, metadata_path: str, snapshot_id: int | None = None) -> SnapshotTable:
        path = resolve(metadata_path)
        return cls(spark, name, TableMetadata.parse(_io(spark).read(path)), path, static=True, snapshot_id=snapshot_id)

    @property
    def metadata(self) -> TableMetadata:
        return self._metadata

    def refresh(self) -> SnapshotTable:
        if not self.static:
            path = latest_metadata(self.io, self._metadata.location) or self.metadata_path
            if path != self.metadata_path:
                self._metadata, self.metadata_path = TableMetadata.parse(self.io.read(path)), path
        return self

    # -- reading

    def scan(self) -> TableScan:
        return TableScan(self, snapshot_id=self.snapshot_id)

    def to_df(self, snapshot_id: int | None = None) -> DataFrame:
        self.refresh()
        return self.scan().at(snapshot_id if snapshot_id is not None else self.snapshot_id).to_df()

    def listed(self, snapshot: dict | None) -> list[Manifest]:
        """The manifests of a snapshot; the oldest format may name them in the metadata itself."""
        if snapshot is None:
            return []
        if "manifest-list" not in snapshot:
            raise TableError(f"snapshot {snapshot['snapshot-id']} of {self.name} has no manifest list")
        return _listed(self.io, snapshot["manifest-list"], self.metadata)

    def snapshots(self) -> DataFrame:
        rows = [
            Row(
                committed_at=_utc(s["timestamp-ms"]), snapshot_id=s["snapshot-id"], parent_id=s.get("parent-snapshot-id"), operation=s.get("summary", {}).get("operation"),
                manifest_list=s.get("manifest-list"), summary={k: str(v) for k, v in s.get("summary", {}).items() if k != "operation"},
            )
            for s in self.refresh().metadata.snapshots
        ]
        return self.spark.createDataFrame(rows, SNAPSHOTS_SCHEMA)

    def manifests(self) -> DataFrame:
        rows = []
        for m in self.listed(self.refresh().metadata.current_snapshot):
            data = m.content == DATA
            text = lambda v: None if v is None else str(v)
            summaries = [(s["contains_null"], s.get("contains_nan"), text(s["lower"]), text(s["upper"])) for s in m.summaries.values()]
            rows.append((0 if data else 1, m.path, m.length, m.spec_id, m.snapshot_id, *(n * of for of in (data, not data) for n in (m.added_files, m.existing_files, m.deleted_files)), summaries))
        return self.spark.createDataFrame(rows, MANIFESTS_SCHEMA)

    # -- writing

    def append(self, df: DataFrame) -> int:
        """Add rows; columns go by name, missing ones are null. Returns how many; no rows make no snapshot."""
        self._writable()
        files = self._write(df)
        if not files:
            return 0
        self._commit_files(files, "append")
        return sum(f.rows for f in files)

    def delete_positions(self, positions: DataFrame) -> int:
        """Mark rows (file_path, pos) as deleted."""
        self._writable()
        rows = positions.select(
            *[c.alias(n, metadata={"parquet.field.id": i}) for c, n, i in ((_plain_path(F.col("file_path")), "file_path", PATH_ID), (F.col("pos").cast("long"), "pos", POSITION_ID))]
        )
        return self._write_deletes(rows, POSITION_DELETES, ())

    def delete_where(self, condition: Column) -> int:
        """Mark the rows that meet a condition as deleted by their positions."""
        self._writable()
        found = None
        for group in self._grouped():
            part = group.where(condition).select(F.col("__path").alias("file_path"), F.col("__pos").alias("pos"))
            found = part if found is None else found.unionByName(part)
        return 0 if found is None else self._write_deletes(found, POSITION_DELETES, ())

    def _grouped(self) -> list[DataFrame]:
        scan = self.refresh().scan()
        tasks = scan.plan()
        if not tasks:
            return []
        read = self.spark.read.schema(scan.schema.spark()).option("recursiveFileLookup", "true").parquet(*[t.file.path for t in tasks])
        return [read.select("*", _plain_path(F.col("_metadata.file_path")).alias("__path"), F.col("_metadata.row_index").alias("__pos"))]

    def delete_equal(self, keys: DataFrame) -> int:
        """Mark earlier rows as deleted whose values in the keys' columns equal a row of ``keys``; nulls equal nulls."""
        self._writable()
        fields = [self.metadata.schema.find(c) for c in keys.columns]
        typed = keys.select(*[F.col(f"`{c}`").cast(field_to_spark(f).dataType).alias(f.name, metadata={"parquet.field.id": f.id}) for c, f in zip(keys.columns, fields, strict=True)])
        return self._write_deletes(typed, EQUALITY_DELETES, tuple(f.id for f in fields))

    def _write_deletes(self, rows: DataFrame, content: int, ids: tuple[int, ...]) -> int:
        folder = f"{self.metadata.location}/data/deletes-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        counts = {r.path: r.n for r in self.spark.read.schema(rows.schema).parquet(folder).groupBy(_plain_path(F.col("_metadata.file_path")).alias("path")).agg(F.count("*").alias("n")).collect()}
        if not counts:
            self.io.delete(folder)
            return 0
        self._commit_files([DataFile(p, content, n, self.io.size(p), EVERYWHERE, equality_ids=ids, schema_id=self.metadata.schema.schema_id) for p, n in sorted(counts.items())], "delete")
        return sum(counts.values())

    def _write(self, df: DataFrame) -> list[DataFile]:
        """Write the rows under the table's location; the files with their statistics."""
        if (kind := self.metadata.properties.get("write.format.default", "parquet")) != "parquet":
            raise TableError(f"cannot write {kind} files")
        schema, spec = self.metadata.schema, self.metadata.spec
        given = {c.lower(): c for c in df.columns}
        if extra := set(given) - {f.name.lower() for f in schema.fields}:
            raise TableError(f"no such columns in {self.name}: {sorted(extra)}")
        columns = []
        for f in schema.fields:
            source = F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None)
            if f.required:
                source = F.when(source.isNotNull(), source).otherwise(F.raise_error(F.lit(f"null in required column {f.name}")))
            # physical names never matter, as reads go by field id; these cannot clash with partition columns
            columns.append(source.cast(field_to_spark(f).dataType).alias(f"c{f.id}", metadata={"parquet.field.id": f.id}))
        rows = df.select(*columns)
        names = []
        for p in spec.fields:
            source = schema.by_id(p.source_id)
            rows = rows.withColumn(p.name, p.transform.column(F.col(f"c{source.id}"), source.type))
            names.append(p.name)
        folder = f"{self.metadata.location}/data/{uuid.uuid4().hex}"
        rows = self._dealt(rows, names)
        order = [_sorted_by(x, schema) for x in self.metadata.sort_fields]
        if names and not self._fanout() or order:
            rows = rows.sortWithinPartitions(*names, *order)
        writer = rows.write.option("maxRecordsPerFile", int(self.metadata.properties.get("write.max-records-per-file", 0)))
        for k, v in self.metadata.properties.items():
            if k.startswith("write.parquet.bloom-filter-enabled.column."):
                writer = writer.option(f"parquet.bloom.filter.enabled#c{schema.find(k.rpartition('.')[2]).id}", v)
        (writer.partitionBy(*names) if names else writer).parquet(folder)
        return self._measured(folder, rows.schema, spec)

    def _fanout(self) -> bool:
        return self.metadata.properties.get("write.datafusion.fanout.enabled", "true").lower() == "true"

    def _dealt(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """By partition if a field spreads its values (identity, bucket), so that a partition's rows meet; else as they come."""
        n = int(self.metadata.properties.get("write.partitions", 0))
        spread = any(f.transform.kind in ("identity", "bucket") for f in self.metadata.spec.fields)
        if spread:
            # AQE may split what a hot partition gets
            return rows.repartition(n, *names) if n else rows.hint("rebalance", *names)
        return rows.repartition(n) if n else rows

    def _measured(self, folder: str, written: T.StructType, spec: PartitionSpec) -> list[DataFile]:
        """One pass over the written rows: counts and bounds by file."""
        schema = self.metadata.schema
        kinds = {f.id: f.type for f in schema.fields}
        physical = T.StructType([x for x in written.fields if x.name.startswith("c") and x.name not in {f.name for f in spec.fields}])
        rows = self.spark.read.schema(physical).option("recursiveFileLookup", "true").parquet(folder)
        rows = rows.select("*", _plain_path(F.col("_metadata.file_path")).alias("__path"))
        aggs = [F.count("*").alias("rows")]
        for f in schema.fields:
            c = F.col(f"c{f.id}")
            aggs.append(F.count_if(c.isNull()).alias(f"nulls_{f.id}"))
            if not isinstance(f.type, str) or f.type in ("time", "uuid"):
                continue
            if f.type in ("float", "double"):
                aggs.append(F.count_if(F.isnan(c)).alias(f"nans_{f.id}"))
                c = F.when(~F.isnan(c), c)
            if f.type == "string":  # whole texts stay out of manifests and of the driver
                head = F.substring(c, 1, BOUND_CHARS)
                aggs += [F.min(head).alias(f"lower_{f.id}"), F.max(F.struct(head.alias("head"), (F.length(c) > BOUND_CHARS).alias("cut"))).alias(f"upper_{f.id}")]
            elif f.type == "boolean" or not f.type.startswith(("binary", "fixed")):
                aggs += [F.min(c).alias(f"lower_{f.id}"), F.max(c).alias(f"upper_{f.id}")]
        parts = []
        for p in spec.fields:
            source = schema.by_id(p.source_id)
            rows = rows.withColumn(f"p{p.field_id}", p.transform.column(F.col(f"c{source.id}"), source.type))
            aggs.append(F.first(f"p{p.field_id}").alias(f"part_{p.field_id}"))
            parts.append(p.field_id)
        out = []
        for r in rows.groupBy("__path").agg(*aggs).collect():
            x = r.asDict()
            columns = {}
            for i, kind in kinds.items():
                c = {"nulls": x[f"nulls_{i}"]}
                for k in ("nans", "lower", "upper"):
                    if f"{k}_{i}" in x:
                        c[k] = x[f"{k}_{i}"]
                if kind not in ("float", "double"):
                    c["nans"] = 0
                if kind == "string":
                    c["upper"] = _above(x[f"upper_{i}"])
                if kind == "timestamptz":  # as instants the session's zone would shift them
                    c.pop("lower", None), c.pop("upper", None)
                columns[i] = c
            out.append(DataFile(x["__path"], DATA, x["rows"], self.io.size(x["__path"]), spec.spec_id, {i: x[f"part_{i}"] for i in parts}, columns, schema_id=schema.schema_id))
        return out

    # -- committing

    def _writable(self) -> None:
        # the pointer to {n}-{uuid} files is kept elsewhere, and commits have to go there; a packed version would not collide with a plain one
        if self.static or not re.fullmatch(r"v\d+\.metadata\.json", self.refresh().metadata_path.rpartition("/")[2]):
            raise TableError(f"table {self.name} is read-only")

    def _commit_files(self, files: list[DataFile], operation: str) -> None:
        snapshot_id = self.metadata.new_snapshot_id()
        stamp = uuid.uuid4().hex
        base = self.metadata.location
        # files of earlier commits lie in other folders; only an attempt of this very commit may have added these
        began = self.metadata.raw.get("last-sequence-number", 0)

        def change(meta: TableMetadata, raw: dict) -> None:
            parent = meta.current_snapshot
            known = self.listed(parent)
            if operation == "append" and raw["properties"].get("commit.check-duplicates", "true") == "true":
                taken = {f.path for m in known if m.sequence > began for f in _files(self.io, m, meta)}
                if both := taken & {f.path for f in files}:
                    raise TableError(f"files are in the table already: {sorted(both)[:3]}")
            if raw["format-version"] < 2:
                raise TableError(f"table {self.name} is of format version 1; upgrade_format(2) makes it writable")
            specs = dict(meta.specs)
            if any(f.spec_id == EVERYWHERE for f in files):
                plain = next((s for s in specs.values() if not s.fields), None)
                if plain is None:
                    plain = specs[max(specs) + 1] = PartitionSpec(max(specs) + 1)
                    raw["partition-specs"].append(plain.to_json())
            if any(f.spec_id not in specs for f in files if f.spec_id != EVERYWHERE):
                raise TableError("files of an unknown partition spec")
            grown = TableMetadata(raw)
            sequence = raw.get("last-sequence-number", 0) + 1
            placed = [replace(f, sequence=sequence, spec_id=plain.spec_id if f.spec_id == EVERYWHERE else f.spec_id) for f in files]
            entries = []
            attempt = uuid.uuid4().hex[:8]
            for spec_id in sorted({f.spec_id for f in placed}):
                own = [f for f in placed if f.spec_id == spec_id]
                content = manifests.dump_entries(own, specs[spec_id], grown, snapshot_id)
                path = f"{base}/metadata/{stamp}-{attempt}-m{spec_id}.avro"
                self.io.create(path, content)
                kind = DATA if own[0].content == DATA else 1
                entries.append(Manifest(path, len(content), spec_id, kind, snapshot_id, sequence, len(own), summarise(own), added_rows=sum(f.rows for f in own)))
            listing = f"{base}/metadata/snap-{snapshot_id}-{attempt}.avro"
            about = {"snapshot-id": str(snapshot_id), "parent-snapshot-id": str(parent["snapshot-id"]) if parent else "null", "sequence-number": str(sequence), "format-version": "2"}
            self.io.create(listing, manifests.dump_list([*entries, *known], grown, about))
            before = (parent or {}).get("summary", {})
            rows, size = sum(f.rows for f in files), sum(f.size for f in files)
            add = {"added-data-files": len(files), "added-records": rows, "added-files-size": size} if operation == "append" else {"added-delete-files": len(files), "added-deletes": rows}
            data = operation == "append"
            summary = {"operation": operation} | {k: str(v) for k, v in add.items()} | {
                "total-records": str(int(before.get("total-records", 0)) + rows * data), "total-files-size": str(int(before.get("total-files-size", 0)) + size * data),
                "total-data-files": str(int(before.get("total-data-files", 0)) + len(files) * data), "total-delete-files": str(int(before.get("total-delete-files", 0)) + len(files) * (not data)),
            }
            stamp_ms = now_ms()
            raw["snapshots"].append(
                {"snapshot-id": snapshot_id, "parent-snapshot-id": parent["snapshot-id"] if parent else None, "sequence-number": sequence, "timestamp-ms": stamp_ms, "manifest-list": listing, "summary": summary, "schema-id": meta.schema.schema_id}
            )
            raw["last-sequence-number"], raw["current-snapshot-id"] = sequence, snapshot_id
            raw.setdefault("snapshot-log", []).append({"timestamp-ms": stamp_ms, "snapshot-id": snapshot_id})
            raw.setdefault("refs", {})["main"] = {"snapshot-id": snapshot_id, "type": "branch"}

        self.commit(change)

    def commit(self, change: Callable[[TableMetadata, dict], None], requires: Callable[[TableMetadata], None] | None = None) -> None:
        """Apply a change to the newest metadata; whoever creates the next version first wins, others reload and retry."""
        self._writable()
        p = self.metadata.properties
        retries, least, most = (int(p.get(f"commit.retry.{k}", d)) for k, d in (("num-retries", 4), ("min-wait-ms", 100), ("max-wait-ms", 60_000)))
        total = int(p.get("commit.retry.total-timeout-ms", 1_800_000))
        began = time.monotonic()
        for attempt in range(retries + 1):
            self.refresh()
            if requires:
                requires(self.metadata)
            raw = self.metadata.evolved()
            change(self.metadata, raw)
            raw.setdefault("metadata-log", []).append({"metadata-file": self.metadata_path, "timestamp-ms": self.metadata.raw.get("last-updated-ms")})
            version = version_of(self.metadata_path) + 1
            path = f"{self.metadata.location}/metadata/v{version}.metadata.json"
            fresh = TableMetadata(raw)
            try:
                self.io.create(path, fresh.text())
            except AlreadyExists:
                wait = min(most, least * 2**attempt) / 1000 * (0.5 + random.random())
                if attempt == retries or time.monotonic() - began + wait > total / 1000:
                    break
                time.sleep(wait)
                continue
            self._metadata, self.metadata_path = fresh, path
            self._hint(version)
            return
        raise CommitFailed(f"table {self.name} kept changing; gave up after {retries} retries")

    def _hint(self, version: int) -> None:
        self.io.replace(f"{self.metadata.location}/metadata/version-hint.text", str(version))

    # -- evolution and other metadata changes

    def _evolve(self, change: Callable[[Schema, int], Schema]) -> None:
        def apply(meta: TableMetadata, raw: dict) -> None:
            new = replace(change(meta.schema, raw["last-column-id"]), schema_id=max(meta.schemas) + 1)
            raw["schemas"].append(new.to_json())
            raw["current-schema-id"], raw["last-column-id"] = new.schema_id, max(raw["last-column-id"], new.last_id())

        self.commit(apply)

    def add_column(self, name: str, kind: T.DataType | str, doc: str | None = None) -> None:
        self._evolve(lambda s, last: s.add(name, kind, last, doc))

    def rename_column(self, name: str, to: str) -> None:
        self._evolve(lambda s, _: s.rename(name, to))

    def drop_column(self, name: str) -> None:
        def change(s: Schema, _: int) -> Schema:
            if any(f.source_id == s.find(name).id for f in self.metadata.spec.fields):
                raise TableError(f"{name} is a partition column")
            return s.drop(name)

        self._evolve(change)

    def promote_column(self, name: str, to: str) -> None:
        self._evolve(lambda s, _: s.promote(name, to))

    def set_partitioning(self, parts: list[tuple[str, str] | str]) -> None:
        """A new default spec for later writes; files keep the spec they were written with."""

        def apply(meta: TableMetadata, raw: dict) -> None:
            spec = PartitionSpec.build(meta.schema, parts, max(meta.specs) + 1, raw.get("last-partition-id", 999) + 1)
            raw["partition-specs"].append(spec.to_json())
            raw["default-spec-id"] = spec.spec_id
            raw["last-partition-id"] = max([raw.get("last-partition-id", 999), *(f.field_id for f in spec.fields)])

        self.commit(apply)

    def set_properties(self, values: dict[str, str]) -> None:
        self.commit(lambda _, raw: raw["properties"].update(values))

    def remove_properties(self, *names: str) -> None:
        self.commit(lambda _, raw: [raw["properties"].pop(n, None) for n in names])

    def set_sort_order(self, columns: list[str | tuple[str, ...]]) -> None:
        """Columns, or (column, "asc" or "desc"[, "nulls-first" or "nulls-last"]); nulls come first going up, last going down."""
        self.commit(lambda meta, raw: raw.update(sort_orders(_sort_fields(meta.schema, columns))))

    def set_ref(self, name: str, snapshot_id: int, kind: str = "tag") -> None:
        def apply(meta: TableMetadata, raw: dict) -> None:
            if meta.snapshot(snapshot_id) is None:
                raise TableError(f"snapshot id {snapshot_id} not found in table {self.name}")
            raw.setdefault("refs", {})[name] = {"snapshot-id": snapshot_id, "type": kind}

        self.commit(apply)

    def upgrade_format(self, version: int) -> None:
        def apply(meta: TableMetadata, raw: dict) -> None:
            if version < meta.raw["format-version"]:
                raise MetadataError("format versions do not go down")
            raw["format-version"] = version

        self.commit(apply)


_FILE_IOS: dict[int, FileIO] = {}


def _io(spark: SparkSession) -> FileIO:
    return _FILE_IOS.setdefault(id(spark), FileIO(spark))


def _utc(ms: int):  # noqa: ANN202
    import datetime as dt

    return dt.datetime.fromtimestamp(math.floor(ms / 1000), dt.UTC).replace(microsecond=ms % 1000 * 1000)


def version_of(path: str) -> int:
    """Of v{n}.metadata.json or {n}-{uuid}.metadata.json."""
    found = re.match(r"v?(\d+)", path.rpartition("/")[2])
    return int(found[1]) if found else 0


def _version_file(io: FileIO, folder: str, n: int | str) -> str | None:
    return next((path for path in (f"{folder}/v{n}.metadata.json", f"{folder}/v{n}.gz.metadata.json") if io.exists(path)), None)


def latest_metadata(io: FileIO, location: str) -> str | None:
    """The metadata file that version-hint.text names or a later one, else the highest v{n} or {n}-{uuid}; None if there is none. All may be packed (.gz)."""
    folder = f"{location.rstrip('/')}/metadata"
    hint = f"{folder}/version-hint.text"
    n = None
    if io.exists(hint):
        text = io.read(hint).strip()
        n = int(text) if text.isdigit() and _version_file(io, folder, text) else None
    if n is None:
        names = io.files(folder)
        n = max((int(m[1]) for x in names if (m := re.fullmatch(r"v(\d+)(?:\.gz)?\.metadata\.json", x))), default=None)
        if n is None:  # as catalogs that keep the pointer themselves name them; the newest here is the best guess
            last = max(((int(m[1]), x) for x in names if (m := re.fullmatch(r"(\d+)-.*\.metadata\.json", x))), default=None)
            return f"{folder}/{last[1]}" if last else None
    while _version_file(io, folder, n + 1):  # a commit whose hint is still to come, or was lost
        n += 1
    return _version_file(io, folder, n)



__all__ = ["Any", "CommitFailed", "ScanTask", "SnapshotTable", "TableError", "TableScan", "latest_metadata"]
