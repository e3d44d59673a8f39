"""Catalogs: namespaces and tables, in process or as a warehouse folder; names fall back to a match without case."""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from sparrowlake.sources.fileio import FileIO, resolve
from sparrowlake.sources.table import SnapshotTable, TableError, latest_metadata


class CatalogError(ValueError):
    pass


def match_name(name: str, names: list[str]) -> str | None:
    """Exact match, else the only one without case."""
    if name in names:
        return name
    found = [n for n in names if n.lower() == name.lower()]
    if len(found) > 1:
        raise CatalogError(f"{name} is ambiguous: {found}")
    return found[0] if found else None


class Catalog(ABC):
    """What every catalog can do. Listings are live."""

    spark: SparkSession

    @abstractmethod
    def list_namespaces(self) -> list[str]: ...
    @abstractmethod
    def create_namespace(self, name: str, properties: dict[str, str] | None = None) -> None: ...
    @abstractmethod
    def namespace_properties(self, name: str) -> dict[str, str]: ...
    @abstractmethod
    def update_namespace(self, name: str, properties: dict[str, str]) -> None: ...
    @abstractmethod
    def drop_namespace(self, name: str) -> None: ...
    @abstractmethod
    def list_tables(self, namespace: str) -> list[str]: ...
    @abstractmethod
    def location(self, namespace: str, table: str) -> str | None: ...
    @abstractmethod
    def register(self, namespace: str, table: str, location: str) -> None: ...
    @abstractmethod
    def forget(self, namespace: str, table: str) -> None: ...
    @abstractmethod
    def default_location(self, namespace: str, table: str) -> str: ...

    def namespace_exists(self, name: str) -> bool:
        return match_name(name, self.list_namespaces()) is not None

    def table_exists(self, namespace: str, table: str) -> bool:
        own = match_name(namespace, self.list_namespaces())
        return own is not None and match_name(table, self.list_tables(own)) is not None

    def resolved(self, namespace: str, table: str) -> tuple[str, str]:
        own = match_name(namespace, self.list_namespaces())
        if own is None:
            raise CatalogError(f"namespace {namespace} not found")
        name = match_name(table, self.list_tables(own))
        if name is None:
            raise CatalogError(f"table {namespace}.{table} not found")
        return own, name

    def load_table(self, namespace: str, table: str) -> SnapshotTable:
        own, name = self.resolved(namespace, table)
        return SnapshotTable.open(self.spark, f"{own}.{name}", self.location(own, name))

    def create_table(self, namespace: str, table: str, schema: T.StructType, **options) -> SnapshotTable:  # noqa: ANN003
        own = match_name(namespace, self.list_namespaces())
        if own is None:
            raise CatalogError(f"namespace {namespace} not found")
        if match_name(table, self.list_tables(own)):
            raise TableError(f"Table {table} already exists")
        location = self.default_location(own, table)
        made = SnapshotTable.create(self.spark, f"{own}.{table}", location, schema, **options)
        self.register(own, table, location)
        return made

    def drop_table(self, namespace: str, table: str, purge: bool = False) -> bool:
        """Whether there was one."""
        if not self.table_exists(namespace, table):
            return False
        own, name = self.resolved(namespace, table)
        location = self.location(own, name)
        self.forget(own, name)
        if purge:
            FileIO(self.spark).delete(location)
        return True

    def rename_table(self, namespace: str, table: str, to: str) -> None:
        own, name = self.resolved(namespace, table)
        if match_name(to, self.list_tables(own)):
            raise TableError(f"Table {to} already exists")
        location = self.location(own, name)
        self.forget(own, name)
        self.register(own, to, location)


class MemoryCatalog(Catalog):
    """Names in process; tables under a folder."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse = spark, resolve(warehouse).rstrip("/")
        self._names: dict[str, tuple[dict[str, str], dict[str, str]]] = {}

    def list_namespaces(self) -> list[str]:
        return sorted(self._names)

    def create_namespace(self, name: str, properties: dict[str, str] | None = None) -> None:
        if self.namespace_exists(name):
            raise CatalogError(f"namespace {name} already exists")
        self._names[name] = (dict(properties or {}), {})

    def namespace_properties(self, name: str) -> dict[str, str]:
        return dict(self._names[name][0])

    def update_namespace(self, name: str, properties: dict[str, str]) -> None:
        self._names[name][0].update(properties)

    def drop_namespace(self, name: str) -> None:
        if self._names[name][1]:
            raise CatalogError(f"namespace {name} is not empty")
        del self._names[name]

    def list_tables(self, namespace: str) -> list[str]:
        return sorted(self._names[namespace][1])

    def location(self, namespace: str, table: str) -> str | None:
        return self._names[namespace][1].get(table)

    def register(self, namespace: str, table: str, location: str) -> None:
        self._names[namespace][1][table] = location

    def forget(self, namespace: str, table: str) -> None:
        del self._names[namespace][1][table]

    def default_location(self, namespace: str, table: str) -> str:
        return f"{self.warehouse}/{namespace}/{table}-{uuid.uuid4().hex[:8]}"


class WarehouseCatalog(Catalog):
    """A folder {warehouse}/{namespace}/{table}; what has metadata is a table. Folders whose names begin with a dot are not looked into."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse, self.io = spark, resolve(warehouse).rstrip("/"), FileIO(spark)
        if not self.warehouse.startswith("/") and "://" not in self.warehouse:
            raise CatalogError(f"warehouse must be an absolute path: {warehouse}")

    def _folders(self, path: str) -> list[str]:
        return [n for n in self.io.folders(path) if not n.startswith(".")]

    def list_namespaces(self) -> list[str]:
        return self._folders(self.warehouse)

    def create_namespace(self, name: str, properties: dict[str, str] | None = None) -> None:
        if self.namespace_exists(name):
            raise CatalogError(f"namespace {name} already exists")
        import json

        self.io.create(f"{self.warehouse}/{name}/.namespace.json", json.dumps(properties or {}))

    def namespace_properties(self, name: str) -> dict[str, str]:
        import json

        path = f"{self.warehouse}/{name}/.namespace.json"
        return json.loads(self.io.read(path)) if self.io.exists(path) else {}

    def update_namespace(self, name: str, properties: dict[str, str]) -> None:
        import json

        self.io.replace(f"{self.warehouse}/{name}/.namespace.json", json.dumps(self.namespace_properties(name) | properties))

    def drop_namespace(self, name: str) -> None:
        if self.list_tables(name):
            raise CatalogError(f"namespace {name} is not empty")
        self.io.delete(f"{self.warehouse}/{name}")

    def list_tables(self, namespace: str) -> list[str]:
        return [n for n in self._folders(f"{self.warehouse}/{namespace}") if latest_metadata(self.io, f"{self.warehouse}/{namespace}/{n}")]

    def location(self, namespace: str, table: str) -> str | None:
        return f"{self.warehouse}/{namespace}/{table}"

    def register(self, namespace: str, table: str, location: str) -> None:
        if resolve(location) != self.default_location(namespace, table):
            raise CatalogError("a warehouse catalog holds tables at their own place only")

    def forget(self, namespace: str, table: str) -> None:
        self.io.delete(f"{self.warehouse}/{namespace}/{table}")

    def rename_table(self, namespace: str, table: str, to: str) -> None:
        raise CatalogError("tables of a warehouse catalog are named by their folder")

    def default_location(self, namespace: str, table: str) -> str:
        return f"{self.warehouse}/{namespace}/{table}"


class RestCatalog(Catalog):
    """Needs a network and a connector on the class path; named so that configurations can say so."""

    def __init__(self, spark: SparkSession, uri: str, **_):  # noqa: ANN003
        raise CatalogError(f"REST catalogs need a connector that is not here: {uri}")

    list_namespaces = create_namespace = namespace_properties = update_namespace = drop_namespace = None  # type: ignore[assignment]
    list_tables = location = register = forget = default_location = None  # type: ignore[assignment]
