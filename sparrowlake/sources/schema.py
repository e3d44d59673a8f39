"""Table types and schemas with field ids, and their Spark counterparts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from itertools import count
from typing import Any

from pyspark.sql import types as T

#: Table type names and the Spark types that hold them.
PRIMITIVES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "time": T.LongType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
    "timestamp_ns": T.LongType(),
    "timestamptz_ns": T.LongType(),
    "string": T.StringType(),
    "uuid": T.StringType(),
    "binary": T.BinaryType(),
}


class SchemaError(ValueError):
    """A type or schema change that tables do not allow."""


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: Any  # a primitive's name, or Struct, List or Map
    required: bool = False
    doc: str | None = None


@dataclass(frozen=True)
class Struct:
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class List:
    element_id: int
    element: Any
    element_required: bool = False


@dataclass(frozen=True)
class Map:
    key_id: int
    key: Any
    value_id: int
    value: Any
    value_required: bool = False


def type_to_json(t: Any) -> Any:
    if isinstance(t, Struct):
        return {"type": "struct", "fields": [field_to_json(f) for f in t.fields]}
    if isinstance(t, List):
        return {"type": "list", "element-id": t.element_id, "element": type_to_json(t.element), "element-required": t.element_required}
    if isinstance(t, Map):
        return {"type": "map", "key-id": t.key_id, "key": type_to_json(t.key), "value-id": t.value_id, "value": type_to_json(t.value), "value-required": t.value_required}
    return t


def field_to_json(f: Field) -> dict:
    out = {"id": f.id, "name": f.name, "required": f.required, "type": type_to_json(f.type)}
    return out | ({"doc": f.doc} if f.doc else {})


def type_from_json(x: Any) -> Any:
    if isinstance(x, str):
        to_spark(x)
        return x
    kind = x.get("type")
    if kind == "struct":
        return Struct(tuple(field_from_json(f) for f in x["fields"]))
    if kind == "list":
        return List(x["element-id"], type_from_json(x["element"]), x.get("element-required", False))
    if kind == "map":
        return Map(x["key-id"], type_from_json(x["key"]), x["value-id"], type_from_json(x["value"]), x.get("value-required", False))
    raise SchemaError(f"unknown type: {x}")


def field_from_json(x: dict) -> Field:
    return Field(x["id"], x["name"], type_from_json(x["type"]), x.get("required", False), x.get("doc"))


def to_spark(t: Any) -> T.DataType:
    """Nested fields carry no ids: they go by name, as Spark's pruning of nested columns loses their metadata."""
    if isinstance(t, Struct):
        return T.StructType([T.StructField(f.name, to_spark(f.type), not f.required, {"doc": f.doc} if f.doc else {}) for f in t.fields])
    if isinstance(t, List):
        return T.ArrayType(to_spark(t.element), not t.element_required)
    if isinstance(t, Map):
        return T.MapType(to_spark(t.key), to_spark(t.value), not t.value_required)
    if t in PRIMITIVES:
        return PRIMITIVES[t]
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", t):
        return T.DecimalType(int(m[1]), int(m[2]))
    if re.fullmatch(r"fixed\[\d+\]", t):
        return T.BinaryType()
    raise SchemaError(f"unknown type: {t}")


def field_to_spark(f: Field) -> T.StructField:
    return T.StructField(f.name, to_spark(f.type), not f.required, {"parquet.field.id": f.id} | ({"doc": f.doc} if f.doc else {}))


def _number(t: T.DataType, ids) -> Any:  # noqa: ANN001
    """The table type of a Spark type; nested fields take their ids after all fields of their level."""
    if isinstance(t, T.StructType):
        own = [next(ids) for _ in t.fields]
        return Struct(tuple(Field(i, f.name, _number(f.dataType, ids), not f.nullable, f.metadata.get("doc") or f.metadata.get("comment")) for i, f in zip(own, t.fields, strict=True)))
    if isinstance(t, T.ArrayType):
        own_id = next(ids)
        return List(own_id, _number(t.elementType, ids), not t.containsNull)
    if isinstance(t, T.MapType):
        key, value = next(ids), next(ids)
        return Map(key, _number(t.keyType, ids), value, _number(t.valueType, ids), not t.valueContainsNull)
    if isinstance(t, T.DecimalType):
        return f"decimal({t.precision},{t.scale})"
    if isinstance(t, (T.ByteType, T.ShortType)):
        return "int"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    for name, spark in PRIMITIVES.items():
        if name not in ("time", "timestamp_ns", "timestamptz_ns", "uuid") and spark == t:
            return name
    raise SchemaError(f"no table type for {t.simpleString()}")


#: Legal promotions besides wider decimals of the same scale.
PROMOTIONS = {("int", "long"), ("float", "double"), ("fixed[16]", "uuid")}


def can_promote(old: Any, new: Any) -> bool:
    if old == new or (old, new) in PROMOTIONS:
        return True
    a, b = (re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", str(x)) for x in (old, new))
    return bool(a and b and a[2] == b[2] and int(b[1]) >= int(a[1]))


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    schema_id: int = 0
    identifier_ids: tuple[int, ...] = field(default=())

    @classmethod
    def from_spark(cls, t: T.StructType, schema_id: int = 0, lower: bool = False) -> Schema:
        """Ids from 1. Names may be lower-cased, as output columns of the engine are."""
        out = _number(t, count(1)).fields
        names = [f.name.lower() for f in out]
        if len(set(names)) < len(names):
            raise SchemaError(f"columns whose names differ in case only: {sorted(names)}")
        return cls(tuple(replace(f, name=f.name.lower()) for f in out) if lower else out, schema_id)

    def spark(self) -> T.StructType:
        return T.StructType([field_to_spark(f) for f in self.fields])

    def to_json(self) -> dict:
        return {"type": "struct", "schema-id": self.schema_id, "fields": [field_to_json(f) for f in self.fields]} | ({"identifier-field-ids": list(self.identifier_ids)} if self.identifier_ids else {})

    @classmethod
    def from_json(cls, x: dict) -> Schema:
        return cls(type_from_json({"type": "struct", "fields": x["fields"]}).fields, x.get("schema-id", 0), tuple(x.get("identifier-field-ids", ())))

    def find(self, name: str) -> Field:
        """By exact name, else by name without case."""
        for f in self.fields:
            if f.name == name:
                return f
        found = [f for f in self.fields if f.name.lower() == name.lower()]
        if not found:
            raise SchemaError(f"no column {name} among {[f.name for f in self.fields]}")
        return found[0]

    def by_id(self, field_id: int) -> Field | None:
        return next((f for f in self.fields if f.id == field_id), None)

    def last_id(self) -> int:
        def most(t: Any) -> int:
            if isinstance(t, Struct):
                return max([0, *(max(f.id, most(f.type)) for f in t.fields)])
            if isinstance(t, List):
                return max(t.element_id, most(t.element))
            if isinstance(t, Map):
                return max(t.key_id, t.value_id, most(t.key), most(t.value))
            return 0

        return most(Struct(self.fields))

    # evolution: each gives a new schema without an id of its own

    def add(self, name: str, t: T.DataType | str, last_column_id: int, doc: str | None = None) -> Schema:
        if any(f.name.lower() == name.lower() for f in self.fields):
            raise SchemaError(f"column {name} already exists")
        kind = type_from_json(t) if isinstance(t, str) else _number(t, count(last_column_id + 2))
        return replace(self, fields=(*self.fields, Field(last_column_id + 1, name, kind, False, doc)))

    def rename(self, name: str, to: str) -> Schema:
        old = self.find(name)
        if any(f.name.lower() == to.lower() and f.id != old.id for f in self.fields):
            raise SchemaError(f"column {to} already exists")
        return replace(self, fields=tuple(replace(f, name=to) if f.id == old.id else f for f in self.fields))

    def drop(self, name: str) -> Schema:
        old = self.find(name)
        return replace(self, fields=tuple(f for f in self.fields if f.id != old.id))

    def promote(self, name: str, to: str) -> Schema:
        old = self.find(name)
        if not can_promote(old.type, to):
            raise SchemaError(f"cannot promote {old.type} to {to}")
        return replace(self, fields=tuple(replace(f, type=to) if f.id == old.id else f for f in self.fields))
