"""Pure functions: transforms, schemas, predicates, configuration, statement preparation, paths, metadata."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from sparrowlake import sqlprep
from sparrowlake.config import ConfigError, expand, parse
from sparrowlake.operators.predicate import Always, Stats, bind, col, may_match, negate, project, without_not
from sparrowlake.operators.transforms import Transform, bucket_bytes, murmur3
from sparrowlake.sources.fileio import resolve
from sparrowlake.sources.metadata import MetadataError, PartitionSpec, TableMetadata, value_from_json, value_to_json
from sparrowlake.sources.schema import Schema, SchemaError, can_promote

SCHEMA = Schema.from_spark(
    T.StructType(
        [
            T.StructField("id", T.LongType(), False),
            T.StructField("name", T.StringType()),
            T.StructField("at", T.TimestampNTZType()),
            T.StructField("price", T.DecimalType(9, 2)),
            T.StructField("part", T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.ArrayType(T.StringType()))])),
            T.StructField("x", T.DoubleType()),
        ]
    )
)


# fixed values: published test vectors of the bucket hash
@pytest.mark.parametrize("value,expected", [(34, 2017239379), (Decimal("14.20"), -500754589), ("iceberg", 1210000089), (Decimal("0.01"), -463810133), (-1, None)])
def test_bucket_hash(value, expected):
    if expected is not None:
        assert murmur3(bucket_bytes(value)) == expected
    assert 0 <= Transform.parse("bucket[16]").apply(value) < 16


def test_bucket_of_dates_and_nulls():
    assert murmur3(bucket_bytes(dt.date(1970, 1, 1))) == murmur3(bucket_bytes(0))
    assert Transform.parse("bucket[4]").apply(None) is None
    with pytest.raises(TypeError):
        bucket_bytes(True)


@pytest.mark.parametrize(
    "text,value,expected",
    [
        ("truncate[10]", 17, 10), ("truncate[10]", -1, -10), ("truncate[3]", "héllo", "hél"), ("truncate[50]", Decimal("10.65"), Decimal("10.50")),
        ("year", dt.date(1969, 12, 31), -1), ("month", dt.date(1970, 3, 1), 2), ("day", dt.datetime(1969, 12, 31, 23), -1), ("hour", dt.datetime(1970, 1, 2, 1), 25), ("void", 3, None), ("identity", "a", "a"),
    ],
)
def test_transforms(text, value, expected):
    t = Transform.parse(text)
    assert t.apply(value) == expected
    assert str(t) == text


@pytest.mark.parametrize("bad", ["bucket", "bucket[0]", "truncate[-1]", "week"])
def test_bad_transforms(bad):
    with pytest.raises(ValueError):
        Transform.parse(bad)


def test_schema_ids_and_json():
    assert [f.id for f in SCHEMA.fields] == [1, 2, 3, 4, 5, 6]
    assert [f.id for f in SCHEMA.fields[4].type.fields] == [7, 8]
    assert Schema.from_json(SCHEMA.to_json()) == SCHEMA
    assert SCHEMA.find("NAME").id == 2
    assert SCHEMA.fields[0].required and not SCHEMA.fields[1].required


def test_schema_changes():
    grown = SCHEMA.add("extra", "string", SCHEMA.last_id())
    assert grown.find("extra").id == SCHEMA.last_id() + 1
    assert grown.rename("extra", "more").find("more").id == grown.find("extra").id
    assert SCHEMA.promote("price", "decimal(12,2)").find("price").type == "decimal(12,2)"
    for change in (lambda: SCHEMA.add("NAME", "string", 9), lambda: SCHEMA.promote("id", "int"), lambda: SCHEMA.rename("id", "name"), lambda: SCHEMA.drop("nope")):
        with pytest.raises(SchemaError):
            change()
    with pytest.raises(SchemaError):
        Schema.from_spark(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("A", T.IntegerType())]))


@pytest.mark.parametrize("old,new,ok", [("int", "long", True), ("long", "int", False), ("float", "double", True), ("decimal(5,2)", "decimal(9,2)", True), ("decimal(5,2)", "decimal(9,3)", False), ("fixed[16]", "uuid", True), ("string", "int", False)])
def test_promotions(old, new, ok):
    assert can_promote(old, new) is ok


def test_predicates_negate_without_not():
    p = ~((col("id", "<", 3) & col("name", "is_null")) | col("x", "in", [1.0, 2.0]))
    q = without_not(bind(p, SCHEMA))
    assert "Not" not in repr(q)
    assert negate(negate(q)) == q
    assert (col("id", "=", 1) & Always(False)) == Always(False)
    assert col("id", "in", []) == Always(False)
    assert col("id", "not_in", [4]).op == "!="


@pytest.mark.parametrize(
    "op,value,stats,expected",
    [
        ("<", 5, Stats(10, 0, 0, 5, 9), False), ("<=", 5, Stats(10, 0, 0, 5, 9), True), (">", 9, Stats(10, 0, 0, 5, 9), False), ("=", 4, Stats(10, 0, 0, 5, 9), False), ("!=", 5, Stats(10, 0, 0, 5, 5), False),
        ("!=", 5, Stats(10, 1, None, 5, 5), True), ("is_null", None, Stats(10, 0), False), ("not_null", None, Stats(10, 10), False), ("is_nan", None, Stats(10, 0, 0), False), ("in", (1, 7), Stats(10, 0, 0, 5, 9), True),
        ("in", (1, 2), Stats(10, 0, 0, 5, 9), False), ("starts_with", "ab", Stats(10, 0, 0, "b", "c"), False), ("starts_with", "ab", Stats(10, 0, 0, "a", "c"), True), ("not_starts_with", "ab", Stats(10, 0, 0, "aba", "abz"), False),
        ("=", "text", Stats(10, 0, 0, 5, 9), True), (">", 9.5, Stats(10, 0, 1, 5.0, 9.0), True), ("=", 1, Stats(0), False), ("=", 1, Stats(10, 10), False), ("=", float("nan"), Stats(10, 0, 1, 1.0, 2.0), True),
    ],
)
def test_statistics(op, value, stats, expected):
    from sparrowlake.operators.predicate import Test

    assert may_match(Test("c", op, value, 1), {1: stats}) is expected


def test_projection_is_inclusive():
    from sparrowlake.operators.predicate import Test

    p = Test("id", "<", 20, 1)
    t = Transform.parse("truncate[10]")
    assert project(p, 1, t, 1000) == Test("id", "<=", 20, 1000)
    assert project(Test("id", "!=", 20, 1), 1, t, 1000) == Always(True)
    assert project(p, 1, Transform.parse("bucket[4]"), 1000) == Always(True)
    assert project(p, 2, t, 1000) == Always(True)


@pytest.mark.parametrize(
    "path,base,expected",
    [("data/a", "/w/t", "/w/t/data/a"), ("/abs/a", "/w", "/abs/a"), ("s3://b/a", "/w", "s3://b/a"), ("file:///a/b", None, "/a/b"), ("file:/a/b", None, "/a/b"), ("a\\b", "/w", "/w/a/b"), ("", "/w/", "/w"), ("./x", "/w", "/w/x")],
)
def test_paths(path, base, expected):
    assert resolve(path, base) == expected


@pytest.mark.parametrize(
    "sql,expected",
    [
        ("SHOW TABLES", (True, None)), ("show tables;", (True, None)), ("Show Tables In s", (True, "s")), ("SHOW TABLES IN cat.s ;", (True, "s")), ('SHOW TABLES IN "My s"', (False, None)), ('SHOW TABLES IN "s"', (True, "s")),
        ("SHOW TABLES IN `s`", (True, "s")), ("SHOW TABLESS", (False, None)), ("SHOW TABLE", (False, None)), ("SHOW TABLES INFOO", (False, None)), ("SHOW TABLES IN", (False, None)), ("é SHOW TABLES", (False, None)),
    ],
)
def test_show_tables(sql, expected):
    assert sqlprep.parse_show_tables(sql) == expected


def test_statement_preparation():
    assert sqlprep.quote_metadata_tables("SELECT * FROM db.t$snapshots WHERE x = 't$manifests'") == "SELECT * FROM db.`t$snapshots` WHERE x = 't$manifests'"
    assert sqlprep.parse_insert("INSERT INTO a.b (x, `y`) SELECT 1, 2;") == ("a.b", ["x", "y"], "SELECT 1, 2")
    assert sqlprep.parse_insert("INSERT INTO t VALUES (1)") == ("t", None, "VALUES (1)")
    assert sqlprep.parse_insert("SELECT 1") is None
    assert "hint" in sqlprep.hint("[TABLE_OR_VIEW_NOT_FOUND] x") and "hint" not in sqlprep.hint("syntax")


def test_configuration():
    text = "\ufeffDefault-Catalog: b\ncatalogs:\n  a:\n    type: hadoop\n    warehouse: ${ROOT}/w${NONE}\n  b:\n    account: me.example.com\n    token: t\n    default-schema: s\n"
    got = parse(text, {"ROOT": "/r"})
    assert got.default_catalog == "b" and got.default_schema == "s"
    assert got.catalogs["a"].properties["warehouse"] == "/r/w"
    assert got.catalogs["b"].properties["uri"] == "https://me.example.com" and got.catalogs["b"].properties["credential"] == "t"
    assert parse("catalogs: {z: {type: memory}, y: {type: memory}}").default_catalog == "y"
    assert expand("a${b", {}) == "a${b"
    for bad in ('{"catalogs": {}}', "catalogs:", "default-catalog: q\ncatalogs: {a: {type: memory}}", "catalogs: {a: {uri: <uri>}}", "- a"):
        with pytest.raises(ConfigError):
            parse(bad)


def test_metadata_parser():
    spec = PartitionSpec.build(SCHEMA, ["name", ("id", "bucket[4]"), ("at", "day")])
    assert [f.name for f in spec.fields] == ["name", "id_bucket", "at_day"]
    meta = TableMetadata.new("/w/t", SCHEMA, spec, {"a": "b"})
    again = TableMetadata.parse(meta.text())
    assert again.schema == SCHEMA and again.spec == spec and again.properties == {"a": "b"}
    for key in ("location", "schemas", "partition-specs", "default-spec-id", "last-column-id"):
        raw = dict(meta.raw)
        del raw[key]
        with pytest.raises(MetadataError):
            TableMetadata(raw)
    for change in ({"format-version": 9}, {"current-schema-id": 7}, {"default-spec-id": 7}, {"current-snapshot-id": 7}, {"default-sort-order-id": 7}):
        with pytest.raises(MetadataError):
            TableMetadata(dict(meta.raw) | change)
    old = TableMetadata({"format-version": 1, "location": "/w", "last-column-id": 1, "schema": {"type": "struct", "fields": [{"id": 1, "name": "a", "type": "int", "required": False}]}, "partition-spec": [{"source-id": 1, "name": "a", "transform": "identity"}]})
    assert old.schema.fields[0].name == "a" and old.spec.fields[0].field_id == 1000
    with pytest.raises(MetadataError):
        TableMetadata.parse("not json")


def test_values_round_trip():
    for v in (1, "a", None, True, 1.5, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 6), Decimal("1.20"), b"\x00\xff"):
        assert value_from_json(value_to_json(v)) == v


@pytest.mark.parametrize(
    "sql,expected",
    [
        ("SELECT strpos(a, 'strpos(') FROM t", "SELECT instr(a, 'strpos(') FROM t"), ("SELECT array_length(make_array(1, 2))", "SELECT size(array(1, 2))"), ("SELECT sha256(concat(a, ',(')) x", "SELECT sha2(concat(a, ',('), 256) x"),
        ("SELECT array_slice(f(a, b), 2, g(3))", "SELECT slice(f(a, b), 2, g(3) - 2 + 1)"), ("SELECT my_strpos(a), t.unnest FROM t", "SELECT my_strpos(a), t.unnest FROM t"), ("SELECT sha256(a", "SELECT sha256(a"), ("-- unnest(\nSELECT 1", "-- unnest(\nSELECT 1"),
    ],
)
def test_dialect(sql, expected):
    from sparrowlake.functions.dialect import translate

    assert translate(sql) == expected
