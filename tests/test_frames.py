"""Documents as tables, Spark schemas, sources, sinks, validation, timelines."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_codec import BRANCH, SNAPSHOT, TABLE

from tablelens import model as M
from tablelens.codec import CodecError, loads, parse_table_metadata
from tablelens.operators import drift, frames, timeline
from tablelens.plans import reference_queries
from tablelens.sources.datasource import register
from tablelens.sources.files import check_metadata, read_metadata, write_documents, write_metadata
from tablelens.shared import with_position, with_previous
from tablelens.types import Primitive, UnsupportedTypeError
from tablelens.validate import validate

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

NESTED = {"type": "map", "key-id": 10, "key": "string", "value-id": 11, "value-required": True, "value": {"type": "list", "element-id": 12, "element-required": False, "element": {"type": "struct", "fields": [{"id": 13, "name": "x", "required": True, "field_type": "decimal(9,2)"}]}}}
FULL = TABLE | {
    "current-schema-id": 1, "default-spec-id": 1,
    "schemas": [{"schema-id": 1, "type": "struct", "identifier-field-ids": [1], "fields": [{"id": 1, "name": "a", "required": True, "field_type": "long", "doc": "key"}, {"id": 2, "name": "m", "required": False, "field_type": NESTED}, {"id": 3, "name": "f", "required": False, "field_type": "fixed[4]"}],
                 "name-mapping": {"default": [{"field-id": 1, "names": ["A", "a"]}, {"field-id": 2, "names": [], "fields": [{"field-id": 10, "names": ["k"]}]}]}}],
    "last-column-id": 13, "last-partition-id": 1000, "current-snapshot-id": SNAPSHOT["snapshot-id"], "snapshots": [SNAPSHOT | {"schema-id": 1}],
    "partition-specs": [{"spec-id": 1, "fields": [{"source-id": 1, "field-id": 1000, "name": "b", "transform": "bucket[4]"}]}],
    "snapshot-log": [{"snapshot-id": SNAPSHOT["snapshot-id"], "timestamp-ms": 7}], "refs": {"main": BRANCH},
    "sort-orders": [{"order-id": 2, "fields": [{"transform": "identity", "source-id": 1, "direction": "asc", "null-order": "nulls-first"}]}], "default-sort-order-id": 2,
}


@pytest.fixture(scope="module")
def md():
    return parse_table_metadata(json.dumps(FULL))


def test_tables_of_a_document(spark, md):
    counts = {t: frames.frame(spark, md, t).count() for t in frames.TABLES}
    assert counts == {"tables": 1, "fields": 7, "identifiers": 1, "name_mappings": 3, "partitions": 1, "sort_fields": 1, "snapshots": 1, "refs": 1, "properties": 2, "metadata_log": 1, "snapshot_log": 1}
    assert [r["path"] for r in frames.frame(spark, md, "fields").collect()] == ["a", "m", "f", "m.key", "m.value", "m.value.element", "m.value.element.x"]
    with pytest.raises(ValueError):
        frames.frame(spark, md, "manifests")


def test_main_is_implied():
    md = parse_table_metadata(json.dumps(TABLE | {"current-snapshot-id": 5}))
    assert frames.resolved_refs(md)["main"].snapshot_id == 5
    assert frames.resolved_refs(parse_table_metadata(json.dumps(TABLE))) == {}


def test_bulk_reader_sink_and_source(spark, md, tmp_path):
    other = parse_table_metadata(json.dumps(TABLE | {"table-uuid": "00000000-0000-0000-0000-000000000001"}))
    for dialect in ("reference", "spec"):
        path = str(tmp_path / dialect)
        write_metadata(spark, [md, other], path, dialect)
        for t in frames.TABLES:
            want = sorted(map(str, [*frames.frame(spark, md, t).collect(), *frames.frame(spark, other, t).collect()]))
            assert sorted(map(str, read_metadata(spark, path, t, dialect).collect())) == want
            register(spark)
            source = spark.read.format("tablemeta").option("table", t).option("dialect", dialect).load(path)
            assert sorted(map(str, source.collect())) == want
            assert source.filter(F.col("table_uuid") == other.table_uuid).count() == frames.frame(spark, other, t).count()
    bad = spark.createDataFrame([("{",), (json.dumps(TABLE),), (None,)], "value string").repartition(3)
    write_documents(bad, "value", str(tmp_path / "bad"))
    assert sorted(r["error"] is None for r in check_metadata(spark, str(tmp_path / "bad")).collect() if r["error"] is None or "JSON" in r["error"]).count(True) == 1


def test_source_packs_files_and_tells_bad_ones(spark, tmp_path):
    for i in range(5):
        (tmp_path / "a").mkdir(exist_ok=True)
        (tmp_path / "a" / f"{i}.json").write_text("\ufeff" + json.dumps(TABLE) if i else "{")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "x.json").write_text("{")
    register(spark)
    for path in (str(tmp_path), tmp_path.as_uri()):
        source = spark.read.format("tablemeta")
        assert source.option("badfiles", "skip").load(path).count() == 4
        assert source.option("badfiles", "skip").load(path).rdd.getNumPartitions() == 1
        assert [r["file"].endswith("a/0.json") for r in spark.read.format("tablemeta").option("table", "errors").load(path).collect()] == [True]
        with pytest.raises(Exception, match="0.json"):
            spark.read.format("tablemeta").load(path).collect()


def test_checks_by_schema(spark):
    text = Primitive("string")
    inner = M.Struct((M.StructField(4, "a", True, text), M.StructField(5, "b", False, M.ListType(6, True, text))))
    schema = M.Schema(0, (M.StructField(1, "k", True, text), M.StructField(2, "s", False, inner), M.StructField(3, "m", False, M.MapType(7, text, 8, True, inner))), (1,))
    df = spark.createDataFrame([("x", ("1", ["p", None]), {"q": (None, [None])}), ("x", None, None), (None, (None, None), {"q": None, "r": ("1", ["2"])})], "k string, s struct<a:string,b:array<string>>, m map<string,struct<a:string,b:array<string>>>")
    assert {r["path"]: r["nulls"] for r in frames.required_violations(df, schema).collect()} == {"k": 1, "s.a": 1, "s.b.element": 1, "m.value": 1, "m.value.a": 1, "m.value.b.element": 1}
    assert [tuple(r) for r in frames.schema_duplicates(df, schema).collect()] == [("x", 2)]
    assert frames.required_violations(df, M.Schema(0, ())).count() == 0
    with pytest.raises(ValueError):
        frames.schema_duplicates(df, M.Schema(0, schema.fields))


def test_positions_and_neighbours(spark):
    rows = [(t, n, i) for t in ("a", "b", None) for n in (None, 1, 1, 2) for i in range(3)]
    df = spark.createDataFrame([(t, n, 100 * k + i) for k, (t, n, i) in enumerate(rows)], "t string, n int, i int").repartition(7)
    got = {r["i"]: r["p"] for r in with_previous(df, "t", ["n", "i"], "i", "p").collect()}
    order = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])
    ranked = sorted(((t, n, 100 * k + i) for k, (t, n, i) in enumerate(rows)), key=order)
    assert got == {r[2]: (ranked[j - 1][2] if j and ranked[j - 1][0] == r[0] else None) for j, r in enumerate(ranked)}
    numbered = with_position(df, [F.col("t").asc_nulls_first(), F.col("n").asc_nulls_first(), F.col("i")])
    assert {r["i"]: r["position"] for r in numbered.collect()} == {r[2]: j + 1 for j, r in enumerate(ranked)}
    assert with_previous(df.limit(0), "t", ["n"], "i", "p").count() == 0 == with_position(df.limit(0), [F.col("i")]).count()


def test_sequence_without_numbers(spark):
    rows = [("a", 1, None), ("a", 2, 5), ("a", 3, None), (None, 4, 1)]
    df = spark.createDataFrame([(t, i, n, None, 0, None) for t, i, n in rows], "table_uuid string, snapshot_id bigint, sequence_number bigint, parent_snapshot_id bigint, timestamp_ms bigint, loaded_at timestamp_ntz")
    assert {r["snapshot_id"]: r["previous_id"] for r in timeline.in_sequence(df).collect()} == {1: None, 3: 1, 2: 3, 4: None}


def test_snapshot_log(spark):
    files = [("t", "f1", 10, 1), ("t", "f2", 20, 1), ("t", "f3", 30, -1), ("t", "f4", 30, 2), ("u", "g", 5, None)]
    df = spark.createDataFrame([(t, f, ms, None, s) for t, f, ms, s in files], "table_uuid string, metadata_file string, last_updated_ms bigint, delivered_at timestamp_ntz, current_snapshot_id bigint")
    log = timeline.snapshot_log(df)
    assert sorted(map(str, (tuple(r) for r in log.collect()))) == sorted(map(str, [("t", 1, 10), ("t", None, 30), ("t", 2, 30), ("u", None, 5)]))
    assert {tuple(r) for r in timeline.as_of_log(log, 25).collect()} == {("t", 1), ("u", None)}


def test_parse_documents(spark):
    rows = [(1, json.dumps(TABLE)), (2, "{"), (3, None), (4, "﻿" + json.dumps(FULL))]
    got = {r["k"]: r for r in frames.parse_documents(spark.createDataFrame(rows, "k int, body string"), "k", "body").collect()}
    assert [k for k, r in got.items() if r["error"] is None] == [1, 4]
    assert parse_table_metadata(got[4]["text"]) == parse_table_metadata(json.dumps(FULL))


def test_spark_schema(spark, md, tmp_path):
    schema = frames.to_spark_schema(md.current_schema())
    assert schema["a"].dataType == T.LongType() and not schema["a"].nullable and schema["a"].metadata == {"id": 1, "comment": "key"}
    assert schema["m"].dataType == T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("x", T.DecimalType(9, 2), False, {"id": 13})]), True), False)
    assert schema["m"].metadata["inner_ids"] == {"key": 10, "value": 11, "value.element": 12}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).schema["a"].metadata["id"] == 1
    for kind in (Primitive("decimal", (40, 2)), Primitive("decimal", (2, 5)), M.MapType(1, M.MapType(2, Primitive("int"), 3, True, Primitive("int")), 4, True, Primitive("int"))):
        with pytest.raises(UnsupportedTypeError):
            frames.to_spark_type(kind)


def test_projection_by_id_and_by_name(spark):
    field = lambda i, n, k, req=False: M.StructField(i, n, req, Primitive(k))
    old = M.Schema(0, (field(1, "a", "int"), field(2, "b.c", "string"), field(3, "gone", "int")))
    new = M.Schema(1, (field(2, "renamed", "string"), field(4, "added", "date"), field(1, "a", "long")))
    df = spark.createDataFrame([(1, "x", 2), (None, None, None)], "a int, `b.c` string, gone int")
    got = frames.project_by_id(df, old, new)
    assert got.dtypes == [("renamed", "string"), ("added", "date"), ("a", "bigint")] and [tuple(r) for r in got.collect()] == [("x", None, 1), (None, None, None)]
    with pytest.raises(ValueError):
        frames.project_by_id(df, old, M.Schema(2, (field(9, "must", "int", True),)))
    mapped = frames.map_names(df, M.NameMappings((M.NameMapping(("zz", "b.c", "a"), 2),)), new)
    assert [tuple(r) for r in mapped.collect()] == [("x", None, None), (None, None, None)]
    assert {tuple(r) for r in frames.required_nulls(df, ["a", "b.c"]).collect()} == {("a", 1), ("b.c", 1)}
    assert frames.identifier_duplicates(df.union(df), ["a"]).count() == 2


def test_validation(md):
    assert validate(md, 2) == []
    codes = [v.code for v in validate(parse_table_metadata(json.dumps(TABLE)))]
    assert codes == ["partition-source-id"]  # source 9 isn't there
    broken = FULL | {"current-schema-id": 9, "default-spec-id": 9, "default-sort-order-id": 9, "current-snapshot-id": 9, "last-column-id": 2, "last-sequence-number": 0, "refs": {"main": BRANCH | {"min-snapshots-to-keep": 0}, "x": BRANCH | {"snapshot-id": 8}}}
    codes = {v.code for v in validate(parse_table_metadata(json.dumps(broken)), 1)}
    assert codes == {"format-version", "current-schema-id", "default-spec-id", "default-sort-order-id", "current-snapshot-id", "main", "ref", "retention", "last-column-id", "last-sequence-number"}
    with pytest.raises(CodecError):
        loads(M.TableMetadata, "{}")


def test_retention(spark):
    """A chain 1 <- 2 <- ... <- 6, a tag on 2, a branch on 5 and an old ref."""
    hour = 3_600_000
    snaps = spark.createDataFrame([("t", i, i - 1 if i > 1 else None, i, i * hour, None, None) for i in range(1, 7)], "table_uuid string, snapshot_id bigint, parent_snapshot_id bigint, sequence_number bigint, timestamp_ms bigint, loaded_at timestamp_ntz, expired_at timestamp_ntz")
    kinds = "table_uuid string, ref_name string, snapshot_id bigint, ref_type string, min_snapshots_to_keep int, max_snapshot_age_ms bigint, max_ref_age_ms bigint, loaded_at timestamp_ntz"

    def candidates(refs):
        return sorted(r["snapshot_id"] for r in timeline.expire_candidates(spark.createDataFrame(refs, kinds), snaps, 6 * hour).collect())

    assert candidates([("t", "main", 5, "branch", 2, 0, None, None)]) == [1, 2, 3, 6]
    assert candidates([("t", "main", 5, "branch", 1, 3 * hour, 1, None)]) == [1, 2, 6]  # not older than three hours; main itself never expires
    assert candidates([("t", "main", 5, "branch", None, None, None, None), ("t", "keep", 2, "tag", None, None, None, None)]) == [1, 3, 4, 6]
    assert candidates([("t", "main", 6, "branch", 1, None, None, None), ("t", "old", 2, "tag", None, None, 4 * hour - 1, None)]) == [1, 2, 3, 4, 5]
    assert candidates([("t", "main", 99, "branch", 1, None, None, None)]) == [1, 2, 3, 4, 5, 6]


def test_retention_on_and_below_a_cycle(spark):
    """The cycle 5 -> 4 -> 3 -> 2 -> 5 by parent, 7 -> 6 -> 4 below it, and 1 alone."""
    parents = {5: 4, 4: 3, 3: 2, 2: 5, 6: 4, 7: 6, 1: None}
    snaps = spark.createDataFrame([("t", i, p, i, i, None, None) for i, p in parents.items()], "table_uuid string, snapshot_id bigint, parent_snapshot_id bigint, sequence_number bigint, timestamp_ms bigint, loaded_at timestamp_ntz, expired_at timestamp_ntz")
    chains: dict[int, list[int]] = {}
    for r in timeline.ancestors(snaps, snaps).orderBy("start_id", "pos").collect():
        chains.setdefault(r["start_id"], []).append(r["snapshot_id"])
    assert chains == {1: [1], 2: [2, 5, 4, 3], 3: [3, 2, 5, 4], 4: [4, 3, 2, 5], 5: [5, 4, 3, 2], 6: [6, 4, 3, 2, 5], 7: [7, 6, 4, 3, 2, 5]}
    refs = spark.createDataFrame([("t", "main", 7, "branch", 3, 2, None, None)], "table_uuid string, ref_name string, snapshot_id bigint, ref_type string, min_snapshots_to_keep int, max_snapshot_age_ms bigint, max_ref_age_ms bigint, loaded_at timestamp_ntz")
    assert sorted(r["snapshot_id"] for r in timeline.expire_candidates(refs, snaps, 7).collect()) == [1, 2, 3]  # 7, 6, 4 by count, 5 by age


def test_violations_of_versions_and_marks(spark):
    mark = "\ufeff"
    bodies = [json.dumps(FULL), json.dumps(FULL | {"format-version": 1}), mark + json.dumps(FULL | {"format-version": "1"}), mark + json.dumps(FULL | {"current-schema-id": 9}), None]
    docs = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    assert sorted((r["k"], r["code"]) for r in frames.violations_of(docs, "k", "body").collect()) == [(1, "format-version"), (2, "format-version"), (3, "current-schema-id")]
    assert frames.tables_of(docs, "body", "tables").count() == 4


def test_spark_types_of_nested_fields(spark):
    """Against a conversion without the codec, over the nested types of the test tables."""
    names = {"long": "bigint", "timestamp": "timestamp_ntz", "timestampz": "timestamp", "timestamptz": "timestamp", "time": "bigint", "uuid": "string"}

    def brute(kind):
        if isinstance(kind, str) and kind.lstrip().startswith("{"):
            kind = json.loads(kind)
        if isinstance(kind, str):
            name = "".join(kind.split()).lower()
            return "binary" if name.startswith("fixed[") else names.get(name, name)
        if kind["type"] == "struct":
            return "struct<" + ",".join(f"{f['name']}:{brute(f.get('field_type') or f.get('type'))}" for f in kind["fields"]) + ">"
        return f"array<{brute(kind['element'])}>" if kind["type"] == "list" else f"map<{brute(kind['key'])},{brute(kind['value'])}>"

    got = reference_queries.schema_to_struct_nested(spark, DATA).collect()
    kinds = {(r["table_uuid"], r["schema_id"], r["id"]): r["field_type"] for r in drift.latest_fields(spark.read.parquet(f"{DATA}/schema_fields.parquet")).collect() if "{" in (r["field_type"] or "")}
    assert got and {(r["table_uuid"], r["schema_id"], r["id"]): r["spark_type"] for r in got} == {k: brute(t) for k, t in kinds.items()}
    texts = ['{"type": "list", "element_id": "7", "element": " Decimal(9, 2)"}', '{"type": "list", "element-id": 7, "element": "decimal(40,2)"}', '{"type": "map"}', '{"type": "struct", "fields": [3]}', "{"]
    assert [frames.spark_type_of(t) for t in texts] == ["array<decimal(9,2)>", None, None, None, None]


def test_nested_projection_by_id_and_by_name(spark):
    field = lambda i, n, k, req=False: M.StructField(i, n, req, Primitive(k) if isinstance(k, str) else k)
    both = lambda item, key, price: (field(1, "s", item), field(2, "l", M.ListType(20, False, item)), field(3, "m", M.MapType(30, Primitive(key), 31, False, price)))
    old = M.Schema(0, both(M.Struct((field(11, "a.b", "int"), field(12, "b", "int", True), field(13, "gone", "int"))), "int", M.Struct((field(14, "x", "int"), field(15, "y", "int")))))
    new = M.Schema(1, both(M.Struct((field(12, "a.b", "long", True), field(16, "added", "date"), field(11, "c", "long"))), "long", M.Struct((field(15, "x", "int"), field(14, "y", "long")))))
    df = spark.createDataFrame([((1, 2, 3), [(4, 5, 6), None], {7: (8, 9)}), (None, None, None)], "s struct<`a.b`:int,b:int,gone:int>, l array<struct<`a.b`:int,b:int,gone:int>>, m map<int,struct<x:int,y:int>>")
    want = [{"s": {"a.b": 2, "added": None, "c": 1}, "l": [{"a.b": 5, "added": None, "c": 4}, None], "m": {7: {"x": 9, "y": 8}}}, {"s": None, "l": None, "m": None}]
    got = frames.project_by_id(df, old, new)
    assert got.dtypes == [("s", "struct<a.b:bigint,added:date,c:bigint>"), ("l", "array<struct<a.b:bigint,added:date,c:bigint>>"), ("m", "map<bigint,struct<x:int,y:bigint>>")]
    assert [r.asDict(recursive=True) for r in got.collect()] == want
    with pytest.raises(ValueError):
        frames.project_by_id(df, old, M.Schema(2, (field(1, "s", M.Struct((field(19, "must", "int", True),))),)))
    name = M.NameMapping
    item = (name(("zz", "a.b"), 11), name(("b", "a.b"), 12))
    mappings = M.NameMappings((name(("s",), 1, item), name(("l",), 2, (name(("element",), 20, item),)), name(("m",), 3, (name(("key",), 30), name(("value",), 31, (name(("x",), 14), name(("y",), 15)))))))
    assert [r.asDict(recursive=True) for r in frames.map_names(df, mappings, new).collect()] == want
