"""The strict codec: valid documents, rejected ones, and round trips."""

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablelens import model as M
from tablelens.codec import KINDS, CodecError, dumps, dumps_type, loads, loads_type, parse_table_metadata
from tablelens.types import Primitive

TABLE = {
    "format-version": 2, "table-uuid": "5d0e8f7a-63c4-4b19-8e2d-0a9b7c61f3e5", "location": "wh://lake/orders", "last-sequence-number": 34,
    "last-updated-ms": 1720000000123, "last-column-id": 3,
    "schemas": [{"schema-id": 7, "type": "struct", "fields": [
        {"id": 2, "name": "code", "required": True, "field_type": "fixed[12]"}, {"id": 3, "name": "placed", "required": False, "field_type": "timestamp"}]}],
    "current-schema-id": 7, "partition-specs": [{"spec-id": 2, "fields": [{"source-id": 9, "field-id": 1004, "name": "placed_hour", "transform": "hour"}]}],  # no field 9
    "default-spec-id": 2, "last-partition-id": 1004, "properties": {"owner": "team-a", "empty": ""},
    "metadata-log": [{"metadata-file": "wh://lake/orders/meta/33.json", "timestamp-ms": 1719999000000}], "sort-orders": [], "default-sort-order-id": 0,
}
SNAPSHOT = {"snapshot-id": 9007199254740995, "sequence-number": 33, "timestamp-ms": 1719999000000, "summary": {"operation": "overwrite"}, "manifest-list": "wh://lake/orders/lists/33", "schema-id": 7}
BRANCH = {"snapshot-id": 9007199254740995, "type": "branch", "min-snapshots-to-keep": 4, "max-snapshot-age-ms": 86400000, "max-ref-age-ms": 604800000}


def field(kind):
    return json.dumps({"id": 21, "name": "part_no", "required": True, "field_type": kind})


def table(**changes):
    return json.dumps(TABLE | {k.replace("_", "-"): v for k, v in changes.items()})


def same_again(value, dialect="reference"):
    assert loads(type(value), dumps(value, dialect), dialect) == value


def test_table_metadata():
    md = parse_table_metadata(table())
    assert md.table_uuid == TABLE["table-uuid"]
    assert [f.field_type for f in md.schemas[0].fields] == [Primitive("fixed", (12,)), Primitive("timestamp")]
    assert md.partition_specs[0].fields[0].transform == M.Transform("hour")  # its source need not be there
    assert md.properties == {"owner": "team-a", "empty": ""} and md.snapshots is None and md.refs is None
    same_again(md)
    same_again(md, "spec")


def test_reference_output_form():
    out = json.loads(dumps(parse_table_metadata(table())))
    assert out["format-version"] == "TableMetadataV2" and out["schemas"][0]["type"] == "Struct" and out["refs"] is None
    assert json.loads(dumps(parse_table_metadata(table()), "spec"))["format-version"] == 2


def test_sub_documents():
    assert loads(M.Struct, '{"fields": []}') == M.Struct(())
    assert loads(M.StructField, field("decimal(20,20)")) == M.StructField(21, "part_no", True, Primitive("decimal", (20, 20)))
    assert loads_type('{"type": "list", "element-id": 31, "element-required": false, "element": "uuid"}') == M.ListType(31, False, Primitive("uuid"))
    m = loads_type('{"type": "map", "key-id": 41, "key": "date", "value-id": 42, "value-required": true, "value": {"fields": []}}')
    assert m == M.MapType(41, Primitive("date"), 42, True, M.Struct(()))
    mapping = loads(M.NameMapping, '{"field-id": 51, "names": ["address", "addr"], "fields": [{"names": []}, {"field-id": 53, "names": ["zip"]}]}')
    assert mapping.field_id == 51 and [x.field_id for x in mapping.fields] == [None, 53]
    schema = loads(M.Schema, '{"schema-id": 6, "fields": [], "name-mapping": {"default": [{"field-id": 51, "names": ["address"]}]}}')
    assert schema.identifier_field_ids is None and len(schema.name_mapping.default) == 1
    order = loads(M.SortOrder, '{"order-id": 8, "fields": [{"source-id": 61, "transform": "truncate[7]", "direction": "asc", "null-order": "nulls-first"}]}')
    assert order.fields == (M.SortField(61, M.Transform("truncate", 7), "asc", "nulls-first"),)
    snapshot = loads(M.Snapshot, json.dumps(SNAPSHOT))
    assert snapshot.summary == M.Summary("overwrite", {}) and snapshot.snapshot_id == 2**53 + 3
    for doc in (BRANCH, {"snapshot-id": 1, "type": "tag", "max-ref-age-ms": 5}):
        ref = loads(M.Reference, json.dumps(doc))
        assert ref.retention.kind == doc["type"]
        same_again(ref)
    for value in (mapping, schema, order, snapshot):
        same_again(value)
        same_again(value, "spec")


@pytest.mark.parametrize("kind", ["boolean", "int", "long", "float", "double", "decimal(3,9)", "date", "time", "timestamp", "timestampz", "string", "uuid", "fixed[18446744073709551615]", "binary", "decimal(2147483647,255)"])
def test_types_round_trip(kind):
    f = loads(M.StructField, field(kind))
    assert str(f.field_type) == kind
    same_again(f)
    same_again(f, "spec")


@pytest.mark.parametrize("text", ["void", "identity", "year", "month", "day", "hour", "bucket[13]", "truncate[5]", "bucket[0]", "truncate[4294967295]"])
def test_transforms_round_trip(text):
    f = loads(M.PartitionField, json.dumps({"source-id": 71, "field-id": 1900, "name": "p", "transform": text}))
    assert str(f.transform) == text
    same_again(f)


@pytest.mark.parametrize(
    "cls,text",
    [
        (M.Struct, '{"type": "struct"}'), (M.StructField, field("decimal(5,256)")), (M.StructField, field("decimal(2147483648,1)")), (M.StructField, field("fixed[2.5]")), (M.StructField, field("fixed[18446744073709551616]")),
        (M.TableMetadata, json.dumps({k: TABLE[k] for k in ("format-version", "table-uuid")})), (M.TableMetadata, '{"format-version": 3}'), (M.TableMetadata, table(table_uuid="5d0e8f7a")),
        (M.TableMetadata, table(table_uuid="{5d0e8f7a-63c4-4b19-8e2d-0a9b7c61f3e5}")),
        (M.StructField, '{"id":1,"name":"a","required":true,"type":"int"}'), (M.StructField, field("timestamptz")),
        (M.StructField, field("decimal(9, 2)")), (M.StructField, field("decimal")), (M.StructField, field("Decimal(9,2)")), (M.StructField, field("decimal(9,2)\n")),
        (M.StructField, field("decimal(9,٢)")), (M.StructField, field(None)), (M.StructField, field(3)),
        *[(M.PartitionField, json.dumps({"source-id": 4, "field-id": 1, "name": "p", "transform": t})) for t in ("bucket[4294967296]", "bucket", "bucket[-1]", "truncate[]", "Day", "")],
        (M.Snapshot, json.dumps(SNAPSHOT | {"summary": {"operation": "append", "n": 3}})), (M.Snapshot, json.dumps(SNAPSHOT | {"summary": {"operation": "merge"}})),
        (M.Snapshot, json.dumps({k: v for k, v in SNAPSHOT.items() if k != "summary"})),
        (M.Reference, json.dumps({k: v for k, v in BRANCH.items() if k != "max-ref-age-ms"})), (M.Reference, json.dumps(BRANCH | {"type": "other"})),
        *[(M.StructField, json.dumps({"id": i, "name": "a", "required": True, "field_type": "int"})) for i in (True, 1.0, 2147483648, "1", None)],
        (M.StructField, '{"id":1,"id":2,"name":"a","required":true,"field_type":"int"}'), (M.StructField, '{"id":NaN,"name":"a","required":true,"field_type":"int"}'),
        (M.StructField, ""), (M.StructField, "[]"), (M.StructField, "{"), (M.SortField, '{"transform":"day","source-id":1,"direction":"DESC","null-order":"nulls-last"}'),
    ],
)
def test_rejected(cls, text):
    with pytest.raises(CodecError):
        loads(cls, text)


def test_accepted_oddities():
    for doc in (TABLE | {"format-version": 1}, TABLE | {"format-version": "x"}, {k: v for k, v in TABLE.items() if k != "format-version"}, TABLE | {"unknown": [1]}):
        assert parse_table_metadata(json.dumps(doc)) == parse_table_metadata(table())
    assert loads(M.StructField, field("int")) == loads(M.StructField, field("int")[:-1] + ', "doc": null}')
    assert parse_table_metadata(table(table_uuid="5D0E8F7A63C44B198E2D0A9B7C61F3E5")).table_uuid == TABLE["table-uuid"]
    assert loads(M.Snapshot, json.dumps(SNAPSHOT)[:-1] + ', "x": 1, "x": 2}').snapshot_id == SNAPSHOT["snapshot-id"]


def test_spec_dialect():
    assert loads(M.StructField, '{"id":1,"name":"a","required":true,"type":"timestamptz"}', "spec").field_type == Primitive("timestampz")
    ref = loads(M.Reference, '{"snapshot-id":1,"type":"branch"}', "spec")
    assert ref.retention == M.Retention("branch", None)
    same_again(ref, "spec")
    assert json.loads(dumps(loads(M.StructField, field("timestampz")), "spec"))["type"] == "timestamptz"


def nested(depth, leaf):
    return "".join(f'{{"type":"list","element-id":{i},"element-required":false,"element":' for i in range(depth)) + leaf + "}" * depth


def test_deep_types():
    kind = loads_type(nested(126, '"int"'))
    assert loads_type(dumps_type(kind)) == kind
    for depth, leaf in ((40, '"nothing"'), (100, "3"), (128, '"int"'), (600, '"int"'), (60_000, '"int"')):
        begun = time.perf_counter()
        for dialect in ("reference", "spec"):
            with pytest.raises(CodecError):
                loads_type(nested(depth, leaf), dialect)
        assert time.perf_counter() - begun < 2


def test_the_first_kind_that_reads_holds():
    assert loads_type('{"fields": 3, "element-id": 1, "element-required": true, "element": "int"}') == M.ListType(1, True, Primitive("int"))
    both = '{"fields": [], "element-id": 1, "element-required": true, "element": "int"}'
    assert loads_type(both) == M.Struct(())
    with pytest.raises(CodecError, match="value-id is missing"):
        loads_type('{"key-id": 1, "key": "int"}')


@pytest.mark.parametrize("kind", [f"decimal({'9' * 5000},2)", f"fixed[{'9' * 5000}]", f"bucket[{'9' * 5000}]"])
def test_long_numbers(kind):
    with pytest.raises(CodecError):
        loads_type(json.dumps(kind))
    with pytest.raises(CodecError):
        loads(M.PartitionField, json.dumps({"source-id": 1, "field-id": 1, "name": "p", "transform": kind}))
    with pytest.raises(CodecError):
        parse_table_metadata(table()[:-1] + ', "other": ' + "7" * 5000 + "}")
    assert loads_type(f'"fixed[{"0" * 5000}7]"') == Primitive("fixed", (7,))


def test_every_document_has_a_kind():
    assert len(KINDS) == 20


transforms = st.one_of(st.sampled_from(["void", "identity", "year", "month", "day", "hour"]).map(M.Transform), st.builds(M.Transform, st.sampled_from(["bucket", "truncate"]), st.integers(0, 2**32 - 1)))
i32 = st.integers(-(2**31), 2**31 - 1)
i64 = st.integers(-(2**63), 2**63 - 1)
sort_fields = st.builds(M.SortField, i32, transforms, st.sampled_from(["asc", "desc"]), st.sampled_from(["nulls-first", "nulls-last"]))
primitives = st.one_of(st.sampled_from(["int", "long", "string", "timestampz", "uuid"]).map(Primitive), st.builds(lambda p, s: Primitive("decimal", (p, s)), st.integers(0, 2**31 - 1), st.integers(0, 255)), st.builds(lambda n: Primitive("fixed", (n,)), st.integers(0, 2**64 - 1)))
types = st.recursive(
    primitives,
    lambda t: st.one_of(
        st.builds(M.ListType, i32, st.booleans(), t), st.builds(M.MapType, i32, t, i32, st.booleans(), t),
        st.builds(lambda f: M.Struct(tuple(f)), st.lists(st.builds(M.StructField, i32, st.text(max_size=5), st.booleans(), t, st.none() | st.text(max_size=5)), max_size=3)),
    ),
    max_leaves=6,
)


@given(st.builds(lambda i, f: M.SortOrder(i, tuple(f)), i32, st.lists(sort_fields, min_size=1, max_size=9)))
@settings(max_examples=60, deadline=None)
def test_sort_orders_round_trip(order):
    same_again(order)


@given(types)
@settings(max_examples=80, deadline=None)
def test_type_trees_round_trip(kind):
    for dialect in ("reference", "spec"):
        assert loads_type(dumps_type(kind, dialect), dialect) == kind


@given(st.builds(M.Snapshot, i64, i64, i64, st.text(), st.builds(M.Summary, st.none() | st.sampled_from(["append", "delete"]), st.dictionaries(st.text(min_size=1).filter(lambda k: k != "operation"), st.text())), st.none() | i64, st.none() | i64))
@settings(max_examples=60, deadline=None)
def test_snapshots_round_trip(snapshot):
    same_again(snapshot)
