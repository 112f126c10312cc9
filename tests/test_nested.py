"""Nested documents to flat tables."""

import json

import pytest
from pyspark.sql import functions as F

from tablelens import jsontext
from tablelens.operators.fieldtree import walk
from tablelens.operators.nested import REJECT, TAGS, flatten_documents, read_table, write_tables

DOC = {
    "format-version": 2, "schemas": [{"schema-id": 3, "type": "struct", "fields": [
        {"id": 1, "name": "a", "required": True, "field_type": "int"},
        {"id": 2, "name": "b", "required": False, "doc": "d", "field_type": {"type": "struct", "fields": [
            {"id": 4, "name": "c", "required": False, "field_type": {"type": "list", "element-id": 5, "element-required": False, "element": {"type": "map", "key-id": 6, "key": "string", "value-id": 7, "value-required": True, "value": {"type": "struct", "fields": [{"id": 8, "name": "e", "required": True, "field_type": "uuid"}]}}}}]}}]}],
    "partition-specs": [{"spec-id": 0, "fields": [{"source-id": 1, "field-id": 1000, "name": "p", "transform": "day"}]}],
    "snapshots": [{"snapshot-id": 9007199254740993, "sequence-number": 1, "timestamp-ms": 5, "manifest-list": "m", "summary": {"operation": "append", "n": "1"}}],
    "refs": {"main": {"snapshot-id": 9007199254740993, "type": "branch", "min-snapshots-to-keep": 1}},
}
NODES = {
    ("schema", "doc", "3"), ("field", "3", "3/1"), ("field", "3", "3/2"), ("field", "3/2", "3/4"), ("field", "3/4", "3/5"), ("field", "3/5", "3/6"),
    ("field", "3/5", "3/7"), ("field", "3/7", "3/8"), ("spec", "doc", "0"), ("spec_field", "0", "0/1000"), ("snapshot", "doc", "9007199254740993"), ("ref", "doc", "main"),
}


def snake(x):
    if isinstance(x, dict):
        return {k.replace("-", "_"): snake(v) for k, v in x.items()}
    return [snake(v) for v in x] if isinstance(x, list) else x


def typed(x):
    if isinstance(x, dict):
        return {("type" if k == "field_type" else k): typed(v) for k, v in x.items()}
    return [typed(v) for v in x] if isinstance(x, list) else x


def texts(x):
    if isinstance(x, dict):
        return {k: str(v) if isinstance(v, int) and not isinstance(v, bool) else texts(v) for k, v in x.items()}
    return [texts(v) for v in x] if isinstance(x, list) else x


def in_text(x):
    """Types of fields as JSON text in the document."""
    if isinstance(x, dict):
        return {k: json.dumps(in_text(v)) if k == "field_type" and isinstance(v, dict) else in_text(v) for k, v in x.items()}
    return [in_text(v) for v in x] if isinstance(x, list) else x


SPELLINGS = {
    13: json.dumps(in_text(DOC)), 14: json.dumps([json.dumps(DOC)]),
    1: json.dumps(DOC), 2: json.dumps(snake(DOC), indent=1), 3: json.dumps(typed(DOC)), 4: json.dumps(texts(DOC)), 5: json.dumps([DOC]), 6: json.dumps(json.dumps(DOC)),
    7: json.dumps({"metadata": DOC}), 8: json.dumps({"kind": "table", "payload": {"metadata": snake(DOC)}}), 9: "﻿" + json.dumps(DOC) + "  \n", 10: "\t" + json.dumps({**DOC, "schemas": DOC["schemas"][0], "partition-specs": DOC["partition-specs"][0]}),
    11: json.dumps({**DOC, "refs": [{"name": "main", **DOC["refs"]["main"]}]}), 12: "﻿" + json.dumps(json.dumps(DOC)),
}
BROKEN = {50: None, 51: "", 52: json.dumps(DOC)[:-9], 53: json.dumps(DOC) + "x", 54: "null", 55: "3", 56: "{}", 57: json.dumps({**DOC, "schemas": None, "snapshots": None, "partition-specs": [], "refs": None}), 58: '"', 59: "[" * 100_000}


def nodes_of(spark, bodies):
    df = spark.createDataFrame(list(bodies.items()), "meta_id bigint, body string")
    out = {}
    for r in flatten_documents(df.withColumns({"node_kind": F.lit(1), "pos": F.lit(2)})).collect():
        out.setdefault(r["meta_id"], []).append((r["node_kind"], r["parent_key"], r["node_key"]))
    return out


@pytest.mark.parametrize("key", SPELLINGS)
def test_spellings(spark, key):
    (got,) = nodes_of(spark, {key: SPELLINGS[key]}).values()
    assert len(got) == len(NODES) and set(got) == NODES


def test_incomplete_bodies(spark):
    assert nodes_of(spark, BROKEN) == {}
    assert nodes_of(spark, {}) == {}


@pytest.mark.parametrize("depth", [300, 5_000, 20_000])
def test_deep_document(spark, depth):
    kind = "".join(f'{{"type":"list","element-id":{100_000 - i},"element-required":true,"element":' for i in range(depth)) + '"int"' + "}" * depth
    body = f'{{"schemas":[{{"schema-id":0,"fields":[{{"id":1,"name":"a","required":true,"field_type":{kind}}}]}}]}}'
    (got,) = nodes_of(spark, {1: body}).values()
    assert len(got) == depth + 2
    assert len(list(walk(kind))) == depth


def test_long_numbers_and_repeated_ids(spark):
    body = json.dumps({"n": 0, **DOC}).replace('"n": 0', '"n": ' + "8" * 5000)
    (got,) = nodes_of(spark, {1: body}).values()
    assert set(got) == NODES
    twice = {"schemas": [{"schema-id": 0, "fields": [{"id": 1, "name": "a", "required": True, "field_type": "int", "doc": "x"}, {"id": 1, "name": "b\ud800", "required": False, "field_type": "int"}]}]}
    df = spark.createDataFrame([(1, json.dumps(twice))], "meta_id bigint, body string")
    rows = read_table(flatten_documents(df, ("field",)), "field").orderBy("pos").collect()
    assert [(r["name"], r["required"], r["doc"]) for r in rows] == [("a", True, "x"), ("b\ufffd", False, None)]


def test_rejects(spark):
    odd = {"schemas": [{"schema-id": "x", "fields": []}, {"schema-id": 2, "fields": [{"id": 2**40, "name": "a", "field_type": {"type": "list", "element-id": 5, "element": "int"}}]}], "refs": {"r": 3}}
    df = spark.createDataFrame([(1, None), (2, json.dumps(odd)), (3, json.dumps(DOC))], "meta_id bigint, body string")
    got = read_table(flatten_documents(df, (REJECT,)), REJECT)
    assert sorted((r["meta_id"], r["part"], r["reason"]) for r in got.collect()) == [(1, "body", "no complete JSON"), (2, "field", "no readable id"), (2, "ref", "no object"), (2, "schema", "no readable id")]


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, {"b": "\\u00e9\\n"}, null, true, false], "": {}, "a": [], "c": [[], {}]}', " [ 1 ] ", '"x"', "3", "[NaN, -Infinity]"])
def test_flat_reader(text):
    assert repr(jsontext._read_flat(text, float)) == repr(json.loads(text))


@pytest.mark.parametrize("text", ["", "[1,]", '{"a" 1}', '{"a": 1,}', "[1", "{", "[1] 2", '{1: 2}', "[01]", "tru", '["a]'])
def test_flat_reader_rejects(text):
    with pytest.raises(ValueError):
        jsontext._read_flat(text, float)


def test_write_deep():
    value = []
    for _ in range(50_000):
        value = [value, {"k": 1}]
    assert jsontext.write(value).count("[") == 50_001


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(k, SPELLINGS[k]) for k in (1, 4, 8)], "meta_id bigint, body string")
    stored = spark.read.parquet(write_tables(flatten_documents(df), str(tmp_path / "nodes")))
    fields = read_table(stored, "field")
    assert fields.count() == 21
    row = fields.filter("node_key = '3/2' and meta_id = 4").first()
    assert (row["schema_id"], row["id"], row["name"], row["required"], row["field_type"], row["doc"]) == (3, 2, "b", False, "struct", "d")
    snapshot = read_table(stored, "snapshot").filter("meta_id = 8").first()
    assert snapshot["snapshot_id"] == 9007199254740993 and snapshot["operation"] == "append" and snapshot["summary"] == {"n": "1"}
    plan = fields._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(node_kind" in plan
    for tag in TAGS:
        assert read_table(stored, tag).count() > 0
    with pytest.raises(ValueError):
        read_table(stored, "other")
