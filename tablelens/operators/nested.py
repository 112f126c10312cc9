"""Deeply nested semi-structured records to flat tables.

Single-pass tagged emission: a depth-first visitor goes once over each
document and emits a row (tag, key, parent key, payload) for every node. The
rows are written partitioned by tag, and each tag's schema is then applied to
its own partition only.

Documents are read in any of their spellings: kebab-case or snake_case keys,
``field_type`` or ``type``, ids as numbers or text, one object in place of a
list of one, refs as a map or as a list with names, a byte order mark, JSON
text inside JSON text, and the document inside envelopes.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens import jsontext
from tablelens.operators.fieldtree import as_int, described, get, objects, opened, type_tag
from tablelens.shared import exact, new_path, ship

#: What is not a node: a body, or a part of a document, that cannot be read.
REJECT = "reject"
TAGS = ("schema", "field", "spec", "spec_field", "snapshot", "ref")
_PARTS = ("schemas", "partition-specs", "snapshots", "refs")
_ROWS = "meta_id bigint, node_kind string, parent_key string, node_key string, pos int, payload string"

#: The columns of each tag's table.
SCHEMAS = {
    "schema": "schema_id int, identifier_field_ids array<int>",
    "field": "schema_id int, id int, name string, required boolean, field_type string, doc string",
    "spec": "spec_id int",
    "spec_field": "spec_id int, field_id int, source_id int, name string, transform string",
    "snapshot": "snapshot_id bigint, parent_snapshot_id bigint, sequence_number bigint, timestamp_ms bigint, manifest_list string, operation string, summary map<string,string>, schema_id bigint",
    "ref": "name string, snapshot_id bigint, type string, min_snapshots_to_keep int, max_snapshot_age_ms bigint, max_ref_age_ms bigint",
    REJECT: "part string, reason string",
}


def documents_in(body: str | None) -> list[dict] | None:
    """The documents of a body; None where it isn't complete JSON."""
    value: Any = body
    while isinstance(value, str):
        try:
            value = jsontext.read(value.removeprefix("\ufeff").strip().removeprefix("\ufeff"))
        except ValueError:
            return None
    if body is None:
        return None
    found, stack = [], [value]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            if any(get(node, part) is not None for part in (*_PARTS, "format-version")):
                found.append(node)
            else:
                stack.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            stack.extend(reversed(node))
        elif isinstance(node, str) and node.lstrip("\ufeff \t\r\n")[:1] in ("{", "["):
            try:
                stack.append(jsontext.read(node.removeprefix("\ufeff")))
            except ValueError:
                continue
    return found


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else jsontext.write(value)


#: (tag, parent key, key, position, payload)
_Node = tuple[str, str, str, int, dict]


def _reject(parent: str, part: str, pos: int, reason: str) -> _Node:
    return REJECT, parent, part, pos, {"part": part, "reason": reason}


def _fields_of(schema: dict, sid: int) -> Iterator[_Node]:
    """Fields of a schema depth first, without recursion. A field without a readable
    id is rejected with all below it."""
    stack = [(str(sid), -1, None, {"type": "struct", "fields": schema.get("fields")}, {})]
    while stack:
        parent, pos, fid, kind, raw = stack.pop()
        key = parent
        if pos >= 0:
            if fid is None:
                yield _reject(parent, "field", pos, "no readable id")
                continue
            key = f"{sid}/{fid}"
            yield "field", parent, key, pos, {"schema_id": sid, "id": fid, "name": _text(raw.get("name")), "required": raw.get("required"), "field_type": type_tag(kind), "doc": _text(raw.get("doc"))}
        stack.extend((key, p, f, k, r) for p, (f, _, k, r) in reversed(list(enumerate(described(kind)))))


def _schemas(doc: dict, tags: Collection[str]) -> Iterator[_Node]:
    for pos, schema in enumerate(objects(get(doc, "schemas"))):
        sid = as_int(get(schema, "schema-id"), 32)
        if sid is None:
            yield _reject("doc", "schema", pos, "no readable id")
            continue
        ids = get(schema, "identifier-field-ids")
        yield "schema", "doc", str(sid), pos, {"schema_id": sid, "identifier_field_ids": [as_int(i, 32) for i in ids] if isinstance(ids, list) else None}
        if "field" in tags or REJECT in tags:
            yield from _fields_of(schema, sid)


def _specs(doc: dict) -> Iterator[_Node]:
    for pos, spec in enumerate(objects(get(doc, "partition-specs"))):
        sid = as_int(get(spec, "spec-id"), 32)
        if sid is None:
            yield _reject("doc", "spec", pos, "no readable id")
            continue
        yield "spec", "doc", str(sid), pos, {"spec_id": sid}
        for p, f in enumerate(objects(spec.get("fields"))):
            fid = as_int(get(f, "field-id"), 32)
            if fid is None:
                yield _reject(str(sid), "spec_field", p, "no readable id")
            else:
                yield "spec_field", str(sid), f"{sid}/{fid}", p, {"spec_id": sid, "field_id": fid, "source_id": as_int(get(f, "source-id"), 32), "name": _text(f.get("name")), "transform": _text(f.get("transform"))}


def _snapshots(doc: dict) -> Iterator[_Node]:
    for pos, snap in enumerate(objects(get(doc, "snapshots"))):
        sid = as_int(get(snap, "snapshot-id"))
        if sid is None:
            yield _reject("doc", "snapshot", pos, "no readable id")
            continue
        summary = snap.get("summary") if isinstance(snap.get("summary"), dict) else {}
        numbers = {k.replace("-", "_"): as_int(get(snap, k)) for k in ("parent-snapshot-id", "sequence-number", "timestamp-ms", "schema-id")}
        yield "snapshot", "doc", str(sid), pos, {"snapshot_id": sid, **numbers, "manifest_list": _text(get(snap, "manifest-list")), "operation": _text(summary.get("operation")), "summary": {k: _text(v) for k, v in summary.items() if k != "operation"}}


def _refs(doc: dict) -> Iterator[_Node]:
    refs = opened(get(doc, "refs"))
    named = refs.items() if isinstance(refs, dict) else [(r.get("name"), r) for r in objects(refs)]
    for pos, (name, ref) in enumerate(named):
        if name is None or not isinstance(ref, dict):
            yield _reject("doc", "ref", pos, "no name" if name is None else "no object")
            continue
        numbers = {k.replace("-", "_"): as_int(get(ref, k), bits) for k, bits in (("snapshot-id", 64), ("min-snapshots-to-keep", 32), ("max-snapshot-age-ms", 64), ("max-ref-age-ms", 64))}
        yield "ref", "doc", str(name), pos, {"name": str(name), "type": _text(ref.get("type")), **numbers}


def visit(doc: dict, tags: Collection[str] = (*TAGS, REJECT)) -> Iterator[_Node]:
    """Every node of a document with one of the tags; parts without any are not entered."""
    parts = [(lambda d: _schemas(d, tags), ("schema", "field")), (_specs, ("spec", "spec_field")), (_snapshots, ("snapshot",)), (_refs, ("ref",))]
    for part, own in parts:
        if REJECT in tags or any(t in tags for t in own):
            yield from (node for node in part(doc) if node[0] in tags)


def _emit(batches: Iterator[pa.RecordBatch], tags: Collection[str], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = ["meta_id", "node_kind", "parent_key", "node_key", "pos", *(["payload"] if payloads else [])]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        ids, kinds, parents, keys, places, *rest = zip(*rows)
        columns = [pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), jsontext.texts(parents), jsontext.texts(keys), pa.array(places, pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, *(jsontext.texts(c) for c in rest)], names)

    for batch in batches:
        rows: list[tuple] = []
        for meta_id, body in zip(batch["meta_id"].to_pylist(), batch["body"].to_pylist()):
            docs = documents_in(body)
            if docs is None and REJECT in tags:
                docs, nodes = [], [_reject("", "body", 0, "no complete JSON")]
                rows.extend((meta_id, *node[:4], *([jsontext.write(node[4])] if payloads else [])) for node in nodes)
            for doc in docs or ():
                if payloads:
                    rows.extend((meta_id, *node[:4], jsontext.write(node[4])) for node in visit(doc, tags))
                else:
                    rows.extend((meta_id, *node[:4]) for node in visit(doc, tags))
            if len(rows) >= 20_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)


def flatten_documents(docs: DataFrame, tags: Collection[str] = TAGS, payloads: bool = True) -> DataFrame:
    """All nodes of all documents: (meta_id, node_kind, parent_key, node_key, pos,
    payload); without payloads all but the last.

    tags are those wanted; REJECT may be among them and gives a row for each body
    that isn't complete JSON (null, empty, cut off, with text behind it) and each
    part without a readable id or name, which have no other rows, nor has what is
    below such a part. Parts that are absent or null are empty. Depth and length of
    numbers have no limit. A document is read within one task; tasks take as many
    documents as a file split holds, and there is no shuffle.
    """
    ship(docs.sparkSession)
    wanted = tuple(tags)
    return exact(docs, "meta_id", "body").mapInArrow(lambda b: _emit(b, wanted, payloads), _ROWS if payloads else _ROWS.removesuffix(", payload string"))


def write_tables(nodes: DataFrame, path: str | None = None) -> str:
    """Writes the nodes partitioned by tag; returns the folder, by default one in the
    shared folder that goes when the session ends."""
    path = path or new_path(nodes.sparkSession, "nodes")
    nodes.write.partitionBy("node_kind").parquet(path)
    return path


def stored_tables(spark: SparkSession, path: str) -> DataFrame:
    """The nodes that write_tables() wrote, none of them included."""
    return spark.read.schema(_ROWS).parquet(path)


def read_table(nodes: DataFrame, tag: str) -> DataFrame:
    """The flat table of one tag: keys, and the tag's own columns."""
    if tag not in SCHEMAS:
        raise ValueError(f"unknown tag {tag!r}; one of {', '.join(SCHEMAS)}")
    typed = nodes.filter(F.col("node_kind") == tag).select("meta_id", "parent_key", "node_key", "pos", F.from_json("payload", SCHEMAS[tag]).alias("p"))
    clash = {"meta_id", "parent_key", "node_key", "pos"}
    return typed.select("meta_id", "parent_key", "node_key", "pos", *(F.col(f"p.{f.name}").alias(f.name if f.name not in clash else f"value_{f.name}") for f in typed.schema["p"].dataType.fields))
