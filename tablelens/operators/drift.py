"""Schemas that drift between files.

Tagged-union inference: the schemas of a table are fused, one after the other, into a
union whose paths (field ids, at any depth) keep every alternative form they ever had:
name, type tag, and the run of neighbouring schemas with it. A change is an
alternative that appears or ends between two neighbouring schemas.

Schemas go through one shuffle only: a range partitioning by (table, schema), which
puts neighbouring schemas next to each other and splits a table with a large part of
all schemas. A task holds two schemas at a time. What lies between two partitions is
compared from their outermost schemas, of which there are two a partition.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import sys
from collections.abc import Iterator
from decimal import Context, Decimal, InvalidOperation
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens import jsontext
from tablelens.operators.fieldtree import NESTED, as_int, children, get, inner, opened, tag_of, type_tag
from tablelens.shared import exact, materialize, ship

HOT_ROWS = 100_000
_KEPT = {"table_uuid": "string", "schema_id": "int", "loaded_at": "timestamp_ntz"}
_FOUND = {"id": pa.int32(), "top_id": pa.int32(), "parent_id": pa.int32(), "name": pa.string(), "tag": pa.string()}


def _fields(fields: DataFrame) -> DataFrame:
    """The columns used; rows without table_uuid, schema_id or id are no fields."""
    columns = exact(fields, "table_uuid", "schema_id", "id", "name", "field_type", "loaded_at")
    typed = columns.select("table_uuid", F.col("schema_id").cast("int").alias("schema_id"), F.col("id").cast("int").alias("id"), "name", F.col("field_type").cast("string").alias("field_type"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"))
    return typed.filter(F.col("table_uuid").isNotNull() & F.col("schema_id").isNotNull() & F.col("id").isNotNull())


def latest_fields(fields: DataFrame) -> DataFrame:
    """Of several rows of a field (table, schema, id) the one loaded last; among
    equal times the greatest (name, type)."""
    best = _fields(fields).groupBy("table_uuid", "schema_id", "id").agg(F.max(F.struct("loaded_at", "name", "field_type")).alias("b"))
    return best.select("table_uuid", "schema_id", "id", "b.name", "b.field_type", "b.loaded_at")


def _flatten(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, names, types = batch["id"].to_pylist(), batch["name"].to_pylist(), batch["field_type"].to_pylist()
        rows: list[int] = []
        found: list[tuple] = []
        for row, (top, name, text) in enumerate(zip(ids, names, types)):
            rows.append(row)
            found.append((top, top, None, name, None if text is None else tag_of(text)))
            if text is not None and "{" in text:
                for field, above, inner_name, tag in inner(text):
                    rows.append(row)
                    found.append((field, top, top if above is None else above, inner_name, tag))
        take = pa.array(rows, pa.int64())
        columns = zip(*found) if found else [()] * len(_FOUND)
        yield pa.RecordBatch.from_arrays([*(batch[k].take(take) for k in kept), *(jsontext.texts(c) if t == pa.string() else pa.array(c, t) for c, t in zip(columns, _FOUND.values()))], [*kept, *_FOUND])


def flatten_fields(fields: DataFrame, types: bool = False) -> DataFrame:
    """One row per field at any depth, those given and those inside their types:
    (id, top_id, parent_id, name, tag), with table, schema and time as given;
    with types also the given field_type that each was found in."""
    ship(fields.sparkSession)
    kinds = _KEPT | ({"field_type": "string"} if types else {})
    kept = [c for c in kinds if c in fields.columns]
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", id int, top_id int, parent_id int, name string, tag string"
    return exact(fields, *dict.fromkeys([*kept, "id", "name", "field_type"])).mapInArrow(lambda b: _flatten(b, kept), schema)


# ---------------------------------------------------------------- the union

#: Of a field in a schema: name, tag, and the id of the field that holds it.
_Form = tuple[str | None, str | None, int | None]
_EDGE = "table_uuid string, schema_id int, id int, name string, tag string, parent_id int, is_first boolean, is_last boolean"
#: kind: run (an alternative from schema_id to to_id, n schemas), change (from schema_id to to_id), edge.
_WALKED = f"kind string, {_EDGE}, to_id int, n bigint, change_kind string"
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
_WALKED_ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in _WALKED.split(", "))])


def _order(value: Any) -> tuple:
    """For comparing values that may be null; null is least."""
    return (False,) if value is None else (True, value)


def _forms(rows: list[tuple]) -> dict[int, _Form]:
    """The form of each id in a schema, of its rows (id, loaded_at, name, type) in that
    order: of a field the last row holds, of an id given twice the form loaded last,
    then the greatest."""
    latest = {top: (at, name, text) for top, at, name, text in rows}
    best: dict[int, tuple[tuple, _Form]] = {}

    def see(field: int, at: Any, form: _Form) -> None:
        old = best.get(field)
        if old is None:
            best[field] = ((), form) if at is None else ((at,), form)
        else:
            key = lambda t, f: (t, _order(f[0]), _order(f[1]), _order(f[2]))
            new = () if at is None else (at,)
            if key(new, form) > key(*old):
                best[field] = (new, form)

    for top, (at, name, text) in latest.items():
        see(top, at, (name, None if text is None else tag_of(text), None))
        if text is not None and "{" in text:
            for field, above, inner_name, tag in inner(text):
                if -(1 << 31) <= field < 1 << 31:
                    see(field, at, (inner_name, tag, top if above is None else above))
    return {field: form for field, (_, form) in best.items()}


def _changes(old: dict[int, _Form], new: dict[int, _Form]) -> Iterator[tuple[int, str]]:
    """(id, kind of change) from one schema to the next."""
    for field, form in new.items():
        was = old.get(field)
        if was is None:
            yield field, "added"
            continue
        if was[0] != form[0]:
            yield field, "renamed"
        if was[1] != form[1]:
            yield field, "type_changed"
    yield from ((field, "removed") for field in old if field not in new)


class _Union:
    """The union of a table's schemas in a partition, and the rows that it gives."""

    def __init__(self, table: str):
        self.table, self.schema, self.forms = table, None, {}
        self.runs: dict[int, list] = {}  # id -> [form, first schema, number of schemas]

    def take(self, schema: int, forms: dict[int, _Form]) -> Iterator[dict]:
        """Fuses the next schema in; the changes, and the runs that have ended."""
        if self.schema is not None:
            for field, kind in _changes(self.forms, forms):
                yield {"kind": "change", "table_uuid": self.table, "schema_id": self.schema, "to_id": schema, "id": field, "change_kind": kind}
        yield from self.end({field for field, run in self.runs.items() if forms.get(field) != run[0]})
        for field, form in forms.items():
            self.runs.setdefault(field, [form, schema, 0])[2] += 1
        self.schema, self.forms = schema, forms

    def end(self, fields: set[int] | None = None) -> Iterator[dict]:
        for field in list(self.runs) if fields is None else fields:
            form, first, n = self.runs.pop(field)
            yield {"kind": "run", "table_uuid": self.table, "schema_id": first, "to_id": self.schema, "id": field, "name": form[0], "tag": form[1], "parent_id": form[2], "n": n}

    def edge(self, first: bool, last: bool) -> Iterator[dict]:
        for field, form in self.forms.items():
            yield {"kind": "edge", "table_uuid": self.table, "schema_id": self.schema, "id": field, "name": form[0], "tag": form[1], "parent_id": form[2], "is_first": first, "is_last": last}


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([(jsontext.texts if f.type == pa.string() else lambda v, t=f.type: pa.array(v, t))([r.get(f.name) for r in held]) for f in _WALKED_ARROW], schema=_WALKED_ARROW)

    for row in rows:
        held.append(row)
        if len(held) >= 20_000:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((table, schema), rows of the columns) of each schema of a sorted partition."""
    at, rows = None, []
    for batch in batches:
        for t, s, *rest in zip(*(batch[c].to_pylist() for c in ("table_uuid", "schema_id", *columns))):
            if at != (t, s):
                if at is not None:
                    yield at, rows
                at, rows = (t, s), []
            rows.append(tuple(rest))
    if at is not None:
        yield at, rows


def _fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        union, n, first = None, 0, False
        for (table, schema), fields in _groups(batches, ["id", "loaded_at", "name", "field_type"]):
            if union is not None and first and n == 1:
                yield from union.edge(True, False)
            if union is None or union.table != table:
                if union is not None:
                    yield from union.end()
                union = _Union(table)
            yield from union.take(schema, _forms(fields))
            n += 1
            first = n == 1
        if union is not None:
            yield from union.edge(n == 1, True)
            yield from union.end()

    return _batches(rows())


def _fuse_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changes from the last schema of a partition to the first of the next."""

    def rows() -> Iterator[dict]:
        before = None
        for (table, schema), fields in _groups(batches, ["id", "name", "tag", "parent_id", "is_first", "is_last"]):
            forms = {field: (name, tag, parent) for field, name, tag, parent, _, _ in fields}
            if before and before[0] == table and before[3] and fields[0][4]:
                for field, kind in _changes(before[2], forms):
                    yield {"kind": "change", "table_uuid": table, "schema_id": before[1], "to_id": schema, "id": field, "change_kind": kind}
            before = (table, schema, forms, fields[0][5])

    return _batches(rows())


def fuse(fields: DataFrame) -> DataFrame:
    """The union of each table's schemas in rows (_WALKED), written: runs of alternatives
    (cut where a partition ends), and the changes between neighbouring schemas.

    Rows without table_uuid, schema_id or id are no fields. Where some schema was sent
    so often that its rows would fill a task, the last rows are picked beforehand, by
    an aggregation that starts before the shuffle.
    """
    ship(fields.sparkSession)
    rows = _fields(fields)
    hot = rows.groupBy("table_uuid", "schema_id").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS).limit(1).count() > 0
    rows = latest_fields(fields) if hot else rows
    placed = rows.repartitionByRange("table_uuid", "schema_id").sortWithinPartitions("table_uuid", "schema_id", "id", "loaded_at", "name", "field_type")
    return materialize(placed.mapInArrow(_fuse, _WALKED), "union")


def changes(union: DataFrame) -> DataFrame:
    """(table_uuid, from_schema_id, to_schema_id, id, change_kind) of a union."""
    edges = union.filter(F.col("kind") == "edge").repartition("table_uuid").sortWithinPartitions("table_uuid", "schema_id", "id")
    found = union.filter(F.col("kind") == "change").unionByName(edges.mapInArrow(_fuse_edges, _WALKED))
    return found.select("table_uuid", F.col("schema_id").alias("from_schema_id"), F.col("to_id").alias("to_schema_id"), "id", "change_kind")


def schema_changes(fields: DataFrame) -> DataFrame:
    """Every change between consecutive schemas of each table.

    Names are compared exactly (null equals null); a table with one schema has no
    changes; an empty input gives no rows.
    """
    return changes(fuse(fields))


# ---------------------------------------------------------------- the consistent shape


def canonical_type(tags: str) -> Column:
    """The narrowest type that holds all alternatives in the array column tags: equal
    ones stay; int < long < decimal < double for numbers, date < timestamp; else string."""
    rule = """
        case when size({t}) = 0 then 'string'
             when size({t}) = 1 then {t}[0]
             when forall({t}, x -> x in ('int', 'long')) then 'long'
             when forall({t}, x -> x in ('float', 'double')) then 'double'
             when forall({t}, x -> x in ('int', 'long') or x like 'decimal%') then 'decimal'
             when forall({t}, x -> x in ('int', 'long', 'float', 'double') or x like 'decimal%') then 'double'
             when forall({t}, x -> x in ('date', 'timestamp')) then 'timestamp'
             else 'string' end
    """
    return F.expr(rule.format(t=tags))


def fused_schema(fields: DataFrame) -> DataFrame:
    """(table_uuid, id, parent_id, name, canonical_type, alternatives): the one
    consistent shape of each table, a row per field id at any depth.

    name is that of the last schema with the field; alternatives lists each form
    (name, tag) with its first and last schema and the number of schemas, by first
    schema. Runs are summed up before they are gathered, so that the list is bounded
    by the number of different forms.
    """
    runs = fuse(fields).filter(F.col("kind") == "run")
    forms = runs.groupBy("table_uuid", "id", "name", "tag").agg(F.min("schema_id").alias("first"), F.max("to_id").alias("last"), F.sum("n").alias("schemas"), F.max(F.struct("to_id", "parent_id")).alias("p"))
    union = forms.groupBy("table_uuid", "id").agg(
        F.max(F.struct("last", "p.parent_id", "name")).alias("now"),
        F.array_sort(F.collect_list(F.struct("first", "last", "name", "tag", "schemas"))).alias("alternatives"),
    )
    tags = union.withColumn("tags", F.array_sort(F.array_distinct(F.filter(F.col("alternatives.tag"), lambda x: x.isNotNull()))))
    return tags.select("table_uuid", "id", "now.parent_id", "now.name", canonical_type("tags").alias("canonical_type"), "alternatives")


def _json(value: Any) -> str:
    """Compact JSON text, keys sorted, numbers with all their digits."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_json(k)}:{_json(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json, value)) + "]"
    if isinstance(value, Decimal):
        text = str(value)
        if "." in text and "E" not in text:
            text = text.rstrip("0")
        return text + "0" if text.endswith(".") else text
    return json.dumps(value, ensure_ascii=False)


_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_CLOCK = re.compile(r"([0-9]{2}:[0-9]{2}:[0-9]{2})(?:\.([0-9]{1,6}))?")
_MOMENT = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?)(Z|[+-][0-9]{2}:?[0-9]{2})?")
_UUID = re.compile(r"([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})")
_EXACT = Context(prec=200)


def _number(text: str, tag: str, written: str | None) -> str | None:
    """A number in the canonical form of a type; None where the type doesn't hold it
    exactly (a double holds what was written as one)."""
    try:
        number = Decimal(text.strip())
    except InvalidOperation:
        return None
    if tag in ("float", "double"):
        short = repr(float(number))
        return short if written in ("float", "double") or not number.is_finite() or Decimal(short) == number else None
    if not number.is_finite() or not -200 < number.adjusted() < 40 or number.as_tuple().exponent < -200:
        return None
    if tag in ("int", "long"):
        bits = 31 if tag == "int" else 63
        return str(int(number)) if number == int(number) and -(1 << bits) <= number < 1 << bits else None
    if m := re.fullmatch(r"decimal\(([0-9]{1,3}),([0-9]{1,3})\)", tag):
        precision, scale = int(m[1]), int(m[2])
        if scale > 150 or (number and number.adjusted() >= precision - scale):
            return None
        fixed = number.quantize(Decimal(1).scaleb(-scale), context=_EXACT)
        return format(fixed, "f") if fixed == number else None
    return format(number.normalize(_EXACT), "f") if number else "0"


def _day(text: str) -> str | None:
    try:
        return dt.date.fromisoformat(text).isoformat() if _DATE.fullmatch(text) else None
    except ValueError:
        return None


def _clock(text: str) -> str | None:
    m = _CLOCK.fullmatch(text)
    if not m or m[1] >= "24" or m[1][3:5] >= "60" or m[1][6:] >= "60":
        return None
    part = (m[2] or "").rstrip("0")
    return f"{m[1]}.{part}" if part else m[1]


def _moment(text: str, zoned: bool) -> str | None:
    m = _MOMENT.fullmatch(text)
    if not m:
        return f"{_day(text)}T00:00:00" if not zoned and _day(text) else None
    day, clock = _day(m[1]), _clock(m[2])
    if day is None or clock is None or zoned != (m[3] is not None):
        return None
    if not zoned:
        return f"{day}T{clock}"
    try:
        at = dt.datetime.fromisoformat(f"{day}T{clock}{m[3]}").astimezone(dt.UTC)
    except (ValueError, OverflowError):
        return None
    return f"{at.date().isoformat()}T{_clock(at.time().isoformat())}Z"


def _canonical(value: Any, tag: str | None, written: str | None = None) -> tuple[str | None, bool]:
    """(text in canonical form, whether the value fits the type tag); written is the
    type it was written with. What doesn't fit, or only with a loss, stays as written."""
    if value is None:
        return None, True
    if isinstance(value, (dict, list)):
        return _json(value), tag in ("struct", "list", "map", "string", None)
    if isinstance(value, bool):
        return ("true" if value else "false"), tag in ("boolean", "string", None)
    text, form = str(value), None
    if tag is None or tag == "string" or tag == "binary" or tag.startswith("fixed"):
        return text, True
    if tag in ("int", "long", "float", "double") or tag.startswith("decimal"):
        form = _number(text, tag, written)
    elif not isinstance(value, str):
        return text, False
    elif tag == "boolean":
        form = text.strip().lower() if text.strip().lower() in ("true", "false") else None
    elif tag == "date":
        form = _day(text.strip())
    elif tag == "time":
        form = _clock(text.strip())
    elif tag in ("timestamp", "timestampz"):
        form = _moment(text.strip(), tag == "timestampz")
    elif tag == "uuid":
        form = "-".join(m.groups()) if (m := _UUID.fullmatch(text.strip().lower())) else None
    else:
        return text, tag not in NESTED
    return (text, False) if form is None else (form, True)


class _Node(NamedTuple):
    """A field as a schema writes it, with its place in the one shape. key is the
    written key, None where the schema lacks the field; out the key in the shape.
    inner: the fields of a struct, the element, or key and value, where None has no id."""

    id: int
    key: str | None
    out: str
    name: str | None
    branch: str | None
    canonical: str | None
    inner: tuple[_Node | None, ...] = ()


def _inner_nodes(kind: Any, parent: int, union: dict[int, dict[int, tuple]]) -> tuple[_Node | None, ...]:
    """The nodes under a type; union: by parent and id the present name, canonical type
    and last schema of all inner fields that the table ever had."""
    kind = opened(kind)
    ever, tag = union.get(parent, {}), type_tag(kind)

    def node(field: int, key: str | None, out: str, inside: Any) -> _Node:
        name, canonical, _ = ever[field]
        return _Node(field, key, out, name, type_tag(inside), canonical, _inner_nodes(inside, field, union))

    if not isinstance(kind, dict) or tag not in NESTED:
        return ()
    if tag == "list":
        field = as_int(get(kind, "element-id"))
        return (None if field is None else node(field, "", "", kind.get("element")),)
    if tag == "map":
        ids = [(as_int(get(kind, f"{part}-id")), kind.get(part)) for part in ("key", "value")]
        return tuple(None if field is None else node(field, "", "", inside) for field, inside in ids)
    outs: dict[int, str] = {}
    for field, (name, _, _) in sorted(ever.items(), key=lambda x: (-x[1][2], -x[0])):  # of equal names the last one's is plain
        out = name or ""
        outs[field] = out if out not in outs.values() else f"{out}#{field}"
    written = [node(field, name or "", outs[field], inside) for field, name, inside in children(kind)]
    there = {n.id for n in written}
    return (*written, *(_Node(i, None, outs[i], name, None, canonical) for i, (name, canonical, _) in sorted(ever.items()) if i not in there))


@lru_cache(maxsize=20_000)
def _columns(shape: str | None) -> tuple[list, list, list, list, list]:
    """ids, present names, branches, canonical types and nodes of a shape's JSON
    text, which all rows of a schema share; a field that the schema lacks has no
    written key in its node."""
    found = json.loads(shape) if shape else {}
    fields = found.get("fields", [])
    union: dict[int, dict[int, tuple]] = {}
    for f in found.get("inner") or ():
        union.setdefault(f["p"], {})[f["i"]] = (f.get("n"), f.get("c"), f["o"])
    nodes = []
    for f in fields:
        written = f.get("written_name", "") if f.get("written") else None
        nodes.append(_Node(f["id"], written, f.get("name") or "", f.get("name"), f.get("branch"), f.get("canonical_type"), _inner_nodes(f.get("kind"), f["id"], union)))
    return [f["id"] for f in fields], [f.get("name") for f in fields], [f.get("branch") for f in fields], [f.get("canonical_type") for f in fields], nodes


def _free(key: str, taken: dict) -> str:
    while key in taken:
        key += "#"
    return key


def _shaped(value: Any, node: _Node, path: tuple[str, ...], found: list[tuple]) -> tuple[str, str | None, bool]:
    """(JSON, text, whether it fits) of a value in the one shape; what is inside goes to found."""
    if value is None:
        return "null", None, True
    if not isinstance(value, (dict, list)):
        text, fits = _canonical(value, node.canonical, node.branch)
        if not fits or node.canonical is None:
            return _json(value), text, fits
        bare = node.canonical in ("int", "long", "boolean") or (node.canonical in ("float", "double") and Decimal(text).is_finite())
        return text if bare else _json(text), text, True
    if node.branch not in NESTED:
        text, fits = _canonical(value, node.canonical)
        return _json(text) if node.canonical == "string" else text, text, fits
    if isinstance(value, list) != (node.branch == "list"):
        return _json(value), _json(value), False
    pairs: dict[str, str] = {}
    if node.branch == "struct":
        for child in node.inner:
            pairs[child.out] = _visit(value, child.key, child, (*path, child.out), found)
        known = {child.key for child in node.inner}
        for key in sorted(value.keys() - known):
            out = _free(key, pairs)
            pairs[out] = _json(value[key])
            found.append(((*path, out), None, key, None, None, _canonical(value[key], None)[0], "unknown"))
    elif node.branch == "list":
        (element,) = node.inner or (None,)
        text = "[" + ",".join(_json(v) if element is None else _visit(value, i, element, (*path, str(i)), found) for i, v in enumerate(value)) + "]"
    else:
        name, inside = node.inner or (None, None)
        for key in sorted(value):
            text, fits = (key, True) if name is None else _canonical(key, name.canonical)
            out = _free(text, pairs)
            at = (*path, out)
            if name is not None:
                found.append((at, name.id, name.name, name.branch, name.canonical, text, "ok" if fits else "misfit"))
            pairs[out] = ""
            pairs[out] = _json(value[key]) if inside is None else _visit(value, key, inside, at, found)
    if node.branch != "list":
        text = "{" + ",".join(f"{_json(k)}:{v}" for k, v in sorted(pairs.items())) + "}"
    return _json(text) if node.canonical == "string" else text, text, node.canonical in (node.branch, "string", None)


def _visit(record: Any, key: Any, node: _Node, path: tuple[str, ...], found: list[tuple]) -> str:
    """JSON of an inner value, whose own entry goes to found before those inside it."""
    at = len(found)
    found.append(())
    if node.key is None or (isinstance(record, dict) and key not in record):
        out, text, state = "null", None, "absent" if node.key is None else "missing"
    else:
        out, text, fits = _shaped(record[key], node, path, found)
        state = "null" if record[key] is None else "ok" if fits else "misfit"
        if state == "ok" and node.canonical in NESTED:
            text = None
    found[at] = (path, node.id, node.name, node.branch, node.canonical, text, state)
    return out


def _unify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "name", "branch", "canonical_type", "value", "state"]
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))  # _shaped goes as deep as json reads
    for batch in batches:
        parts: tuple[list, ...] = ([], [], [], [])
        values, states, ends, rest = [], [], [0], []
        found: list[tuple] = []
        inner_ends = [0]
        for payload, shape in zip(batch["payload"].to_pylist(), batch["shape"].to_pylist()):
            *shared, nodes = _columns(shape)
            for whole, own in zip(parts, shared):
                whole.extend(own)
            own_values, own_states, own_found, own_rest = _row(payload, nodes)
            values.extend(own_values)
            states.extend(own_states)
            found.extend(own_found)
            rest.append(own_rest)
            ends.append(len(values))
            inner_ends.append(len(found))
        columns = [pa.array(parts[0], pa.int32()), *(jsontext.texts(x) for x in (*parts[1:], values, states))]
        fields = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))
        paths, ids, *others = zip(*found) if found else [()] * 7
        path_ends = np.cumsum([0, *map(len, paths)]).astype(np.int32)
        steps = pa.ListArray.from_arrays(pa.array(path_ends), jsontext.texts(x for p in paths for x in p))
        columns = [steps, pa.array(ids, pa.int32()), *(jsontext.texts(x) for x in others)]
        insides = pa.ListArray.from_arrays(pa.array(inner_ends, pa.int32()), pa.StructArray.from_arrays(columns, ["path", *names]))
        rest_ends = np.cumsum([0, *map(len, rest)]).astype(np.int32)
        others = pa.MapArray.from_arrays(pa.array(rest_ends), jsontext.texts(k for r in rest for k, _ in r), jsontext.texts(v for r in rest for _, v in r))
        yield pa.RecordBatch.from_arrays([batch["row_id"], batch["table_uuid"], batch["schema_id"], fields, insides, others], ["row_id", "table_uuid", "schema_id", "fields", "inner", "rest"])


def _row(payload: str | None, nodes: list[_Node]) -> tuple[list, list, list, list]:
    """(values, states, entries of what is inside, unknown keys) of a payload."""
    try:
        record = jsontext.read(payload, Decimal) if payload else {}
        if not isinstance(record, dict):
            raise ValueError("no object")
        values, states, found = [], [], []
        for node in nodes:
            text, state = None, "absent" if node.key is None else "missing"
            if node.key is not None and node.key in record:
                _, text, fits = _shaped(record[node.key], node, (node.out,), found)
                state = "null" if record[node.key] is None else "ok" if fits else "misfit"
            values.append(text)
            states.append(state)
        known = {node.key for node in nodes}
        return values, states, found, sorted((k, _canonical(v, None)[0]) for k, v in record.items() if k not in known)
    except (ValueError, RecursionError):
        return [None] * len(nodes), ["unreadable"] * len(nodes), [], []


def unify_rows(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """All rows of a table in one consistent shape: (row_id, table_uuid, schema_id,
    fields, inner, rest), fields with one entry per top-level field id that the
    table ever had, by id: its present name, the branch (the type the row was
    written with, null where its schema lacks the field), the canonical type,
    the value as text in canonical form, and its state: ok, null, missing (an
    optional key left out; so are all of a null or empty payload), absent (not in
    the row's schema), misfit (the canonical type doesn't hold it exactly; kept as
    written), unreadable (payload isn't a JSON object). Keys that the schema lacks, all of them where the schema itself is
    unknown, are kept with their values as text in rest.

    Structs, lists and maps are brought into the shape at any depth, by the ids
    inside the type they were written with, an id being matched under its parent's:
    the value is JSON in which a struct has all fields that it ever had in the
    table under their present names (of several with one name the last has it
    plain, others have #id behind it), numbers and booleans as such, decimals and
    all others as text, misfits as written, and keys that the schema lacks as they
    are (with # behind one that is taken). inner has an entry for each field,
    element, key and value inside, outer ones first: its path (present names,
    positions, keys), and the rest as in fields; value is null for nested ones that
    are in their parent's JSON, id for unknown keys, whose state is unknown.

    Schemas are joined by (table, schema) to the rows; a hot schema is split by
    Spark at run time. Each table's shape is bounded by its number of fields.
    """
    ship(rows.sparkSession)
    every = materialize(flatten_fields(latest_fields(fields), types=True).withColumn("ord", F.col("schema_id")), "fields")
    flat = every.filter(F.col("parent_id").isNull())
    per_id = flat.groupBy(F.col("table_uuid").alias("ut"), F.col("id").alias("uid")).agg(F.max(F.struct("ord", "name")).alias("now"), F.array_sort(F.collect_set("tag")).alias("tags"))
    per_id = per_id.select("ut", "uid", F.col("now.name").alias("now_name"), canonical_type("tags").alias("canonical_type"))
    per_table = per_id.groupBy("ut").agg(F.array_sort(F.collect_list(F.struct("uid", "now_name", "canonical_type"))).alias("all_fields"))
    per_inner = every.filter(F.col("parent_id").isNotNull()).groupBy(F.col("table_uuid").alias("ut"), F.col("parent_id").alias("p"), F.col("id").alias("i")).agg(F.max(F.struct("ord", "loaded_at", "name")).alias("now"), F.array_sort(F.collect_set("tag")).alias("tags"))
    per_inner = per_inner.select("ut", F.struct("p", "i", F.col("now.name").alias("n"), canonical_type("tags").alias("c"), F.col("now.ord").alias("o")).alias("f"))
    per_table = per_table.join(per_inner.groupBy(F.col("ut").alias("it")).agg(F.array_sort(F.collect_list("f")).alias("all_inner")), F.col("ut") == F.col("it"), "left")
    per_schema = flat.groupBy("table_uuid", "schema_id").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("name", "tag", F.when(F.contains("field_type", F.lit("{")), F.col("field_type")).alias("kind"))))).alias("written"))
    shape = F.expr("transform(all_fields, f -> named_struct('id', f.uid, 'name', f.now_name, 'branch', written[f.uid].tag, 'canonical_type', f.canonical_type, 'written', written[f.uid] is not null, 'written_name', written[f.uid].name, 'kind', written[f.uid].kind))")
    shapes = per_schema.join(per_table, F.col("table_uuid") == F.col("ut")).select(F.col("table_uuid").alias("st"), F.col("schema_id").alias("ss"), F.to_json(F.struct(shape.alias("fields"), F.col("all_inner").alias("inner"))).alias("shape"))
    joined = exact(rows, "row_id", "table_uuid", "schema_id", "payload").select("row_id", "table_uuid", F.col("schema_id").cast("int").alias("schema_id"), "payload").join(shapes, (F.col("table_uuid") == F.col("st")) & (F.col("schema_id") == F.col("ss")), "left")
    kind = "row_id bigint, table_uuid string, schema_id int, fields array<struct<id int, name string, branch string, canonical_type string, value string, state string>>, inner array<struct<path array<string>, id int, name string, branch string, canonical_type string, value string, state string>>, rest map<string,string>"
    return joined.select("row_id", "table_uuid", "schema_id", "payload", "shape").mapInArrow(_unify, kind)
