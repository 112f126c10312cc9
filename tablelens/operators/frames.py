"""Table metadata as DataFrames.

One function turns a document into the rows of a table; the driver, the bulk
reader and the data source all go by it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablelens import jsontext
from tablelens import model as M
from tablelens.codec import CodecError, body_text, dumps, dumps_type, loads_type, parse_table_metadata
from tablelens.operators.fieldtree import as_int, get, opened, type_tag
from tablelens.shared import ship
from tablelens.types import Primitive, UnsupportedTypeError, primitive_to_spark
from tablelens.validate import validate

#: The columns of each table.
TABLES = {
    "tables": "table_uuid string, location string, last_sequence_number bigint, last_updated_ms bigint, last_column_id int, current_schema_id int, default_spec_id int, last_partition_id int, current_snapshot_id bigint, default_sort_order_id bigint",
    "fields": "table_uuid string, schema_id int, path string, id int, required boolean, field_type string, doc string",
    "identifiers": "table_uuid string, schema_id int, field_id int",
    "name_mappings": "table_uuid string, schema_id int, path string, field_id int, name string, priority int",
    "partitions": "table_uuid string, spec_id int, pos int, source_id int, field_id int, name string, transform string",
    "sort_fields": "table_uuid string, order_id int, pos int, source_id int, transform string, direction string, null_order string",
    "snapshots": "table_uuid string, snapshot_id bigint, parent_snapshot_id bigint, sequence_number bigint, timestamp_ms bigint, manifest_list string, operation string, summary map<string,string>, schema_id bigint",
    "refs": "table_uuid string, ref_name string, snapshot_id bigint, ref_type string, min_snapshots_to_keep int, max_snapshot_age_ms bigint, max_ref_age_ms bigint",
    "properties": "table_uuid string, key string, value string",
    "metadata_log": "table_uuid string, pos int, metadata_file string, timestamp_ms bigint",
    "snapshot_log": "table_uuid string, pos int, snapshot_id bigint, timestamp_ms bigint",
}


def _mapping_rows(mappings: tuple[M.NameMapping, ...], path: str = "") -> Iterator[tuple[str, int | None, str, int]]:
    stack = [(path, m) for m in reversed(mappings)]
    while stack:
        above, m = stack.pop()
        for priority, name in enumerate(m.names):
            yield above, m.field_id, name, priority
        inner = f"{above}.{m.names[0]}".lstrip(".") if m.names else above
        stack.extend((inner, x) for x in reversed(m.fields or ()))


def rows_of(md: M.TableMetadata, table: str) -> Iterator[tuple]:
    """The rows that a document has in a table of TABLES."""
    u = md.table_uuid
    if table == "tables":
        yield u, md.location, md.last_sequence_number, md.last_updated_ms, md.last_column_id, md.current_schema_id, md.default_spec_id, md.last_partition_id, md.current_snapshot_id, md.default_sort_order_id
    elif table == "fields":
        for s in md.schemas:
            for path, fid, required, kind, doc in M.walk_fields(s):
                yield u, s.schema_id, ".".join(path), fid, required, str(kind) if isinstance(kind, Primitive) else dumps_type(kind), doc
    elif table == "identifiers":
        yield from ((u, s.schema_id, i) for s in md.schemas for i in s.identifier_field_ids or ())
    elif table == "name_mappings":
        yield from ((u, s.schema_id, *row) for s in md.schemas if s.name_mapping for row in _mapping_rows(s.name_mapping.default))
    elif table == "partitions":
        yield from ((u, s.spec_id, pos, f.source_id, f.field_id, f.name, str(f.transform)) for s in md.partition_specs for pos, f in enumerate(s.fields))
    elif table == "sort_fields":
        yield from ((u, o.order_id, pos, f.source_id, str(f.transform), f.direction, f.null_order) for o in md.sort_orders for pos, f in enumerate(o.fields))
    elif table == "snapshots":
        yield from ((u, s.snapshot_id, s.parent_snapshot_id, s.sequence_number, s.timestamp_ms, s.manifest_list, s.summary.operation, s.summary.other, s.schema_id) for s in md.snapshots or ())
    elif table == "refs":
        yield from ((u, name, r.snapshot_id, r.retention.kind, r.retention.min_snapshots_to_keep, r.retention.max_snapshot_age_ms, r.retention.max_ref_age_ms) for name, r in resolved_refs(md).items())
    elif table == "properties":
        yield from ((u, k, v) for k, v in (md.properties or {}).items())
    elif table == "metadata_log":
        yield from ((u, pos, e.metadata_file, e.timestamp_ms) for pos, e in enumerate(md.metadata_log or ()))
    elif table == "snapshot_log":
        yield from ((u, pos, e.snapshot_id, e.timestamp_ms) for pos, e in enumerate(md.snapshot_log or ()))
    else:
        raise ValueError(f"unknown table {table!r}; one of {', '.join(TABLES)}")


def resolved_refs(md: M.TableMetadata) -> dict[str, M.Reference]:
    """The refs of a document; where it has none, main is the current snapshot."""
    if md.refs is None and md.current_snapshot_id is not None:
        return {"main": M.Reference(md.current_snapshot_id, M.Retention("branch", None))}
    return md.refs or {}


def frame(spark: SparkSession, md: M.TableMetadata, table: str) -> DataFrame:
    """A table of one document."""
    return spark.createDataFrame(list(rows_of(md, table)), TABLES[table])


# ---------------------------------------------------------------- in bulk


def parse_documents(docs: DataFrame, key: str, body: str, dialect: str = "reference") -> DataFrame:
    """(key, table_uuid, error, text): each body read by the strict codec and
    written again; error tells why one is rejected. Null is rejected as no JSON."""
    ship(docs.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["body"].to_pylist():
                try:
                    md = parse_table_metadata(body_text(text), dialect)
                    rows.append((md.table_uuid, None, dumps(md, dialect)))
                except CodecError as e:
                    rows.append((None, str(e), None))
            columns = list(zip(*rows)) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["key"], *(jsontext.texts(c) for c in columns)], ["key", "table_uuid", "error", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(body).alias("body")).mapInArrow(parse, f"key {kind}, table_uuid string, error string, text string").withColumnRenamed("key", key)


def tables_of(docs: DataFrame, body: str, table: str, dialect: str = "reference") -> DataFrame:
    """A table of all documents in a column of bodies; rejected bodies have no rows."""
    ship(docs.sparkSession)
    schema = T.StructType.fromDDL(TABLES[table])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[Any, ...]] = []
            for text in batch["body"].to_pylist():
                try:
                    rows.extend(rows_of(parse_table_metadata(body_text(text), dialect), table))
                except CodecError:
                    continue
            columns = list(zip(*rows)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([jsontext.texts(c) if f.type == pa.string() else pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(F.col(body).alias("body")).mapInArrow(read, schema)


def format_version(text: str) -> Any:
    """The format-version of a document, which its model does not keep: 2 where it is
    tagged by type name, a number given as text as such, None where there is none."""
    found = json.loads(text).get("format-version")
    if found == "TableMetadataV2":
        return 2
    number = as_int(found)
    return found if number is None else number


def violations_of(docs: DataFrame, key: str, body: str, dialect: str = "reference") -> DataFrame:
    """(key, code, detail): what validate() reports of each body that is a document."""
    ship(docs.sparkSession)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, text in enumerate(batch["body"].to_pylist()):
                try:
                    whole = body_text(text)
                    found = validate(parse_table_metadata(whole, dialect), format_version(whole))
                except CodecError:
                    continue
                take.extend([i] * len(found))
                rows.extend((v.code, v.detail) for v in found)
            columns = list(zip(*rows)) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(take, pa.int64())), *(jsontext.texts(c) for c in columns)], ["key", "code", "detail"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(body).alias("body")).mapInArrow(check, f"key {kind}, code string, detail string").withColumnRenamed("key", key)


# ---------------------------------------------------------------- schemas


def to_spark_type(kind: M.FieldType) -> T.DataType:
    """The Spark type of a type. Ids and docs of inner struct fields are kept in
    their metadata; those of elements, keys and values by to_spark_schema."""
    if isinstance(kind, Primitive):
        return primitive_to_spark(kind)
    if isinstance(kind, M.Struct):
        return T.StructType([_spark_field(f) for f in kind.fields])
    if isinstance(kind, M.ListType):
        return T.ArrayType(to_spark_type(kind.element), not kind.element_required)
    if isinstance(kind.key, M.MapType):
        raise UnsupportedTypeError("Spark builds no map with maps as keys")
    return T.MapType(to_spark_type(kind.key), to_spark_type(kind.value), not kind.value_required)


def _respelled(value: Any) -> Any:
    """A type as schema rows write it, in the spelling that the codec reads. A part
    without required is optional."""
    value, kind = opened(value), type_tag(value)
    if not isinstance(value, dict):
        return kind
    if kind == "struct":
        fields = value.get("fields")
        if not isinstance(fields, list) or not all(isinstance(f, dict) for f in fields):
            return None
        parts = [(f, get(f, "field-type")) for f in fields]
        return {"type": "struct", "fields": [{"id": as_int(f.get("id")), "name": f.get("name"), "required": bool(f.get("required")), "field_type": _respelled(f.get("type") if t is None else t)} for f, t in parts]}
    if kind == "list":
        return {"type": "list", "element-id": as_int(get(value, "element-id")), "element-required": bool(get(value, "element-required")), "element": _respelled(value.get("element"))}
    if kind == "map":
        return {"type": "map", "key-id": as_int(get(value, "key-id")), "key": _respelled(value.get("key")), "value-id": as_int(get(value, "value-id")), "value-required": bool(get(value, "value-required")), "value": _respelled(value.get("value"))}
    return None


@lru_cache(maxsize=50_000)
def spark_type_of(text: str) -> str | None:
    """The name of the Spark type of a type's text, nested ones too; None where there is none."""
    try:
        return to_spark_type(loads_type(json.dumps(_respelled(text)))).simpleString()
    except (CodecError, UnsupportedTypeError, RecursionError):
        return None


def spark_types(fields: DataFrame) -> DataFrame:
    """(table_uuid, schema_id, id, name, spark_type) of fields with their field_type."""
    ship(fields.sparkSession)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["table_uuid", "schema_id", "id", "name"]
        for batch in batches:
            kinds = [None if t is None else spark_type_of(t) for t in batch["field_type"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(kinds, pa.string())], [*names, "spark_type"])

    return fields.select("table_uuid", "schema_id", "id", "name", "field_type").mapInArrow(convert, "table_uuid string, schema_id int, id int, name string, spark_type string")


def _inner_ids(kind: M.FieldType, path: str = "") -> dict[str, int]:
    """Ids of elements, keys and values under a field, by their path in it; struct
    fields hold their own."""
    out: dict[str, int] = {}
    if isinstance(kind, M.ListType):
        parts = [("element", kind.element_id, kind.element)]
    elif isinstance(kind, M.MapType):
        parts = [("key", kind.key_id, kind.key), ("value", kind.value_id, kind.value)]
    else:
        return out
    for name, number, inner in parts:
        at = f"{path}.{name}".lstrip(".")
        out[at] = number
        out |= _inner_ids(inner, at)
    return out


def _spark_field(f: M.StructField) -> T.StructField:
    meta: dict[str, Any] = {"id": f.id}
    if f.doc is not None:
        meta["comment"] = f.doc
    if isinstance(f.field_type, Primitive):
        if f.field_type.name == "fixed":
            meta["length"] = f.field_type.args[0]
        if f.field_type.name in ("time", "uuid", "timestampz", "fixed"):
            meta["type"] = str(f.field_type)
    elif inner := _inner_ids(f.field_type):
        meta["inner_ids"] = inner
    return T.StructField(f.name, to_spark_type(f.field_type), not f.required, meta)


def to_spark_schema(schema: M.Schema) -> T.StructType:
    """The StructType of a schema: required fields are not nullable, ids and docs
    are kept as metadata, which Parquet files of Spark keep too."""
    return T.StructType([_spark_field(f) for f in schema.fields])


def _nullable(value: Column, whole: Column) -> Column:
    return F.when(whole.isNotNull(), value)


def _by_id(value: Column, written: M.FieldType, wanted: M.FieldType) -> Column:
    """A value written with one type in the form of another: the fields of structs are
    found by id at any depth; elements, keys and values are those of their list or map."""
    if isinstance(written, M.Struct) and isinstance(wanted, M.Struct):
        return _nullable(F.struct(*_fields_by_id(value.getField, written.fields, wanted.fields)), value)
    if isinstance(written, M.ListType) and isinstance(wanted, M.ListType):
        return F.transform(value, lambda x: _by_id(x, written.element, wanted.element))
    if isinstance(written, M.MapType) and isinstance(wanted, M.MapType):
        keyed = F.transform_keys(value, lambda k, _: _by_id(k, written.key, wanted.key))
        return F.transform_values(keyed, lambda _, v: _by_id(v, written.value, wanted.value))
    return value.cast(to_spark_type(wanted))


def _fields_by_id(get_field: Callable[[str], Column], written: tuple[M.StructField, ...], wanted: tuple[M.StructField, ...]) -> list[Column]:
    there = {f.id: f for f in written}
    out: list[Column] = []
    for f in wanted:
        if f.id in there:
            out.append(_by_id(get_field(there[f.id].name), there[f.id].field_type, f.field_type).alias(f.name))
        elif f.required:
            raise ValueError(f"required field {f.name} ({f.id}) was not written")
        else:
            out.append(F.lit(None).cast(to_spark_type(f.field_type)).alias(f.name))
    return out


def project_by_id(df: DataFrame, written: M.Schema, wanted: M.Schema) -> DataFrame:
    """df, written with one schema, in the form of another: columns, and fields
    inside them at any depth, are found by id, so that renames, reorderings and widened types come out right. A field
    that df lacks is null; a required one that it lacks is an error."""
    return df.select(*_fields_by_id(lambda name: F.col(f"`{name}`"), written.fields, wanted.fields))


def _by_name(value: Column, has: T.DataType, wanted: M.FieldType, mappings: tuple[M.NameMapping, ...]) -> Column:
    """A value of a type without ids in the form of another; mappings: those inside the field's."""
    inner = {m.field_id: m.fields or () for m in mappings if m.field_id is not None}
    if isinstance(has, T.StructType) and isinstance(wanted, M.Struct):
        return _nullable(F.struct(*_fields_by_name(value.getField, has, wanted.fields, mappings)), value)
    if isinstance(has, T.ArrayType) and isinstance(wanted, M.ListType):
        return F.transform(value, lambda x: _by_name(x, has.elementType, wanted.element, inner.get(wanted.element_id, ())))
    if isinstance(has, T.MapType) and isinstance(wanted, M.MapType):
        keyed = F.transform_keys(value, lambda k, _: _by_name(k, has.keyType, wanted.key, inner.get(wanted.key_id, ())))
        return F.transform_values(keyed, lambda _, v: _by_name(v, has.valueType, wanted.value, inner.get(wanted.value_id, ())))
    return value.cast(to_spark_type(wanted))


def _fields_by_name(get_field: Callable[[str], Column], has: T.StructType, wanted: tuple[M.StructField, ...], mappings: tuple[M.NameMapping, ...]) -> list[Column]:
    by_id = {m.field_id: m for m in mappings if m.field_id is not None}
    kinds = {f.name: f.dataType for f in has.fields}
    out: list[Column] = []
    for f in wanted:
        mapping = by_id.get(f.id)
        found = next((n for n in (mapping.names if mapping else ()) if n in kinds), None)
        value = F.lit(None).cast(to_spark_type(f.field_type)) if found is None else _by_name(get_field(found), kinds[found], f.field_type, mapping.fields or ())
        out.append(value.alias(f.name))
    return out


def map_names(df: DataFrame, mappings: M.NameMappings, schema: M.Schema) -> DataFrame:
    """df, whose files hold no field ids, with its columns named as in the schema:
    each field takes the first of its mapped names that df has, and fields inside
    it likewise by the mappings inside its own. Fields of the schema without such a
    column are null; unmapped columns are left out."""
    return df.select(*_fields_by_name(lambda name: F.col(f"`{name}`"), df.schema, schema.fields, mappings.default))


def identifier_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """The identifiers that more than one row has, with their number of rows."""
    return df.groupBy(*columns).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def required_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls) of columns that may not be null; one pass, no shuffle of rows."""
    counts = df.agg(*(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in columns))).alias("r")).select("r.column", "r.nulls")


# ---------------------------------------------------------------- checks by a schema


def schema_duplicates(df: DataFrame, schema: M.Schema) -> DataFrame:
    """identifier_duplicates() by the identifier fields of a schema, which are top-level
    fields; none, or one that the schema lacks, is an error."""
    names = {f.id: f.name for f in schema.fields}
    ids = schema.identifier_field_ids or ()
    if not ids or not set(ids) <= set(names):
        raise ValueError(f"schema {schema.schema_id} has no identifier fields of its own")
    return identifier_duplicates(df, [names[i] for i in ids])


_Rule = tuple[str, Callable[[Column], Column]]


def _rules(kind: M.FieldType, path: str) -> Iterator[_Rule]:
    """What must not be null inside a value: (path, whether it is in some value)."""
    if isinstance(kind, M.Struct):
        for f in kind.fields:
            at = f"{path}.{f.name}"
            if f.required:
                yield at, lambda v, n=f.name: v.isNotNull() & v.getField(n).isNull()
            yield from ((p, lambda v, n=f.name, r=rule: r(v.getField(n))) for p, rule in _rules(f.field_type, at))
    elif isinstance(kind, M.ListType):
        if kind.element_required:
            yield f"{path}.element", lambda v: F.exists(v, lambda x: x.isNull())
        yield from ((p, lambda v, r=rule: F.exists(v, lambda x: r(x))) for p, rule in _rules(kind.element, f"{path}.element"))
    elif isinstance(kind, M.MapType):
        if kind.value_required:
            yield f"{path}.value", lambda v: F.exists(F.map_values(v), lambda x: x.isNull())
        yield from ((p, lambda v, r=rule: F.exists(F.map_keys(v), lambda x: r(x))) for p, rule in _rules(kind.key, f"{path}.key"))
        yield from ((p, lambda v, r=rule: F.exists(F.map_values(v), lambda x: r(x))) for p, rule in _rules(kind.value, f"{path}.value"))


def required_violations(df: DataFrame, schema: M.Schema) -> DataFrame:
    """(path, nulls): of each required field, element and map value of a schema, at any
    depth, the number of rows in which it is null somewhere while what holds it is not.
    One pass, no shuffle of rows."""
    found = [(f.name, F.col(f"`{f.name}`").isNull()) for f in schema.fields if f.required]
    found += [(p, rule(F.col(f"`{f.name}`"))) for f in schema.fields for p, rule in _rules(f.field_type, f.name)]
    if not found:
        return df.sparkSession.createDataFrame([], "path string, nulls bigint")
    counts = df.agg(*(F.count(F.when(c, 1)).alias(f"n{i}") for i, (_, c) in enumerate(found)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.col(f"n{i}").alias("nulls")) for i, (p, _) in enumerate(found)))).alias("r")).select("r.path", "r.nulls")
