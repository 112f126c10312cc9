"""Strict, round-trip-safe JSON for the model.

Each document type is described once, as a table of its keys; one reader and
one writer go by these tables. The ``reference`` dialect reads and writes the
documents of the reference as they are; ``spec`` also reads the published
spelling (field key ``type``, ``timestamptz``, retention numbers left out), and
writes it. Both read again what they write.

Read: unknown keys are ignored, a missing or null optional key is None, a
missing required key, a repeated known key, a number out of its range, and a
value of another kind are errors; so is nesting of more than ``DEEPEST`` levels,
where the JSON reader of the reference stops too. In maps the last of repeated
keys holds. Whatever is wrong with a text, the error is a CodecError.
Versions and references between ids are not checked here; see ``validate``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from tablelens import model as M
from tablelens.types import I32, I64, U32, Primitive, TypeTextError, parse_primitive, whole, within

DIALECTS = ("reference", "spec")
#: Levels of objects and lists that a document may nest (fixed value).
DEEPEST = 127
_UUID = re.compile(r"(?:urn:uuid:)?([0-9a-fA-F]{8})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{12})")
_HYPHENS = (0, 4)
_PARAMETER = {"bucket": re.compile(r"bucket\[([0-9]+)\]"), "truncate": re.compile(r"truncate\[([0-9]+)\]")}
#: Transforms without a parameter, operations, directions and null orders (fixed values).
TRANSFORMS = ("void", "identity", "year", "month", "day", "hour")
OPERATIONS = ("append", "replace", "overwrite", "delete")
DIRECTIONS = ("asc", "desc")
NULL_ORDERS = ("nulls-first", "nulls-last")


class CodecError(ValueError):
    """A document that isn't one; path tells where."""

    def __init__(self, path: str, message: str):
        super().__init__(f"{path or 'document'}: {message}")
        self.path, self.message = path, message


class _Object(list):
    """A JSON object as its (key, value) pairs, so that repeated keys are seen."""

    def last(self) -> dict[str, Any]:
        return dict(self)


def _load(text: str) -> Any:
    def refuse(name: str) -> Any:
        raise CodecError("", f"{name} is no JSON")

    try:
        return json.loads(text, object_pairs_hook=_Object, parse_constant=refuse)
    except CodecError:
        raise
    except (ValueError, RecursionError) as e:  # numbers of over 4300 digits are a ValueError
        raise CodecError("", f"not JSON: {e}"[:200]) from e


def body_text(text: str | None) -> str:
    """A document's text without the byte order mark that it may begin with; null is empty."""
    return "" if text is None else text.removeprefix("\ufeff")


# ---------------------------------------------------------------- kinds of values


@dataclass(frozen=True)
class Kind:
    """How a value is read (value, path, dialect) and written (value, dialect)."""

    read: Callable[[Any, str, str], Any]
    write: Callable[[Any, str], Any]


def _keep(value: Any, dialect: str) -> Any:
    return value


def _integer(bounds: tuple[int, int]) -> Kind:
    def read(value: Any, path: str, dialect: str) -> int:
        if type(value) is not int or not within(value, bounds):
            raise CodecError(path, f"{_short(value)} is no integer from {bounds[0]} to {bounds[1]}")
        return value

    return Kind(read, _keep)


def _plain(python: type, name: str) -> Kind:
    def read(value: Any, path: str, dialect: str) -> Any:
        if type(value) is not python:
            raise CodecError(path, f"{_short(value)} is no {name}")
        return value

    return Kind(read, _keep)


def _short(value: Any) -> str:
    return repr(value)[:60]


def _one_of(values: tuple[str, ...]) -> Kind:
    def read(value: Any, path: str, dialect: str) -> str:
        if not isinstance(value, str) or value not in values:
            raise CodecError(path, f"{_short(value)} is none of {', '.join(values)}")
        return value

    return Kind(read, _keep)


def _list_of(kind: Kind) -> Kind:
    def read(value: Any, path: str, dialect: str) -> tuple:
        if isinstance(value, _Object) or not isinstance(value, list):
            raise CodecError(path, f"{_short(value)} is no list")
        return tuple(kind.read(x, f"{path}[{i}]", dialect) for i, x in enumerate(value))

    return Kind(read, lambda value, dialect: [kind.write(x, dialect) for x in value])


def _map_of(kind: Kind) -> Kind:
    def read(value: Any, path: str, dialect: str) -> dict:
        if not isinstance(value, _Object):
            raise CodecError(path, f"{_short(value)} is no object")
        return {k: kind.read(x, f"{path}.{k}", dialect) for k, x in value.last().items()}

    return Kind(read, lambda value, dialect: {k: kind.write(x, dialect) for k, x in value.items()})


def _read_uuid(value: Any, path: str, dialect: str) -> str:
    m = _UUID.fullmatch(value) if isinstance(value, str) else None
    if not m or value.removeprefix("urn:uuid:").count("-") not in _HYPHENS or (value.startswith("urn:") and "-" not in value):
        raise CodecError(path, f"{_short(value)} is no uuid")
    return "-".join(m.groups()).lower()


def _read_transform(value: Any, path: str, dialect: str) -> M.Transform:
    if isinstance(value, str):
        if value in TRANSFORMS:
            return M.Transform(value)
        for name, pattern in _PARAMETER.items():
            if (m := pattern.fullmatch(value)) and within(whole(m[1]), U32):
                return M.Transform(name, whole(m[1]))
    raise CodecError(path, f"{_short(value)} is no transform")


INT, LONG, TEXT, BOOL = _integer(I32), _integer(I64), _plain(str, "text"), _plain(bool, "boolean")
UUID = Kind(_read_uuid, _keep)
TRANSFORM = Kind(_read_transform, lambda t, dialect: str(t))


# ---------------------------------------------------------------- documents


@dataclass(frozen=True)
class Key:
    """A key of a document: attribute, JSON key, kind; other keys it may have in
    the spec dialect; what the spec dialect makes optional."""

    attr: str
    kind: Kind
    json: str = ""
    required: bool = True
    spec_json: str = ""
    spec_optional: bool = False

    def name(self, dialect: str) -> str:
        return (self.spec_json if dialect == "spec" else "") or self.json or self.attr.replace("_", "-")

    def names(self, dialect: str) -> tuple[str, ...]:
        plain = self.json or self.attr.replace("_", "-")
        return (plain, self.spec_json) if dialect == "spec" and self.spec_json else (plain,)


def _take(pairs: _Object, key: Key, path: str, dialect: str) -> Any:
    names = key.names(dialect)
    found = [v for k, v in pairs if k in names]
    if len(found) > 1:
        raise CodecError(path, f"{names[0]} is given {len(found)} times")
    if key.required and not (key.spec_optional and dialect == "spec"):
        if not found:
            raise CodecError(path, f"{names[0]} is missing")
        return key.kind.read(found[0], f"{path}.{names[0]}".lstrip("."), dialect)
    return None if not found or found[0] is None else key.kind.read(found[0], f"{path}.{names[0]}".lstrip("."), dialect)


@dataclass(frozen=True)
class Document:
    """A document type: its class and keys, and the tag that is written first:
    (key, value in the reference dialect, value in the spec dialect, or None)."""

    cls: type
    keys: tuple[Key, ...]
    tag: tuple[str, Any, Any] | None = None

    def read(self, value: Any, path: str, dialect: str) -> Any:
        if not isinstance(value, _Object):
            raise CodecError(path, f"{_short(value)} is no object")
        return self.cls(**{k.attr: _take(value, k, path, dialect) for k in self.keys})

    def lacks(self, keys: set[str], dialect: str) -> list[str]:
        """The required keys that an object with these keys doesn't have."""
        return [k.names(dialect)[0] for k in self.keys if k.required and not (k.spec_optional and dialect == "spec") and not keys & set(k.names(dialect))]

    def write(self, value: Any, dialect: str) -> dict[str, Any]:
        out: dict[str, Any] = {}
        if self.tag and (tag := self.tag[2 if dialect == "spec" else 1]) is not None:
            out[self.tag[0]] = tag
        for k in self.keys:
            v = getattr(value, k.attr)
            if v is not None:
                out[k.name(dialect)] = k.kind.write(v, dialect)
            elif dialect == "reference":
                out[k.name(dialect)] = None
        return out

    def kind(self) -> Kind:
        return Kind(self.read, self.write)


def _read_type(value: Any, path: str, dialect: str) -> M.FieldType:
    if isinstance(value, str):
        try:
            return parse_primitive(value, dialect)
        except TypeTextError as e:
            raise CodecError(path, str(e)) from e
    if isinstance(value, _Object):
        _check_depth(path)
        keys = {k for k, _ in value}
        error = None
        for document in (STRUCT, LIST, MAP):  # the first that reads it holds; each part is read once
            if not document.lacks(keys, dialect):
                try:
                    return document.read(value, path, dialect)
                except CodecError as e:
                    error = error or e
        if error is None:
            meant = LIST if "element-id" in keys else MAP if "key-id" in keys else STRUCT
            error = CodecError(path, f"{meant.lacks(keys, dialect)[0]} is missing")
        raise error
    raise CodecError(path, f"{_short(value)} is no type")


def _check_depth(path: str) -> None:
    """Each step of a path is one level of nesting."""
    if path.count(".") + path.count("[") + 2 > DEEPEST:
        raise CodecError(path[:60], f"more than {DEEPEST} levels")


def _write_type(value: M.FieldType, dialect: str) -> Any:
    if isinstance(value, Primitive):
        return "timestamptz" if dialect == "spec" and value.name == "timestampz" else str(value)
    return {M.Struct: STRUCT, M.ListType: LIST, M.MapType: MAP}[type(value)].write(value, dialect)


TYPE = Kind(_read_type, _write_type)
FIELD = Document(M.StructField, (Key("id", INT), Key("name", TEXT), Key("required", BOOL), Key("field_type", TYPE, json="field_type", spec_json="type"), Key("doc", TEXT, required=False)))
STRUCT = Document(M.Struct, (Key("fields", _list_of(FIELD.kind())),), ("type", "Struct", "struct"))
LIST = Document(M.ListType, (Key("element_id", INT), Key("element_required", BOOL), Key("element", TYPE)), ("list", "List", None))
MAP = Document(M.MapType, (Key("key_id", INT), Key("key", TYPE), Key("value_id", INT), Key("value_required", BOOL), Key("value", TYPE)), ("type", "Map", "map"))


def _read_mapping(value: Any, path: str, dialect: str) -> M.NameMapping:
    _check_depth(path)
    return NAME_MAPPING.read(value, path, dialect)


NAME_MAPPING = Document(M.NameMapping, (Key("field_id", INT, required=False), Key("names", _list_of(TEXT)), Key("fields", _list_of(Kind(_read_mapping, lambda v, d: NAME_MAPPING.write(v, d))), required=False)))
NAME_MAPPINGS = Document(M.NameMappings, (Key("default", _list_of(NAME_MAPPING.kind())),))
SCHEMA = Document(
    M.Schema,
    (Key("schema_id", INT), Key("identifier_field_ids", _list_of(INT), required=False), Key("name_mapping", NAME_MAPPINGS.kind(), required=False), Key("fields", _list_of(FIELD.kind()))),
    ("type", "Struct", "struct"),
)
PARTITION_FIELD = Document(M.PartitionField, (Key("source_id", INT), Key("field_id", INT), Key("name", TEXT), Key("transform", TRANSFORM)))
PARTITION_SPEC = Document(M.PartitionSpec, (Key("spec_id", INT), Key("fields", _list_of(PARTITION_FIELD.kind()))))
SORT_FIELD = Document(M.SortField, (Key("source_id", INT), Key("transform", TRANSFORM), Key("direction", _one_of(DIRECTIONS)), Key("null_order", _one_of(NULL_ORDERS))))
SORT_ORDER = Document(M.SortOrder, (Key("order_id", INT), Key("fields", _list_of(SORT_FIELD.kind()))))


def _read_summary(value: Any, path: str, dialect: str) -> M.Summary:
    if not isinstance(value, _Object):
        raise CodecError(path, f"{_short(value)} is no object")
    operation = _take(value, Key("operation", _one_of(OPERATIONS), required=False), path, dialect)
    other = _map_of(TEXT).read(_Object((k, v) for k, v in value if k != "operation"), path, dialect)
    return M.Summary(operation, other)


def _write_summary(value: M.Summary, dialect: str) -> dict[str, Any]:
    own = {} if value.operation is None and dialect == "spec" else {"operation": value.operation}
    return own | value.other


SUMMARY = Kind(_read_summary, _write_summary)
SNAPSHOT = Document(
    M.Snapshot,
    (Key("snapshot_id", LONG), Key("parent_snapshot_id", LONG, required=False), Key("sequence_number", LONG), Key("timestamp_ms", LONG), Key("manifest_list", TEXT), Key("summary", SUMMARY), Key("schema_id", LONG, required=False)),
)
_RETENTION = {
    "branch": (Key("min_snapshots_to_keep", INT, spec_optional=True), Key("max_snapshot_age_ms", LONG, spec_optional=True), Key("max_ref_age_ms", LONG, spec_optional=True)),
    "tag": (Key("max_ref_age_ms", LONG, spec_optional=True),),
}


def _read_retention(value: Any, path: str, dialect: str) -> M.Retention:
    if not isinstance(value, _Object):
        raise CodecError(path, f"{_short(value)} is no object")
    kind = _take(value, Key("type", _one_of(tuple(_RETENTION))), path, dialect)
    return M.Retention(kind, **{k.attr: _take(value, k, path, dialect) for k in _RETENTION[kind]})


def _write_retention(value: M.Retention, dialect: str) -> dict[str, Any]:
    return {"type": value.kind} | {k.name(dialect): v for k in _RETENTION[value.kind] if (v := getattr(value, k.attr)) is not None}


RETENTION = Kind(_read_retention, _write_retention)
REFERENCE = Kind(
    lambda value, path, dialect: M.Reference(_take(_need_object(value, path), Key("snapshot_id", LONG), path, dialect), _read_retention(value, path, dialect)),
    lambda value, dialect: {"snapshot-id": value.snapshot_id} | _write_retention(value.retention, dialect),
)


def _need_object(value: Any, path: str) -> _Object:
    if not isinstance(value, _Object):
        raise CodecError(path, f"{_short(value)} is no object")
    return value


METADATA_LOG = Document(M.MetadataLogEntry, (Key("metadata_file", TEXT), Key("timestamp_ms", LONG)))
SNAPSHOT_LOG = Document(M.SnapshotLogEntry, (Key("snapshot_id", LONG), Key("timestamp_ms", LONG)))
TABLE_METADATA = Document(
    M.TableMetadata,
    (
        Key("table_uuid", UUID), Key("location", TEXT), Key("last_sequence_number", LONG), Key("last_updated_ms", LONG), Key("last_column_id", INT),
        Key("schemas", _list_of(SCHEMA.kind())), Key("current_schema_id", INT), Key("partition_specs", _list_of(PARTITION_SPEC.kind())), Key("default_spec_id", INT),
        Key("last_partition_id", INT), Key("properties", _map_of(TEXT), required=False), Key("current_snapshot_id", LONG, required=False),
        Key("snapshots", _list_of(SNAPSHOT.kind()), required=False), Key("snapshot_log", _list_of(SNAPSHOT_LOG.kind()), required=False),
        Key("metadata_log", _list_of(METADATA_LOG.kind()), required=False), Key("sort_orders", _list_of(SORT_ORDER.kind())), Key("default_sort_order_id", LONG),
        Key("refs", _map_of(REFERENCE), required=False),
    ),
    ("format-version", "TableMetadataV2", 2),
)

#: Every document by the class it is read to.
KINDS: dict[type, Kind] = {
    d.cls: d.kind() for d in (TABLE_METADATA, METADATA_LOG, SNAPSHOT_LOG, FIELD, STRUCT, LIST, MAP, NAME_MAPPING, NAME_MAPPINGS, SCHEMA, PARTITION_FIELD, PARTITION_SPEC, SORT_FIELD, SORT_ORDER, SNAPSHOT)
} | {Primitive: TYPE, M.Transform: TRANSFORM, M.Summary: SUMMARY, M.Retention: RETENTION, M.Reference: REFERENCE}


def loads(cls: type, text: str, dialect: str = "reference") -> Any:
    """The document of class cls that a JSON text holds; CodecError if it holds none."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    return KINDS[cls].read(_load(text), "", dialect)


def dumps(value: Any, dialect: str = "reference") -> str:
    """The JSON text of a document. Types are written as the values of a field's type."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    return json.dumps(KINDS[type(value)].write(value, dialect), ensure_ascii=False)


def loads_type(text: str, dialect: str = "reference") -> M.FieldType:
    """A type from its JSON value: a name in quotes, or an object."""
    return TYPE.read(_load(text), "", dialect)


def dumps_type(value: M.FieldType, dialect: str = "reference") -> str:
    return json.dumps(TYPE.write(value, dialect), ensure_ascii=False)


def parse_table_metadata(text: str, dialect: str = "reference") -> M.TableMetadata:
    return loads(M.TableMetadata, text, dialect)
