"""Table metadata, version 2, as values: frozen, compared by content."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from tablelens.types import Primitive


@dataclass(frozen=True)
class StructField:
    id: int
    name: str
    required: bool
    field_type: FieldType
    doc: str | None = None


@dataclass(frozen=True)
class Struct:
    fields: tuple[StructField, ...]


@dataclass(frozen=True)
class ListType:
    element_id: int
    element_required: bool
    element: FieldType


@dataclass(frozen=True)
class MapType:
    key_id: int
    key: FieldType
    value_id: int
    value_required: bool
    value: FieldType


FieldType = Primitive | Struct | ListType | MapType


@dataclass(frozen=True)
class NameMapping:
    names: tuple[str, ...]
    field_id: int | None = None
    fields: tuple[NameMapping, ...] | None = None


@dataclass(frozen=True)
class NameMappings:
    default: tuple[NameMapping, ...]


@dataclass(frozen=True)
class Schema:
    schema_id: int
    fields: tuple[StructField, ...]
    identifier_field_ids: tuple[int, ...] | None = None
    name_mapping: NameMappings | None = None


@dataclass(frozen=True)
class Transform:
    """A partition transform: its name, and the parameter of bucket and truncate."""

    name: str
    arg: int | None = None

    def __str__(self) -> str:
        return self.name if self.arg is None else f"{self.name}[{self.arg}]"


@dataclass(frozen=True)
class PartitionField:
    source_id: int
    field_id: int
    name: str
    transform: Transform


@dataclass(frozen=True)
class PartitionSpec:
    spec_id: int
    fields: tuple[PartitionField, ...]


@dataclass(frozen=True)
class SortField:
    source_id: int
    transform: Transform
    direction: str
    null_order: str


@dataclass(frozen=True)
class SortOrder:
    order_id: int
    fields: tuple[SortField, ...]


@dataclass(frozen=True)
class Summary:
    operation: str | None = None
    other: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: int
    sequence_number: int
    timestamp_ms: int
    manifest_list: str
    summary: Summary
    parent_snapshot_id: int | None = None
    schema_id: int | None = None


@dataclass(frozen=True)
class Retention:
    """kind is branch or tag; a tag only has max_ref_age_ms."""

    kind: str
    max_ref_age_ms: int | None
    min_snapshots_to_keep: int | None = None
    max_snapshot_age_ms: int | None = None


@dataclass(frozen=True)
class Reference:
    snapshot_id: int
    retention: Retention


@dataclass(frozen=True)
class MetadataLogEntry:
    metadata_file: str
    timestamp_ms: int


@dataclass(frozen=True)
class SnapshotLogEntry:
    snapshot_id: int
    timestamp_ms: int


@dataclass(frozen=True)
class TableMetadata:
    table_uuid: str
    location: str
    last_sequence_number: int
    last_updated_ms: int
    last_column_id: int
    schemas: tuple[Schema, ...]
    current_schema_id: int
    partition_specs: tuple[PartitionSpec, ...]
    default_spec_id: int
    last_partition_id: int
    sort_orders: tuple[SortOrder, ...]
    default_sort_order_id: int
    properties: dict[str, str] | None = None
    current_snapshot_id: int | None = None
    snapshots: tuple[Snapshot, ...] | None = None
    snapshot_log: tuple[SnapshotLogEntry, ...] | None = None
    metadata_log: tuple[MetadataLogEntry, ...] | None = None
    refs: dict[str, Reference] | None = None

    def current_schema(self) -> Schema | None:
        return next((s for s in self.schemas if s.schema_id == self.current_schema_id), None)

    def default_spec(self) -> PartitionSpec | None:
        return next((s for s in self.partition_specs if s.spec_id == self.default_spec_id), None)


def walk_fields(kind: Any, path: tuple[str, ...] = ()):
    """(path, id, required, type, doc) of all fields of a type, depth first."""
    stack = [(path, kind)]
    while stack:
        at, node = stack.pop()
        inner: list[tuple[tuple[str, ...], int, bool, FieldType, str | None]] = []
        if isinstance(node, (Struct, Schema)):
            inner = [((*at, f.name), f.id, f.required, f.field_type, f.doc) for f in node.fields]
        elif isinstance(node, ListType):
            inner = [((*at, "element"), node.element_id, node.element_required, node.element, None)]
        elif isinstance(node, MapType):
            inner = [((*at, "key"), node.key_id, True, node.key, None), ((*at, "value"), node.value_id, node.value_required, node.value, None)]
        yield from inner
        stack.extend((p, t) for p, _, _, t, _ in reversed(inner) if not isinstance(t, Primitive))
