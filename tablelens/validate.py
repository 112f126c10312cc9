"""Invariants of a table's metadata, reported and never a parse error."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from tablelens import model as M


@dataclass(frozen=True)
class Violation:
    code: str
    detail: str


def validate(md: M.TableMetadata, format_version: int | None = None) -> list[Violation]:
    """All violations of a document, in the order of the checks below."""
    out: list[Violation] = []

    def check(good: bool, code: str, detail: str) -> None:
        if not good:
            out.append(Violation(code, detail))

    if format_version is not None:
        check(format_version == 2, "format-version", f"{format_version} is not 2")
    schemas = {s.schema_id for s in md.schemas}
    check(md.current_schema_id in schemas, "current-schema-id", f"no schema {md.current_schema_id}")
    check(md.default_spec_id in {s.spec_id for s in md.partition_specs}, "default-spec-id", f"no partition spec {md.default_spec_id}")
    check(md.default_sort_order_id in {0, *(o.order_id for o in md.sort_orders)}, "default-sort-order-id", f"no sort order {md.default_sort_order_id}")
    snapshots = {s.snapshot_id for s in md.snapshots or ()}
    if md.current_snapshot_id not in (None, -1):
        check(md.current_snapshot_id in snapshots, "current-snapshot-id", f"no snapshot {md.current_snapshot_id}")
    main = (md.refs or {}).get("main")
    if main is not None:
        check(main.snapshot_id == md.current_snapshot_id, "main", f"main is {main.snapshot_id}, current is {md.current_snapshot_id}")
    for name, ref in sorted((md.refs or {}).items()):
        check(ref.snapshot_id in snapshots, "ref", f"{name}: no snapshot {ref.snapshot_id}")
        r = ref.retention
        for limit in (r.min_snapshots_to_keep, r.max_snapshot_age_ms, r.max_ref_age_ms):
            check(limit is None or limit > 0, "retention", f"{name}: {limit} is not positive")
    known: set[int] = set()
    for s in md.schemas:
        ids = Counter(fid for _, fid, *_ in M.walk_fields(s))
        known |= set(ids)
        for fid, n in sorted(ids.items()):
            check(n == 1, "field-id", f"schema {s.schema_id}: {fid} is used {n} times")
        for fid in s.identifier_field_ids or ():
            check(fid in ids, "identifier-field-id", f"schema {s.schema_id}: no field {fid}")
    check(md.last_column_id >= max(known, default=0), "last-column-id", f"{md.last_column_id} is below field {max(known, default=0)}")
    fields = [(spec.spec_id, f) for spec in md.partition_specs for f in spec.fields]
    highest = max((f.field_id for _, f in fields), default=0)
    check(md.last_partition_id >= highest, "last-partition-id", f"{md.last_partition_id} is below partition field {highest}")
    meanings: dict[int, tuple[int, str]] = {}
    for spec_id, f in fields:
        check(f.source_id in known, "partition-source-id", f"spec {spec_id}: {f.name} has no source field {f.source_id}")
        meaning = (f.source_id, str(f.transform))
        check(meanings.setdefault(f.field_id, meaning) == meaning, "partition-field-id", f"spec {spec_id}: {f.field_id} stands for two fields")
    for order in md.sort_orders:
        for f in order.fields:
            check(f.source_id in known, "sort-source-id", f"order {order.order_id}: no source field {f.source_id}")
    for n, count in sorted(Counter(s.snapshot_id for s in md.snapshots or ()).items()):
        check(count == 1, "snapshot-id", f"{n} is used {count} times")
    newest = max((s.sequence_number for s in md.snapshots or ()), default=0)
    check(md.last_sequence_number >= newest, "last-sequence-number", f"{md.last_sequence_number} is below {newest}")
    for s in md.snapshots or ():
        check(s.schema_id is None or s.schema_id in schemas, "snapshot-schema-id", f"snapshot {s.snapshot_id}: no schema {s.schema_id}")
    return out
