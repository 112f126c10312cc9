"""Queries of the metadata operators over the test tables, and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens import model as M
from tablelens.codec import parse_table_metadata
from tablelens.functions.ordering import sort_columns
from tablelens.functions.transforms import apply_transform, parse_transform_columns, with_partition_columns
from tablelens.model import NameMapping, NameMappings, PartitionField, PartitionSpec, Schema, SortField, SortOrder, StructField, Transform
from tablelens.operators import drift, frames, timeline
from tablelens.plans import codec_sql
from tablelens.plans.core_queries import _DEEP, _P1, table
from tablelens.plans.pruning import And, Compare, In, Not, prune
from tablelens.shared import stored_once, with_position
from tablelens.types import Primitive, spark_type_column, type_columns

NOW_MS = 1_735_689_600_000  # 2025-01-01
AS_OF_MS = 1_704_067_200_000  # 2024-01-01

#: Metadata of the events table, as a document of the reference dialect.
EVENTS_METADATA = """
{"format-version": 2, "table-uuid": "3f2a9c54-7d1e-4b60-9a86-51c7e0d4b2f8", "location": "wh://local/events",
 "last-sequence-number": 1, "last-updated-ms": 1704067200000, "last-column-id": 6,
 "schemas": [{"schema-id": 0, "type": "struct", "fields": [
   {"id": 1, "name": "event_id", "required": true, "field_type": "long"},
   {"id": 2, "name": "ts", "required": true, "field_type": "timestamp"},
   {"id": 3, "name": "user_id", "required": false, "field_type": "long"},
   {"id": 4, "name": "event_type", "required": false, "field_type": "string"},
   {"id": 5, "name": "value", "required": false, "field_type": "double"},
   {"id": 6, "name": "props", "required": false, "field_type": "string"}]}],
 "current-schema-id": 0,
 "partition-specs": [{"spec-id": 0, "fields": [
   {"source-id": 2, "field-id": 1000, "name": "ts_day", "transform": "day"}]},
  {"spec-id": 1, "fields": [
   {"source-id": 2, "field-id": 1001, "name": "ts_month", "transform": "month"},
   {"source-id": 3, "field-id": 1002, "name": "user_bucket", "transform": "bucket[8]"},
   {"source-id": 4, "field-id": 1003, "name": "type_part", "transform": "truncate[4]"}]}],
 "default-spec-id": 0, "last-partition-id": 1003, "sort-orders": [], "default-sort-order-id": 0}
"""


def _events_metadata():
    return parse_table_metadata(EVENTS_METADATA)


def events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and value per partition of the table's default spec."""
    md = _events_metadata()
    parts = with_partition_columns(table(spark, sf_dir, "events").select("ts", "value"), md.current_schema(), md.default_spec())
    return parts.groupBy("ts_day").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 2).alias("total_value"))


def partition_tuple_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    md = _events_metadata()
    spec = md.partition_specs[1]
    parts = with_partition_columns(table(spark, sf_dir, "events").select("ts", "user_id", "event_type"), md.current_schema(), spec)
    return parts.groupBy(*(f.name for f in spec.fields)).agg(F.count("*").alias("rows"))


def _partitioned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a table partitioned by day. It is written once for each state of
    their files; days with many rows are split over several tasks."""
    md = _events_metadata()
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    parts = with_partition_columns(events, md.current_schema(), md.default_spec())
    return spark.read.schema(parts.schema).parquet(stored_once(parts, "events", "ts_day"))


def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of a table that is partitioned by day; the scan lists those only."""
    md = _events_metadata()
    wanted = And((Compare("ts", ">=", dt.datetime(2024, 1, 10, 6)), Compare("ts", "<", dt.datetime(2024, 1, 12, 18, 30))))
    return prune(_partitioned_events(spark, sf_dir), wanted, md.default_spec(), md.current_schema()).select("event_id", "ts", "value")


def pruned_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by price, a decimal, through the partition values of a truncate and a bucket."""
    schema = Schema(0, (StructField(1, "price", True, Primitive("decimal", (14, 2))), StructField(2, "o_custkey", True, Primitive("long"))))
    spec = PartitionSpec(0, (PartitionField(1, 1000, "price_step", Transform("truncate", 5_000_000)), PartitionField(2, 1001, "cust_bucket", Transform("bucket", 32))))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    wanted = And((Compare("price", "<=", 250_000), Compare("price", ">", Decimal("100000.5")), Not(In("o_custkey", (1, 2, 3)))))
    return prune(with_partition_columns(orders, schema, spec), wanted, spec, schema).select("o_orderkey", "price")


def _transform(name: str, source: str, key: str, column: str, arg: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        value = apply_transform(Transform(name, arg), F.col(column), df.schema[column].dataType)
        return df.select(key, value.alias("part"))

    return query


def type_to_spark(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "schema_fields").select("field_type").distinct()
    columns = type_columns(F.col("field_type"))
    return kinds.select("field_type", *(c.alias(n) for n, c in columns.items()), spark_type_column(F.col("field_type")).alias("spark_type"))


def parse_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "partition_fields").select("transform").distinct()
    name, arg = parse_transform_columns(F.col("transform"))
    return texts.select("transform", name.alias("name"), arg.alias("arg"))


def schema_to_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Spark type of each top-level field of a plain type, by schema; those of
    structs, lists and maps, which SQL cannot say, are in schema_to_struct_nested."""
    fields = drift.latest_fields(table(spark, sf_dir, "schema_fields"))
    kind = F.regexp_replace(F.lower(F.regexp_replace("field_type", r"\s", "")), "^timestamptz$", "timestampz")
    return fields.filter(~F.contains("field_type", F.lit("{"))).select("table_uuid", "schema_id", "id", "name", spark_type_column(kind).alias("spark_type"))


def schema_to_struct_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Spark type of each top-level field that is a struct, list or map."""
    fields = drift.latest_fields(table(spark, sf_dir, "schema_fields"))
    return frames.spark_types(fields.filter(F.contains("field_type", F.lit("{"))))


def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = drift.flatten_fields(drift.latest_fields(table(spark, sf_dir, "schema_fields")))
    return flat.select("table_uuid", "schema_id", F.col("id").cast("bigint").alias("id"), "name", "tag")


def current_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.current_schemas(table(spark, sf_dir, "table_metadata"), table(spark, sf_dir, "schema_fields"))
    return found.select("table_uuid", "schema_id", "id", "name", "field_type")


def schema_at_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.schemas_at_snapshots(table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "table_metadata"), table(spark, sf_dir, "schema_fields"))


def _renamed_events() -> Schema:
    kinds = {"event_id": (1, "long"), "happened": (2, "timestamp"), "kind": (4, "string"), "amount": (5, "double"), "note": (7, "string")}
    return Schema(1, tuple(StructField(i, n, n == "event_id", Primitive(k)) for n, (i, k) in kinds.items()))


def project_by_field_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.project_by_id(table(spark, sf_dir, "events"), _events_metadata().current_schema(), _renamed_events())


def name_mapping_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {1: ("id", "event_id"), 2: ("happened", "time", "ts"), 4: ("event_type", "type"), 5: ("value",), 7: ("comment",)}
    mappings = NameMappings(tuple(NameMapping(n, i) for i, n in names.items()))
    return frames.map_names(table(spark, sf_dir, "events"), mappings, _renamed_events())


_TEXTS = M.MapType(91, Primitive("string"), 92, True, Primitive("string"))
_LOG = M.ListType(93, True, M.Struct((StructField(94, "metadata_file", True, Primitive("string")), StructField(95, "timestamp_ms", True, Primitive("long")))))
#: What rows of snapshots and of table_metadata should hold.
_SNAPSHOTS = Schema(
    0,
    tuple(StructField(i, n, True, k) for i, (n, k) in enumerate([("table_uuid", Primitive("string")), ("snapshot_id", Primitive("long")), ("parent_snapshot_id", Primitive("long")), ("operation", Primitive("string")), ("summary", _TEXTS), ("schema_id", Primitive("long")), ("loaded_at", Primitive("timestamp"))])),
    identifier_field_ids=(0, 1),
)
_METADATA = Schema(0, (StructField(1, "table_uuid", True, Primitive("string")), StructField(2, "metadata_file", True, Primitive("string")), StructField(3, "properties", False, _TEXTS), StructField(4, "metadata_log", True, _LOG)))
#: The same with other names and another order inside, and a field that is not written yet.
_METADATA_NOW = Schema(
    1,
    (
        StructField(2, "file", True, Primitive("string")), StructField(1, "table_uuid", True, Primitive("string")),
        StructField(4, "log", False, M.ListType(93, False, M.Struct((StructField(96, "size", False, Primitive("long")), StructField(95, "at", False, Primitive("long")), StructField(94, "name", False, Primitive("string")))))),
    ),
)


def _log_entries(projected: DataFrame) -> DataFrame:
    return projected.select("table_uuid", "file", F.posexplode("log").alias("pos", "e")).select("table_uuid", "file", "pos", "e.size", "e.at", "e.name")


def project_nested_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries inside metadata rows, renamed and reordered by field id."""
    return _log_entries(frames.project_by_id(table(spark, sf_dir, "table_metadata"), _METADATA, _METADATA_NOW))


def name_mapping_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for files without field ids, by inner mappings."""
    inner = (NameMapping(("entry_time", "timestamp_ms"), 95), NameMapping(("metadata_file",), 94))
    mappings = NameMappings((NameMapping(("metadata_file",), 2), NameMapping(("table_uuid",), 1), NameMapping(("metadata_log",), 4, (NameMapping(("element",), 93, inner),))))
    return _log_entries(frames.map_names(table(spark, sf_dir, "table_metadata"), mappings, _METADATA_NOW))


def identifier_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.schema_duplicates(table(spark, sf_dir, "snapshots"), _SNAPSHOTS)


def required_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.required_violations(table(spark, sf_dir, "snapshots"), _SNAPSHOTS)


def required_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.required_violations(table(spark, sf_dir, "table_metadata"), _METADATA)


def sort_order_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders numbered in the total order of a sort order, with the values that it compares."""
    schema = Schema(0, (StructField(1, "o_custkey", True, Primitive("long")), StructField(2, "o_orderdate", True, Primitive("timestamp")), StructField(3, "o_orderkey", True, Primitive("long"))))
    fields = (SortField(1, Transform("bucket", 16), "asc", "nulls-first"), SortField(2, Transform("month"), "desc", "nulls-last"), SortField(3, Transform("identity"), "asc", "nulls-last"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    bucket = apply_transform(Transform("bucket", 16), F.col("o_custkey"), df.schema["o_custkey"].dataType)
    month = apply_transform(Transform("month"), F.col("o_orderdate"), df.schema["o_orderdate"].dataType)
    return with_position(df, sort_columns(SortOrder(1, fields), schema, df)).select(bucket.alias("cust_bucket"), month.alias("order_month"), "o_orderkey", "position")


def sort_order_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots, which lack parents, operations and schemas here and there, numbered in
    the order of a sort order with each direction and null order."""
    schema = Schema(0, tuple(StructField(i, n, False, Primitive(k)) for i, (n, k) in enumerate([("table_uuid", "string"), ("snapshot_id", "long"), ("schema_id", "long"), ("operation", "string"), ("parent_snapshot_id", "long")])))
    fields = [(2, "identity", "desc", "nulls-first"), (3, "identity", "asc", "nulls-last"), (4, "identity", "desc", "nulls-last"), (0, "identity", "asc", "nulls-first"), (1, "identity", "asc", "nulls-first")]
    df = timeline.latest_snapshots(table(spark, sf_dir, "snapshots"), "schema_id", "operation", "parent_snapshot_id")
    order = SortOrder(1, tuple(SortField(i, Transform(t), d, n) for i, t, d, n in fields))
    return with_position(df, sort_columns(order, schema, df)).select("table_uuid", "snapshot_id", "position")


_SNAPSHOT_COLUMNS = ["table_uuid", "snapshot_id", "parent_snapshot_id", "sequence_number", "timestamp_ms", "manifest_list", "operation", "schema_id"]


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.latest_snapshots(table(spark, sf_dir, "snapshots"), *_SNAPSHOT_COLUMNS)


def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.summary_entries(table(spark, sf_dir, "snapshots"))


def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.summed(table(spark, sf_dir, "snapshots"), "added-records")


def snapshots_by_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.by_operation(table(spark, sf_dir, "snapshots").select("table_uuid", "snapshot_id", "operation", "timestamp_ms"), ["append", "delete"])


def current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.current_snapshots(table(spark, sf_dir, "table_metadata"), table(spark, sf_dir, "snapshots"), *_SNAPSHOT_COLUMNS)


def _lineage(spark: SparkSession, sf_dir: str, cyclic: bool) -> DataFrame:
    starts = timeline.current_snapshots(table(spark, sf_dir, "table_metadata"), table(spark, sf_dir, "snapshots"), "timestamp_ms").select("table_uuid", "snapshot_id")
    return timeline.ancestors(table(spark, sf_dir, "snapshots"), starts, cyclic)


def snapshot_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its SQL, without current snapshots on or below a cycle; snapshot_lineage_whole has them."""
    return _lineage(spark, sf_dir, False)


def snapshot_lineage_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineage(spark, sf_dir, True)


def snapshot_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.in_sequence(table(spark, sf_dir, "snapshots"))


def as_of_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.as_of(table(spark, sf_dir, "table_metadata"), AS_OF_MS)


def as_of_snapshot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.as_of_log(timeline.snapshot_log(table(spark, sf_dir, "table_metadata")), AS_OF_MS)


def snapshot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.snapshot_log(table(spark, sf_dir, "table_metadata"))


def resolve_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.resolve_refs(table(spark, sf_dir, "table_metadata"), table(spark, sf_dir, "refs"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.live_refs(table(spark, sf_dir, "refs"), table(spark, sf_dir, "snapshots"), NOW_MS)
    return found.select("table_uuid", "ref_name", "snapshot_id", "ref_type", "min_snapshots_to_keep", "max_snapshot_age_ms", "max_ref_age_ms", "expired")


def expire_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As its SQL, where a branch on or below a cycle keeps its own snapshot only;
    expire_candidates_whole applies its limits too."""
    return timeline.expire_candidates(table(spark, sf_dir, "refs"), table(spark, sf_dir, "snapshots"), NOW_MS, cyclic=False)


def expire_candidates_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.expire_candidates(table(spark, sf_dir, "refs"), table(spark, sf_dir, "snapshots"), NOW_MS)


def metadata_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.metadata_log(table(spark, sf_dir, "table_metadata"), keep=5)


def table_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.table_properties(table(spark, sf_dir, "table_metadata"))


def _parse(dialect: str, errors: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """Which bodies the strict codec takes in a dialect; with errors, why it rejects others."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = frames.parse_documents(table(spark, sf_dir, "metadata_docs"), "meta_id", "body", dialect)
        return found.filter(F.col("error").isNotNull()).select("meta_id", "error") if errors else found.select("meta_id", F.col("error").isNull().alias("accepted"), "table_uuid")

    return query


def _round_trip(dialect: str) -> Callable[[SparkSession, str], DataFrame]:
    """Each body that is taken, written and read again: the same text both times."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        first = frames.parse_documents(table(spark, sf_dir, "metadata_docs"), "meta_id", "body", dialect).filter(F.col("error").isNull()).select("meta_id", F.col("text").alias("once"))
        second = frames.parse_documents(first, "meta_id", "once", dialect).select(F.col("meta_id").alias("again_id"), F.col("text").alias("twice"))
        return first.join(second, F.col("meta_id") == F.col("again_id")).select("meta_id", F.col("once").eqNullSafe(F.col("twice")).alias("same"))

    return query


def validate_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.violations_of(table(spark, sf_dir, "metadata_docs"), "meta_id", "body", "spec")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "events_by_day": events_by_day,
    "parse_table_metadata": _parse("spec"),
    "parse_table_metadata_strict": _parse("reference"),
    "parse_errors": _parse("spec", errors=True),
    "roundtrip_table_metadata": _round_trip("spec"),
    "roundtrip_table_metadata_strict": _round_trip("reference"),
    "validate_metadata": validate_metadata,
    "type_to_spark": type_to_spark,
    "parse_transforms": parse_transforms,
    "schema_to_struct": schema_to_struct,
    "schema_to_struct_nested": schema_to_struct_nested,
    "schema_fields": schema_fields,
    "current_schema": current_schema,
    "schema_at_snapshot": schema_at_snapshot,
    "project_by_field_id": project_by_field_id,
    "name_mapping_resolve": name_mapping_resolve,
    "project_nested_by_id": project_nested_by_id,
    "name_mapping_nested": name_mapping_nested,
    "identifier_uniqueness": identifier_uniqueness,
    "required_nulls": required_nulls,
    "required_nested": required_nested,
    "transform_void": _transform("void", "orders", "o_orderkey", "o_orderpriority"),
    "transform_identity": _transform("identity", "orders", "o_orderkey", "o_orderpriority"),
    "transform_year": _transform("year", "orders", "o_orderkey", "o_orderdate"),
    "transform_month": _transform("month", "orders", "o_orderkey", "o_orderdate"),
    "transform_day": _transform("day", "orders", "o_orderkey", "o_orderdate"),
    "transform_hour": _transform("hour", "events", "event_id", "ts"),
    "transform_bucket": _transform("bucket", "orders", "o_orderkey", "o_custkey", 16),
    "transform_bucket_time": _transform("bucket", "events", "event_id", "ts", 32),
    "transform_bucket_string": _transform("bucket", "part", "p_partkey", "p_name", 16),
    "transform_truncate_int": _transform("truncate", "orders", "o_orderkey", "o_custkey", 10),
    "transform_truncate_string": _transform("truncate", "part", "p_partkey", "p_name", 3),
    "partition_tuple_counts": partition_tuple_counts,
    "pruned_scan": pruned_scan,
    "pruned_decimal": pruned_decimal,
    "sort_order_apply": sort_order_apply,
    "sort_order_nulls": sort_order_nulls,
    "snapshots": snapshots,
    "snapshot_summary": snapshot_summary,
    "summary_totals": summary_totals,
    "snapshots_by_operation": snapshots_by_operation,
    "current_snapshot": current_snapshot,
    "snapshot_lineage": snapshot_lineage,
    "snapshot_lineage_whole": snapshot_lineage_whole,
    "snapshot_sequence": snapshot_sequence,
    "as_of_timestamp": as_of_timestamp,
    "as_of_snapshot_log": as_of_snapshot_log,
    "snapshot_log": snapshot_log,
    "resolve_ref": resolve_ref,
    "refs": refs,
    "expire_candidates": expire_candidates,
    "expire_candidates_whole": expire_candidates_whole,
    "metadata_log": metadata_log,
    "table_properties": table_properties,
}

# ---------------------------------------------------------------- SQL


def _bucket_sql(source: str, key: str, value: str, n: int, more: str = "") -> str:
    """Murmur3 of a bigint in plain SQL, step by step."""
    two32 = "4294967296"
    mul = lambda x, c: f"(({x})::HUGEINT * {c} % {two32})::BIGINT"
    rot = lambda x, left, low, high: f"(({x})::HUGEINT * {low} % {two32})::BIGINT + ({x}) // {high}"
    return f"""
WITH b0 AS (SELECT {key}{more}, {value} AS v, CASE WHEN {value} < 0 THEN {value}::HUGEINT + 18446744073709551616 ELSE {value}::HUGEINT END AS u FROM {source}),
b1 AS (SELECT *, {mul(f"(u % {two32})", 3432918353)} AS lo, {mul(f"(u // {two32})", 3432918353)} AS hi FROM b0),
b2 AS (SELECT * REPLACE ({rot("lo", 15, 32768, 131072)} AS lo, {rot("hi", 15, 32768, 131072)} AS hi) FROM b1),
b3 AS (SELECT * REPLACE ({mul("lo", 461845907)} AS lo, {mul("hi", 461845907)} AS hi) FROM b2),
b4 AS (SELECT *, {rot("lo", 13, 8192, 524288)} AS h FROM b3),
b5 AS (SELECT * REPLACE (xor(((h * 5 + 3864292196) % {two32})::BIGINT, hi) AS h) FROM b4),
b6 AS (SELECT * REPLACE ({rot("h", 13, 8192, 524288)} AS h) FROM b5),
b7 AS (SELECT * REPLACE (xor(((h * 5 + 3864292196) % {two32})::BIGINT, 8::BIGINT) AS h) FROM b6),
b8 AS (SELECT * REPLACE (xor(h, h // 65536) AS h) FROM b7),
b9 AS (SELECT * REPLACE ({mul("h", 2246822507)} AS h) FROM b8),
b10 AS (SELECT * REPLACE (xor(h, h // 8192) AS h) FROM b9),
b11 AS (SELECT * REPLACE ({mul("h", 3266489909)} AS h) FROM b10),
b12 AS (SELECT *, CASE WHEN v IS NOT NULL THEN ((xor(h, h // 65536) % 2147483648) % {n})::INTEGER END AS bucket FROM b11)
"""


def _bucket_text_sql(source: str, key: str, value: str, n: int) -> str:
    """Murmur3 of a text's bytes in plain SQL: words by list functions, the rest step by step."""
    two32, digits = "4294967296", "'0123456789ABCDEF'"
    mul = lambda x, c: f"(({x})::HUGEINT * {c} % {two32})::BIGINT"
    rot = lambda x, low, high: f"(({x})::HUGEINT * {low} % {two32})::BIGINT + ({x}) // {high}"
    mixed = f"list_transform(list_transform(list_transform({{}}, lambda k: {mul('k', 3432918353)}), lambda k: {rot('k', 32768, 131072)}), lambda k: {mul('k', 461845907)})"
    return f"""
WITH t0 AS (SELECT {key}, {value} AS v, hex(encode({value})) AS x FROM {source}),
t1 AS (SELECT *, length(x) // 2 AS n, list_transform(range(0, length(x) // 2), lambda i: (strpos({digits}, substr(x, 2 * i + 1, 1)) - 1) * 16 + strpos({digits}, substr(x, 2 * i + 2, 1)) - 1) AS b FROM t0),
t2 AS (SELECT *, n % 4 AS r, list_transform(range(0, n // 4), lambda i: (b[4 * i + 1] + b[4 * i + 2] * 256 + b[4 * i + 3] * 65536 + b[4 * i + 4] * 16777216)::BIGINT) AS words FROM t1),
t3 AS (SELECT *, {mixed.format("words")} AS ks, {mixed.format("[(CASE WHEN r > 0 THEN b[n - r + 1] ELSE 0 END + CASE WHEN r > 1 THEN b[n - r + 2] * 256 ELSE 0 END + CASE WHEN r > 2 THEN b[n - r + 3] * 65536 ELSE 0 END)::BIGINT]")} AS tail FROM t2),
t4 AS (SELECT *, list_reduce(list_concat([0::BIGINT], ks), lambda h, k: ((({rot("xor(h, k)", 8192, 524288)}) * 5 + 3864292196) % {two32})::BIGINT) AS h FROM t3),
t5 AS (SELECT * REPLACE (xor(xor(h, tail[1]), n) AS h) FROM t4),
t6 AS (SELECT * REPLACE (xor(h, h // 65536) AS h) FROM t5),
t7 AS (SELECT * REPLACE ({mul("h", 2246822507)} AS h) FROM t6),
t8 AS (SELECT * REPLACE (xor(h, h // 8192) AS h) FROM t7),
t9 AS (SELECT * REPLACE ({mul("h", 3266489909)} AS h) FROM t8)
SELECT {key}, CASE WHEN v IS NOT NULL THEN ((xor(h, h // 65536) % 2147483648) % {n})::INTEGER END AS part FROM t9"""


_LATEST_SNAPSHOTS = "(SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY table_uuid, snapshot_id ORDER BY loaded_at DESC, timestamp_ms DESC, parent_snapshot_id DESC NULLS LAST) = 1)"
_LATEST_METADATA = "(SELECT * FROM table_metadata QUALIFY row_number() OVER (PARTITION BY table_uuid ORDER BY last_updated_ms DESC, metadata_file DESC, delivered_at DESC) = 1)"
_LATEST_FIELDS = "(SELECT * FROM schema_fields QUALIFY row_number() OVER (PARTITION BY table_uuid, schema_id, id ORDER BY loaded_at DESC, name DESC, field_type DESC) = 1)"
_LATEST_REFS = "(SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY table_uuid, ref_name ORDER BY loaded_at DESC, snapshot_id DESC) = 1)"
_CURRENT = f"(SELECT s.* FROM {_LATEST_SNAPSHOTS} s JOIN {_LATEST_METADATA} m ON m.table_uuid = s.table_uuid AND m.current_snapshot_id = s.snapshot_id AND m.current_snapshot_id <> -1)"
_PLAIN_TYPES = "'boolean','int','long','float','double','date','time','timestamp','timestampz','string','uuid','binary'"


def _spark_type_sql(text: str) -> str:
    return f"""CASE {text} WHEN 'boolean' THEN 'boolean' WHEN 'int' THEN 'int' WHEN 'long' THEN 'bigint' WHEN 'float' THEN 'float' WHEN 'double' THEN 'double' WHEN 'date' THEN 'date' WHEN 'time' THEN 'bigint'
        WHEN 'timestamp' THEN 'timestamp_ntz' WHEN 'timestampz' THEN 'timestamp' WHEN 'string' THEN 'string' WHEN 'uuid' THEN 'string' WHEN 'binary' THEN 'binary'
        ELSE CASE WHEN regexp_full_match({text}, 'fixed\\[[0-9]+\\]') THEN 'binary' WHEN regexp_full_match({text}, 'decimal\\([0-9]+,[0-9]+\\)') THEN {text} END END"""


_UP = _P1[: _P1.index("ends AS (")].rstrip().rstrip(",")

SQL = {
    "events_by_day": "SELECT date_diff('day', DATE '1970-01-01', ts::DATE)::INTEGER AS ts_day, count(*) AS rows, round(sum(value), 2) AS total_value FROM events GROUP BY 1",
    "partition_tuple_counts": _bucket_sql("events", "event_id", "user_id", 8, ", ts, event_type")
    + "SELECT ((year(ts) - 1970) * 12 + month(ts) - 1)::INTEGER AS ts_month, bucket AS user_bucket, left(event_type, 4) AS type_part, count(*) AS rows FROM b12 GROUP BY 1, 2, 3",
    "pruned_scan": "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:30:00'",
    "pruned_decimal": "SELECT o_orderkey, o_totalprice::DECIMAL(14,2) AS price FROM orders WHERE o_totalprice::DECIMAL(14,2) <= 250000 AND o_totalprice::DECIMAL(14,2) > 100000.5 AND o_custkey NOT IN (1, 2, 3)",
    "transform_void": "SELECT o_orderkey, NULL::VARCHAR AS part FROM orders",
    "transform_identity": "SELECT o_orderkey, o_orderpriority AS part FROM orders",
    "transform_year": "SELECT o_orderkey, (year(o_orderdate) - 1970)::INTEGER AS part FROM orders",
    "transform_month": "SELECT o_orderkey, ((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1)::INTEGER AS part FROM orders",
    "transform_day": "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS part FROM orders",
    "transform_hour": "SELECT event_id, floor(epoch_us(ts) / 3600000000)::INTEGER AS part FROM events",
    "transform_bucket": _bucket_sql("orders", "o_orderkey", "o_custkey", 16) + "SELECT o_orderkey, bucket AS part FROM b12",
    "transform_bucket_time": _bucket_sql("events", "event_id", "epoch_us(ts)", 32) + "SELECT event_id, bucket AS part FROM b12",
    "transform_bucket_string": _bucket_text_sql("part", "p_partkey", "p_name", 16),
    "transform_truncate_int": "SELECT o_orderkey, o_custkey - ((o_custkey % 10) + 10) % 10 AS part FROM orders",
    "transform_truncate_string": "SELECT p_partkey, left(p_name, 3) AS part FROM part",
    "sort_order_apply": _bucket_sql("orders", "o_orderkey", "o_custkey", 16, ", o_orderdate") + "SELECT *, row_number() OVER (ORDER BY cust_bucket ASC NULLS FIRST, order_month DESC NULLS LAST, o_orderkey ASC NULLS LAST) AS position FROM (SELECT bucket AS cust_bucket, ((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1)::INTEGER AS order_month, o_orderkey FROM b12)",
    "sort_order_nulls": f"SELECT table_uuid, snapshot_id, row_number() OVER (ORDER BY schema_id DESC NULLS FIRST, operation ASC NULLS LAST, parent_snapshot_id DESC NULLS LAST, table_uuid ASC NULLS FIRST, snapshot_id ASC NULLS FIRST) AS position FROM {_LATEST_SNAPSHOTS}",
    "type_to_spark": f"""
        SELECT field_type, CASE WHEN field_type IN ({_PLAIN_TYPES}) THEN field_type WHEN d THEN 'decimal' WHEN f THEN 'fixed' END AS kind,
               CASE WHEN d THEN regexp_extract(field_type, '([0-9]+),', 1)::INTEGER END AS precision, CASE WHEN d THEN regexp_extract(field_type, ',([0-9]+)', 1)::INTEGER END AS scale,
               CASE WHEN f THEN regexp_extract(field_type, '([0-9]+)', 1)::DECIMAL(20,0) END AS length, {_spark_type_sql("field_type")} AS spark_type
        FROM (SELECT DISTINCT field_type, regexp_full_match(field_type, 'decimal\\([0-9]+,[0-9]+\\)') AS d, regexp_full_match(field_type, 'fixed\\[[0-9]+\\]') AS f FROM schema_fields)""",
    "parse_transforms": """
        SELECT transform, CASE WHEN transform IN ('void', 'identity', 'year', 'month', 'day', 'hour') THEN transform WHEN p THEN split_part(transform, '[', 1) END AS name,
               CASE WHEN p THEN regexp_extract(transform, '([0-9]+)', 1)::BIGINT END AS arg
        FROM (SELECT DISTINCT transform, regexp_full_match(transform, '(bucket|truncate)\\[[0-9]+\\]') AS p FROM partition_fields)""",
    "schema_to_struct": f"""
        SELECT table_uuid, schema_id, id, name, {_spark_type_sql("t")} AS spark_type
        FROM (SELECT *, CASE lower(regexp_replace(field_type, '\\s', '', 'g')) WHEN 'timestamptz' THEN 'timestampz' ELSE lower(regexp_replace(field_type, '\\s', '', 'g')) END AS t
              FROM {_LATEST_FIELDS} WHERE NOT contains(field_type, '{{'))""",
    "schema_fields": f"WITH RECURSIVE latest AS {_LATEST_FIELDS}, {_DEEP.format(src='latest')}"
    + """SELECT table_uuid, schema_id, id, name, replace(lower(regexp_replace(CASE WHEN json_type(j) = 'OBJECT' THEN j->>'type' ELSE j->>'$' END, '\\s', '', 'g')), 'timestamptz', 'timestampz') AS tag FROM deep""",
    "current_schema": f"SELECT f.table_uuid, f.schema_id, f.id, f.name, f.field_type FROM {_LATEST_FIELDS} f JOIN {_LATEST_METADATA} m ON m.table_uuid = f.table_uuid AND m.current_schema_id = f.schema_id",
    "schema_at_snapshot": f"""
        WITH sizes AS (SELECT table_uuid, schema_id, count(DISTINCT id) AS fields FROM schema_fields GROUP BY ALL),
        x AS (SELECT s.table_uuid, s.snapshot_id, coalesce(s.schema_id, m.current_schema_id) AS schema_id FROM {_LATEST_SNAPSHOTS} s LEFT JOIN {_LATEST_METADATA} m ON m.table_uuid = s.table_uuid)
        SELECT x.table_uuid, snapshot_id, x.schema_id::BIGINT AS schema_id, fields IS NOT NULL AS known, coalesce(fields, 0) AS fields FROM x LEFT JOIN sizes ON sizes.table_uuid = x.table_uuid AND sizes.schema_id = x.schema_id""",
    "project_by_field_id": "SELECT event_id, ts AS happened, event_type AS kind, value AS amount, NULL::VARCHAR AS note FROM events",
    "name_mapping_resolve": "SELECT event_id, ts AS happened, event_type AS kind, value AS amount, NULL::VARCHAR AS note FROM events",
    "identifier_uniqueness": "SELECT table_uuid, snapshot_id, count(*) AS rows FROM snapshots GROUP BY ALL HAVING count(*) > 1",
    "required_nulls": " UNION ALL ".join(f"SELECT '{c}' AS path, count(*) FILTER ({c} IS NULL) AS nulls FROM snapshots" for c in ("table_uuid", "snapshot_id", "parent_snapshot_id", "operation", "summary", "schema_id", "loaded_at"))
    + " UNION ALL SELECT 'summary.value', count(*) FILTER (len(list_filter(map_values(summary), lambda x: x IS NULL)) > 0) FROM snapshots",
    "required_nested": " UNION ALL ".join(f"SELECT '{p}' AS path, count(*) FILTER ({c}) AS nulls FROM table_metadata" for p, c in (
        ("table_uuid", "table_uuid IS NULL"), ("metadata_file", "metadata_file IS NULL"), ("metadata_log", "metadata_log IS NULL"), ("properties.value", "len(list_filter(map_values(properties), lambda x: x IS NULL)) > 0"),
        ("metadata_log.element", "len(list_filter(metadata_log, lambda x: x IS NULL)) > 0"),
        *((f"metadata_log.element.{f}", f"len(list_filter(metadata_log, lambda x: x IS NOT NULL AND x.{f} IS NULL)) > 0") for f in ("metadata_file", "timestamp_ms")),
    )),
    **dict.fromkeys(("project_nested_by_id", "name_mapping_nested"), "SELECT table_uuid, metadata_file AS file, (generate_subscripts(metadata_log, 1) - 1)::INTEGER AS pos, NULL::BIGINT AS size, unnest(metadata_log).timestamp_ms AS at, unnest(metadata_log).metadata_file AS name FROM table_metadata"),
    "snapshots": f"SELECT {', '.join(_SNAPSHOT_COLUMNS)} FROM {_LATEST_SNAPSHOTS}",
    "snapshot_summary": f"SELECT table_uuid, snapshot_id, operation, e.key AS key, e.value AS value FROM (SELECT table_uuid, snapshot_id, operation, unnest(map_entries(summary)) AS e FROM {_LATEST_SNAPSHOTS})",
    "summary_totals": f"SELECT operation, count(*) AS snapshots, sum(try_cast(summary['added-records'] AS BIGINT))::BIGINT AS total FROM {_LATEST_SNAPSHOTS} GROUP BY 1",
    "snapshots_by_operation": "SELECT table_uuid, snapshot_id, operation, timestamp_ms FROM snapshots WHERE operation IN ('append', 'delete')",
    "current_snapshot": f"SELECT {', '.join(_SNAPSHOT_COLUMNS)} FROM {_CURRENT}",
    "snapshot_lineage": _UP + f" SELECT u.t AS table_uuid, u.s AS start_id, (len(u.path) - 1)::INTEGER AS pos, u.seen AS snapshot_id FROM up u JOIN {_CURRENT} c ON c.table_uuid = u.t AND c.snapshot_id = u.s WHERE (u.t, u.s) NOT IN (SELECT (t, s) FROM up WHERE loops)",
    "snapshot_sequence": f"SELECT table_uuid, snapshot_id, sequence_number, lag(snapshot_id) OVER (PARTITION BY table_uuid ORDER BY sequence_number NULLS FIRST, snapshot_id) AS previous_id FROM {_LATEST_SNAPSHOTS}",
    "as_of_timestamp": f"SELECT table_uuid, nullif(current_snapshot_id, -1) AS snapshot_id FROM table_metadata WHERE last_updated_ms <= {AS_OF_MS} QUALIFY row_number() OVER (PARTITION BY table_uuid ORDER BY last_updated_ms DESC, metadata_file DESC, delivered_at DESC) = 1",
    "resolve_ref": f"""
        SELECT table_uuid, snapshot_id FROM {_LATEST_REFS} WHERE ref_name = 'main'
        UNION ALL SELECT table_uuid, current_snapshot_id FROM {_LATEST_METADATA} WHERE current_snapshot_id <> -1 AND table_uuid NOT IN (SELECT table_uuid FROM refs)""",
    "refs": f"""
        SELECT r.table_uuid, ref_name, r.snapshot_id, ref_type, min_snapshots_to_keep, max_snapshot_age_ms, max_ref_age_ms, coalesce({NOW_MS} - s.timestamp_ms > max_ref_age_ms AND ref_name <> 'main', false) AS expired
        FROM {_LATEST_REFS} r LEFT JOIN {_LATEST_SNAPSHOTS} s ON s.table_uuid = r.table_uuid AND s.snapshot_id = r.snapshot_id""",
    "expire_candidates": _UP
    + f""",
        live AS (SELECT r.* FROM {_LATEST_REFS} r LEFT JOIN {_LATEST_SNAPSHOTS} s ON s.table_uuid = r.table_uuid AND s.snapshot_id = r.snapshot_id
                 WHERE NOT coalesce({NOW_MS} - s.timestamp_ms > max_ref_age_ms AND ref_name <> 'main', false)),
        chain AS (SELECT u.t, u.seen, len(u.path) - 1 AS pos, s.timestamp_ms, min_snapshots_to_keep AS k, max_snapshot_age_ms AS a
                  FROM up u JOIN live r ON r.table_uuid = u.t AND r.snapshot_id = u.s AND ref_type = 'branch' JOIN {_LATEST_SNAPSHOTS} s ON s.table_uuid = u.t AND s.snapshot_id = u.seen
                  WHERE (u.t, u.s) NOT IN (SELECT (t, s) FROM up WHERE loops)),
        kept AS (SELECT t, seen FROM chain WHERE pos < greatest(coalesce(k, 1), 1) OR coalesce({NOW_MS} - timestamp_ms <= a, false) UNION SELECT table_uuid, snapshot_id FROM live)
        SELECT table_uuid, snapshot_id FROM {_LATEST_SNAPSHOTS} s WHERE expired_at IS NULL AND NOT EXISTS (SELECT 1 FROM kept WHERE kept.t = s.table_uuid AND kept.seen = s.snapshot_id)""",
    "metadata_log": f"""
        SELECT table_uuid, (rn - 1)::INTEGER AS pos, metadata_file, timestamp_ms FROM (
            SELECT table_uuid, e.metadata_file, e.timestamp_ms, row_number() OVER (PARTITION BY table_uuid ORDER BY e.timestamp_ms DESC, e.metadata_file DESC) AS rn
            FROM (SELECT table_uuid, unnest(metadata_log) AS e FROM {_LATEST_METADATA})) WHERE rn <= 5""",
    "table_properties": f"SELECT table_uuid, e.key AS key, e.value AS value FROM (SELECT table_uuid, unnest(map_entries(properties)) AS e FROM {_LATEST_METADATA})",
}

_SNAPSHOT_LOG = """
WITH files AS (SELECT table_uuid, metadata_file, last_updated_ms AS timestamp_ms, nullif(current_snapshot_id, -1) AS snapshot_id FROM table_metadata
    QUALIFY row_number() OVER (PARTITION BY table_uuid, metadata_file ORDER BY delivered_at DESC, last_updated_ms DESC) = 1),
log AS (SELECT table_uuid, snapshot_id, timestamp_ms FROM files
    WINDOW w AS (PARTITION BY table_uuid ORDER BY timestamp_ms NULLS FIRST, metadata_file) QUALIFY row_number() OVER w = 1 OR snapshot_id IS DISTINCT FROM lag(snapshot_id) OVER w)
"""
SQL["snapshot_log"] = _SNAPSHOT_LOG + "SELECT * FROM log"
SQL["as_of_snapshot_log"] = _SNAPSHOT_LOG + f"SELECT table_uuid, snapshot_id FROM log WHERE timestamp_ms <= {AS_OF_MS} QUALIFY row_number() OVER (PARTITION BY table_uuid ORDER BY timestamp_ms DESC, snapshot_id DESC NULLS LAST) = 1"
SQL["parse_table_metadata"], SQL["parse_table_metadata_strict"] = codec_sql.parsed("spec"), codec_sql.parsed("reference")
SQL["roundtrip_table_metadata"], SQL["roundtrip_table_metadata_strict"] = codec_sql.round_trips("spec"), codec_sql.round_trips("reference")
SQL["validate_metadata"] = codec_sql.violations()
