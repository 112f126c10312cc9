"""Sort orders as Spark orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.transforms import TransformError, apply_transform
from tablelens.model import Schema, SortOrder

_METHOD = {
    ("asc", "nulls-first"): "asc_nulls_first", ("asc", "nulls-last"): "asc_nulls_last",
    ("desc", "nulls-first"): "desc_nulls_first", ("desc", "nulls-last"): "desc_nulls_last",
}


def sort_columns(order: SortOrder, schema: Schema, df: DataFrame) -> list[Column]:
    """The orderings of a sort order, first one first; none for the unsorted order 0.
    Each compares the transformed value of its source field."""
    if order.order_id == 0:
        return []
    fields = {f.id: f for f in schema.fields}
    kinds = {f.name: f.dataType for f in df.schema}
    out = []
    for f in order.fields:
        if f.source_id not in fields:
            raise TransformError(f"sort field: no source field {f.source_id}")
        source = fields[f.source_id]
        out.append(getattr(apply_transform(f.transform, F.col(f"`{source.name}`"), kinds[source.name], source.field_type), _METHOD[(f.direction, f.null_order)])())
    return out


def sort_for_writing(df: DataFrame, order: SortOrder, schema: Schema, total: bool = False) -> DataFrame:
    """df sorted for a writer: within its partitions, or in total. Readers never
    sort by a table's default order."""
    columns = sort_columns(order, schema, df)
    if not columns:
        return df
    return df.orderBy(*columns) if total else df.sortWithinPartitions(*columns)
