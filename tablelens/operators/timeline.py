"""Snapshots, references and logs over time, for all tables at once.

Inputs are tables as delivered: of several rows of a snapshot, ref or file the
one loaded last holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators import hierarchy
from tablelens.shared import materialize, with_previous

SNAPSHOT_LINKS = hierarchy.Links(group="table_uuid", node="snapshot_id", parent="parent_snapshot_id", version="loaded_at", order="timestamp_ms")
MAIN = "main"


def latest(df: DataFrame, keys: Sequence[str], version: str, *more: str, keep: Sequence[str] | None = None) -> DataFrame:
    """The row of each key with the greatest version; among equal ones by more. Of the
    columns only those to keep are read and shuffled; all of them by default."""
    rest = [c for c in (df.columns if keep is None else keep) if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(version, *more)).alias("r"))
    return picked.select(*keys, *(F.col(f"r.`{c}`").alias(c) for c in rest))


def latest_snapshots(snapshots: DataFrame, *keep: str) -> DataFrame:
    return latest(snapshots, ["table_uuid", "snapshot_id"], "loaded_at", "timestamp_ms", "parent_snapshot_id", keep=keep or None)


def latest_metadata(table_metadata: DataFrame, *keep: str) -> DataFrame:
    """The state of each table in its last file: by last_updated_ms, then file name."""
    return latest(table_metadata, ["table_uuid"], "last_updated_ms", "metadata_file", "delivered_at", keep=keep or None)


def latest_refs(refs: DataFrame) -> DataFrame:
    return latest(refs, ["table_uuid", "ref_name"], "loaded_at", "snapshot_id", keep=["snapshot_id", "ref_type", "min_snapshots_to_keep", "max_snapshot_age_ms", "max_ref_age_ms"])


def by_operation(snapshots: DataFrame, operations: Sequence[str]) -> DataFrame:
    """The snapshots of some operations only; the filter reaches the scan."""
    return snapshots.filter(F.col("operation").isin(*operations))


def current_snapshots(table_metadata: DataFrame, snapshots: DataFrame, *keep: str) -> DataFrame:
    """The current snapshot of each table. Tables whose current_snapshot_id is null
    or -1 are empty and have none; a pointer to nothing has none either."""
    now = latest_metadata(table_metadata, "current_snapshot_id")
    now = now.filter(F.col("current_snapshot_id").isNotNull() & (F.col("current_snapshot_id") != -1)).select("table_uuid", F.col("current_snapshot_id").alias("snapshot_id"))
    return latest_snapshots(snapshots, *keep).join(now, ["table_uuid", "snapshot_id"])


def current_schemas(table_metadata: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """The top-level fields of each table's current schema."""
    now = latest_metadata(table_metadata, "current_schema_id")
    fields = latest(schema_fields, ["table_uuid", "schema_id", "id"], "loaded_at", "name", "field_type", keep=["pos", "name", "required", "field_type", "doc"])
    return fields.join(now.select("table_uuid", F.col("current_schema_id").alias("schema_id")), ["table_uuid", "schema_id"])


def schemas_at_snapshots(snapshots: DataFrame, table_metadata: DataFrame, schema_fields: DataFrame) -> DataFrame:
    """(table_uuid, snapshot_id, schema_id, known, fields): the schema each snapshot
    was written with, else the table's current one; known where its fields are there."""
    now = latest_metadata(table_metadata, "current_schema_id").select("table_uuid", F.col("current_schema_id").cast("bigint").alias("current"))
    sizes = schema_fields.groupBy("table_uuid", F.col("schema_id").cast("bigint").alias("schema_id")).agg(F.count_distinct("id").alias("fields"))
    at = latest_snapshots(snapshots, "schema_id").join(now, "table_uuid", "left")
    at = at.select("table_uuid", "snapshot_id", F.coalesce("schema_id", "current").alias("schema_id"))
    return at.join(sizes, ["table_uuid", "schema_id"], "left").select("table_uuid", "snapshot_id", "schema_id", F.col("fields").isNotNull().alias("known"), F.coalesce("fields", F.lit(0)).alias("fields"))


def ancestors(snapshots: DataFrame, starts: DataFrame, cyclic: bool = True) -> DataFrame:
    """(table_uuid, start_id, pos, snapshot_id): the chain of parents of each start
    (table_uuid, snapshot_id), itself at pos 0. A chain ends where a parent isn't
    there, or where a snapshot would come again; without cyclic, starts on or
    below a cycle have no chain."""
    forest = materialize(hierarchy.resolve_forest(snapshots, SNAPSHOT_LINKS, shape=True), "forest")
    wanted = starts.select(F.col("table_uuid").alias("wt"), F.col("snapshot_id").alias("ws")).distinct()
    marked = forest.join(wanted, F.col("g").eqNullSafe(F.col("wt")) & (F.col("node") == F.col("ws")), "left").withColumn("wanted", F.col("ws").isNotNull())
    paths = hierarchy.full_paths(marked, F.col("wanted"), cyclic=cyclic)
    chain = F.reverse("path")
    if cyclic:
        # a path begins at the smallest snapshot of the cycle; the path of its parent is the whole cycle
        ends = forest.filter("closes_cycle").select(F.col("g").alias("eg"), F.col("parent").alias("end"))
        last = forest.join(ends, F.col("g").eqNullSafe(F.col("eg")) & (F.col("node") == F.col("end")), "left").withColumn("last", F.col("end").isNotNull())
        rings = hierarchy.full_paths(last, F.col("last"), cyclic=True).select(F.col("g").alias("rg"), F.col("path").alias("ring"))
        paths = paths.join(rings, F.col("g").eqNullSafe(F.col("rg")) & (F.col("path")[0] == F.col("ring")[0]), "left")
        chain = F.concat(chain, F.coalesce(F.reverse(F.array_except("ring", "path")), F.array().cast("array<bigint>")))
    return paths.select(F.col("g").alias("table_uuid"), F.col("node").alias("start_id"), F.posexplode(chain).alias("pos", "snapshot_id"))


def in_sequence(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the one before it by sequence number (null first), then id,
    of its table."""
    rows = latest_snapshots(snapshots, "sequence_number")
    return with_previous(rows, "table_uuid", ["sequence_number", "snapshot_id"], "snapshot_id", "previous_id")


def as_of(table_metadata: DataFrame, timestamp_ms: int) -> DataFrame:
    """(table_uuid, snapshot_id): the snapshot that was current at a time, by the
    last file up to it; null where the table was empty then."""
    then = table_metadata.filter(F.col("last_updated_ms") <= timestamp_ms).groupBy("table_uuid")
    return then.agg(F.max(F.struct("last_updated_ms", "metadata_file", "delivered_at", F.expr("nullif(current_snapshot_id, -1)").alias("s"))).alias("m")).select("table_uuid", F.col("m.s").alias("snapshot_id"))


def snapshot_log(table_metadata: DataFrame) -> DataFrame:
    """(table_uuid, snapshot_id, timestamp_ms): each change of a table's current snapshot
    (null where it became empty), as its delivered files tell."""
    keys = ["table_uuid", "metadata_file"]
    files = latest(table_metadata, keys, "delivered_at", "last_updated_ms", keep=["last_updated_ms", "current_snapshot_id"])
    states = files.select("table_uuid", "metadata_file", F.col("last_updated_ms").alias("timestamp_ms"), F.struct(F.expr("nullif(current_snapshot_id, -1)").alias("s")).alias("now"))
    steps = with_previous(states, "table_uuid", ["timestamp_ms", "metadata_file"], "now", "then")
    changed = steps.filter(F.col("then").isNull() | ~F.col("then.s").eqNullSafe(F.col("now.s")))
    return changed.select("table_uuid", F.col("now.s").alias("snapshot_id"), "timestamp_ms")


def as_of_log(log: DataFrame, timestamp_ms: int) -> DataFrame:
    """(table_uuid, snapshot_id): the snapshot that was current at a time, by a snapshot
    log (table_uuid, snapshot_id, timestamp_ms; pos where several entries have one time)."""
    place = F.col("pos") if "pos" in log.columns else F.lit(0)
    then = log.filter(F.col("timestamp_ms") <= timestamp_ms).groupBy("table_uuid")
    return then.agg(F.max(F.struct("timestamp_ms", place.alias("pos"), "snapshot_id")).alias("m")).select("table_uuid", F.col("m.snapshot_id").alias("snapshot_id"))


def resolve_refs(table_metadata: DataFrame, refs: DataFrame, name: str = MAIN) -> DataFrame:
    """(table_uuid, snapshot_id) that a name stands for in each table: the ref, as
    loaded last; for main in a table without any refs, its current snapshot."""
    named = latest_refs(refs)
    found = named.filter(F.col("ref_name") == name).select("table_uuid", "snapshot_id")
    if name != MAIN:
        return found
    now = latest_metadata(table_metadata, "current_snapshot_id")
    now = now.filter(F.col("current_snapshot_id").isNotNull() & (F.col("current_snapshot_id") != -1))
    return found.unionByName(now.join(refs.select("table_uuid").distinct(), "table_uuid", "left_anti").select("table_uuid", F.col("current_snapshot_id").alias("snapshot_id")))


def live_refs(refs: DataFrame, snapshots: DataFrame, now_ms: int) -> DataFrame:
    """The refs as loaded last, with expired: older than max_ref_age_ms, by the
    time of the snapshot they point to. main never expires; a limit of null is
    none; a ref to a snapshot that isn't there has no age."""
    at = latest_snapshots(snapshots, "timestamp_ms").withColumnRenamed("timestamp_ms", "at")
    joined = latest_refs(refs).join(at, ["table_uuid", "snapshot_id"], "left")
    too_old = (F.lit(now_ms) - F.col("at") > F.col("max_ref_age_ms")) & (F.col("ref_name") != MAIN)
    return joined.withColumn("expired", F.coalesce(too_old, F.lit(False))).drop("at")


def expire_candidates(refs: DataFrame, snapshots: DataFrame, now_ms: int, cyclic: bool = True) -> DataFrame:
    """(table_uuid, snapshot_id) that no live ref keeps.

    A tag keeps its snapshot. A branch keeps, of the chain of its snapshot, the
    first min_snapshots_to_keep (at least its own) and those not older than
    max_snapshot_age_ms (inclusive). Snapshots that are marked expired already are no candidates.
    A chain that leads into a cycle ends where a snapshot would come again; without
    cyclic, a branch on or below one keeps its own snapshot only.
    """
    live = materialize(live_refs(refs, snapshots, now_ms).filter(~F.col("expired")), "live")
    forest = materialize(hierarchy.resolve_forest(snapshots, SNAPSHOT_LINKS, shape=True), "forest")
    branches = live.filter(F.col("ref_type") == "branch").groupBy(F.col("table_uuid").alias("bt"), F.col("snapshot_id").alias("bs")).agg(F.max(F.greatest(F.coalesce("min_snapshots_to_keep", F.lit(1)), F.lit(1))).alias("keep"), F.max("max_snapshot_age_ms").alias("age"))
    # of the branches below a snapshot: the least level that they reach up to, and the greatest age
    there = F.lit(True) if cyclic else F.col("level") >= 0
    valued = forest.join(branches, F.col("g").eqNullSafe(F.col("bt")) & (F.col("node") == F.col("bs")), "left")
    valued = valued.withColumns({"reach": F.when(there, F.col("tree_level") - F.col("keep")).cast("bigint"), "age": F.when(there, F.col("age")).cast("bigint")})
    limits = hierarchy.fold_descendants(valued, {"reach": "min", "age": "max"}).withColumnsRenamed({"g": "fg", "node": "fn"})
    placed = forest.join(limits, F.col("g").eqNullSafe(F.col("fg")) & (F.col("node") == F.col("fn")))
    around = F.lit(None).cast("bigint")
    if cyclic:
        # a chain goes on from where the cycle is cut, around to where it came in: past all that
        # holds the last of the ring, the parent of its first. A snapshot that it has passed
        # before it passes at a lower position than so counted.
        ends = forest.filter("closes_cycle").select(F.col("g").alias("eg"), F.col("root").alias("er"), F.col("parent").alias("ep"))
        last = forest.select(F.col("g").alias("lg"), F.col("node").alias("ln"), F.col("number").alias("last_number"), F.col("tree_level").alias("last_level"))
        rings = ends.join(last, F.col("eg").eqNullSafe(F.col("lg")) & (F.col("ep") == F.col("ln"))).drop("lg", "ln", "ep")
        whole = valued.filter(F.col("level") < 0).groupBy(F.col("g").alias("wg"), F.col("root").alias("wr")).agg(F.min("reach").alias("ring_reach"), F.max("age").alias("ring_age"))
        rings = rings.join(whole, F.col("eg").eqNullSafe(F.col("wg")) & (F.col("er") == F.col("wr"))).drop("wg", "wr")
        on_ring = (F.col("number") <= F.col("last_number")) & (F.col("last_number") <= F.col("number") + F.col("descendants"))
        placed = placed.join(rings, F.col("g").eqNullSafe(F.col("eg")) & (F.col("root") == F.col("er")) & (F.col("level") < 0) & on_ring, "left")
        around = F.col("ring_age")
        reached = (F.col("tree_level") > F.col("reach")) | (F.col("tree_level") - F.col("last_level") - 1 > F.col("ring_reach"))
    else:
        reached = F.col("tree_level") > F.col("reach")
    placed = placed.select(F.col("g").alias("pg"), F.col("node").alias("pn"), F.coalesce(reached, F.lit(False)).alias("reached"), F.greatest("age", around).alias("age") if cyclic else F.col("age"))
    rows = latest_snapshots(snapshots, "timestamp_ms", "expired_at").filter(F.col("expired_at").isNull()).join(placed, F.col("table_uuid").eqNullSafe(F.col("pg")) & (F.col("snapshot_id") == F.col("pn")), "left")
    young = F.coalesce(F.lit(now_ms) - F.col("timestamp_ms") <= F.col("age"), F.lit(False))
    gone = rows.filter(~(F.coalesce("reached", F.lit(False)) | young)).select("table_uuid", "snapshot_id")
    return gone.join(live.select("table_uuid", "snapshot_id"), ["table_uuid", "snapshot_id"], "left_anti")


def metadata_log(table_metadata: DataFrame, keep: int | None = None) -> DataFrame:
    """The entries of each table's last metadata log, newest pos 0; of at most keep entries."""
    now = latest_metadata(table_metadata, "metadata_log")
    order = F.reverse(F.array_sort(F.transform("metadata_log", lambda e: F.struct(e["timestamp_ms"].alias("timestamp_ms"), e["metadata_file"].alias("file")))))
    entries = now.select("table_uuid", F.posexplode(order if keep is None else F.slice(order, 1, keep)).alias("pos", "e"))
    return entries.select("table_uuid", "pos", F.col("e.file").alias("metadata_file"), F.col("e.timestamp_ms").alias("timestamp_ms"))


def table_properties(table_metadata: DataFrame) -> DataFrame:
    """(table_uuid, key, value) of each table's last file."""
    now = latest_metadata(table_metadata, "properties")
    return now.select("table_uuid", F.explode("properties").alias("key", "value"))


def summary_entries(snapshots: DataFrame) -> DataFrame:
    """(table_uuid, snapshot_id, operation, key, value) of each snapshot's summary."""
    return latest_snapshots(snapshots, "operation", "summary").select("table_uuid", "snapshot_id", "operation", F.explode("summary").alias("key", "value"))


def summed(snapshots: DataFrame, key: str) -> DataFrame:
    """Of each operation the number of snapshots and the sum of a number in their summaries."""
    value = F.col("value").try_cast("bigint")
    numbers = latest_snapshots(snapshots.withColumn("value", F.col("summary")[key]), "operation", "value")
    return numbers.groupBy("operation").agg(F.count("*").alias("snapshots"), F.sum(value).alias("total"))
