"""What changed between full snapshots.

Each delivered file holds the full state of a table as sets of keyed records.
The records of a file, sorted by key, are cut into content-defined chunks: a
chunk begins at each record whose key hashes to a multiple of ``CHUNK``, so
that the cuts of two files agree wherever their keys do. Chunks that both of
two consecutive files have are discarded by their digests; only the records of
the others are joined by key to classify the changes.

Files go through one shuffle only: a range partitioning by (table, time, name),
which puts consecutive files next to each other and splits a table with a large
part of all files by time. What lies between two partitions is compared from
their outermost files, of which there are two a partition.

Digests are two independent 64-bit sums over the records of a chunk: 128 bits,
so that equal digests of different chunks don't occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.shared import arrow_batches, exact, materialize, ship

CHUNK = 4
BATCH_BYTES = "16m"  # of states that a task compares at a time
HOT_DELIVERIES = 50_000
_KEYS = ("snapshot-diff-01", "snapshot-diff-02", "snapshot-diff-03")  # of the hashes, 16 bytes each
_STATE = "table_uuid string, file string, ms bigint, properties map<string,string>, metadata_log array<struct<metadata_file:string,timestamp_ms:bigint>>, is_first boolean, is_last boolean"
_FOUND = "kind string, record_key string, change_kind string, value_then string, value_now string"
_STATE_ARROW = pa.schema([
    ("table_uuid", pa.string()), ("file", pa.string()), ("ms", pa.int64()), ("properties", pa.map_(pa.string(), pa.string())),
    ("metadata_log", pa.list_(pa.struct([("metadata_file", pa.string()), ("timestamp_ms", pa.int64())]))), ("is_first", pa.bool_()), ("is_last", pa.bool_()),
])
_OUT_ARROW = pa.schema([*_STATE_ARROW, *((n, pa.string()) for n in ("kind", "record_key", "change_kind", "value_then", "value_now"))])
_NAMES = [f.name for f in _STATE_ARROW]


# ---------------------------------------------------------------- chunks


@dataclass
class Chunks:
    """Chunks of records sorted by (owner, key): chunk c holds records start[c] to end[c]."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    d1: np.ndarray
    d2: np.ndarray
    keys: pa.Array
    vals: pa.Array


def _entries(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and values of all entries of a list or map column, nulls being empty."""
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    owner = np.repeat(np.arange(len(column)), np.diff(offsets))
    keep = np.asarray(column.is_valid())[owner]
    return (owner, values) if keep.all() else (owner[keep], values.filter(pa.array(keep)))


def _hash(texts: np.ndarray, key: str) -> np.ndarray:
    return pd.util.hash_array(texts, hash_key=key, categorize=False)


def cut(owner: np.ndarray, keys: pa.Array, vals: pa.Array) -> Chunks:
    """Chunks of records (owner, key, value as text). Of a key given twice the
    greatest value counts, null last."""
    table = pa.table({"o": owner, "k": keys, "v": vals})
    order = pc.sort_indices(table, [("o", "ascending"), ("k", "ascending"), ("v", "ascending")], null_placement="at_start")
    table = table.take(order).combine_chunks()
    owner, keys, vals = table["o"].to_numpy(), table["k"].combine_chunks(), table["v"].combine_chunks()
    names = keys.to_numpy(zero_copy_only=False)
    if len(owner) > 1:
        last = np.append((owner[1:] != owner[:-1]) | (names[1:] != names[:-1]), True)
        if not last.all():
            owner, names, keys, vals = owner[last], names[last], keys.filter(pa.array(last)), vals.filter(pa.array(last))
    marked = pc.if_else(pc.is_null(vals), "n", pc.binary_join_element_wise("v", pc.fill_null(vals, ""), ""))
    full = pc.binary_join_element_wise(keys, marked, "\x00").to_numpy(zero_copy_only=False)
    begins = _hash(names, _KEYS[0]) % np.uint64(CHUNK) == 0
    start = np.flatnonzero(begins | np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    add = lambda h: np.add.reduceat(h, start) if len(start) else np.zeros(0, np.uint64)
    return Chunks(owner[start], start, np.append(start[1:], len(owner)), add(_hash(full, _KEYS[1])), add(_hash(full, _KEYS[2])), keys, vals)


def _kinds(states: pa.Table) -> Iterator[tuple[str, Chunks]]:
    owner, pairs = _entries(states["properties"].combine_chunks())
    yield "property", cut(owner, pairs.field(0), pairs.field(1))
    owner, entries = _entries(states["metadata_log"].combine_chunks())
    there = np.asarray(pc.is_valid(pc.struct_field(entries, 0)))
    owner, entries = owner[there], entries.filter(pa.array(there))
    yield "log", cut(owner, pc.struct_field(entries, 0), pc.cast(pc.struct_field(entries, 1), pa.string()))


def unmatched(c: Chunks, of_new: np.ndarray, of_old: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, side, chunk) of the chunks that the other file of their pair lacks.
    of_new and of_old give the pair in which a file is the later or earlier one, or -1."""
    pair = np.concatenate([of_old[c.owner], of_new[c.owner]])
    side = np.repeat([False, True], len(c.owner))
    chunk = np.tile(np.arange(len(c.owner)), 2)
    used = pair >= 0
    pair, side, chunk = pair[used], side[used], chunk[used]
    d1, d2 = c.d1[chunk], c.d2[chunk]
    order = np.lexsort((side, d2, d1, pair))
    p, a, b, s = pair[order], d1[order], d2[order], side[order]
    twin = (p[1:] == p[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (s[1:] != s[:-1])
    alone = order[~(np.append(twin, False) | np.append(False, twin))] if len(order) else order
    return pair[alone], side[alone], chunk[alone]


def compare(states: pa.Table, earlier: np.ndarray, later: np.ndarray) -> list[pa.RecordBatch]:
    """The changes of each pair of rows of states, as rows of the later file."""
    out = []
    of_new, of_old = np.full(states.num_rows, -1), np.full(states.num_rows, -1)
    of_new[later] = of_old[earlier] = np.arange(len(later))
    for kind, c in _kinds(states):
        pair, side, chunk = unmatched(c, of_new, of_old)
        sizes = c.end[chunk] - c.start[chunk]
        at = np.repeat(c.start[chunk] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum()) if len(chunk) else np.zeros(0, np.int64)
        rows = pa.table({"p": np.repeat(pair, sizes), "k": c.keys.take(pa.array(at)), "s": np.repeat(side, sizes), "v": c.vals.take(pa.array(at))})
        rows = rows.take(pc.sort_indices(rows, [("p", "ascending"), ("k", "ascending"), ("s", "ascending")])).combine_chunks()
        if not rows.num_rows:
            continue
        p, s = rows["p"].to_numpy(), rows["s"].to_numpy()
        k, v = (rows[x].combine_chunks().to_numpy(zero_copy_only=False) for x in "kv")
        both = np.append((p[1:] == p[:-1]) & (k[1:] == k[:-1]), False)  # an old record, its new form behind it
        second = np.append(False, both[:-1])
        nxt = np.append(v[1:], None)
        change = np.where(both, np.where(v == nxt, "", "changed"), np.where(second, "", np.where(s, "added", "removed")))
        pick = np.flatnonzero(change != "")
        then = np.where(s[pick], None, v[pick])
        now = np.where(s[pick], v[pick], np.where(both[pick], nxt[pick], None))
        file = states.select(["table_uuid", "file"]).take(pa.array(later[p[pick]])).combine_chunks()
        found = {"table_uuid": file["table_uuid"], "file": file["file"], "kind": [kind] * len(pick), "record_key": k[pick], "change_kind": change[pick], "value_then": then, "value_now": now}
        out.append(_batch(found, len(pick)))
    return out


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    arrays = []
    for f in _OUT_ARROW:
        x = columns.get(f.name)
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        arrays.append(pa.nulls(n, f.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, f.type, from_pandas=True))
    return pa.RecordBatch.from_arrays(arrays, schema=_OUT_ARROW)


def _changes(row: pa.ChunkedArray) -> np.ndarray:
    """Where a sorted column differs from the row before."""
    a = row.combine_chunks()
    return np.asarray(pc.fill_null(pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)), True))


def _walk(batches: Iterator[pa.RecordBatch], outermost: bool) -> Iterator[pa.RecordBatch]:
    """Compares consecutive files of a sorted partition and hands on its first and
    last file; with outermost, the rows are such files of all partitions, and only
    the last of one is compared with the first of the next."""
    held: pa.Table | None = None
    first: pa.Table | None = None

    def step(states: pa.Table, final: bool) -> tuple[pa.Table, list[pa.RecordBatch]]:
        n = states.num_rows
        if outermost:
            kept = np.arange(n)
        else:  # of a file sent again the last row holds
            kept = np.flatnonzero(np.append(_changes(states["table_uuid"]) | _changes(states["ms"]) | _changes(states["file"]), True))
        files = states.take(pa.array(kept)).combine_chunks()
        m = files.num_rows
        same = ~_changes(files["table_uuid"]) if m > 1 else np.zeros(0, bool)
        if outermost and m > 1:
            same &= np.asarray(files["is_last"].combine_chunks())[:-1] & np.asarray(files["is_first"].combine_chunks())[1:]
        later = np.flatnonzero(same) + 1
        later = later if final else later[later < m - 1]  # the last one may still be sent again
        return files, compare(files, later - 1, later) if len(later) else []

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        files, found = step(rows if held is None else pa.concat_tables([held, rows]), False)
        yield from found
        if first is None and files.num_rows > 1:
            first = files.slice(0, 1)
        held = files.slice(max(0, files.num_rows - 2))
    if held is None:
        return
    files, found = step(held, True)
    yield from found
    if outermost:
        return
    last = files.slice(files.num_rows - 1)
    alone = first is None and files.num_rows == 1
    edges = [last] if alone else [files.slice(0, 1) if first is None else first, last]
    for i, edge in enumerate(edges):
        columns = {n: edge[n] for n in _NAMES} | {"is_first": [alone or i == 0], "is_last": [alone or i == 1]}
        yield _batch(columns, 1)


# ---------------------------------------------------------------- on Spark


def delivered_files(deliveries: DataFrame) -> DataFrame:
    """(table_uuid, file, ms, at, h, properties, metadata_log) of the deliveries,
    such that rows of one file differ in at and h only. Rows without table_uuid or
    metadata_file are no files; a null time counts as 0.

    Of files that were sent with different times, and of files sent so often that
    they would fill a task, the last delivery is picked beforehand, by an
    aggregation that starts before the shuffle.
    """
    columns = exact(deliveries, "table_uuid", "metadata_file", "delivered_at", "last_updated_ms", "properties", "metadata_log")
    log = F.transform("metadata_log", lambda e: F.struct(e["metadata_file"].cast("string").alias("metadata_file"), e["timestamp_ms"].cast("bigint").alias("timestamp_ms")))
    rows = columns.filter(F.col("table_uuid").isNotNull() & F.col("metadata_file").isNotNull()).select(
        "table_uuid", F.col("metadata_file").alias("file"), F.coalesce(F.col("last_updated_ms").cast("bigint"), F.lit(0)).alias("ms"),
        F.col("delivered_at").alias("at"), "properties", log.alias("metadata_log"),
    )
    rows = rows.withColumn("h", F.xxhash64(F.to_json(F.struct("properties", "metadata_log"))))
    seen = rows.groupBy(F.col("table_uuid").alias("st"), F.col("file").alias("sf")).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.count("*").alias("n"))
    odd = materialize(seen.filter((F.col("lo") != F.col("hi")) | (F.col("n") > HOT_DELIVERIES)).select("st", "sf"), "odd")
    if odd.limit(1).count() == 0:
        return rows
    same = (F.col("table_uuid") == F.col("st")) & (F.col("file") == F.col("sf"))
    order = F.struct("at", "ms", "h")
    picked = rows.join(odd, same, "left_semi").groupBy("table_uuid", "file").agg(F.max(order).alias("o"), F.max_by(F.struct("properties", "metadata_log"), order).alias("s"))
    picked = picked.select("table_uuid", "file", "o.ms", "o.at", "s.properties", "s.metadata_log", "o.h")
    return rows.join(odd, same, "left_anti").unionByName(picked)


def snapshot_changes(deliveries: DataFrame) -> DataFrame:
    """The records added, removed or changed from each delivered file of a table
    to the next: (table_uuid, metadata_file of the later, record_kind,
    record_key, change_kind, value_then, value_now).

    Files are ordered by last_updated_ms, ties by name; a file sent again counts
    once, as sent last (among equal times the greatest last_updated_ms, then
    content). Values are compared exactly, null equals null; a null map or log is
    an empty one; a log entry without metadata_file names no record. The first
    file of a table has no changes; an empty input gives none.
    """
    ship(deliveries.sparkSession)
    none = F.lit(None).cast("boolean")
    files = delivered_files(deliveries).repartitionByRange("table_uuid", "ms", "file").sortWithinPartitions("table_uuid", "ms", "file", "at", "h")
    states = files.select("table_uuid", "file", "ms", "properties", "metadata_log", none.alias("is_first"), none.alias("is_last"))
    with arrow_batches(deliveries.sparkSession, BATCH_BYTES):
        walked = materialize(states.mapInArrow(lambda b: _walk(b, False), f"{_STATE}, {_FOUND}"), "walked")
    edges = walked.filter(F.col("is_first").isNotNull()).select(*_NAMES).repartition("table_uuid").sortWithinPartitions("table_uuid", "ms", "file")
    between = edges.mapInArrow(lambda b: _walk(b, True), f"{_STATE}, {_FOUND}")
    found = ["table_uuid", F.col("file").alias("metadata_file"), F.col("kind").alias("record_kind"), "record_key", "change_kind", "value_then", "value_now"]
    return walked.filter(F.col("kind").isNotNull()).select(*found).unionByName(between.select(*found))
