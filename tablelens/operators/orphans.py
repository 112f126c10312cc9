"""References to records that do not exist.

Keyed state, maintained batch by batch: an index of parents (per key when it is
there) and the references with what has happened to them. A batch may hold any mix
of references, arrivals and deletions. Its new references probe the index; keys
whose times it changes have their references looked up again, so that arrivals
resolve the orphans that wait for them and deletions reopen those in order. Only
references that are new or whose key has changed are worked out and written: the
state is a log, and of the rows of one reference or key the last batch's holds.

The log is stored in buckets by a hash of the key. A batch reads only the buckets
that its keys are in, so that its work follows its own size; see ``step``. Batches in
any order give the same state, since times decide, not the order in which they come.

Parents are aggregated before they are shuffled. References are never gathered by
key: they meet the index in a join, where Spark splits hot keys at run time.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.shared import drop_table, exact, materialize, new_path, with_previous

REFERENCE = ("ref_kind", "table_uuid", "record_key", "target_kind", "target_id", "first_seen")
PARENT = ("target_kind", "table_uuid", "target_id", "arrived", "deleted")
_KEY = ("target_kind", "table_uuid", "target_id")
_ID = ("ref_kind", "record_key", *_KEY)
#: A row of the state: of the index (arrived, deleted, times) or of the references (the rest).
_COLUMNS = {
    "target_kind": "string", "table_uuid": "string", "target_id": "bigint", "arrived": "timestamp_ntz", "deleted": "timestamp_ntz", "times": "array<struct<at:timestamp_ntz,there:boolean>>",
    "ref_kind": "string", "record_key": "string", "first_seen": "timestamp_ntz", "moves": "array<struct<at:timestamp_ntz,what:string>>", "v": "int",
}
_DDL = ", ".join(f"{c} {t}" for c, t in {**_COLUMNS, "part": "string", "log": "string", "bucket": "int"}.items())
_LOGS = {"index": ("arrived", "deleted", "times"), "references": ("ref_kind", "record_key", "first_seen", "moves")}
_BEGIN = "0001-01-01"


@dataclass
class OrphanState:
    """The state after the batches so far: the name of each one's part of the two logs, by
    its number. returns: whether a parent that arrives after its deletion is there
    again; if not, it is there from its first arrival until its first deletion."""

    folder: str
    buckets: int
    returns: bool = False
    batches: dict[int, str] = field(default_factory=dict)

    @classmethod
    def new(cls, spark: SparkSession, folder: str | None = None, returns: bool = False, buckets: int | None = None) -> OrphanState:
        """An empty state; as many buckets as shuffle partitions, so that what a join
        puts into one task lies in one bucket."""
        return cls(folder or new_path(spark, "orphans"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), returns)

    def path(self, name: str) -> str:
        return f"{self.folder}/part={name}"

    def log(self, spark: SparkSession, log: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a log, of the given buckets or of all."""
        paths = [self.path(name) for _, name in sorted(self.batches.items())]
        rows = spark.read.schema(_DDL).option("basePath", self.folder).parquet(*paths) if paths else spark.createDataFrame([], _DDL)
        rows = rows.filter(F.col("log") == log) if buckets is None or len(buckets) >= self.buckets else rows.filter((F.col("log") == log) & F.col("bucket").isin(buckets))
        return rows.select(*_KEY, *_LOGS[log], "v", "bucket")

    def write(self, name: str, v: int, index: DataFrame, references: DataFrame) -> None:
        """Writes both parts of a batch at once."""

        def shaped(df: DataFrame, log: str) -> DataFrame:
            have = {*_KEY, *_LOGS[log]}
            columns = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in _COLUMNS.items() if c != "v"]
            return df.select(*columns, F.lit(v).alias("v"), F.lit(log).alias("log"), _bucket(self.buckets).alias("bucket"))

        shaped(index, "index").unionByName(shaped(references, "references")).write.mode("overwrite").partitionBy("log", "bucket").parquet(self.path(name))


#: The key by whose columns everything is shuffled; null is a table too.
_JOIN = ("target_kind", "_table", "_none", "target_id")


def _with_join_key(df: DataFrame) -> DataFrame:
    return df.withColumns({"_table": F.coalesce("table_uuid", F.lit("")), "_none": F.col("table_uuid").isNull()})


def _bucket(n: int) -> Column:
    """By the columns, and in the order, of the shuffles, so that a task's keys lie in few buckets."""
    return F.pmod(F.hash("target_kind", F.coalesce("table_uuid", F.lit("")), F.col("table_uuid").isNull(), "target_id"), F.lit(n)).cast("int")


_EVENTS = "array<struct<at:timestamp_ntz,there:boolean>>"


def _batch_index(parents: DataFrame, returns: bool) -> DataFrame:
    """What a batch of parents adds to the index: (key, arrived, deleted, times)."""
    none = F.lit(None)
    if not returns:
        least = _with_join_key(parents).groupBy(*_JOIN).agg(F.max("table_uuid").alias("table_uuid"), F.min("arrived").alias("arrived"), F.min("deleted").alias("deleted"))
        return least.select(*_KEY, "arrived", "deleted", none.cast(_EVENTS).alias("times"))
    moves = F.explode(F.array(F.struct(F.col("arrived").alias("at"), F.lit(True).alias("there")), F.struct(F.col("deleted").alias("at"), F.lit(False).alias("there"))))
    events = parents.select(*_KEY, moves.alias("e")).filter(F.col("e.at").isNotNull()).select(*_KEY, "e.at", "e.there").distinct()
    times = _turns(events, keep_first=True).groupBy(*_KEY).agg(F.collect_list(F.struct("at", "there")).alias("times"))
    return times.select(*_KEY, none.cast("timestamp_ntz").alias("arrived"), none.cast("timestamp_ntz").alias("deleted"), "times")


def _turns(events: DataFrame, keep_first: bool = False) -> DataFrame:
    """Of the events (key, at, there) of each key those that change whether it is there; a
    deletion at the time of an arrival goes first. No key is gathered before that."""
    before = with_previous(events.withColumn("key", F.struct(*_KEY)), "key", ["at", "there"], "there", "before")
    first = F.col("before").isNull() if keep_first else F.lit(False)
    return before.filter(first | (F.col("there") != F.coalesce("before", F.lit(False)))).drop("key", "before")


def _index(log: DataFrame, v: int, returns: bool) -> DataFrame:
    """(_JOIN, times, changed) of each key of an index log: when it is there, and whether
    batch v has changed that."""
    rows = _with_join_key(log)
    if returns:
        events = log.select(*_KEY, F.explode("times").alias("e")).select(*_KEY, "e.at", "e.there").distinct()
        times = _with_join_key(_turns(events)).groupBy(*_JOIN).agg(F.array_sort(F.collect_list(F.struct("at", "there"))).alias("times"))
        new = rows.filter(F.col("v") == v).select(*_JOIN, F.lit(True).alias("changed")).distinct()
        return times.join(new, list(_JOIN), "full").withColumn("changed", F.coalesce("changed", F.lit(False)))
    old = lambda c: F.min(F.when(F.col("v") < v, F.col(c)))
    least = rows.groupBy(*_JOIN).agg(F.min("arrived").alias("arrived"), F.min("deleted").alias("deleted"), old("arrived").alias("old_a"), old("deleted").alias("old_d"))
    changed = ~(F.col("arrived").eqNullSafe(F.col("old_a")) & F.col("deleted").eqNullSafe(F.col("old_d")))
    lives = F.col("arrived").isNotNull() & (F.col("deleted").isNull() | (F.col("arrived") < F.col("deleted")))
    event = lambda at, there: F.struct(F.col(at).alias("at"), F.lit(there).alias("there"))
    times = F.when(lives & F.col("deleted").isNull(), F.array(event("arrived", True))).when(lives, F.array(event("arrived", True), event("deleted", False)))
    return least.select(*_JOIN, times.alias("times"), changed.alias("changed"))


def _moves(seen: Column, times: Column) -> Column:
    """What happens to a reference first seen at a time: opened where its target is not
    there then; afterwards resolved and reopened as the target comes and goes."""
    times = F.coalesce(times, F.array().cast("array<struct<at:timestamp_ntz,there:boolean>>"))
    past = F.filter(times, lambda e: e["at"] <= seen)
    there = F.coalesce(F.get(past, F.size(past) - 1)["there"], F.lit(False))
    later = F.transform(F.filter(times, lambda e: e["at"] > seen), lambda e: F.struct(e["at"].alias("at"), F.when(e["there"], "resolved").otherwise("reopened").alias("what")))
    return F.when(there, later).otherwise(F.concat(F.array(F.struct(seen.alias("at"), F.lit("opened").alias("what"))), later))


def step(state: OrphanState, references: DataFrame, parents: DataFrame, version: int | None = None) -> OrphanState:
    """The state after one more batch, of references (REFERENCE columns) and parents
    (PARENT columns: when one arrived, and when it was deleted, either of them null).

    A reference without target_id is none; a null table_uuid is a table of its own; a
    reference or parent delivered again changes nothing but its times (the earliest
    count). version is the batch's number, by default the next; a batch taken up again
    under its number, after a failure, replaces what it had written.
    """
    spark = references.sparkSession
    v = max(state.batches, default=-1) + 1 if version is None else version
    before = OrphanState(state.folder, state.buckets, state.returns, {n: p for n, p in state.batches.items() if n < v})
    bucket = _bucket(state.buckets)
    refs = references.select(*_ID, "first_seen").filter(F.col("target_id").isNotNull())
    parents = parents.select(*PARENT).filter(F.col("target_id").isNotNull())
    touched: list[int] | None = None
    if before.batches:
        first = refs.select(*_KEY).unionByName(parents.select(*_KEY)).select(bucket.alias("b")).take(16 * state.buckets)
        if len(first) < 16 * state.buckets:  # more keys than that are in nearly all buckets
            touched = sorted({r[0] for r in first})
    own = _batch_index(parents, state.returns)
    index = _index(before.log(spark, "index", touched).drop("bucket").unionByName(own.withColumn("v", F.lit(v))), v, state.returns)

    known = before.log(spark, "references", touched).select(*_ID, "first_seen", F.col("first_seen").alias("old_seen"), F.lit(True).alias("known"))
    both = known.unionByName(refs.withColumns({"old_seen": F.lit(None).cast("timestamp_ntz"), "known": F.lit(False)}))
    least = both.groupBy(*_ID).agg(F.min("first_seen").alias("first_seen"), F.min("old_seen").alias("old_seen"), F.max("known").alias("known"))
    probed = _with_join_key(least).join(index, list(_JOIN), "left")
    affected = probed.filter(~F.col("known") | ~F.col("first_seen").eqNullSafe(F.col("old_seen")) | F.coalesce("changed", F.lit(False)))
    seen = F.coalesce("first_seen", F.lit(_BEGIN).cast("timestamp_ntz"))
    name = f"batch-{v}"
    state.write(name, v, own, affected.select(*_ID, "first_seen", _moves(seen, F.col("times")).alias("moves")))
    return OrphanState(state.folder, state.buckets, state.returns, {**before.batches, v: name})


def compact(spark: SparkSession, state: OrphanState) -> OrphanState:
    """The state with its logs in one, under the number of its last batch."""
    if len(state.batches) < 2:
        return state
    v = max(state.batches)
    name = f"whole-{v}"
    rows = state.log(spark, "index")
    if state.returns:
        events = rows.select(*_KEY, F.explode("times").alias("e")).select(*_KEY, "e.at", "e.there").distinct()
        whole = _turns(events).groupBy(*_KEY).agg(F.collect_list(F.struct("at", "there")).alias("times")).withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("arrived", "deleted")})
    else:
        whole = rows.groupBy(*_KEY).agg(F.min("arrived").alias("arrived"), F.min("deleted").alias("deleted")).withColumn("times", F.lit(None).cast(_EVENTS))
    state.write(name, v, whole, references(spark, state))
    return OrphanState(state.folder, state.buckets, state.returns, {v: name})


def drop(spark: SparkSession, state: OrphanState, *names: str) -> None:
    """Deletes parts of the logs; all of the state where none are named."""
    for path in [state.path(name) for name in names] or [state.folder]:
        drop_table(spark, path)


# ---------------------------------------------------------------- what the state tells


def references(spark: SparkSession, state: OrphanState) -> DataFrame:
    """(ref_kind, record_key, target_kind, table_uuid, target_id, first_seen, moves) of
    each reference, as its last batch left it. moves are in order of time: opened (it
    arrived while its target was not there), resolved (the target has arrived),
    reopened (the target has been deleted). A target is there from its arrival
    (inclusive) until its deletion (exclusive). A reference without a known time
    counts as first of all."""
    rows = state.log(spark, "references")
    if len(state.batches) < 2:
        return rows.select(*_ID, "first_seen", "moves")
    return rows.groupBy(*_ID).agg(F.max(F.struct("v", "first_seen", "moves")).alias("m")).select(*_ID, "m.first_seen", "m.moves")


def pending(spark: SparkSession, state: OrphanState) -> DataFrame:
    """The references that wait for their target at the end."""
    return references(spark, state).filter((F.size("moves") > 0) & (F.element_at("moves", -1)["what"] != "resolved"))


def orphans_on_arrival(spark: SparkSession, state: OrphanState) -> DataFrame:
    """The references whose target was not there when they first arrived."""
    opened = (F.size("moves") > 0) & (F.get("moves", F.lit(0))["what"] == "opened")
    return references(spark, state).filter(opened).select("ref_kind", "table_uuid", "record_key", "target_id")


def open_counts(spark: SparkSession, state: OrphanState, period: str = "month") -> DataFrame:
    """(ref_kind, table_uuid, period, opened, resolved, reopened, open_at_end): the
    periodic snapshot of counts per table, for each period with an event."""
    events = references(spark, state).select("ref_kind", "table_uuid", F.explode("moves").alias("m"))
    n = lambda what: F.count(F.when(F.col("m.what") == what, 1)).alias(what)
    counts = events.groupBy("ref_kind", "table_uuid", F.date_trunc(period, F.col("m.at")).cast("timestamp_ntz").alias("period")).agg(n("opened"), n("resolved"), n("reopened"))
    so_far = Window.partitionBy("ref_kind", "table_uuid").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)  # one row a period
    return counts.withColumn("open_at_end", F.sum(F.col("opened") - F.col("resolved") + F.col("reopened")).over(so_far))


def in_batches(references: DataFrame, parents: DataFrame, n: int) -> list[tuple[DataFrame, DataFrame]]:
    """References and parents, written in n batches by the time at which they came: equal
    spans from the first to the last time. An arrival and a deletion are two events. What
    has no time is in the first batch."""
    ends = references.select(F.min("first_seen").alias("a"), F.max("first_seen").alias("z")).unionByName(parents.select(F.min("arrived").alias("a"), F.max(F.greatest("arrived", "deleted")).alias("z")))
    row = ends.agg(F.min("a"), F.max("z")).first()
    if n < 2 or row[0] is None or row[1] is None or row[0] == row[1]:
        return [(references, parents)]
    cuts = [F.lit((row[0] + (row[1] - row[0]) * i / n).isoformat(" ")).cast("timestamp_ntz") for i in range(1, n)]
    number = lambda at: reduce(lambda a, b: a + b, (F.coalesce((at >= cut).cast("int"), F.lit(0)) for cut in cuts))
    none = F.lit(None).cast("timestamp_ntz")
    event = lambda arrived, deleted: F.struct(arrived.alias("arrived"), deleted.alias("deleted"), number(F.coalesce(arrived, deleted)).alias("batch"))
    events = F.filter(F.array(event(F.col("arrived"), none), event(none, F.col("deleted"))), lambda e: e["arrived"].isNotNull() | e["deleted"].isNotNull())
    refs = references.select(*REFERENCE, number(F.col("first_seen")).alias("batch"))
    moves = parents.select("target_kind", "table_uuid", "target_id", F.explode(events).alias("e")).select("target_kind", "table_uuid", "target_id", "e.arrived", "e.deleted", "e.batch")
    out = []
    for df in (refs, moves):
        path = new_path(df.sparkSession, "arrivals")
        df.write.partitionBy("batch").parquet(path)
        out.append(df.sparkSession.read.schema(df.schema).parquet(path))
    return [tuple(df.filter(F.col("batch") == i).drop("batch") for df in out) for i in range(n)]


# ---------------------------------------------------------------- the tables of this project


def _ntz(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz")


def metadata_batch(table_metadata: DataFrame, snapshots: DataFrame, schema_fields: DataFrame, partition_fields: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, parents) of the metadata tables: current_schema_id,
    current_snapshot_id (null and -1 are none), source_id and refs.snapshot_id
    against schemas, snapshots and fields (ids inside types count)."""
    from tablelens.operators.drift import flatten_fields

    table_metadata = exact(table_metadata, "table_uuid", "metadata_file", "delivered_at", "current_schema_id", "current_snapshot_id")
    snapshots = exact(snapshots, "table_uuid", "snapshot_id", "loaded_at", "expired_at")
    schema_fields = exact(schema_fields, "table_uuid", "schema_id", "id", "field_type", "loaded_at")
    partition_fields = exact(partition_fields, "table_uuid", "spec_id", "source_id", "field_id", "loaded_at")
    refs = exact(refs, "table_uuid", "ref_name", "snapshot_id", "loaded_at")

    def ref(df: DataFrame, kind: str, key: Column, target_kind: str, target: str, at: str) -> DataFrame:
        return df.select(F.lit(kind).alias("ref_kind"), "table_uuid", key.alias("record_key"), F.lit(target_kind).alias("target_kind"), F.col(target).cast("bigint").alias("target_id"), _ntz(at).alias("first_seen"))

    both = F.explode(F.array(
        F.struct(F.lit("current_schema_id").alias("k"), F.lit("schema").alias("t"), F.col("current_schema_id").cast("bigint").alias("i")),
        F.struct(F.lit("current_snapshot_id").alias("k"), F.lit("snapshot").alias("t"), F.expr("nullif(current_snapshot_id, -1)").alias("i")),
    ))
    current = table_metadata.select("table_uuid", "metadata_file", _ntz("delivered_at").alias("at"), both.alias("b"))
    references = current.select(F.col("b.k").alias("ref_kind"), "table_uuid", F.col("metadata_file").alias("record_key"), F.col("b.t").alias("target_kind"), F.col("b.i").alias("target_id"), F.col("at").alias("first_seen"))
    references = references.unionByName(ref(partition_fields, "source_id", F.concat_ws("/", "spec_id", "field_id"), "field", "source_id", "loaded_at"))
    references = references.unionByName(ref(refs, "ref_snapshot_id", F.col("ref_name"), "snapshot", "snapshot_id", "loaded_at"))

    never = F.lit(None).cast("timestamp_ntz")
    parents = snapshots.select(F.lit("snapshot").alias("target_kind"), "table_uuid", F.col("snapshot_id").cast("bigint").alias("target_id"), _ntz("loaded_at").alias("arrived"), _ntz("expired_at").alias("deleted"))
    fields = schema_fields.select("table_uuid", "schema_id", "id", "field_type", _ntz("loaded_at").alias("loaded_at"))
    schemas = fields.select(F.lit("schema").alias("target_kind"), "table_uuid", F.col("schema_id").cast("bigint").alias("target_id"), F.col("loaded_at").alias("arrived"), never.alias("deleted"))
    forms = fields.groupBy("table_uuid", "id", "field_type").agg(F.min("loaded_at").alias("loaded_at")).select("table_uuid", F.lit(0).alias("schema_id"), F.col("id").cast("int").alias("id"), F.lit("").alias("name"), "field_type", "loaded_at")
    inner = flatten_fields(forms).select(F.lit("field").alias("target_kind"), "table_uuid", F.col("id").cast("bigint").alias("target_id"), F.col("loaded_at").alias("arrived"), never.alias("deleted"))
    inner = materialize(inner, "fields")  # types are read once, however many batches follow
    return references, parents.unionByName(schemas).unionByName(inner)
