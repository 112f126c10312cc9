"""Orphan references: state, batches, salting and the stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablelens.operators.orphans import OrphanState, compact, in_batches, metadata_batch, open_counts, orphans_on_arrival, pending, references, step
from tablelens.streaming.activity import activity
from tablelens.streaming.orphan_stream import ARRIVALS, OrphanTracker

REF = "ref_kind string, table_uuid string, record_key string, target_kind string, target_id bigint, first_seen timestamp_ntz"
PAR = "target_kind string, table_uuid string, target_id bigint, arrived timestamp_ntz, deleted timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def random_batch(seed, n=300):
    rng = random.Random(seed)
    table = lambda: rng.choice(["a", "a", "a", "b", None])
    refs = [("k", table(), f"r{rng.randint(0, 150)}", "s", rng.choice([7, 7, 7, *range(20), None]), day(rng.randint(0, 90))) for _ in range(n)]
    parents = [("s", table(), rng.randint(0, 15), day(rng.choice([None, *range(90)])), day(rng.choice([None, None, *range(90)]))) for _ in range(n // 4)]
    return refs, parents


def brute(refs, parents):
    index, seen = {}, {}
    for k, t, i, a, d in parents:
        old = index.get((k, t, i), (None, None))
        index[(k, t, i)] = tuple(min([x for x in pair if x is not None], default=None) for pair in zip(old, (a, d)))
    for kind, t, key, k, i, at in refs:
        if i is not None:
            seen[(kind, t, key, k, i)] = min(at, seen.get((kind, t, key, k, i), at))
    out = {}
    for (kind, t, key, k, i), at in seen.items():
        a, d = index.get((k, t, i), (None, None))
        lives = a is not None and (d is None or a < d)
        there = lives and a <= at and (d is None or at < d)
        resolved = a if lives and not there and a > at else None
        out[(kind, t, key, i)] = (None if there else at, resolved, d if there or resolved else None)
    return out


def frames(spark, refs, parents):
    return spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR)


def lived(spark, state):
    out = {}
    for r in references(spark, state).collect():
        at = {m["what"]: m["at"] for m in r["moves"]}
        assert len(at) == len(r["moves"])
        out[(r["ref_kind"], r["table_uuid"], r["record_key"], r["target_id"])] = (at.get("opened"), at.get("resolved"), at.get("reopened"))
    return out


def test_lifecycles(spark):
    refs, parents = random_batch(1)
    want = brute(refs, parents)
    whole = step(OrphanState.new(spark), *frames(spark, refs, parents))
    several = OrphanState.new(spark)
    batches = in_batches(*frames(spark, refs, parents), 4)
    assert len(batches) == 4
    for batch in batches:
        several = step(several, *batch)
    for state in (whole, several, compact(spark, several)):
        assert lived(spark, state) == want
        assert {tuple(r) for r in orphans_on_arrival(spark, state).collect()} == {k for k, v in want.items() if v[0] is not None}
        open_ = sum((v[0] is not None) - (v[1] is not None) + (v[2] is not None) for v in want.values())
        n = sum(r["open_at_end"] for r in open_counts(spark, state).groupBy("ref_kind", "table_uuid").agg(F.max_by("open_at_end", "period").alias("open_at_end")).collect())
        assert n == open_ == pending(spark, state).count()


def test_batches_in_any_order_give_the_same(spark):
    refs, parents = random_batch(2, 120)
    want = brute(refs, parents)
    for seed in (0, 1):
        rng = random.Random(seed)
        r, p = rng.sample(refs, len(refs)), rng.sample(parents, len(parents))
        state = OrphanState.new(spark)
        for i in range(3):
            state = step(state, *frames(spark, r[i::3], p[i::3]))
        assert lived(spark, state) == want


def test_a_batch_writes_what_it_touches(spark):
    refs = [("k", "t", f"r{i}", "s", i, day(5)) for i in range(2000)]
    parents = [("s", "t", i, day(1), None) for i in range(0, 2000, 2)]
    state = step(OrphanState.new(spark, buckets=64), *frames(spark, refs, parents))
    state = step(state, *frames(spark, [("k", "t", "r1", "s", 1, day(6)), ("k", "t", "new", "s", 2, day(6))], [("s", "t", 3, day(7), None), ("s", "t", 4, None, day(8))]))
    part = OrphanState(state.folder, 64, False, {1: state.batches[1]})
    assert sorted((r["record_key"], [m["what"] for m in r["moves"]]) for r in part.log(spark, "references").collect()) == [("new", []), ("r3", ["opened", "resolved"]), ("r4", ["reopened"])]
    assert part.log(spark, "index").count() == 2
    touched = state.log(spark, "references", [0, 1])
    assert "bucket#" in touched._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert pending(spark, state).count() == 1000 and references(spark, state).count() == 2001


@pytest.mark.parametrize("split", [1, 4])
def test_parents_that_return(spark, split):
    refs = [("k", "t", f"r{n}", "s", 1, day(n)) for n in (0, 31, 45, 60, 200)] + [("k", None, "x", "s", 1, day(3))]
    parents = [("s", "t", 1, day(10), None), ("s", "t", 1, None, day(31)), ("s", "t", 1, day(60), None), ("s", "t", 1, day(12), None), ("s", "t", 1, None, day(90)), ("s", "t", 1, day(90), None), ("s", None, 1, None, day(1))]
    state = OrphanState.new(spark, returns=True)
    for batch in in_batches(*frames(spark, refs, parents), split):
        state = step(state, *batch)
    got = {r["record_key"]: [((m["at"] - T0).days, m["what"]) for m in r["moves"]] for r in references(spark, state).collect()}
    tail = [(90, "reopened"), (90, "resolved")]
    assert got == {
        "r0": [(0, "opened"), (10, "resolved"), (31, "reopened"), (60, "resolved"), *tail], "r31": [(31, "opened"), (60, "resolved"), *tail],
        "r45": [(45, "opened"), (60, "resolved"), *tail], "r60": tail, "r200": [], "x": [(3, "opened")],
    }
    assert lived(spark, step(OrphanState.new(spark), *frames(spark, refs, parents)))["k", "t", "r45", 1] == (day(45), None, None)


def test_stream(spark, tmp_path):
    refs, parents = random_batch(3, 90)
    want = brute(refs, parents)
    rows = [(True, *r, None, None) for r in refs] + [(False, None, t, None, k, i, None, a, d) for k, t, i, a, d in parents]
    for i in range(5):
        spark.createDataFrame(rows[i::5], ARRIVALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tracker = OrphanTracker(spark, str(tmp_path / "state"), compact_every=2)
    stream = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = tracker.start(stream, str(tmp_path / "checkpoint"))
    query.awaitTermination(240)
    last = query.lastProgress["batchId"]
    assert last == 4 and lived(spark, tracker.state(last)) == want
    again = spark.createDataFrame(rows[4::5], ARRIVALS)
    tracker.step(again, 4)
    assert lived(spark, tracker.state(4)) == want


def test_activity_stream_and_table_agree(spark, tmp_path):
    rows = [(T0 + dt.timedelta(hours=7 * i), "append" if i % 3 else "delete") for i in range(40)]
    df = spark.createDataFrame(rows, "loaded_at timestamp_ntz, operation string")
    df.write.parquet(str(tmp_path / "in"))
    query = activity(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("activity").collect())) == sorted(map(tuple, activity(df).collect()))


def test_tables_of_metadata(spark):
    md = spark.createDataFrame([("a", "f1", day(5), 0, 11), ("a", "f2", day(5), 3, -1), ("a", "f3", day(5), 0, None), ("a", "f4", day(1), 0, 12)], "table_uuid string, metadata_file string, delivered_at timestamp_ntz, current_schema_id int, current_snapshot_id bigint")
    snaps = spark.createDataFrame([("a", 11, day(3), None), ("a", 11, day(4), day(5)), ("a", 12, day(1), day(9))], "table_uuid string, snapshot_id bigint, loaded_at timestamp_ntz, expired_at timestamp_ntz")
    fields = spark.createDataFrame([("a", 0, 1, "list", day(2)), ("a", 0, 2, '{"type":"list","element-id":9,"element-required":true,"element":"int"}', day(2))], "table_uuid string, schema_id int, id int, field_type string, loaded_at timestamp_ntz").withColumn("name", F.lit("n"))
    parts = spark.createDataFrame([("a", 0, 9, 1000, day(2)), ("a", 0, 8, 1001, day(2)), ("a", 1, 1, 1002, day(1))], "table_uuid string, spec_id int, source_id int, field_id int, loaded_at timestamp_ntz")
    refs = spark.createDataFrame([("a", "main", 12, day(8)), ("a", "main", 99, day(8)), ("a", "tag", 12, day(9))], "table_uuid string, ref_name string, snapshot_id bigint, loaded_at timestamp_ntz")
    state = step(OrphanState.new(spark), *metadata_batch(md, snaps, fields, parts, refs))
    assert sorted((r["ref_kind"], r["record_key"], r["target_id"]) for r in orphans_on_arrival(spark, state).collect()) == [
        ("current_schema_id", "f2", 3), ("current_schema_id", "f4", 0), ("current_snapshot_id", "f1", 11),
        ("ref_snapshot_id", "main", 99), ("ref_snapshot_id", "tag", 12), ("source_id", "0/1001", 8), ("source_id", "1/1002", 1),
    ]
    empty = [x.limit(0) for x in (md, snaps, fields, parts, refs)]
    assert orphans_on_arrival(spark, step(OrphanState.new(spark), *metadata_batch(*empty))).count() == 0
    clashing = [x.withColumns({c: F.lit(1) for c in ("target_kind", "hk", "salt", "arrived", "b")}) for x in (md, snaps, fields, parts, refs)]
    assert orphans_on_arrival(spark, step(OrphanState.new(spark), *metadata_batch(*clashing))).count() == 7
