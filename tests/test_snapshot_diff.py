"""Differences of full snapshots against a comparison of whole maps."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablelens.operators import snapshot_diff
from tablelens.operators.snapshot_diff import cut, snapshot_changes, unmatched

SCHEMA = "table_uuid string, metadata_file string, delivered_at timestamp_ntz, last_updated_ms bigint, properties map<string,string>, metadata_log array<struct<metadata_file string, timestamp_ms bigint>>"
T0 = dt.datetime(2024, 1, 1)


def brute(rows):
    files = {}
    for t, f, at, ms, props, log in rows:
        if t is None or f is None:
            continue
        if (t, f) not in files or (at or dt.datetime.min) > (files[(t, f)][0] or dt.datetime.min):
            files[(t, f)] = (at, ms or 0, props or {}, {e[0]: e[1] for e in log or [] if e and e[0] is not None})
    out = set()
    by_table = {}
    for (t, f), v in files.items():
        by_table.setdefault(t, []).append((v[1], f, v))
    for t, versions in by_table.items():
        versions.sort(key=lambda v: v[:2])
        for (_, _, old), (_, f, new) in zip(versions, versions[1:]):
            for kind, a, b in (("property", old[2], new[2]), ("log", old[3], new[3])):
                for k in a.keys() | b.keys():
                    if k not in a:
                        out.add((t, f, kind, k, "added"))
                    elif k not in b:
                        out.add((t, f, kind, k, "removed"))
                    elif a[k] != b[k]:
                        out.add((t, f, kind, k, "changed"))
    return out


def random_rows(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for t in ("a", "b", "c"):
        props = {f"key{i}": str(i) for i in range(60 if t == "a" else 5)}
        log = []
        for v in range(n if t == "a" else 8):
            for _ in range(rng.randint(0, 3)):
                k = f"key{rng.randint(0, 70)}"
                rng.choice([lambda: props.pop(k, None), lambda: props.__setitem__(k, rng.choice([None, "", "x", "é🙂"])), lambda: props.__setitem__(k, str(rng.random()))])()
            log = [*log[-30:], (f"file{v}", rng.choice([v, v, None]))]
            ms = v * rng.choice([10**6, 10**8, 0])
            row = (t, f"f{v:03d}", T0 + dt.timedelta(days=v), ms, dict(props) if rng.random() > 0.1 else None, list(log) if rng.random() > 0.1 else None)
            rows.append(row)
            if rng.random() < 0.2:
                rows.append((t, row[1], T0 - dt.timedelta(days=1), ms, {"old": "1"}, None))
                rows.append(row)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_changes(spark, seed):
    rows = random_rows(seed)
    got = [tuple(r)[:5] for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_equal_chunks_are_discarded():
    big = {f"key{i}": "v" for i in range(2000)}
    keys = pa.array([*big, *big, "new"])
    vals = pa.array(["w" if i == 500 else "v" for i in range(2000)] + ["v"] * 2001)
    chunks = cut(np.repeat([0, 1], [2000, 2001]), keys, vals)
    assert len(chunks.start) > 800
    _, _, left = unmatched(chunks, np.array([-1, 0]), np.array([0, -1]))
    assert (chunks.end - chunks.start)[left].sum() < 60  # of 4001 records, those of the chunks that changed


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_partitions_and_odd_files(spark, monkeypatch, parts):
    """Boundaries between partitions anywhere; a file sent with two times; hot files."""
    monkeypatch.setattr(snapshot_diff, "HOT_DELIVERIES", 2)
    rows = random_rows(7)
    again = [(t, f, at + dt.timedelta(days=400), ms + 10**10, {"late": "1"}, log) for t, f, at, ms, _, log in rows[:6]]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(r)[:5] for r in snapshot_changes(spark.createDataFrame(rows + again, SCHEMA)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == len(set(got)) and set(got) == brute(rows + again)


def test_edges(spark):
    assert snapshot_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "f", T0, 1, {"a": "1"}, None), ("a", None, T0, 1, {"a": "1"}, None), ("a", "f1", None, None, {"a": None, "": "x"}, [None, (None, 4), ("l", 1), ("l", 2)]), ("a", "f2", None, 5, {"a": "", "": "x" * 100_000}, [("l", 2)])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("file", "fid", "s", "o", "ms", "kind")})
    got = {tuple(r)[:5] for r in snapshot_changes(df).collect()}
    assert got == {("a", "f2", "property", "a", "changed"), ("a", "f2", "property", "", "changed")}
