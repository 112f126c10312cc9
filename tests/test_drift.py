"""Schema drift: changes, the fused shape, and rows in it."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablelens.operators import drift
from tablelens.operators.fieldtree import walk

SCHEMA = "table_uuid string, schema_id int, pos int, id int, name string, required boolean, field_type string, doc string, loaded_at timestamp_ntz"
ROWS = "row_id bigint, table_uuid string, schema_id int, payload string"
T0 = dt.datetime(2024, 1, 1)


def row(t, s, i, name, kind, day=0):
    return (t, s, 0, i, name, True, kind, None, T0 + dt.timedelta(days=day))


def schemas_of(rows):
    best = {}
    for t, s, _, i, name, _, kind, _, at in rows:
        if t is None or s is None or i is None:
            continue
        key = (at is not None, at or T0, name is not None, name or "", kind is not None, kind or "")
        if (t, s, i) not in best or key > best[(t, s, i)][0]:
            best[(t, s, i)] = (key, name, kind, at)
    schemas = {}
    for (t, s, i), (_, name, kind, at) in best.items():
        fields = [(i, name, plain(kind))] + [(f, n, g) for f, _, n, g in walk(kind or "")]
        for f, n, g in fields:
            schemas.setdefault(t, {}).setdefault(s, {})[f] = (n, g)
    return schemas


def brute(rows):
    out = []
    for t, by in schemas_of(rows).items():
        order = sorted(by)
        for a, b in zip(order, order[1:]):
            for f in by[a].keys() | by[b].keys():
                old, new = by[a].get(f), by[b].get(f)
                if old is None:
                    out.append((t, a, b, f, "added"))
                elif new is None:
                    out.append((t, a, b, f, "removed"))
                else:
                    out += [(t, a, b, f, "renamed")] if old[0] != new[0] else []
                    out += [(t, a, b, f, "type_changed")] if old[1] != new[1] else []
    return sorted(out, key=str)


def plain(kind):
    if kind is None:
        return None
    if kind.lstrip().startswith("{"):
        return json.loads(kind)["type"].lower()
    low = "".join(kind.split()).lower()
    return "timestampz" if low == "timestamptz" else low


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for t in ("a", "b", None):
        shape = {i: [f"n{i}", "int"] for i in range(1, 5)}
        for s in sorted(rng.sample(range(-3, 40), 14)):
            for i in list(shape):
                if rng.random() < 0.2:
                    shape[i][0] += "x"
                if rng.random() < 0.2:
                    base = 100 + i * 10
                    shape[i][1] = rng.choice(["long", " LONG ", "timestamptz", "Timestampz", f'{{"type": "list", "element-id": {base}, "element-required": true, "element": "{rng.choice(["int", "INT", "string"])}"}}', f'{{"type":"struct","fields":[{{"id":{base + 1},"name":"{rng.choice("uv")}","required":true,"field_type":"int"}}]}}', f'{{"type":"map","key-id":{base + 2},"key":"string","value-id":{base + 3},"value-required":false,"value":{{"type":"list","element-id":{base + 4},"element-required":false,"element":"uuid"}}}}'])
                if rng.random() < 0.1:
                    del shape[i]
            if rng.random() < 0.3:
                shape[len(shape) + 20 + s] = ["new", "date"]
            for i, (n, k) in shape.items():
                rows.append(row(t, s, i, n, k, rng.randint(0, 3)))
                if rng.random() < 0.1:
                    rows.append(rows[-1])
                if rng.random() < 0.1:
                    rows.append(row(t, s, i, n + "old", k, -1))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,parts,hot", [(1, 1, 10**5), (2, 4, 2), (3, 60, 10**5)])
def test_changes(spark, monkeypatch, seed, parts, hot):
    monkeypatch.setattr(drift, "HOT_ROWS", hot)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = random_rows(seed)
    got = drift.schema_changes(spark.createDataFrame(rows, SCHEMA)).collect()
    shape = {(r["table_uuid"], r["id"]): r for r in drift.fused_schema(spark.createDataFrame(rows, SCHEMA)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    forms = {}
    for t, by in schemas_of(rows).items():
        for s, fields in by.items():
            for i, form in fields.items():
                forms.setdefault((t, i), {}).setdefault(form, []).append(s)
    assert {k: sorted(map(str, ((a["name"], a["tag"], a["first"], a["last"], a["schemas"]) for a in r["alternatives"]))) for k, r in shape.items()} == {k: sorted(map(str, ((*f, min(x), max(x), len(x)) for f, x in v.items()))) for k, v in forms.items()}


def test_fused_schema(spark):
    rows = [row("a", 0, 1, "n", "int"), row("a", 1, 1, "m", "long"), row("a", 2, 1, "m", "LONG "), row("a", 2, 2, "d", "date"), row("a", 3, 2, "d", "timestamp"), row("a", 3, 3, "x", "decimal(9,2)"), row("a", 4, 3, "x", "uuid")]
    got = {r["id"]: r for r in drift.fused_schema(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: (r["name"], r["canonical_type"]) for i, r in got.items()} == {1: ("m", "long"), 2: ("d", "timestamp"), 3: ("x", "string")}
    assert [tuple(a) for a in got[1]["alternatives"]] == [(0, 0, "n", "int", 1), (1, 2, "m", "long", 2)]


def test_rows_in_one_shape(spark):
    fields = [row("a", 0, 1, "n", "int"), row("a", 1, 1, "m", "long"), row("a", 1, 2, "s", "string"), row("a", 0, 3, "k", "struct")]
    rows = [(1, "a", 0, '{"n": "7", "zz": 1}'), (2, "a", 1, '{"m": 9007199254740993, "s": null}'), (3, "a", 0, '{"n": "x", "k": {"b": 1.50}}'), (4, "a", 0, "{"), (5, "z", 0, '{"q": [1]}'), (6, "a", None, None), (7, "a", 0, "[1]"), (8, "a", 0, None)]
    got = {r["row_id"]: r for r in drift.unify_rows(spark.createDataFrame(rows, ROWS).withColumn("shape", F.lit(1)), spark.createDataFrame(fields, SCHEMA)).collect()}
    short = {i: [(f["id"], f["name"], f["branch"], f["value"], f["state"]) for f in r["fields"] or []] for i, r in got.items()}
    assert short[1] == [(1, "m", "int", "7", "ok"), (2, "s", None, None, "absent"), (3, "k", "struct", None, "missing")] and got[1]["rest"] == {"zz": "1"}
    assert short[2] == [(1, "m", "long", "9007199254740993", "ok"), (2, "s", "string", None, "null"), (3, "k", None, None, "absent")]
    assert short[3][0] == (1, "m", "int", "x", "misfit") and short[3][2] == (3, "k", "struct", '{"b":1.5}', "ok")
    assert {s for *_, s in short[4]} == {"unreadable"} and short[5] == [] and short[6] == []
    assert {s for *_, s in short[7]} == {"unreadable"} and {s for *_, s in short[8]} == {"missing", "absent"}
    assert len(got) == 8 and got[5]["rest"] == {"q": "[1]"}


def test_rows_in_one_shape_inside(spark):
    old = '{"type": "struct", "fields": [{"id": 11, "name": "lot", "field_type": "int"}, {"id": 12, "name": "price", "field_type": "decimal(38,20)"}, {"id": 13, "name": "tags", "field_type": {"type": "list", "element-id": 14, "element": {"type": "struct", "fields": [{"id": 15, "name": "a", "type": "int"}]}}}]}'
    new = '{"type": "struct", "fields": [{"id": 16, "name": "lot", "field_type": "date"}, {"id": 11, "name": "batch", "field_type": "long"}, {"id": 12, "name": "price", "field_type": "decimal(38,20)"}, {"id": 13, "name": "tags", "field_type": {"type": "list", "element-id": 14, "element": {"type": "struct", "fields": [{"id": 15, "name": "b", "type": "long"}]}}}]}'
    sums = '{"type": "map", "key-id": 21, "key": "int", "value-id": 22, "value": "%s"}'
    fields = [row("a", 0, 1, "s", old), row("a", 1, 1, "t", new), row("a", 0, 2, "m", sums % "float"), row("a", 1, 2, "m", sums % "double")]
    payloads = ['{"s": {"lot": "14", "price": 0.12345678901234567890, "tags": [{"a": "7"}, null, 3], "batch": 1.10}, "m": {"07": "2.5", "x": 1}}', '{"t": {"lot": "2024-01-01", "batch": 15}, "m": [1]}']
    got = drift.unify_rows(spark.createDataFrame([(k, "a", k, p) for k, p in enumerate(payloads)], ROWS), spark.createDataFrame(fields, SCHEMA)).orderBy("row_id").collect()
    values = [{f["name"]: (f["value"], f["state"]) for f in r["fields"]} for r in got]
    assert values[0]["t"] == ('{"batch":14,"batch#":1.1,"lot":null,"price":"0.12345678901234567890","tags":[{"b":7},null,3]}', "ok")
    assert values[0]["m"] == ('{"7":2.5,"x":1.0}', "ok")
    assert values[1] == {"t": ('{"batch":15,"lot":"2024-01-01","price":null,"tags":null}', "ok"), "m": ("[1]", "misfit")}
    inner = [{(*f["path"], f["id"]): tuple(f)[2:] for f in r["inner"]} for r in got]
    assert inner[0]["t", "batch", 11] == ("batch", "int", "long", "14", "ok") and inner[0]["t", "lot", 16] == ("lot", None, "date", None, "absent")
    assert inner[0]["t", "tags", "0", "b", 15] == ("b", "int", "long", "7", "ok") and inner[0]["t", "tags", "2", 14] == (None, "struct", "struct", "3", "misfit")
    assert inner[0]["t", "tags", "1", 14][-1] == "null" and inner[0]["t", "batch#", None] == ("batch", None, None, "1.10", "unknown")
    assert inner[0]["m", "7", 21][-2:] == ("7", "ok") and inner[0]["m", "x", 21][-2:] == ("x", "misfit") and inner[0]["m", "7", 22] == (None, "float", "double", "2.5", "ok")
    assert inner[1]["t", "price", 12][-1] == "missing" and not any(k[0] == "m" for k in inner[1])


def test_empty_and_nulls(spark):
    assert drift.schema_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drift.unify_rows(spark.createDataFrame([], ROWS), spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None,) * 9, row("a", None, 1, "n", "int"), row("a", 0, 1, None, None), row("a", 1, 1, "n", "{broken"), row("a", 2, 1, "n", '{"type": "list"}')]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("b", "ord", "form", "block", "tag", "span")})
    got = sorted(tuple(r)[1:] for r in drift.schema_changes(df).collect())
    assert got == [(0, 1, 1, "renamed"), (0, 1, 1, "type_changed"), (1, 2, 1, "type_changed")]


@pytest.mark.parametrize(
    "value,tag,written,text",
    [
        (9007199254740993, "double", "long", None), (9007199254740992, "double", "long", "9007199254740992.0"), (Decimal("0.1"), "double", "double", "0.1"), ("0.10", "double", "decimal(9,2)", "0.1"),
        (2**31, "int", "int", None), (2**63, "long", "long", None), (Decimal("1E30"), "int", "int", None), ("7.0", "int", "int", "7"),
        ("1.5", "decimal(9,2)", None, "1.50"), ("1.50", "decimal(9,2)", None, "1.50"), ("1.505", "decimal(9,2)", None, None), ("12345678.5", "decimal(9,2)", None, None), ("-0.5", "decimal(2,2)", None, "-0.50"),
        ("1.50", "decimal", None, "1.5"), (3, "decimal", None, "3"), ("1E5", "decimal", None, "100000"), ("1E999999999", "decimal", None, None), ("0.00", "decimal", None, "0"), ("nan", "decimal", None, None),
        ("2024-02-29", "date", None, "2024-02-29"), ("2023-02-29", "date", None, None), ("not a date", "date", None, None), (20240101, "date", None, None),
        ("2024-01-01", "timestamp", "date", "2024-01-01T00:00:00"), ("2024-01-01 10:00:00.500", "timestamp", None, "2024-01-01T10:00:00.5"), ("zzz", "timestamp", None, None), ("2024-01-01T10:00:00Z", "timestamp", None, None),
        ("2024-01-01T01:00:00+02:00", "timestampz", None, "2023-12-31T23:00:00Z"), ("2024-01-01T01:00:00", "timestampz", None, None), ("9999-12-31T23:59:59-01:00", "timestampz", None, None),
        ("10:00:00.120", "time", None, "10:00:00.12"), ("25:00:00", "time", None, None), ("x", "uuid", None, None), ("F79C3E09677C4BBDA479512F87F12A34", "uuid", None, "f79c3e09-677c-4bbd-a479-512f87f12a34"),
        (True, "boolean", None, "true"), ("TRUE", "boolean", None, "true"), ("yes", "boolean", None, None), (1, "boolean", None, None), (5, "string", "int", "5"),
    ],
)
def test_canonical_values_lose_nothing(value, tag, written, text):
    got, fits = drift._canonical(value, tag, written)
    assert (got, fits) == ((str(value), False) if text is None else (text, True))
