"""Partition transforms, sort orders and pruning."""

import datetime as dt
import itertools
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.ordering import sort_for_writing
from tablelens.functions.transforms import TransformError, apply_transform, murmur3, parse_transform_columns, unscaled_bytes, with_partition_columns
from tablelens.model import PartitionField, PartitionSpec, Schema, SortField, SortOrder, StructField, Transform
from tablelens.plans.pruning import And, Compare, In, IsNull, Not, Or, StartsWith, partition_value, project, prune, to_column
from tablelens.types import Primitive, parse_primitive, spark_type_column, type_columns


def slow_murmur3(data: bytes) -> int:
    """By the published algorithm, byte by byte."""
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    h = 0
    n = len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:n]):
        k = rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    k = int.from_bytes(data[n:], "little")
    h ^= rot(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def test_murmur3():
    rng = random.Random(1)
    data = [rng.randbytes(rng.randint(0, 40)) for _ in range(500)] + [b""]
    assert murmur3(data).tolist() == [slow_murmur3(d) for d in data]
    assert murmur3([]).tolist() == []
    assert murmur3([bytes([0, 1, 2, 3])]).astype("int32").tolist() == [-188683207]
    assert unscaled_bytes(Decimal("14.20"), 2) == bytes([0x05, 0x8C]) and unscaled_bytes(Decimal("-1"), 0) == b"\xff" and unscaled_bytes(Decimal("1.28"), 2) == b"\x00\x80"


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("c", T._parse_datatype_string(kind))]))


def applied(spark, values, kind, name, arg=None):
    df = column(spark, values, kind)
    return [r[0] for r in df.select(apply_transform(Transform(name, arg), F.col("c"), df.schema["c"].dataType)).collect()]


def test_time(spark):
    n = dt.datetime
    stamps = [n(1970, 1, 1), n(1969, 12, 31, 23, 59, 59), n(2017, 11, 16, 22, 31, 8), n(9999, 12, 31, 23, 59, 59, 999999), n(1, 1, 1), None]
    assert applied(spark, stamps, "timestamp_ntz", "year") == [0, -1, 47, 8029, -1969, None]
    assert applied(spark, stamps, "timestamp_ntz", "month") == [0, -1, 574, 96359, -23628, None]
    assert applied(spark, stamps, "timestamp_ntz", "day") == [0, -1, 17486, 2932896, -719162, None]
    assert applied(spark, stamps, "timestamp_ntz", "hour") == [0, -1, 419686, 70389527, -17259888, None]
    utc = [x.replace(tzinfo=dt.UTC) if x else None for x in stamps[:3]] + [n(2024, 1, 2, 1, tzinfo=dt.UTC), None]
    assert applied(spark, utc, "timestamp", "day") == [0, -1, 17486, 19724, None]
    assert applied(spark, utc, "timestamp", "hour") == [0, -1, 419686, 473377, None]
    assert applied(spark, [dt.date(1969, 12, 31), None], "date", "month") == [-1, None]
    with pytest.raises(TransformError):
        applied(spark, [dt.date(1970, 1, 1)], "date", "hour")
    with pytest.raises(TransformError):
        applied(spark, [1], "int", "day")


def test_bucket(spark):
    big = 2**31 - 1
    assert applied(spark, [34, None], "bigint", "bucket", big) == [2017239379 % big, None]
    assert applied(spark, [34], "int", "bucket", 16) == [2017239379 % 16]
    assert applied(spark, [dt.date(2017, 11, 16)], "date", "bucket", 64) == [(-653330422 & big) % 64]
    assert applied(spark, [dt.datetime(2017, 11, 16, 22, 31, 8)], "timestamp_ntz", "bucket", 64) == [(-2047944441 & big) % 64]
    texts = ["", "a", "ab", "abc", "abcd", "naïve 🙂", "x" * 1000, *("ÿ" * (n // 2) + "~" * (n % 2) for n in range(30)), None]
    assert applied(spark, texts, "string", "bucket", 100) == [None if t is None else (slow_murmur3(t.encode()) & big) % 100 for t in texts]
    blobs = [bytearray(b"\0\1\2\3"), bytearray(b""), None]
    assert applied(spark, blobs, "binary", "bucket", 100) == [None if b is None else (slow_murmur3(bytes(b)) & big) % 100 for b in blobs]
    assert applied(spark, [Decimal("14.20"), None], "decimal(9,2)", "bucket", 100) == [(slow_murmur3(b"\x05\x8c") & big) % 100, None]
    numbers = [Decimal(s * (2**k + d)).scaleb(-3) for k in range(0, 59) for d in (-1, 0, 1) for s in (1, -1)]
    for kind in ("decimal(18,3)", "decimal(24,3)"):
        assert applied(spark, numbers, kind, "bucket", big) == [(slow_murmur3(unscaled_bytes(n, 3)) & big) % big for n in numbers]
    uuids = spark.createDataFrame([("f79c3e09-677c-4bbd-a479-3f349cb785e7",), ("none",), (None,)], "c string")
    spec = PartitionSpec(0, (PartitionField(1, 1000, "p", Transform("bucket", big)),))
    hashed = with_partition_columns(uuids, Schema(0, (StructField(1, "c", False, Primitive("uuid")),)), spec)
    assert [r["p"] for r in hashed.collect()] == [1488055340 % big, None, None]
    for kind, value in (("double", 1.0), ("boolean", True)):
        with pytest.raises(TransformError):
            applied(spark, [value], kind, "bucket", 4)
    with pytest.raises(TransformError):
        applied(spark, [1], "int", "bucket", 0)


def test_truncate_identity_void(spark):
    assert applied(spark, [1, -1, 0, 10, -10, -11, None], "int", "truncate", 10) == [0, -10, 0, 10, -10, -20, None]
    assert applied(spark, [2**62 + 7, None], "bigint", "truncate", 10) == [(2**62 + 7) // 10 * 10, None]
    assert applied(spark, [Decimal("10.65"), Decimal("-0.05")], "decimal(9,2)", "truncate", 50) == [Decimal("10.50"), Decimal("-0.50")]
    assert applied(spark, [-(2**31), 2**31 - 1, 5], "int", "truncate", 10) == [None, 2147483640, 0]
    assert applied(spark, [7, -7], "int", "truncate", 2**32 - 1) == [0, None] and applied(spark, [-(2**63)], "bigint", "truncate", 10) == [None]
    assert applied(spark, [Decimal("1.23"), Decimal("-1.23")], "decimal(3,2)", "truncate", 5000) == [Decimal("0.00"), None]
    assert applied(spark, ["abc"], "string", "truncate", 2**32 - 1) == ["abc"]
    assert applied(spark, ["iceland", "🙂🙂🙂🙂", "a", "", None], "string", "truncate", 3) == ["ice", "🙂🙂🙂", "a", "", None]
    assert applied(spark, [bytearray(b"abcd"), None], "binary", "truncate", 2) == [bytearray(b"ab"), None]
    assert applied(spark, ["a", None], "string", "identity") == ["a", None]
    assert applied(spark, ["a"], "string", "void") == [None]


def test_texts_as_columns(spark):
    rows = {"day": ("day", None), "bucket[16]": ("bucket", 16), "truncate[4294967295]": ("truncate", 2**32 - 1), "bucket[4294967296]": (None, None), "bucket": (None, None), "Day": (None, None), "day\n": (None, None), "bucket[1]\n": (None, None)}
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert {r[0]: (r[1], r[2]) for r in df.select("t", *parse_transform_columns(F.col("t"))).collect()} == rows
    kinds = {"decimal(9,2)": ("decimal", 9, 2, None, "decimal(9,2)"), "decimal(40,50)": ("decimal", 40, 50, None, None), "decimal(9,256)": (None,) * 5, "fixed[16]": ("fixed", None, None, 16, "binary"), "fixed[18446744073709551615]": ("fixed", None, None, 2**64 - 1, "binary"), "fixed[18446744073709551616]": (None,) * 5, "fixed[000000000000000000000000007]": ("fixed", None, None, 7, "binary"), "timestampz": ("timestampz", None, None, None, "timestamp"), "String": (None,) * 5, "int": ("int", None, None, None, "int")}
    df = spark.createDataFrame([(t,) for t in kinds], "t string")
    cols = type_columns(F.col("t"))
    assert {r[0]: tuple(r)[1:] for r in df.select("t", *cols.values(), spark_type_column(F.col("t"))).collect()} == kinds


SCHEMA = Schema(0, (StructField(1, "n", False, Primitive("long")), StructField(2, "s", False, Primitive("string")), StructField(3, "ts", False, Primitive("timestamp"))))
SPEC = PartitionSpec(0, tuple(PartitionField(s, 1000 + i, f"p{i}", t) for i, (s, t) in enumerate([(1, Transform("bucket", 4)), (1, Transform("truncate", 10)), (2, Transform("truncate", 2)), (3, Transform("day")), (3, Transform("hour")), (2, Transform("identity")), (1, Transform("void"))])))


def rows(spark):
    rng = random.Random(3)
    n = [None, *range(-25, 26)]
    s = [None, "", "a", "ab", "abc", "b", "ba"]
    ts = [None] + [dt.datetime(1969, 12, 30) + dt.timedelta(hours=7 * i, microseconds=i) for i in range(15)]
    return spark.createDataFrame([(rng.choice(n), rng.choice(s), rng.choice(ts)) for _ in range(300)], "n bigint, s string, ts timestamp_ntz")


def test_pruning_keeps_results(spark):
    df = with_partition_columns(rows(spark), SCHEMA, SPEC).cache()
    t = dt.datetime(1970, 1, 1, 3)
    simple = [Compare("n", op, v) for op in ("=", "!=", "<", "<=", ">", ">=") for v in (-10, 0, 7)]
    simple += [Compare("s", op, "ab") for op in ("=", "<", ">=")] + [Compare("ts", op, t) for op in ("=", "<", "<=", ">", ">=")]
    simple += [In("n", (1, 2, -10)), In("s", ("a", "abc")), IsNull("n"), IsNull("ts", True), StartsWith("s", "ab"), StartsWith("s", "a"), StartsWith("s", "abc")]
    mixed = [And((a, b)) for a, b in itertools.islice(itertools.combinations(simple, 2), 0, None, 37)] + [Or((a, b)) for a, b in itertools.islice(itertools.combinations(simple, 2), 5, None, 41)]
    everything = simple + mixed + [Not(p) for p in simple[::3] + mixed[::4]]
    flags = []
    for p in everything:
        q = project(p, SPEC, SCHEMA)
        if q is not None:
            flags.append(F.count(F.when(to_column(p) & ~F.coalesce(to_column(q), F.lit(False)), 1)))
    assert len(flags) > 40
    assert set(df.agg(*(f.alias(f"c{i}") for i, f in enumerate(flags))).first()) == {0}


LONG, INT = 2**63, 2**31
MOMENTS = [dt.datetime(1970, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 2, 29, 12), dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31, 23, 59, 59, 999999), dt.datetime(1969, 1, 1)]
DECIMALS = [Decimal(x) for x in ("0", "1.5", "1.50", "5", "3", "-0.01", "-3.99", "9999999.99", "-9999999.99", "2.505")]
#: type of the field, of the column, values, and literals that Spark compares with them
KINDS = [
    ("int", "int", [0, 1, -1, 7, -10, INT - 1, -INT], [0, 7, -10, INT - 1, -INT, -INT + 5, INT, 2**40, 1.5, Decimal("6.5"), Decimal(7)]),
    ("long", "bigint", [0, 1, -1, 7, -10, LONG - 1, -LONG, 2**53 + 1], [0, 7, -10, LONG - 1, -LONG, -LONG + 3, 2.0**53, Decimal(7), 6.999]),
    ("decimal(9,2)", "decimal(9,2)", [d for d in DECIMALS if d != Decimal("2.505")], [*DECIMALS, 3, 5, -4, 10**12, Decimal("1E+7"), 0.5]),
    ("decimal(30,2)", "decimal(30,2)", [d for d in DECIMALS if d != Decimal("2.505")] + [Decimal("-9" * 1 + "9" * 27 + ".99")], [*DECIMALS, 3, 5, Decimal("-9" + "9" * 27 + ".99")]),
    ("date", "date", [m.date() for m in MOMENTS], [m.date() for m in MOMENTS] + [dt.datetime(2024, 2, 29), dt.datetime(2024, 2, 29, 3)]),
    ("timestamp", "timestamp_ntz", MOMENTS, [*MOMENTS, dt.date(2024, 2, 29), dt.date(1970, 1, 1), dt.datetime(2024, 2, 29, 12, tzinfo=dt.UTC)]),
    ("timestampz", "timestamp", [m.replace(tzinfo=dt.UTC) for m in MOMENTS if 1 < m.year < 9999], [*(m.replace(tzinfo=dt.UTC) for m in MOMENTS if 1 < m.year < 9999), dt.datetime(2024, 2, 29, 12, tzinfo=dt.timezone(dt.timedelta(hours=5))), dt.datetime(2024, 2, 29, 7), dt.date(2024, 2, 29)]),
    ("string", "string", ["", "a", "ab", "abc", "b", "🙂🙂x", "ÿ"], ["", "a", "ab", "abc", "🙂🙂", "ÿ"]),
    ("uuid", "string", ["f79c3e09-677c-4bbd-a479-3f349cb785e7", "F79C3E09-677C-4BBD-A479-3F349CB785E7", "x", ""], ["f79c3e09-677c-4bbd-a479-3f349cb785e7", "x", ""]),
    ("binary", "binary", [bytearray(b) for b in (b"", b"a", b"abc", b"\xff\0", b"abcde")], [b"", b"a", b"abc", b"\xff\0"]),
    ("boolean", "boolean", [True, False], [True, False]),
]


@pytest.mark.parametrize("name,column_type,values,literals", KINDS, ids=[k[0] for k in KINDS])
def test_pruning_loses_no_row_of_any_type(spark, name, column_type, values, literals):
    kind = parse_primitive(name)
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"c {column_type}")
    schema = Schema(0, (StructField(1, "c", False, kind),))
    transforms = [Transform("identity"), Transform("void")]
    for t in [Transform(n, a) for n in ("bucket", "truncate") for a in (1, 3, 16, 50, 1000, 2**32 - 1)] + [Transform(n) for n in ("year", "month", "day", "hour")]:
        try:
            apply_transform(t, F.col("c"), df.schema["c"].dataType)
            transforms.append(t)
        except TransformError:
            pass
    spec = PartitionSpec(0, tuple(PartitionField(1, 1000 + i, f"p{i}", t) for i, t in enumerate(transforms)))
    parts = with_partition_columns(df, schema, spec).cache()
    predicates = [Compare("c", op, v) for op in ("=", "!=", "<", "<=", ">", ">=") for v in literals] + [IsNull("c"), IsNull("c", True), In("c", tuple(literals[:2])), In("c", (literals[-1],)), In("c", (literals[0], None))]
    if name == "string":
        predicates += [StartsWith("c", v) for v in literals]
    predicates += [Not(p) for p in predicates]
    checks, projected = [], 0
    for f in spec.fields:
        for p in predicates:
            q = project(p, PartitionSpec(0, (f,)), schema)
            if q is not None:
                projected += 1
                checks.append((f.transform, p, F.count(F.when(to_column(p) & ~F.coalesce(to_column(q), F.lit(False)), 1))))
    assert projected > 20
    found = parts.agg(*(c.alias(f"c{i}") for i, (_, _, c) in enumerate(checks))).first()
    assert [(str(t), p) for (t, p, _), n in zip(checks, found) if n] == []


def test_pruning_uses_exact_literals():
    def of(kind, transform, p):
        return project(p, PartitionSpec(0, (PartitionField(1, 1000, "p", transform),)), Schema(0, (StructField(1, "c", False, parse_primitive(kind)),)))

    assert of("decimal(9,2)", Transform("bucket", 16), Compare("c", "=", Decimal("1.5"))) == Compare("p", "=", (slow_murmur3(unscaled_bytes(Decimal("1.50"), 2)) & (2**31 - 1)) % 16)
    assert of("decimal(9,2)", Transform("bucket", 16), Compare("c", "=", 3)) == Compare("p", "=", (slow_murmur3(unscaled_bytes(Decimal("3.00"), 2)) & (2**31 - 1)) % 16)
    assert of("decimal(9,2)", Transform("truncate", 50), Compare("c", "<=", 5)) == Or((Compare("p", "<=", Decimal("5.00")), IsNull("p")))
    assert of("timestamp", Transform("bucket", 1000), Compare("c", "=", dt.date(2024, 1, 1))) == of("timestamp", Transform("bucket", 1000), Compare("c", "=", dt.datetime(2024, 1, 1)))
    assert of("long", Transform("truncate", 10), IsNull("c", True)) is None and of("string", Transform("truncate", 10), IsNull("c", True)) == IsNull("p", True)
    assert of("decimal(9,2)", Transform("bucket", 16), Compare("c", "=", Decimal("2.505"))) is None and of("int", Transform("bucket", 16), Compare("c", "=", 1.0)) is None


def test_projections():
    p = lambda q: project(q, PartitionSpec(0, (PartitionField(3, 1, "d", Transform("day")),)), SCHEMA)
    assert p(Compare("ts", ">", dt.datetime(1970, 1, 2, 5))) == Compare("d", ">=", 1)
    assert p(Not(Compare("ts", ">=", dt.datetime(1970, 1, 2, 5)))) == Compare("d", "<=", 1)
    assert p(Compare("ts", "!=", dt.datetime(1970, 1, 2))) is None and p(Or((Compare("ts", "=", dt.datetime(1970, 1, 2)), Compare("n", "=", 1)))) is None
    assert p(Compare("ts", ">", dt.datetime(1970, 1, 2, 5, tzinfo=dt.UTC))) is None and p(In("ts", ())) == In("d", ())
    assert partition_value(Transform("hour"), dt.datetime(1969, 12, 31, 23, 59), Primitive("timestamp")) == -1 and partition_value(Transform("bucket", 16), 34, Primitive("int")) == 2017239379 % 16


def test_pruned_scan_lists_few_folders(spark, tmp_path):
    spec = PartitionSpec(0, (PartitionField(3, 1, "d", Transform("day")),))
    with_partition_columns(rows(spark).filter("ts is not null"), SCHEMA, spec).write.partitionBy("d").parquet(str(tmp_path / "t"))
    df = prune(spark.read.parquet(str(tmp_path / "t")), Compare("ts", "<", dt.datetime(1970, 1, 1)), spec, SCHEMA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(d" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    assert df.count() == rows(spark).filter("ts < '1970-01-01'").count()


def test_sort_orders(spark):
    order = SortOrder(1, (SortField(2, Transform("truncate", 1), "desc", "nulls-last"), SortField(1, Transform("identity"), "asc", "nulls-first")))
    got = [(r["s"], r["n"]) for r in sort_for_writing(rows(spark), order, SCHEMA, total=True).collect()]
    key = lambda r: ((r[0] is None, tuple(-ord(c) for c in (r[0] or "")[:1]) or (1,)), (r[1] is not None, r[1] or 0))
    assert [(g[0][:1] if g[0] else g[0], g[1]) for g in got] == [(g[0][:1] if g[0] else g[0], g[1]) for g in sorted(got, key=key)]
    df = rows(spark)
    assert sort_for_writing(df, SortOrder(0, ()), SCHEMA) is df
