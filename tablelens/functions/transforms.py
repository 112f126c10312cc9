"""Partition transforms as columns.

All are built from Spark's own expressions and run in the JVM. Spark's Murmur3
differs from the standard one in the last bytes of strings and binaries only: of
those it hashes the part that is a multiple of four bytes long, its last steps
are undone, and the rest is mixed in as the standard says. Decimals of more than
18 digits, whose bytes no expression gives, go through a vectorized Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.model import PartitionSpec, Schema, Transform
from tablelens.shared import ship
from tablelens.types import U32, Primitive

#: An int whose hash with Spark's seed 42 is 0; hashed first, it makes 0 the seed (fixed value).
_SEED_ZERO = -1693959553
_INT_MAX = 2147483647
_HOUR_US, _DAY_US = 3_600_000_000, 86_400_000_000
_M1, _M2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


class TransformError(ValueError):
    """A transform that cannot be applied to a column."""


def parse_transform_columns(text: Column) -> tuple[Column, Column]:
    """(name, parameter) of transform texts; both null where a text is no transform."""
    from tablelens.codec import TRANSFORMS

    name = F.nullif(F.regexp_extract(text, r"^(bucket|truncate)\[[0-9]+\]\z", 1), F.lit(""))
    arg = F.nullif(F.regexp_extract(text, r"^(?:bucket|truncate)\[0*([0-9]{1,10})\]\z", 1), F.lit("")).cast("bigint")
    fits = arg <= U32[1]
    return F.when(text.isin(*TRANSFORMS), text).when(fits, name), F.when(fits, arg)


# ---------------------------------------------------------------- Murmur3


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def murmur3(values: Iterable[bytes]) -> np.ndarray:
    """The 32-bit hashes (seed 0) of byte strings, all at once, word by word."""
    data = list(values)
    sizes = np.array([len(v) for v in data], np.int64)
    words = int(sizes.max(initial=0) + 3) // 4
    h = np.zeros(len(data), np.uint32)
    with np.errstate(over="ignore"):
        order = np.argsort(-sizes, kind="stable")
        for w in range(words):
            at = order[: int((sizes > 4 * w).sum())]
            block = np.frombuffer(b"".join(data[i][4 * w : 4 * w + 4].ljust(4, b"\0") for i in at), "<u4").astype(np.uint32)
            k = _rotl(block * _M1, 15) * _M2
            full = sizes[at] >= 4 * w + 4
            mixed = h[at] ^ k
            h[at] = np.where(full, _rotl(mixed, 13) * np.uint32(5) + np.uint32(0xE6546B64), mixed)
        h ^= sizes.astype(np.uint32)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    return h


def unscaled_bytes(value: Decimal, scale: int) -> bytes:
    """The unscaled value of a decimal in the fewest bytes of two's complement."""
    n = int(value.scaleb(scale))
    return n.to_bytes((n if n >= 0 else ~n).bit_length() // 8 + 1, "big", signed=True)


def _hashed(values: pa.Array) -> pa.Array:
    data = [None if v is None else unscaled_bytes(v, values.type.scale) for v in values.to_pylist()]
    there = np.array([v is not None for v in data], bool)
    out = np.zeros(len(data), np.int32)
    out[there] = murmur3(v for v in data if v is not None).view(np.int32)
    return pa.array(out, mask=~there)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _steps(value: Column, *steps: Callable[[Column], Column]) -> Column:
    for step in steps:
        value = _let(value, step)
    return value


_LOW = 0xFFFFFFFF


def _times(by: int) -> Callable[[Column], Column]:
    """Product modulo 2^32 of an unsigned 32-bit number, in halves so that no bigint overflows."""
    return lambda x: (x.bitwiseAND(F.lit(0xFFFF)) * F.lit(by) + F.shiftleft((F.shiftrightunsigned(x, 16) * F.lit(by)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_LOW))


def _fold(*by: int) -> Callable[[Column], Column]:
    """x ^ (x >>> by) for each shift."""

    def step(x: Column) -> Column:
        out = x
        for n in by:
            out = out.bitwiseXOR(F.shiftrightunsigned(x, n))
        return out

    return step


def _left(n: int) -> Callable[[Column], Column]:
    return lambda x: F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 32 - n)).bitwiseAND(F.lit(_LOW))


def _hash_binary(data: Column) -> Column:
    """The standard Murmur3 (seed 0) of a binary column that is not null."""
    size = F.octet_length(data).cast("bigint")
    rest = F.pmod(size, F.lit(4).cast("bigint"))
    head = F.hash(F.lit(_SEED_ZERO), F.substring(data, F.lit(1), (size - rest).cast("int"))).cast("bigint").bitwiseAND(F.lit(_LOW))
    # back from the finished hash of the head to its state
    state = _steps(head, _fold(16), _times(pow(0xC2B2AE35, -1, 1 << 32)), _fold(13, 26), _times(pow(0x85EBCA6B, -1, 1 << 32)), _fold(16)).bitwiseXOR(size - rest)
    byte = lambda i: F.when(rest >= i, F.conv(F.hex(F.substring(data, (size - rest).cast("int") + F.lit(i), F.lit(1))), 16, 10).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    tail = byte(1) + F.shiftleft(byte(2), 8) + F.shiftleft(byte(3), 16)
    mixed = _steps(tail, _times(int(_M1)), _left(15), _times(int(_M2)))
    return _steps(state.bitwiseXOR(mixed).bitwiseXOR(size), _fold(16), _times(0x85EBCA6B), _fold(13), _times(0xC2B2AE35), _fold(16), lambda x: F.when(x > _INT_MAX, x - (1 << 32)).otherwise(x).cast("int"))


def _unscaled(column: Column, scale: int) -> Column:
    """The unscaled value of a decimal of at most 18 digits in the fewest bytes of two's complement."""
    number = (column.cast(T.DecimalType(38, scale)) * F.lit(10**scale).cast(T.DecimalType(19, 0))).cast("bigint")
    octets = F.lit(8)
    for n in range(7, 0, -1):
        octets = F.when(number.between(-(1 << (8 * n - 1)), (1 << (8 * n - 1)) - 1), n).otherwise(octets)
    return F.substring(F.unhex(F.lpad(F.hex(number), 16, "0")), F.lit(9) - octets, octets)


def hash_column(column: Column, kind: T.DataType, source: Primitive | None = None) -> Column:
    """The format's 32-bit hash of a column; null for null. source is the type of the
    field: a uuid is hashed as its 16 bytes."""
    if source == Primitive("uuid") and isinstance(kind, T.StringType):
        column, kind = F.unhex(F.replace(column, F.lit("-"), F.lit(""))), T.BinaryType()
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        as_long = column.cast("bigint")
    elif isinstance(kind, T.DateType):
        as_long = F.unix_date(column).cast("bigint")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        as_long = micros(column, kind)
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        return F.when(column.isNotNull(), _let(column.cast("binary"), _hash_binary))
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return F.when(column.isNotNull(), _let(_unscaled(column, kind.scale), _hash_binary))
    elif isinstance(kind, T.DecimalType):
        ship(SparkSession.active())
        return F.arrow_udf(_hashed, "int")(column)
    else:
        raise TransformError(f"{kind.simpleString()} cannot be hashed")
    return F.when(column.isNotNull(), F.hash(F.lit(_SEED_ZERO), as_long))


# ---------------------------------------------------------------- time


def micros(column: Column, kind: T.DataType) -> Column:
    """Microseconds from 1970-01-01, in UTC for zoned timestamps; the session's zone has no part in it."""
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column)
    return F.unix_micros(column)


def _exact_div(column: Column, by: int) -> Column:
    """Floor division of a bigint, exact at every magnitude: the remainder goes
    first, so that the integer division does not round."""
    return F.floor((column - F.pmod(column, F.lit(by).cast("bigint"))).cast("decimal(20,0)") / F.lit(by).cast("decimal(20,0)"))


def _days(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_date(column.cast("date"))
    if isinstance(kind, T.TimestampType):
        return _exact_div(F.unix_micros(column), _DAY_US).cast("int")
    raise TransformError(f"{kind.simpleString()} has no days")


def _time(name: str, column: Column, kind: T.DataType) -> Column:
    days = _days(column, kind)
    if name == "day":
        return days
    if name == "hour":
        if isinstance(kind, T.DateType):
            raise TransformError("a date has no hours")
        return _exact_div(micros(column, kind), _HOUR_US).cast("int")
    date = F.date_from_unix_date(days)
    years = F.year(date) - 1970
    return years if name == "year" else years * 12 + F.month(date) - 1


# ---------------------------------------------------------------- transforms


def _truncate(column: Column, kind: T.DataType, width: int) -> Column:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        big = column.cast("bigint")
        return F.try_subtract(big, F.pmod(big, F.lit(width).cast("bigint"))).try_cast(kind)
    if isinstance(kind, T.DecimalType):
        wide = T.DecimalType(38, kind.scale)
        value, step = column.cast(wide), F.lit(Decimal(width).scaleb(-kind.scale)).cast(wide)
        return F.try_subtract(value, F.pmod(value, step)).try_cast(kind)
    if isinstance(kind, T.StringType):
        return F.left(column, F.lit(min(width, _INT_MAX)))
    if isinstance(kind, T.BinaryType):
        return F.substring(column, 1, min(width, _INT_MAX))
    raise TransformError(f"{kind.simpleString()} cannot be truncated")


def apply_transform(transform: Transform, column: Column, kind: T.DataType, source: Primitive | None = None) -> Column:
    """The partition values of a column of the given type; null for null.

    void is always null; year, month, day and hour count from 1970-01-01 in UTC,
    downwards before; truncate rounds numbers down, also below zero (null where
    the type holds no such number), and cuts strings by characters. source is the
    type of the field, where it says more than the column's (uuids are strings here).
    """
    name = transform.name
    if name in ("bucket", "truncate") and not transform.arg:
        raise TransformError(f"{transform} has no positive parameter")
    if name == "void":
        return F.lit(None).cast(kind)
    if name == "identity":
        return column
    if name in ("year", "month", "day", "hour"):
        return _time(name, column, kind)
    if name == "bucket":
        return F.pmod(hash_column(column, kind, source).bitwiseAND(F.lit(_INT_MAX)), F.lit(transform.arg)).cast("int")
    return _truncate(column, kind, transform.arg)


def result_type(transform: Transform, kind: T.DataType) -> T.DataType:
    return kind if transform.name in ("void", "identity", "truncate") else T.IntegerType()


def with_partition_columns(df: DataFrame, schema: Schema, spec: PartitionSpec) -> DataFrame:
    """df with a column for each field of the spec. Sources are top-level fields
    found by id; a field whose source is not in the schema is an error."""
    fields = {f.id: f for f in schema.fields}
    kinds = {f.name: f.dataType for f in df.schema}
    out = {}
    for f in spec.fields:
        if f.source_id not in fields:
            raise TransformError(f"partition field {f.name}: no source field {f.source_id}")
        source = fields[f.source_id]
        out[f.name] = apply_transform(f.transform, F.col(f"`{source.name}`"), kinds[source.name], source.field_type)
    return df.withColumns(out)
