"""The type grammar: text form, and the Spark types that stand for it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The names of the types without parameters (fixed values).
PLAIN = ("boolean", "int", "long", "float", "double", "date", "time", "timestamp", "timestampz", "string", "uuid", "binary")

I32, I64, U8, U32, U64 = (-(2**31), 2**31 - 1), (-(2**63), 2**63 - 1), (0, 2**8 - 1), (0, 2**32 - 1), (0, 2**64 - 1)

_DECIMAL = re.compile(r"decimal\(([0-9]+),([0-9]+)\)")
_FIXED = re.compile(r"fixed\[([0-9]+)\]")


class TypeTextError(ValueError):
    """A text that names no type."""


class UnsupportedTypeError(ValueError):
    """A type of the model that Spark has no column for."""


@dataclass(frozen=True)
class Primitive:
    """A type without fields. args are precision and scale of a decimal, or the length of a fixed."""

    name: str
    args: tuple[int, ...] = ()

    def __str__(self) -> str:
        if self.name == "decimal":
            return f"decimal({self.args[0]},{self.args[1]})"
        return f"fixed[{self.args[0]}]" if self.name == "fixed" else self.name


def within(number: int, bounds: tuple[int, int]) -> bool:
    return bounds[0] <= number <= bounds[1]


def whole(digits: str) -> int:
    """The number that digits write; of more than 20 digits only that it is too large for 64 bits."""
    digits = digits.lstrip("0") or "0"
    return int(digits) if len(digits) <= 20 else 2**64


def parse_primitive(text: str, dialect: str = "reference") -> Primitive:
    """The type that a text names, exactly: no blanks, lower case. The spec dialect
    also knows ``timestamptz`` and a blank behind the comma of a decimal."""
    if text in PLAIN:
        return Primitive(text)
    if dialect == "spec":
        if text == "timestamptz":
            return Primitive("timestampz")
        text = re.sub(r",\s+", ",", text)
    if text.startswith("decimal"):
        if not (m := _DECIMAL.fullmatch(text)):
            raise TypeTextError(f"not a decimal: {text!r}")
        precision, scale = whole(m[1]), whole(m[2])
        if not within(precision, I32):
            raise TypeTextError(f"precision is no 32-bit integer: {text!r}")
        if not within(scale, U8):
            raise TypeTextError(f"scale is no 8-bit integer: {text!r}")
        return Primitive("decimal", (precision, scale))
    if text.startswith("fixed"):
        if not (m := _FIXED.fullmatch(text)):
            raise TypeTextError(f"not a fixed: {text!r}")
        if not within(whole(m[1]), U64):
            raise TypeTextError(f"length is no 64-bit integer: {text!r}")
        return Primitive("fixed", (whole(m[1]),))
    raise TypeTextError(f"unknown type {text!r}")


_SPARK = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(),
    "time": T.LongType(), "timestamp": T.TimestampNTZType(), "timestampz": T.TimestampType(), "string": T.StringType(), "uuid": T.StringType(),
    "binary": T.BinaryType(), "fixed": T.BinaryType(),
}


def primitive_to_spark(p: Primitive) -> T.DataType:
    """The column type of a primitive. time is kept as microseconds of the day,
    since Parquet files of Spark hold no times."""
    if p.name == "decimal":
        precision, scale = p.args
        if not 1 <= precision <= 38 or scale > precision:
            raise UnsupportedTypeError(f"Spark has no {p}")
        return T.DecimalType(precision, scale)
    return _SPARK[p.name]


# ---------------------------------------------------------------- as columns


def type_columns(text: Column) -> dict[str, Column]:
    """kind, precision, scale and length (decimal(20,0), as it has 64 bits without a
    sign) of type texts, as columns; kind is null where the text names no type."""

    def number(pattern: str, digits: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast(T.DecimalType(digits, 0))

    precision = number(r"^decimal\(0*([0-9]{1,10}),[0-9]+\)\z", 10)
    scale = number(r"^decimal\([0-9]+,0*([0-9]{1,3})\)\z", 3)
    length = number(r"^fixed\[0*([0-9]{1,20})\]\z", 20)
    length = F.when(length <= F.lit(str(U64[1])).cast(T.DecimalType(20, 0)), length)
    is_decimal = (precision <= I32[1]) & (scale <= U8[1])
    kind = F.when(text.isin(*PLAIN), text).when(is_decimal, "decimal").when(length.isNotNull(), "fixed")
    return {"kind": kind, "precision": F.when(is_decimal, precision).cast("int"), "scale": F.when(is_decimal, scale).cast("int"), "length": length}


def spark_type_column(text: Column) -> Column:
    """The name of the Spark type of each type text; null where there is none."""
    parts = type_columns(text)
    fits = parts["precision"].between(1, 38) & (parts["scale"] <= parts["precision"])
    named = F.create_map(*[F.lit(x) for name, kind in _SPARK.items() for x in (name, kind.simpleString())])
    return F.when(parts["kind"] == "decimal", F.when(fits, F.concat(F.lit("decimal("), parts["precision"].cast("string"), F.lit(","), parts["scale"].cast("string"), F.lit(")")))).when(parts["kind"].isNotNull(), named[parts["kind"]])
