"""Source types, their table types, decoding of text values, and the rules for widening and rescaling."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Source type names and the table types they map to. Anything else is text.
TYPES = {
    "bool": T.BooleanType(),
    "int2": T.IntegerType(),
    "int4": T.IntegerType(),
    "oid": T.IntegerType(),
    "int8": T.LongType(),
    "float4": T.FloatType(),
    "float8": T.DoubleType(),
    "text": T.StringType(),
    "varchar": T.StringType(),
    "bpchar": T.StringType(),
    "name": T.StringType(),
    "json": T.StringType(),
    "jsonb": T.StringType(),
    "inet": T.StringType(),
    "cidr": T.StringType(),
    "macaddr": T.StringType(),
    "uuid": T.StringType(),
    "bytea": T.BinaryType(),
    "date": T.DateType(),
    "time": T.LongType(),
    "timetz": T.LongType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
}
ALIASES = {"boolean": "bool", "smallint": "int2", "integer": "int4", "int": "int4", "bigint": "int8", "real": "float4", "double precision": "float8", "character varying": "varchar", "character": "bpchar", "char": "bpchar", "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamptz", "time without time zone": "time", "time with time zone": "timetz"}
_NUMERIC = re.compile(r"(?:numeric|decimal)(?:\s*\(\s*(\d+)\s*(?:,\s*(-?\d+)\s*)?\))?$")


def table_type(name: str) -> T.DataType:
    """Table type of a source type by name, arguments allowed; unknown types are text."""
    plain = name.strip().lower()
    if m := _NUMERIC.match(plain):
        if m[1] is None:
            return T.DecimalType(38, 18)
        precision, scale = int(m[1]), int(m[2] or 0)
        if precision > 38 or not 0 <= scale <= precision:
            raise ValueError(f"numeric({precision},{scale}) has no table type")
        return T.DecimalType(precision, scale)
    plain = re.sub(r"\s*\(\d+\)", "", plain)
    return TYPES.get(ALIASES.get(plain, plain), T.StringType())


def time_micros(text: Column) -> Column:
    """Microseconds of the day of HH:MM:SS[.ffffff] with or without a zone; the zone is dropped."""
    m = [F.regexp_extract(text, r"^(\d+):(\d+):(\d+)(?:\.(\d{1,6}))?", i) for i in range(1, 5)]
    return F.when(text.isNotNull(), (m[0].cast("long") * 3600 + m[1].cast("long") * 60 + m[2].cast("long")) * 1_000_000 + F.rpad(m[3], 6, "0").cast("long"))


def decode_text(text: Column, name: str) -> Column:
    """A value from its text form. Malformed input raises, as a cast does in ANSI mode."""
    kind = ALIASES.get(name.lower(), name.lower())
    target = table_type(name)
    if isinstance(target, T.StringType):
        return text
    if kind == "bool":
        low = F.lower(text)
        return F.when(low.isin("t", "true", "1"), True).when(low.isin("f", "false", "0"), False).when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))
    if kind == "oid":  # above 2**31 it wraps
        return (F.pmod(text.cast("long") + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")
    if kind == "bytea":
        return F.when(F.substring(text, 1, 2) == "\\x", F.unhex(F.substring(text, 3, 1 << 30))).when(text.isNotNull(), F.raise_error(F.lit("bytea must be in hex form")).cast("binary"))
    if kind in ("time", "timetz"):
        return time_micros(text)
    return text.cast(target)


def exact_decimal(value: Column, precision: int, scale: int) -> Column:
    """The value at a new scale; raises where a cast would round or overflow."""
    out = value.cast(T.DecimalType(38, 18)).try_cast(T.DecimalType(precision, scale))
    same = out.cast(T.DecimalType(38, 18)) == value.cast(T.DecimalType(38, 18))
    return F.when(value.isNull() | same, out).otherwise(F.raise_error(F.lit(f"value does not fit decimal({precision},{scale}) exactly")).cast(T.DecimalType(precision, scale)))


def fits_exactly(value: Column, precision: int, scale: int) -> Column:
    """Whether exact_decimal would accept the value."""
    out = value.cast(T.DecimalType(38, 18)).try_cast(T.DecimalType(precision, scale))
    return F.coalesce(out.cast(T.DecimalType(38, 18)) == value.cast(T.DecimalType(38, 18)), F.lit(False)) | value.isNull()


def may_promote(old: T.DataType, new: T.DataType) -> bool:
    """Same type, int to long, float to double, decimal of the same scale and no less precision."""
    if old == new:
        return True
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale == old.scale and new.precision >= old.precision
    return (type(old), type(new)) in {(T.IntegerType, T.LongType), (T.FloatType, T.DoubleType)}


def parse_lsn(text: Column) -> Column:
    """hi/lo in hex to one number."""
    parts = F.split(text, "/")
    return F.shiftleft(F.conv(parts[0], 16, 10).cast("long"), 32) + F.conv(parts[1], 16, 10).cast("long")


def format_lsn(lsn: Column) -> Column:
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF))))
