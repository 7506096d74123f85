"""Hidden partition transforms as Columns, their grammar, path segments, and pruning."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The multipliers of the 32-bit hash that bucket numbers are defined by.
_C1, _C2, _ADD, _MIX1, _MIX2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
_WORD = 0xFFFFFFFF
#: Fixed value: the name of a NULL partition in a path.
NULL_SEGMENT = "__HIVE_DEFAULT_PARTITION__"
_SUFFIX = {"identity": "", "year": "_year", "month": "_month", "day": "_day", "hour": "_hour", "bucket": "_bucket", "truncate": "_trunc"}
_EXPR = re.compile(r"\s*(?:(\w+)\s*(?:\[\s*(\d+)\s*\])?\s*\(\s*(\w+)\s*\)|(\w+))\s*$")


@dataclass(frozen=True)
class Transform:
    kind: str
    column: str
    width: int = 0

    @property
    def name(self) -> str:
        return self.column + _SUFFIX[self.kind]


def parse(expr: str) -> Transform:
    """`c`, identity(c), year(c), month(c), day(c), hour(c), bucket[N](c), truncate[W](c); names in any case."""
    m = _EXPR.match(expr)
    if not m:
        raise ValueError(f"not a partition expression: {expr!r}")
    if m[4]:
        return Transform("identity", m[4])
    kind, width = m[1].lower(), m[2]
    if kind not in _SUFFIX:
        raise ValueError(f"unknown transform {m[1]!r}")
    if (kind in ("bucket", "truncate")) != (width is not None):
        raise ValueError(f"{kind} {'needs' if width is None else 'takes no'} [N]")
    if width is not None and not int(width):
        raise ValueError(f"{kind}[0] is not allowed")
    return Transform(kind, m[3], int(width or 0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: without it, an expression doubles with every use of its argument."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _times(a: Column, c: int) -> Column:
    return _let(a, lambda x: (x.bitwiseAND(F.lit(0xFFFF)) * F.lit(c) + F.shiftleft((F.shiftright(x, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_WORD)))


def _turn(a: Column, n: int) -> Column:
    return _let(a, lambda x: F.shiftleft(x, n).bitwiseAND(F.lit(_WORD)).bitwiseOR(F.shiftright(x, 32 - n)))


def _scramble(k: Column) -> Column:
    return _times(_turn(_times(k, _C1), 15), _C2)


def _round(h: Column, k: Column) -> Column:
    return (_turn(h.bitwiseXOR(_scramble(k)), 13) * F.lit(5) + F.lit(_ADD)).bitwiseAND(F.lit(_WORD))


def _finish(h: Column, length: Column) -> Column:
    fold = lambda a, n: _let(a, lambda x: x.bitwiseXOR(F.shiftright(x, n)))
    return fold(_times(fold(_times(fold(h.bitwiseXOR(length), 16), _MIX1), 13), _MIX2), 16)


def hash_long(value: Column) -> Column:
    """32-bit murmur3 with seed 0 of the value as 8 little-endian bytes."""
    h = _round(_round(F.lit(0).cast("long"), value.bitwiseAND(F.lit(_WORD))), F.shiftrightunsigned(value, 32).bitwiseAND(F.lit(_WORD)))
    return _finish(h, F.lit(8).cast("long"))


def hash_bytes(value: Column) -> Column:
    """32-bit murmur3 with seed 0 of a byte string."""
    text, size = F.hex(value), F.octet_length(value)
    byte = lambda i: F.conv(F.substr(text, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    block = lambda i: byte(i).bitwiseOR(F.shiftleft(byte(i + 1), 8)).bitwiseOR(F.shiftleft(byte(i + 2), 16)).bitwiseOR(F.shiftleft(byte(i + 3), 24))
    whole = F.floor(size / 4).cast("int")
    starts = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: i * 4)).otherwise(F.array().cast("array<int>"))
    h = F.aggregate(starts, F.lit(0).cast("long"), lambda acc, i: _round(acc, block(i)))
    rest, at = size - whole * 4, whole * 4
    tail = F.when(rest >= 1, byte(at)).otherwise(F.lit(0).cast("long"))
    tail = tail.bitwiseOR(F.when(rest >= 2, F.shiftleft(byte(at + 1), 8)).otherwise(F.lit(0).cast("long")))
    tail = tail.bitwiseOR(F.when(rest >= 3, F.shiftleft(byte(at + 2), 16)).otherwise(F.lit(0).cast("long")))
    return _finish(F.when(rest > 0, h.bitwiseXOR(_scramble(tail))).otherwise(h), size.cast("long"))


def _decimal_bytes(value: Column, kind: T.DecimalType) -> Column:
    """The unscaled value as the fewest big-endian bytes in two's complement."""
    if kind.precision > 18:
        return _wide_decimal_bytes(value, kind)
    unscaled = (value * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long")
    full = F.lpad(F.hex(unscaled), 16, "0")
    bits = F.length(F.bin(F.when(unscaled < 0, -(unscaled + 1)).otherwise(unscaled)))
    bits = F.when((unscaled == 0) | (unscaled == -1), 0).otherwise(bits)
    size = F.floor(bits / 8).cast("int") + 1
    return F.unhex(F.substr(full, 17 - size * 2, size * 2))


def _wide_decimal_bytes(value: Column, kind: T.DecimalType) -> Column:
    """As above for up to 38 digits: four 32-bit words, then without the leading bytes that only repeat the sign."""
    # Sums, products and remainders of decimals are exact; floor, negation and division with a rest are not.
    one, shift = F.lit(1).cast("decimal(1,0)"), F.lit(10**kind.scale).cast(T.DecimalType(min(38, kind.scale + 1), 0))
    part = value % one
    unscaled = ((value - part).cast("decimal(38,0)") * shift).cast("decimal(38,0)") + (part * shift).cast("decimal(38,0)") if kind.scale else value
    base, flip = F.lit(1 << 32).cast("decimal(38,0)"), F.when(value < 0, F.lit(_WORD)).otherwise(F.lit(0))

    def words(rest: Column, n: int) -> Column:
        low = lambda x: F.pmod(x, base)
        word = lambda x: F.lpad(F.hex(low(x).cast("long").bitwiseXOR(flip)), 8, "0")
        return _let(rest, lambda x: word(x) if n == 1 else F.concat(words(((x - low(x)) / base).cast("decimal(38,0)"), n - 1), word(x)))

    # A negative number's bits are those of its distance to -1, all turned over.
    unscaled = unscaled.cast("decimal(38,0)")
    distance = F.when(value < 0, F.lit(-1).cast("decimal(38,0)") - unscaled).otherwise(unscaled).cast("decimal(38,0)")
    sign = F.when(value < 0, r"^(FF)+(?=[89A-F])").otherwise(r"^(00)+(?=[0-7])")
    return F.unhex(F.regexp_replace(words(distance, 4), sign, F.lit("")))


def _instant(value: Column, kind: T.DataType) -> Column:
    return F.unix_micros(value.cast("timestamp")) if isinstance(kind, T.TimestampNTZType) else F.unix_micros(value)


def _reject(t: Transform, kind: T.DataType) -> ValueError:
    return ValueError(f"{t.kind} does not apply to {kind.simpleString()}")


def apply(t: Transform, value: Column, kind: T.DataType) -> Column:
    """The transform of a column of that type; NULL gives NULL. Sessions must run in UTC."""
    stamp = isinstance(kind, T.TimestampType | T.TimestampNTZType)
    whole = isinstance(kind, T.IntegerType | T.LongType | T.ShortType)
    if t.kind == "identity":
        return F.unix_date(value) if isinstance(kind, T.DateType) else _instant(value, kind) if stamp else value
    if t.kind in ("year", "month", "day", "hour"):
        if not (stamp or isinstance(kind, T.DateType)):
            raise _reject(t, kind)
        if t.kind == "year":
            return F.year(value) - 1970
        if t.kind == "month":
            return (F.year(value) - 1970) * 12 + F.month(value) - 1
        if t.kind == "day":
            return F.unix_date(F.to_date(value))
        return F.floor(_instant(value, kind) / 3_600_000_000).cast("int") if stamp else F.unix_date(value) * 24
    if t.kind == "bucket":
        if whole:
            h = hash_long(value.cast("long"))
        elif isinstance(kind, T.DateType):
            h = hash_long(F.unix_date(value).cast("long"))
        elif stamp:
            h = hash_long(_instant(value, kind))
        elif isinstance(kind, T.StringType):
            h = hash_bytes(value.cast("binary"))
        elif isinstance(kind, T.DecimalType):
            h = hash_bytes(_decimal_bytes(value, kind))
        else:
            raise _reject(t, kind)
        return F.when(value.isNotNull(), F.pmod(h.bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(t.width)).cast("int"))
    if whole:
        return value - F.pmod(value, F.lit(t.width).cast(kind))
    if isinstance(kind, T.DecimalType):
        step = F.lit(t.width).cast("decimal(38,0)") * F.lit(f"1e-{kind.scale}").cast(f"decimal(38,{kind.scale})")
        step = step.cast(T.DecimalType(min(38, kind.precision + 10), kind.scale))
        return (value - F.pmod(value, step)).cast(T.DecimalType(min(38, kind.precision + 1), kind.scale))
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.substring(value, 1, t.width)
    raise _reject(t, kind)


def uuid_bucket(value: Column, width: int) -> Column:
    """bucket[width] of a uuid in text form: its 16 bytes are hashed."""
    return F.when(value.isNotNull(), F.pmod(hash_bytes(F.unhex(F.replace(value, F.lit("-"), F.lit("")))).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(width)).cast("int"))


def segment(t: Transform, part: Column, kind: T.DataType | None = None) -> Column:
    """name=value for a path: NULL by its fixed name, binary in base64, other than unreserved characters escaped."""
    text = F.base64(part) if isinstance(kind, T.BinaryType) else part.cast("string")
    # url_encode is the form encoding: blanks are + and * stays.
    escaped = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(f"{t.name}="), F.coalesce(escaped, F.lit(NULL_SEGMENT)))


def prune(t: Transform, low: object, high: object, kind: T.DataType) -> Column | None:
    """A condition on the partition column that every row with low <= column <= high meets; None if there is none.

    All transforms but bucket keep order, so the bounds' own partitions bound the partitions of what lies between.
    """
    if t.kind == "bucket":
        return (F.col(t.name) == apply(t, F.lit(low).cast(kind), kind)) if low == high else None
    return F.col(t.name).between(apply(t, F.lit(low).cast(kind), kind), apply(t, F.lit(high).cast(kind), kind))
