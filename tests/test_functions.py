import datetime as dt
import struct
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions import partition, schema, types


def transformed(spark, expr, values, kind):
    df = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("c", kind)]))
    t = partition.parse(expr)
    return [r[0] for r in df.select(partition.apply(t, F.col("c"), kind)).collect()]


def murmur(data: bytes) -> int:
    h, word = 0, 0xFFFFFFFF
    rotl = lambda x, n: ((x << n) | (x >> (32 - n))) & word
    for i in range(0, len(data) - len(data) % 4, 4):
        k = struct.unpack("<I", data[i : i + 4])[0]
        h = (rotl(h ^ (rotl(k * 0xCC9E2D51 & word, 15) * 0x1B873593 & word), 13) * 5 + 0xE6546B64) & word
    if rest := data[len(data) - len(data) % 4 :]:
        h ^= rotl(int.from_bytes(rest, "little") * 0xCC9E2D51 & word, 15) * 0x1B873593 & word
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & word
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & word
    return h ^ (h >> 16)


def test_golden_values(spark):
    day = lambda *a: dt.datetime(*a)
    assert transformed(spark, "bucket[4](c)", [1, 2, 3, 4, 5], T.IntegerType()) == [0, 0, 3, 2, 3]
    assert transformed(spark, "truncate[3](c)", ["alice", "bob"], T.StringType()) == ["ali", "bob"]
    assert transformed(spark, "truncate[10](c)", [1, 15, -1, 25, 100, None], T.IntegerType()) == [0, 10, -10, 20, 100, None]
    assert transformed(spark, "truncate[100](c)", [150, 250, -50, 999, 0], T.LongType()) == [100, 200, -100, 900, 0]
    prices = [Decimal(x) for x in ("10.65", "25.30", "99.99", "-10.65", "0.00")]
    assert transformed(spark, "truncate[50](c)", prices, T.DecimalType(10, 2)) == [Decimal(x) for x in ("10.50", "25.00", "99.50", "-11.00", "0.00")]
    assert transformed(spark, "day(c)", [day(2025, 1, 15, 10), None], T.TimestampNTZType()) == [20103, None]
    assert transformed(spark, "hour(c)", [day(1969, 12, 31, 23, 30)], T.TimestampNTZType()) == [-1]
    assert transformed(spark, "year(c)", [dt.date(2024, 5, 1)], T.DateType()) == [54]
    assert transformed(spark, "month(c)", [dt.date(2025, 2, 1)], T.DateType()) == [661]


@pytest.mark.parametrize("n", range(10))
def test_bucket_of_texts_of_every_tail_length(spark, n):
    text = "añ23456789"[:n]
    assert transformed(spark, "bucket[97](c)", [text], T.StringType()) == [(murmur(text.encode()) & 0x7FFFFFFF) % 97]


@pytest.mark.parametrize("value", ["0.00", "1.27", "1.28", "-1.28", "-1.29", "327.68", "99999999.99", "-99999999.99"])
def test_bucket_of_decimals(spark, value):
    unscaled = int(Decimal(value) * 100)
    size = next(n for n in range(1, 9) if -(1 << (8 * n - 1)) <= unscaled < 1 << (8 * n - 1))
    want = (murmur(unscaled.to_bytes(size, "big", signed=True)) & 0x7FFFFFFF) % 97
    assert transformed(spark, "bucket[97](c)", [Decimal(value)], T.DecimalType(10, 2)) == [want]


@pytest.mark.parametrize("kind", [T.DecimalType(38, 0), T.DecimalType(30, 2), T.DecimalType(38, 10)])
def test_bucket_of_wide_decimals(spark, kind):
    step = Decimal(1).scaleb(-kind.scale)
    whole = [0, 1, 127, 128, -1, -128, -129, 1 << 31, 1 << 32, (1 << 63) - 1, 1 << 63, -(1 << 63) - 1, 1 << 90, -(1 << 90), 10**kind.precision - 1, 1 - 10**kind.precision]
    values = [i for i in whole if abs(i) < 10**kind.precision]
    size = lambda i: next(n for n in range(1, 17) if -(1 << (8 * n - 1)) <= i < 1 << (8 * n - 1))
    want = [(murmur(i.to_bytes(size(i), "big", signed=True)) & 0x7FFFFFFF) % 97 for i in values]
    with localcontext(prec=60):
        assert transformed(spark, "bucket[97](c)", [i * step for i in values], kind) == want


def test_bucket_of_whole_names(spark, sf_dir):
    from driftwell.plans import catalog

    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()}
    got = {r.p_partkey: r.b for r in catalog.queries()["part_bucket_string"](spark, sf_dir).collect()}
    assert got == {k: (murmur(n.encode()) & 0x7FFFFFFF) % 16 for k, n in names.items()}


@pytest.mark.parametrize("bad", ["", "bucket(c)", "bucket[0](c)", "hourly(c)", "truncate[](c)", "year[2](c)", "a b"])
def test_grammar_errors(bad):
    with pytest.raises(ValueError):
        partition.parse(bad)


def test_grammar():
    assert partition.parse(" BUCKET[ 4 ]( id ) ") == partition.Transform("bucket", "id", 4)
    assert partition.parse("truncate[3](n)").name == "n_trunc"
    with pytest.raises(ValueError):
        partition.apply(partition.parse("bucket[4](c)"), F.lit(True), T.BooleanType())


def test_type_map():
    assert types.table_type("numeric(10,2)") == T.DecimalType(10, 2)
    assert types.table_type("numeric") == T.DecimalType(38, 18)
    assert types.table_type("character varying(20)") == T.StringType()
    assert types.table_type("interval") == T.StringType()
    with pytest.raises(ValueError):
        types.table_type("numeric(40,2)")


def test_decode(spark):
    row = spark.range(1).select(
        types.decode_text(F.lit("\\x0aff"), "bytea").alias("raw"),
        types.decode_text(F.lit("4294967295"), "oid").alias("oid"),
        types.decode_text(F.lit("23:59:59.5"), "time").alias("t"),
        types.parse_lsn(F.lit("1/A0")).alias("lsn"),
        types.format_lsn(F.lit((1 << 32) + 160)).alias("text"),
    )
    r = row.first()
    assert (bytes(r.raw), r.oid, r.t, r.lsn, r.text) == (b"\x0a\xff", -1, 86399500000, (1 << 32) + 160, "1/A0")
    with pytest.raises(Exception, match="boolean"):
        spark.range(1).select(types.decode_text(F.lit("maybe"), "bool")).collect()


def test_decimals_never_lose_digits(spark):
    """D-decimal: rescaling refuses a remainder or overflow."""
    ok = lambda v: spark.range(1).select(types.exact_decimal(F.lit(v).cast("decimal(12,4)"), 6, 2)).first()[0]
    assert ok("1.2300") == Decimal("1.23") and ok(None) is None
    for bad in ("1.2345", "12345678.0"):
        with pytest.raises(Exception, match="exactly"):
            ok(bad)


def base():
    return schema.TableSchema.of(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.IntegerType()), T.StructField("s", T.StringType())]), ["id"])


def test_schema_changes():
    s = base()
    changes = schema.diff(s, {"id": T.IntegerType(), "v": T.LongType(), "n": T.DoubleType()})
    assert [(c.kind, c.name) for c in changes] == [("promote", "v"), ("add", "n"), ("drop", "s")]
    s = schema.apply(s, changes)
    assert [c.field_id for c in s.columns] == [1, 2, 3, 4] and s.columns[2].dropped
    again = schema.apply(s, schema.diff(s, {"id": T.IntegerType(), "v": T.LongType(), "n": T.DoubleType(), "s": T.StringType()}))
    assert again.columns[-1].field_id == 5  # D18: a name that comes back is a new column
    assert schema.TableSchema.from_json(again.to_json()) == again


@pytest.mark.parametrize("incoming", [{"id": T.LongType(), "v": T.IntegerType(), "s": T.StringType()}, {"v": T.IntegerType(), "s": T.StringType()}, {"id": T.IntegerType(), "v": T.StringType(), "s": T.StringType()}])
def test_illegal_changes(incoming):
    with pytest.raises(ValueError):
        schema.diff(base(), incoming)
