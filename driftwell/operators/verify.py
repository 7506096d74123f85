"""Comparing a source with a table, and two tables with one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(source: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """(key, status) of keys on one side only or with unequal rows: source_only, table_only, mismatched. NULL equals NULL,
    and columns are compared by value across integer widths."""
    columns = [c for c in source.columns if c not in key]
    row = F.struct(*columns) if columns else F.lit(0)
    x = source.select(*key, F.lit(True).alias("_in_source"), row.alias("_s"))
    y = table.select(*key, F.lit(True).alias("_in_table"), row.alias("_t"))
    both = x.join(y, key, "full_outer")
    if columns:
        same = F.lit(True)
        for c in columns:
            same = same & F.col(f"_s.{c}").eqNullSafe(F.col(f"_t.{c}"))
    else:
        same = F.lit(True)
    status = F.when(F.col("_in_table").isNull(), "source_only").when(F.col("_in_source").isNull(), "table_only").when(~same, "mismatched")
    return both.select(*key, status.alias("status")).where("status IS NOT NULL")


def checksums(table: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """(bucket, rows, checksum, high, low): equal for equal tables, whatever their order; to find where two replicas
    differ before comparing rows.

    Every column is hashed with whether it is NULL, since a hash alone passes over NULLs. Besides the xor, in which a row
    that comes twice vanishes, the two halves of the hashes are added up; a bucket may have two billion rows.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    h = F.xxhash64(*(x for c in sorted(table.columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))
    rows = table.select(bucket.alias("bucket"), h.alias("h"))
    return rows.groupBy("bucket").agg(F.count("*").alias("rows"), F.bit_xor("h").alias("checksum"), F.sum(F.shiftrightunsigned("h", 32)).alias("high"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))


def replicas_equal(a: DataFrame, b: DataFrame, key: list[str], buckets: int = 1024) -> bool:
    x, y = checksums(a, key, buckets), checksums(b, key, buckets)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
