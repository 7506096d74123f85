"""Whole tables and watermark polls as sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types a watermark may have; values are compared within one type only.
WATERMARK_TYPES = (T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


def snapshot_log(table: DataFrame, key: list[str], lsn: int) -> DataFrame:
    """A full table as inserts that precede every change after `lsn`, the position taken before the table was read.

    Changes between that position and the read come twice; the fold by key removes them.
    """
    return table.select(F.lit("I").alias("_op"), F.lit(-1).cast("long").alias("_seq"), F.lit(lsn).cast("long").alias("_lsn"), F.array().cast("array<string>").alias("_unchanged"), "*")


def after_key(key: list[str], last: list[object]) -> Column:
    """(a, b) > (x, y) as a disjunction of typed comparisons, which a scan can use."""
    terms = []
    for i, (c, v) in enumerate(zip(key, last, strict=True)):
        same = [F.col(k) == F.lit(x) for k, x in zip(key[:i], last[:i], strict=True)]
        terms.append(reduce(lambda a, b: a & b, [*same, F.col(c) > F.lit(v)]))
    return reduce(lambda a, b: a | b, terms)


def key_page(table: DataFrame, key: list[str], size: int, last: list[object] | None = None) -> DataFrame:
    """The next `size` rows in key order, compared by type, not by text."""
    rows = table if last is None else table.where(after_key(key, last))
    return rows.orderBy(*key).limit(size)


def parallel_snapshot(spark: SparkSession, url: str, table: str, column: str, low: object, high: object, parts: int, **options: str) -> DataFrame:
    """A JDBC table read in `parts` key ranges at once."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def poll(table: DataFrame, key: list[str], watermark: str, after: object | None = None, overlap: bool = False) -> DataFrame:
    """The newest row of each key above the watermark, with `_op` = I to be promoted against the table's state.

    The first poll (after=None) takes all rows that have one. overlap takes rows at the watermark again, so that
    rows tied with the last one seen are not missed; upserting them twice changes nothing. Of rows tied within a
    key one is taken by the order of all columns. Deletes are never seen.
    """
    if not isinstance(table.schema[watermark].dataType, WATERMARK_TYPES):
        raise ValueError(f"{watermark} cannot be a watermark: {table.schema[watermark].dataType.simpleString()}")
    mark = F.col(watermark)
    rows = table.where(mark.isNotNull() if after is None else mark >= F.lit(after) if overlap else mark > F.lit(after))
    rest = [c for c in table.columns if c not in key and c != watermark]
    newest = rows.groupBy(*key).agg(F.max(F.struct(watermark, *rest)).alias("r"))
    return newest.select(F.lit("I").alias("_op"), *(F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in table.columns))


def next_watermark(table: DataFrame, watermark: str) -> object | None:
    return table.agg(F.max(watermark)).first()[0]


def poll_page(table: DataFrame, key: list[str], watermark: str, size: int, after: tuple | None = None) -> DataFrame:
    """A page in (watermark, key) order: ties across a page's edge are not skipped."""
    return key_page(table.where(F.col(watermark).isNotNull()), [watermark, *key], size, list(after) if after else None)
