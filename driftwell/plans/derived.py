"""Inputs for the registered queries: change logs and control tables derived from the driver's tables by arithmetic,
in Spark and, word for word, in DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["o_orderkey"]
COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share; one of our own only where none is set and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='driftwell-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: (condition, operation, place, status, price, unchanged columns, is the row carried)
_EVENTS = [
    ("true", "I", 0, "o_orderstatus", "o_totalprice", "", True),
    ("o_orderkey % 3 = 0", "U", 1, "o_orderstatus", "o_totalprice * 2", "o_orderpriority", True),
    ("o_orderkey % 6 = 0", "U", 2, "'X'", "o_totalprice", "o_orderpriority", True),
    ("o_orderkey % 5 = 0", "D", 3, "", "", "", False),
    ("o_orderkey % 10 = 0", "I", 4, "o_orderstatus", "o_totalprice", "", True),
]


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log over `orders`, from one scan of it."""
    events = []
    for when, op, place, status, price, unchanged, row in _EVENTS:
        col = lambda c, e, row=row: (F.expr(e) if row else F.lit(None).cast("string")).alias(c)
        events.append(
            F.when(
                F.expr(when),
                F.struct(
                    F.lit(op).alias("_op"),
                    (F.col("o_orderkey") * 10 + place).alias("_seq"),
                    (F.array(F.lit(unchanged)) if unchanged else F.array().cast("array<string>")).alias("_unchanged"),
                    (F.col("o_custkey") if row else F.lit(None).cast("long")).alias("o_custkey"),
                    col("o_orderstatus", status),
                    (F.expr(price) if row else F.lit(None)).cast("double").alias("o_totalprice"),
                    (F.col("o_orderdate") if row else F.lit(None).cast("timestamp_ntz")).alias("o_orderdate"),
                    (F.lit(None).cast("string") if unchanged or not row else F.col("o_orderpriority")).alias("o_orderpriority"),
                ),
            )
        )
    return load(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array_compact(F.array(*events))).alias("e")).select("o_orderkey", "e.*")


#: The same log. `unchanged` is one name or NULL.
LOG_SQL = "log AS (" + " UNION ALL ".join(
    f"SELECT o_orderkey, '{op}' AS op, o_orderkey * 10 + {place} AS seq, {repr(unchanged) if unchanged else 'CAST(NULL AS VARCHAR)'} AS unchanged, "
    + (f"o_custkey, {status} AS o_orderstatus, {price} AS o_totalprice, o_orderdate, {'CAST(NULL AS VARCHAR)' if unchanged else 'o_orderpriority'} AS o_orderpriority" if row else "CAST(NULL AS BIGINT) AS o_custkey, CAST(NULL AS VARCHAR) AS o_orderstatus, CAST(NULL AS DOUBLE) AS o_totalprice, CAST(NULL AS TIMESTAMP) AS o_orderdate, CAST(NULL AS VARCHAR) AS o_orderpriority")
    + f" FROM orders WHERE {when}"
    for when, op, place, status, price, unchanged, row in _EVENTS
) + ")"


#: What the whole log comes to, said directly: the orders that live, with their last values.
STATE_SQL = """
SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 6 = 0 AND o_orderkey % 10 <> 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 10 = 0
"""
