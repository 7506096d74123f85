"""Operational tables, and the questions they answer. `now` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(spec: str) -> T.StructType:
    kinds = {"ts": T.TimestampType(), "s": T.StringType(), "i": T.IntegerType(), "l": T.LongType()}
    fields = []
    for n, part in enumerate(spec.split(), 1):
        name, kind = part.split(":")
        fields.append(T.StructField(name.rstrip("!"), kinds[kind], not name.endswith("!"), {"id": n}))
    return T.StructType(fields)


#: Names, types and order of the operational tables' columns; ! marks those that are never NULL.
COMMITS = _schema("ts!:ts worker_id:s table_name!:s mode!:s snapshot_id!:l sequence_number!:l lsn:l rows:l bytes:l duration_ms:l data_files:i delete_files:i max_source_ts:ts schema_id:i tx_count:i engine_commit_sha:s")
CHECKPOINTS = _schema("ts!:ts worker_id:s lsn:l last_flush_at:ts engine_commit_sha:s")
COMPACTIONS = _schema("ts!:ts worker_id:s table_name!:s partition:s snapshot_id!:l sequence_number!:l input_data_files:i input_delete_files:i output_data_files:i rows_rewritten:l rows_removed:l bytes_before:l bytes_after:l duration_ms:l engine_commit_sha:s")
MAINTENANCE = _schema("ts!:ts worker_id:s table_name!:s operation!:s items_affected:i bytes_freed:l duration_ms:l engine_commit_sha:s")
MARKERS = T.StructType([T.StructField("uuid", T.StringType(), False), T.StructField("table_name", T.StringType(), False), T.StructField("snapshot_id", T.LongType(), False)])


def record(spark: SparkSession, schema: T.StructType, rows: list[dict]) -> DataFrame:
    """Rows of an operational table; empty texts and zeros of nullable columns become NULL."""
    clean = lambda f, v: None if f.nullable and v in ("", 0) else v
    return spark.createDataFrame([tuple(clean(f, r.get(f.name)) for f in schema) for r in rows], schema)


def normalised(rows: DataFrame, schema: T.StructType) -> DataFrame:
    def col(f: T.StructField) -> Column:
        c = F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if not f.nullable or isinstance(f.dataType, T.TimestampType):
            return c.alias(f.name)
        return F.nullif(c, F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0).cast(f.dataType)).alias(f.name)

    return rows.select(*map(col, schema))


def write(rows: DataFrame, path: str) -> None:
    """Append, by day."""
    rows.withColumn("ts_day", F.to_date("ts")).write.mode("append").partitionBy("ts_day").parquet(path)


def freshness(commits: DataFrame, now: Column) -> DataFrame:
    """Seconds since each table's last commit and since its newest source change."""
    seconds = lambda c: F.timestamp_diff("SECOND", c, now)
    return commits.groupBy("table_name").agg(F.max("ts").alias("last_commit"), F.max("max_source_ts").alias("last_source")).select("table_name", seconds(F.col("last_commit")).alias("seconds_since_commit"), seconds(F.col("last_source")).alias("source_lag_seconds"))


def heartbeat(checkpoints: DataFrame, now: Column) -> DataFrame:
    return checkpoints.groupBy("worker_id").agg(F.max("ts").alias("last_seen")).select("worker_id", F.timestamp_diff("SECOND", "last_seen", now).alias("seconds_silent"))


def lag_by_hour(commits: DataFrame) -> DataFrame:
    lag = F.timestamp_diff("MILLISECOND", "max_source_ts", "ts")
    return commits.where("max_source_ts IS NOT NULL").groupBy("table_name", F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.avg(lag), 3).alias("avg_lag_ms"), F.max(lag).alias("max_lag_ms"), F.count("*").alias("commits"))


def throughput(commits: DataFrame, since: Column) -> DataFrame:
    return commits.where(F.col("ts") >= since).groupBy("table_name").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.sum("tx_count").alias("transactions"), F.count("*").alias("commits"))


def deletes_since_compaction(commits: DataFrame, compactions: DataFrame) -> DataFrame:
    last = compactions.groupBy("table_name").agg(F.max("ts").alias("last_ts"))
    return commits.join(last, "table_name", "left").where("last_ts IS NULL OR ts > last_ts").groupBy("table_name").agg(F.sum(F.coalesce("delete_files", F.lit(0))).alias("delete_files"), F.sum(F.coalesce("data_files", F.lit(0))).alias("data_files"))


def compaction_effect(compactions: DataFrame) -> DataFrame:
    files = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return compactions.groupBy("table_name").agg((files("input_data_files") + files("input_delete_files")).alias("files_in"), files("output_data_files").alias("files_out"), files("rows_removed").alias("rows_removed"), (files("bytes_before") - files("bytes_after")).alias("bytes_saved"))
