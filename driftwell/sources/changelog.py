"""Change logs as DataFrames, and the fixed envelope in which they are staged.

A change log has `_op` (I, U, D, T or R), `_seq` (its place in the log: rows of one transaction share an LSN, so
the LSN alone does not order them), optionally `_lsn`, `_ts`, `_xid`, `_unchanged` (names of columns that an update
left out) and `_table`, and the table's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL = ("_op", "_seq", "_lsn", "_ts", "_xid", "_unchanged", "_table")
#: Columns of a staged file, and its operation codes.
STAGED = T.StructType(
    [
        T.StructField("_op", T.StringType()),
        T.StructField("_lsn", T.LongType()),
        T.StructField("_ts", T.TimestampType()),
        T.StructField("_unchanged_cols", T.StringType()),
        T.StructField("_data", T.StringType()),
        T.StructField("_xid", T.LongType()),
        T.StructField("_seq", T.LongType()),
    ]
)
OPS = ("I", "U", "D", "T")


def payload(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in CONTROL]


def _or_null(log: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in log.columns else F.lit(None)).cast(kind).alias(name)


def stage(log: DataFrame) -> DataFrame:
    """The log in the envelope: schema changes are left out, truncates carry an empty object."""
    data = F.when(F.col("_op") == "T", "{}").otherwise(F.to_json(F.struct(*payload(log))))
    unchanged = F.to_json("_unchanged") if "_unchanged" in log.columns else F.lit(None).cast("string")
    return log.where("_op <> 'R'").select("_op", _or_null(log, "_lsn", "long"), _or_null(log, "_ts", "timestamp"), unchanged.alias("_unchanged_cols"), data.alias("_data"), _or_null(log, "_xid", "long"), "_seq")


def unstage(staged: DataFrame, schema: T.StructType, key: list[str] = ()) -> DataFrame:
    """The log back from the envelope, straight to the table's present types; an unknown operation raises.

    With the key's names, rows of a moved key bring the old one back in `_old_<key>` columns.
    """
    known = F.when(F.col("_op").isin(*OPS), F.col("_op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.col("_op"))).cast("string"))
    unchanged = F.coalesce(F.from_json("_unchanged_cols", "array<string>"), F.array().cast("array<string>"))
    old = [T.StructField(f"_old_{k}", schema[k].dataType) for k in key]
    parsed = staged.select(known.alias("_op"), "_seq", "_lsn", "_ts", "_xid", unchanged.alias("_unchanged"), F.from_json("_data", T.StructType([*schema.fields, *old]), {"mode": "FAILFAST"}).alias("row"))
    return parsed.select("_op", "_seq", "_lsn", "_ts", "_xid", "_unchanged", "row.*")


def write_staged(log: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    stage(log).write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_staged(spark: SparkSession, path: str, schema: T.StructType, key: list[str] = ()) -> DataFrame:
    return unstage(spark.read.schema(STAGED).parquet(path), schema, key)


def without_keepalives(messages: DataFrame) -> DataFrame:
    """Stream messages but those that only say the source is alive (`_op` K): they carry a position and no change."""
    return messages.where("_op <> 'K'")


def committed(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows of transactions that committed, in commit order, with `_commit_seq`; rows without a transaction pass.

    commits: (_xid, _commit_seq). A rolled-back transaction has no row there.
    """
    done = log.where("_xid IS NOT NULL").join(commits, "_xid")
    free = log.where("_xid IS NULL").withColumn("_commit_seq", F.col("_seq"))
    return done.unionByName(free)


def flushable_lsn(log: DataFrame) -> DataFrame:
    """The position up to which the source may forget, once the log's rows are kept. Keepalives count."""
    return log.agg(F.max("_lsn").alias("flushable_lsn"))


def check_payload(op: Column, before: Column, after: Column) -> Column:
    """Whether a change carries what its operation needs: inserts and updates the new row, deletes the old one."""
    return F.when(op.isin("I", "U"), after.isNotNull()).when(op == "D", before.isNotNull()).otherwise(True)


def checked(changes: DataFrame) -> DataFrame:
    """Changes with `before` and `after` structs; one that does not carry what its operation needs raises."""
    fine = check_payload(F.col("_op"), F.col("before"), F.col("after"))
    message = F.concat(F.lit("no row in change "), F.col("_seq").cast("string"))
    return changes.withColumn("_op", F.when(fine, F.col("_op")).otherwise(F.raise_error(message).cast("string")))


def split_key_changes(changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Changes with `before` and `after` structs to log rows: an update that moves the key deletes the old one first.

    `_seq` is doubled to make room. The row of the new key remembers the old one in `_old_<key>` columns, so that
    values the update left out can be looked up under it.
    """
    moved = (F.col("_op") == "U") & F.col("before").isNotNull()
    differs = F.lit(False)
    for k in key:
        differs = differs | ~F.col(f"before.{k}").eqNullSafe(F.col(f"after.{k}"))
    moved = moved & differs
    source = F.when(F.col("_op") == "D", F.col("before")).otherwise(F.col("after"))
    own = F.struct(F.col("_op").alias("op"), F.lit(0).alias("late"), source.alias("row"))
    first = F.struct(F.lit("D").alias("op"), F.lit(0).alias("late"), F.col("before").alias("row"))
    then = F.struct(F.lit("U").alias("op"), F.lit(1).alias("late"), F.col("after").alias("row"))
    out = changes.withColumn("_moved", moved).withColumn("e", F.explode(F.when(moved, F.array(first, then)).otherwise(F.array(own))))
    old = [F.when(F.col("_moved") & (F.col("e.op") == "U"), F.col(f"before.{k}")).alias(f"_old_{k}") for k in key]
    rest = [c for c in changes.columns if c in CONTROL and c not in ("_op", "_seq")]
    return out.select(F.col("e.op").alias("_op"), (F.col("_seq") * 2 + F.col("e.late")).alias("_seq"), *rest, *(F.col(f"e.row.{c}").alias(c) for c in columns), *old)


def explode_truncates(messages: DataFrame) -> DataFrame:
    """One truncate message for several tables to one event for each, in the order named; others pass."""
    tables = F.when(F.col("_op") == "T", F.col("_tables")).otherwise(F.array("_table"))
    out = messages.select("*", F.posexplode(tables).alias("_nth", "_name"))
    return out.withColumn("_table", F.col("_name")).drop("_name", "_tables")


def published(log: DataFrame, tables: list[str], parents: DataFrame | None = None) -> DataFrame:
    """Rows of listed tables; partitions are reported as their parent. parents: (child, parent)."""
    if parents is not None:
        log = log.join(parents, log["_table"] == parents["child"], "left").withColumn("_table", F.coalesce("parent", "_table")).drop("child", "parent")
    return log.where(F.col("_table").isin(tables))


def renamed(log: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Source table names to target names; those without an entry keep theirs."""
    if not targets:
        return log
    pairs = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))
    return log.withColumn("_table", F.coalesce(F.try_element_at(pairs, F.col("_table")), F.col("_table")))


def take_markers(log: DataFrame, marker_table: str, uuid_column: str = "uuid") -> tuple[DataFrame, DataFrame]:
    """(data, markers): inserts into the marker table leave the data and become (uuid, commit_lsn)."""
    is_marker = F.col("_table") == marker_table
    markers = log.where(is_marker & (F.col("_op") == "I")).select(F.col(uuid_column).alias("uuid"), F.col("_lsn").alias("commit_lsn"))
    return log.where(~is_marker), markers
