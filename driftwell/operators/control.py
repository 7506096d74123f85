"""Control tables: staged-log offsets, cursors, markers, work assignment, and the rules that guard them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from driftwell.functions.schema import TableSchema, apply, diff
from driftwell.operators.table import Table

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()
#: The control tables with their keys and columns.
CONTROL_TABLES = {
    "log_index": (["table_name", "end_offset"], [("table_name", _S), ("end_offset", _L), ("start_offset", _L), ("s3_path", _S), ("record_count", _L), ("flushable_lsn", _L)]),
    "log_seq": (["table_name"], [("table_name", _S), ("next_offset", _L)]),
    "cursors": (["table_name"], [("table_name", _S), ("last_offset", _L)]),
    "tables": (["table_name"], [("table_name", _S), ("snapshot_complete", _B), ("snapshot_lsn", _L), ("pg_oid", _L)]),
    "pending_markers": (["uuid"], [("uuid", _S), ("commit_lsn", _L)]),
    "marker_emissions": (["uuid", "table_name"], [("uuid", _S), ("table_name", _S), ("snapshot_id", _L)]),
    "watermarks": (["table_name"], [("table_name", _S), ("watermark", _S)]),
}


class Tables:
    """The control tables of one deployment, each a table of this engine under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def schema(self, name: str) -> TableSchema:
        key, columns = CONTROL_TABLES[name]
        return TableSchema.of(T.StructType([T.StructField(c, kind) for c, kind in columns]), key)

    def table(self, name: str) -> Table:
        return Table(self.spark, self.path(name))

    def create(self) -> None:
        """Create what is missing; what is there stays."""
        for name in CONTROL_TABLES:
            Table.create(self.spark, self.path(name), self.schema(name))

    def migrate(self) -> list[str]:
        """Bring tables of an earlier layout to the present columns; the names of those changed. Columns are only
        added: those that are no longer known stay as they are."""
        changed = []
        self.create()
        for name, (_, columns) in CONTROL_TABLES.items():
            table, now = self.table(name), {c.name: c.type for c in self.table(name).schema().columns}
            if missing := {c: kind for c, kind in columns if c not in now}:
                table.evolve(apply(table.schema(), diff(table.schema(), now | missing)))
                changed.append(name)
        return changed

    def drop(self) -> None:
        for name in CONTROL_TABLES:
            self.table(name).files.delete("")

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def put(self, name: str, rows: DataFrame) -> None:
        """Upsert complete rows."""
        key, columns = CONTROL_TABLES[name]
        table = self.table(name)
        known = table.read().select(*key, F.lit(True).alias("_known"))
        op = F.when(F.col("_known"), "U").otherwise("I").alias("_op")
        table.commit(rows.join(known, key, "left").select(op, *(c for c, _ in columns)))

    def _put(self, name: str, *values: object) -> None:
        _, columns = CONTROL_TABLES[name]
        self.put(name, self.spark.createDataFrame([values], T.StructType([T.StructField(c, kind) for c, kind in columns])))

    def register(self, name: str, oid: int = 0) -> None:
        self._put("tables", name, False, 0, oid)

    def snapshot_done(self, name: str, lsn: int) -> None:
        oid = self.read("tables").where(F.col("table_name") == name).select("pg_oid").first()
        self._put("tables", name, True, lsn, oid[0] if oid else 0)

    def is_open(self, name: str) -> bool:
        """Whether a table may be replicated: its snapshot is complete."""
        return not self.read("tables").where((F.col("table_name") == name) & F.col("snapshot_complete")).isEmpty()

    def stage(self, claims: DataFrame) -> None:
        """Give staged files (table_name, claim_no, record_count, s3_path, flushable_lsn) their offsets, and enter them."""
        counters = self.read("log_seq")
        claimed = claim_offsets(claims, counters).persist()
        try:
            self.put("log_index", claimed)
            self.put("log_seq", next_counters(claimed, counters))
        finally:
            claimed.unpersist()

    def cursor(self, name: str) -> int:
        row = self.read("cursors").where(F.col("table_name") == name).first()
        return row["last_offset"] if row else 0

    def advance(self, name: str, offset: int) -> None:
        """Move a cursor on; it never goes back."""
        if offset > self.cursor(name):
            self._put("cursors", name, offset)

    def emit_markers(self, name: str, snapshot: int) -> None:
        """Enter the snapshot that the table stood at when a marker's changes were all in it."""
        due = eligible_markers(self.read("pending_markers"), self.read("marker_emissions"), self.read("log_index"), self.read("cursors"), name)
        self.put("marker_emissions", due.select("uuid", F.lit(name).alias("table_name"), F.lit(snapshot).cast("long").alias("snapshot_id")))

    def watermark(self, name: str) -> str | None:
        row = self.read("watermarks").where(F.col("table_name") == name).first()
        return row["watermark"] if row else None

    def keep_watermark(self, name: str, value: str) -> None:
        self._put("watermarks", name, value)


def claim_offsets(claims: DataFrame, counters: DataFrame) -> DataFrame:
    """[start_offset, end_offset) of each claim: per table contiguous, in the order of claim_no, from its counter on.

    claims: (table_name, claim_no, record_count, ...); counters: (table_name, next_offset), 0 where missing.
    """
    upto = F.sum("record_count").over(Window.partitionBy("table_name").orderBy("claim_no").rowsBetween(Window.unboundedPreceding, 0))
    base = claims.join(counters, "table_name", "left").withColumn("_base", F.coalesce("next_offset", F.lit(0).cast("long"))).drop("next_offset")
    return base.withColumn("end_offset", F.col("_base") + upto).withColumn("start_offset", F.col("end_offset") - F.col("record_count")).drop("_base")


def next_counters(claimed: DataFrame, counters: DataFrame) -> DataFrame:
    new = claimed.select("table_name", F.col("end_offset").alias("next_offset"))
    return counters.select("table_name", "next_offset").unionByName(new).groupBy("table_name").agg(F.max("next_offset").alias("next_offset"))


def unread(log_index: DataFrame, table: str, cursor: int, limit: int) -> DataFrame:
    """The next staged files of a table beyond its cursor, in offset order."""
    return log_index.where((F.col("table_name") == table) & (F.col("end_offset") > cursor)).orderBy("end_offset").limit(limit)


def spent(log_index: DataFrame, cursors: DataFrame) -> DataFrame:
    """Staged files at or below their table's cursor: safe to delete."""
    return log_index.join(cursors, "table_name").where("end_offset <= last_offset").select("table_name", "end_offset", "s3_path")


def eligible_markers(pending: DataFrame, emitted: DataFrame, log_index: DataFrame, cursors: DataFrame, table: str) -> DataFrame:
    """Markers not yet emitted for the table, once no unread staged file has changes at or before their LSN; by (LSN,
    uuid), in which order they are given out."""
    mine = log_index.where(F.col("table_name") == table).join(cursors, "table_name", "left")
    first = mine.where(F.col("end_offset") > F.coalesce("last_offset", F.lit(-1))).agg(F.min("flushable_lsn").alias("_first"))
    todo = pending.join(emitted.where(F.col("table_name") == table).select("uuid"), "uuid", "left_anti")
    # An unread file at or before the marker exists exactly if the smallest unread LSN is: one row instead of a theta join.
    return todo.crossJoin(F.broadcast(first)).where("_first IS NULL OR _first > commit_lsn").drop("_first").orderBy("commit_lsn", "uuid")


def pair_markers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Snapshots of two replicas that stand at one marker: (uuid, table_name, a_snapshot, b_snapshot)."""
    x = a.select("uuid", "table_name", F.col("snapshot_id").alias("a_snapshot"))
    return x.join(b.select("uuid", "table_name", F.col("snapshot_id").alias("b_snapshot")), ["uuid", "table_name"])


def assign(tables: DataFrame, workers: DataFrame) -> DataFrame:
    """(table_name, worker_id): sorted tables dealt round the sorted workers. Both are control tables, a row for each
    table or worker of a deployment."""
    n = workers.select("worker_id", (F.row_number().over(Window.orderBy("worker_id")) - 1).alias("_w"), F.count("*").over(Window.partitionBy()).alias("_n"))
    t = tables.select("table_name", (F.row_number().over(Window.orderBy("table_name")) - 1).alias("_t"))
    size = workers.agg(F.count("*").alias("_n"))
    return t.crossJoin(F.broadcast(size)).where("_n > 0").withColumn("_w", F.col("_t") % F.col("_n")).join(n.select("worker_id", "_w"), "_w").select("table_name", "worker_id")


def expired(consumers: DataFrame, now: Column) -> DataFrame:
    return consumers.where(F.col("expires_at") < now)


#: Rules over one state row for each table; every violated rule is reported. number: (message, condition).
STARTUP_RULES = {
    0: ("server too old", "server_version <> 0 AND server_version < 130000"),
    1: ("fresh start but the target exists", "fresh AND target_exists"),
    2: ("fresh start but the slot exists", "fresh AND slot_exists"),
    3: ("table is missing in the catalog", "NOT fresh AND NOT target_exists"),
    4: ("slot is gone after a snapshot", "NOT fresh AND NOT slot_exists AND snapshot_lsn > 0"),
    5: ("slot starts after the flushed position", "slot_exists AND flushed_lsn > 0 AND restart_lsn > flushed_lsn"),
    6: ("snapshot complete without a position", "logical_mode AND snapshot_complete AND snapshot_lsn = 0"),
    8: ("slot has lost its log", "wal_status = 'lost'"),
    9: ("slot conflicts", "conflicting"),
    10: ("table was recreated", "stored_oid <> 0 AND stored_oid <> current_oid"),
    11: ("table left the publication", "snapshot_complete AND NOT in_publication"),
    12: ("slot is confirmed beyond the flushed position", "flushed_lsn > 0 AND confirmed_lsn > flushed_lsn"),
}
#: Of the rules on the slot and server, which are the same for all tables, one row is enough.
GLOBAL_RULES = (0, 2, 4, 5, 8, 9, 12)
WATCH_RULES = {
    1: ("pipeline is ahead of the slot", "error", "pipeline_lsn > confirmed_lsn"),
    2: ("cursor is beyond the log", "error", "cursor >= 0 AND cursor > coalesce(max_end_offset, 0)"),
    3: ("position went back", "error", "pipeline_lsn < previous_lsn"),
    4: ("slot is not reserved", "warning", "wal_status = 'unreserved'"),
    5: ("slot has lost its log", "fatal", "wal_status = 'lost'"),
    6: ("slot conflicts", "fatal", "conflicting"),
}


def validate(state: DataFrame) -> DataFrame:
    """(rule, table_name, message) of every violation; rules on the whole deployment have no table name."""
    found = F.array(*(F.when(F.expr(c), F.struct(F.lit(n).alias("rule"), (F.lit(None).cast("string") if n in GLOBAL_RULES else F.col("table_name")).alias("table_name"), F.lit(m).alias("message"))) for n, (m, c) in STARTUP_RULES.items()))
    return state.select(F.explode(F.array_compact(found)).alias("v")).select("v.*").distinct()


def watch(samples: DataFrame) -> DataFrame:
    """(sample, table_name, rule, severity, message) over samples in time; a lower position becomes the new floor."""
    at = samples.withColumn("previous_lsn", F.lag("pipeline_lsn").over(Window.partitionBy("table_name").orderBy("sample")))
    found = F.array(*(F.when(F.expr(c), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.lit(m).alias("message"))) for n, (m, s, c) in WATCH_RULES.items()))
    return at.select("sample", "table_name", F.explode(F.array_compact(found)).alias("v")).select("sample", "table_name", "v.*")
