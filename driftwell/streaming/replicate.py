"""A staged change log as a stream into a table, and the whole cycle around each batch."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwell.functions.schema import TableSchema
from driftwell.operators import control, metadata
from driftwell.operators.fold import cycle_stats, materialise
from driftwell.operators.table import CompactionResult, Table
from driftwell.sources.changelog import STAGED, unstage
from driftwell.sources.tables import next_watermark, poll

#: Times that a batch is tried again when another writer's commit came first.
RETRIES = 3


def now_in_ms() -> int:
    return time.time_ns() // 1_000_000


def apply_batch(table: Table, log: DataFrame, batch: int, now_ms: int = 0, compact: bool = True) -> int:
    """Fold one batch onto the table. A batch that was committed before changes nothing, so replays are safe; one that
    another writer's commit overtook is folded again, onto what that left."""
    for attempt in range(RETRIES + 1):
        schema: TableSchema = table.schema()
        try:
            out = table.commit(materialise(log, table.read(), schema.key, table.partition_sources()), now_ms, batch)
            break
        except FileExistsError:
            if attempt == RETRIES:
                raise
    if compact:
        table.compact(now_ms)
    return out


def replicate(spark: SparkSession, staged_path: str, table: Table, checkpoint: str, files_per_batch: int = 64, trigger: dict | None = None, clock: Callable[[], int] = now_in_ms, each: Callable[[DataFrame, int, int], None] | None = None) -> StreamingQuery:
    """Follow a folder of staged files. The commit carries the batch number and comes before the stream's own
    checkpoint, so a batch may be replayed and still counts once. Commits carry the clock's time, by which they expire.
    each, if given, takes the place of apply_batch: (log, batch, now in ms), as `Cycle.run` does."""
    stream = spark.readStream.schema(STAGED).option("maxFilesPerTrigger", files_per_batch).parquet(staged_path)

    def step(batch: DataFrame, number: int) -> None:
        schema = table.schema()
        log = unstage(batch, schema.struct(), schema.key)
        each(log, number, clock()) if each else apply_batch(table, log, number, clock())

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass
class Cycle:
    """What surrounds a batch: the gate, the commit, compaction, markers, the cursor and the operational tables.

    The table's commit comes first and decides; everything after it can be done again from what it says, so a cycle that
    died half way is run again with the same batch number.
    """

    name: str
    table: Table
    control: control.Tables
    worker: str = "worker"

    def run(self, log: DataFrame, batch: int, now_ms: int, end_offset: int | None = None, commit_sha: str = "") -> int | None:
        """One batch, or None while the table's snapshot isn't complete."""
        if not self.control.is_open(self.name):
            return None
        began, before = now_in_ms(), self.table.snapshot
        snapshot = apply_batch(self.table, log, batch, now_ms, compact=False)
        stats = cycle_stats(log).first()
        if snapshot > before:
            self._record_commit(snapshot, stats, now_ms, now_in_ms() - began, commit_sha)
        if (done := self.table.compact(now_ms)) is not None:
            self._record_compaction(done, now_ms, commit_sha)
        if end_offset is not None:
            self.control.advance(self.name, end_offset)
        self.control.emit_markers(self.name, snapshot)
        metadata.write(metadata.record(self.table.spark, metadata.CHECKPOINTS, [{"ts": _time(now_ms), "worker_id": self.worker, "lsn": stats["max_lsn"], "last_flush_at": _time(now_ms), "engine_commit_sha": commit_sha}]), self.control.path("checkpoints"))
        return snapshot

    def _record_commit(self, snapshot: int, stats: object, now_ms: int, took_ms: int, commit_sha: str) -> None:
        entry = next(m for m in self.table.history() if m["snapshot"] == snapshot)
        files = [*entry["data"], *entry["deletes"]]
        row = {
            "ts": _time(now_ms), "worker_id": self.worker, "table_name": self.name, "mode": "logical", "snapshot_id": snapshot, "sequence_number": snapshot,
            "lsn": stats["max_lsn"], "rows": stats["rows"], "bytes": sum(f["bytes"] for f in files), "duration_ms": took_ms, "data_files": len(entry["data"]), "delete_files": len(entry["deletes"]),
            "max_source_ts": stats["max_source_ts"], "schema_id": 0, "tx_count": stats["tx_count"], "engine_commit_sha": commit_sha,
        }
        metadata.write(metadata.record(self.table.spark, metadata.COMMITS, [row]), self.control.path("commits"))

    def _record_compaction(self, done: CompactionResult, now_ms: int, commit_sha: str) -> None:
        number = self.table.snapshot
        row = {"ts": _time(now_ms), "worker_id": self.worker, "table_name": self.name, "snapshot_id": number, "sequence_number": number, "engine_commit_sha": commit_sha, **vars(done)}
        metadata.write(metadata.record(self.table.spark, metadata.COMPACTIONS, [row]), self.control.path("compactions"))

    def maintain(self, now_ms: int, retention_ms: int, grace_ms: int, commit_sha: str = "") -> dict:
        """Expire and clean, and say so in the operational table."""
        out = self.table.maintain(now_ms, retention_ms, grace_ms)
        common = {"ts": _time(now_ms), "worker_id": self.worker, "table_name": self.name, "engine_commit_sha": commit_sha}
        rows = [common | {"operation": "expire_snapshots", "items_affected": out["expired"]}, common | {"operation": "clean_orphans", "items_affected": out["deleted"], "bytes_freed": out["bytes_freed"]}]
        metadata.write(metadata.record(self.table.spark, metadata.MAINTENANCE, rows), self.control.path("maintenance"))
        return out


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc)


def upsert_poll(source: DataFrame, table: Table, watermark: str, after: object | None = None, now_ms: int = 0) -> int:
    """One poll of a table by watermark, applied as upserts."""
    schema = table.schema()
    return table.commit(materialise(_sequenced(poll(source, schema.key, watermark, after, overlap=True)), table.read(), schema.key), now_ms)


def poll_cycle(name: str, source: DataFrame, table: Table, watermark: str, controls: control.Tables, now_ms: int = 0) -> object | None:
    """Poll from the watermark kept for the table, and keep the new one once the rows are committed."""
    after = controls.watermark(name)
    if after is not None:
        after = F.lit(after).cast(source.schema[watermark].dataType)
    upsert_poll(source, table, watermark, after, now_ms)
    newest = next_watermark(source, watermark)
    if newest is not None:
        controls.keep_watermark(name, str(newest))
    return newest


def _sequenced(polled: DataFrame) -> DataFrame:
    return polled.withColumn("_seq", F.lit(0).cast("long"))
