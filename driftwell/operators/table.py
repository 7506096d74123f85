"""Snapshot-versioned tables: data files, equality-delete files, and one manifest file for each snapshot.

A data row carries the snapshot that wrote it. An equality delete of snapshot N hides rows of its key from snapshots
before N and none of N itself. A manifest is written last and never overwritten: that is the commit. A compaction
changes no row, so it has no snapshot of its own: its manifest is a further revision of the snapshot that it rewrites.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from itertools import takewhile
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import partition
from driftwell.functions.schema import TableSchema, conform, not_null

SNAPSHOT = "_snapshot"
#: Defaults of the table services.
DATA_FILES, DELETE_FILES, TARGET_BYTES = 8, 4, 128 << 20


@dataclass(frozen=True)
class CompactionResult:
    input_data_files: int
    input_delete_files: int
    output_data_files: int
    rows_rewritten: int
    rows_removed: int
    bytes_before: int
    bytes_after: int


class Files:
    """A folder on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm, self.conf, self.root = spark, spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, relative: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{relative}".rstrip("/"))

    def list(self, relative: str, suffix: str = "") -> list[tuple[str, int, int]]:
        """(relative path, bytes, modified in ms) of the files below a folder."""
        top = self._path(relative)
        if not self.fs.exists(top):
            return []
        base, out, it = self.fs.makeQualified(self._path("")).toString(), [], self.fs.listFiles(top, True)
        while it.hasNext():
            f = it.next()
            name = f.getPath().toString()[len(base) + 1 :]
            if name.endswith(suffix):
                out.append((name, f.getLen(), f.getModificationTime()))
        return sorted(out)

    def read(self, relative: str) -> str:
        stream = self.fs.open(self._path(relative))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, relative: str, text: str) -> None:
        """Write whole, then give the file its name, which fails if the name is taken: one of two writers wins.

        On a local disk that is a hard link; elsewhere a rename that does not overwrite, which name nodes do in one
        step. A store without such a rename needs a committer of its own.
        """
        part, target = self._path(f"{relative}.{uuid.uuid4().hex}"), self._path(relative)
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        try:
            if self.fs.getUri().getScheme() == "file":
                link = self.jvm.java.nio.file.Files.createLink
                link(self.jvm.java.io.File(target.toUri().getPath()).toPath(), self.jvm.java.io.File(part.toUri().getPath()).toPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                hadoop.FileContext.getFileContext(target.toUri(), self.conf).rename(part, target, none)
        except Py4JJavaError as e:
            if not self.fs.exists(target):
                raise
            raise FileExistsError(relative) from e
        finally:
            self.fs.delete(part, False)

    def delete(self, relative: str) -> None:
        self.fs.delete(self._path(relative), True)


class Table:
    """A table under one folder. Every method that changes it makes at most one snapshot."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self._manifests: dict[str, dict] = {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: TableSchema) -> Table:
        """Create, or load if it is there."""
        table = cls(spark, path)
        if not table.files.list("_manifest", ".json"):
            table._commit(0, 0, {"kind": "create", "schema": schema.to_json()})
        return table

    def history(self, upto: int | None = None) -> list[dict]:
        """Manifests in order, a base in place of all that it sums up. They never change, so each is read once."""
        names = [name for name, _, _ in self.files.list("_manifest", ".json")]
        self._manifests = {n: self._manifests.get(n) or json.loads(self.files.read(n)) for n in names}
        out = list(self._manifests.values())
        base = max((_place(m) for m in out if m["kind"] == "base"), default=(-1, 0))
        out = [m for m in out if _place(m) > base or (_place(m) == base and m["kind"] == "base")]
        return [m for m in out if upto is None or m["snapshot"] <= upto]

    def _commit(self, snapshot: int, now_ms: int, body: dict) -> int:
        entry = {"snapshot": snapshot, "timestamp_ms": now_ms, "data": [], "deletes": [], "removed": []} | body
        self.files.create(_manifest(entry), json.dumps(entry))
        return snapshot

    @property
    def snapshot(self) -> int:
        return self.history()[-1]["snapshot"]

    def schema(self, upto: int | None = None) -> TableSchema:
        return TableSchema.from_json([m for m in self.history(upto) if "schema" in m][-1]["schema"])

    def evolve(self, schema: TableSchema, now_ms: int = 0) -> int:
        return self._commit(self.snapshot + 1, now_ms, {"kind": "schema", "schema": schema.to_json()})

    def live_files(self, kind: str, upto: int | None = None) -> list[dict]:
        """Files of a kind that no snapshot up to `upto` removed, oldest first."""
        history = self.history(upto)
        gone = {p for m in history for p in m["removed"]}
        return [f for m in history for f in m[kind] if f["path"] not in gone]

    def _transforms(self) -> list[partition.Transform]:
        return [partition.parse(p) for p in self.schema().partitions]

    def _write(self, rows: DataFrame, folder: str, partitioned: bool, columns: list[str] | None = None) -> list[dict]:
        """Write rows, or some columns of them, under a folder of its own; the files made, with their sizes."""
        where = f"{folder}/{uuid.uuid4().hex}"
        writer = rows.write
        if partitioned and (parts := self._transforms()):
            kinds = {c.name: c.type for c in self.schema().columns}
            names = [f"_p_{t.name}" for t in parts]
            for t, name in zip(parts, names, strict=True):
                rows = rows.withColumn(name, partition.apply(t, F.col(t.column), kinds[t.column]))
            # One task for each partition value, split further by size at run time.
            writer = rows.select(*(columns or rows.columns), *names * bool(columns)).hint("rebalance", *names).write.partitionBy(*names)
        writer.option("compression", "zstd").parquet(f"{self.path}/{where}")
        return [{"path": name, "bytes": size} for name, size, _ in self.files.list(where, ".parquet")]

    def commit(self, changes: DataFrame, now_ms: int = 0, batch: int | None = None) -> int:
        """Apply complete operations (`_op` and the table's columns, one row for each key) as one snapshot.

        Inserts and updates add a row; updates and deletes hide the key's earlier ones. A batch number that was
        committed before, or a batch without rows, makes no snapshot.
        """
        history = self.history()
        if batch is not None and self._applied(history, batch):
            return history[-1]["snapshot"]
        schema, number = self.schema(), history[-1]["snapshot"] + 1
        # Both files come from the same rows; keep those where the reads of the table must not be repeated.
        changes = changes.persist()
        try:
            stamp = F.lit(number).cast("long").alias(SNAPSHOT)
            rows = not_null(conform(changes.where("_op IN ('I', 'U')"), schema), schema)
            data = self._write(rows.select("*", stamp), "data", True)
            deletes = self._write_deletes(changes.where("_op IN ('U', 'D')").withColumn(SNAPSHOT, stamp), [*schema.key, SNAPSHOT])
        finally:
            changes.unpersist()
        files = self._with_rows([*data, *deletes])
        data, deletes = ([f for f in files if f["path"].startswith(kind)] for kind in ("data/", "deletes/"))
        if not data and not deletes:
            return history[-1]["snapshot"]
        return self._commit(number, now_ms, {"kind": "append", "data": data, "deletes": deletes, "batch": batch})

    def _write_deletes(self, rows: DataFrame, columns: list[str]) -> list[dict]:
        """Deletes lie in the partition of the row that they hide, where that is known, so that a read that passes over
        its data passes over them too; the others lie outside all partitions and are always read."""
        if "_was" not in rows.columns or not self._transforms():
            return self._write(rows.select(*columns), "deletes", False)
        known = rows.where("_was IS NOT NULL")
        sources = [F.col(f"_was.{c}").alias(c) for c in self.partition_sources() if c not in columns]
        inside = self._write(known.select(*columns, *sources), "deletes", True, columns)
        return inside + self._write(rows.where("_was IS NULL").select(*columns), "deletes", False)

    def partition_sources(self) -> list[str]:
        """The columns that partitions are made of."""
        return list(dict.fromkeys(t.column for t in self._transforms()))

    def data_files(self) -> DataFrame:
        """(path, bytes, rows) of the live data files."""
        return self.spark.createDataFrame([(f["path"], f["bytes"], f["rows"]) for f in self.live_files("data")], "path string, bytes long, rows long")

    @staticmethod
    def _applied(history: list[dict], batch: int) -> bool:
        """Whether a batch was committed before. Of expired snapshots the highest number is known: batches are numbered
        upwards, so lower ones came before it."""
        return any(m.get("batch") == batch or m["kind"] == "base" and m.get("batch") is not None and batch <= m["batch"] for m in history)

    def _with_rows(self, files: list[dict]) -> list[dict]:
        """Row counts from the files; those without rows are deleted."""
        if not files:
            return files
        # Without columns to read, the counts come from the files' footers.
        counts = dict(self.spark.read.schema("_none int").parquet(*(f"{self.path}/{f['path']}" for f in files)).groupBy(_relative().alias("f")).count().collect())
        for f in files:
            f["rows"] = counts.get(f["path"], 0)
            if not f["rows"]:
                self.files.delete(f["path"])
        return [f for f in files if f["rows"]]

    def _data(self, files: list[dict], schema: TableSchema, with_file: bool = False) -> DataFrame:
        """Rows of data files under the table's schema: Parquet widens promoted columns and fills missing ones."""
        struct = schema.struct().add(SNAPSHOT, "long")
        if not files:
            out = self.spark.createDataFrame([], struct)
            return out.withColumn("_file", F.lit(None).cast("string")) if with_file else out
        rows = self.spark.read.schema(struct).parquet(*(f"{self.path}/{f['path']}" for f in files))
        return rows.withColumn("_file", _relative()) if with_file else rows

    def _deleted(self, files: list[dict], schema: TableSchema) -> DataFrame:
        """(key, _deleted): the last snapshot that hides each key."""
        struct = schema.struct().add(SNAPSHOT, "long")
        keys = type(struct)([f for f in struct if f.name in schema.key or f.name == SNAPSHOT])
        rows = self.spark.read.schema(keys).parquet(*(f"{self.path}/{f['path']}" for f in files)) if files else self.spark.createDataFrame([], keys)
        return rows.groupBy(*schema.key).agg(F.max(SNAPSHOT).alias("_deleted"))

    def read(self, snapshot: int | None = None, where: dict[str, tuple] | None = None, sequence: bool = False) -> DataFrame:
        """Live rows, at the end or as of a snapshot. where: {column: (low, high)} prunes files by hidden partition
        before the scan, and filters the rows."""
        schema = self.schema(snapshot)
        data, deletes = self.live_files("data", snapshot), self.live_files("deletes", snapshot)
        kinds = {c.name: c.type for c in schema.columns}
        if where:
            data, deletes = self._pruned(data, where, kinds), self._pruned(deletes, where, kinds)
        rows = self._data(data, schema)
        for c, (low, high) in (where or {}).items():
            rows = rows.where(F.col(c).between(F.lit(low).cast(kinds[c]), F.lit(high).cast(kinds[c])))
        if deletes:
            hidden = self._deleted(deletes, schema)
            rows = rows.join(hidden, schema.key, "left").where(f"_deleted IS NULL OR _deleted <= {SNAPSHOT}").drop("_deleted")
        columns = [c.name for c in schema.columns if not c.name.endswith(f"__dropped{c.field_id}")]
        return rows.select(*columns, *[SNAPSHOT] * sequence)

    def _pruned(self, files: list[dict], where: dict[str, tuple], kinds: dict) -> list[dict]:
        for t in self._transforms():
            if t.column not in where:
                continue
            low, high = where[t.column]
            condition = partition.prune(t, low, high, kinds[t.column])
            if condition is None:
                continue
            kind = self.spark.range(1).select(partition.apply(t, F.lit(low).cast(kinds[t.column]), kinds[t.column]).alias("x")).schema["x"].dataType
            if kind.typeName() == "binary":
                continue
            values = sorted({f["path"].split(f"_p_{t.name}=")[1].split("/")[0] for f in files if f"_p_{t.name}=" in f["path"]} - {partition.NULL_SEGMENT})
            rows = self.spark.createDataFrame([(v, unquote(v)) for v in values], "raw string, value string").select("raw", F.col("value").cast(kind).alias(t.name))
            keep = {r["raw"] for r in rows.where(condition).collect()}
            if kind.typeName() == "string":
                keep.add(partition.NULL_SEGMENT)  # empty texts lie with NULLs
            files = [f for f in files if f"_p_{t.name}=" not in f["path"] or f["path"].split(f"_p_{t.name}=")[1].split("/")[0] in keep]
        return files

    def compact(self, now_ms: int = 0, data_files: int = DATA_FILES, delete_files: int = DELETE_FILES, target_bytes: int = TARGET_BYTES, force: bool = False) -> CompactionResult | None:
        """Rewrite small files and files with hidden rows, and drop all delete files, once there are enough of either.

        The rows' own snapshots stay, so reads as of earlier snapshots are unchanged. None if there is nothing to do.
        """
        at = self.history()[-1]
        data, deletes = self.live_files("data", at["snapshot"]), self.live_files("deletes", at["snapshot"])
        if not force and len(data) < data_files and len(deletes) < delete_files:
            return None
        schema = self.schema()
        hidden = self._deleted(deletes, schema)
        touched = set()
        if deletes:
            rows = self._data(data, schema, with_file=True).select(*schema.key, SNAPSHOT, "_file")
            dead = rows.join(hidden, schema.key).where(f"_deleted > {SNAPSHOT}").select("_file").distinct()
            touched = {r[0] for r in dead.collect()}
        chosen = [f for f in data if f["bytes"] < target_bytes // 2 or f["path"] in touched]
        if not chosen and not deletes:
            return None
        rows = self._data(chosen, schema)
        newest = rows.groupBy(*schema.key).agg(F.max(F.struct(SNAPSHOT, *(c.name for c in schema.columns if not c.key))).alias("r"))
        newest = newest.select(*(F.col(c.name) if c.key else F.col(f"r.{c.name}").alias(c.name) for c in schema.columns), F.col(f"r.{SNAPSHOT}").alias(SNAPSHOT))
        kept = newest.join(hidden, schema.key, "left").where(f"_deleted IS NULL OR _deleted <= {SNAPSHOT}").drop("_deleted") if deletes else newest
        if not self._transforms():  # files of the target's size, or the next call would find as many small ones again
            kept = kept.repartition(-(-sum(f["bytes"] for f in chosen) // max(target_bytes, 1)) or 1)
        made = self._with_rows(self._write(kept, "data", True)) if chosen else []
        before = sum(f["rows"] for f in chosen)
        removed = [f["path"] for f in [*chosen, *deletes]]
        self._commit(at["snapshot"], now_ms, {"kind": "replace", "revision": at.get("revision", 0) + 1, "data": made, "removed": removed})
        distinct = newest.count() if chosen else 0
        after = sum(f["rows"] for f in made)
        return CompactionResult(len(chosen), len(deletes), len(made), before, distinct - after, sum(f["bytes"] for f in [*chosen, *deletes]), sum(f["bytes"] for f in made))

    def expire(self, retention_ms: int) -> int:
        """Drop snapshots older than the newest less the retention; how many. What they leave live goes to one base manifest
        first, with the rows' own snapshots, so the present state is untouched; a crash before the old manifests are
        deleted leaves files that history() passes over."""
        history = self.history()
        limit = history[-1]["timestamp_ms"] - retention_ms
        old = list(takewhile(lambda m: m["timestamp_ms"] < limit, history[:-1]))
        count = sum(m["kind"] != "base" for m in old)
        if not count:
            return 0
        cut, gone = old[-1], {p for m in old for p in m["removed"]}
        base = {"snapshot": cut["snapshot"], "revision": cut.get("revision", 0), "timestamp_ms": cut["timestamp_ms"], "kind": "base", "schema": self.schema(cut["snapshot"]).to_json(), "removed": []}
        base |= {kind: [f for m in old for f in m[kind] if f["path"] not in gone] for kind in ("data", "deletes")}
        base["batch"] = max((m["batch"] for m in old if m.get("batch") is not None), default=None)
        self.files.create(_manifest(base), json.dumps(base))
        for m in old:
            self.files.delete(_manifest(m))
        return count

    def orphans(self, now_ms: int, grace_ms: int = 30 * 60_000) -> tuple[list[tuple[str, int]], int]:
        """Files that no manifest names and that are older than the grace time, with sizes; and how many newer ones
        are protected. Refuses if no file in the folder is known: then paths don't compare."""
        known = {f["path"] for m in self.history() for kind in ("data", "deletes") for f in m[kind]}
        found = self.files.list("data", ".parquet") + self.files.list("deletes", ".parquet")
        if known and found and not known & {name for name, _, _ in found}:
            raise RuntimeError("no listed file is referenced; refusing to call them orphans")
        loose = [(n, size, at) for n, size, at in found if n not in known]
        return [(n, size) for n, size, at in loose if at <= now_ms - grace_ms], sum(at > now_ms - grace_ms for _, _, at in loose)

    def clean(self, now_ms: int, grace_ms: int = 30 * 60_000) -> tuple[int, int, int]:
        """(deleted, bytes freed, protected)"""
        old, protected = self.orphans(now_ms, grace_ms)
        for name, _ in old:
            self.files.delete(name)
        return len(old), sum(size for _, size in old), protected

    def maintain(self, now_ms: int, retention_ms: int = 168 * 3_600_000, grace_ms: int = 30 * 60_000) -> dict:
        expired = self.expire(retention_ms)
        deleted, freed, protected = self.clean(now_ms, grace_ms)
        return {"expired": expired, "deleted": deleted, "bytes_freed": freed, "protected": protected}


def _place(manifest: dict) -> tuple[int, int]:
    return manifest["snapshot"], manifest.get("revision", 0)


def _manifest(entry: dict) -> str:
    """Names sort by snapshot and revision."""
    number, revision = _place(entry)
    return f"_manifest/{number:012d}{f'.r{revision:06d}' if revision else ''}{'-base' if entry['kind'] == 'base' else ''}.json"


def _relative() -> Column:
    """A file's path below its table, as the manifest has it; files of one write share names across partitions."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(path, "((?:data|deletes)/[0-9a-f]{32}/.+)$", 1)


def hidden_partition(expr: str, frame: DataFrame) -> Column:
    t = partition.parse(expr)
    return partition.apply(t, F.col(t.column), frame.schema[t.column].dataType)
