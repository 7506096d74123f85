"""`python -m driftwell VERB ...`: the engine's verbs over tables in shared folders."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from driftwell.functions.schema import TableSchema
from driftwell.operators import control, verify
from driftwell.operators.table import Table
from driftwell.sources.tables import snapshot_log
from driftwell.streaming.replicate import Cycle, apply_batch, now_in_ms, replicate


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="driftwell")
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name: str, text: str, *names: str) -> argparse.ArgumentParser:
        out = verbs.add_parser(name, help=text)
        for n in names:
            out.add_argument(f"--{n}", required=True)
        return out

    verb("snapshot", "create a table from a source as it is now", "source", "table").add_argument("--key", required=True, nargs="+")
    verbs.choices["snapshot"].add_argument("--partition", nargs="*", default=[])
    verbs.choices["snapshot"].add_argument("--lsn", type=int, default=0)
    run = verb("run", "follow a folder of staged files", "staged", "table", "checkpoint")
    run.add_argument("--continuous", action="store_true", help="every ten seconds rather than once")
    run.add_argument("--control", help="folder of the control tables: run whole cycles")
    run.add_argument("--name", default="table")
    verb("compact", "rewrite small files and apply deletes", "table").add_argument("--force", action="store_true")
    maintain = verb("maintain", "expire snapshots and delete files that none names", "table")
    maintain.add_argument("--retention-hours", type=float, default=168)
    maintain.add_argument("--grace-minutes", type=float, default=30)
    verb("verify", "compare a source with a table; fails where they differ", "source", "table").add_argument("--show", type=int, default=20)
    for name, text in (("setup", "create the control tables"), ("migrate", "bring them to the present layout"), ("cleanup", "drop them")):
        verb(name, text, "control")
    return parser


def _source(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Exit code: 0, or 1 where verify found a difference."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"driftwell {args.verb}").getOrCreate()
    if args.verb in ("setup", "migrate", "cleanup"):
        tables = control.Tables(spark, args.control)
        done = {"setup": tables.create, "migrate": tables.migrate, "cleanup": tables.drop}[args.verb]()
        print(json.dumps({"verb": args.verb, "changed": done or []}))
        return 0
    if args.verb == "snapshot":
        source = _source(spark, args.source)
        table = Table.create(spark, args.table, TableSchema.of(source.schema, args.key, tuple(args.partition)))
        apply_batch(table, snapshot_log(source, args.key, args.lsn), -1, now_in_ms(), compact=False)
        print(json.dumps({"snapshot": table.snapshot}))
        return 0
    table = Table(spark, args.table)
    if args.verb == "run":
        each = Cycle(args.name, table, control.Tables(spark, args.control)).run if args.control else None
        trigger = {"processingTime": "10 seconds"} if args.continuous else {"availableNow": True}
        replicate(spark, args.staged, table, args.checkpoint, trigger=trigger, each=each).awaitTermination()
        print(json.dumps({"snapshot": table.snapshot}))
    elif args.verb == "compact":
        done = table.compact(now_in_ms(), force=args.force)
        print(json.dumps(vars(done) if done else {}))
    elif args.verb == "maintain":
        print(json.dumps(table.maintain(now_in_ms(), int(args.retention_hours * 3_600_000), int(args.grace_minutes * 60_000))))
    else:
        found = verify.diff(_source(spark, args.source), table.read(), table.schema().key)
        differences = found.count()
        for row in found.limit(args.show).collect():
            print(json.dumps(row.asDict(), default=str))
        print(json.dumps({"differences": differences}))
        return int(differences > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
