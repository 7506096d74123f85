import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions.schema import TableSchema
from driftwell.operators import control
from driftwell.operators.fold import materialise
from driftwell.operators.table import SNAPSHOT, Table
from driftwell.plans.derived import workspace
from driftwell.sources import changelog, tables
from driftwell.streaming.replicate import Cycle, apply_batch, poll_cycle, replicate, upsert_poll

SCHEMA = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType())])
LOG = "_op string, _seq long, _unchanged array<string>, k int, a string, n int"


def new(spark, *partitions):
    return Table.create(spark, workspace(spark, "t"), TableSchema.of(SCHEMA, ["k"], partitions))


def random_log(rng, size):
    """Rows of a log that a source could really send, and the state it comes to."""
    state, rows = {}, []
    for seq in range(size):
        k = rng.randint(1, 6)
        if rng.random() < 0.05:
            state.clear()
            rows.append(("T", seq, [], None, None, None))
        elif k not in state:
            state[k] = (rng.choice("abc"), rng.choice([None, rng.randint(0, 9)]))
            rows.append(("I", seq, [], k, *state[k]))
        elif rng.random() < 0.3:
            del state[k]
            rows.append(("D", seq, [], k, None, None))
        elif rng.random() < 0.5:
            state[k] = (rng.choice("xyz"), state[k][1])
            rows.append(("U", seq, ["n"], k, state[k][0], None))
        else:
            state[k] = (rng.choice("xyz"), rng.randint(0, 9))
            rows.append(("U", seq, [], k, *state[k]))
    return rows, state


def state_of(table, **kw):
    return {r["k"]: (r["a"], r["n"]) for r in table.read(**kw).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_logs_in_random_batches(spark, seed):
    rng = random.Random(seed)
    rows, want = random_log(rng, 40)
    cuts = sorted(rng.sample(range(1, 40), 2))
    table = new(spark, "truncate[2](n)") if seed == 2 else new(spark)
    for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, 40], strict=True)):
        batch = spark.createDataFrame(rows[lo:hi], LOG)
        for _ in range(1 + (seed == 1)):  # a replay changes nothing
            apply_batch(table, batch, i, now_ms=i * 1000, compact=False)
    assert state_of(table) == want
    before = {s: state_of(table, snapshot=s) for s in range(1, table.snapshot + 1)}
    table.compact(force=True)
    assert state_of(table) == want
    for s, old in before.items():
        assert state_of(table, snapshot=s) == old
    table.expire(0)
    assert state_of(table) == want  # D2
    assert table.orphans(now_ms=1 << 50)[0] == [] or state_of(table) == want


def test_update_that_moves_partition(spark):
    """D4: deletes count for the whole table."""
    table = new(spark, "a")
    table.commit(spark.createDataFrame([("I", 1, "x", 1)], "_op string, k int, a string, n int"))
    table.commit(spark.createDataFrame([("U", 1, "y", 2)], "_op string, k int, a string, n int"))
    assert state_of(table) == {1: ("y", 2)}


def test_commit_refuses_nulls_and_existing_manifests(spark):
    table = new(spark)
    with pytest.raises(Exception, match="NULL in k"):
        table.commit(spark.createDataFrame([("I", None, "x", 1)], "_op string, k int, a string, n int"))
    with pytest.raises(FileExistsError):
        table._commit(0, 0, {"kind": "again"})
    assert table.commit(spark.createDataFrame([], "_op string, k int, a string, n int")) == 0  # no rows, no snapshot


def test_orphans_refuse_paths_that_do_not_compare(spark):
    """D23"""
    table = new(spark)
    table.commit(spark.createDataFrame([("I", 1, "x", 1)], "_op string, k int, a string, n int"))
    entry = table.history()[-1]
    table.files.delete("_manifest/000000000001.json")
    table._commit(1, 0, {"kind": "append", "data": [f | {"path": f"s3://b/{f['path']}"} for f in entry["data"]]})
    table = Table(spark, table.path)  # manifests never change, so a table reads each once
    with pytest.raises(RuntimeError):
        table.orphans(1 << 50)


def test_stream(spark, tmp_path):
    table = new(spark)
    staged, checkpoint = str(tmp_path / "staged"), str(tmp_path / "checkpoint")
    rows = [("I", 1, [], 1, "a", 5), ("I", 2, [], 2, "b", 6)]
    changelog.write_staged(spark.createDataFrame(rows, LOG).coalesce(1), staged)
    replicate(spark, staged, table, checkpoint).awaitTermination(120)
    changelog.write_staged(spark.createDataFrame([("U", 3, ["n"], 1, "c", None), ("D", 4, [], 2, None, None)], LOG).coalesce(1), staged)
    replicate(spark, staged, table, checkpoint).awaitTermination(120)
    assert state_of(table) == {1: ("c", 5)}


def test_watermark_ties_are_not_missed(spark):
    """D3"""
    table = new(spark)
    source = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA)
    upsert_poll(source, table, "n")
    source = source.union(spark.createDataFrame([(3, "late", 2)], SCHEMA))
    upsert_poll(source, table, "n", after=2)
    assert state_of(table) == {1: ("a", 1), 2: ("b", 2), 3: ("late", 2)}
    with pytest.raises(ValueError):
        tables.poll(source, ["k"], "a")


def test_pages_follow_typed_order(spark):
    """D7"""
    df = spark.createDataFrame([(i, "x", 0) for i in (9216, 10240, 9)], SCHEMA)
    assert [r.k for r in tables.key_page(df, ["k"], 2, [9]).collect()] == [9216, 10240]


def test_unknown_operation_raises(spark):
    staged = changelog.stage(spark.createDataFrame([("Z", 1, [], 1, "a", 1)], LOG))
    with pytest.raises(Exception, match="unknown operation"):
        changelog.unstage(staged, SCHEMA).collect()


def test_one_batch_or_many_agree(spark):
    rows, want = random_log(random.Random(99), 30)
    empty = spark.createDataFrame([], SCHEMA)
    out = materialise(spark.createDataFrame(rows, LOG), empty, ["k"]).where(F.col("_op") != "D")
    assert {r["k"]: (r["a"], r["n"]) for r in out.collect()} == want


def moved(spark, *rows):
    """(seq, unchanged, before, after) as staged changes; before is the old row of a moved key."""
    row = "struct<k: int, a: string, n: int>"
    changes = spark.createDataFrame([("U" if after else "D", seq, un, before, after) for seq, un, before, after in rows], f"_op string, _seq long, _unchanged array<string>, before {row}, after {row}")
    return changelog.split_key_changes(changes, ["k"], ["k", "a", "n"])


@pytest.mark.parametrize("as_stream", [False, True])
def test_moved_keys_through_the_envelope(spark, tmp_path, as_stream):
    """D6: one step from the live row, one from a value of the same batch, and chains of both."""
    table = new(spark)
    table.commit(spark.createDataFrame([("I", k, "old", k) for k in (1, 2, 3, 4)], "_op string, k int, a string, n int"), batch=-1)
    log = moved(
        spark,
        (1, ["a"], (1, None, 1), (11, None, 10)),
        (2, [], None, (2, "fresh", 20)),
        (3, ["a", "n"], (2, None, None), (12, None, None)),
        (4, ["a"], (3, None, 3), (13, None, 30)),
        (5, ["a", "n"], (13, None, None), (23, None, None)),
        (6, [], None, (4, "new", 40)),
        (7, ["a"], (4, None, 40), (14, None, 41)),
        (8, ["a", "n"], (14, None, None), (24, None, None)),
        (9, ["n"], None, (24, "last", None)),
    )
    staged = str(tmp_path / "staged")
    changelog.write_staged(log.coalesce(1), staged)
    if as_stream:
        replicate(spark, staged, table, str(tmp_path / "checkpoint")).awaitTermination(120)
    else:
        apply_batch(table, changelog.read_staged(spark, staged, SCHEMA, ["k"]), 0)
    assert state_of(table) == {11: ("old", 10), 12: ("fresh", 20), 23: ("old", 30), 24: ("last", 41)}


def test_replay_after_expiry(spark):
    table = new(spark)
    batch = lambda op, a: spark.createDataFrame([(op, 0, [], 1, a, 1)], LOG)
    apply_batch(table, batch("I", "first"), 0, now_ms=1_000, compact=False)
    apply_batch(table, batch("U", "second"), 1, now_ms=2_000, compact=False)
    table.compact(3_000, force=True)
    assert table.expire(0) > 0
    apply_batch(table, batch("I", "first"), 0, now_ms=4_000, compact=False)
    assert state_of(table) == {1: ("second", 1)}


def scans(df, path):
    """How many scans of data files below a path the optimised plan has."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count(f",{SNAPSHOT}#") and sum("Relation [" in line and SNAPSHOT in line for line in plan.split("\n"))


def test_live_rows_are_read_once(spark):
    table = new(spark)
    table.commit(spark.createDataFrame([("I", k, "x", k) for k in range(9)], "_op string, k int, a string, n int"))
    log = spark.createDataFrame([("U", 1, ["n"], 1, "y", None), ("I", 2, [], 2, "z", 2)], LOG)
    plan = materialise(log, table.read(), ["k"])
    assert scans(plan, table.path) == 1
    cut = log.unionByName(spark.createDataFrame([("T", 3, [], None, None, None)], LOG))
    assert scans(materialise(cut, table.read(), ["k"]), table.path) == 2


def test_two_writers(spark):
    """The one whose commit came second folds again onto what the first left."""
    table = new(spark)
    other = Table(spark, table.path)
    commit = Table.commit

    def overtaken(self, *a, **kw):
        Table.commit = commit
        other.commit(spark.createDataFrame([("I", 1, "theirs", 1)], "_op string, k int, a string, n int"))
        raise FileExistsError("000000000001")

    Table.commit = overtaken
    try:
        apply_batch(table, spark.createDataFrame([("U", 1, ["n"], 1, "mine", None)], LOG), 0)
    finally:
        Table.commit = commit
    assert state_of(table) == {1: ("mine", 1)}


def test_stream_commits_carry_time(spark, tmp_path):
    table = new(spark)
    changelog.write_staged(spark.createDataFrame([("I", 1, [], 1, "a", 5)], LOG), str(tmp_path / "staged"))
    replicate(spark, str(tmp_path / "staged"), table, str(tmp_path / "checkpoint"), clock=lambda: 77).awaitTermination(120)
    assert table.history()[-1]["timestamp_ms"] == 77


def test_control_tables(spark):
    controls = control.Tables(spark, workspace(spark, "control"))
    controls.create()
    assert not controls.is_open("t")
    controls.register("t", 7)
    assert not controls.is_open("t")
    controls.snapshot_done("t", 5)
    assert controls.is_open("t") and controls.read("tables").first()["pg_oid"] == 7
    claims = spark.createDataFrame([("t", 1, 3, "f1", 10), ("t", 2, 4, "f2", 20)], "table_name string, claim_no long, record_count long, s3_path string, flushable_lsn long")
    controls.stage(claims)
    controls.stage(claims.where("claim_no = 1").withColumn("s3_path", F.lit("f3")))
    assert [(r.s3_path, r.end_offset) for r in control.unread(controls.read("log_index"), "t", 3, 5).collect()] == [("f2", 7), ("f3", 10)]
    controls.advance("t", 7)
    controls.advance("t", 3)
    assert controls.cursor("t") == 7
    assert sorted(r.s3_path for r in control.spent(controls.read("log_index"), controls.read("cursors")).collect()) == ["f1", "f2"]
    assert controls.migrate() == []
    controls.drop()
    assert not controls.table("cursors").files.list("_manifest")


def test_earlier_control_layout_is_migrated(spark):
    controls = control.Tables(spark, workspace(spark, "control"))
    old = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("snapshot_complete", T.BooleanType())])
    Table.create(spark, controls.path("tables"), TableSchema.of(old, ["table_name"])).commit(spark.createDataFrame([("I", "t", True)], "_op string, table_name string, snapshot_complete boolean"))
    assert controls.migrate() == ["tables"]
    assert controls.is_open("t") and controls.read("tables").first()["pg_oid"] is None


def test_polls_keep_their_watermark(spark):
    table, controls = new(spark), control.Tables(spark, workspace(spark, "control"))
    controls.create()
    source = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], SCHEMA)
    assert poll_cycle("t", source, table, "n", controls) == 2
    source = source.union(spark.createDataFrame([(3, "late", 2), (4, "d", 3)], SCHEMA))
    assert poll_cycle("t", source, table, "n", controls) == 3
    assert state_of(table) == {1: ("a", 1), 2: ("b", 2), 3: ("late", 2), 4: ("d", 3)} and controls.watermark("t") == "3"


def test_checks_on_the_stream(spark):
    row = "struct<k: int>"
    bad = spark.createDataFrame([("I", 5, None, None)], f"_op string, _seq long, before {row}, after {row}")
    with pytest.raises(Exception, match="no row in change 5"):
        changelog.checked(bad).collect()
    messages = spark.createDataFrame([("K", 9), ("I", 4)], "_op string, _lsn long")
    assert [r._op for r in changelog.without_keepalives(messages).collect()] == ["I"]
    assert changelog.flushable_lsn(messages).first()[0] == 9
    tables_of = spark.createDataFrame([("a",), ("b",)], "_table string")
    assert sorted(r._table for r in changelog.renamed(tables_of, {"a": "x"}).collect()) == ["b", "x"]


def test_maintenance_is_recorded(spark):
    controls = control.Tables(spark, workspace(spark, "control"))
    cycle = Cycle("t", new(spark), controls)
    cycle.table.commit(spark.createDataFrame([("I", 1, "x", 1)], "_op string, k int, a string, n int"), now_ms=1_000)
    cycle.table.commit(spark.createDataFrame([("U", 1, "y", 1)], "_op string, k int, a string, n int"), now_ms=9_000)
    assert cycle.maintain(9_000, 0, 0)["expired"] == 2
    rows = {r.operation: r.items_affected for r in spark.read.parquet(controls.path("maintenance")).collect()}
    assert rows == {"expire_snapshots": 2, "clean_orphans": None}


def test_deletes_lie_with_the_rows_they_hide(spark):
    table = new(spark, "a")
    apply_batch(table, spark.createDataFrame([("I", k, [], k, a, 1) for k, a in ((1, "x/1"), (2, "y"), (3, ""), (4, None))], LOG), 0, compact=False)
    apply_batch(table, spark.createDataFrame([("U", 5, ["n"], 1, "y", None), ("D", 6, [], 2, None, None), ("D", 7, [], 9, None, None), ("U", 8, [], 3, "", 7)], LOG), 1, compact=False)
    where = {f["path"].split("/")[2] for f in table.live_files("deletes")}
    assert {p for p in where if p.startswith("_p_")} == {"_p_a=x%2F1", "_p_a=y", "_p_a=__HIVE_DEFAULT_PARTITION__"} and len(where) == 4
    kinds = {c.name: c.type for c in table.schema().columns}
    assert not any("_p_a=y" in f["path"] for f in table._pruned(table.live_files("deletes"), {"a": ("w", "x/2")}, kinds))
    assert state_of(table) == {1: ("y", 1), 3: ("", 7), 4: (None, 1)}
    assert state_of(table, where={"a": ("w", "x/2")}) == {} and state_of(table, where={"a": ("y", "y")}) == {1: ("y", 1)}
    assert state_of(table, where={"a": ("", "b")}) == {3: ("", 7)}
    table.compact(force=True)
    assert state_of(table) == {1: ("y", 1), 3: ("", 7), 4: (None, 1)}


def test_compaction_keeps_the_snapshot(spark):
    """A compaction between two commits takes no number, and finds nothing left of its own to do."""
    table = new(spark)
    apply_batch(table, spark.createDataFrame([("I", k, [], k, "x", k) for k in range(8)], LOG), 0, compact=False)
    assert table.compact(data_files=1, delete_files=1) is not None
    assert table.snapshot == 1 and len(table.live_files("data")) == 1
    apply_batch(table, spark.createDataFrame([("D", 9, [], 1, None, None)], LOG), 1, compact=False)
    assert table.snapshot == 2
    assert sorted(state_of(table)) == [0, 2, 3, 4, 5, 6, 7] and sorted(state_of(table, snapshot=1)) == list(range(8))
    table.compact(force=True)
    table.compact(force=True)
    assert table.snapshot == 2 and sorted(state_of(table)) == [0, 2, 3, 4, 5, 6, 7]
    table.expire(-1)
    assert sorted(state_of(table)) == [0, 2, 3, 4, 5, 6, 7]
