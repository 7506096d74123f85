"""The verbs, from a snapshot to the drop of the control tables."""

import json

from pyspark.sql import functions as F

from driftwell.__main__ import main
from driftwell.operators import control
from driftwell.plans.derived import workspace
from driftwell.sources import changelog


def said(capsys):
    return json.loads(capsys.readouterr().out.strip().split("\n")[-1])


def test_verbs(spark, tmp_path, capsys):
    source, staged, checkpoint = (str(tmp_path / n) for n in ("source", "staged", "checkpoint"))
    table, controls = workspace(spark, "t"), workspace(spark, "control")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, a string")
    rows.write.parquet(source)
    run = lambda *a: main(list(a), spark)

    assert run("snapshot", "--source", source, "--table", table, "--key", "k") == 0
    assert said(capsys) == {"snapshot": 1}
    assert run("verify", "--source", source, "--table", table) == 0
    assert said(capsys) == {"differences": 0}

    changelog.write_staged(spark.createDataFrame([("U", 5, [], 2, "c"), ("I", 6, [], 3, "d")], "_op string, _seq long, _unchanged array<string>, k int, a string"), staged)
    assert run("setup", "--control", controls) == 0
    control.Tables(spark, controls).snapshot_done("t", 1)
    assert run("run", "--staged", staged, "--table", table, "--checkpoint", checkpoint, "--control", controls, "--name", "t") == 0
    capsys.readouterr()
    assert run("verify", "--source", source, "--table", table) == 1
    assert said(capsys) == {"differences": 2}
    assert spark.read.parquet(f"{controls}/commits").select("snapshot_id", F.col("rows")).collect() == [(2, 2)]

    assert run("compact", "--table", table, "--force") == 0
    assert said(capsys)["rows_rewritten"] == 4
    assert run("maintain", "--table", table, "--retention-hours", "0", "--grace-minutes", "0") == 0
    assert said(capsys)["expired"] >= 1
    assert run("migrate", "--control", controls) == 0 and run("cleanup", "--control", controls) == 0
