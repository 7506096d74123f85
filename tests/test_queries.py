"""Every registered query of the table engine against its SQL, at the smallest scale."""

import pytest

from driftwell.plans import catalog
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], sf_dir)


@pytest.mark.parametrize("name", ["commit_metadata", "marker_emission"])
def test_commits_of_many_files(spark, sf_dir, name):
    """So many files that each commit is compacted."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "9"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert_same(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], sf_dir)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_keys_that_move_to_each_other(spark, tmp_path):
    keys = [3, 4, 8, 1_000_004, 1_000_008, 2_000_004, 2_000_005]
    spark.createDataFrame([(k, k % 7, f"{k}-P") for k in keys], "o_orderkey long, o_custkey long, o_orderpriority string").toPandas().to_parquet(tmp_path / "orders.parquet")
    assert_same(catalog.queries()["key_change_staged"](spark, str(tmp_path)), catalog.oracle_sql()["key_change_staged"], str(tmp_path))


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
