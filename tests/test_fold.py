import pytest

from driftwell.operators import fold as F

LOG = "_op string, _seq long, _unchanged array<string>, k int, a string, b string"


def log(spark, *rows):
    return spark.createDataFrame([(op, i, un, k, a, b) for i, (op, k, a, b, un) in enumerate(rows)], LOG)


def live(spark, *rows):
    return spark.createDataFrame(list(rows), "k int, a string, b string")


def done(df):
    return sorted(tuple(r) for r in df.select("_op", "k", "a", "b").collect())


def test_last_operation_wins(spark):
    x = log(spark, ("I", 1, "a", "b", []), ("U", 1, "c", "d", []), ("I", 2, "x", "y", []), ("D", 2, None, None, []), ("D", 3, None, None, []), ("I", 3, "p", "q", []))
    assert done(F.materialise(x, live(spark), ["k"])) == [("D", 2, None, None), ("I", 3, "p", "q"), ("U", 1, "c", "d")]


def test_unchanged_values_carry_within_a_batch(spark):
    x = log(spark, ("I", 1, "a", "long", []), ("U", 1, "b", None, ["b"]), ("U", 1, "c", None, ["b"]))
    assert done(F.materialise(x, live(spark), ["k"])) == [("U", 1, "c", "long")]


def test_null_is_a_value(spark):
    x = log(spark, ("I", 1, "a", "long", []), ("U", 1, "b", None, []), ("U", 1, "c", None, ["b"]))
    assert done(F.materialise(x, live(spark), ["k"])) == [("U", 1, "c", None)]


def test_two_placeholders_in_a_later_batch_take_the_live_value(spark):
    """D1"""
    x = log(spark, ("U", 1, "b", None, ["b"]), ("U", 1, "c", None, ["b"]))
    assert done(F.materialise(x, live(spark, (1, "a", "long")), ["k"])) == [("U", 1, "c", "long")]


def test_values_do_not_survive_a_delete(spark):
    x = log(spark, ("I", 1, "a", "old", []), ("D", 1, None, None, []), ("I", 1, "n", None, []))
    assert done(F.materialise(x, live(spark), ["k"])) == [("I", 1, "n", None)]


def test_insert_of_a_live_key_is_an_update(spark):
    assert done(F.materialise(log(spark, ("I", 1, "n", "m", [])), live(spark, (1, "a", "b")), ["k"])) == [("U", 1, "n", "m")]


def test_missing_row_raises(spark):
    """D16"""
    with pytest.raises(Exception, match="not live"):
        F.materialise(log(spark, ("U", 1, "b", None, ["b"])), live(spark), ["k"]).collect()


def test_truncate_also_ends_rows_of_its_own_batch(spark):
    """D5"""
    x = log(spark, ("I", 2, "a", "b", []), ("T", None, None, None, []), ("I", 3, "c", "d", []))
    assert done(F.materialise(x, live(spark, (1, "x", "y")), ["k"])) == [("D", 1, None, None), ("D", 2, None, None), ("I", 3, "c", "d")]


def test_empty_log(spark):
    assert done(F.materialise(log(spark), live(spark, (1, "a", "b")), ["k"])) == []


def test_key_change_takes_left_out_values_from_the_old_key(spark):
    """D6"""
    from driftwell.sources.changelog import split_key_changes

    row = "struct<k: int, a: string, b: string>"
    changes = spark.createDataFrame([("U", 5, ["b"], (1, "a", None), (9, "n", None))], f"_op string, _seq long, _unchanged array<string>, before {row}, after {row}")
    x = split_key_changes(changes, ["k"], ["k", "a", "b"])
    assert done(F.materialise(x, live(spark, (1, "a", "kept")), ["k"])) == [("D", 1, None, None), ("U", 9, "n", "kept")]
