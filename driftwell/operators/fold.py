"""Folding a change log to the last state of each key, and fitting that onto a table's live rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftwell.sources.changelog import payload


def fold(log: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: the last operation, and of each column the last value that an event really carried.

    A column named in `_unchanged` has no value in that event. Values never come from before the key's last delete,
    which starts the row anew. Columns without any value in the log are listed in `_missing`; that is not the same as
    a NULL value. Truncates must have been expanded.
    """
    columns = [c for c in payload(log) if c not in key and not c.startswith("_old_")]
    old = [c for c in log.columns if c.startswith("_old_")]
    unchanged = F.col("_unchanged") if "_unchanged" in log.columns else F.array().cast("array<string>")
    # The window and the aggregates need the same hash partitioning, so the log is shuffled once.
    last_delete = F.max(F.when(F.col("_op") == "D", F.col("_seq"))).over(Window.partitionBy(*key))
    rows = log.select(*key, *columns, *old, "_op", "_seq", unchanged.alias("_unchanged"), last_delete.alias("_cut")).where("_cut IS NULL OR _seq >= _cut")
    real = lambda c: F.when(~F.array_contains("_unchanged", c) & (F.col("_op") != "D"), F.col("_seq"))
    found = rows.groupBy(*key).agg(
        F.max_by("_op", "_seq").alias("_op"),
        F.max("_seq").alias("_seq"),
        *(F.max_by(F.struct(F.col(c).alias("v")), real(c)).alias(c) for c in columns),
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in old),
    )
    missing = F.when(F.col("_op") == "D", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))) if columns else F.array().cast("array<string>")
    dead = F.col("_op") == "D"
    return found.select("_op", "_seq", *key, *(F.when(~dead, F.col(c)["v"]).alias(c) for c in columns), missing.alias("_missing"), *old)


def expand_truncates(log: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Each truncate becomes deletes at its place: of every live key, and of every key earlier in this log.

    Only the last truncate matters to a key, and it alone is expanded, so a log of many truncates stays small.
    """
    last = F.broadcast(log.where("_op = 'T'").agg(F.max("_seq").alias("_at")))  # one row
    rest = log.where("_op <> 'T'")
    early = rest.crossJoin(last).where("_seq < _at").select(*key, "_at")
    keys = live.select(*key).crossJoin(last).where("_at IS NOT NULL").unionByName(early).distinct()
    deletes = keys.select(F.lit("D").alias("_op"), F.col("_at").alias("_seq"), *key)
    return rest.unionByName(deletes, allowMissingColumns=True)


def repair(folded: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """Fill columns that no event carried from the live row of the key, or of the key it had before; an update of a
    key that is not live then raises."""
    columns = [c for c in live.columns if c not in key]
    now = live.select(*(F.col(k).alias(f"_live_{k}") for k in key), F.struct(*columns).alias("_live"))
    has_old = [c for c in folded.columns if c.startswith("_old_")]
    lookup = lambda k: F.coalesce(f"_old_{k}", k) if f"_old_{k}" in has_old else F.col(k)
    needs = F.size("_missing") > 0
    on = needs
    for k in key:
        on = on & (F.col(f"_live_{k}") == lookup(k))
    joined = folded.join(now, on, "left")
    unknown = needs & F.col("_live").isNull()
    filled = [F.when(F.array_contains("_missing", c), F.when(unknown, F.raise_error(F.lit(f"no value for {c}: its row is not live")).cast(live.schema[c].dataType)).otherwise(F.col(f"_live.{c}"))).otherwise(F.col(c)).alias(c) if c in folded.columns else F.lit(None).cast(live.schema[c].dataType).alias(c) for c in columns]
    return joined.select("_op", "_seq", *key, *filled)


def promote(folded: DataFrame, live: DataFrame, key: list[str]) -> DataFrame:
    """An insert of a key that is live is an update."""
    known = live.select(*key).withColumn("_known", F.lit(True))
    return folded.join(known, key, "left").withColumn("_op", F.when((F.col("_op") == "I") & F.col("_known"), "U").otherwise(F.col("_op"))).select(folded.columns)


def follow_moves(log: DataFrame, key: list[str]) -> DataFrame:
    """Values that a moved key's update left out, from the events of its old key in this same log.

    A move is a row with `_old_<key>`; the delete of the old key comes directly before it. What the old key's earlier
    events do not say either is left to the live row, of the key that the row had before this log. Each pass of either
    loop resolves one more step of a chain of moves.
    """
    old = [f"_old_{k}" for k in key]
    source = {o: f"_from_{k}" for o, k in zip(old, key, strict=True)}
    columns = [c for c in payload(log) if c not in key and c not in old]
    if "_unchanged" not in log.columns:
        log = log.withColumn("_unchanged", F.array().cast("array<string>"))
    moves = log.where(F.col(old[0]).isNotNull()).select(F.col("_seq").alias("_move"), *(F.col(o).alias(f) for o, f in source.items()))
    before = F.col("_seq") < F.col("_move") - 1
    for k in key:
        before = before & (F.col(k) == F.col(f"_from_{k}"))
    while True:
        carried = fold(log.join(moves, before).drop(*key, *source.values()), ["_move"]).where("_op <> 'D'")
        joined = log.join(carried.select("_move", F.struct("_missing", *columns).alias("_then")), F.col("_seq") == F.col("_move"), "left")
        here = F.col("_then").isNotNull() & F.col(old[0]).isNotNull()
        joined = joined.withColumn("_said", F.when(here, F.array_except("_unchanged", F.col("_then._missing"))).otherwise(F.array().cast("array<string>")))
        values = [F.when(F.array_contains("_said", c), F.col(f"_then.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
        rest = [c for c in log.columns if c not in columns and c != "_unchanged"]
        if joined.where(F.size("_said") > 0).isEmpty():
            break
        log = joined.select(*rest, *values, F.array_except("_unchanged", "_said").alias("_unchanged"))

    earlier = log.where(F.col(old[0]).isNotNull()).select("_seq", *key)
    links = moves.join(earlier, before, "left").groupBy("_move", *source.values()).agg(F.max("_seq").alias("_parent"))
    while not links.where("_parent IS NOT NULL").isEmpty():
        up = links.select(F.col("_move").alias("_parent"), F.struct(*source.values(), F.col("_parent").alias("_next")).alias("_up"))
        links = links.join(up, "_parent", "left").select("_move", *(F.coalesce(f"_up.{f}", f).alias(f) for f in source.values()), F.col("_up._next").alias("_parent"))
    out = log.join(links.drop("_parent"), F.col("_seq") == F.col("_move"), "left")
    return out.select(*(F.when(F.col(c).isNotNull(), F.coalesce(F.col(source[c]), F.col(c))).alias(c) if c in source else F.col(c) for c in log.columns))


def materialise(log: DataFrame, live: DataFrame, key: list[str], located: list[str] = ()) -> DataFrame:
    """A batch of the log as final operations on the table: one row for each key, complete. With columns to locate rows
    by, `_was` has their values in the live row that an operation hides, or NULL where that is not known.

    The live rows are read once, and only those of the batch's keys: the semi join comes before all else that is done
    with them. A truncate, and only that, needs the keys of all live rows. Whether the log has truncates or moved keys
    is asked first, in one pass over those columns.
    """
    columns = [c for c in live.columns if c not in key]
    old = [f"_old_{k}" for k in key if f"_old_{k}" in log.columns]
    moved = F.col(old[0]).isNotNull() if old else F.lit(False)
    asked = log.agg(F.coalesce(F.bool_or(F.col("_op") == "T"), F.lit(False)).alias("truncates"), F.coalesce(F.bool_or(moved), F.lit(False)).alias("moves")).first()
    if asked["moves"]:
        log = follow_moves(log, key)
    elif old:
        log, old = log.drop(*old), []
    folded = fold(expand_truncates(log, live, key) if asked["truncates"] else log, key)
    lookup = [F.when(F.col("_op") == "U", F.coalesce(f"_old_{k}", k)).otherwise(F.col(k)) if old else F.col(k) for k in key]
    wanted = log.select(*key)
    if old:
        wanted = wanted.unionByName(log.where(F.col(old[0]).isNotNull()).select(*(F.col(o).alias(k) for o, k in zip(old, key, strict=True))))
    now = live.join(wanted.distinct(), key, "left_semi").select(*(F.col(k).alias(f"_live_{k}") for k in key), F.struct(F.lit(True).alias("_known"), *columns).alias("_live"))
    on = F.lit(True)
    for k, x in zip(key, lookup, strict=True):
        on = on & (F.col(f"_live_{k}") == x)
    joined = folded.join(now, on, "left")
    unknown = (F.size("_missing") > 0) & F.col("_live").isNull()

    def filled(c: str) -> Column:
        kind = live.schema[c].dataType
        if c not in folded.columns:
            return F.lit(None).cast(kind).alias(c)
        stop = F.raise_error(F.lit(f"no value for {c}: its row is not live")).cast(kind)
        return F.when(F.array_contains("_missing", c), F.when(unknown, stop).otherwise(F.col(f"_live.{c}"))).otherwise(F.col(c)).alias(c)

    op = F.when((F.col("_op") == "I") & F.col("_live").isNotNull(), "U").otherwise(F.col("_op")).alias("_op")
    here = F.col("_live").isNotNull()
    for o in old:  # the row found under a moved key's old name is not the one that the new name hides
        here = here & F.col(o).isNull()
    was = F.when(here, F.struct(*(F.col(f"_live_{c}" if c in key else f"_live.{c}").alias(c) for c in located))).alias("_was")
    return joined.select(op, *key, *map(filled, columns), *[was] * bool(located))


def cycle_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.max("_lsn").alias("max_lsn"), F.max("_ts").alias("max_source_ts"), F.count_distinct("_xid").alias("tx_count"), F.count("*").alias("rows"))
