"""Registered queries of the table engine, each with DuckDB SQL that states its meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions import partition
from driftwell.functions import types as kinds
from driftwell.functions.schema import TableSchema, apply, diff
from driftwell.operators import control, metadata, verify
from driftwell.operators import fold as folding
from driftwell.operators.table import Table, hidden_partition
from driftwell.plans.derived import KEY, LOG_SQL, STATE_SQL, load, orders_log, workspace
from driftwell.sources import changelog, tables
from driftwell.streaming.replicate import Cycle, apply_batch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _orders_schema(spark: SparkSession, d: str) -> TableSchema:
    return TableSchema.of(load(spark, d, "orders").schema, KEY)


def _empty(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").limit(0)


def _table(spark: SparkSession, d: str, batches: list[str], partitions: tuple[str, ...] = (), compact: bool = False) -> Table:
    """The orders log applied in batches, each a condition on `_seq`, to a new table on disk."""
    schema = TableSchema.of(load(spark, d, "orders").schema, KEY, partitions)
    table = Table.create(spark, workspace(spark, "orders"), schema)
    for i, condition in enumerate(batches):
        table.commit(folding.materialise(orders_log(spark, d).where(condition), table.read(), KEY), (i + 1) * 1000, i)
    if compact:
        table.compact(10_000, force=True)
    return table


_TWO = ["_seq % 10 = 0", "_seq % 10 <> 0"]
_FIVE = [f"_seq % 10 = {i}" for i in range(5)]


# Fold and materialise


@query(f"""WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS n FROM log)
SELECT o_orderkey, op AS last_op, seq AS last_seq FROM r WHERE n = 1""")
def fold_last_write(spark: SparkSession, d: str) -> DataFrame:
    return folding.fold(orders_log(spark, d), KEY).select("o_orderkey", F.col("_op").alias("last_op"), F.col("_seq").alias("last_seq"))


@query(f"""WITH {LOG_SQL}, cut AS (SELECT *, max(CASE WHEN op = 'D' THEN seq END) OVER (PARTITION BY o_orderkey) AS cut FROM log),
live AS (SELECT * FROM cut WHERE cut IS NULL OR seq > cut),
v AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS n FROM live WHERE unchanged IS NULL)
SELECT o_orderkey, o_orderpriority FROM v WHERE n = 1""")
def fold_unchanged_carry(spark: SparkSession, d: str) -> DataFrame:
    return folding.fold(orders_log(spark, d), KEY).where("_op <> 'D'").select("o_orderkey", "o_orderpriority")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'I' WHEN o_orderkey % 5 = 0 THEN 'D' ELSE 'U' END AS op,
CAST(CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_missing
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""")
def fold_missing_values(spark: SparkSession, d: str) -> DataFrame:
    log = orders_log(spark, d).where("_seq % 10 <> 0")
    return folding.fold(log, KEY).select("o_orderkey", F.col("_op").alias("op"), F.size("_missing").alias("n_missing"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'U' ELSE 'I' END AS op FROM orders")
def promote_reinserts(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    log = orders.withColumn("_op", F.lit("I")).withColumn("_seq", F.lit(0).cast("long"))
    return folding.promote(folding.fold(log, KEY), orders.where("o_orderkey % 4 = 0"), KEY).select("o_orderkey", F.col("_op").alias("op"))


@query("""SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0""")
def repair_unchanged(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    log = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(None).cast("long").alias("o_custkey"), "o_orderstatus", (F.col("o_totalprice") + 1).alias("o_totalprice"), "o_orderdate", F.lit(None).cast("string").alias("o_orderpriority"), F.lit("U").alias("_op"), F.lit(1).cast("long").alias("_seq"), F.array(F.lit("o_custkey"), F.lit("o_orderpriority")).alias("_unchanged"))
    return folding.repair(folding.fold(log, KEY), orders, KEY).select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'U' ELSE 'D' END AS op FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 7 = 0""")
def truncate_expand(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    blank = [c for c in orders.columns if c not in KEY]
    before = orders.where("o_orderkey % 3 = 0").select("*", F.lit("I").alias("_op"), F.lit(1).cast("long").alias("_seq"))
    truncate = spark.range(1).select(*(F.lit(None).cast(orders.schema[c].dataType).alias(c) for c in [*KEY, *blank]), F.lit("T").alias("_op"), F.lit(2).cast("long").alias("_seq"))
    after = orders.where("o_orderkey % 7 = 0").select("*", F.lit("U").alias("_op"), F.lit(3).cast("long").alias("_seq"))
    log = before.unionByName(truncate).unionByName(after)
    return folding.fold(folding.expand_truncates(log, orders.where("o_orderkey % 2 = 0"), KEY), KEY).select("o_orderkey", F.col("_op").alias("op"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN 'D' ELSE 'U' END AS op,
CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""")
def materialise_batch(spark: SparkSession, d: str) -> DataFrame:
    """The second of two batches against the state after the first."""
    out = folding.materialise(orders_log(spark, d).where(_TWO[1]), load(spark, d, "orders"), KEY)
    return out.select("o_orderkey", F.col("_op").alias("op"), "o_orderpriority")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in two commits to a table on disk, read back."""
    return _table(spark, sf_dir, _TWO).read()


@query(STATE_SQL)
def materialise_two_commits(spark: SparkSession, d: str) -> DataFrame:
    return flagship(spark, d)


@query(STATE_SQL)
def mor_state(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, _FIVE).read()


@query("SELECT * FROM orders")
def mor_as_of_first(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, _TWO).read(snapshot=1)


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def mor_as_of_third(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, _FIVE).read(snapshot=3)


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def replay_is_noop(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").withColumn("_op", F.lit("I"))
    table = Table.create(spark, workspace(spark, "replay"), _orders_schema(spark, d))
    for _ in range(2):
        table.commit(orders.where("o_orderkey % 2 = 1"), 0, 7)
    return table.read().select("o_orderkey", "o_orderpriority")


# Table services


@query(STATE_SQL)
def compact_state(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, _FIVE, compact=True).read()


@query("SELECT * FROM orders")
def compact_keeps_history(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, _TWO, compact=True).read(snapshot=1)


@query("""SELECT CAST(count(*) + sum(CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) + sum(CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey % 5 <> 0) THEN 1 ELSE 0 END) AS BIGINT) AS rows_rewritten,
CAST(sum(CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS rows_removed, 1 AS delete_batches FROM orders""")
def compaction_stats(spark: SparkSession, d: str) -> DataFrame:
    table = _table(spark, d, _TWO)
    batches = len({f["path"].split("/")[1] for f in table.live_files("deletes")})
    out = table.compact(force=True)
    return spark.createDataFrame([(out.rows_rewritten, out.rows_removed, batches)], "rows_rewritten long, rows_removed long, delete_batches int")


@query(STATE_SQL)
def expire_keeps_state(spark: SparkSession, d: str) -> DataFrame:
    table = _table(spark, d, _FIVE)
    table.expire(1500)
    return table.read()


@query(f"""SELECT CAST(4 AS BIGINT) AS expired, CAST(2 AS BIGINT) AS deleted, CAST(2 AS BIGINT) AS bytes_freed, CAST(1 AS BIGINT) AS protected,
count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS keys FROM ({STATE_SQL})""")
def maintain_counts(spark: SparkSession, d: str) -> DataFrame:
    """Five commits a second apart and one later; two old files that no manifest names, and a new one."""
    table = _table(spark, d, _FIVE)
    now = 60_000_000
    table.evolve(table.schema(), now)
    for name, age in (("old", 3_600_000), ("older", 7_200_000), ("new", 60_000)):
        table.files.create(f"data/lost/{name}.parquet", "x")
        table.files.fs.setTimes(table.files._path(f"data/lost/{name}.parquet"), now - age, -1)
    out = table.maintain(now, retention_ms=now - 4_000, grace_ms=30 * 60_000)
    counts = [F.lit(out[k]).cast("long").alias(k) for k in ("expired", "deleted", "bytes_freed", "protected")]
    return table.read().agg(F.count("*").alias("rows"), F.sum("o_custkey").alias("keys")).select(*counts, "rows", "keys")


@query("SELECT CAST(n AS INTEGER) AS delete_commits, n >= 4 AS compacts FROM (VALUES (3), (4)) AS t(n)")
def compaction_trigger(spark: SparkSession, d: str) -> DataFrame:
    """Not forced: three files of deletes are left alone, four are not."""
    customers = load(spark, d, "customer").select("c_custkey", "c_mktsegment").coalesce(1)
    found = []
    table = Table.create(spark, workspace(spark, "trigger"), TableSchema.of(customers.schema, ["c_custkey"]))
    table.commit(customers.withColumn("_op", F.lit("I")))
    for i in range(1, 5):
        table.commit(customers.where(F.col("c_custkey") == i).withColumn("_op", F.lit("D")))
        if i >= 3:
            found.append((i, table.compact() is not None))
    return spark.createDataFrame(found, "delete_commits int, compacts boolean")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'source_only' WHEN o_orderkey % 13 = 0 THEN 'table_only' ELSE 'mismatched' END AS status FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0")
def verify_diff(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    source = orders.where("o_orderkey % 13 <> 0 OR o_orderkey % 11 = 0")
    table = orders.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 17 == 0, "?").otherwise(F.col("o_orderstatus")))
    return verify.diff(source, table, KEY)


#: (case, what the other replica holds): changes of order, of a value, of where a NULL stands, and of how often a row comes.
_REPLICAS = [
    ("same", "SELECT o_custkey, a, b FROM x"),
    ("changed", "SELECT CASE WHEN a = '7' THEN -1 ELSE o_custkey END AS o_custkey, a, b FROM x"),
    ("null moved", "SELECT o_custkey, b AS a, a AS b FROM x"),
    ("pair replaced", "SELECT o_custkey, CASE WHEN o_custkey < 20 THEN 'z' ELSE a END AS a, b FROM x"),
]
_REPLICA_SQL = "x AS (SELECT o_custkey, CAST(o_custkey % 10 AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM orders UNION ALL SELECT o_custkey, CAST(o_custkey % 10 AS VARCHAR), NULL FROM orders WHERE o_custkey < 20)"


@query(f"WITH {_REPLICA_SQL} " + " UNION ALL ".join(f"SELECT '{case}' AS replica, NOT EXISTS ((SELECT * FROM x EXCEPT ALL ({other})) UNION ALL (({other}) EXCEPT ALL SELECT * FROM x)) AS equal" for case, other in _REPLICAS))
def replica_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Rows with NULLs, several rows of one key, and rows that come twice."""
    rows = load(spark, d, "orders").select("o_custkey", (F.col("o_custkey") % 10).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    rows = rows.unionByName(rows.where("o_custkey < 20"))
    out = None
    for case, other in _REPLICAS:
        replica = spark.sql(other.replace("FROM x", "FROM {x}"), x=rows)
        x, y = (verify.checksums(t, ["o_custkey"], 64).select("bucket", F.struct("rows", "checksum", "high", "low").alias(n)) for t, n in ((rows, "x"), (replica, "y")))
        same = x.join(y, "bucket", "full_outer").agg(F.every(F.col("x").eqNullSafe(F.col("y"))).alias("equal")).select(F.lit(case).alias("replica"), "equal")
        out = same if out is None else out.unionByName(same)
    return out


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-03-31'")
def pruned_read(spark: SparkSession, d: str) -> DataFrame:
    table = Table.create(spark, workspace(spark, "pruned"), TableSchema.of(load(spark, d, "orders").schema, KEY, ("month(o_orderdate)",)))
    table.commit(load(spark, d, "orders").withColumn("_op", F.lit("I")))
    return table.read(where={"o_orderdate": ("1995-03-01 00:00:00", "1995-03-31 00:00:00")}).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus BETWEEN 'F' AND 'G' AND o_orderkey % 2 = 1")
def pruned_deletes(spark: SparkSession, d: str) -> DataFrame:
    """Partitions by a text; half the rows move to another partition, and a read of the first passes over the others' files."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    table = Table.create(spark, workspace(spark, "pruned"), TableSchema.of(orders.schema, KEY, ("o_orderstatus",)))
    row = lambda part, op, status, seq: part.select(F.lit(op).alias("_op"), F.lit(seq).cast("long").alias("_seq"), "o_orderkey", status.alias("o_orderstatus"))
    apply_batch(table, row(orders, "I", F.col("o_orderstatus"), 0), 0, compact=False)
    apply_batch(table, row(orders.where("o_orderkey % 2 = 0"), "U", F.lit("a/b=c"), 1), 1, compact=False)
    return table.read(where={"o_orderstatus": ("F", "G")})


@query("SELECT CAST(year(o_orderdate) - 1970 AS VARCHAR) AS y, count(*) AS rows FROM orders GROUP BY ALL")
def partition_of_file_path(spark: SparkSession, d: str) -> DataFrame:
    """A regular expression on the paths of a table's files."""
    table = Table.create(spark, workspace(spark, "paths"), TableSchema.of(load(spark, d, "orders").schema, KEY, ("year(o_orderdate)",)))
    table.commit(load(spark, d, "orders").withColumn("_op", F.lit("I")))
    return table.data_files().groupBy(F.regexp_extract("path", "_p_o_orderdate_year=([^/]+)", 1).alias("y")).agg(F.sum("rows").alias("rows"))


# Partition transforms


@query("""SELECT o_orderkey, CAST(year(o_orderdate) - 1970 AS INTEGER) AS y, CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m,
CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS dd FROM orders""")
def part_year_month_day(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    return orders.select("o_orderkey", hidden_partition("year(o_orderdate)", orders).alias("y"), hidden_partition("month(o_orderdate)", orders).alias("m"), hidden_partition("day(o_orderdate)", orders).alias("dd"))


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 3600000000.0) AS INTEGER) AS h FROM events")
def part_hour(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    return events.select("event_id", hidden_partition("hour(ts)", events).alias("h"))


@query("SELECT event_id, event_type AS p, 'event_type=' || replace(event_type, ' ', '%20') AS segment FROM events")
def part_identity(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    t = partition.parse("identity(event_type)")
    p = partition.apply(t, F.col("event_type"), T.StringType())
    return events.select("event_id", p.alias("p"), partition.segment(t, p).alias("segment"))


def _murmur_sql(blocks: list[str], tail: str, size: str, source: str, key: str) -> str:
    """32-bit murmur3 as a chain of CTEs: one round for each block expression, then the tail and the end."""
    word = 4294967296
    rotl = lambda x, n: f"(({x}) * {2**n} % {word} + ({x}) // {2 ** (32 - n)})"
    mixed = lambda k: f"({rotl(f'(CAST({k} AS UHUGEINT) * 3432918353 % {word})', 15)} * 461845907 % {word})"
    ctes, last, h = [], source, "CAST(0 AS UHUGEINT)"
    for i, b in enumerate(blocks):
        ctes.append(f"k{i} AS (SELECT *, {mixed(b)} AS k_{i}, {h} AS h_in{i} FROM {last})")
        ctes.append(f"x{i} AS (SELECT *, CAST(xor(h_in{i}, k_{i}) AS UHUGEINT) AS x_{i} FROM k{i})")
        ctes.append(f"r{i} AS (SELECT *, ({rotl(f'x_{i}', 13)} * 5 + 3864292196) % {word} AS h_{i} FROM x{i})")
        last, h = f"r{i}", f"h_{i}"
    ctes.append(f"t AS (SELECT *, xor(CAST({h} AS UHUGEINT), {mixed(tail) if tail else 'CAST(0 AS UHUGEINT)'}) AS h_t FROM {last})")
    ctes.append(f"f0 AS (SELECT *, xor(h_t, CAST({size} AS UHUGEINT)) AS f_0 FROM t)")
    for i, (shift, factor) in enumerate(((16, 2246822507), (13, 3266489909), (16, 1)), 1):
        ctes.append(f"f{i} AS (SELECT *, xor(f_{i - 1}, f_{i - 1} // {2**shift}) * {factor} % {word} AS f_{i} FROM f{i - 1})")
    return f"WITH {', '.join(ctes)} SELECT {key}, CAST(f_3 % 2147483648 % 16 AS INTEGER) AS b FROM f3"


@query(_murmur_sql(["o_orderkey % 4294967296", "o_orderkey // 4294967296"], "", "8", "orders", "o_orderkey"))
def part_bucket_long(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    return orders.select("o_orderkey", hidden_partition("bucket[16](o_orderkey)", orders).alias("b"))


@query(None)
def part_bucket_string(spark: SparkSession, d: str) -> DataFrame:
    """Whole names of any length; tests hold the hash against a plain one."""
    part = load(spark, d, "part")
    return part.select("p_partkey", hidden_partition("bucket[16](p_name)", part).alias("b"))


@query(_murmur_sql(["date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) % 4294967296", "0"], "", "8", "orders", "o_orderkey"))
def part_bucket_date(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return orders.select("o_orderkey", hidden_partition("bucket[16](day)", orders).alias("b"))


@query(_murmur_sql(["epoch_us(ts) % 4294967296", "epoch_us(ts) // 4294967296"], "", "8", "events", "event_id"))
def part_bucket_timestamp(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    return events.select("event_id", hidden_partition("bucket[16](ts)", events).alias("b"))


@query(_murmur_sql([], "o_orderkey % 100", "1", "orders", "o_orderkey"))
def part_bucket_decimal(spark: SparkSession, d: str) -> DataFrame:
    """Unscaled values below 128 are one byte, of any precision."""
    orders = load(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 100) / F.lit(100)).cast("decimal(30,2)").alias("v"))
    return orders.select("o_orderkey", hidden_partition("bucket[16](v)", orders).alias("b"))


@query(_murmur_sql(["o_orderkey % 256 * 16777216", "0", "0", "o_orderkey // 256 % 256"], "", "16", "orders", "o_orderkey"))
def part_bucket_uuid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    byte = lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")
    text = F.concat(F.lit("000000"), byte(k % 256), F.lit("-0000-0000-0000-0000"), byte(F.floor(k / 256) % 256), F.lit("000000"))
    return load(spark, d, "orders").select("o_orderkey", partition.uuid_bucket(text, 16).alias("b"))


@query("""SELECT o_orderkey, o_orderkey - 5000 - (((o_orderkey - 5000) % 100) + 100) % 100 AS w, substr(o_orderpriority, 1, 3) AS s,
CAST(floor(CAST(o_totalprice AS DECIMAL(12,2)) * 2) / 2 AS DOUBLE) AS p FROM orders""")
def part_truncate(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") - 5000).alias("v"), "o_orderpriority", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    return orders.select("o_orderkey", hidden_partition("truncate[100](v)", orders).alias("w"), hidden_partition("truncate[3](o_orderpriority)", orders).alias("s"), hidden_partition("truncate[50](price)", orders).cast("double").alias("p"))


@query("SELECT event_id, 'event_type_trunc=' || replace(replace(replace(base64(encode(substr(event_type, 1, 4))), '+', '%2B'), '/', '%2F'), '=', '%3D') AS segment FROM events")
def part_binary_segment(spark: SparkSession, d: str) -> DataFrame:
    t = partition.parse("truncate[4](event_type)")
    raw = F.col("event_type").cast("binary")
    return load(spark, d, "events").select("event_id", partition.segment(t, partition.apply(t, raw, T.BinaryType()), T.BinaryType()).alias("segment"))


# Sources and staging


@query(f"WITH {LOG_SQL} SELECT op, seq, unchanged, o_orderkey, o_orderstatus, o_totalprice FROM log")
def envelope_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = workspace(spark, "staged")
    changelog.write_staged(orders_log(spark, d), path)
    out = changelog.read_staged(spark, path, _orders_schema(spark, d).struct())
    return out.select(F.col("_op").alias("op"), F.col("_seq").alias("seq"), F.try_element_at("_unchanged", F.lit(1)).alias("unchanged"), "o_orderkey", "o_orderstatus", "o_totalprice")


@query("""SELECT o_orderkey * 2 AS seq, 'D' AS op, o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey * 2 + 1, 'U', o_orderkey + 1000000 FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey * 2, 'U', o_orderkey FROM orders WHERE o_orderkey % 4 <> 0""")
def key_change_split(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    before = F.struct(F.col("o_orderkey").alias("k"), "o_custkey")
    after = F.struct((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 4 == 0, 1_000_000).otherwise(0)).alias("k"), "o_custkey")
    changes = orders.select(F.lit("U").alias("_op"), F.col("o_orderkey").alias("_seq"), before.alias("before"), after.alias("after"))
    return changelog.split_key_changes(changes, ["k"], ["k", "o_custkey"]).select(F.col("_seq").alias("seq"), F.col("_op").alias("op"), "k")


@query("""SELECT o_orderkey + CASE WHEN o_orderkey % 4 = 0 THEN 1000000 ELSE 0 END AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
CASE WHEN o_orderkey % 8 = 0 THEN 'fresh' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def key_change_staged(spark: SparkSession, d: str) -> DataFrame:
    """Moved keys that leave out a value, through staged files; half of them were updated in the same batch before. The
    largest keys come first, so that a key that another one moves to is free by then."""
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderpriority")
    table = Table.create(spark, workspace(spark, "moved"), TableSchema.of(orders.schema, ["k"]))
    table.commit(orders.withColumn("_op", F.lit("I")))
    row = lambda k, c, p: F.struct(k.alias("k"), c.alias("o_custkey"), p.alias("o_orderpriority"))
    k, c, none = F.col("k"), F.col("o_custkey"), F.lit(None).cast("string")
    at = F.lit(1 << 60) - k * 2
    fresh = orders.where("k % 8 = 0").select(F.lit("U").alias("_op"), at.alias("_seq"), F.array().cast("array<string>").alias("_unchanged"), F.lit(None).cast("struct<k: bigint, o_custkey: bigint, o_orderpriority: string>").alias("before"), row(k, c, F.lit("fresh")).alias("after"))
    moved = orders.where("k % 4 = 0").select(F.lit("U").alias("_op"), (at + 1).alias("_seq"), F.array(F.lit("o_orderpriority")).alias("_unchanged"), row(k, c, none).alias("before"), row(k + 1_000_000, c + 1, none).alias("after"))
    path = workspace(spark, "staged")
    changelog.write_staged(changelog.split_key_changes(changelog.checked(fresh.unionByName(moved)), ["k"], ["k", "o_custkey", "o_orderpriority"]), path)
    apply_batch(table, changelog.read_staged(spark, path, table.schema().struct(), ["k"]), 0, compact=False)
    return table.read()


def _cycles(spark: SparkSession, d: str) -> Cycle:
    """The orders log as two staged files, each run as a cycle; a marker for each nation."""
    table = Table.create(spark, workspace(spark, "orders"), _orders_schema(spark, d))
    controls = control.Tables(spark, workspace(spark, "control"))
    controls.create()
    cycle = Cycle("orders", table, controls)
    controls.register("orders")
    sizes = spark.createDataFrame([("orders", i, 10, f"file-{i}", 100 * i) for i in (1, 2)], "table_name string, claim_no long, record_count long, s3_path string, flushable_lsn long")
    controls.stage(sizes)
    controls.put("pending_markers", load(spark, d, "nation").select(F.col("n_name").alias("uuid"), (F.col("n_nationkey") * 10).cast("long").alias("commit_lsn")))
    log = orders_log(spark, d).withColumn("_lsn", F.col("_seq")).withColumn("_xid", F.col("o_orderkey") % 7).withColumn("_ts", F.col("o_orderdate").cast("timestamp"))
    closed = cycle.run(log.where(_TWO[0]), 0, 1_000, 10)
    assert closed is None and table.snapshot == 0, "the gate lets nothing through before the snapshot is complete"
    controls.snapshot_done("orders", 1)
    for i, condition in enumerate(_TWO):
        for _ in range(2):  # a replay adds nothing
            cycle.run(log.where(condition), i, (i + 1) * 1_000, (i + 1) * 10)
    return cycle


@query(f"""WITH m AS (SELECT n_name AS uuid, CASE WHEN n_nationkey * 10 < 200 THEN 1 ELSE 2 END AS snapshot_id FROM nation)
SELECT uuid, CAST(snapshot_id AS BIGINT) AS snapshot_id, (SELECT count(*) FROM ({STATE_SQL})) AS rows FROM m""")
def marker_emission(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot at which each marker was given out, and the rows of the table in the end."""
    cycle = _cycles(spark, d)
    rows = F.broadcast(cycle.table.read().agg(F.count("*").alias("rows")))
    return cycle.control.read("marker_emissions").select("uuid", "snapshot_id").crossJoin(rows)


@query(f"""WITH {LOG_SQL}, b AS (SELECT CASE WHEN seq % 10 = 0 THEN 1 ELSE 2 END AS snapshot_id, * FROM log)
SELECT CAST(snapshot_id AS BIGINT) AS snapshot_id, 'orders' AS table_name, max(seq) AS lsn, count(*) AS rows, CAST(count(DISTINCT o_orderkey % 7) AS INTEGER) AS tx_count, snapshot_id = 2 AS has_deletes, max(o_orderdate) AS max_source_ts FROM b GROUP BY snapshot_id""")
def commit_metadata(spark: SparkSession, d: str) -> DataFrame:
    """One row for each commit, whatever was replayed."""
    rows = spark.read.parquet(_cycles(spark, d).control.path("commits"))
    return rows.select("snapshot_id", "table_name", "lsn", "rows", "tx_count", (F.coalesce("delete_files", F.lit(0)) > 0).alias("has_deletes"), F.col("max_source_ts").cast("timestamp_ntz").alias("max_source_ts"))


@query("SELECT event_id, user_id AS xid, CAST(user_id * 10 AS BIGINT) AS commit_seq FROM events WHERE user_id % 4 <> 0")
def commit_filter(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").select(F.lit("I").alias("_op"), F.col("event_id").alias("_seq"), F.col("user_id").alias("_xid"), "event_id")
    commits = events.where("_xid % 4 <> 0").select("_xid").distinct().withColumn("_commit_seq", F.col("_xid") * 10)
    return changelog.committed(events, commits).select("event_id", F.col("_xid").alias("xid"), F.col("_commit_seq").alias("commit_seq"))


@query("""SELECT event_id, event_type AS t FROM events WHERE event_id % 2 = 1 UNION ALL SELECT event_id, 'a' FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'b' FROM events WHERE event_id % 2 = 0""")
def truncate_message_explode(spark: SparkSession, d: str) -> DataFrame:
    messages = load(spark, d, "events").select("event_id", F.col("event_id").alias("_seq"), F.when(F.col("event_id") % 2 == 0, "T").otherwise("I").alias("_op"), F.col("event_type").alias("_table"), F.array(F.lit("a"), F.lit("b")).alias("_tables"))
    return changelog.explode_truncates(messages).select("event_id", F.col("_table").alias("t"))


@query("SELECT event_id, 'all_' || (user_id % 3) AS t FROM events WHERE user_id % 3 < 2")
def publication_filter(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "events").select("event_id", F.concat(F.lit("part_"), (F.col("user_id") % 6).cast("string")).alias("_table"))
    parents = spark.range(6).select(F.concat(F.lit("part_"), F.col("id").cast("string")).alias("child"), F.concat(F.lit("all_"), (F.col("id") % 3).cast("string")).alias("parent"))
    return changelog.published(log, ["all_0", "all_1"], parents).select("event_id", F.col("_table").alias("t"))


@query("SELECT CAST(event_id AS VARCHAR) AS uuid, event_id * 3 AS commit_lsn FROM events WHERE event_id % 50 = 0")
def marker_interception(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "events").select(F.when(F.col("event_id") % 50 == 0, "markers").otherwise("events").alias("_table"), F.lit("I").alias("_op"), (F.col("event_id") * 3).alias("_lsn"), F.col("event_id").cast("string").alias("uuid"))
    return changelog.take_markers(log, "markers")[1]


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 300 ORDER BY o_orderkey LIMIT 100")
def key_page(spark: SparkSession, d: str) -> DataFrame:
    return tables.key_page(load(spark, d, "orders").select("o_orderkey", "o_custkey"), KEY, 100, [300])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey > 100 OR (l_orderkey = 100 AND l_linenumber > 2)) GROUP BY ALL")
def key_page_composite(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").where(tables.after_key(["l_orderkey", "l_linenumber"], [100, 2]))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts > TIMESTAMP '2024-01-10')
SELECT user_id, event_id, ts, value FROM r WHERE n = 1""")
def watermark_poll(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").select("user_id", "ts", "event_id", "value")
    after = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return tables.poll(events, ["user_id"], "ts", after).select("user_id", "event_id", "ts", "value")


@query("SELECT ts, event_id FROM events ORDER BY ts, event_id LIMIT 200")
def watermark_page(spark: SparkSession, d: str) -> DataFrame:
    return tables.poll_page(load(spark, d, "events").select("ts", "event_id"), ["event_id"], "ts", 200)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def snapshot_handoff(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot followed by changes, some of which it already holds."""
    orders = load(spark, d, "orders")
    log = orders.where("o_orderkey % 3 = 0").select(F.lit("U").alias("_op"), F.col("o_orderkey").alias("_seq"), F.lit(20).cast("long").alias("_lsn"), F.array().cast("array<string>").alias("_unchanged"), "o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") * 2).alias("o_totalprice"), "o_orderdate", "o_orderpriority")
    both = tables.snapshot_log(orders, KEY, 10).unionByName(log)
    return folding.materialise(both, _empty(spark, d), KEY).select("o_orderkey", "o_totalprice")


# Control


_CLAIMS = "SELECT event_type AS table_name, event_id AS claim_no, user_id % 7 + 1 AS record_count FROM events"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_type").alias("table_name"), F.col("event_id").alias("claim_no"), (F.col("user_id") % 7 + 1).alias("record_count"))


@query(f"SELECT table_name, claim_no, sum(record_count) OVER w - record_count + 5 AS start_offset, sum(record_count) OVER w + 5 AS end_offset FROM ({_CLAIMS}) WINDOW w AS (PARTITION BY table_name ORDER BY claim_no)".replace("sum(record_count) OVER w", "CAST(sum(record_count) OVER w AS BIGINT)"))
def offset_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = _claims(spark, d)
    counters = claims.select("table_name").distinct().withColumn("next_offset", F.lit(5).cast("long"))
    return control.claim_offsets(claims, counters).select("table_name", "claim_no", "start_offset", "end_offset")


@query(f"SELECT claim_no, end_offset FROM (SELECT table_name, claim_no, CAST(sum(record_count) OVER (PARTITION BY table_name ORDER BY claim_no) AS BIGINT) AS end_offset FROM ({_CLAIMS})) WHERE table_name = 'click' AND end_offset > 50 ORDER BY end_offset LIMIT 64")
def staged_log_read(spark: SparkSession, d: str) -> DataFrame:
    claims = _claims(spark, d)
    index = control.claim_offsets(claims, spark.createDataFrame([], "table_name string, next_offset long"))
    return control.unread(index, "click", 50, 64).select("claim_no", "end_offset")


@query("""SELECT o_orderkey AS uuid, o_custkey AS commit_lsn FROM orders
WHERE o_orderkey % 7 <> 0 AND o_custkey < (SELECT min(user_id + 20) FROM events WHERE event_type = 'click' AND event_id > 100)""")
def marker_eligibility(spark: SparkSession, d: str) -> DataFrame:
    pending = load(spark, d, "orders").select(F.col("o_orderkey").alias("uuid"), F.col("o_custkey").alias("commit_lsn"))
    emitted = pending.where("uuid % 7 = 0").select("uuid", F.lit("click").alias("table_name"))
    index = load(spark, d, "events").select(F.col("event_type").alias("table_name"), F.col("event_id").alias("end_offset"), (F.col("user_id") + 20).alias("flushable_lsn"))
    cursors = spark.range(1).select(F.lit("click").alias("table_name"), F.lit(100).cast("long").alias("last_offset"))
    return control.eligible_markers(pending, emitted, index, cursors, "click")


@query("SELECT o_orderkey AS uuid, 't' AS table_name, o_custkey AS a_snapshot, o_custkey + 1 AS b_snapshot FROM orders WHERE o_orderkey % 6 = 0")
def marker_pairing(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("uuid"), F.lit("t").alias("table_name"), F.col("o_custkey").alias("snapshot_id"))
    return control.pair_markers(rows.where("uuid % 2 = 0"), rows.where("uuid % 3 = 0").withColumn("snapshot_id", F.col("snapshot_id") + 1))


@query("""WITH w AS (SELECT r_name, row_number() OVER (ORDER BY r_name) - 1 AS i FROM region), t AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation)
SELECT n_name AS table_name, r_name AS worker_id FROM t JOIN w ON w.i = t.i % (SELECT count(*) FROM region)""")
def assign_tables(spark: SparkSession, d: str) -> DataFrame:
    return control.assign(load(spark, d, "nation").select(F.col("n_name").alias("table_name")), load(spark, d, "region").select(F.col("r_name").alias("worker_id")))


@query("SELECT user_id, max(ts) AS expires_at FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 16:00:00'")
def consumer_expiry(spark: SparkSession, d: str) -> DataFrame:
    consumers = load(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("expires_at"))
    return control.expired(consumers, F.lit("2024-01-30 16:00:00").cast("timestamp_ntz"))


@query("""SELECT 3 AS rule, n_name AS table_name FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 6, n_name FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT 10, n_name FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 11, n_name FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 0
UNION ALL SELECT 12, NULL UNION ALL SELECT 5, NULL""")
def validate_startup(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    state = load(spark, d, "nation").select(
        F.col("n_name").alias("table_name"), F.lit(False).alias("fresh"), (n % 5 != 0).alias("target_exists"), F.lit(True).alias("slot_exists"), F.lit(True).alias("logical_mode"), (n % 3 == 0).alias("snapshot_complete"), F.lit(0).alias("snapshot_lsn"),
        F.lit(150_000).alias("server_version"), F.lit(20).alias("restart_lsn"), F.lit(10).alias("flushed_lsn"), F.lit(15).alias("confirmed_lsn"), F.lit("reserved").alias("wal_status"), F.lit(False).alias("conflicting"), F.lit(7).alias("stored_oid"), F.when(n % 4 == 1, 8).otherwise(7).alias("current_oid"), (n % 2 != 0).alias("in_publication"),
    )
    return control.validate(state).select("rule", "table_name")


@query("""WITH s AS (SELECT event_id, event_type, user_id, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events)
SELECT event_id AS sample, event_type AS table_name, 1 AS rule FROM s WHERE user_id > 50 UNION ALL SELECT event_id, event_type, 3 FROM s WHERE user_id < p
UNION ALL SELECT event_id, event_type, 2 FROM s WHERE event_id % 10 > 5 UNION ALL SELECT event_id, event_type, 4 FROM s WHERE event_id % 100 = 0""")
def watcher_rules(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    samples = e.select(F.col("event_id").alias("sample"), F.col("event_type").alias("table_name"), F.col("user_id").alias("pipeline_lsn"), F.lit(50).alias("confirmed_lsn"), (F.col("event_id") % 10).alias("cursor"), F.lit(5).alias("max_end_offset"), F.when(F.col("event_id") % 100 == 0, "unreserved").otherwise("reserved").alias("wal_status"), F.lit(False).alias("conflicting"))
    return control.watch(samples).select("sample", "table_name", "rule")


@query("SELECT max(event_id) AS max_lsn, max(ts) AS max_source_ts, count(DISTINCT user_id) AS tx_count, count(*) AS rows FROM events")
def cycle_stats(spark: SparkSession, d: str) -> DataFrame:
    return folding.cycle_stats(load(spark, d, "events").select(F.col("event_id").alias("_lsn"), F.col("ts").alias("_ts"), F.col("user_id").alias("_xid")))


# Schema evolution and types


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 5000000000 ELSE o_custkey END AS o_custkey,
CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'new' END AS note FROM orders""")
def schema_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Add, drop and promote between two commits; earlier files are read as they are."""
    orders = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_orderstatus")
    table = Table.create(spark, workspace(spark, "evolved"), TableSchema.of(orders.schema, KEY))
    table.commit(orders.where("o_orderkey % 2 = 1").withColumn("_op", F.lit("I")))
    table.evolve(apply(table.schema(), diff(table.schema(), {"o_orderkey": T.LongType(), "o_custkey": T.LongType(), "note": T.StringType()})))
    later = orders.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_custkey") + F.lit(5_000_000_000)).alias("o_custkey"), F.lit("new").alias("note"), F.lit("I").alias("_op"))
    table.commit(later)
    return table.read().select("o_orderkey", "o_custkey", "o_orderstatus", "note")


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) = CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(12,1)) AS fits FROM orders")
def decimal_rescale(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", kinds.fits_exactly(F.col("o_totalprice").cast("decimal(12,2)"), 12, 1).alias("fits"))


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AS flag, CAST((o_orderkey % 24) * 3600000000 + 123000 AS BIGINT) AS micros, CAST(o_orderdate AS DATE) AS day,
upper(to_hex(o_orderkey // 4294967296)) || '/' || upper(to_hex(o_orderkey * 3)) AS lsn, o_orderkey * 3 AS lsn_number FROM orders""")
def text_decode(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    k = F.col("o_orderkey")
    flag = F.when(k % 2 == 0, "t").otherwise("f")
    clock = F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:00.123+02"))
    lsn = kinds.format_lsn(k * 3)
    return orders.select("o_orderkey", kinds.decode_text(flag, "boolean").alias("flag"), kinds.decode_text(clock, "timetz").alias("micros"), kinds.decode_text(F.substring(F.col("o_orderdate").cast("string"), 1, 10), "date").alias("day"), lsn.alias("lsn"), kinds.parse_lsn(lsn).alias("lsn_number"))


# Operational tables


def _commits(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.select(F.col("ts"), F.col("event_type").alias("table_name"), F.col("event_id").alias("snapshot_id"), (F.col("user_id") * 10).alias("rows"), (F.col("user_id") * 1000).alias("bytes"), (F.col("event_id") % 3).cast("int").alias("data_files"), (F.col("event_id") % 2).cast("int").alias("delete_files"), (F.col("ts") - F.make_dt_interval(secs=F.col("event_id") % 60)).alias("max_source_ts"), (F.col("event_id") % 5).cast("int").alias("tx_count"))


_COMMITS_SQL = "commits AS (SELECT ts, event_type AS table_name, event_id, user_id * 10 AS rows, user_id * 1000 AS bytes, event_id % 3 AS data_files, event_id % 2 AS delete_files, ts - to_seconds(event_id % 60) AS max_source_ts, event_id % 5 AS tx_count FROM events)"
_NOW = "2024-03-01 00:00:00"


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp_ntz")


@query(f"WITH {_COMMITS_SQL} SELECT table_name, CAST(floor(epoch(TIMESTAMP '{_NOW}' - max(ts))) AS BIGINT) AS seconds_since_commit, CAST(floor(epoch(TIMESTAMP '{_NOW}' - max(max_source_ts))) AS BIGINT) AS source_lag_seconds FROM commits GROUP BY table_name")
def meta_freshness(spark: SparkSession, d: str) -> DataFrame:
    return metadata.freshness(_commits(spark, d), _now())


@query(f"SELECT CAST(user_id AS VARCHAR) AS worker_id, CAST(floor(epoch(TIMESTAMP '{_NOW}' - max(ts))) AS BIGINT) AS seconds_silent FROM events GROUP BY user_id")
def meta_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    return metadata.heartbeat(load(spark, d, "events").select("ts", F.col("user_id").cast("string").alias("worker_id")), _now())


@query(f"WITH {_COMMITS_SQL} SELECT table_name, date_trunc('hour', ts) AS hour, round(avg((event_id % 60) * 1000), 3) AS avg_lag_ms, CAST(max((event_id % 60) * 1000) AS BIGINT) AS max_lag_ms, count(*) AS commits FROM commits GROUP BY ALL")
def meta_lag_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return metadata.lag_by_hour(_commits(spark, d)).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(f"WITH {_COMMITS_SQL} SELECT table_name, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(tx_count) AS BIGINT) AS transactions, count(*) AS commits FROM commits WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY table_name")
def meta_throughput(spark: SparkSession, d: str) -> DataFrame:
    return metadata.throughput(_commits(spark, d), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


@query(f"WITH {_COMMITS_SQL}, c AS (SELECT table_name, max(ts) AS last_ts FROM commits WHERE event_id % 97 = 0 GROUP BY table_name) SELECT table_name, CAST(sum(delete_files) AS BIGINT) AS delete_files, CAST(sum(data_files) AS BIGINT) AS data_files FROM commits LEFT JOIN c USING (table_name) WHERE last_ts IS NULL OR ts > last_ts GROUP BY table_name")
def meta_deletes_since_compaction(spark: SparkSession, d: str) -> DataFrame:
    commits = _commits(spark, d)
    return metadata.deletes_since_compaction(commits, commits.where("snapshot_id % 97 = 0"))


@query("SELECT event_type AS table_name, CAST(sum(event_id % 9 + event_id % 4) AS BIGINT) AS files_in, CAST(sum(event_id % 3) AS BIGINT) AS files_out, CAST(sum(user_id) AS BIGINT) AS rows_removed, CAST(sum(event_id % 1000 - event_id % 100) AS BIGINT) AS bytes_saved FROM events GROUP BY event_type")
def meta_compaction_effect(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    n = F.col("event_id")
    rows = e.select("ts", F.col("event_type").alias("table_name"), n.alias("snapshot_id"), n.alias("sequence_number"), (n % 9).alias("input_data_files"), (n % 4).alias("input_delete_files"), (n % 3).alias("output_data_files"), F.col("user_id").alias("rows_removed"), (n % 1000).alias("bytes_before"), (n % 100).alias("bytes_after"))
    return metadata.compaction_effect(metadata.normalised(rows, metadata.COMPACTIONS))


# Queries on replicated tables


@query("SELECT o_orderkey, CAST(length(o_orderpriority) AS INTEGER) AS n, substr(o_orderpriority, 1, 1) AS c, round(o_totalprice, 6) AS p FROM (" + STATE_SQL + ") ORDER BY o_orderkey, n")
def select_from_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT o_orderkey, length(o_orderpriority) AS n, substr(o_orderpriority, 1, 1) AS c, round(o_totalprice, 6) AS p FROM {orders} ORDER BY o_orderkey, n", orders=_table(spark, d, _TWO).read())


@query("SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM (" + STATE_SQL + ") JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
def join_from_table(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, _TWO).read()
    return orders.join(load(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
