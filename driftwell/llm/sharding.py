"""Size-balanced shards by sampled splitters over a key range."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftwell.llm.shared import Scratch

#: Key samples behind each splitter, and key ranges planned for each shard: what the driver holds and broadcasts grows
#: with the number of shards alone.
SAMPLES_PER_RANGE, RANGES_PER_SHARD = 16, 128
#: Rows that are numbered together, on average.
ROWS_TOGETHER = 100_000
#: A group of equal texts above 1 / OVERFULL of a shard is cut into SALTS parts; a group or part above 1 / HEAVY is
#: placed by itself. So at most shards * OVERFULL groups and shards * HEAVY parts can reach the driver.
OVERFULL, SALTS, HEAVY = 8, 256, 64
CELL_BITS = 12


@dataclass
class ShardPlan:
    """Where each piece of the key space goes: rows for broadcast tables, all bounded by the constants above."""

    overfull: list[tuple[int]]
    heavy: list[tuple[int, int, int, int, int]]  # key, salt, piece, shard, offset
    ranges: list[tuple[int, int, int, int, int, int]]  # cell, lo, hi, piece, shard, offset


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All columns as a struct, plus id, size, key. Equal texts share a key; the key is uniform over 64-bit values."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def _salted(spark: SparkSession, rows: DataFrame, overfull: list[tuple[int]]) -> DataFrame:
    """salt: 0, or for rows of an overfull group a number dealt by their id, which also gives the part a key of its own."""
    hot = _small(spark, [(k, True) for (k,) in overfull], "key long, hot boolean")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.join(hot, "key", "left").withColumn("salt", salt).withColumn("key", F.when(F.col("hot"), F.xxhash64("key", "salt")).otherwise(F.col("key"))).drop("hot")


def _cells(bounds: list[int]) -> list[tuple[int, int, int, int]]:
    """(cell, lo, hi, range) for ranges [bounds[i], bounds[i + 1]), cut at the cells' edges so that a range is found by an equi-join."""
    width, low = 1 << (64 - CELL_BITS), -(1 << 63)
    out = []
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        for cell in range(lo >> (64 - CELL_BITS), ((hi - 1) >> (64 - CELL_BITS)) + 1):
            out.append((cell, max(lo, cell * width, low), min(hi, (cell + 1) * width) - 1, i))
    return out


def _in_ranges(spark: SparkSession, rows: DataFrame, cells: list[tuple], extra: str = "") -> DataFrame:
    cells_df = _small(spark, cells, "cell int, lo long, hi long, piece int" + extra)
    return rows.withColumn("cell", F.shiftright("key", 64 - CELL_BITS).cast("int")).join(cells_df, "cell").where("key BETWEEN lo AND hi").drop("cell", "lo", "hi")


def plan_shards(spark: SparkSession, rows: DataFrame, shards: int) -> ShardPlan:
    """rows: (id, size, key), read a few times."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    share = max(1, total // shards)
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    overfull = [(r[0],) for r in groups.where(F.col("size") * OVERFULL > share).select("key").collect()]
    units = _salted(spark, rows, overfull).groupBy("key", "salt").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    is_heavy = F.col("size") * HEAVY > share
    heavy = units.where(is_heavy).orderBy(F.desc("size"), "key", "salt").collect()
    light = units.where(~is_heavy)

    # Size-weighted key samples: a unit is drawn with probability size * samples / total, decided by a hash of its key.
    n_ranges = shards * RANGES_PER_SHARD
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "key", "salt"), 11) / F.lit(float(1 << 53))
    drawn = sorted(r[0] for r in light.where(draw * total < F.col("size") * (n_ranges * SAMPLES_PER_RANGE)).select("key").collect())
    splitters = sorted({drawn[i * len(drawn) // n_ranges] for i in range(1, n_ranges)}) if drawn else []
    low, high = -(1 << 63), 1 << 63
    bounds = [low, *(s for s in splitters if s > low), high]

    target = max(1, total // n_ranges)
    for tries in range(4):
        sums = {r["piece"]: r for r in _in_ranges(spark, light, _cells(bounds)).groupBy("piece").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.count("*").alias("units")).collect()}
        cuts = []
        for i, r in sums.items():  # an overfull range is cut evenly: keys are hashes, so widths stand for sizes
            if r["size"] > 2 * target and r["units"] > 1:
                lo, hi, parts = bounds[i], bounds[i + 1], -(-r["size"] // target)
                cuts += [lo + (hi - lo) * k // parts for k in range(1, parts)]
        if not cuts or tries == 3:  # the sums must be those of the bounds
            break
        bounds = sorted({*bounds, *cuts})

    load, counts = [0] * shards, [0] * shards
    heap = [(0, s) for s in range(shards)]
    placed = []
    for piece, u in enumerate(heavy):
        at, s = heapq.heappop(heap)
        placed.append((u["key"], u["salt"], len(bounds) + piece, s, counts[s]))
        counts[s] += u["n"]
        load[s] = at + u["size"]
        heapq.heappush(heap, (load[s], s))
    # Ranges in key order fill what is left of each shard: shard s ends where the cumulative sizes pass its capacity.
    rest = sum(r["size"] for r in sums.values())
    level = _level(load, rest)
    ends, edge = [], 0.0
    for s in range(shards):
        edge += max(0.0, level - load[s])
        ends.append(edge)
    where, passed = {}, 0
    for i in range(len(bounds) - 1):
        size = sums[i]["size"] if i in sums else 0
        s = min(bisect_right(ends, passed + size / 2), shards - 1)
        where[i] = (s, counts[s])
        passed += size
        counts[s] += sums[i]["n"] if i in sums else 0
    return ShardPlan(overfull, placed, [(cell, lo, hi, i, *where[i]) for cell, lo, hi, i in _cells(bounds)])


def _level(load: list[int], rest: float) -> float:
    """The level to which `rest` fills vessels that already hold `load`."""
    held = sorted(load)
    for k in range(1, len(held) + 1):
        level = (rest + sum(held[:k])) / k
        if k == len(held) or level <= held[k]:
            return level
    return 0.0


def _placed(spark: SparkSession, rows: DataFrame, plan: ShardPlan) -> DataFrame:
    heavy = _small(spark, plan.heavy, "key long, salt int, h_piece int, h_shard int, h_offset long")
    rows = _salted(spark, rows, plan.overfull).join(heavy, ["key", "salt"], "left")
    rows = _in_ranges(spark, rows, plan.ranges, ", shard int, offset long").withColumn("heavy", F.col("h_piece").isNotNull())
    for c in ("piece", "shard", "offset"):
        rows = rows.withColumn(c, F.coalesce(f"h_{c}", c))
    return rows.drop("h_piece", "h_shard", "h_offset")


def shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row, shards of nearly equal bytes.

    A row's size is its text's UTF-8 bytes plus 1; null and empty texts have size 1. Rows of equal texts stay in
    one shard unless their group is overfull (above 1/8 of a shard); then it is cut by id. slot numbers the rows
    of a shard from 0 without gaps. Null ids and repeated rows are placed like any others; rows that are equal in
    id and text are interchangeable. Other columns are ignored, so their names cannot clash. An empty table gives
    no rows. The text itself is never shuffled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = scratch.keep(_keyed(docs, id_col, text_col).drop("row"), "rows")
    # A piece's rows are numbered by stretches of their keys, or of their ids' hashes where one key is the whole piece.
    bits = (rows.count() // ROWS_TOGETHER).bit_length()
    stretch = F.shiftrightunsigned(F.when(F.col("heavy"), F.xxhash64(F.lit("slot"), "id")).otherwise(F.col("key")), 64 - bits) if bits else F.lit(0).cast("long")
    placed = _placed(spark, rows, plan_shards(spark, rows, shards)).withColumn("stretch", stretch)
    counts = placed.groupBy("piece", "stretch").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("piece").orderBy("stretch")) - F.col("n")
    placed = placed.join(counts.select("piece", "stretch", before.alias("before")), ["piece", "stretch"])
    rank = F.row_number().over(Window.partitionBy("piece", "stretch").orderBy("key", "salt", "id"))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("before") + rank - 1).alias("slot"))


def with_shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """The documents with a shard column (an existing one of that name gives way); cases as in shards()."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = scratch.keep(_keyed(docs, id_col, text_col).drop("row"), "rows")
    plan = plan_shards(spark, rows, shards)
    placed = _placed(spark, _keyed(docs, id_col, text_col), plan)
    return placed.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != shard_col), F.col("shard").alias(shard_col))
