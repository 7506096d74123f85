"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftwell.llm.shared import SPACE, Scratch

WEIGHTS, EPOCHS, SHARE = (5, 2, 1), 2, 1.5
#: Words in a block: at most MOST_WORDS, fewer where the mix is small, so that it has about SLOTS slots or more.
MOST_WORDS, SLOTS = 4096, 98_304
GOLDEN = 0.6180339887498949
CELLS = 1024
#: Rows in a bucket of the two-step running sums.
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, n, words, target) from (source, size): n numbers sources by code point, null last, from 1.

    Weights repeat in that order. Targets share `share` times all words by weight; one that passes `epochs` times its
    source's words stops there and the excess is shared by weight among the others, until none is above. That end
    state is a water level: target = min(weight * level, cap), found from sums in the order of cap / weight.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("words"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1)
    caps = by_source.withColumn("n", n).withColumn("w", weight.cast("double")).withColumn("cap", F.col("words") * float(epochs)).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "n")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("words").over(Window.partitionBy()) * share
    steps = caps.withColumn("level", (total - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "n", "level"))).over(Window.partitionBy())["level"]
    return steps.withColumn("target", F.least(F.col("w") * level, "cap")).select("source", "n", "words", "target")


def _slots(spark: SparkSession, sources: DataFrame, slots: int) -> DataFrame:
    """(n, block): slot i takes the source whose stretch of cumulative targets holds the golden-ratio point of i, and
    of that source the block of the slot's rank among the source's slots."""
    span = Window.orderBy("n")
    upto = F.sum("target").over(span.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("target").over(Window.partitionBy())
    stretch = sources.where("target > 0").select("n", (upto / total).alias("hi"), ((upto - F.col("target")) / total).alias("lo"))
    # Rounding must not leave a gap at the top.
    stretch = stretch.withColumn("hi", F.when(F.lead("n").over(span).isNull(), 2.0).otherwise(F.lead("lo").over(span)))
    cell = F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.floor(F.least("hi", F.lit(1.0)) * CELLS).cast("int")))
    stretch = stretch.withColumn("cell", cell)
    # i * GOLDEN mod 1, in two parts so that doubles stay exact enough for any i.
    part = 1 << 20
    point = (F.pmod("i", F.lit(part)) + 0.5) * GOLDEN + F.floor(F.col("i") / part) * ((part * GOLDEN) % 1)
    points = spark.range(slots).withColumnRenamed("id", "i").withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    taken = points.join(stretch, "cell").where("u >= lo AND u < hi").withColumn("chunk", F.floor(F.col("i") / 8192)).select("n", "i", "chunk")
    earlier = taken.groupBy("n", "chunk").count().withColumn("before", F.sum("count").over(Window.partitionBy("n").orderBy("chunk")) - F.col("count"))
    rank = F.row_number().over(Window.partitionBy("n", "chunk").orderBy("i")) - 1
    return taken.withColumn("rank", rank).join(earlier, ["n", "chunk"]).select("n", (F.col("before") + F.col("rank")).alias("block"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(id, source, size, source_size, target, taken): how many words of each document the mix takes, repeats counted.

    A source's documents lie in hash order, end to end, over `epochs` laps; the line is cut into blocks of equal
    word counts, and slot r of the source joins block r. So no document is taken more than `epochs` times its size,
    and a source's taken words differ from its target by a few blocks at most (a mix has 98,304 blocks or more, or
    blocks of one word). Null or blank texts have size 0 and nothing is taken from them; a null source is a source,
    the last. Null ids and repeated rows count as rows of their own. Other columns are ignored, so their names
    cannot clash. An empty table gives no rows. Reruns agree.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = scratch.keep(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")), "rows")
    sources = scratch.keep(source_targets(rows, weights, share, epochs), "sources")
    target, count = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0], rows.count()
    words = max(1, min(MOST_WORDS, int(target // SLOTS)))
    slots = scratch.keep(_slots(spark, sources, -int(-target // words)), "slots")

    # Running sums within hash buckets of a source, then over its buckets: a hot source is many groups.
    bits = max(1, (count // BUCKET_ROWS).bit_length())
    h = F.xxhash64(F.lit("mix"), "id", "source", "size")
    named = sources.withColumnRenamed("source", "_source")
    placed = rows.join(named, rows["source"].eqNullSafe(named["_source"])).select("id", "source", "size", "n", "words", "target", h.alias("h")).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    inside = F.sum("size").over(Window.partitionBy("n", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    sums = placed.groupBy("n", "bucket").agg(F.sum("size").alias("all"))
    sums = sums.withColumn("before", F.sum("all").over(Window.partitionBy("n").orderBy("bucket")) - F.col("all")).drop("all")
    number = F.row_number().over(Window.partitionBy("n", "bucket").orderBy("h", "id"))
    placed = placed.withColumn("inside", inside).withColumn("number", number).join(sums, ["n", "bucket"]).withColumn("at", F.col("before") + F.col("inside"))
    placed = scratch.keep(placed.select("id", "source", "size", "n", "words", "target", "bucket", "number", "at"), "placed")

    starts = F.array(*(F.col("at") + lap * F.col("words") for lap in range(epochs)))
    laps = placed.where("size > 0").select("n", "bucket", "number", "size", F.explode(starts).alias("lo"))
    pieces = laps.withColumn("hi", F.col("lo") + F.col("size")).withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / words), F.floor((F.col("hi") - 1) / words))))
    overlap = F.least("hi", (F.col("block") + 1) * words) - F.greatest("lo", F.col("block") * words)
    taken = pieces.join(slots, ["n", "block"]).groupBy("n", "bucket", "number").agg(F.sum(overlap).alias("taken"))
    out = placed.join(taken, ["n", "bucket", "number"], "left")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("words").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The documents as the mix holds them: each as often as the nearest whole number to taken / size.

    Documents without words take no part in the mix's weights and stay once. Cases as in mix().
    """
    taken = mix(docs, id_col, text_col, source_col, **settings)
    taken = taken.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"), F.col("size").alias("_size"), "taken")
    copies = taken.groupBy("_id", "_source", "_size").agg(F.sum("taken").alias("t"), F.sum("_size").alias("s")).withColumn("copies", F.when(F.col("s") == 0, 1).otherwise(F.round(F.col("t") / F.greatest(F.col("s"), F.lit(1)))).cast("int"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(whole.alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    same = rows["id"].eqNullSafe(copies["_id"]) & rows["source"].eqNullSafe(copies["_source"]) & (rows["size"] == copies["_size"])
    return rows.join(copies.where("copies > 0"), same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
