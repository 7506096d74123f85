"""Connected components, and linking within candidate buckets, as joins and aggregates only.

Both are used where groups may be huge: nothing here gathers a group in one task, emits all pairs of a
group, or brings links to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.shared import Scratch

#: Times that the nearest pair of every two components is tried before all pairs that are left.
NEAREST = 2


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(scratch: Scratch, edges: DataFrame, name: str, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for every node of an edge.

    Alternating large-star and small-star contraction: each round is two min-aggregates and two joins, and
    every node ends as a leaf of the star around its component's smallest node. Rounds needed grow with the
    logarithm of the longest path; a result that still changes after `rounds` raises. Self loops, repeated
    and reversed edges are allowed; no edges give no rows.
    """
    cur = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    cur = scratch.keep(cur, f"{name}-0")
    state, last = _state(cur), f"{name}-0"
    for i in range(1, rounds + 1):
        # Large star: each larger neighbour of u moves to the smallest node around u.
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.distinct(), f"{name}-{i}a")
        # Small star: u and its smaller neighbours all point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        cur = scratch.keep(small.where("u <> v").distinct(), f"{name}-{i}")
        scratch.drop(last, f"{name}-{i}a")
        last, before, state = f"{name}-{i}", state, _state(cur)
        if state == before:
            roots = cur.select(F.col("v").alias("node")).distinct()
            return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def star(at: DataFrame, quick: Callable[[Column, Column], Column], seed: int) -> DataFrame:
    """Pairs of each bucket's rows with one pivot: the node that shares buckets with most rows, ties by a hash."""
    sized = at.groupBy("bucket").agg(F.count("*").alias("rows"))
    weight = at.select("bucket", "node").join(sized, "bucket").groupBy("node").agg(F.sum("rows").alias("weight"))
    ranked = at.join(weight, "node")
    pivot = ranked.groupBy("bucket").agg(F.max(F.struct("weight", F.xxhash64(F.lit(seed), "node").alias("h"), "node", "code", "component")).alias("p"))
    pairs = at.join(pivot, "bucket").where((F.col("component") != F.col("p.component")) & quick(F.col("code"), F.col("p.code")))
    return pairs.select(F.greatest("node", "p.node").alias("a"), F.least("node", "p.node").alias("b"))


def linked_components(scratch: Scratch, shared: DataFrame, quick: Callable[[Column, Column], Column], confirm: Callable[[DataFrame], DataFrame], name: str, propose=star, finish: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 2, widen: Callable[[DataFrame], DataFrame] | None = None, strict: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(node, component) over confirmed links among rows that share a bucket; nodes without a link may be missing.

    shared has (bucket, node, code), only buckets of two nodes or more. quick(code, code) is a cheap necessary
    condition of a link; confirm((a, b)) keeps the pairs that are links. A few rounds of propose, which names at
    most about one pair for each row of a bucket, join most of what belongs together. Then all pairs of different
    components that share a bucket and meet the quick condition, and were not confirmed before, are confirmed: the
    condition is part of the join, so what comes out is only what may still join two components. A pair within
    one component needs no test, since it cannot change the result; so no link between components is lost. widen and
    strict, if given, make that condition harder: widen gives the rows of the last step a column `more`, which is too wide
    for every round, and strict(more, more) says how far apart two rows are, or null where they can't be linked. Of the
    buckets that two rows share it may be null in all but one. The nearest pair of two components is then confirmed first,
    since a link spares their other pairs. finish, if given, takes the place of that last step: from (bucket, node, code, component) it gives links that join what links
    can join.
    """
    links = tested = labels = None

    def labelled(df: DataFrame) -> DataFrame:
        return df.withColumn("component", F.col("node")) if labels is None else df.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def add(pairs: DataFrame, step: str) -> None:
        nonlocal links, tested, labels
        pairs = pairs.distinct() if tested is None else pairs.distinct().join(tested, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, f"{name}-pairs{step}")
        good = scratch.keep(confirm(pairs), f"{name}-links{step}")
        links, tested = (good, pairs) if links is None else (links.unionByName(good), tested.unionByName(pairs))
        labels = scratch.keep(components(scratch, links, f"{name}-{step}"), f"{name}-labels{step}")

    rows = shared
    for i in range(rounds + 1):
        at = labelled(rows)
        if i:
            split = at.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
            at = scratch.keep(at.join(split, "bucket", "left_semi"), f"{name}-split{i}")
            rows = at.drop("component")
        if i < rounds:
            add(propose(at, quick, i), str(i))
            continue
        if finish:
            links = links.unionByName(scratch.keep(finish(at), f"{name}-links-last"))
            labels = scratch.keep(components(scratch, links, f"{name}-last"), f"{name}-labels-last")
            break
        at = widen(at) if widen else at
        x, y = at.alias("x"), at.alias("y")
        condition = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component")) & quick(F.col("x.code"), F.col("y.code"))
        ends = [F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")]
        if not strict:
            add(x.join(y, condition).select(*ends), "-cross")
            continue
        how_far = strict(F.col("x.more"), F.col("y.more"))
        cross = x.join(y, condition & how_far.isNotNull()).select(*ends, F.col("x.component").alias("lo"), F.col("y.component").alias("hi"), how_far.alias("far"))
        cross = scratch.keep(cross, f"{name}-cross")
        for step in range(NEAREST):  # one link of two components makes their other pairs needless
            add(cross.groupBy("lo", "hi").agg(F.min_by(F.struct("a", "b"), F.struct("far", "a", "b")).alias("p")).select("p.*"), f"-nearest{step}")
            for side in ("lo", "hi"):
                cross = cross.join(labels.select(F.col("node").alias(side), F.col("component").alias("_c")), side, "left").withColumn(side, F.coalesce("_c", side)).drop("_c")
            cross = cross.where("lo <> hi").join(tested, ["a", "b"], "left_anti").select("a", "b", F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"), "far")
            cross = scratch.keep(cross, f"{name}-cross{step}")
        add(cross.select("a", "b"), "-cross")
    last = f"{name}-labels-last" if finish else f"{name}-labels-cross"
    scratch.drop(*(n for n in scratch.names if n.startswith(f"{name}-") and n != last))
    return labels
