"""MinHash near-duplicate removal with odd sketches.

Each document's set of word shingles gives k MinHash samples. Their bands propose candidates; the samples,
folded into a parity bitmap (an odd sketch), estimate the similarity of a candidate pair by one XOR and
population count; what passes is confirmed on the full sets. Documents with equal sets are one class from
the start, so exact copies never form pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.llm.linking import linked_components
from driftwell.llm.shared import Scratch, forget, utf8
from driftwell.llm.words import C1, WordHashes, longs, mix, space_words, windows

WORDS, SIMILARITY = 5, 0.75
#: 28 bands of 3 samples: a pair at similarity 0.75 shares no band with probability (1 - 0.75**3)**28 = 2e-7.
BANDS, ROWS = 28, 3
#: Samples folded into the bitmap (the first BANDS * ROWS of them make the bands), and its bits.
SAMPLES, BITS = 256, 1024
#: Rows of a bucket compared with one another at once, and bytes of full sets held at once by the last comparison.
TOGETHER, TOGETHER_BYTES = 2048, 32 << 20


def shingles(text: bytes | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. Fewer words than a shingle: the whole sequence is one; none: empty."""
    h = hashes.of(space_words(text)) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    return np.unique(windows(h, words) if len(h) >= words else windows(np.append(h, C1), len(h) + 1))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples of each non-empty set, one row each."""
    a, b = _permutations()
    out = np.full((len(sets), SAMPLES), 2**32 - 1, np.uint32)
    for i, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 4096):
            np.minimum(out[i], (np.multiply.outer(x[at : at + 4096], a) + b).min(axis=0), out=out[i])
    return out


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps of (sample number, sample), BITS wide, as rows of 64-bit words."""
    n = len(minima)
    with np.errstate(over="ignore"):
        bit = mix(minima.astype(np.uint64) + (np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    odd = np.bincount((np.arange(n)[:, None] * BITS + bit.astype(np.int64)).ravel(), minlength=n * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, BITS), axis=1).view(np.uint64)


def bands(minima: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of it."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * C1
    for r in range(ROWS):
        out = mix(out + minima[:, r : BANDS * ROWS : ROWS].astype(np.uint64) + C1)
    return out


def estimate(xor_bits: int) -> float:
    """Similarity that an XOR population count stands for: 1 + BITS / (4 k) ln(1 - 2 bits / BITS)."""
    return 1 + BITS / (4 * SAMPLES) * math.log(max(1 - 2 * xor_bits / BITS, 1e-9))


def most_xor_bits(similarity: float) -> int:
    """The largest XOR population count kept as a candidate: five standard deviations below the threshold.

    The sample's spread is sqrt(s (1 - s) / k); the bitmap's own spread is far smaller at these widths and is
    covered by the rounding up. What this filter lets through is confirmed exactly.
    """
    floor = max(similarity - 5 * math.sqrt(similarity * (1 - similarity) / SAMPLES), 0.05)
    return next((b for b in range(BITS // 2) if estimate(b) < floor), BITS // 2)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows that come sorted by keys, as tables of whole groups with the groups' bounds."""

    def bounds(rows: pa.Table) -> list[int]:
        new = np.zeros(rows.num_rows - 1, bool)
        for k in keys:
            v = rows.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        return [0, *(np.flatnonzero(new) + 1).tolist(), rows.num_rows]

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if len(held) > 1 and all(held[0].column(k)[0].as_py() == held[-1].column(k)[-1].as_py() for k in keys):
            continue  # one large group goes on
        rows = pa.concat_tables(held).combine_chunks()
        at = bounds(rows)
        if len(at) > 2:
            yield rows.slice(0, at[-2]).combine_chunks(), at[:-1]
        held = [rows.slice(at[-2])]
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        yield rows, bounds(rows)


def _matrix(rows: pa.Table, column: str, width: int) -> np.ndarray:
    return rows.column(column).chunk(0).flatten().to_numpy().view(np.uint64).reshape(rows.num_rows, width)


def _pairs(node: list[bytes], found: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = [(max(node[i], node[j]), min(node[i], node[j])) for i, j in found]
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in ends], pa.binary()), pa.array([b for _, b in ends], pa.binary())], ["a", "b"])


PAIRS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


class Forest:
    """Candidate pairs of a bucket's rows: the edges of a maximum spanning forest over estimated similarity.

    Only pairs of different components within the sketch's limit count, the most similar first; a pair that the
    forest already joins is left out, so a bucket gives fewer pairs than it has rows.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def __call__(self, at: DataFrame, quick: object, seed: int) -> DataFrame:
        # A bucket of more than TOGETHER rows is dealt into parts at random, anew in each round.
        size = at.groupBy("bucket").count()
        part = F.pmod(F.xxhash64(F.lit(seed), "node"), F.ceil(F.col("count") / TOGETHER))
        dealt = at.join(size, "bucket").select("bucket", part.alias("part"), "node", "code", "component")
        return dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(self._propose, PAIRS)

    def _propose(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _groups(batches, ["bucket", "part"]):
            code = _matrix(rows, "code", BITS // 64)
            node, component = rows.column("node").to_pylist(), rows.column("component").to_pylist()
            found = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo == 2:
                    if component[lo] != component[lo + 1] and np.bitwise_count(code[lo] ^ code[lo + 1]).sum() <= self.limit:
                        found.append((lo, lo + 1))
                elif hi - lo > 2:
                    found += [(lo + i, lo + j) for i, j in forest(code[lo:hi], component[lo:hi], self.limit)]
            yield _pairs(node, found)


class Rest:
    """The last step: every pair of different components that shares a bucket and meets the sketch's limit is compared on
    the full sets, where it lies, and the links that join components come out.

    A pair is compared in the first of its shared bands only. A bucket too large for one task is dealt into blocks, and
    each two blocks meet in a task; what a task holds is bounded by TOGETHER rows and TOGETHER_BYTES of sets a block.
    """

    def __init__(self, limit: int, percent: int, classes: DataFrame, sets: DataFrame):
        self.limit, self.percent, self.classes, self.sets = limit, percent, classes, sets

    def __call__(self, at: DataFrame) -> DataFrame:
        # By the sketches alone, most rows have no pair left to compare; only the others bring their sets.
        size = at.groupBy("bucket").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("blocks"))
        left = _meeting(at, size, "code", "component").mapInArrow(_with_pairs(self.limit), "bucket long, node binary").distinct()
        full = at.join(left, ["bucket", "node"]).join(self.classes.select(F.col("key").alias("node"), "bands"), "node").join(self.sets.withColumnRenamed("key", "node"), "node")
        blocks = F.ceil(F.greatest(F.count("*") / TOGETHER, F.sum(F.size("shingles")) * 8 / TOGETHER_BYTES))
        size = full.groupBy("bucket").agg(blocks.cast("int").alias("blocks"))
        return _meeting(full, size, "code", "component", "bands", "shingles").mapInArrow(_compared(self.limit, self.percent), PAIRS)


def _meeting(rows: DataFrame, size: DataFrame, *columns: str) -> DataFrame:
    """Rows sorted into groups (bucket, lo, hi): a bucket is dealt into blocks, and each two of them meet in a group."""
    dealt = rows.join(size, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", *columns)
    return dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def _with_pairs(limit: int):
    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _groups(batches, ["bucket", "lo", "hi"]):
            code, component = _matrix(rows, "code", BITS // 64), rows.column("component").to_pylist()
            has = np.zeros(rows.num_rows, bool)
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                numbers: dict[bytes, int] = {}
                of = np.array([numbers.setdefault(c, len(numbers)) for c in component[lo:hi]])
                for at in range(lo, hi, 64):
                    part = slice(at, min(at + 64, hi))
                    near = np.bitwise_count(code[part, None] ^ code[None, lo:hi]).sum(axis=2, dtype=np.int32) <= limit
                    has[part] |= (near & (of[part.start - lo : part.stop - lo, None] != of[None])).any(axis=1)
            keep = pa.array(has)
            yield pa.RecordBatch.from_arrays([rows.column("bucket").chunk(0).filter(keep), rows.column("node").chunk(0).filter(keep)], ["bucket", "node"])

    return flag


def _compared(limit: int, percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in _groups(batches, ["bucket", "lo", "hi"]):
            code, band = _matrix(rows, "code", BITS // 64), _matrix(rows, "bands", BANDS)
            bucket, own, lo_, hi_ = (rows.column(c).to_numpy() for c in ("bucket", "own", "lo", "hi"))
            node, component = rows.column("node").to_pylist(), rows.column("component").to_pylist()
            lists = rows.column("shingles").chunk(0)
            starts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            sets = [values[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            found = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                numbers: dict[bytes, int] = {}
                of = np.array([numbers.setdefault(c, len(numbers)) for c in component[lo:hi]])
                root = list(range(len(numbers)))

                def find(x: int) -> int:
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                here = np.uint64(int(bucket[lo]) & 0xFFFFFFFFFFFFFFFF)
                for at in range(lo, hi, 64):
                    part = slice(at, min(at + 64, hi))
                    near = np.bitwise_count(code[part, None] ^ code[None, lo:hi]).sum(axis=2, dtype=np.int32) <= limit
                    near &= of[part.start - lo : part.stop - lo, None] < of[None]
                    if lo_[lo] != hi_[lo]:  # two blocks meet: pairs within one are compared where it meets itself
                        near &= own[part, None] != own[None, lo:hi]
                    i, j = np.nonzero(near)
                    i, j = i + at, j + lo
                    equal = band[i] == band[j]
                    first = band[i, equal.argmax(axis=1)] == here
                    for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
                        x, y = find(of[a - lo]), find(of[b - lo])
                        if x == y:
                            continue
                        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                            root[x] = y
                            found.append((a, b))
            yield _pairs(node, found)

    return compare


def forest(code: np.ndarray, component: list[bytes], limit: int) -> list[tuple[int, int]]:
    numbers: dict[bytes, int] = {}
    of = np.array([numbers.setdefault(c, len(numbers)) for c in component])
    if len(numbers) < 2:
        return []
    bits, left, right = [], [], []
    for at in range(0, len(code), 64):
        diff = np.bitwise_count(code[at : at + 64, None] ^ code[None]).sum(axis=2, dtype=np.int32)
        i, j = np.nonzero((diff <= limit) & (of[at : at + 64, None] < of[None]))
        bits.append(diff[i, j])
        left.append(i + at)
        right.append(j)
    bits, left, right = np.concatenate(bits), np.concatenate(left), np.concatenate(right)
    order = np.argsort(bits, kind="stable")
    root = list(range(len(numbers)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out, parts = [], len(numbers)
    for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
        a, b = find(of[i]), find(of[j])
        if a != b:
            root[a] = b
            out.append((i, j))
            parts -= 1
            if parts == 1:
                break
    return out


SIGNED = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
    T.StructField("sketch", T.ArrayType(T.LongType())),
]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sets = [shingles(t, hashes) for t in part.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            minima = samples([sets[i] for i in full])
            where = np.full(len(sets), -1)
            where[full] = np.arange(len(full))
            pick = pa.array(where, mask=where < 0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), longs(bands(minima)).take(pick), longs(odd_sketches(minima)).take(pick)],
                ["_id", "_hash", "n_shingles", "key", "bands", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingles(t, hashes) for t in part.column(1).to_pylist()]
            values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], ["key", "shingles"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document: (id, n_shingles, component_id, kept, class_key).

    component_id is the smallest id reachable over links (similarity of full shingle sets of at least
    `similarity`), a document's own id included; kept marks id = component_id. A null or blank text has an
    empty set, is linked with nothing and is kept. Rows with null ids take part; they are kept only if no
    row of their component has an id. Repeated rows are kept or dropped alike. Other columns are ignored,
    so their names cannot clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_hash", T.LongType()), *SIGNED])
    signed = scratch.keep(rows.select("_id", utf8(F.col("_text")).alias("text"), "_hash").mapInArrow(_signed, schema), "signed")

    # One row stands for each class: that of its smallest id, and of the smallest text hash where rows share that id.
    who = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash")).alias("who")
    classes = signed.where("n_shingles > 0").groupBy("key").agg(who, F.first("bands").alias("bands"), F.first("sketch").alias("code"))
    classes = scratch.keep(classes.select("key", "who._id", "who._hash", "bands", "code"), "classes")
    rest = scratch.keep(signed.select("_id", "n_shingles", "key"), "rest")
    scratch.drop("signed")
    forget(spark)
    banded = classes.select(F.explode("bands").alias("bucket"), "key")
    several = banded.groupBy("bucket").count().where("count > 1").select("bucket")
    shared = banded.join(several, "bucket").join(classes.select("key", "code"), "key").select("bucket", F.col("key").alias("node"), "code")
    shared = scratch.keep(shared, "shared")
    forget(spark)

    # Full sets of one document of each class that shares a bucket, made anew from its text. Rows of one id or of none
    # differ in their text's hash; rows that agree in both are one row repeated, and one of them is enough.
    wanted = classes.join(shared.select(F.col("node").alias("key")).distinct(), "key", "left_semi").select("key", "_id", "_hash")
    texts = rows.join(wanted, rows["_id"].eqNullSafe(wanted["_id"]) & (rows["_hash"] == wanted["_hash"])).select("key", utf8(F.col("_text")).alias("text"))
    if not id_is_unique(rest):
        texts = texts.dropDuplicates(["key"])
    sets = scratch.keep(texts.mapInArrow(_sets, "key binary, shingles array<long>"), "sets")
    forget(spark)

    limit = most_xor_bits(similarity)
    percent = round(similarity * 100)

    def quick(x: Column, y: Column) -> Column:
        bits = F.bit_count(x[0].bitwiseXOR(y[0]))
        for i in range(1, BITS // 64):
            bits = bits + F.bit_count(x[i].bitwiseXOR(y[i]))
        return bits <= limit

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
        common = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("c"))
        return common.where(100 * F.col("c") >= percent * (F.col("nx") + F.col("ny") - F.col("c"))).select("a", "b")

    linked = linked_components(scratch, shared, quick, confirm, "near", Forest(limit), Rest(limit, percent, classes, sets))
    least = classes.select("key", "_id").join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = least.groupBy("component").agg(F.min("_id").alias("component_id"))
    named = scratch.keep(least.join(smallest, "component").select("key", "component_id"), "named")
    scratch.drop_all_but("rest", "named")
    forget(spark)
    out = rest.join(named, "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), (alone | F.col("_id").eqNullSafe(component)).alias("kept"), F.col("key").alias("class_key"))


def id_is_unique(signed: DataFrame) -> bool:
    n, null, some = signed.groupBy("_id").count().agg(F.count(F.when(F.col("count") > 1, 1)), F.count(F.when(F.col("_id").isNull(), 1)), F.count("*")).first()
    return n == 0 and null == 0


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents' own columns, one document of each group: that of the smallest id. Cases as in near_duplicates().

    Several rows may hold a group's smallest id; of those with one text, one stays, whichever it is.
    """
    groups = near_duplicates(docs, id_col, text_col, similarity)
    kept = groups.where("kept").select(F.col(f"`{id_col}`").alias("_id"), "class_key").distinct()
    # The kept rows carry ids alone; a text's class tells rows of one id apart where ids repeat.
    repeated = kept.groupBy("_id").count().where("count > 1").limit(1).count() or docs.groupBy(F.col(f"`{id_col}`")).count().where("count > 1").limit(1).count()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), utf8(F.col(f"`{text_col}`")).alias("utf8"))
    if not repeated:
        return whole.join(kept, whole["id"].eqNullSafe(kept["_id"]), "left_semi").select("row.*")
    keyed = whole.mapInArrow(_with_key, T.StructType([*whole.schema.fields, T.StructField("_key", T.BinaryType())]))
    same = keyed["id"].eqNullSafe(kept["_id"]) & keyed["_key"].eqNullSafe(kept["class_key"])
    rows = keyed.join(kept, same, "left_semi")
    one = rows.where("_key IS NOT NULL").groupBy("id", "_key").agg(F.first("row").alias("row")).select("row.*")
    return one.unionByName(rows.where("_key IS NULL").select("row.*"))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sets = [shingles(t, hashes) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())], ["row", "id", "utf8", "_key"])
