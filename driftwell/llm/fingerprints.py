"""Document fingerprints by a randomised edit embedding.

A walk reads a text with a pointer: each step writes the character under the pointer, and a random bit that
depends on the step and that character, the same for all texts, says whether the pointer moves on. Two texts
that differ by few edits fall into step again after each edit with high probability, so edit distance turns
into Hamming distance between the written sequences. A fingerprint samples places of that sequence.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from driftwell.llm.linking import linked_components
from driftwell.llm.shared import Scratch, utf8
from driftwell.llm.words import mix

#: Sampled places, and the written characters taken at each. A place gives one byte of the fingerprint.
SLOTS, SPAN = 128, 8
#: Independent walks whose samples are banded for links, and samples in a band.
WALKS, BAND = 16, 3
CHUNK_BYTES, CHUNK_ROWS = 12 << 20, 8192
#: Bytes planned for a part, fewest and most parts, and the key samples behind each splitter.
PART_BYTES, LEAST_PARTS, MOST_PARTS, SAMPLES_PER_PART = 32 << 20, 64, 16_384, 64
LAST = np.iinfo(np.int64).max
_STEPS = 4096


def _walk_bits(walk: int) -> np.ndarray:
    bits = np.random.default_rng(7 + walk).integers(0, 2, (_STEPS, 256), dtype=np.int64)
    bits[:, 0] = 0  # class 0 is the end of a text: the pointer stays
    return bits


def _records() -> list[np.ndarray]:
    """For each slot the places at which a random order of all places has a new minimum. A text of n steps takes the
    last one below n: the place of least order among its own, so texts of nearly equal length take the same places."""
    rng, out = np.random.default_rng(11), []
    for _ in range(SLOTS):
        r = [0]
        while r[-1] < 1 << 44:
            r.append(max(r[-1] + 1, int((r[-1] + 1) / max(rng.random(), 1e-6))))
        out.append(np.array(r))
    return out


def steps(n: int) -> int:
    """Steps that take the pointer over n characters but for a chance of some thousandths: 2 n, and 2.8 deviations."""
    return 2 * n + 4 * math.isqrt(n) + (n > 0)


class Embedding:
    def __init__(self, walk: int = 0) -> None:
        self.bits, self.records = _walk_bits(walk), _records()
        self.rows = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(_STEPS)).astype(np.int64)

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """SLOTS bytes for each text; equal texts have equal ones. All texts walk in step."""
        n = np.array(list(map(len, texts)), np.int64)
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        classes = ((codes * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8)
        np.maximum(classes, 1, out=classes)
        starts = np.cumsum(n + 1) - (n + 1)
        classes[starts + n] = 0
        length = np.array([steps(x) for x in n.tolist()], np.int64)
        by = np.argsort(-length, kind="stable")
        ptr, base = starts[by].copy(), np.cumsum(length) - length
        walks = -length[by]
        to = base[by].copy()
        written = np.zeros(int(length.sum()) + SPAN, np.uint8)
        k, j, top = len(texts), 0, int(length.max(initial=0))
        while j < top:
            k = int(np.searchsorted(walks, -j, "left"))
            # Until the shortest active text ends, the same k texts walk.
            for j in range(j, int(-walks[k - 1])):
                c = classes[ptr[:k]]
                written[to[:k] + j] = c
                ptr[:k] += self.bits[self.rows[j & 0xFFFF]][c]
            j += 1
        out = np.zeros((len(texts), SLOTS), np.uint8)
        some = np.flatnonzero(length > 0)
        for s, r in enumerate(self.records):
            place = r[np.searchsorted(r, length[some], "left") - 1]
            at = base[some] + place
            left = length[some] - place
            h = mix(place.astype(np.uint64) + np.uint64(s << 48))
            for i in range(SPAN):
                h = mix(h + np.where(left > i, written[at + i], 0).astype(np.uint64))
            out[some, s] = h >> np.uint64(56)
        return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal bytes, less what chance gives."""
    return np.clip(((x == y).mean(axis=1) - 1 / 256) * 256 / 255, 0, 1)


_embeddings: dict[int, Embedding] = {}


def embedding(walk: int = 0) -> Embedding:
    if walk not in _embeddings:
        _embeddings[walk] = Embedding(walk)
    return _embeddings[walk]


def fingerprints(docs: DataFrame, text_col: str = "text", walks: int = 1) -> DataFrame:
    """(row, fingerprint): the document's columns as a struct, and its fingerprints of all walks in hex, in one string.

    Null reads as empty; an empty text has the fingerprint of all zeros. Texts are read whole. The documents' columns
    stay inside `row`, so no name can clash. An empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                texts = [(t or b"").decode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                marks = np.concatenate([embedding(w).fingerprints(texts) for w in range(walks)], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.tobytes().hex() for m in marks], pa.string())], ["row", "fingerprint"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), utf8(F.col(f"`{text_col}`")).alias("utf8"))
    return rows.mapInArrow(scan, T.StructType([rows.schema["row"], T.StructField("fingerprint", T.StringType())]))


COMPARED = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part and order, each part with a copy of the next part's first document at its end."""
    ids: list[int | None] = []
    texts: list[str] = []
    held = 0

    def done(following: str) -> pa.RecordBatch:
        nexts = [*texts[1:], following]
        edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(texts, nexts, strict=True)]
        marks = embedding().fingerprints([*texts, following, *edited])
        n = len(texts)
        own, after, other = marks[:n], marks[1 : n + 1], marks[n + 1 :]
        cols = [
            pa.array(ids, pa.int64()),
            pa.array(list(map(len, texts)), pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
            pa.array([m.tobytes().hex() for m in own], pa.string()),
            pa.array([m.tobytes().hex() for m in other], pa.string()),
            pa.array(likeness(own, other)),
            pa.array(likeness(own, after)),
        ]
        return pa.RecordBatch.from_arrays(cols, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for tail, i, t in zip(batch.column("tail").to_pylist(), batch.column("id").to_pylist(), batch.column("utf8").to_pylist(), strict=True):
            text = (t or b"").decode("utf-8", "surrogatepass")
            if texts and (tail or held >= CHUNK_BYTES or len(texts) >= CHUNK_ROWS):
                yield done(text)
                ids, texts, held = [], [], 0
            if not tail:
                ids.append(i)
                texts.append(text)
                held += len(t or b"")


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).

    In the edited text the last floor(n_chars / 2) code points give way to the first as many (or all) of the next
    document in ascending id order; after the last comes the first. Null texts are empty; null ids come last; rows of
    equal ids, and those without one, are ordered by text. Other columns are ignored, so their names cannot clash. An
    empty table gives no rows. Each text moves once, to the part of its id range; the first of a part also goes to the part before.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), utf8(F.col(f"`{text_col}`")).alias("utf8"))
    # The first seven bytes as a number keep the order of texts: rows of one id, or of none, may fill several parts.
    prefix = F.conv(F.rpad(F.hex(F.substring(F.coalesce("utf8", F.lit(b"")), 1, 7)), 14, "0"), 16, 10).cast("long")
    rows = rows.select("id", "utf8", F.coalesce("id", F.lit(LAST)).alias("k"), prefix.alias("h"), (F.coalesce(F.octet_length("utf8"), F.lit(0)) + 1).alias("size"))
    size = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = min(max(size // PART_BYTES, LEAST_PARTS), MOST_PARTS)
    # Splitters of equal bytes: a row is drawn with a probability that goes with its size.
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("part"), "k", "h"), 11) / F.lit(float(1 << 53))
    drawn = sorted((r[0], r[1]) for r in rows.select("k", "h", "size").where(draw * size < F.col("size") * float(parts * SAMPLES_PER_PART)).select("k", "h").collect())
    splitters = np.array(sorted({drawn[i * len(drawn) // parts] for i in range(1, parts)}) if drawn else [], np.int64).reshape(-1, 2)

    @pandas_udf("int")
    def home(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(_homes(splitters, k.to_numpy(), h.to_numpy()).astype(np.int32))

    firsts = sorted((r["part"], r["first"]["k"], r["first"]["h"]) for r in rows.select(home("k", "h").alias("part"), "k", "h").groupBy("part").agg(F.min(F.struct("k", "h")).alias("first")).collect())
    heads = np.array([(k, h, firsts[i - 1][0]) for i, (_, k, h) in enumerate(firsts)], np.int64).reshape(-1, 3)  # the first of all follows the last part

    @pandas_udf("array<int>")
    def homes(k: pd.Series, h: pd.Series) -> pd.Series:
        """The part of a row, and that before where the row is the first of its part."""
        ks, hs = k.to_numpy(), h.to_numpy()
        own = _homes(splitters, ks, hs)
        at = np.minimum(np.searchsorted(heads[:, 0], ks), len(heads) - 1)
        out = own[:, None].tolist()
        for i in np.flatnonzero(np.isin(ks, heads[:, 0])).tolist():
            for head in heads[at[i] :]:
                if head[0] != ks[i]:
                    break
                if head[1] == hs[i]:
                    out[i].append(int(head[2]))
        return pd.Series(out)

    dealt = rows.select("id", "k", "h", "utf8", F.posexplode(homes("k", "h")).alias("tail", "part")).withColumn("tail", F.col("tail") > 0)
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "tail", "k", "h", "utf8")
    return dealt.select("tail", "id", "utf8").mapInArrow(_compare, COMPARED).withColumnRenamed("id", id_col)


def _homes(splitters: np.ndarray, k: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each (k, h) how many splitters, sorted pairs, are no larger. Only a k that has several splitters needs h."""
    lo, hi = np.searchsorted(splitters[:, 0], k), np.searchsorted(splitters[:, 0], k, "right")
    out = lo.copy()
    for a in np.unique(lo[hi > lo]).tolist():
        here = (lo == a) & (hi > lo)
        b = int(hi[here][0])
        out[here] += np.searchsorted(splitters[a:b, 1], h[here], "right")
    return out


def edit_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_edits: float = 0.1, band: int = BAND, walks: int = WALKS) -> DataFrame:
    """(id, component_id): texts linked where their edit distance is at most `most_edits` of the longer length.

    Bit-sampled banding: `band` bytes of a walk's fingerprint make a bucket key. One walk may lose step at an edit for
    long, and then no band of it is shared, so there are several independent walks. All candidates are verified by edit
    distance. The README gives how many pairs are missed, by edit rate. Equal texts are one
    node; null and empty texts stay alone. component_id is the smallest id of the component; null ids count last.
    """
    scratch = Scratch(docs.sparkSession, "edits")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    keyed = rows.withColumn("node", F.when(F.length("text") > 0, F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    texts = scratch.keep(fingerprints(keyed.where("node IS NOT NULL").dropDuplicates(["node"]).select("node", "text"), walks=walks).select("row.*", "fingerprint"), "texts")
    starts = [(w, i) for w in range(walks) for i in range(SLOTS // band)]
    keys = F.array(*(F.xxhash64(F.lit(w), F.lit(i), F.substring("fingerprint", 2 * (SLOTS * w + band * i) + 1, 2 * band)) for w, i in starts))
    banded = texts.select(F.explode(keys).alias("bucket"), "node", F.lit(0).alias("code"))
    shared = scratch.keep(banded.join(banded.groupBy("bucket").count().where("count > 1").select("bucket"), "bucket"), "shared")

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        longest = F.greatest(F.length("x"), F.length("y"))
        return both.where(F.levenshtein("x", "y") <= longest * most_edits).select("a", "b")

    linked = linked_components(scratch, shared, lambda x, y: F.lit(True), confirm, "edits")
    named = keyed.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least"))
    return named.join(least, "component", "left").select(F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
