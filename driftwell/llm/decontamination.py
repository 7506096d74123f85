"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every training window."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.llm.shared import Scratch, utf8
from driftwell.llm.words import ALNUM, WordHashes, alnum_words, windows

N = 10
#: Benchmark text that one broadcast may hold. Its set takes some six times as much: a hash, an item and a place for each
#: word, and the words. A larger benchmark is cut into parts of this size, each with a pass of its own over the documents.
PART_BYTES = 16 << 20
_WORD = re.compile(rb"[^ ]+")
_FILTER_BITS = 20


@dataclass
class NgramSet:
    """Windows of the items as sorted arrays: for each size of window the hashes in order and the word that each starts
    with; and the words of all items end to end, to verify a hit against."""

    windows: dict[int, tuple[np.ndarray, np.ndarray]]
    words: bytes
    starts: np.ndarray  # of each word in `words`, and the end; words are parted by one blank
    firsts: np.ndarray  # number of each item's first word
    ids: list[str]
    maps: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[str, bytes | None]], n: int = N) -> NgramSet:
        """An item of n words or more gives all its windows; a shorter one, but for an empty one, is a window."""
        hashes, found, texts, lengths, firsts, ids = WordHashes(), {}, [], [], [], []
        at = 0
        for item_id, text in items:
            if not (w := alnum_words(text or b"")):
                continue
            size = min(n, len(w))
            h = windows(hashes.of(w), size)
            found.setdefault(size, []).append((h, at + np.arange(len(h))))
            texts.append(b" ".join(w))
            lengths.append(np.fromiter(map(len, w), np.int64, len(w)) + 1)
            firsts.append(at)
            ids.append(item_id)
            at += len(w)
        sets = {}
        for size, parts in found.items():
            h, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            sets[size] = h[order], place[order].astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths or [np.empty(0, np.int64)]))])
        return cls(sets, b" ".join(texts), starts.astype(np.uint32), np.array(firsts, np.uint32), ids)

    def n_bytes(self) -> int:
        return len(self.words) + self.starts.nbytes + sum(h.nbytes + place.nbytes for h, place in self.windows.values())

    def near(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions whose window hash is in the set, by a small bitmap and then a binary search; and from where to where
        it lies there."""
        known, shift = self.windows[size][0], np.uint64(64 - _FILTER_BITS)
        if size not in self.maps:
            self.maps[size] = np.zeros(1 << _FILTER_BITS, bool)
            self.maps[size][known >> shift] = True
        maybe = np.flatnonzero(self.maps[size][h >> shift])
        lo = np.searchsorted(known, h[maybe])
        here = known[np.minimum(lo, len(known) - 1)] == h[maybe]
        maybe, lo = maybe[here], lo[here]
        return maybe, lo, np.searchsorted(known, h[maybe], "right")

    def hits(self, docs: list[list[bytes]], hashes: WordHashes) -> list[tuple[set[tuple[int, int]], set[int]]]:
        """For each document its hit windows as (start, end) and the items they come from, verified word by word."""
        out = [(set(), set()) for _ in docs]
        flat = hashes.of([w for d in docs for w in d])
        starts = np.cumsum([0, *map(len, docs)])
        for size, (_, place) in self.windows.items():
            h = windows(flat, size)
            if not len(h):
                continue
            at, lo, hi = self.near(h, size)
            owner = np.searchsorted(starts, at, "right") - 1
            for p, d, a, b in zip(at.tolist(), owner.tolist(), lo.tolist(), hi.tolist(), strict=True):
                i = p - int(starts[d])
                seen = docs[d][i : i + size]
                if len(seen) < size:
                    continue  # it goes on into the next document
                seen = b" ".join(seen)
                for w in place[a:b].tolist():
                    if seen == self.words[self.starts[w] : self.starts[w + size] - 1]:
                        out[d][0].add((i, i + size))
                        out[d][1].add(int(np.searchsorted(self.firsts, w, "right")) - 1)
        return out


def merged(spans: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text.translate(ALNUM))]
    keep, last = [], 0
    for lo, hi in spans:
        keep.append(text[last : at[lo][0]])
        last = at[hi - 1][1]
    return b"".join([*keep, text[last:]])


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _scan(shared, more: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, hashes = shared.value, WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                docs = [alnum_words(t) if t else [] for t in part.column(1).to_pylist()]
                hits = grams.hits(docs, hashes)
                spans, items = [s for s, _ in hits], [{grams.ids[i] for i in x} for _, x in hits]
                if more:
                    spans = [s | {(x["start"], x["end"]) for x in old} for s, old in zip(spans, part.column(3).to_pylist(), strict=True)]
                    items = [s | set(old) for s, old in zip(items, part.column(4).to_pylist(), strict=True)]
                cols = [pa.array(list(map(len, docs)), pa.int64()), pa.array([[{"start": a, "end": b} for a, b in merged(s)] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["row", "utf8", "n_words", "spans", "items"])

    return scan


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, part_bytes: int = PART_BYTES) -> DataFrame:
    """(row, utf8, n_words, spans, items): each document's columns as a struct, its bytes, and what was hit.

    spans are maximal runs of hit words, as [start, end) word numbers; items the ids, as strings, of items with a
    window in the document. Null or empty texts have no words and no hits; items without words are ignored, and a
    null item id reads as an empty string. Equal items and equal documents are each reported. The documents'
    own columns stay inside `row`, so no name can clash.

    The hash set is broadcast, as sorted arrays of some six times the text's bytes. The benchmark's bytes are summed
    first: beyond `part_bytes` the items are dealt into parts, and each part is a pass over the documents, so one
    broadcast never grows with the benchmark (only with its longest item, which is not cut).
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("id"), utf8(F.col(f"`{item_text_col}`")).alias("utf8"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("utf8")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    cur = docs.select(whole.alias("row"), utf8(F.col(f"`{text_col}`")).alias("utf8"))
    schema = T.StructType([*cur.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    scratch = Scratch(spark, "decontamination")
    for p in range(parts):
        here = items.where(F.pmod(F.xxhash64("id", "utf8"), F.lit(parts)) == p) if parts > 1 else items
        grams = NgramSet.of([(r["id"], r["utf8"]) for r in here.toLocalIterator()], n)
        cur = cur.mapInArrow(_scan(spark.sparkContext.broadcast(grams), p > 0), schema)
        if p + 1 < parts:
            cur = scratch.keep(cur, f"part{p}")
    return cur


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents", **settings) -> DataFrame:
    """The documents' own columns without contaminated documents, or ("spans") without the hit passages.

    Cases are as in benchmark_hits: documents without words are clean and stay.
    """
    hits = benchmark_hits(docs, benchmark, text_col, **settings)
    if remove == "documents":
        return hits.where(F.size("spans") == 0).select("row.*")
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["row", "utf8"])

    rest = hits.select("row", "utf8", "spans")
    out = rest.mapInArrow(cleaned, T.StructType(rest.schema.fields[:2]))
    return out.select(*(F.col("utf8").cast("string").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
