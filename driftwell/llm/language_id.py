"""Language identification by prediction by partial matching (PPM) over bytes, with frozen statistics.

Each language has a context tree of byte contexts up to three bytes. A symbol that its longest context has
not seen costs that context's escape and is tried in the next shorter one, down to a uniform byte. The code
length of a whole text under each language's tree decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.llm.shared import utf8

UNKNOWN = "und"
#: Text learned from for one language, in bytes, and the longest document used for it. The sample is drawn by a hash of
#: id and text from all labelled rows, at a rate found from the language's total, so it doesn't grow with the table.
LEARN_BYTES, LONGEST = 2 << 20, 1 << 20
_START = b"\n\n\n"
_SLOT_BITS = 22
_HASH = np.uint32(0x9E3779B1)
_SLICE = 1 << 20


def _grams(flat: np.ndarray) -> np.ndarray:
    """The four bytes that end at each position from the fourth on; the last one is the top byte."""
    return np.ndarray((max(len(flat) - 3, 0),), "<u4", flat.tobytes(), strides=(1,)).copy() if len(flat) > 3 else np.empty(0, np.uint32)


@dataclass
class ContextTrees:
    """Code lengths in bits, by language, of every symbol in every context that some language has seen.

    A table holds one row for a gram (context and symbol) or context known to any language and one column for each
    language. Order 1 and shorter are held densely. slots finds a 4-gram's row without a search.
    """

    languages: list[str]
    grams: np.ndarray
    cost4: np.ndarray
    slots: np.ndarray
    contexts: np.ndarray
    escape4: np.ndarray
    grams3: np.ndarray
    cost3: np.ndarray
    escape3: np.ndarray
    cost2: np.ndarray

    @classmethod
    def learn(cls, texts: dict[str, list[bytes]]) -> ContextTrees:
        languages = sorted(texts)
        flat = {k: _grams(np.frombuffer(b"".join(_START + t for t in texts[k]), np.uint8)) for k in languages}
        # Grams that reach over a document's start end in padding; drop those whose last byte is padding of the next.
        counted = []
        for k in languages:
            keep = np.concatenate([np.arange(a, b) for a, b in _spans(texts[k])]) if texts[k] else np.empty(0, np.int64)
            g = flat[k][keep]
            counted.append([np.unique(g >> np.uint32(8 * (3 - order)), return_counts=True) for order in range(4)])
        n = len(languages)

        cost1 = np.empty((256, n), np.float32)
        cost2 = np.empty((65536, n), np.float32)
        dense2 = np.arange(65536, dtype=np.uint32)
        escape3 = np.zeros((65536, n), np.float32)
        grams3 = np.unique(np.concatenate([c[2][0] for c in counted])) if n else np.empty(0, np.uint32)
        grams4 = np.unique(np.concatenate([c[3][0] for c in counted])) if n else np.empty(0, np.uint32)
        contexts = np.unique(grams4 & np.uint32(0xFFFFFF))
        cost3, cost4 = np.empty((len(grams3), n), np.float32), np.empty((len(grams4), n), np.float32)
        escape4 = np.zeros((len(contexts), n), np.float32)
        for i, c in enumerate(counted):
            cost1[:, i] = _level(np.arange(256, dtype=np.uint32), c[0], 0, np.full(256, 8.0), None)
            cost2[:, i] = _level(dense2, c[1], 8, cost1[dense2 >> 8, i], None)
            cost3[:, i] = _level(grams3, c[2], 16, cost2[grams3 >> 8, i], escape3[:, i])
            at = np.searchsorted(grams3, grams4 >> np.uint32(8))
            cost4[:, i] = _level(grams4, c[3], 24, cost3[at, i], None)
            ctx, bits = _escapes(c[3], 24)
            escape4[np.searchsorted(contexts, ctx), i] = bits
        slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        slots[_slot(grams4)] = np.arange(len(grams4), dtype=np.int32)
        return cls(languages, grams4, cost4, slots, contexts, escape4, grams3, cost3, escape3, cost2)

    def bits(self, g: np.ndarray) -> np.ndarray:
        """Bits of each 4-gram's last byte after its first three, one column for each language."""
        if not len(self.grams):
            return np.zeros((len(g), len(self.languages)), np.float32)
        row = self.slots[_slot(g)]
        miss = np.flatnonzero(self.grams[row] != g)
        out = self.cost4[row]
        if len(miss):
            m = g[miss]
            at = np.minimum(np.searchsorted(self.grams, m), len(self.grams) - 1)
            seen = self.grams[at] == m
            out[miss[seen]] = self.cost4[at[seen]]
            out[miss[~seen]] = self._shorter(m[~seen])
        return out

    def _shorter(self, g: np.ndarray) -> np.ndarray:
        """For grams that no language has seen whole."""
        ctx, g3 = g & np.uint32(0xFFFFFF), g >> np.uint32(8)
        at = np.minimum(np.searchsorted(self.contexts, ctx), len(self.contexts) - 1)
        out = np.where((self.contexts[at] == ctx)[:, None], self.escape4[at], np.float32(0))
        at = np.minimum(np.searchsorted(self.grams3, g3), len(self.grams3) - 1)
        below = self.escape3[g3 & np.uint32(0xFFFF)] + self.cost2[g3 >> np.uint32(8)]
        return out + np.where((self.grams3[at] == g3)[:, None], self.cost3[at], below)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each whole text under each language: one row for each text."""
        out = np.zeros((len(texts), len(self.languages)))
        flat = np.frombuffer(b"".join(_START + t for t in texts), np.uint8)
        owner_ends = np.cumsum([len(t) + 3 for t in texts]) - 3  # where each text's grams end
        spans = _spans(texts)
        for lo in range(0, len(flat) - 3, _SLICE):
            piece = self.bits(_grams(flat[lo : lo + _SLICE + 3]))
            hi = lo + len(piece)
            first = int(np.searchsorted(owner_ends, lo, "right"))
            for d in range(first, len(texts)):
                a, b = max(spans[d][0], lo), min(spans[d][1], hi)
                if spans[d][0] >= hi:
                    break
                if a < b:
                    out[d] += piece[a - lo : b - lo].sum(axis=0, dtype=np.float64)
        return out


def _spans(texts: list[bytes]) -> list[tuple[int, int]]:
    """Where each text's grams lie among those of the padded, joined texts."""
    at, out = 0, []
    for t in texts:
        out.append((at, at + len(t)))
        at += len(t) + 3
    return out


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * _HASH) >> np.uint32(32 - _SLOT_BITS)


def _escapes(counted: tuple[np.ndarray, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of the grams and the cost of an escape from each: distinct / (count + distinct)."""
    ctx, where = np.unique(counted[0] & np.uint32((1 << bits) - 1), return_inverse=True)
    n, d = np.bincount(where, counted[1], len(ctx)), np.bincount(where, minlength=len(ctx))
    return ctx, -np.log2(d / (n + d))


def _level(grams: np.ndarray, counted: tuple[np.ndarray, np.ndarray], bits: int, shorter: np.ndarray, escapes: np.ndarray | None) -> np.ndarray:
    """Cost of each gram's last byte: its share in the context, or else the context's escape and the shorter cost."""
    seen, counts = counted
    out = shorter.astype(np.float64)
    if not len(seen):
        return out
    mask = np.uint32((1 << bits) - 1)
    ctx, esc = _escapes(counted, bits)
    at = np.minimum(np.searchsorted(ctx, grams & mask), len(ctx) - 1)
    out += np.where(ctx[at] == (grams & mask), esc[at], 0)
    where = np.searchsorted(ctx, seen & mask)
    n, d = np.bincount(where, counts, len(ctx)), np.bincount(where, minlength=len(ctx))
    place = np.minimum(np.searchsorted(seen, grams), len(seen) - 1)
    known = seen[place] == grams
    share = -np.log2(counts / (n + d)[where])
    out[known] = share[place[known]]
    if escapes is not None:
        escapes[ctx] = esc
    return out


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text[:64].decode("utf-8", "ignore"))) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", learn_bytes: int = LEARN_BYTES) -> ContextTrees:
    """Trees from a bounded hash sample of the labelled rows, texts of up to LONGEST bytes.

    Null and empty texts and null labels are not learned from; without any row to learn from the trees know no
    language. Repeated rows are drawn together; null ids take part. Other columns are ignored.
    """
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), utf8(F.col(f"`{text_col}`")).alias("utf8"), F.col(f"`{id_col}`").alias("id")).where("lang IS NOT NULL AND octet_length(utf8) BETWEEN 1 AND " + str(LONGEST))
    totals = rows.groupBy("lang").agg(F.sum(F.octet_length("utf8")).alias("bytes")).collect()
    rate = F.lit(0.0)
    for r in totals:
        rate = F.when(F.col("lang") == r["lang"], min(1.0, learn_bytes / r["bytes"])).otherwise(rate)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("learn"), "id", "utf8"), 11) / F.lit(float(1 << 53))
    texts: dict[str, list[bytes]] = {}
    for r in rows.where(draw < rate).select("lang", "utf8").toLocalIterator():
        texts.setdefault(r["lang"], []).append(bytes(r["utf8"]))
    return ContextTrees.learn(texts)


def identify(docs: DataFrame, trees: ContextTrees, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score, bits): the document's columns as a struct, the language of the shortest code, its
    posterior probability under equal priors, and the code lengths by language in the order of trees.languages.

    A null text, one without any letter (so also an empty one), or trees of no language give "und" and score 0.
    Ties go to the first language by name. Texts are read whole. The documents' columns stay inside `row`, so no
    name can clash. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                bits = model.score(texts)
                langs, scores = [], []
                for t, b in zip(texts, bits, strict=True):
                    if not model.languages or not has_letter(t):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(b.argmin())
                    langs.append(model.languages[best])
                    scores.append(float(1 / np.exp2(np.maximum(b[best] - b, -1000)).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits.tolist(), pa.list_(pa.float64()))], ["row", "lang_pred", "score", "bits"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), utf8(F.col(f"`{text_col}`")).alias("utf8"))
    return rows.mapInArrow(scan, T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.ArrayType(T.DoubleType()))]))


def keep_identified(docs: DataFrame, trees: ContextTrees, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The documents with a language; those without letters (null and empty texts too), or undecided between languages,
    go. Repeated rows stay or go alike; columns and their names are the documents' own; an empty table gives no rows."""
    return identify(docs, trees, text_col).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
