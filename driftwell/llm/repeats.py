"""Exact repeated passages through an enhanced suffix array, cut into buckets that each fit a task.

A suffix array of the whole corpus can't be sorted in one place. So suffixes are sorted from anchors only:
the smallest hashed 24-byte gram of each 50-byte window (equal windows have equal anchors, at equal offsets).
Anchors whose gram turns up in one document only are dropped first. The others, with the bytes around them,
are dealt by gram, and each bucket is sorted by the bytes from the anchor on, with common-prefix lengths. A
stack scan walks the tree of common-prefix intervals; within an interval, a second scan over the bytes to
the left of the anchor splits the members where their left extensions differ. What is left on both sides
undivided is a maximal repeat around the anchor, with all its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.shared import Scratch, forget, utf8
from driftwell.llm.words import C1, C2, C3, mix

#: Bytes of a repeat, and of the gram that anchors it.
LENGTH, GRAM = 50, 24
LEFT = LENGTH - GRAM
WIDTH = LEFT + LENGTH
BLOCK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 2 << 20, 8 << 20, 64
#: A gram that more blocks hold is dealt by more bytes: contexts go by the first FAR bytes from the anchor, and once more
#: by the NEAR bytes before it and the gram. LENGTH bytes around the anchor have FAR after its start or NEAR before it, so
#: all that share them meet in one of the two.
HOT_BLOCKS, FAR = 4096, 37
NEAR = LENGTH - FAR + 1
NO_ID = np.iinfo(np.int64).max
_SLICE_BITS = 20


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(blob: bytes, n: int, *kinds: tuple[str, int]) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind, width in kinds:
        size = np.dtype(kind).itemsize * n * width
        out.append(np.frombuffer(raw[at : at + size], kind).reshape((n, width) if width > 1 else n))
        at += size
    return out


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, one at a time, since each may be large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


class Block:
    """Whole documents joined end to end."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, data: bytes):
        self.ids, self.lengths = ids, lengths
        self.text = np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors of all windows that lie in one document, in order, and their gram hashes."""
        text, n = self.text, len(self.text)
        found = []
        # Windows that start in [lo, lo + step) need bytes up to LENGTH - 1 further on.
        step = (1 << _SLICE_BITS) - 2 * LENGTH
        for lo in range(0, max(n - LENGTH + 1, 0), step):
            part = text[lo : lo + step + LENGTH]
            h = _gram_hashes(part)
            low = np.uint64((1 << _SLICE_BITS) - 1)
            best = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), LEFT + 1)
            best = best[: min(step, n - LENGTH + 1 - lo)]
            start = np.arange(lo, lo + len(best))
            whole = start + LENGTH <= self.ends[np.searchsorted(self.ends, start, "right")]
            at = np.unique((best & low).astype(np.int64)[whole])
            found.append((at + lo, h[at]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        pos, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
        # Anchors are minima, so their hashes crowd at the low end: mixed once more, they fill all buckets alike.
        return pos, mix(np.concatenate([h for _, h in found])[first])

    def owner(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, pos, "right")

    def contexts(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor: LEFT bytes before it and LENGTH from it on (zeros beyond its document), how many of
        either are the document's, and the document's number."""
        doc = self.owner(pos)
        left = np.minimum(pos - self.starts[doc], LEFT)
        right = np.minimum(self.ends[doc] - pos, LENGTH)
        around, out = np.arange(-LEFT, LENGTH), np.empty((len(pos), WIDTH), np.uint8)
        for at in range(0, len(pos), 8192):  # the index of all at once would take many times the bytes it fetches
            part = slice(at, at + 8192)
            out[part] = self.text[np.clip(pos[part, None] + around, 0, len(self.text) - 1)]
            out[part][(around < -left[part, None]) | (around >= right[part, None])] = 0
        return out, left.astype(np.uint8), right.astype(np.uint8), doc


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    n = len(text) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
    h = words[:n] * C1
    for k, c in ((8, C2), (16, C3)):
        h = ((h ^ (h >> np.uint64(32))) + words[k : k + n]) * c
    h ^= h >> np.uint64(29)
    h *= C1
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def _row_hashes(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each row of bytes, and the rows as 64-bit words."""
    width = sum(c.shape[1] for c in columns)
    wide, at = np.zeros((len(columns[0]), -(-width // 8) * 8), np.uint8), 0
    for c in columns:
        wide[:, at : at + c.shape[1]] = c
        at += c.shape[1]
    words = wide.view("<u8")
    h = np.zeros(len(wide), np.uint64)
    for i in range(words.shape[1]):
        h = ((h ^ (h >> np.uint64(32))) + words[:, i]) * C2
    return h, words


def _grouped(ctx: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal contexts together: (order, where groups start in it, group of each place in it)."""
    h, words = _row_hashes(ctx, left[:, None], right[:, None])
    order = np.argsort(h, kind="stable")
    new = np.ones(len(ctx), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    texts: list[bytes] = []
    held, made, part = 0, 0, TaskContext.get().partitionId()

    def block() -> pa.RecordBatch:
        lengths = np.array(list(map(len, texts)), np.int64)
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        return pa.RecordBatch.from_arrays([pa.array([(part << 24) + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths.tobytes()], pa.binary()), pa.array([data], pa.binary())], ["block", "ids", "lengths", "data"])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or b"")
            held += len(texts[-1])
            if held >= BLOCK_BYTES:
                yield block()
                ids, texts, held, made = [], [], 0, made + 1
    if ids:
        yield block()


def _open(ids: list[int | None], lengths: bytes, data: bytes) -> Block:
    known = np.array([NO_ID if i is None else i for i in ids], np.int64)
    return Block(known, np.frombuffer(lengths, np.int64), zstandard.ZstdDecompressor().decompress(data))


def _send_grams(bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _one_by_one(batch):
                block = _open(r["ids"], r["lengths"], r["data"])
                pos, h = block.anchors()
                grams, several = _distinct(block, pos, h)
                edges = np.searchsorted(_buckets(grams, bits), np.arange((1 << bits) + 1))
                rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if lo < hi]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in rows], pa.int32()), pa.array([r["block"]] * len(rows), pa.int64()), pa.array([grams[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()), pa.array([np.packbits(several[lo:hi]).tobytes() for _, lo, hi in rows], pa.binary())],
                    ["bucket", "block", "grams", "several"],
                )

    return send


def _distinct(block: Block, pos: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams, and whether documents of different ids in this block hold them."""
    order = np.argsort(h, kind="stable")
    ids = block.ids[block.owner(pos[order])]
    grams, first = np.unique(h[order], return_index=True)
    if not len(grams):
        return grams, np.empty(0, bool)
    return grams, np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first)


def _find_shared(hot_blocks: int):
    """Of the grams that blocks sent to a bucket, the ones in several documents, and the hot ones: as bits in the order
    sent."""

    def find(group: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(s)).astype(bool) for x, s in zip(group.column("several").to_pylist(), sent, strict=True)]
        grams, where, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        shared = count > 1
        shared |= np.bincount(where, np.concatenate(bits), len(grams)) > 0
        hot = shared & (count > hot_blocks)
        answers, at = [], 0
        for s in sent:
            mine = where[at : at + len(s)]
            answers.append((np.packbits(shared[mine]).tobytes(), np.packbits(hot[mine]).tobytes()))
            at += len(s)
        columns = [pa.array(x, pa.binary()) for x in zip(*answers, strict=True)]
        return pa.table([group.column("block"), group.column("bucket"), *columns, pa.array(list(map(len, sent)), pa.int32())], names=["block", "bucket", "shared", "hot", "n"])

    return find


def _send_contexts(bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _one_by_one(batch):
                block = _open(r["ids"], r["lengths"], r["data"])
                pos, h = block.anchors()
                answers = sorted(r["answers"], key=lambda a: a["bucket"])
                shared, hot = (np.concatenate([np.unpackbits(np.frombuffer(a[c], np.uint8), count=a["n"]).astype(bool) for a in answers] or [np.empty(0, bool)]) for c in ("shared", "hot"))
                grams = np.unique(h)
                grams, hot = grams[shared], grams[hot]
                pick = np.isin(h, grams)
                pos, h = pos[pick], h[pick]
                if not len(pos):
                    continue
                ctx, left, right, doc = block.contexts(pos)
                order, first, _ = _grouped(ctx, left, right)
                ids = block.ids[doc[order]]
                low, high = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
                rep = order[first]
                at = np.argsort(rep)  # neighbours in the text have like ids and positions, which pack well
                rep, low, high = rep[at], low[at], high[at]
                bucket = _buckets(h[rep], bits)
                if len(hot) and (is_hot := np.isin(h[rep], hot)).any():
                    around = ctx[rep[is_hot]]
                    after, before = (_buckets(mix(_row_hashes(around[:, part])[0]), bits) for part in (slice(LEFT, LEFT + FAR), slice(LEFT - NEAR, LEFT + GRAM)))
                    rep, low, high = (np.concatenate([x[~is_hot], x[is_hot], x[is_hot]]) for x in (rep, low, high))
                    bucket = np.concatenate([bucket[~is_hot], after, before])
                by = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[by], np.arange((1 << bits) + 1))
                rows = [(b, by[lo:hi]) for b, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if lo < hi]
                blobs = [_pack(ctx[rep[k]], left[rep[k]], right[rep[k]], low[k], high[k], pos[rep[k]].astype(np.int32)) for _, k in rows]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([r["block"]] * len(rows), pa.int64()), pa.array([len(k) for _, k in rows], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "block", "n", "contexts"])

    return send


def _lcp(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common-prefix lengths of neighbouring rows, no longer than either's own length."""
    if len(rows) < 2:
        return np.empty(0, np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(lengths[1:], lengths[:-1]).astype(np.int64))


def _sorted_by(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order by bytes, a shorter row before its extensions."""
    width = rows.shape[1]
    key = np.ascontiguousarray(np.concatenate([rows + np.uint8(0), lengths[:, None]], axis=1)).view(f"V{width + 1}").ravel()
    return np.argsort(key, kind="stable")


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every common-prefix interval of len(lcp) + 1 sorted suffixes, by one stack scan."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


class Bucket:
    """The enhanced suffix array of one bucket's anchors: right contexts in order, with common prefixes, and for the
    same anchors the order and common lengths of their left contexts, read backwards."""

    def __init__(self, ctx: np.ndarray, left: np.ndarray, right: np.ndarray):
        sa = _sorted_by(ctx[:, LEFT:], right)
        self.sa, self.left, self.right = sa, left[sa].astype(np.int64), right[sa].astype(np.int64)
        self.lcp = _lcp(ctx[sa, LEFT:], right[sa])
        self.back = ctx[sa, LEFT - 1 :: -1] if LEFT else ctx[sa, :0]
        # Anchors of one gram are an interval of depth GRAM or more.
        self.bounds = np.flatnonzero(np.concatenate([[True], self.lcp < GRAM, [True]])) if len(sa) else np.zeros(1, np.int64)

    def repeats(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(left, right, members): bytes shared before the anchor and from it on, LENGTH or more in all, and the places
        in suffix order of the two or more anchors that share them. Sets are maximal: no byte can be added on either
        side. (An anchor alone in its suffix repeats only as a whole, with its equal contexts.)"""
        first, last = self.bounds[:-1], self.bounds[1:]
        size = last - first
        # Two members: their common lengths are the tree.
        i = first[size == 2]
        differ = self.back[i] != self.back[i + 1]
        ll = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), LEFT), np.minimum(self.left[i], self.left[i + 1]))
        rr = self.lcp[i]
        for k in np.flatnonzero(ll + rr >= LENGTH).tolist():
            yield int(ll[k]), int(rr[k]), np.array([i[k], i[k] + 1])
        for a, b in zip(first[size > 2].tolist(), last[size > 2].tolist(), strict=True):
            yield from self._tree(a, b)

    def _tree(self, a: int, b: int) -> Iterator[tuple[int, int, np.ndarray]]:
        back, left = self.back[a:b], self.left[a:b]
        order = _sorted_by(back, left.astype(np.uint8))
        lcs = _lcp(back[order], left[order])
        lcp = self.lcp[a : b - 1]
        if lcs.max() + lcp.max() < LENGTH:
            return
        rank = np.empty(b - a, np.int64)
        rank[order] = np.arange(b - a)
        for depth, lo, hi in intervals(lcp.tolist()):
            need = LENGTH - depth
            ranks = np.sort(rank[lo : hi + 1])
            common = np.minimum.reduceat(lcs, ranks[:-1])
            # reduceat gives the minimum from one rank up to the next; the last runs to the end and is cut here.
            common[-1] = lcs[ranks[-2] : ranks[-1]].min()
            if common.max() < need:
                continue
            inner = lcp[lo:hi]
            for shared, x, y in intervals(common.tolist()):
                if shared < need:
                    continue
                members = np.sort(order[ranks[x : y + 1]])
                # Right extension: if they agree beyond this interval's depth, a deeper interval reports them.
                if inner[members[0] - lo : members[-1] - lo].min() == depth:
                    yield shared, depth, members + a


def _scan_bucket(group: pa.Table) -> pa.Table:
    kinds = (("u1", WIDTH), ("u1", 1), ("u1", 1), ("<i8", 1), ("<i8", 1), ("<i4", 1))
    rows = [(blk, *_unpack(x, n, *kinds)) for blk, n, x in zip(group.column("block").to_pylist(), group.column("n").to_pylist(), group.column("contexts").to_pylist(), strict=True)]
    ctx, left, right, low, high, pos = (np.concatenate([r[i] for r in rows]) for i in range(1, 7))
    source = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    # Equal contexts of different blocks are one suffix; what it shares holds for all of them.
    order, first, of = _grouped(ctx, left, right)
    same_low = np.minimum.reduceat(low[order], first)
    rep = order[first]
    bucket = Bucket(ctx[rep], left[rep], right[rep])
    lows = same_low[bucket.sa]
    found: dict[int, list[tuple[int, int, int]]] = {}
    for shared_left, shared_right, members in bucket.repeats():
        least = int(lows[members].min())
        for m in members.tolist():
            found.setdefault(m, []).append((shared_left, shared_right, least))
    place = np.empty(len(rep), np.int64)
    place[bucket.sa] = np.arange(len(rep))
    suffix = np.empty(len(ctx), np.int64)
    suffix[order] = place[of]
    # A suffix always repeats as itself, over its whole context, in the smallest of its own documents.
    own = np.stack([pos, bucket.left[suffix], bucket.right[suffix], lows[suffix]], axis=1)
    own, whose = own[lows[suffix] < high], source[lows[suffix] < high]
    more, theirs = [], []
    for i in np.flatnonzero(np.isin(suffix, np.fromiter(found, np.int64, len(found)))).tolist():
        top, at = int(high[i]), int(pos[i])
        for x in found[int(suffix[i])]:
            if x[2] < top:
                more.append((at, *x))
                theirs.append(int(source[i]))
    own = np.concatenate([own, np.array(more, np.int64).reshape(-1, 4)])
    whose = np.concatenate([whose, np.array(theirs, np.int64)])
    by = np.argsort(whose, kind="stable")
    edges = np.searchsorted(whose[by], np.arange(len(rows) + 1))
    keep = [(r[0], own[by[lo:hi]]) for r, lo, hi in zip(rows, edges, edges[1:], strict=False) if lo < hi]
    return pa.table([pa.array([b for b, _ in keep], pa.int64()), pa.array([len(o) for _, o in keep], pa.int32()), pa.array([_pack(o) for _, o in keep], pa.binary())], names=["block", "n", "repeats"])


def _apply(with_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _one_by_one(batch):
                block = _open(r["ids"], r["lengths"], r["data"])
                covered = _covered(block, [_unpack(a["repeats"], a["n"], ("<i8", 4))[0] for a in r["answers"] or []])
                spans, kept = [], []
                for a, b in zip(block.starts.tolist(), block.ends.tolist(), strict=True):
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered[a:b], [False]]).astype(np.int8))).reshape(-1, 2)
                    spans.append([{"start": s, "end": e} for s, e in edge.tolist()])
                    if with_text:
                        kept.append(block.text[a:b][~covered[a:b]].tobytes() if len(edge) else block.text[a:b].tobytes())
                for lo in range(0, len(spans), 512):
                    part = slice(lo, lo + 512)
                    cols = [pa.array(r["ids"][part], pa.int64()), pa.array(block.lengths[part], pa.int64()), pa.array(spans[part], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                    yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept[part], pa.binary())] if with_text else [])], ["id", "n_bytes", "spans", *["kept"] * with_text])

    return apply


def _covered(block: Block, answers: list[np.ndarray]) -> np.ndarray:
    """Which bytes repeat a smaller document's, from (position of a context, left, right, smallest id) rows."""
    covered = np.zeros(len(block.text) + 1, np.int64)
    if answers:
        told = np.concatenate(answers)
        pos, h = block.anchors()
        reps = np.unique(told[:, 0])
        pick = np.isin(h, h[np.searchsorted(pos, reps)])
        pos = pos[pick]
        ctx, left, right, doc = block.contexts(pos)
        order, first, of = _grouped(ctx, left, right)
        group = np.empty(len(pos), np.int64)
        group[order] = of
        told_group = group[np.searchsorted(pos, told[:, 0])]
        by = np.argsort(told_group, kind="stable")
        told, told_group = told[by], told_group[by]
        lo, hi = np.searchsorted(told_group, group), np.searchsorted(told_group, group, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(pos)), n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        earlier = told[row, 3] < block.ids[doc[at]]
        at, row = at[earlier], row[earlier]
        np.add.at(covered, pos[at] - told[row, 1], 1)
        np.add.at(covered, pos[at] + told[row, 2], -1)
    return np.cumsum(covered)[:-1] > 0


def _shared_grams(scratch: Scratch, blocks: DataFrame, bits: int, hot_blocks: int) -> DataFrame:
    sent = blocks.mapInArrow(_send_grams(bits), "bucket int, block long, grams binary, several binary")
    return scratch.keep(sent.groupBy("bucket").applyInArrow(_find_shared(hot_blocks), "block long, bucket int, shared binary, hot binary, n int"), "shared")


def _found_repeats(scratch: Scratch, blocks: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    answers = shared.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared", "hot", "n")).alias("answers"))
    contexts = blocks.join(answers, "block").mapInArrow(_send_contexts(bits), "bucket int, block long, n int, contexts binary")
    return scratch.keep(contexts.groupBy("bucket").applyInArrow(_scan_bucket, "block long, n int, repeats binary"), "found")


SPANS = "array<struct<start: long, end: long>>"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """(id, n_bytes, spans, kept): the byte spans of each document that repeat one of a smaller id, and the other bytes.

    A byte is in a span if a LENGTH-byte string that covers it also starts in a document with a smaller id. Strings are
    judged on the input. Texts are UTF-8 bytes; null is empty; matches lie within one document. Spans are maximal and
    in order. Rows of equal ids never count against each other; null ids count as larger than any other and never
    against each other. Kept bytes may cut a code point. Repeated rows come out as often as they came. Other columns
    are ignored, so their names cannot clash. An empty table gives no rows. Ids are integers.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), utf8(F.col(f"`{text_col}`")).alias("utf8"))
    blocks = scratch.keep(rows.mapInArrow(_make_blocks, "block long, ids array<long>, lengths binary, data binary"), "blocks")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("utf8")), F.lit(0))).first()[0]
    bits = max(LEAST_BUCKETS, size // BUCKET_BYTES).bit_length()

    shared = _shared_grams(scratch, blocks, bits, hot_blocks)
    forget(docs.sparkSession)
    found = _found_repeats(scratch, blocks, shared, bits)
    scratch.drop("shared")
    forget(docs.sparkSession)
    answers = found.groupBy("block").agg(F.collect_list(F.struct("n", "repeats")).alias("answers"))
    out = blocks.join(answers, "block", "left").mapInArrow(_apply(with_text), f"id long, n_bytes long, spans {SPANS}" + ", kept binary" * with_text)
    return out.withColumnRenamed("id", id_col)
