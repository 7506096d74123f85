"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every word from both sides."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.shared import Scratch, utf8
from driftwell.llm.words import split_all

#: Output words: at least CLASSES classes of as many words each; the number of classes grows with the corpus (see
#: `classes_for`). The most frequent words have their own number, the others share HASHED of every WORDS numbers.
CLASSES, HASHED = 32, 64
WORDS = CLASSES * CLASSES
OFFSETS = (-2, -1, 1, 2)
WIDTH, BATCH, RATE, SEED = 16, 8192, 0.15, 5
#: Texts of which the words are trained on in batches; their last batch is what is left.
TEXTS = 256
#: Classes at most: a network of a million words has 340 MB. What is gathered of rarer words goes on growing in the table
#: of counts (see `_within`).
MOST_CLASSES = 1024
#: Words that share a number of which the workers know the counts; those of the others are joined in. Which words these
#: are changes no result.
KNOWN = 200_000
#: Scores above this are shifted before they are raised, so that the exponents stay finite whatever the weights.
SAFE = 60.0
#: Rows that are computed together; any number gives the same results but for rounding.
BLOCK = 512

#: Floats of a network: so many for each of its words, and so many besides.
_PER_WORD, _BESIDES = (len(OFFSETS) + 1) * WIDTH + 1, (len(OFFSETS) + 1) * WIDTH
#: Floats of a network that travel in one row, so that averaging never holds whole networks.
PIECE = 1 << 18
#: Log-probabilities within a shared number are added as whole millionths: their sums don't depend on the order.
UNIT = 1_000_000


def classes_for(distinct: int) -> int:
    """The cube root of the distinct words: the network's words grow as their power of two thirds."""
    return min(MOST_CLASSES, max(CLASSES, math.ceil(round(distinct ** (1 / 3), 6))))


def shared_numbers(words: int) -> int:
    return words * HASHED // WORDS


def _bucket(word: Column, shared: int) -> Column:
    """Which of the shared numbers a word has; `Vocabulary` says the same."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(word), 1), F.lit(shared)).cast("int")


class Vocabulary:
    """Numbers of words, and what a word's share of its number is worth where that is known here.

    known: (word, bucket, log_p) of some of the words that share numbers, as `_within` has them.
    """

    def __init__(self, frequent: list[bytes], words: int = WORDS, known: list[tuple[bytes, int, int]] = ()):
        self.words, self.shared = words, shared_numbers(words)
        self.own = words - self.shared
        self.known = pa.array([*frequent, *(w for w, _, _ in known)], pa.binary())
        kind = np.uint16 if words < 1 << 16 else np.uint32
        # Two more places: the last but one for words not known here, the last for padding.
        self.numbers = np.concatenate([np.arange(len(frequent)), self.own + np.array([b for _, b, _ in known], np.int64), [0, words]]).astype(kind)
        self.log_p = np.concatenate([np.zeros(len(frequent), np.int64), np.array([p for _, _, p in known], np.int64), [0, 0]])

    def __getitem__(self, word: bytes) -> int:
        """Of a word as it is cut from a text."""
        at = self._at.get(word)
        return self._shared_number(word) if at is None else int(self.numbers[at])

    @cached_property
    def _at(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.known.to_pylist())}

    def _shared_number(self, word: bytes) -> int:
        return self.own + (xxhash.xxh64_intdigest(word, 42) >> 1) % self.shared

    def numbered(self, texts: pa.Array | list[bytes | None], with_rest: bool = False) -> tuple:
        """Word numbers of all texts with padding around each, where the words are, how many each text has, the sum of
        each text's known shares, and on request a list for each text of its other words without a number of their own,
        with how often they come."""
        far, unknown = max(OFFSETS), len(self.numbers) - 2
        words, counts = split_all(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        places = pc.fill_null(pc.index_in(words, value_set=self.known), unknown).to_numpy()
        found = self.numbers[places]
        missed = np.flatnonzero(places == unknown)
        rest = words.take(pa.array(missed)).dictionary_encode()
        new, which = rest.dictionary, rest.indices.to_numpy()
        if len(missed):
            found[missed] = np.array([self._shared_number(w) for w in new.to_pylist()], found.dtype)[which]
        text = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(words)) + far * (text + 1)
        numbers = np.full(far + len(words) + far * len(counts), self.words, found.dtype)
        numbers[at] = found
        ends = np.cumsum(counts)
        upto = np.concatenate([[0], np.cumsum(self.log_p[places])])
        out = numbers, at, counts, upto[ends] - upto[ends - counts]
        if not with_rest:
            return out
        pairs, n = np.unique(text[missed] * max(1, len(new)) + which, return_counts=True)
        edges = np.searchsorted(pairs, np.arange(len(counts) + 1) * max(1, len(new)))
        items = pa.StructArray.from_arrays([new.take(pa.array(pairs % max(1, len(new)))), pa.array(n, pa.int64())], ["word", "n"])
        return *out, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), items)


@dataclass
class Window:
    """tanh of summed position embeddings of the words around, then a class, then a word of that class."""

    embed: np.ndarray  # [offset, word or padding, WIDTH]; in memory what a word has for all offsets lies together
    bias: np.ndarray
    classes: np.ndarray  # [WIDTH + 1, class]
    words: np.ndarray  # [class, WIDTH + 1, word of it]

    @classmethod
    def fresh(cls, classes: int = CLASSES) -> Window:
        rng = np.random.default_rng(SEED)
        return cls(
            rng.normal(0, 0.1, (len(OFFSETS), classes * classes + 1, WIDTH)).transpose(1, 0, 2).astype(np.float32, order="C").transpose(1, 0, 2),
            np.zeros(WIDTH, np.float32),
            rng.normal(0, 0.1, (WIDTH + 1, classes)).astype(np.float32),
            rng.normal(0, 0.1, (classes, WIDTH + 1, classes)).astype(np.float32),
        )

    @property
    def n_words(self) -> int:
        return self.classes.shape[1] ** 2

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.bias, self.classes, self.words]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Window:
        # The classes' own weights are fewer than a word's for each class, so the root's floor is exact.
        out, at = cls.fresh(math.isqrt((flat.size - _BESIDES) // _PER_WORD)), 0
        for a in out.arrays():
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        return out

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """around: numbers of the words at OFFSETS of each masked word. A column of ones is added for the biases."""
        h = np.ones((around.shape[1], WIDTH + 1), self.bias.dtype)
        rows = _by_word(self.embed).reshape(-1, WIDTH)
        at = around * np.int64(len(OFFSETS))
        near = rows.take(at[0], axis=0)
        for k in range(1, len(OFFSETS)):
            near += rows.take(at[k] + k, axis=0)
        near += self.bias
        np.tanh(near, out=h[:, :WIDTH])
        return h

    def log_likelihood(self, word: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Natural log-probability of each masked word given the words around it."""
        order, of, inside, by_class = _by_class(word, len(self.words))
        h, found = self.hidden(around[:, order]), np.empty(len(word))
        for some, rows in _blocks(by_class):
            x = h[rows] @ self.classes
            found[rows] = _log_of(x, of[rows])
            for c, lo, hi in some:
                np.dot(h[lo:hi], self.words[c], out=x[lo - rows.start : hi - rows.start])
            found[rows] += _log_of(x, inside[rows])
        out = np.empty(len(word))
        out[order] = found
        return out

    def learn(self, ids: np.ndarray, at: np.ndarray, memory: list[np.ndarray]) -> None:
        """One AdaGrad step on the mean negative log-likelihood of the words at some ascending places of a text. Words
        and classes that the text doesn't hold there have no gradient and are not touched."""
        m_embed, m_bias, m_classes, m_words = memory
        some, g, g_bias, g_classes, g_words = self._gradients(ids, at)
        weights, memories = _by_word(self.embed), _by_word(m_embed)
        m = memories.take(some, axis=0)
        m += g * g
        memories[some] = m
        own = weights.take(some, axis=0)
        own -= _change(g, m)
        weights[some] = own
        _step(self.bias, g_bias, m_bias)
        _step(self.classes, g_classes, m_classes)
        for c, g in g_words:
            _step(self.words[c], g, m_words[c])

    def train(self, word: np.ndarray, around: np.ndarray, memory: list[np.ndarray]) -> None:
        """As `learn`, of words and the words around each."""
        self.learn(*_as_text(word, around), memory)

    def gradients(self, word: np.ndarray, around: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, list]:
        """Of the mean negative log-likelihood: (for each offset the words that have one and theirs, of the biases, of
        the classes, (classes, of their words) for all classes that the batch holds)."""
        some, g, *others = self._gradients(*_as_text(word, around))
        return [(some[has], g[has, k]) for k, has in enumerate(np.isin(some, near) for near in around)], *others

    def _gradients(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
        """(words, theirs for each offset, of the biases, of the classes, (classes, of their words))."""
        order, of, inside, by_class = _by_class(ids[at], len(self.words))  # rows of one class lie together from here on
        lo, hi = at[0] + min(OFFSETS), at[-1] + max(OFFSETS) + 1
        ids, at, n = ids[lo:hi], at[order] - lo, at.dtype.type(len(at))
        h = self.hidden(_around(ids, at))
        back, own = np.empty((2, len(h), WIDTH), h.dtype)
        g_classes, g_words = np.zeros_like(self.classes), []
        for some, rows in _blocks(by_class):
            x = h[rows] @ self.classes
            scale = _error(x, of[rows], n)
            g_classes += (h[rows] * scale).T @ x
            np.dot(x, self.classes[:WIDTH].T, out=back[rows])
            back[rows] *= scale
            for c, lo, hi in some:
                np.dot(h[lo:hi], self.words[c], out=x[lo - rows.start : hi - rows.start])
            scale = _error(x, inside[rows], n)
            scaled, g = (h[rows] * scale).T, np.empty((len(some), *self.classes.shape), x.dtype)
            for i, (c, lo, hi) in enumerate(some):
                part = x[lo - rows.start : hi - rows.start]
                np.dot(part, self.words[c, :WIDTH].T, out=own[lo:hi])
                np.dot(scaled[:, lo - rows.start : hi - rows.start], part, out=g[i])
            own[rows] *= scale
            g_words.append((slice(some[0][0], some[-1][0] + 1), g))
        back += own
        # By places of the text: a word's gradient for an offset is that of the place so far before it.
        far = max(OFFSETS)
        placed = np.zeros((len(ids) + 2 * far, WIDTH), back.dtype)
        placed[at + far] = back * (1 - h[:, :WIDTH] ** 2)
        by = np.argsort(ids, kind="stable")
        ids = ids[by]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rows = np.diff(first, append=len(ids))
        more, once = rows > 1, by[first]  # a word that comes once needs no sum
        by, starts = by[np.repeat(more, rows)], np.cumsum(rows[more]) - rows[more]
        g_embed = np.empty((len(first), len(OFFSETS), WIDTH), back.dtype)
        for k, o in enumerate(OFFSETS):
            g_embed[:, k] = placed.take(once + (far - o), axis=0)
            if len(by):
                g_embed[more, k] = np.add.reduceat(placed.take(by + (far - o), axis=0), starts)
        return ids[first], g_embed, placed.sum(axis=0), g_classes, g_words


def _by_word(a: np.ndarray) -> np.ndarray:
    """[word or padding, offset, WIDTH], as it lies in memory."""
    return a.transpose(1, 0, 2)


def _as_text(word: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text of the words and those around each, and the places of the words in it."""
    width = max(OFFSETS) - min(OFFSETS) + 1
    at = np.arange(len(word)) * width - min(OFFSETS)
    ids = np.empty(len(word) * width, np.result_type(word, around))
    ids[at] = word
    for o, near in zip(OFFSETS, around, strict=True):
        ids[at + o] = near
    return ids, at


def _change(g: np.ndarray, m: np.ndarray) -> np.ndarray:
    out = np.sqrt(m)
    np.divide(g, out, out=out)
    out *= RATE
    return out


def _step(a: np.ndarray, g: np.ndarray, m: np.ndarray) -> None:
    m += g * g
    a -= _change(g, m)


def _raised(x: np.ndarray) -> np.ndarray:
    """Raises scores in place; their sums over rows. Rows are shifted by their largest score where one is large."""
    if x.size and x.max() > SAFE:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def _log_of(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log of the softmax of scores at one place of each row."""
    if x.size and x.max() > SAFE:
        x -= x.max(axis=1, keepdims=True)
    own = x.reshape(-1).take(_places(x, at))
    return own - np.log(_raised(x))


def _places(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.arange(0, x.size, x.shape[1]) + at


def _error(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Softmax of scores less one at the right place, over n: x in place, to be multiplied by the column returned."""
    total = _raised(x)
    x.reshape(-1)[_places(x, at)] -= total
    return (1 / (total * x.dtype.type(n)))[:, None]


def _by_class(word: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The order that sorts words by class, in that order the classes and the words' places in them, and (class, first
    row, end) of each class there is."""
    kind = np.uint8 if classes <= 256 else np.uint16
    of = (word % classes).astype(kind)
    order = np.argsort(of, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=classes))]).tolist()
    return order, of[order], (word // classes)[order], [(c, lo, hi) for c, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if lo < hi]


def _blocks(by_class: list[tuple[int, int, int]]) -> Iterator[tuple[list[tuple[int, int, int]], slice]]:
    """Runs of classes, none left out between, with some BLOCK rows in all, and their rows; the scores of so many stay in
    a processor's cache."""
    at = 0
    while at < len(by_class):
        end = at + 1
        while end < len(by_class) and by_class[end][0] == by_class[end - 1][0] + 1 and by_class[end][2] - by_class[at][1] <= BLOCK:
            end += 1
        yield by_class[at:end], slice(by_class[at][1], by_class[end - 1][2])
        at = end


def _around(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([ids[at + o] for o in OFFSETS])


def _some(texts: pa.Array, most: int = 1 << 24) -> Iterator[pa.Array]:
    """Texts in runs of 4 * TEXTS, or of TEXTS where so many have more than `most` bytes."""
    step = 4 * TEXTS if texts.nbytes * 4 * TEXTS <= most * len(texts) else TEXTS
    for lo in range(0, len(texts), step):
        yield texts.slice(lo, step)
        pa.default_memory_pool().release_unused()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(kept).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    for batch in batches:
        for texts in _some(batch.column(0)):
            found = split_all(texts)[0].value_counts()
            kept.append(pa.table([found.field(0), found.field(1)], ["word", "n"]))
            if sum(t.num_rows for t in kept) > 600_000:
                kept = [merged()]
                if kept[0].num_rows > 300_000:
                    yield from kept.pop().to_batches()
    if kept:
        yield from merged().to_batches()


def _train(frequent, known, classes: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Window.fresh(classes), 0
        vocabulary = Vocabulary(frequent.value, net.n_words, known.value)
        memory = [np.full_like(a, 1e-6) for a in net.arrays()]
        for batch in batches:
            for texts in _some(batch.column(0)):
                ids, at, counts, _ = vocabulary.numbered(texts)
                upto = np.concatenate([[0], np.cumsum(counts)])[::TEXTS].tolist()
                for lo, hi in zip(upto, [*upto[1:], len(at)], strict=True):
                    for b in range(lo, hi, BATCH):
                        net.learn(ids, at[b : min(b + BATCH, hi)], memory)
                seen += len(at)
        if seen:
            part, flat = TaskContext.get().partitionId(), net.flat()
            for i, at in enumerate(range(0, flat.size, PIECE)):
                yield _piece(part, i, seen, flat[at : at + PIECE])

    return train


def _piece(part: int, piece: int, seen: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([piece], pa.int64()), pa.array([seen], pa.int64()), pa.array([weights.tobytes()], pa.binary())], ["part", "piece", "seen", "weights"])


def _average(group: pa.Table) -> pa.Table:
    """The mean of a piece of networks, by the words each has seen; in the order of their parts, so that reruns agree."""
    rows = sorted(group.to_pylist(), key=lambda r: r["part"])
    seen = sum(r["seen"] for r in rows)
    mean = sum(np.frombuffer(r["weights"], np.float32).astype(np.float64) * (r["seen"] / seen) for r in rows)
    return pa.Table.from_batches([_piece(rows[0]["part"], rows[0]["piece"], seen, mean.astype(np.float32))])


def _score(frequent, known, weights):
    """(key, n_words, log_p, shares, words): of every text the network's log-probability, the shares known here in
    millionths, and the words that have neither a number of their own nor a known share, with how often they come."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Window.of(np.frombuffer(weights.value, np.float32))
        vocabulary = Vocabulary(frequent.value, net.n_words, known.value)
        for batch in batches:
            done = 0
            for texts in _some(batch.column(1)):
                ids, at, counts, shares, words = vocabulary.numbered(texts, with_rest=True)
                logs = [net.log_likelihood(ids[p], _around(ids, p)) for p in (at[b : b + BATCH] for b in range(0, len(at), BATCH))]
                upto = np.concatenate([[0.0], np.cumsum(np.concatenate(logs or [np.empty(0)]))])
                ends = np.cumsum(counts)
                total = upto[ends] - upto[ends - counts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(counts), pa.array(total, pa.float64()), pa.array(shares, pa.int64()), words], ["key", "n_words", "log_p", "shares", "words"])
                done += len(texts)

    return score


def _known(within: DataFrame) -> list[tuple[bytes, int, int]]:
    """KNOWN or fewer of the words of `_within`, of the larger shares."""
    words = within.where("word IS NOT NULL")
    n = words.count()
    if n > KNOWN:
        words = words.where(F.col("log_p") >= words.agg(F.percentile_approx("log_p", 1 - KNOWN / n)).first()[0])
    return [(bytes(r["word"]), r["bucket"], r["log_p"]) for r in words.limit(KNOWN).collect()]


def _within(counted: DataFrame, frequent: list[tuple[bytes, int]], shared: int) -> DataFrame:
    """(bucket, word, log_p): the log-probability, in millionths, of every word without a number of its own among those
    of its number: its count in the corpus against theirs. A row without a word says what is kept for all unseen
    words of the number, as if each of its words had been new once, and one more."""
    last = (F.col("n") < frequent[-1][1]) | ((F.col("n") == frequent[-1][1]) & (F.col("word") > F.lit(frequent[-1][0]))) if frequent else F.lit(False)
    rest = counted.where(last).select(_bucket(F.col("word"), shared).alias("bucket"), "word", "n")
    numbers = counted.sparkSession.range(shared).select(F.col("id").cast("int").alias("bucket"))
    totals = numbers.join(rest.groupBy("bucket").agg(F.sum("n").alias("all"), (F.count("*") + 1).alias("new")), "bucket", "left").fillna({"all": 0, "new": 1})
    log_p = lambda n: F.round(F.log(n / (F.col("all") + F.col("new"))) * UNIT).cast("long").alias("log_p")
    known = rest.join(F.broadcast(totals), "bucket").select("bucket", "word", log_p(F.col("n")))
    return known.unionAll(totals.select("bucket", F.lit(None).cast("binary").alias("word"), log_p(F.col("new"))))


def learn(docs: DataFrame, text_col: str = "text") -> tuple[list[bytes], bytes, DataFrame]:
    """(frequent words, weights of the network, log-probabilities within the shared numbers), from all words of all
    documents.

    Words are counted over the corpus; the network's vocabulary grows with the distinct ones. Each partition trains a
    network over its own words from the same start, and the networks are averaged by word counts, piece by piece, first
    in groups, then as one, so that no task or driver holds many. The words that share a number are not bounded; they
    stay in a distributed table (see `_within`). Null, empty and blank texts say nothing; repeated rows count as often as
    they come; an empty table gives no words and the network it would have started with. Only the text is read.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    texts = docs.select(utf8(F.col(f"`{text_col}`")).alias("utf8"))
    counted = scratch.keep(texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    by_count = sorted(((r["n"], r["words"]) for r in counted.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    classes = classes_for(sum(words for _, words in by_count))
    shared = shared_numbers(classes * classes)
    # Only words as frequent as the last one taken are sorted, so that not every partition sends its first ones.
    room, least = classes * classes - shared, 1
    upto = np.cumsum([words for _, words in by_count])
    if len(upto) and upto[-1] > room:
        least = by_count[int(np.searchsorted(upto, room))][0]
    taken = [(bytes(r["word"]), r["n"]) for r in counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(room).collect()]
    frequent = [w for w, _ in taken]
    within = scratch.keep(_within(counted, taken, shared), "within")
    schema, sc = "part long, piece long, seen long, weights binary", docs.sparkSession.sparkContext
    nets = scratch.keep(texts.mapInArrow(_train(sc.broadcast(frequent), sc.broadcast(_known(within)), classes), schema), "networks")
    groups = max(1, math.isqrt(nets.where("piece = 0").count()))
    first = nets.withColumn("g", F.pmod("part", F.lit(groups))).groupBy("g", "piece").applyInArrow(_average, schema)
    mean = first.groupBy("piece").applyInArrow(_average, schema).collect()
    scratch.drop("networks", "counts")
    weights = b"".join(bytes(r["weights"]) for r in sorted(mean, key=lambda r: r["piece"]))
    return frequent, weights or Window.fresh(classes).flat().tobytes(), within


def score(docs: DataFrame, frequent: list[bytes], weights: bytes, within: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, n_words, pseudo_log_likelihood): the document's columns as a struct, its words, and the sum over them of
    the log-probability (natural) of the word given the two words on either side.

    A word that shares its number with others has the number's probability times its own share of the number's words in
    the corpus learned from; an unseen one has the number's share for unseen words, and 1 / 256 for each byte and for
    the end. Words are runs without ASCII whitespace, A-Z lower-cased. Null, empty or blank texts have no words and a
    sum of 0. Texts are read whole. Columns stay inside `row`, so no name can clash. An empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    scratch = Scratch(docs.sparkSession, "lm-scores")
    known, net = _known(within), Window.of(np.frombuffer(weights, np.float32))
    text = utf8(F.col(f"`{text_col}`"))
    key = F.unhex(F.md5(text)).alias("key")
    schema = "key binary, n_words long, log_p double, shares long, words array<struct<word: binary, n: long>>"
    scored = docs.select(key, text.alias("utf8")).mapInArrow(_score(sc.broadcast(frequent), sc.broadcast(known), sc.broadcast(weights)), schema)
    scored = scratch.keep(scored, "scored")

    rare = scored.select("key", F.posexplode("words").alias("at", "w")).select("key", F.col("w.word").alias("word"), F.col("w.n").alias("n"), (F.col("at") == 0).cast("long").alias("first"))
    new = F.broadcast(within.where("word IS NULL").select("bucket", F.col("log_p").alias("new")))
    rare = rare.join(within.where("word IS NOT NULL").select("word", "log_p"), "word", "left")
    rare = rare.withColumn("bucket", _bucket(F.col("word"), shared_numbers(net.n_words))).join(new, "bucket")
    spelled = F.round((F.length("word") + 1) * (math.log(256) * UNIT)).cast("long")
    # Rows of equal texts share a key: each has the text's first rare word once.
    sums = rare.groupBy("key").agg((F.sum(F.col("n") * F.coalesce("log_p", F.col("new") - spelled)) / F.sum("first")).alias("rare"))
    # Equal texts have equal scores, so one row of each text is enough.
    once = scored.groupBy("key").agg(F.min("n_words").alias("n_words"), F.min("log_p").alias("log_p"), F.min("shares").alias("shares")).join(sums, "key", "left")
    total = F.col("log_p") + (F.col("shares") + F.coalesce("rare", F.lit(0.0))) / UNIT
    once = once.select("key", "n_words", total.alias("pseudo_log_likelihood"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key)
    return rows.join(once, "key", "left").select("row", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("pseudo_log_likelihood", F.lit(0.0)).alias("pseudo_log_likelihood"))
