"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.llm.shared import Scratch, utf8

#: The classifier is fitted to at most about so many rows, drawn by a hash, of each of four kinds: labelled 0 or 1, and
#: without a label but more likely the one or the other.
SAMPLE_ROWS = 6000
#: A lexicon entry: the least share of toxic ones among the labelled documents that hold it, either label weighted as
#: in the sample; and how surprising that must be: toxic documents times the logarithm of their share against the
#: sample's. Every labelled document is counted, and every such entry is kept.
LEAST_SHARE, LEAST_SURPRISE = 0.8, 8.0
#: Bits of the filter that keeps most texts without a label out of the shuffle.
FILTER_BITS = 1 << 24
PREFIXES = (4, 5, 6)
LEXICON_VOTERS = 8
_LETTERS = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"!{2,}|\b[A-Z]{4,}\b")
_NOISE = re.compile(r"[^\w\s.,;:!?'\"()-]")


def entries_of(word: str) -> list[str]:
    """What a word can match in a lexicon: itself, and its first letters."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


class Hits(dict):
    """word -> numbers of the lexicon entries it matches, remembered for a bounded number of words."""

    def __init__(self, lexicon: dict[str, int]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        self[word] = found = tuple(self.lexicon[e] for e in entries_of(word) if e in self.lexicon)
        return found


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        keys = list(toxic.keys() | clean.keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["entry", "toxic", "clean"])
        toxic.clear()
        clean.clear()
        return out

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_LETTERS.findall((text or "").lower()))
            (toxic if label else clean).update({e for w in words for e in entries_of(w)})
            if len(toxic) + len(clean) > 400_000:
                yield flush()
    yield flush()


def _find_hits(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found, sizes, shouts, noise = [], [], [], []
                for raw in part.column(1).to_pylist():
                    text = (raw or b"").decode("utf-8", "replace")
                    words = _LETTERS.findall(text.lower())
                    c = Counter(e for h in map(hits.__getitem__, words) if h for e in h)
                    found.append([{"entry": e, "n": n} for e, n in sorted(c.items())])
                    sizes.append(len(words))
                    shouts.append(len(_SHOUT.findall(text)))
                    noise.append(len(_NOISE.findall(text)))
                kind = pa.list_(pa.struct([("entry", pa.int32()), ("n", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind), pa.array(sizes, pa.int64()), pa.array(shouts, pa.int64()), pa.array(noise, pa.int64())], ["id", "hits", "words", "shouts", "noise"])

    return find


def votes(hits: list[dict], words: int, shouts: int, noise: int, entries: int) -> tuple[int, ...]:
    """What each voter says: entries are dealt over LEXICON_VOTERS voters, then two density voters and two pattern voters."""
    lex = [0] * LEXICON_VOTERS
    total = 0
    for h in hits:
        lex[h["entry"] % LEXICON_VOTERS] = 1
        total += h["n"]
    return (*lex, int(total * 100 >= words > 0), int(total >= 4), int(shouts * 50 > words), int(noise * 10 > words))


VOTERS = LEXICON_VOTERS + 4


#: What a model says of no label; observations that the starting rates count as; information, in nats, that makes two
#: voters depend on one another.
NO_LABEL, START_COUNTS, LEAST_INFORMATION = -1, 20.0, 1e-4


@dataclass
class LabelModel:
    """A joint distribution of the unseen label, the votes, and the label that a row may have been given.

    Given the unseen label the voters form a tree: each depends on one other at most, along the maximum spanning tree of
    their mutual information, so correlated voters do not count twice. The given label is a voter of its own, whose
    accuracy is estimated like that of the others and which does not vote on most rows.
    """

    prior: float
    parent: np.ndarray  # of each voter, or -1
    fires: np.ndarray  # [label, vote of the parent, voter]
    told: np.ndarray  # [label]: how often a given label says 1

    @classmethod
    def fit(cls, patterns: np.ndarray, given: np.ndarray, counts: np.ndarray, start: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
        """EM over distinct (votes, given label) and their counts in the whole corpus. start: [label, voter] firing rates
        to begin with. Rows without a label weigh as much as those with one, in all, if they are more: so they refine
        what the labels say, and do not outvote it."""
        voters = patterns.shape[1]
        model = cls(prior, np.full(voters, -1), np.repeat(start[:, None], 2, axis=1), np.array([0.05, 0.95]))
        free = given == NO_LABEL
        rest, labelled = counts[free].sum(), counts[~free].sum()
        counts = np.where(free & (labelled > 0), min(1.0, labelled / max(rest, 1)), 1.0) * counts
        for _ in range(rounds if len(counts) else 0):
            p = model.posterior(patterns, given)
            w = np.stack([(1 - p) * counts, p * counts])
            mass = w.sum(axis=1)
            model.prior = float(np.clip(mass[1] / mass.sum(), 1e-4, 0.5))
            model.told = (w @ (given == 1) + START_COUNTS * np.array([0.05, 0.95])) / (w @ ~free + START_COUNTS)
            both = np.stack([(patterns * x[:, None]).T @ patterns for x in w])  # [label, voter, voter]: both fire
            model.parent = _tree(both, mass)
            model.fires = _rates(both, mass, model.parent, start)
        return model

    def posterior(self, patterns: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of votes and given label."""
        f, voters = np.clip(self.fires, 1e-4, 1 - 1e-4), np.arange(patterns.shape[1])
        above = np.where(self.parent >= 0, patterns[:, self.parent], 0).astype(int)
        on, off = np.log(f[1] / f[0]), np.log((1 - f[1]) / (1 - f[0]))
        logit = np.log(self.prior / (1 - self.prior)) + np.where(patterns > 0, on[above, voters], off[above, voters]).sum(axis=1)
        t = np.clip(self.told, 1e-4, 1 - 1e-4)
        logit = logit + np.select([given == 1, given == 0], [np.log(t[1] / t[0]), np.log((1 - t[1]) / (1 - t[0]))], 0.0)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))

    def accuracy(self) -> np.ndarray:
        """How often each voter is right, by the model."""
        rate = np.where(self.parent >= 0, 0.0, self.fires[:, 0])
        for v in _down(self.parent):
            if self.parent[v] >= 0:
                above = rate[:, self.parent[v]]
                rate[:, v] = (1 - above) * self.fires[:, 0, v] + above * self.fires[:, 1, v]
        return self.prior * rate[1] + (1 - self.prior) * (1 - rate[0])


def _information(both: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters given the label."""
    out, total = np.zeros(both.shape[1:]), mass.sum()
    for n11, m in zip(both, mass, strict=True):
        n1 = np.diag(n11)
        for joint, x, y in ((n11, n1, n1), (n1[:, None] - n11, n1, m - n1), (n1[None] - n11, m - n1, n1), (m - n1[:, None] - n1[None] + n11, m - n1, m - n1)):
            joint, alone = np.maximum(joint, 0), np.maximum(np.outer(x, y), 1e-12)
            out += np.where(joint > 1e-9, joint * np.log(np.maximum(joint * m, 1e-12) / alone), 0) / total
    np.fill_diagonal(out, 0)
    return out


def _tree(both: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Parents in the maximum spanning tree by mutual information; edges that say nothing are left out."""
    info = _information(both, mass)
    parent, best, inside = np.full(len(info), -1), np.full(len(info), -1.0), np.zeros(len(info), bool)
    for _ in range(len(info)):
        v = int(np.where(inside, -2.0, best).argmax())
        inside[v] = True
        if best[v] < LEAST_INFORMATION:
            parent[v] = -1
        nearer = ~inside & (info[v] > best)
        best[nearer], parent[nearer] = info[v][nearer], v
    return parent


def _down(parent: np.ndarray) -> list[int]:
    """Voters, each after its parent."""
    out: list[int] = []
    while len(out) < len(parent):
        out += [v for v in range(len(parent)) if v not in out and (parent[v] < 0 or parent[v] in out)]
    return out


def _rates(both: np.ndarray, mass: np.ndarray, parent: np.ndarray, start: np.ndarray) -> np.ndarray:
    """[label, vote of the parent, voter]: firing rates. The starting rates count as some observations, so that no voter
    can change sides."""
    out, voters = np.empty((2, 2, len(parent))), np.arange(len(parent))
    for label in range(2):
        n1 = np.diag(both[label])
        fired = np.where(parent >= 0, n1[parent], 0)
        together = np.where(parent >= 0, both[label][parent, voters], 0)
        for vote, (n, k) in enumerate(((mass[label] - fired, n1 - together), (fired, together))):
            out[label, vote] = (k + START_COUNTS * start[label]) / (n + START_COUNTS)
    return out


def signals(hits: list[dict], words: int, shouts: int, noise: int) -> tuple[float, ...]:
    """What the classifier sees beside the single entries."""
    total = sum(h["n"] for h in hits)
    return (1.0, np.log1p(total), np.log1p(len(hits)), min(5.0, 100 * total / (words + 20)), min(2.0, 50 * shouts / (words + 20)), min(2.0, 10 * noise / (words + 20)))


SIGNALS, HIT = 6, 0.2


@dataclass
class Features:
    """Rows of SIGNALS dense values, and the entries that each row holds, each with the value HIT."""

    dense: np.ndarray
    row: np.ndarray
    entry: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Features:
        dense = np.array([signals(r["hits"], r["words"], r["shouts"], r["noise"]) for r in rows], float).reshape(-1, SIGNALS)
        row = np.repeat(np.arange(len(rows)), [len(r["hits"]) for r in rows]) if rows else np.empty(0, np.int64)
        return cls(dense, row, np.array([h["entry"] for r in rows for h in r["hits"]], np.int64))

    def logits(self, w: np.ndarray) -> np.ndarray:
        """w: a weight for each entry, then one for each signal."""
        return self.dense @ w[len(w) - SIGNALS :] + HIT * np.bincount(self.row, w[self.entry], len(self.dense))


def fit_linear(x: Features, y: np.ndarray, entries: int, rounds: int = 600, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by AdaGrad over the whole (bounded) sample."""
    w, g2 = np.zeros(entries + SIGNALS), np.full(entries + SIGNALS, 1e-8)
    # Either label has half the weight.
    share = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x.logits(w), -50, 50)))
        back = share * (p - y)
        g = np.concatenate([HIT * np.bincount(x.entry, back[x.row], entries), x.dense.T @ back]) + l2 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return w


def _perhaps_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with a known id, and few others: a bit map of hashed ids, bounded in size, is broadcast."""
    if rows.schema["id"].dataType != known.schema["id"].dataType:
        return rows
    at = F.pmod(F.xxhash64(F.lit("known"), "id"), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    bits = known.select(at.alias("at")).select(F.shiftright("at", 6).alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    found = rows.where("id IS NOT NULL").withColumn("at", at).withColumn("cell", F.shiftright("at", 6)).join(F.broadcast(bits), "cell")
    return found.where(F.col("bits").bitwiseAND(bit) != 0).select("id", "text")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, score): a score from 0 to 1 for every document, learned from `labels` (id, 0 / 1).

    Lexicon entries (words and beginnings of words) are those whose labelled documents, all of them counted, are mostly
    toxic; their number is not bounded. Voters look at all documents; the label model is fitted to the counts of their vote patterns, and of given labels as one more
    voter, over the whole corpus; posterior labels train the classifier, of a sample of labelled and of other rows. Only text enters a score. Null and empty texts get the score of a text without hits. Null ids and
    labels are not learned from; an id labelled twice counts by its mean label. With no labels of either kind every
    score is 0. Other columns are ignored, so their names cannot clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg((F.avg("y") > 0.5).alias("toxic"))
    known = scratch.keep(known, "known")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("toxic"), "id"), 11) / F.lit(float(1 << 53))
    counted = _perhaps_known(rows, known).join(known, "id").select("toxic", "text").mapInArrow(_count_entries, "entry string, toxic long, clean long")
    counted = counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    base = min(sample_rows, n[True]) / (min(sample_rows, n[True]) + min(sample_rows, n[False]))
    clean_weight = min(1.0, sample_rows / n[False]) / min(1.0, sample_rows / n[True])
    share = F.col("toxic") / (F.col("toxic") + F.col("clean") * clean_weight + 0.5)
    surprise = F.col("toxic") * F.log(share / base)
    good = counted.where((share >= LEAST_SHARE) & (surprise >= LEAST_SURPRISE)).orderBy(surprise.desc(), "entry").select("entry")
    lexicon = {r["entry"]: i for i, r in enumerate(good.collect())}

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("entry", T.IntegerType()), T.StructField("n", T.IntegerType())]))), *(T.StructField(c, T.LongType()) for c in ("words", "shouts", "noise"))])
    found = rows.select("id", utf8(F.col("text")).alias("utf8")).mapInArrow(_find_hits(spark.sparkContext.broadcast(lexicon)), schema)
    found = scratch.keep(found, "found")

    size = len(lexicon)
    # At most 3 * 2 ** VOTERS rows: what the voters say of a document, and the label it was given.
    voted = scratch.keep(found.mapInArrow(_vote(size), T.StructType([*schema.fields, T.StructField("votes", T.StringType())])).join(known, "id", "left").withColumn("given", F.coalesce(F.col("toxic").cast("int"), F.lit(NO_LABEL))), "voted")
    seen = voted.groupBy("votes", "given").count().orderBy("votes", "given").collect()
    patterns, given = _patterns([r["votes"] for r in seen]), np.array([r["given"] for r in seen])
    counts = np.array([r["count"] for r in seen], float)
    start = np.stack([((patterns[given == k] * counts[given == k, None]).sum(axis=0) + 0.5) / (counts[given == k].sum() + 1) for k in (0, 1)])
    model = LabelModel.fit(patterns, given, counts, start, n[True] / (n[True] + n[False]))

    # The classifier learns the posteriors of labelled rows and of others, about sample_rows of either side of each.
    p = model.posterior(patterns, given)
    kinds = [(r["votes"], r["given"], float(q), (r["given"] if r["given"] != NO_LABEL else 2 + (q > 0.5))) for r, q in zip(seen, p, strict=True)]
    sizes = Counter()
    for (*_, side), c in zip(kinds, counts, strict=True):
        sizes[side] += c
    rated = [(v, g, q, min(1.0, sample_rows / float(sizes[side]))) for v, g, q, side in kinds]
    rated = F.broadcast(spark.createDataFrame(rated, "votes string, given int, p double, rate double"))
    taught = voted.join(rated, ["votes", "given"]).where(draw < F.col("rate")).select("hits", "words", "shouts", "noise", "p").collect()
    weights = fit_linear(Features.of(taught), np.array([r["p"] for r in taught]), size)

    shared = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            z = Features.of(batch.select(["hits", "words", "shouts", "noise"]).to_pylist()).logits(w)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))), pa.float64())], ["id", "score"])

    out = found.mapInArrow(score, T.StructType([schema["id"], T.StructField("score", T.DoubleType())]))
    return out.withColumnRenamed("id", id_col)


def _vote(size: int):
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["hits", "words", "shouts", "noise"]).to_pylist()
            said = pa.array(["".join(map(str, votes(r["hits"], r["words"], r["shouts"], r["noise"], size))) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, said], [*batch.schema.names, "votes"])

    return vote


def _patterns(said: list[str]) -> np.ndarray:
    return np.array([[int(v) for v in x] for x in said], float).reshape(-1, VOTERS)
