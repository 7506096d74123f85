"""The registered queries as they are registered: their learning rules, columns and constants, at the smallest scale."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from driftwell.llm import queries


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows(spark, sf_dir, name):
    out = queries.queries()[name](spark, sf_dir)
    return out.columns, out.collect()


def part(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_source_mixing(spark, sf_dir, docs):
    columns, out = rows(spark, sf_dir, "op1_source_mixing")
    assert set(columns) >= {"doc_id", "size", "source_size", "target", "taken"} and len(out) == len(docs)
    sizes, targets, taken = Counter(), {}, Counter()
    for r in out:
        assert r["size"] == n_words(docs[r.doc_id].text) and 0 <= r.taken <= 2 * r["size"]
        sizes[docs[r.doc_id].source] += r["size"]
        taken[docs[r.doc_id].source] += r.taken
        targets.setdefault(docs[r.doc_id].source, r.target)
    # Weights 5, 2, 1 by code point, filled up to twice each source's size.
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, left = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        share = (left - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in order:
        want = 2 * sizes[s] if s in capped else share * weight[s]
        assert targets[s] == pytest.approx(want) and abs(taken[s] - want) <= 0.01 * want + 10
    for r in out:
        assert r.source_size == sizes[docs[r.doc_id].source]


def test_sharding(spark, sf_dir, docs):
    _, out = rows(spark, sf_dir, "op5_sharding")
    load, slots = Counter(), defaultdict(list)
    for r in out:
        text = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None) and 0 <= r.shard < 16
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(out) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in out)
    assert max(load.values()) - min(load.get(s, 0) for s in range(16)) <= max(2 * largest, 0.1 * sum(load.values()) / 16)


def test_language_id(spark, sf_dir, docs):
    _, out = rows(spark, sf_dir, "op8_language_id")
    right = Counter()
    for r in out:
        d = docs[r.doc_id]
        assert r.held_out == (part(r.doc_id, 5) == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", d.text or ""))
        if r.held_out and d.lang and r.lang_pred != "und":
            right[r.lang_pred == d.lang] += 1
    assert len(out) == len(docs) and right[True] >= 0.9 * sum(right.values()) > 0


def test_toxicity(spark, sf_dir, docs):
    _, out = rows(spark, sf_dir, "op6_toxicity")
    assert len(out) == len(docs)
    for r in out:
        assert r.held_out == (part(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_toxicity_never_sees_held_out_labels(spark, sf_dir, tmp_path):
    """Other labels of the held-out rows change no score."""
    from pyspark.sql import functions as F

    for name in ("documents", "labels"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "labels":
            table = table.withColumn("toxic", F.when(queries.id_part(3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast(table.schema["toxic"].dataType))
        table.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    score = lambda d: {r.doc_id: round(r.score, 9) for r in queries.op6_toxicity(spark, d).collect()}
    assert score(sf_dir) == score(str(tmp_path))


def test_fingerprints(spark, sf_dir, docs):
    _, out = rows(spark, sf_dir, "op9_fingerprints")
    order = sorted(docs)
    by_id, marks = {r.doc_id: r for r in out}, defaultdict(set)
    for i, k in enumerate(order):
        own, after = docs[k].text or "", docs[order[(i + 1) % len(order)]].text or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = by_id[k]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        marks[own].add(r.fingerprint)
    assert len(out) == len(docs) and all(len(m) == 1 for m in marks.values())


@pytest.mark.parametrize("name", ["op2_lm_scoring", "op7_line_dedup"])
def test_one_row_for_each_document(spark, sf_dir, docs, name):
    _, out = rows(spark, sf_dir, name)
    assert sorted(r.doc_id for r in out) == sorted(docs)
