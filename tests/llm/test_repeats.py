import hashlib
import random

import numpy as np
import pytest

from driftwell.llm import repeats as R


def brute(docs):
    key = lambda i: R.NO_ID if i is None else i
    first = {}
    for i, t in docs:
        for p in range(len(t or b"") - 49):
            first[t[p : p + 50]] = min(first.get(t[p : p + 50], R.NO_ID), key(i))
    out = []
    for i, t in docs:
        t = t or b""
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < key(i):
                gone[p : p + 50] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, **settings):
    df = spark.createDataFrame([(i, None if t is None else t.decode(), 1) for i, t in docs], "doc_id long, text string, block int").repartition(4)
    rows = R.repeated_spans(df, **settings).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=repr)


@pytest.mark.parametrize("hot_blocks", [R.HOT_BLOCKS, 0])
def test_against_all_windows(spark, hot_blocks):
    """With 0, every gram in several blocks counts as hot."""
    rng = random.Random(3)
    pool = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(20, 140))) for _ in range(12)]
    docs = [(rng.randint(0, 40), b"".join(rng.choice(pool) + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6)))) for _ in range(60)]
    docs += [(None, pool[0] * 2), (7, None), (99, b""), (100, b"a" * 300), (101, b"a" * 2000), (3, "é".encode() * 60), (4, b"x" + "é".encode() * 60), (0, bytes(rng.choice(b"abcdefgh") for _ in range(30_000)))]
    docs.append((102, docs[-1][1][5000:25_000]))
    assert run(spark, docs, hot_blocks=hot_blocks) == brute(docs)


def test_one_passage_in_many_surroundings(spark):
    """Its gram is hot; the passage is shared to different lengths on either side."""
    rng = random.Random(9)
    noise = lambda n: bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(n))
    passage = noise(90)
    docs = [(i, noise(rng.randint(0, 60)) + passage[rng.randint(0, 35) : rng.randint(60, 90)] + noise(rng.randint(0, 60))) for i in range(2500)]
    want = brute(docs)
    assert sum(r[2] > 0 for r in want) > 500
    assert run(spark, docs, hot_blocks=1) == want


def test_empty_table(spark):
    assert run(spark, []) == []


def test_repeats_are_all_the_maximal_ones():
    """Of one anchor: all pairs' common stretches are in some reported set, and sets are maximal on both sides."""
    rng = np.random.default_rng(2)
    gram = rng.integers(97, 123, R.GRAM).astype(np.uint8)
    ctx = np.zeros((40, R.WIDTH), np.uint8)
    ctx[:, : R.LEFT] = rng.integers(97, 99, (40, R.LEFT))
    ctx[:, : R.LEFT - 6] = ctx[rng.integers(0, 3, 40), : R.LEFT - 6]
    ctx[:, R.LEFT : R.LEFT + R.GRAM] = gram
    ctx[:, R.LEFT + R.GRAM :] = rng.integers(97, 99, (40, R.LENGTH - R.GRAM))
    ctx[20:] = ctx[:20]
    ctx[20:, R.LEFT + 40 :] = 122
    ctx[:3, : R.LEFT] = ctx[20:23, : R.LEFT]
    ctx = np.unique(ctx, axis=0)
    n = len(ctx)
    bucket = R.Bucket(ctx, np.full(n, R.LEFT, np.uint8), np.full(n, R.LENGTH, np.uint8))
    found = [(left, right, set(bucket.sa[m].tolist())) for left, right, m in bucket.repeats()]
    text = [bytes(r) for r in ctx]

    def common(i, j):
        right = next((k for k in range(R.LENGTH) if text[i][R.LEFT + k] != text[j][R.LEFT + k]), R.LENGTH)
        left = next((k for k in range(R.LEFT) if text[i][R.LEFT - 1 - k] != text[j][R.LEFT - 1 - k]), R.LEFT)
        return left, right

    seen = 0
    for i in range(n):
        for j in range(i):
            left, right = common(i, j)
            if left + right >= R.LENGTH:
                seen += 1
                assert any((a, b) == (left, right) and {i, j} <= m for a, b, m in found)
    assert seen
    for left, right, members in found:
        pairs = [common(i, j) for i in members for j in members if i < j]
        assert min(a for a, _ in pairs) == left and min(b for _, b in pairs) == right
        outside = [k for k in range(n) if k not in members and all(common(k, i)[0] >= left and common(k, i)[1] >= right for i in members)]
        assert not outside


def test_intervals_by_stack_scan():
    assert sorted(R.intervals([2, 2, 0, 5])) == [(0, 0, 4), (2, 0, 2), (5, 3, 4)]
