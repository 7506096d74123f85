import random

import numpy as np

from driftwell.llm import near_duplicates as N
from driftwell.llm.linking import components
from driftwell.llm.shared import Scratch


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(rows):
    """(id, size, component, kept) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, row string, key int")
    out = N.near_duplicates(df.repartition(3))
    return sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_edge_cases(spark):
    rows = [(3, "a b c d e f"), (1, "A b\tc d\ne f"), (2, None), (4, ""), (5, " \n "), (6, "one two"), (7, "ONE two"), (8, "one two three"), (3, "a b c d e f"), (None, "one two"), (9, "é É é É é"), (10, "e " * 30_000)]
    assert run(spark, rows) == brute(rows)


def test_copies_with_edits_against_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    assert run(spark, rows) == brute(rows)


def test_buckets_larger_than_one_block(spark, monkeypatch):
    """The workers get their own copy of the module, so the plan's part counts are what changes here."""
    monkeypatch.setattr(N, "TOGETHER", 3)
    test_copies_with_edits_against_all_pairs(spark)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_kept_documents(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "a b c d e f", "t"), (3, None, "u"), (1, "a b c d e f", "s"), (1, "x y z w v u", "s")], "doc_id long, text string, row string")
    out = N.keep_distinct(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "a b c d e f"), (1, "x y z w v u"), (3, "")]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    for share in (0.95, 0.85, 0.75):
        keep = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:keep], rng.integers(0, 2**63, len(a) - keep).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = N.odd_sketches(N.samples([a, b]))
        assert abs(N.estimate(int(np.bitwise_count(x ^ y).sum())) - true) < 0.1


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = dict(components(Scratch(spark, "t"), edges, "c").collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_many_rows_without_an_id(spark):
    """Classes that only rows without an id hold, in one bucket: each is found by its text."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    rows = [(5, " ".join(base))]
    for i in range(40):
        copy = list(base)
        copy[rng.randrange(80)] = rng.choice(vocabulary)
        rows += [(None if i % 4 else 7, " ".join(copy))] * (1 + i % 3)
    rows += [(None, " ".join(rng.choice(vocabulary) for _ in range(20))) for _ in range(30)]
    assert run(spark, rows) == brute(rows)


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "`doc.id` long, `the.text` string")
    assert sorted(r["component_id"] for r in N.near_duplicates(df, "doc.id", "the.text").collect()) == [1, 1]
    assert N.keep_distinct(df, "doc.id", "the.text").count() == 1
