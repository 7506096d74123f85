import re
import zlib
from collections import defaultdict

import pytest

from driftwell.llm.mixing import mix, mixed_documents
from driftwell.llm.sharding import shards, with_shard

SCHEMA = "doc_id long, text string, source string, n long, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], SCHEMA)


def level(words: dict, weights=(5, 2, 1), share=1.5, epochs=2):
    """Targets by repeated resharing of the excess."""
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, set(order)
    while left:
        rest = share * sum(words.values()) - sum(full.values())
        want = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if want[s] > epochs * words[s]]
        if not over:
            return full | want
        for s in over:
            full[s] = epochs * words[s]
            left.discard(s)
    return full


def sample():
    rows = []
    for i in range(400):
        source = [None, "a", "b", "é", "Z", ""][i % 6] if i % 3 else "a"
        rows.append((i, " ".join(["w"] * ((i * 37) % 50)), source))
    return rows + [(None, "x y", "a"), (5, "dup dup", "b"), (5, "dup dup", "b"), (900, None, "b"), (901, " \n\t", "a"), (902, "w " * 20_000, "hot")]


def test_mix_meets_targets(spark):
    rows = sample()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = defaultdict(int)
    for _, t, s in rows:
        words[s] += size(t)
    want = level(dict(words))
    out = mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    taken = defaultdict(int)
    for r in out:
        assert r.taken <= 2 * r.size and r.source_size == words[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 6
    again = mix(frame(spark, rows).repartition(7)).collect()
    assert sorted(out, key=repr) == sorted(again, key=repr)


def test_mixed_documents(spark):
    rows = sample()
    out = mixed_documents(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "source", "n", "block"]
    copies = defaultdict(int)
    for r in out.collect():
        copies[r.doc_id] += 1
    assert copies[900] == copies[901] == 1
    assert max(v for k, v in copies.items() if k != 5) <= 2


def test_empty_tables(spark):
    assert mix(frame(spark, [])).collect() == []
    assert mixed_documents(frame(spark, [])).collect() == []
    assert shards(frame(spark, []), 4).collect() == []


@pytest.mark.parametrize("n", [1, 16])
def test_shards(spark, n):
    rows = [(i, f"text {i} " * (i % 17), "s") for i in range(3000)]
    rows += [(10_000 + i, "the same text over and over", "s") for i in range(2000)]
    rows += [(None, None, "s"), (1, None, "s"), (1, "", "s"), (1, "", "s"), (7, "long " * 2000, "s")]
    out = shards(frame(spark, rows), n).collect()
    assert len(out) == len(rows)
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in out) == want
    load, slots, where = [0] * n, defaultdict(list), defaultdict(set)
    for r in out:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load) - min(load) <= 0.05 * sum(load) / n
    # Only the overfull group is cut; null and empty texts are two groups of one checksum.
    assert sum(len(s) > 1 for crc, s in where.items() if crc) <= 1
    again = with_shard(frame(spark, rows), n)
    assert again.columns == ["doc_id", "text", "source", "n", "block", "shard"] and again.count() == len(rows)
