import re
from collections import Counter

import corpus_pipeline as P
from driftwell.llm import language_id, mixing, sharding
from driftwell.llm.shared import Scratch
from tests.compare import assert_same
from tests.llm.test_near_duplicates import brute


def plain_language_id(trees, rows):
    out = []
    for r in rows:
        text = r.text or ""
        bits = trees.score([text.encode()])[0]
        share = 1 / sum(2.0 ** max(min(bits) - b, -1000) for b in bits)
        if re.search(r"[^\W\d_]", text) and share >= 0.5:
            out.append(r)
    return out


def plain_near_duplicates(rows):
    kept = {(i, k) for (i, _, _, k) in brute([(r.doc_id, r.text) for r in rows])}
    return [r for r in rows if (r.doc_id, True) in kept]


def plain_decontamination(items, rows):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {n: set() for n in range(1, 11)}
    for t in items:
        w = split(t)
        n = min(10, len(w))
        windows.get(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    hit = lambda w: any(tuple(w[i : i + n]) in found for n, found in windows.items() for i in range(len(w) - n + 1))
    return [r for r in rows if not hit(split(r.text))]


def plain_mixing(taken, rows):
    """Ids and sizes are unique here, so each row's own share decides."""
    out = []
    for r in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        out += [r] * (int(taken[r.doc_id] / size + 0.5) if size else 1)
    return out


def test_every_stage_against_a_plain_version(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: stages.append((name, out := keep(self, df, name), out.collect() if self.root.split("/")[-1].startswith("corpus") else None)) or out)
    last = P.run(spark, sf_dir).collect()
    monkeypatch.undo()
    done = {name.split("-", 1)[1]: (df, rows) for name, df, rows in stages if rows is not None}
    assert list(done) == [name for name, _ in P.STAGES]
    bag = lambda rows: Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows)
    rows = docs.collect()
    assert len({r.doc_id for r in rows}) == len(rows)

    assert bag(done["language_id"][1]) == bag(plain_language_id(language_id.learn(docs), rows))
    rows = done["language_id"][1]
    assert bag(done["near_duplicates"][1]) == bag(plain_near_duplicates(rows))
    rows = done["near_duplicates"][1]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert bag(done["decontamination"][1]) == bag(plain_decontamination(items, rows))
    rows = done["decontamination"][1]
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()}
    assert bag(done["mixing"][1]) == bag(plain_mixing(taken, rows))
    rows = done["mixing"][1]
    assert bag(last) == bag(rows)
    placed = {(r.doc_id, r.shard) for r in sharding.shards(spark.createDataFrame(rows, docs.schema), P.SHARDS).collect()}
    assert {(r.doc_id, r.shard) for r in last} == placed


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= 2 * docs.count()
        if name != "mixing":
            assert out.count() >= 0.6 * docs.count()
        docs = out
    last = P.run(spark, sf_dir)
    assert last.columns == [*docs.columns, "shard"] and last.count() == docs.count()


def test_stages_take_odd_tables(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "some words to be read here", "en", "s", 3), (1, "some words to be read here", "en", "s", 3)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in P.STAGES:
            assert stage(spark, df, sf_dir).count() <= 2 * len(rows)


def test_registered_sql(spark, sf_dir):
    from driftwell.llm import queries

    for name, sql in queries.oracle_sql().items():
        assert_same(queries.queries()[name](spark, sf_dir), sql, sf_dir)
