import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from driftwell.llm import decontamination, fingerprints, language_id, lm_scoring, toxicity
from driftwell.llm.words import space_words, split_all


# Benchmark decontamination


def test_hits_and_cleaning(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item!"), (2, "Short item!"), (3, ""), (4, None), (None, "nameless thing")], "item_id long, text string")
    rows = [
        (1, "x ONE two, three four five six seven eight nine ten. y", "a"),
        (2, "a short-item here; short item", "a"),
        (3, None, "a"),
        (4, "", "a"),
        (5, "one two three four five six seven eight nine", "a"),
        (6, "z one two three four five six seven eight nine ten eleven " * 2 + "w " * 30_000, "a"),
        (None, "nameless thing nameless, thing", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    for size in (1 << 20, 40):  # one part, and several passes
        out = {r.row.doc_id: (r.n_words, [tuple(s) for s in r.spans], list(r["items"])) for r in decontamination.benchmark_hits(docs, bench, part_bytes=size).collect()}
        assert out[1] == (12, [(1, 11)], ["1"])
        assert out[2] == (6, [(1, 3), (4, 6)], ["2"])
        assert out[3] == out[4] == (0, [], [])
        assert out[5] == (9, [], [])
        assert out[6][:2] == (30_024, [(1, 12), (13, 24)])
        assert out[None][1:] == ([(1, 3)], [""])  # a no-break space is part of a word
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5]
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[1] == "x . y" and cut[2] == "a  here; " and cut[3] is None and cut[5] == rows[4][1]
    assert decontamination.benchmark_hits(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0
    assert decontamination.benchmark_hits(docs.limit(0), bench).count() == 0


# Language identification


def ppm(texts, text):
    """Code length by the definition, with dicts."""
    seen = [{} for _ in range(4)]
    for t in texts:
        p = b"\n\n\n" + t
        for i in range(3, len(p)):
            for k in range(4):
                seen[k].setdefault(p[i - k : i], Counter())[p[i]] += 1
    bits, p = 0.0, b"\n\n\n" + text
    for i in range(3, len(p)):
        for k in (3, 2, 1, 0):
            c = seen[k].get(p[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if p[i] in c:
                bits -= math.log2(c[p[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    rng = random.Random(1)
    texts = {k: [bytes(rng.choice(a) for _ in range(rng.randint(0, 60))) for _ in range(6)] for k, a in (("aa", b"abcab "), ("bb", b"bcdx "))}
    trees = language_id.ContextTrees.learn(texts)
    probe = [bytes(rng.choice(b"abcdx zq\n") for _ in range(n)) for n in (0, 1, 2, 3, 50, 2000)]
    got = trees.score(probe)
    for t, row in zip(probe, got, strict=True):
        assert row == pytest.approx([ppm(texts[k], t) for k in trees.languages], abs=1e-2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trees = language_id.learn(docs.where("doc_id % 5 <> 0"))
    out = language_id.identify(docs.where("doc_id % 5 = 0").withColumn("lang_pred", F.lit("x")), trees)
    assert out.where(F.col("row.lang") == F.col("lang_pred")).count() >= 0.98 * out.count()


def test_texts_without_language(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ... !", "en"), (4, "the cat " * 20_000, "en"), (5, "abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.learn(docs)
    out = {r.row.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, trees).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4] == out[5] == ("en", 1.0)
    assert sorted(r.doc_id for r in language_id.keep_identified(docs, trees).collect()) == [4, 5]
    none = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), trees).count() == 0


# Fingerprints


def test_many_parts_of_large_texts(spark, monkeypatch):
    """Bytes of a text times samples of all parts are beyond an int."""
    monkeypatch.setattr(fingerprints, "SAMPLES_PER_PART", 1 << 20)
    rows = [(i, f"text {i} " * 50) for i in range(40)]
    out = fingerprints.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_chars) for r in out) == [(i, len(t)) for i, t in rows]


def test_edited_neighbours(spark):
    rng = random.Random(2)
    rows = [(i * 3, "".join(rng.choice("abcdé 漢𝄞") for _ in range(rng.randint(0, 400)))) for i in range(200)] + [(None, "last"), (3, "tie"), (900, None), (901, "long " * 20_000), (902, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, tail string").repartition(5)
    out = fingerprints.edited_neighbours(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for i, (d, t) in enumerate(order):
        t, y = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + y[: len(t) // 2]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=repr) == sorted(want, key=repr)
    long = [r for r in out if 200 <= r.n_chars < 1000]
    assert 0.35 < np.mean([r.near_edited for r in long]) < 0.65 and np.mean([r.near_next for r in long]) < 0.1
    assert fingerprints.edited_neighbours(df.limit(0)).collect() == []
    one = fingerprints.edited_neighbours(df.where("doc_id = 901")).collect()
    assert one[0].near_next == 1.0


def test_fingerprints_follow_edits(spark):
    rng = random.Random(5)
    x = "".join(rng.choice("etaoin shrdlu") for _ in range(1500))
    texts = [x, x[:700] + "q" + x[700:], x[:20] + x[21:], x[::-1], "", x]
    marks = fingerprints.embedding().fingerprints(texts)
    near = [float(fingerprints.likeness(marks[:1], marks[i : i + 1])[0]) for i in range(6)]
    assert near[5] == 1.0 and near[1] > 0.8 and near[2] > 0.8 and near[3] < 0.1 and near[4] < 0.1
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, x), (50, None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in fingerprints.edit_components(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 0, None: 0, 50: 50}


def test_edit_components_up_to_the_threshold(spark):
    rng = random.Random(9)
    letters = "etaoin shrdlucmfgyp"

    def edited(x, n):
        x = list(x)
        for _ in range(n):
            at = rng.randrange(len(x))
            x[at : at + rng.randrange(2)] = rng.choice(["", rng.choice(letters)])
        return "".join(x)

    rows, rates = [], {}
    for i in range(60):
        x = "".join(rng.choice(letters) for _ in range(1000))
        rates[2 * i] = (0.02, 0.05, 0.1)[i % 3]
        rows += [(2 * i, x), (2 * i + 1, edited(x, int(1000 * rates[2 * i])))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = df.where("doc_id % 2 = 0").alias("x").join(df.alias("y"), F.expr("y.doc_id = x.doc_id + 1"))
    near = {r[0] for r in pairs.where("levenshtein(x.text, y.text) <= 0.1 * greatest(length(x.text), length(y.text))").select("x.doc_id").collect()}
    got = {r.doc_id: r.component_id for r in fingerprints.edit_components(df).collect()}
    assert len(got) == len(rows) and all(got[i] == i for i in rates)  # unrelated texts stay apart
    for rate in (0.02, 0.05, 0.1):
        true = [i for i in near if rates[i] == rate]
        assert len(true) >= 15 and sum(got[i + 1] == i for i in true) >= 0.9 * len(true)


# Toxicity


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(6)
    common = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        text = [rng.choice(common) for _ in range(40)]
        if bad:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(["badone", "vile", f"grimst{rng.choice('abcdef')}x"])
        rows.append((i, " ".join(text), "s"))
        if i % 2:
            labels.append((i, int(bad)))
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "badone vile", "s"), (1002, "word1 " * 30_000, "s")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, words string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, known).collect()}
    assert len(score) == len(rows)
    held = [i for i in range(900) if not i % 2]
    assert all(score[i] >= 0.7 for i in held if i % 3 == 0) and all(score[i] < 0.5 for i in held if i % 3)
    assert score[1000] == score[1001] < 0.5 and score[1002] < 0.5 and score[None] >= 0.7
    assert {r.score for r in toxicity.toxicity(docs, known.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), known).count() == 0


def distinct_votes(votes, given):
    rows, counts = np.unique(np.column_stack([votes, given]), axis=0, return_counts=True)
    return rows[:, :-1], rows[:, -1].astype(int), counts.astype(float)


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(0)
    n = 20_000
    y = rng.random(n) < 0.2
    right = [0.95, 0.9, 0.8, 0.55]
    votes = np.stack([np.where(rng.random(n) < r, y, ~y) for r in right], axis=1).astype(float)
    told = np.where(rng.random(n) < 0.97, y, ~y)
    given = np.where(rng.random(n) < 0.1, told, toxicity.NO_LABEL)
    start = np.tile(np.array([[0.2], [0.7]]), (1, 4))
    model = toxicity.LabelModel.fit(*distinct_votes(votes, given), start, 0.3)
    free = np.full(n, toxicity.NO_LABEL)
    assert ((model.posterior(votes, free) > 0.5) == y).mean() > 0.93
    assert model.accuracy() == pytest.approx(right, abs=0.03)
    assert model.told == pytest.approx([0.03, 0.97], abs=0.03)
    # Two copies of a voter hang together and count once.
    copied = np.hstack([votes, votes[:, 3:], votes[:, 3:]])
    twice = toxicity.LabelModel.fit(*distinct_votes(copied, given), np.tile(np.array([[0.2], [0.7]]), (1, 6)), 0.3)
    assert sum(twice.parent[v] in (3, 4, 5) for v in (3, 4, 5)) == 2
    assert ((twice.posterior(copied, free) > 0.5) == (model.posterior(votes, free) > 0.5)).mean() > 0.99


def test_posterior_against_all_labels():
    """The joint probability of votes and given label, written out."""
    rng = np.random.default_rng(1)
    votes = (rng.random((300, 4)) < 0.4).astype(float)
    votes[:, 2] = np.where(rng.random(300) < 0.9, votes[:, 1], votes[:, 2])
    given = rng.choice([toxicity.NO_LABEL, 0, 1], 300)
    model = toxicity.LabelModel.fit(*distinct_votes(votes, given), np.tile(np.array([[0.2], [0.6]]), (1, 4)), 0.3, rounds=4)
    assert model.parent[2] == 1 or model.parent[1] == 2
    for v, g, p in zip(votes, given, model.posterior(votes, given), strict=True):
        joint = []
        for label, prior in enumerate((1 - model.prior, model.prior)):
            q = prior
            for i, x in enumerate(v):
                above = int(v[model.parent[i]]) if model.parent[i] >= 0 else 0
                fire = model.fires[label, above, i]
                q *= fire if x else 1 - fire
            if g != toxicity.NO_LABEL:
                q *= model.told[label] if g else 1 - model.told[label]
            joint.append(q)
        assert p == pytest.approx(joint[1] / sum(joint), rel=1e-6)


# LM scoring


def test_gradients():
    rng = np.random.default_rng(0)
    net = lm_scoring.Window.fresh()
    word, around = rng.integers(0, lm_scoring.WORDS, 32), rng.integers(0, lm_scoring.WORDS + 1, (4, 32))
    total = sum(np.exp(net.log_likelihood(np.array([k]), around[:, :1]))[0] for k in range(lm_scoring.WORDS))
    assert total == pytest.approx(1, abs=1e-4)
    before = net.log_likelihood(word, around).mean()
    memory = [np.full_like(a, 1e-6) for a in net.arrays()]
    for _ in range(5):
        net.train(word, around, memory)
    assert net.log_likelihood(word, around).mean() > before + 1
    assert np.array_equal(lm_scoring.Window.of(net.flat()).words, net.words)


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    net = lm_scoring.Window.fresh()
    for a in net.arrays():
        a += rng.normal(0, 0.3, a.shape).astype(np.float32)
    wide = lm_scoring.Window(*(a.astype(np.float64) for a in net.arrays()))
    word, around = rng.integers(0, lm_scoring.WORDS, 40), rng.integers(0, 40, (4, 40))
    loss = lambda: -wide.log_likelihood(word, around).mean()
    g_embed, g_bias, g_classes, g_words = wide.gradients(word, around)
    checked = [(wide.bias, g_bias), (wide.classes, g_classes), *((wide.words[c], g) for c, g in g_words[:3])]
    for k, (some, g) in enumerate(g_embed):
        checked.append((wide.embed[k, int(some[0])], g[0]))
    for a, g in checked:
        for i in rng.choice(a.size, 5):
            at, step = np.unravel_index(i, a.shape), 1e-5
            was = a[at]
            a[at] = was + step
            up = loss()
            a[at] = was - step
            down = loss()
            a[at] = was
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("block", [1, 7, 512, 10_000])
def test_steps_on_texts(monkeypatch, block):
    """A step on places of a text is the step on its words and those around them, however rows lie in blocks."""
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 300, 400).astype(np.uint16)
    ids[::9] = lm_scoring.WORDS
    at = np.flatnonzero(ids != lm_scoring.WORDS)
    at = at[(at > 1) & (at < 398)]
    nets = [lm_scoring.Window.fresh(), lm_scoring.Window.fresh()]
    memories = [[np.full_like(a, 1e-6) for a in net.arrays()] for net in nets]
    for _ in range(3):
        monkeypatch.setattr(lm_scoring, "BLOCK", block)
        nets[0].learn(ids, at, memories[0])
        monkeypatch.setattr(lm_scoring, "BLOCK", 512)
        nets[1].train(ids[at], lm_scoring._around(ids, at), memories[1])
    for a, b, fresh in zip(nets[0].arrays(), nets[1].arrays(), lm_scoring.Window.fresh().arrays(), strict=True):
        assert np.abs(a - b).max() < 1e-3 < np.abs(a - fresh).max()
    unseen = np.setdiff1d(np.arange(lm_scoring.WORDS), ids)
    assert np.array_equal(nets[0].embed[:, unseen], lm_scoring.Window.fresh().embed[:, unseen])


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_numbers_of_whole_batches(kind):
    """Words cut and numbered a batch at a time are those of one text after another, whatever the bytes."""
    rng = random.Random(3)
    texts = [None, b"", b" ", b"  The the\tx ", b"\xff A\xfe\x00 \x1c \xc2\x85 \xc2\xa0", *(bytes(rng.choices(range(256), k=rng.randrange(60))) for _ in range(500))]
    texts += [bytes(rng.choices(b" \t\n\x0b\x0c\r\x1cAbz\xc3", k=rng.randrange(40))) for _ in range(500)]
    plain = [space_words(t) if t else [] for t in texts]
    words, counts = split_all(pa.array([b"left out", *texts], kind).slice(1))
    assert words.to_pylist() == [w for t in plain for w in t] and counts.tolist() == [len(t) for t in plain]
    assert split_all(pa.array([], kind))[0].to_pylist() == []

    numbers = lm_scoring.Vocabulary([b"a", b"the"], known=[(b"b", 5, -100), (b"z", 9, -7)])
    ids, at, counts, shares, rest = numbers.numbered(pa.array(texts, kind), with_rest=True)
    own, known = {b"a": 0, b"the": 1}, {b"b": -100, b"z": -7}
    assert counts.tolist() == [len(t) for t in plain] and shares.tolist() == [sum(known.get(w, 0) for w in t) for t in plain]
    assert [{x["word"]: x["n"] for x in r} for r in rest.to_pylist()] == [Counter(w for w in t if w not in own and w not in known) for t in plain]
    alone = [numbers.numbered([t])[0] for t in texts]
    assert np.array_equal(ids, np.concatenate([alone[0], *(a[2:] for a in alone[1:])]))
    flat = [w for t in plain for w in t]
    assert all(int(i) == own.get(w, lm_scoring.WORDS - lm_scoring.HASHED + {b"b": 5, b"z": 9}.get(w, (xxhash.xxh64_intdigest(w, 42) >> 1) % lm_scoring.HASHED)) for i, w in zip(ids[at], flat, strict=True))
    counted = Counter()
    for b in lm_scoring._count_words(iter([pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["utf8"])] * 2)):
        counted.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    assert counted == Counter(flat * 2)


def test_large_weights_stay_finite():
    net = lm_scoring.Window.fresh()
    net.classes *= 1e4
    net.words *= 1e4
    out = net.log_likelihood(np.arange(32), np.zeros((4, 32), np.int64))
    assert np.isfinite(out).all() and (out <= 0).all()


def test_gibberish_scores_below_text(spark):
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = lm_scoring.learn(docs)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    own = [(r.doc_id, r.text) for r in docs.where("doc_id < 60").collect() if r.text and len(r.text.split()) > 20]
    noise = [(i, " ".join(word() for _ in t.split())) for i, t in own]
    mean = lambda rows: [r.pseudo_log_likelihood / r.n_words for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), *model).collect()]
    assert max(mean(noise)) < min(mean(own))


def test_word_order_matters(spark):
    rng = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(3, "doc_id")
    model = lm_scoring.learn(docs)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 200").collect()]

    def mixed(t):
        w = t.split()
        rng.shuffle(w)
        return " ".join(w)

    score = lambda rows: {r.row.doc_id: (r.n_words, r.pseudo_log_likelihood) for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), *model).collect()}
    own, other = score(rows), score([(i, mixed(t)) for i, t in rows])
    assert np.mean([own[i][1] > other[i][1] for i in own]) > 0.6
    assert all(own[i][0] == len(t.split()) for i, t in rows)
    edge = score([(1, None), (2, ""), (3, " \n "), (None, "one"), (4, "the " * 30_000)])
    assert edge[1] == edge[2] == edge[3] == (0, 0.0) and edge[None][0] == 1 and edge[4][0] == 30_000
    assert lm_scoring.learn(docs.limit(0))[0] == []


@pytest.mark.parametrize("known", [200_000, 1_000, 0])
def test_words_beyond_the_network(spark, monkeypatch, known):
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    # 40,001 distinct words; rare ones of one shared number have counts 1 to 3.
    texts = [" ".join(f"w{i}" for i in range(k, 40_000, 40)) for k in range(40)] + ["w39999 w39999 w39998"] + ["the " * 500]
    texts += [" ".join(f"w{i}" for i in range(1000))] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm_scoring.learn(docs)
    classes = lm_scoring.classes_for(40_001)
    assert classes > lm_scoring.CLASSES and lm_scoring.classes_for(8_000_000) == 200
    words = classes * classes
    numbers = lm_scoring.Vocabulary(model[0], words)
    assert len(model[0]) == words - lm_scoring.shared_numbers(words) > lm_scoring.WORDS - lm_scoring.HASHED
    n = Counter(w for t in texts for w in t.encode().split())
    rest = {w: c for w, c in n.items() if w not in set(model[0])}
    assert len(rest) == 40_001 - len(model[0]) and max(rest.values()) <= min(n[w] for w in model[0])
    probe = [b"w39000", b"w20000", b"never-seen", b"the", b"w5"]
    rows = [(i, w.decode()) for i, w in enumerate(probe)] + [(9, "w39000 the w39000 never-seen"), (9, "w39000 the w39000 never-seen")]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), *model).collect()
    net = lm_scoring.Window.of(np.frombuffer(model[1], np.float32))

    def want(text):
        ids, at, _, _ = numbers.numbered([text])
        total = net.log_likelihood(ids[at], lm_scoring._around(ids, at)).sum()
        for w in text.split():
            same = [c for x, c in rest.items() if numbers[x] == numbers[w]]
            if w in rest:
                total += math.log(rest[w] / (sum(same) + len(same) + 1))
            elif w not in n:
                total += math.log((len(same) + 1) / (sum(same) + len(same) + 1)) - (len(w) + 1) * math.log(256)
        return total

    assert len(got) == len(rows)
    for r in got:
        assert r.pseudo_log_likelihood == pytest.approx(want(r.row.text.encode()), abs=1e-3)
    one = {r.row.text: r.pseudo_log_likelihood for r in got}
    assert one["never-seen"] < one["w39000"] - 10


def test_lexicon_counts_all_labelled_rows(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    common, rare = [word() for _ in range(200)], [word() for _ in range(700)]
    rows, labels = [], []
    for i in range(2400):  # each rare word is in some 20 toxic rows, far fewer of them in a sample of 150
        text = [rng.choice(common) for _ in range(40)]
        if i % 2:
            for k in range(12):
                text[k * 3] = rare[(i // 2 * 12 + k) % 700]
        rows.append((i, " ".join(text)))
        labels.append((i, i % 2))
    rows += [(10_000 + i, " ".join([*(rng.choice(common) for _ in range(36)), *[w] * 4])) for i, w in enumerate(rare)]
    rows += [(20_000 + i, " ".join(rng.choice(common) for _ in range(40))) for i in range(200)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, known, sample_rows=150).collect()}
    assert len(score) == len(rows)
    # More words than the 512 entries that were kept before, and each known by itself.
    assert np.mean([score[10_000 + i] > max(score[20_000 + k] for k in range(200)) for i in range(700)]) > 0.95


def test_ngram_set_is_bounded():
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200_000)).encode()
    grams = decontamination.NgramSet.of([("x", text), ("y", b"short one"), ("x", text[:600])])
    assert grams.n_bytes() < 6 * (len(text) + 600)
    words = text.split()
    spans, items = grams.hits([words[50:70], [b"a", b"short", b"one"], words[:9]], decontamination.WordHashes())[0]
    assert spans == {(i, i + 10) for i in range(11)} and {grams.ids[i] for i in items} == {"x"} and items == {0, 2}


def test_parts_split_rows_of_one_id():
    rng = np.random.default_rng(5)
    rows = np.stack([rng.choice([1, 2, 2, 2, 9], 400), rng.integers(0, 50, 400)], axis=1)
    splitters = np.array(sorted({(1, 30), (2, 5), (2, 17), (2, 40), (5, 0), (9, 25)}))
    want = [sum((a, b) <= (k, h) for a, b in splitters.tolist()) for k, h in rows.tolist()]
    assert fingerprints._homes(splitters, rows[:, 0], rows[:, 1]).tolist() == want
    assert fingerprints._homes(splitters[:0], rows[:, 0], rows[:, 1]).tolist() == [0] * 400
