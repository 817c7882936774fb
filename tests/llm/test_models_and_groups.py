"""Classifier, near-dedup and the pipeline."""

import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from verdictflow.llm import components, minhash_dedup, pu_classifier

SF_DIR = "/root/testdata/sf0.01"


def shingles(text, width):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, width))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def planted(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.randrange(1, 80)) for _ in range(n // 6)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t).upper() if i % 9 == 0 else " ".join(t)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (5, rows[5][1])]


@pytest.mark.parametrize("block", [1024, 7, 2])
def test_near_duplicates_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK_DOCS", block)
    monkeypatch.setattr(minhash_dedup, "STAR_DOCS", block)
    monkeypatch.setattr(minhash_dedup, "COMBINED", 20 * block)
    rows = planted(block, 300)
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(docs, 3, 85).collect()
    wanted = brute(rows, 3, 85)
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == wanted[r.doc_id] and r.kept == (r.doc_id == wanted[r.doc_id])
    once = minhash_dedup.stage(spark, docs, SF_DIR).collect()
    assert len(once) == len({r.doc_id for r in once if r.doc_id is not None}) + 1


def test_near_duplicates_of_nothing(spark):
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        minhash_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), percent=50)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, i) for i in range(501, 560)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.id: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_risk_stays_non_negative_and_separates():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (600, 4)), rng.normal(-1.5, 1, (400, 4))
    net = pu_classifier.fit(good[:200], np.vstack([good[200:], bad]), 0.5)
    assert (net.forward(good[200:])[1] > 0).mean() > 0.93 and (net.forward(bad)[1] < 0).mean() > 0.93


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_is_estimated_without_negatives(share):
    rng = np.random.default_rng(4)
    good, bad = rng.normal(1.5, 1, (4000, 4)), rng.normal(-1.5, 1, (4000, 4))
    n = int(3000 * share)
    unlabelled = np.vstack([good[:n], bad[: 3000 - n]])
    assert pu_classifier.estimate_prior(good[n - 200 : n + 600], unlabelled) == pytest.approx(share, abs=0.04)
    assert pu_classifier.estimate_prior(good[:1], unlabelled[:1]) == 0.5


def test_classifier_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in pu_classifier.op2_quality_classifier(spark, SF_DIR).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF_DIR}/labels.parquet'").fetchall()
    held = [(rows[i].predicted, q) for i, q in labels if rows[i].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.95


def test_classifier_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (3, "w " * 9000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = pu_classifier.score(docs.withColumnRenamed("text", "__text").drop("score"), labels, ["doc_id"]).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_pipeline_against_brute_force(spark):
    """Each stage on what its predecessor kept, held against plain Python, DuckDB or the tokenizers library."""
    from collections import Counter, defaultdict

    from tokenizers import Tokenizer

    from verdictflow.llm import bpe, common, quality_rules

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "mixing", "bpe"]
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf), f"test-{name}")
        assert name == "bpe" or docs.columns == columns
        seen.append(docs.collect())
    rules, classifier, dedup, mix, encoded = seen

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert {r.doc_id for r in rules} == {i for i, k in con.sql(f"SELECT doc_id, kept FROM ({quality_rules.ORACLE})").fetchall() if k}

    quality = dict(con.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    before, after = {r.doc_id for r in rules}, {r.doc_id for r in classifier}
    good = [i for i in before if quality.get(i) == 1]
    assert after <= before and sum(i in after for i in good) >= 0.95 * len(good)

    least = brute([(r.doc_id, r.text) for r in classifier], 5, 80)
    assert sorted(r.doc_id for r in dedup) == sorted(i for i, c in least.items() if i == c)

    words = lambda t: len([w for w in (t or "").translate({i: 32 for i in (9, 10, 11, 12, 13)}).split(" ") if w])
    size, taken, weight = defaultdict(int), defaultdict(int), {}
    for r in dedup:
        size[r.source] += words(r.text)
    for r in mix:
        taken[r.source] += words(r.text)
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size))}
    capped: set = set()
    while True:
        left, free = sum(size.values()) - sum(3 * size[s] for s in capped), [s for s in size if s not in capped]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 3 * size[s] for s in capped}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    longest = max(words(r.text) for r in dedup)
    assert max(Counter(r.doc_id for r in mix).values()) <= 3
    assert all(abs(taken[s] - target[s]) <= longest for s in size)

    library = Tokenizer.from_file(bpe.default_vocabulary())
    texts = {r.doc_id: r.text for r in mix}
    assert Counter(r.doc_id for r in encoded) == Counter(r.doc_id for r in mix)
    assert all(r.round_trip and r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in encoded)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(texts)


def test_a_group_of_thousands_loses_no_link(spark, monkeypatch):
    """Near copies of few texts around the threshold, in components far beyond a block, against all pairs by matrices."""
    monkeypatch.setattr(minhash_dedup, "COMBINED", 700)
    rng, rows = random.Random(8), []
    base = [[f"v{b}w{i}" for i in range(60)] for b in range(2)]
    for i in range(3000):
        t = list(base[i % 2])
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(40)}"
        rows.append((i * 3, " ".join(t)))
    sets = [shingles(t, 3) for _, t in rows]
    place = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    matrix = np.zeros((len(rows), len(place)), np.float32)
    for k, s in enumerate(sets):
        matrix[k, [place[x] for x in s]] = 1
    common, size = matrix @ matrix.T, matrix.sum(1)
    linked = 100 * common >= 85 * (size[:, None] + size[None, :] - common)
    root = np.arange(len(rows))
    while True:
        least = np.where(linked, root[None, :], len(rows)).min(1)
        if (least == root).all():
            break
        root = least
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert len(set(root)) > 20 and got == {rows[k][0]: rows[r][0] for k, r in enumerate(root)}
