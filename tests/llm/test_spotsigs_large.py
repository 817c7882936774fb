"""SpotSigs over ids that doubles can't hold, and the search for similar documents."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash

from verdictflow.llm import spotsigs


@pytest.mark.parametrize("start", [1 << 62, (1 << 63) - 1 - 5000 * 7, -(1 << 62)])
def test_no_row_is_lost_with_large_ids(spark, start):
    ids = [start + 7 * i for i in range(5000)]
    texts = {i: f"the house {k} of cards" for k, i in enumerate(ids)}
    got = spotsigs.with_next(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    order = sorted(ids, reverse=True)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(ids)
    assert {r.doc_id: r.edited_sha256 for r in got} == {i: sha(spotsigs.edited(texts[i], texts[order[(k + 1) % len(order)]])) for k, i in enumerate(order)}


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8])
def test_all_similar_pairs_are_found(spark, threshold):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = ["", None, "the of", "w1"]
    for _ in range(12):
        base = [w for x in rng.sample(words, rng.randrange(1, 40)) for w in ("the", x)]
        for _ in range(6):
            texts.append(" ".join(w for w in base if rng.random() > rng.choice([0, 0.02, 0.1])))
    texts += [" ".join(words[:n]) for n in (7, 8, 10, 14, 16, 20)]  # few spots: sets of n words, likeness just at a threshold
    rng.shuffle(texts)
    rows = [(i // 2 if i < 4 else None if i == 5 else i, t) for i, t in enumerate(texts)]  # ids occur twice, one is null
    sets = [(i, set(spotsigs.signatures(t or "").tolist())) for i, t in rows]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    pair = lambda a, b: tuple(sorted((a, b), key=str))
    wanted = Counter((*pair(a, b), like(x, y)) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if like(x, y) >= threshold)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(wanted) > 50
    for salts in (1, 3):
        pairs, members = spotsigs.similar(docs, threshold, salts)
        of = defaultdict(list)
        for r in members.collect():
            of[r.rep].append(r.doc_id)
        assert sum(map(len, of.values())) == len(rows)
        got = Counter((*pair(a, b), 1.0) for ids in of.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
        for r in pairs.collect():
            got.update((*pair(a, b), r.likeness) for a in of[r.rep] for b in of[r.other_rep])
        assert got == wanted


def test_copies_of_one_text_are_one_representative(spark):
    docs = spark.createDataFrame([(i, "the house of cards is on the hill") for i in range(3000)] + [(9000, "")], "doc_id long, text string")
    pairs, members = spotsigs.similar(docs, 0.8)
    assert pairs.count() == 0 and members.select("rep").distinct().count() == 2 and members.count() == 3001
    assert [x.count() for x in spotsigs.similar(docs.limit(0), 0.8)] == [0, 0]


def brute_spots(text):
    """An anchor with the next two content words, by scanning forward from every anchor; words too where there are few."""
    trim = spotsigs.PUNCTUATION
    words = [w if w.isalnum() else w.strip(trim) for w in text.lower().split()]
    spots = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for x in words[i + 1 :] if x and x not in spotsigs.ANCHORS][:2]
            if len(chain) == 2:
                spots.add(" ".join([w, *chain]))
    if len(spots) < max(8, len(words) // 20):
        spots |= {w for w in words if w}
    return spots


def test_query_against_brute_force(spark):
    """Every column of op7 on a whole table: sets of spots as strings, likeness counted on them."""
    sf = "/root/testdata/sf0.001"
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in spotsigs.op7_spotsigs(spark, sf).collect()}
    assert len(got) == len(docs)
    code = lambda spots: "".join(sorted(f"{xxhash.xxh3_64_intdigest(s) & (1 << 48) - 1:012x}" for s in spots))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, text) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        own, new, following = brute_spots(text), brute_spots(changed), brute_spots(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(changed.encode()).hexdigest(), code(own), code(new))
        assert r.near_edited == pytest.approx(like(own, new)) and r.near_next == pytest.approx(like(own, following))
