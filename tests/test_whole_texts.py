"""Queries over texts of many lines, against brute force over whole texts."""

import re
from collections import Counter, defaultdict

from verdictflow.plans import catalogue

DOCS = [
    (1, "Zebra at one\nlater words live here\nzebra", "en", "a"),
    (2, "first\n\nlater zebra\r\nunknown", "en", "a"),
    (3, "erste Zeile\nhier words", "de", "b"),
    (4, "x\nonly known\nhier", None, "b"),
    (5, None, "en", "c"),
    (6, "", "en", None),
    (7, "\nwords after an empty line", "en", None),
    (8, "same\nwords", "en", None),
]
BENCHMARK = [(1, "known\nwords"), (2, None)]


def words(text):
    return {w for w in re.split("[^a-z]+", (text or "").lower()) if w}


def tables(spark, folder):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_verdicts_of_every_line(spark, tmp_path):
    tables(spark, tmp_path)
    known = set().union(*(words(t) for _, t in BENCHMARK))
    seen = Counter((s, w) for _, t, _, s in DOCS if s is not None for w in words(t))
    wanted = Counter()
    for _, text, lang, source in DOCS:
        for w in words(text):
            wanted["stdlib" if len(w) <= 2 else "first-party" if seen[source, w] > 1 else "unverified" if lang != "en" else "registry-hit" if w in known else "registry-404"] += 1
    got = catalogue.q01(spark, str(tmp_path)).collect()
    assert {r.reason: r.n for r in got} == wanted
    assert len({r.reason for r in got}) == 5


def test_name_table_of_every_line(spark, tmp_path):
    tables(spark, tmp_path)
    first, cases = {}, defaultdict(dict)
    for i, text, lang, source in sorted(DOCS, key=lambda r: r[0]):
        for w in words(text):
            if len(w) > 3:
                first.setdefault(w, lang)
                cases[w].setdefault(source, i)
    wanted = {w: (first[w], ",".join(s for s in cases[w] if s is not None)) for w in first}
    assert {r.name: (r.status, r.cases) for r in catalogue.q24(spark, str(tmp_path)).collect()} == wanted


def test_short_items_are_found_in_documents(spark, tmp_path):
    texts = ["one two three four five six seven", "xone twox three", "three\nfour five", "one  two", "", None]
    items = ["one", "one two", "two three four five six", "one two three four five six", "three\nfour", "absent word", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.item_id) for r in catalogue.q25(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(i, k) for i, t in enumerate(texts) for k, b in enumerate(items) if t is not None and b is not None and b in t]
