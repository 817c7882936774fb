"""Every query and the pipeline on empty tables, and on nulls, empty and very long texts, ties, repeated rows and columns
whose names clash with their own."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from verdictflow.llm import bpe, chat, html_extract, queries

LONG = "The house of the long road is near and " * 40_000
GOOD = "The road to the old house was long and the people of the town were proud of it, as it had been there for many years."
DOCS = [
    (1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "en", "a"), (4, "one two", "en", "b"), (4, "one two", "en", "b"), (5, "three four", "en", "b"), (5, GOOD, "en", "b"), (6, LONG, "en", "a"),
    (None, GOOD, "en", "b"), (None, GOOD, "en", "b"), (7, "é😀 \x0b <|endoftext|> ###", "fr", "c"), (8, GOOD, "en", "b"), (9, GOOD + " And so on.", None, None),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = "__row __key __of __size __id __n __text __content __kept kept score held_out f0 n_words size content slot ids digest sig root fingerprint".split()
LABELS = [(8, 1, 0), (9, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (5, None, 0), (1, 0, 0)]
PAGES = [(1, "u", None), (2, None, ""), (3, "a\r\nb", "<p>" + LONG), (3, "a\r\nb", "<p>" + LONG), (None, "u", "<article><p>One."), (4, "u", "<article><p>One."), (5, "u", "<")]
TURNS = [(1, 0, "user", None), (1, 1, "assistant", LONG), (1, 1, "assistant", LONG), (2, None, None, ""), (None, 0, "assistant", "x"), (3, 1, "assistant", "\\ </turn> <| ###")]


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in df.columns])


def write(spark, folder, keep):
    tables = {"documents": (DOCS, DOC_SCHEMA), "labels": (LABELS, "doc_id long, quality int, toxic int"), "pages": (PAGES, "page_id long, url string, html string"), "conversations": (TURNS, "conv_id long, turn long, role string, text string")}
    for name, (rows, schema) in tables.items():
        clashing(spark.createDataFrame(rows if keep else [], schema)).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("odd")), True)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, str(tmp_path_factory.mktemp("empty")), False)


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_empty_tables_give_empty_results(spark, empty, name):
    found = (corpus_pipeline.run if name == "pipeline" else queries.QUERIES[name])(spark, empty).collect()
    assert [r.conv_id for r in found] == [chat.PROBE_ID] if name == "op9_chat" else found == []


def ids(rows):
    return sorted((r[0] is not None, r[0] or 0) for r in rows)


@pytest.mark.parametrize("name", ["op2_quality_classifier", "op3_quality_rules", "op4_mixing", "op5_minhash", "op7_spotsigs", "op10_bpe"])
def test_every_document_is_in_the_result(spark, odd, name):
    found = queries.QUERIES[name](spark, odd)
    assert ids(found.select("doc_id").collect()) == ids(DOCS)


def test_classifier_scores_odd_rows(spark, odd):
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and not (r.doc_id is None and r.held_out) for r in queries.QUERIES["op2_quality_classifier"](spark, odd).collect())


def test_groups_of_odd_rows(spark, odd):
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.QUERIES["op5_minhash"](spark, odd).collect()]
    shingles = len({tuple(w) for w in zip(*(GOOD.lower().split()[i:] for i in range(3)))})  # noqa: B905
    by_id = {i: c for i, _, c, _ in found}
    assert {i: by_id[i] for i in (1, 2, 3, 4, 6, 7)} == {i: i for i in (1, 2, 3, 4, 6, 7)}
    assert by_id[5] == by_id[8] == by_id[9] == 5 and (8, shingles, 5, False) in found
    assert [x for x in found if x[0] is None] == [(None, shingles, None, True)] * 2


def test_sequences_hold_every_odd_row(spark, odd):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.encode_special_tokens = True
    found = queries.QUERIES["op6_training_order"](spark, odd)
    got = {(r.doc_id, r.n) for r in found.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    wanted = {}
    for i, t, *_ in DOCS:
        wanted[i] = wanted.get(i, 0) + len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert got == set(wanted.items()) and found.where("NOT read_back").count() == 0


def test_records_of_odd_pages(spark, odd):
    found = queries.QUERIES["op1_warc"](spark, odd).collect()
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in found), key=str) == sorted([(i, u, len((h or "").encode()), "response", None) for i, u, h in PAGES], key=str)
    assert {r.payload_digest for r in found if r.page_id == 3} == {hashlib.sha1(PAGES[2][2].encode()).hexdigest()}


def test_texts_of_odd_pages(spark, odd):
    found = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in queries.QUERIES["op8_html"](spark, odd).collect()), key=str)
    texts = {None: "", "": "", "<": "<", "<article><p>One.": "One.", "<p>" + LONG: LONG.strip()}
    assert found == sorted([(i, u, t, len(t)) for i, u, t in ((i, u, html_extract.extract(h or "")) for i, u, h in PAGES)], key=str)
    assert {h: html_extract.extract(h or "") for h in texts if h != "<"} == {h: t for h, t in texts.items() if h != "<"}


def test_turns_of_odd_conversations(spark, odd):
    found = {r.conv_id: r for r in queries.QUERIES["op9_chat"](spark, odd).collect()}
    assert {i: r.n_turns for i, r in found.items()} == {1: 3, 2: 1, None: 1, 3: 1, chat.PROBE_ID: 2}
    assert (found[1].loss_chars, found[1].loss_sha256) == (2 * len(LONG), hashlib.sha256((LONG * 2).encode()).hexdigest())
    assert found[2].turns_sha256 == hashlib.sha256(b"unknown\n\n").hexdigest()


def test_document_parts_and_clashing_columns(spark):
    parts = "array(named_struct('type','document','text',null,'ref','d.pdf','units',3), named_struct('type','text','text',null,'ref',null,'units',null), named_struct('type','odd/kind','text','x','ref',null,'units',null))"
    df = spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, {parts} AS parts, 'c' AS formatted, 'c' AS ts, 'c' AS content, 'c' AS p")
    row = chat.format_conversations(df, F.col("parts")).first()
    assert row.formatted == "### user: <|document:0|><|odd_kind:1|></turn>\n"
    assert [(a.type, a.ref, a.tokens) for a in row.attachments] == [("document", "d.pdf", 3 * 512), ("odd/kind", None, 0)]


def test_stages_pass_clashing_columns_on(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == "clash" for r in rows for c in CLASHES), name
        if name == "near_dedup":
            kept = [(r.doc_id, r.text) for r in rows if r.doc_id is not None]
            assert len(kept) == 8 and set(kept) == {(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "three four"), (5, GOOD), (6, LONG), (7, DOCS[10][1])}
            assert sum(r.doc_id is None for r in rows) == 2
    assert {r.doc_id for r in corpus_pipeline.run(spark, odd).collect()} <= {r[0] for r in DOCS}
