"""Operators over inputs of their own."""

import json
import time

import pytest
from pyspark.sql import functions as F

from verdictflow.operators import cascade, corpus, diffs, imports, manifests, scoring
from verdictflow.plans.scan import ORDER, decisions, release, scan
from verdictflow.sources import readers
from verdictflow.streaming.watch import watch


def test_unknown_is_never_fire(spark):
    rows = spark.createDataFrame([("import", "x", r) for r in ("exists", "absent", "unknown")], "kind string, top string, registry string")
    for c in ("in_stdlib", "in_first_party", "in_repo", "in_sibling"):
        rows = rows.withColumn(c, F.lit(False))
    got = {r.registry: (r.verdict, r.reason) for r in cascade.decide(rows, cascade.IMPORT_RULES).collect()}
    assert got == {"exists": ("suppress", "registry-hit"), "absent": ("fire", "registry-404"), "unknown": ("silent", "unverified")}


def test_rules_are_first_match(spark):
    row = spark.createDataFrame([("relative", "", True, True, True, True, "absent", True)], "kind string, top string, in_stdlib boolean, in_first_party boolean, in_repo boolean, in_sibling boolean, registry string, aliased boolean")
    assert cascade.decide(row, cascade.IMPORT_RULES).first().reason == "relative"
    assert cascade.decide(row, cascade.QA_RULES).first().reason == "relative"


def test_broken_diff_gives_no_lines(spark):
    bad = spark.createDataFrame([("x", "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1,2 @@\n a\n+import b\ndiff --git a/c.py b/c.py\n--- a/c.py\n+++ b/c.py\n@@ -1,9 +1,9 @@\n a\n")], "case_id string, diff string")
    lines = diffs.classified(bad)
    assert diffs.body_lines(lines).count() == 0
    assert diffs.errors(lines).first().error == "truncated hunk"


def test_empty_and_plain_diffs(spark):
    plain = spark.createDataFrame([("e", ""), ("n", None), ("p", "--- a\n+++ b\n@@ -1 +1 @@\n-a\n+b\n")], "case_id string, diff string")
    assert diffs.classified(plain).count() == 0


def test_carriage_returns_are_dropped(spark):
    one = spark.createDataFrame([("x", "diff --git a/a b/a\r\n--- a/a\r\n+++ b/a\r\n@@ -1 +1 @@\r\n-a\r\n+b\r\n")], "case_id string, diff string")
    assert [r.text for r in diffs.added_lines(diffs.classified(one)).collect()] == ["b"]


def test_lexer_tolerates_fragments():
    assert [m for _, _, m in imports.imports_of('x = (1,\nimport a\nfrom b import (c,\n')] == ["a", "b"]
    assert list(imports.imports_of('"""doc\nimport no\n')) == []


def test_extras_end_an_array_unless_kept(spark):
    text = "diff --git a/pyproject.toml b/pyproject.toml\n--- a/pyproject.toml\n+++ b/pyproject.toml\n@@ -1,2 +1,5 @@\n [project]\n+dependencies = [\n+ \"one[x]>=1\",\n+ \"two\",\n ]\n"
    lines = diffs.body_lines(diffs.classified(spark.createDataFrame([("t", text)], "case_id string, diff string")))
    names = lambda **k: sorted(r.name for r in manifests.toml_dependencies(lines, **k).collect())
    assert names() == ["one"]
    assert names(keep_extras=True) == ["one", "two"]


def test_lexer_takes_linear_time():
    block = "x = [\n" + "    1, 'import no', {'a': (2)},\n" * 16_000 + "]\nimport yes\n"
    started = time.perf_counter()
    assert [m for _, _, m in imports.imports_of(block)] == ["yes"]
    assert [m for _, _, m in imports.imports_of("f(\n" + "\n" * 16_000 + "x)\nimport yes\n")] == ["yes"]
    assert [m for _, _, m in imports.imports_of("from __future__ import annotations\nif x: import a; from b import c\nelse: import d\n")] == ["a", "b", "d"]
    assert time.perf_counter() - started < 2


def scan_plan(spark):
    diffs = spark.createDataFrame([("t", "x")], "case_id string, diff string")
    return decisions(spark, diffs, spark.createDataFrame([], readers.REGISTRY))._jdf.queryExecution()


def test_scan_reads_its_lines_once(spark):
    """The lines' own plan is one exchange; the branches read what was kept and broadcast only the fixed lists."""
    plan = scan_plan(spark).executedPlan().toString()
    above = "\n".join(x for x in plan.splitlines())
    assert plan.count("InMemoryTableScan") >= 3
    assert above.count("Exchange hashpartitioning") <= 15


def test_order_and_domain_of_decisions(spark):
    text = "".join([
        "diff --git a/b/requirements.txt b/b/requirements.txt\n--- /dev/null\n+++ b/b/requirements.txt\n@@ -0,0 +1,2 @@\n+two\n+one\n",
        "diff --git a/tests/data/x.py b/tests/data/x.py\n--- /dev/null\n+++ b/tests/data/x.py\n@@ -0,0 +1 @@\n+import hidden\n",
        "diff --git a/a.py b/a.py\n--- /dev/null\n+++ b/a.py\n@@ -0,0 +1,3 @@\n+import zz, os, aa\n+from . import q\n+import gone\n",
    ])
    reg = spark.createDataFrame([(n, 404, False, "d") for n in ("one", "zz", "gone")] + [("two", 200, True, "d")], readers.REGISTRY)
    table = spark.createDataFrame([("t", text)], "case_id string, diff string")
    got = decisions(spark, table, reg).orderBy(*ORDER)
    assert [(r.top or "-", r.reason) for r in got.collect()] == [
        ("two", "registry-hit/manifest"), ("one", "registry-404/manifest"), ("-", "fixture-data"), ("zz", "registry-404"), ("os", "stdlib"), ("aa", "unverified"), ("-", "relative"), ("gone", "registry-404"),
    ]
    assert [r.name for r in scan(spark, table, reg).orderBy("ord").collect()] == ["one", "zz", "gone"]
    with pytest.raises(Exception, match="no such decision"):
        cascade.closed(got.withColumn("reason", F.lit("other"))).collect()


def test_fixture_files_give_no_candidates(spark):
    text = "diff --git a/tests/fixtures/a.py b/tests/fixtures/a.py\n--- /dev/null\n+++ b/tests/fixtures/a.py\n@@ -0,0 +1 @@\n+import nowhere\n"
    reg = spark.createDataFrame([("nowhere", 404, False, "2024-01-01")], readers.REGISTRY)
    got = decisions(spark, spark.createDataFrame([("t", text)], "case_id string, diff string"), reg).collect()
    assert [(r.kind, r.file, r.verdict, r.reason) for r in got] == [("file", "tests/fixtures/a.py", "suppress", "fixture-data")]


def test_wrong_file_is_no_false_positive_once_credited(spark):
    truths = spark.createDataFrame([("c", 1, "n", "a.py", "import")], "case_id string, truth_id long, name string, file string, kind string")
    found = spark.createDataFrame([("c", "n", "a.py"), ("c", "N", "b.py")], "case_id string, name string, file string")
    assert scoring.false_positives(truths, found).count() == 0
    assert scoring.false_positives(truths, found.where("file = 'b.py'")).count() == 1


def test_cap_counts_only_rows_before_the_stop(spark):
    rows = spark.createDataFrame([("r", i, i % 2 == 0) for i in range(10)], "repo string, i int, ok boolean")
    seen = [r.i for r in corpus.examined_until_full(rows, "repo", ["i"], "ok", 2).orderBy("i").collect()]
    assert seen == [0, 1, 2]


def test_signals_and_registry_merge(spark):
    rows = spark.createDataFrame([(True, "x", False, False), (False, None, False, False)], "in_tree boolean, near string, is_test boolean, guarded boolean")
    assert [r.signals for r in corpus.signals(rows).collect()] == [["exists in tree", "near x"], ["none"]]
    known = spark.createDataFrame([("A_b", 404, False, "2024-01-01")], readers.REGISTRY)
    new = spark.createDataFrame([("a-b", 200, True, "2024-02-01"), ("c", 429, None, "2024-02-01")], readers.REGISTRY)
    assert [(r.name, r.exists) for r in cascade.new_verdicts(known, new).collect()] == [("a-b", True)]


def test_manifest_and_registry_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('# note\n\n{"id":"a","label":"clean"}\n{"id":"b","label":"clean","truth":[{"name":"x"}]}\n{"id":"c","label":"odd"}\nnot json\n')
    got = {r.id: (r.diff, r.error) for r in readers.manifest(spark, str(tmp_path / "m.jsonl")).collect()}
    assert got["a"] == ("diffs/a.diff", None) and got["b"][1] and got["c"][1] and got[None][1]
    (tmp_path / "reg").mkdir()
    (tmp_path / "reg/x.json").write_text(json.dumps({"name": "x", "status": 200, "exists": True, "checked": "2024-01-01"}, indent=1))
    assert readers.registry(spark, str(tmp_path / "reg")).first().exists is True


def test_stream_of_diffs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.diff").write_text("diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1,2 @@\n a\n+import nowhere\n")
    reg = spark.createDataFrame([("nowhere", 404, False, "2024-01-01")], readers.REGISTRY)
    watch(spark, str(tmp_path / "in"), reg, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert [(r.case_id, r.name, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("one", "nowhere", 2)]


def test_kept_lines_are_released(spark):
    table = spark.createDataFrame([("t", "diff --git a/a.py b/a.py\n--- /dev/null\n+++ b/a.py\n@@ -0,0 +1 @@\n+import nowhere\n")], "case_id string, diff string")
    found = scan(spark, table, spark.createDataFrame([("nowhere", 404, False, "d")], readers.REGISTRY))
    assert found.count() == 1 and found._verdictflow_lines.is_cached
    release(found)
    assert not found._verdictflow_lines.is_cached and found.count() == 1
