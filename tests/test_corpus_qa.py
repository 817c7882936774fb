"""Adjudication, miner gates and JSON reports of the reference."""

import json

from pyspark.sql import functions as F

from verdictflow.operators import cascade, corpus, render, sinks
from verdictflow.plans import inline
from verdictflow.sources import readers

DIFF = "diff --git a/{p} b/{p}\n--- a/{p}\n+++ b/{p}\n@@ -0,0 +1 @@\n+{line}\n"


def test_adjudicated_names_are_kept(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id":"a","label":"clean","adjudicated":[{"name":"gone"},{"name":"pkg.sub"}]}\n{"id":"b","label":"clean"}\n')
    known = readers.adjudicated(readers.manifest(spark, str(tmp_path / "m.jsonl")))
    cols = "case_id string, repo string, ord long, kind string, name string, top string, file string, line int, registry string, in_stdlib boolean, in_first_party boolean, aliased boolean, evidence string"
    names = [("a", "import", "gone.x", "gone", "absent"), ("a", "import", "pkg.sub", "pkg", "absent"), ("a", "import", "pkg.other", "pkg", "absent"), ("a", "requirement", "gone", "gone", "unknown"), ("b", "import", "gone", "gone", "absent"), ("a", "import", "fine", "fine", "exists"), ("a", "relative", ".", "", "unknown")]
    rows = spark.createDataFrame([(c, "r", i, k, n, t, "f.py", i, g, False, False, False, "e") for i, (c, k, n, t, g) in enumerate(names)], cols).withColumn("signals", F.array(F.lit("none")))
    out = cascade.adjudicate(cascade.decide(rows, cascade.QA_RULES), known)
    assert [r.reason for r in out.orderBy("ord").collect()] == ["adjudicated-keep", "adjudicated-keep", "unresolved", "adjudicated-keep", "unresolved", "pypi", "relative"]
    assert {r.reason: r.verdict for r in out.collect()} == {"adjudicated-keep": "suppress", "unresolved": "silent", "pypi": "suppress", "relative": "suppress"}
    sinks.write_verification_report(out, str(tmp_path / "report"))
    part = lambda p: spark.read.json(str(tmp_path / "report" / p)).collect()
    assert {r.status: r.n for r in part("occurrences")} == {"adjudicated-keep": 3, "unresolved": 2, "pypi": 1, "relative": 1}
    table = {(r.kind, r.name): (r.status, r.cases) for r in part("names")}
    assert table == {("import", "gone"): ("adjudicated-keep", ["a", "b"]), ("import", "pkg"): ("adjudicated-keep", ["a"]), ("requirement", "gone"): ("adjudicated-keep", ["a"]), ("import", "fine"): ("pypi", ["a"]), ("relative", "."): ("relative", ["a"])}
    assert sorted((r.case_id, r.name) for r in part("unresolved")) == [("a", "pkg.other"), ("b", "gone")]
    assert corpus.registry_checked(sinks.verification_report(out)[1]).first().names == 1


def test_diff_gates(spark):
    wanted = {
        ("a.py", "import x"): (True, True), ("a.py", "  from .b import c"): (True, True), ("a.py", "x = 1"): (True, False), ("a.txt", "import x"): (False, False), ("requirements-dev.txt", " six==1 # old"): (False, True), ("requirements.txt", "# six"): (False, False),
        ("requirements.txt", "-r other.txt"): (False, False), ("requirements.txt", "x @ https://h"): (False, False), ("sub/pyproject.toml", '  "left-pad[a]>=1",'): (False, True), ("pyproject.toml", 'name = "x"'): (False, False), ("setup.cfg", "    six"): (False, True), ("setup.py", "    'six',"): (True, False), ("setup.py", "import six"): (True, True),
    }
    diffs = spark.createDataFrame([(str(i), DIFF.format(p=p, line=line)) for i, (p, line) in enumerate(wanted)] + [("gone", "--- a/a.py\n+++ /dev/null\n+import x\n"), ("", "")], "case_id string, diff string")
    got = {r.case_id: (r.touches_python, r.adds_name) for r in corpus.diff_gates(diffs).collect()}
    assert got == {str(i): v for i, v in enumerate(wanted.values())} | {"gone": (False, False)}


def test_mined_pulls_and_cap(spark):
    now, ok, bad = "2026-01-01 00:00:00", DIFF.format(p="a.py", line="import x"), DIFF.format(p="a.py", line="x")
    rows = [
        (1, None, "User", "u", ok, "not merged"), (2, "2024-01-02 00:00:00", "User", "u", ok, "kept"), (3, "2024-01-01 23:59:59", "User", "u", ok, "too old"), (4, "2025-01-01 00:00:00", "Bot", "u", ok, "bot"), (5, "2025-01-01 00:00:00", None, "x[bot]", ok, "bot"), (6, "2025-01-01 00:00:00", None, None, ok, "already mined"),
        (7, "2025-01-01 00:00:00", "User", "u", None, "diff unavailable"), (8, "2025-01-01 00:00:00", "User", "u", "", "no python file"), (9, "2025-01-01 00:00:00", "User", "u", ok * 31, "too large"), (10, "2025-01-01 00:00:00", "User", "u", ok + "+y\n" * 1500, "too large"), (11, "2025-01-01 00:00:00", "User", "u", bad, "no import or requirement"),
        (2, "2024-01-02 00:00:00", "User", "u", ok, "already mined"), (12, "2025-01-01 00:00:00", "User", "u", ok * 30, "kept"),
    ]
    pulls = spark.createDataFrame([("o/r", i, n, m, t, u) for i, (n, m, t, u, *_) in enumerate(rows)] + [("o/s", i, i, "2025-01-01 00:00:00", "User", "u") for i in range(20)], "repo string, pos int, number long, merged_at string, user_type string, login string").withColumn("merged_at", F.to_timestamp("merged_at"))
    diffs = spark.createDataFrame([*{(f"o__r__pr{n}", d) for n, *_, d, _ in rows}, *((f"o__s__pr{i}", ok) for i in range(20))], "case_id string, diff string")
    existing = spark.createDataFrame([("o__r__pr6",), ("o__s__pr0",)], "case_id string")
    run = lambda **k: [(r.repo, r.gate) for r in corpus.mined(pulls, diffs, existing, F.lit(now).cast("timestamp"), **k).orderBy("repo", "pos").collect()]
    got = run()
    assert [g for r, g in got if r == "o/r"] == [r[-1] for r in rows]
    assert [g for r, g in got if r == "o/s"] == ["already mined"] + ["kept"] * 11
    assert [g for r, g in run(target=2) if r == "o/r"] == [r[-1] for r in rows[:6]]  # the case mined before fills the cap
    assert sum(r == "o/s" for r, _ in run(target=99)) == 15


def test_json_report(spark):
    errors = spark.createDataFrame([("c3", "boom")], "case_id string, error string")
    cases, truths, found = inline.CASES.frame(spark), inline.TRUTHS.frame(spark), inline.FINDINGS.frame(spark)
    got = json.loads(render.report_json("t\"}", "file", cases, truths, found, errors).first().body)
    assert (got["tool"], got["match"], [c["corpus"] for c in got["corpora"]]) == ("t\"}", "file", ["good", "seeded"])
    good, seeded, total = *got["corpora"], got["total"]
    assert good["recall"] is None and good["kinds"] == {} and good["errors"] == [] and good["noise"] == 2
    assert seeded["kinds"] == {"?": {"hits": 0, "total": 1}, "import": {"hits": 1, "total": 3}, "requirement": {"hits": 1, "total": 1}}
    assert seeded["unlocated"] == 1 and seeded["errors"] == ["c3: boom"]
    assert total["cases"] == 5 and total["kinds"] == seeded["kinds"] and total["tp"] == seeded["tp"] == 2
    empty = json.loads(render.report_json("t", "file", cases.limit(0), truths.limit(0), found.limit(0), errors.limit(0)).first().body)
    assert empty["corpora"] == [] and empty["total"].keys() == total.keys()
