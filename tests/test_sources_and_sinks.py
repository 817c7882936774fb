import json
import sys

from pyspark.sql import functions as F

from verdictflow.operators import repo, sinks
from verdictflow.sources import listing, readers, tools


def test_tools_run_per_case(spark):
    cases = spark.createDataFrame([("a", "x\ny\n", None), ("b", None, "ctx")], "case_id string, diff string, context string")
    script = "import sys,json; d=sys.stdin.read(); print(json.dumps([{'name': sys.argv[1] or 'none', 'line': len(d)}]))"
    runs = tools.run_tool(cases, [sys.executable, "-c", script, "n{context}"])
    got = {r.case_id: r.findings for r in readers.parse_findings(runs.drop("error")).collect()}
    assert [(f.name, f.line) for f in got["a"]] == [("n", 4)] and [(f.name, f.line) for f in got["b"]] == [("nctx", 0)]
    hung = tools.run_tool(cases, [sys.executable, "-c", "import time; time.sleep(30)"], timeout=1).collect()
    assert all(r.error.startswith("TimeoutExpired") for r in hung)
    assert tools.run_tool(cases.limit(0), ["true"]).count() == 0
    said = tools.run_function(cases, lambda d: [("n", "f", len(d), "import", "m")])
    assert sorted((r.case_id, r.line) for r in said.collect()) == [("a", 4), ("b", 0)]


def test_directory_listing(spark, tmp_path):
    for p in ("setup.py", "src/alpha/__init__.py", "libs/beta/__init__.py", "libs/beta/mod.py", "node_modules/x/__init__.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    seen = listing.directory(spark, str(tmp_path), "r")
    assert {r.name for r in repo.top_level(seen).collect()} == {"setup", "src", "libs", "alpha", "beta"}
    assert ("libs/beta", "mod") in {(r.dir, r.name) for r in repo.siblings(seen).collect()}


def test_captured_inputs(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"repo": "r", "ref": "HEAD", "truncated": False, "tree": [{"path": "a", "type": "tree"}, {"path": "a/b.py", "type": "blob"}]}))
    assert sorted((r.path, r.is_dir) for r in listing.captured_trees(spark, str(tmp_path / "t.json")).collect()) == [("a", True), ("a/b.py", False)]
    (tmp_path / "p.json").write_text('{"number":1,"merged_at":"2024-01-02T03:04:05Z","user":{"login":"x[bot]","type":"User"}}\n{"number":2,"merged_at":null}\n')
    assert [r.merged_at is None for r in listing.pulls(spark, str(tmp_path / "p.json")).orderBy("number").collect()] == [False, True]
    assert spark.createDataFrame([('{"pull_request":{"number":7}}',)], "b string").select(listing.event_number(F.col("b"))).first()[0] == 7


def test_context_round_trip(spark, tmp_path):
    top = spark.createDataFrame([("r", "b"), ("r", "a")], "ctx_id string, name string")
    near = spark.createDataFrame([("r", "d", "m")], "ctx_id string, dir string, name string")
    sinks.write_contexts(top, near, str(tmp_path / "ctx"))
    back = spark.read.schema("top_level array<string>, siblings map<string,array<string>>, ctx_id string").json(str(tmp_path / "ctx")).first()
    assert back.top_level == ["a", "b"] and back.siblings == {"d": ["m"]}


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([("c", "n", "f.py", 3, "import", "m", 1)], "case_id string, name string, file string, line int, kind string, message string, ord int")
    none = spark.createDataFrame([], "case_id string, error string")
    assert sinks.exit_code(found, none).first().code == 1 and sinks.exit_code(found.limit(0), none).first().code == 0
    assert sinks.exit_code(found, spark.createDataFrame([("c", "e")], "case_id string, error string")).first().code == 2
    assert sinks.annotations(found).first().line == "::warning file=f.py,line=3::m"
    sinks.write_findings(found.select("case_id"), found, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).first().body.startswith('[{"name":"n"')
    cases = spark.createDataFrame([("c", 1), ("d", 2)], "case_id string, x int")
    sinks.write_quarantine(cases, found.select("case_id"), str(tmp_path / "k"), str(tmp_path / "r"))
    assert [r.case_id for r in spark.read.parquet(str(tmp_path / "k")).collect()] == ["d"]
    snap = spark.createDataFrame([("x", 404, False, "d"), ("y", 200, True, "d")], readers.REGISTRY)
    assert tuple(sinks.fresh(spark.createDataFrame([("x",), ("y",)], "name string"), snap).first()) == (False, 1)
    log = sinks.explain_log(found.select("case_id", F.lit("fire").alias("verdict"), F.lit("registry-404").alias("reason"), F.col("name").alias("top"), "file", "line", F.col("name").alias("dist")))
    assert log.first().line == "fire\tregistry-404\tn\tf.py:3\tn"
