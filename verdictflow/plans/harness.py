"""More of the catalogue: sources over files that the queries bring themselves, sinks, corpus checks, and whole scans of
thousands of diffs made from a table."""

from __future__ import annotations

import difflib
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import cascade, corpus, diffs, imports, render, repo, scoring, sinks
from ..sources import listing, live, readers, refdata, staging, tools
from . import inline, scan
from .catalogue import ADDED_SQL, COARSE, ORACLES, SOURCES, TOY_SQL, WANTED, norm_sql, query, read, toy_tool

__all__ = ["ORACLES"]


def rows(schema: str, values: list[tuple]) -> str:
    """SQL of the expected rows."""
    return f"SELECT * FROM {inline.Inline(schema, values).sql()}"


# ---------------------------------------------------------------- sources

MANIFEST = "\n".join([
    "# cases",
    json.dumps({"id": "a", "label": "clean"}),
    "",
    json.dumps({"id": "b", "label": "hallucination", "diff": "diffs/sub/other.diff", "source": {"repo": "o/r"}, "truth": [{"name": "gone", "file": "x.py", "kind": "import"}]}),
    json.dumps({"id": "c", "label": "clean", "truth": [{"name": "x"}]}),
    json.dumps({"id": "d", "label": "maybe"}),
    "{broken",
    json.dumps({"id": "e", "label": "clean", "adjudicated": [{"name": "kept"}, {"name": "kept"}]}),
])
CORPUS = {"manifest.jsonl": MANIFEST, "diffs/a.diff": "diff --git a/a b/a\n", "diffs/sub/other.diff": "two\nlines\n", "diffs/z.diff": "no case"}


@query("q39_post_image_paths", f"""
SELECT case_id, pos::BIGINT AS pos, raw[7:] AS path FROM (SELECT case_id, g - 1 AS pos, ls[g] AS raw FROM (SELECT case_id, ls, unnest(range(1, len(ls) + 1)) AS g FROM (SELECT case_id, string_split(diff, chr(10)) AS ls FROM {COARSE.sql()}))) WHERE starts_with(raw, '+++ b/')
""")
def q39(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.post_image_paths(COARSE.frame(spark)).withColumn("pos", F.col("pos").cast("long"))


@query("q40_manifest", rows("place string, id string, diff string, truths long, error string", [
    ("manifest.jsonl:2", "a", "diffs/a.diff", 0, None), ("manifest.jsonl:4", "b", "diffs/sub/other.diff", 1, None), ("manifest.jsonl:5", "c", "diffs/c.diff", 1, "a clean case has truths"),
    ("manifest.jsonl:6", "d", "diffs/d.diff", 0, "unknown label"), ("manifest.jsonl:7", None, None, 0, "bad json or no id"), ("manifest.jsonl:8", "e", "diffs/e.diff", 0, None),
]))
def q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.manifest(spark, staging.put(spark, CORPUS) + "/manifest.jsonl")
    return found.select("place", "id", "diff", F.coalesce(F.size("truth"), F.lit(0)).cast("long").alias("truths"), "error")


@query("q41_case_diffs", rows("case_id string, path string, diff string", [("a", "diffs/a.diff", "diff --git a/a b/a\n"), ("b", "diffs/sub/other.diff", "two\nlines\n"), ("e", "diffs/e.diff", None)]))
def q41(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case of a corpus with its diff."""
    return readers.case_diffs(spark, staging.put(spark, CORPUS)).select("case_id", "path", "diff")


@query("q41b_diff_files", rows("case_id string, diff string", [("a", "diff --git a/a b/a\n"), ("z", "no case")]))
def q41b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.diffs(spark, staging.put(spark, CORPUS) + "/diffs/*.diff")


@query("q42_registry_files", rows("dist string, registry string", [("Requests", "exists"), ("flask", "unknown"), ("left.pad", "absent"), ("rate-limited", "unknown"), ("nowhere", "unknown"), ("MY_PKG", "unknown")]))
def q42(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of one file per name, with other files beside it."""
    one = lambda n, s, e: json.dumps({"name": n, "status": s, "exists": e, "checked": "2024-01-01"}, indent=1)
    folder = staging.put(spark, {"requests.json": one("requests", 200, True), "left-pad.json": one("left_pad", 404, False), "rate-limited.json": one("rate-limited", 429, None), "README.md": "MY_PKG", "other.json": '{"exists": true}'})
    return cascade.lookup(WANTED.frame(spark), readers.registry(spark, folder), known_once=True)


@query("q43_directory_listing", rows("kind string, dir string, name string", [
    ("top", "", "setup"), ("top", "", "src"), ("top", "", "libs"), ("top", "", "alpha"), ("top", "", "beta"), ("top", "", "a"),
    ("beside", "", "setup"), ("beside", "", "src"), ("beside", "", "libs"), ("beside", "", "a"), ("beside", "src", "alpha"), ("beside", "src/alpha", "__init__"), ("beside", "libs", "beta"), ("beside", "libs/beta", "__init__"), ("beside", "libs/beta", "mod"),
    ("beside", "a", "b"), ("beside", "a/b", "c"), ("beside", "a/b/c", "d"), ("beside", "a/b/c/d", "in"), ("beside", "a/b/c/d", "e"), ("beside", ".hidden", "y"),
]))
def q43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk that leaves out skipped directories, dotted names and what lies too deep."""
    files = ("setup.py", "src/alpha/__init__.py", "libs/beta/__init__.py", "libs/beta/mod.pyi", "node_modules/x/__init__.py", ".hidden/y.py", "a/b/c/d/in.py", "a/b/c/d/e/deep.py")
    seen = listing.directory(spark, staging.put(spark, dict.fromkeys(files, "x")), "r")
    top = repo.top_level(seen).select(F.lit("top").alias("kind"), F.lit("").alias("dir"), "name")
    return top.unionByName(repo.siblings(seen).select(F.lit("beside").alias("kind"), "dir", "name"))


@query("q44_context_round_trip", rows("ctx_id string, dir string, name string", [
    ("r", None, "setup"), ("r", None, "src"), ("r", None, "alpha"), ("r", None, "beta"), ("s/t", None, "one"), ("flat", None, "two"),
    ("r", "", "setup"), ("r", "src", "alpha"), ("r", "", "src"), ("r", "src/alpha", "__init__"), ("r", "src/alpha", "sub"), ("r", "src/alpha/sub", "__init__"), ("r", "libs/python", "beta"),
    ("r", "libs/python/beta", "__init__"), ("r", "libs/python/beta", "helper"), ("r", "tools", "run"), ("flat", "d", "three"),
]))
def q44(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured listings as they are written, and one under its own file name, read back."""
    seen = inline.LISTING.frame(spark)
    top = repo.top_level(seen).unionByName(spark.createDataFrame([("s/t", "one")], "ctx_id string, name string"))
    folder = staging.shared_folder(spark)
    sinks.write_contexts(top, repo.siblings(seen), folder)
    written = readers.repo_context(spark, folder)
    flat = readers.repo_context(spark, staging.put(spark, {"flat.json": json.dumps({"top_level": ["two"], "siblings": {"d": ["three"]}}, indent=1), "notes.txt": "no"}))
    out = None
    for names_, near in (written, flat):
        both = names_.select("ctx_id", F.lit(None).cast("string").alias("dir"), "name").unionByName(near)
        out = both if out is None else out.unionByName(both)
    return out


@query("q45_captured_trees", rows("ctx_id string, path string, is_dir boolean, truncated boolean", [("o/r", "a", True, False), ("o/r", "a/b.py", False, False), ("o/s", "c.py", False, True)]))
def q45(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = lambda r, t, *p: json.dumps({"repo": r, "ref": "HEAD", "truncated": t, "tree": [{"path": x, "type": k} for x, k in p]})
    return listing.captured_trees(spark, staging.put(spark, {"r.json": tree("o/r", False, ("a", "tree"), ("a/b.py", "blob")), "s.json": tree("o/s", True, ("c.py", "blob"))}))


@query("q46_pull_pages", rows("repo string, number long, recent boolean, bot boolean", [("o", 1, True, False), ("o", 2, False, False), ("o", 3, True, True), ("o", 4, False, True), ("p", 6, True, False)]))
def q46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages of merged requests up to a repository's first empty one, with the gates on age and author."""
    pull = lambda n, at, login, kind=None: {"number": n, "merged_at": at, "user": {"login": login, "type": kind}}
    pages = {
        "o/1.json": [pull(1, "2025-06-01T00:00:00Z", "ann", "User"), pull(2, None, "ann")], "o/2.json": [pull(3, "2025-06-01T00:00:00Z", "x[bot]"), pull(4, "2020-01-01T00:00:00Z", "y", "Bot")],
        "o/3.json": [], "o/4.json": [pull(5, "2025-06-01T00:00:00Z", "late")], "p/1.json": [pull(6, "2024-01-02T00:00:00Z", None)],
    }
    found = listing.pull_pages(spark, staging.put(spark, {k: json.dumps(v) for k, v in pages.items()}))
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return found.select("repo", "number", corpus.merged_within(F.col("merged_at"), now).alias("recent"), corpus.is_bot(F.col("user.type"), F.col("user.login")).alias("bot"))


TOOL = "import sys,json; d=sys.stdin.read(); c=sys.argv[1]; sys.exit('boom') if d == 'crash' else print(json.dumps([{'name': c, 'line': len(d)}] if d else []))"


@query("q47_tool_runs", rows("case_id string, name string, line long, crashed boolean, failed boolean", [("a", "ctx=", 4, False, False), ("b", "ctx=here", 3, False, False), ("c", None, None, True, False), ("d", None, None, False, False)]))
def q47(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command run per case, with its context filled in; a crash is no empty answer."""
    cases = spark.createDataFrame([("a", "x\ny\n", None), ("b", "abc", "here"), ("c", "crash", None), ("d", None, None)], "case_id string, diff string, context string")
    runs = readers.run_status(readers.parse_findings(tools.run_tool(cases, [sys.executable, "-c", TOOL, "ctx={context}"]).drop("error")))
    return runs.select("case_id", "crashed", F.col("error").isNotNull().alias("failed"), F.explode_outer("findings").alias("f")).select("case_id", "f.name", F.col("f.line").cast("long").alias("line"), "crashed", "failed")


EVENTS = inline.Inline("body string", [('{"pull_request":{"number":7,"head":{"sha":"abc"}},"number":7}',), ('{"number":9,"after":"def"}',), ('{"action":"x"}',), ("no json",)])


@query("q48_event_payload", f"""
SELECT body, CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.pull_request.number'), json_extract_string(body, '$.number'))::BIGINT END AS number,
  CASE WHEN json_valid(body) THEN coalesce(json_extract_string(body, '$.pull_request.head.sha'), json_extract_string(body, '$.after')) END AS sha FROM {EVENTS.sql()}
""")
def q48(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("body")
    return EVENTS.frame(spark).select("body", listing.event_number(body).alias("number"), listing.event_commit(body).alias("sha"))


# ---------------------------------------------------------------- sinks and reports


@query("q49_explain_log", rows("case_id string, k long, line string", [
    ("basic", 1, "suppress\tregistry-hit\trequests\tpkg/app.py:2\trequests"), ("basic", 2, "suppress\tregistry-hit\tflask\tpkg/app.py:3\tflask"), ("basic", 3, "suppress\tregistry-hit\tnumpy\tpkg/app.py:22\tnumpy"), ("basic", 4, "fire\tregistry-404\tpandas\tpkg/app.py:22\tpandas"),
    ("new", 1, "suppress\tfixture-data\t-\ttests/data/x.py\t-"), ("new", 2, "suppress\tfirst-party\tcore\tsrc/core/util.py:1\tcore"), ("new", 3, "suppress\trelative\t\tsrc/core/util.py:2\t"), ("new", 4, "suppress\tregistry-hit\tyaml\tsrc/core/util.py:3\tPyYAML"),
    ("tricky", 1, "suppress\tregistry-hit/manifest\tFlask\trequirements.txt:2\tFlask"), ("tricky", 2, "fire\tregistry-404/manifest\tmy_pkg\trequirements.txt:5\tmy_pkg"),
    ("toml", 1, "fire\tregistry-404/manifest\tleft-pad\tpyproject.toml:5\tleft-pad"), ("toml", 2, "silent\tunverified/manifest\tother\tpyproject.toml:6\tother"), ("toml", 3, "suppress\tregistry-hit/manifest\thttpx\tpyproject.toml:34\thttpx"),
    ("toml", 4, "silent\tunverified/manifest\tpytest\tpyproject.toml:37\tpytest"), ("toml", 5, "silent\tunverified/manifest\truff\tpyproject.toml:37\truff"),
]))
def q49(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision of whole scans, in order."""
    log = sinks.explain_log(scan.decisions(spark, inline.DIFFS.frame(spark), inline.REGISTRY.frame(spark)))
    numbered = log.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("ls")).select("case_id", F.posexplode("ls").alias("k", "l"))
    return numbered.select("case_id", (F.col("k") + 1).cast("long").alias("k"), "l.line")


@query("q50_registry_merge", """
WITH e AS (SELECT 'user_' || user_id AS name, CASE WHEN event_type = 'error' THEN NULL ELSE event_type = 'click' END AS "exists", ts, event_id FROM events)
SELECT replace(name, '_', '-') AS name, arg_max("exists", (ts, event_id)) AS "exists" FROM e WHERE "exists" IS NOT NULL GROUP BY 1
""")
def q50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry table after a run, written and read again: definite answers only, the latest of each name."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("user_"), "user_id").alias("name"), F.lit(0).alias("status"), F.when(F.col("event_type") != "error", F.col("event_type") == "click").alias("exists"), F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("checked"))
    early = F.col("checked") < "2024-01-15"
    return sinks.write_registry(spark, e.where(early & F.col("exists").isNotNull()), e.where(~early), staging.shared_folder(spark)).select("name", "exists")


@query("q51_report_text", f"""
WITH {TOY_SQL}, r AS (SELECT CASE WHEN grouping(corpus) = 1 THEN 'TOTAL' ELSE corpus END AS corpus, count(*) AS cases, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(CASE WHEN label = 'clean' THEN findings ELSE 0 END) AS noise FROM c GROUP BY ROLLUP (corpus)),
m AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + fn, 0) AS q FROM r), n AS (SELECT *, CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * p * q / (p + q) END AS f FROM m)
SELECT corpus, rpad(corpus, 14, ' ') || ' ' || lpad(cases::VARCHAR, 6, ' ') || ' ' || lpad(tp::VARCHAR, 6, ' ') || ' ' || lpad(fp::VARCHAR, 6, ' ') || ' ' || lpad(fn::VARCHAR, 6, ' ') || ' ' || lpad(noise::VARCHAR, 6, ' ')
  || ' ' || lpad(coalesce(format('{{:.1f}}%', p * 100), '-'), 8, ' ') || ' ' || lpad(coalesce(format('{{:.1f}}%', q * 100), '-'), 8, ' ') || ' ' || lpad(coalesce(format('{{:.1f}}%', f * 100), '-'), 8, ' ') AS line FROM n
""")
def q51(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.report_text(scoring.corpus_report(scoring.case_counts(*toy_tool(spark, sf_dir))))


@query("q52_report_json", rows("body string", [(
    '{"tool":"t","match":"file","corpora":[{"corpus":"good","cases":2,"findings":2,"tp":0,"fp":1,"fn":0,"precision":0.0,"recall":null,"f1":null,"noise":2,"kinds":{},"unlocated":0,"errors":[]},'
    '{"corpus":"seeded","cases":3,"findings":6,"tp":2,"fp":2,"fn":3,"precision":0.5,"recall":0.4,"f1":0.4444444444444445,"noise":0,"kinds":{"?":{"hits":0,"total":1},"import":{"hits":1,"total":3},"requirement":{"hits":1,"total":1}},"unlocated":1,"errors":["c3: boom"]}],'
    '"total":{"corpus":"TOTAL","cases":5,"findings":8,"tp":2,"fp":3,"fn":3,"precision":0.4,"recall":0.4,"f1":0.4000000000000001,"noise":2,"kinds":{"?":{"hits":0,"total":1},"import":{"hits":1,"total":3},"requirement":{"hits":1,"total":1}},"unlocated":1,"errors":["c3: boom"]}}',
)]))
def q52(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = spark.createDataFrame([("c3", "boom")], "case_id string, error string")
    return render.report_json("t", "file", inline.CASES.frame(spark), inline.TRUTHS.frame(spark), inline.FINDINGS.frame(spark), errors)


QA_REGISTRY = inline.Inline("name string, status int, exists boolean, checked string", [("numpy", 200, True, "d"), ("PyYAML", 200, True, "d"), ("six", 200, True, "d"), ("flask", 200, True, "d"), ("left-pad", 404, False, "d"), ("requests", 404, False, "d")])
QA_OWN = inline.Inline("repo string, top string", [("r/core", "core")])
QA_KEPT = inline.Inline("case_id string, name string", [("odd", "pkg.sub"), ("basic", "requests"), ("needs", "nothing")])
_std = ", ".join(f"'{n}'" for n in ("os", "sys", "json"))
QA_SQL = f"""{ADDED_SQL}, f AS (SELECT *, ends_with(path, '.py') AS py, regexp_matches(path, '(^|/)requirements[^/]*[.]txt$') AS req, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS spec,
  regexp_extract(content, '^\\s*import\\s+([A-Za-z_][\\w.]*(?:\\s*,\\s*[A-Za-z_][\\w.]*)*)', 1) AS imp, regexp_extract(content, '^\\s*from\\s+([A-Za-z_.][\\w.]*)\\s+import\\b', 1) AS org FROM a),
n AS (
  SELECT case_id, pos, unnest(regexp_split_to_array(imp, '\\s*,\\s*')) AS name, 'import' AS kind FROM f WHERE py AND imp <> ''
  UNION ALL SELECT case_id, pos, org, CASE WHEN starts_with(org, '.') THEN 'relative' ELSE 'from-import' END FROM f WHERE py AND imp = '' AND org <> ''
  UNION ALL SELECT case_id, pos, regexp_extract(spec, '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1), 'requirement' FROM f
    WHERE req AND NOT py AND spec[1] NOT IN ('#', '-') AND NOT contains(spec, '://') AND NOT contains(spec, ' @ ') AND regexp_matches(spec, '^[A-Za-z0-9]')
), t AS (SELECT *, CASE kind WHEN 'relative' THEN '' WHEN 'requirement' THEN {norm_sql("name")} ELSE split_part(name, '.', 1) END AS top FROM n),
d AS (SELECT *, CASE WHEN top = 'yaml' AND kind <> 'requirement' THEN 'pyyaml' ELSE {norm_sql("top")} END AS dist FROM t),
g AS (SELECT d.*, coalesce(r."exists", false) AS here, o.top IS NOT NULL AS own, k1.name IS NOT NULL OR k2.name IS NOT NULL AS kept FROM d
  LEFT JOIN (SELECT {norm_sql("name")} AS norm, "exists" FROM {QA_REGISTRY.sql().replace("exists", '"exists"')}) r ON r.norm = CASE WHEN d.kind = 'requirement' THEN d.top ELSE d.dist END
  LEFT JOIN {QA_OWN.sql()} o ON o.top = d.top LEFT JOIN {QA_KEPT.sql()} k1 ON k1.case_id = d.case_id AND k1.name = d.top LEFT JOIN {QA_KEPT.sql()} k2 ON k2.case_id = d.case_id AND k2.name = d.name),
s AS (SELECT *, CASE WHEN kind = 'relative' THEN 'relative' WHEN kind = 'requirement' THEN CASE WHEN here THEN 'pypi' WHEN kept THEN 'adjudicated-keep' ELSE 'unresolved' END WHEN top IN ({_std}) THEN 'stdlib' WHEN own THEN 'first-party'
  WHEN here AND top = 'yaml' THEN 'pypi-alias' WHEN here THEN 'pypi' WHEN kept THEN 'adjudicated-keep' ELSE 'unresolved' END AS status FROM g)"""


def qa_decisions(spark: SparkSession) -> DataFrame:
    """The corpus check on the coarse candidates of COARSE: resolved, and adjudicated names kept."""
    found = imports.qa_candidates(diffs.coarse_added(COARSE.frame(spark))).withColumnRenamed("path", "file")
    own = found.select("case_id").distinct().join(F.broadcast(QA_OWN.frame(spark).select("top")))
    resolved = cascade.resolve_imports(found, refdata.stdlib(spark), refdata.aliases(spark), QA_REGISTRY.frame(spark), own, rules=cascade.QA_RULES)
    order = F.concat_ws(" ", "case_id", F.lpad(F.col("pos").cast("string"), 9, "0"), F.lpad(F.col("k").cast("string"), 4, "0"))
    rows_ = resolved.select("case_id", F.lit("o/r").alias("repo"), order.alias("ord"), "kind", "name", "top", "file", (F.col("pos") + 1).alias("line"), "reason", "verdict", F.lit("e").alias("evidence"), F.array(F.lit("none")).alias("signals"))
    return cascade.closed(cascade.adjudicate(rows_, QA_KEPT.frame(spark)))


@query("q53_qa_occurrences", f"WITH {QA_SQL} SELECT status, count(*)::BIGINT AS n FROM s GROUP BY status")
def q53(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.verification_report(qa_decisions(spark))[0]


@query("q53b_qa_names", f"""
WITH {QA_SQL}, o AS (SELECT *, coalesce(nullif(top, ''), name) AS shown, case_id || ' ' || lpad(pos::VARCHAR, 9, '0') AS ord FROM s), c AS (SELECT kind, shown, case_id, min(ord) AS o, arg_min(status, ord) AS status FROM o GROUP BY ALL)
SELECT kind, shown AS name, arg_min(status, o) AS status, string_agg(case_id, ',' ORDER BY o) AS cases FROM c GROUP BY ALL
""")
def q53b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.verification_report(qa_decisions(spark))[1].select("kind", "name", "status", F.array_join("cases", ",").alias("cases"))


@query("q53c_qa_unresolved", f"WITH {QA_SQL} SELECT case_id, name, kind, pos + 1 AS line FROM s WHERE status = 'unresolved'")
def q53c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.verification_report(qa_decisions(spark))[2].select("case_id", "name", "kind", F.col("line").cast("long").alias("line"))


@query("q53d_qa_checked_names", f"""
WITH {QA_SQL}, o AS (SELECT *, coalesce(nullif(top, ''), name) AS shown, case_id || ' ' || lpad(pos::VARCHAR, 9, '0') AS ord FROM s) SELECT count(*)::BIGINT AS names FROM (SELECT kind, shown, arg_min(status, ord) AS status FROM o GROUP BY kind, shown) WHERE status IN ('pypi', 'pypi-alias')
""")
def q53d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.registry_checked(sinks.verification_report(qa_decisions(spark))[1])


@query("q54_annotations", f"SELECT case_id, '::warning file=' || coalesce(file, '') || ',line=' || coalesce(line, 0) || '::' || coalesce(message, '') AS line FROM {inline.FINDINGS.sql()}")
def q54(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.annotations(inline.FINDINGS.frame(spark))


@query("q55_exit_codes", "SELECT unnest([2, 1, 0, 2]) AS code, unnest(['found and failed', 'found', 'nothing', 'failed']) AS run")
def q55(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, failed = inline.FINDINGS.frame(spark), spark.createDataFrame([("c", "e")], "case_id string, error string")
    out = None
    for run, f, e in (("found and failed", found, failed), ("found", found, failed.limit(0)), ("nothing", found.limit(0), failed.limit(0)), ("failed", found.limit(0), failed)):
        one = sinks.exit_code(f, e).withColumn("run", F.lit(run))
        out = one if out is None else out.unionByName(one)
    return out


ABSENT = inline.Inline("case_id string, name string, verified_absent string", [("a", "left.pad", "2024-01-01"), ("b", "My_Pkg", None)])


@query("q56_absence_stamp", rows("case_id string, name string, verified_absent string, snapshot string", [("a", "left.pad", "2026-02-03", "all absent"), ("b", "My_Pkg", "2026-02-03", "all absent"), ("a", "left.pad", "2024-01-01", "one appeared"), ("b", "My_Pkg", None, "one appeared")]))
def q56(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps are written only if every name is still absent."""
    truths, snapshot = ABSENT.frame(spark), inline.REGISTRY.frame(spark)
    appeared = snapshot.withColumn("exists", F.col("exists") | (F.col("name") == "my-pkg"))
    one = sinks.stamp_absent(truths, snapshot, "2026-02-03").withColumn("snapshot", F.lit("all absent"))
    return one.unionByName(sinks.stamp_absent(truths, appeared, "2026-02-03").withColumn("snapshot", F.lit("one appeared")))


# ---------------------------------------------------------------- mining and corpus upkeep


@query("q57_mined", """
WITH p AS (SELECT 'o/c' || o_custkey AS repo, o_orderkey AS number, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS merged, o_orderpriority AS prio, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
g AS (SELECT *, CASE WHEN merged IS NULL THEN 'not merged' WHEN merged < TIMESTAMP '1998-06-01' - INTERVAL 730 DAY THEN 'too old' WHEN prio = '2-HIGH' THEN 'bot' WHEN prio = '1-URGENT' THEN 'already mined' WHEN prio = '3-MEDIUM' THEN 'no import or requirement' ELSE 'kept' END AS gate FROM p),
c AS (SELECT *, coalesce(sum(CASE WHEN gate IN ('kept', 'already mined') THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM g)
SELECT repo, number, gate FROM c WHERE had < 2
""")
def q57(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The miner over orders as requests: gates in order, requests mined before count toward the cap."""
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("o/c"), "o_custkey").alias("repo"), F.col("o_orderkey").alias("number"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp")).alias("merged_at"), F.col("o_orderpriority").alias("prio"))
    case_id = F.concat(F.replace("repo", F.lit("/"), F.lit("__")), F.lit("__pr"), F.col("number").cast("string")).alias("case_id")
    pulls = o.select("repo", F.col("number").alias("pos"), "number", "merged_at", F.when(F.col("prio") == "2-HIGH", "Bot").alias("user_type"), F.lit("u").alias("user_login")).withColumnRenamed("user_login", "login")
    line = F.when(F.col("prio") == "3-MEDIUM", "x = 1").otherwise("import x")
    texts = o.select(case_id, F.concat(F.lit("diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -0,0 +1 @@\n+"), line, F.lit("\n")).alias("diff"))
    return corpus.mined(pulls, texts, o.where("prio = '1-URGENT'").select(case_id), F.lit("1998-06-01").cast("timestamp"), target=2).select("repo", "number", "gate")


@query("q58_diff_gates", f"""
WITH {ADDED_SQL}, q AS (SELECT case_id, bool_or(starts_with(raw, '+++ b/') AND ends_with(raw, '.py')) AS touches_python FROM raw GROUP BY 1),
b AS (SELECT *, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS s FROM a),
h AS (SELECT case_id, bool_or(CASE WHEN path IS NULL THEN false WHEN ends_with(path, '.py') THEN regexp_matches(content, '^\\s*(import|from)\\s+[A-Za-z_.]') WHEN NOT regexp_matches(path, '(^|/)(requirements[^/]*[.]txt|pyproject[.]toml|setup[.]py|setup[.]cfg)$') THEN false WHEN s = '' OR s[1] = '#' THEN false
  WHEN ends_with(path, '.txt') THEN s[1] <> '-' AND NOT contains(s, '://') ELSE regexp_matches(trim(trim(s, ','), chr(34) || chr(39)), '^[A-Za-z0-9][A-Za-z0-9._-]*(\\[[^\\]]+\\])?\\s*(((===|==|>=|<=|~=|!=|>|<)\\S*|;.*))?$') END) AS adds_name FROM b GROUP BY 1)
SELECT q.case_id, touches_python, coalesce(adds_name, false) AS adds_name FROM q LEFT JOIN h USING (case_id)
""")
def q58(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.diff_gates(COARSE.frame(spark))


TREE = inline.Inline("repo string, path string", [("r", "inner.py"), ("r", "src/deep"), ("r", "both"), ("r", "both.py"), ("q", "gone")])
OPEN = inline.Inline("case_id string, repo string, ord long, top string, file string", [("a", "r", 1, "inner", "x.py"), ("a", "r", 2, "deep", "x.py"), ("b", "r", 3, "both", "Tests/x.py"), ("b", "r", 4, "reqests", "x.py"), ("b", "r", 5, "zzzz", "x.py"), ("a", "r", 6, "gone", "x.py")])
GUARDS = inline.Inline("case_id string, diff string", [("a", "+try:\n+    import x\n+except (ImportError, ValueError):\n"), ("b", "+except ValueError:\n")])


@query("q59_diagnosis", rows("ord long, probe string, near string, signals string", [
    (1, "inner.py", None, "exists in tree,guarded import"), (2, "src/deep", None, "exists in tree,guarded import"), (3, "both", None, "exists in tree,test file"), (4, None, "requests", "near requests"), (5, None, None, "none"), (6, None, None, "guarded import"),
]))
def q59(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(n,) for n in corpus.POPULAR.split()], "name string")
    found = corpus.diagnose(OPEN.frame(spark), TREE.frame(spark), known, GUARDS.frame(spark))
    return found.select("ord", "probe", "near", F.array_join("signals", ",").alias("signals"))


MISSPELT = ("reqursts", "numpi", "pandsa", "beautifulsuop4", "crytpograhpy", "setuptool", "virtalenvs", "flaks", "ruff", "pillows", "urlib3", "matplot", "sqlalchmey", "cover", "mipy", "")
_close = [(w, m[0], round(difflib.SequenceMatcher(None, m[0], w).ratio(), 9)) for w in MISSPELT if (m := difflib.get_close_matches(w, corpus.POPULAR.split(), n=1, cutoff=0.8))]


@query("q59b_close_names", rows("name string, near string, ratio double", _close))
def q59b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest well-known name; the expected rows compare every pair."""
    known = spark.createDataFrame([(n,) for n in corpus.POPULAR.split()], "name string")
    found = corpus.close_names(spark.createDataFrame([(w,) for w in MISSPELT], "name string"), known)
    return found.withColumn("ratio", F.round("ratio", 9))


# ---------------------------------------------------------------- scans of many diffs

PART_SQL = """p AS (SELECT p_partkey, lower(p_type) AS own, string_split(p_name, ' ') AS ws, replace(lower(p_brand), '#', '_') AS brand, p_size FROM part),
c AS (
  SELECT p_partkey, own, ws, p_size, 'import' AS kind, unnest(ws) AS name, unnest(range(1, len(ws) + 1)) AS line FROM p
  UNION ALL SELECT p_partkey, own, ws, p_size, 'import', brand, len(ws) + 1 FROM p
  UNION ALL SELECT p_partkey, own, ws, p_size, 'import', own, len(ws) + 2 FROM p
  UNION ALL SELECT p_partkey, own, ws, p_size, 'import', 'os', len(ws) + 3 FROM p
  UNION ALL SELECT p_partkey, own, ws, p_size, 'requirement', brand, 1 FROM p
), reg AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name, true AS here FROM part UNION SELECT DISTINCT replace(lower(p_brand), '#', '_'), false FROM part WHERE length(p_brand) = 7),
r AS (SELECT c.*, CASE WHEN here THEN 'exists' WHEN NOT here THEN 'absent' ELSE 'unknown' END AS registry, name = ws[2] AND p_size > 25 AS in_repo, name = ws[2] AND p_size BETWEEN 11 AND 25 AS beside FROM c LEFT JOIN reg USING (name)),
d AS (SELECT *, CASE WHEN kind = 'requirement' THEN CASE registry WHEN 'exists' THEN 'registry-hit/manifest' WHEN 'absent' THEN 'registry-404/manifest' ELSE 'unverified/manifest' END
  WHEN name = 'os' THEN 'stdlib' WHEN name = own THEN 'first-party' WHEN in_repo THEN 'first-party/repo' WHEN beside THEN 'first-party/sibling' WHEN registry = 'exists' THEN 'registry-hit' WHEN registry = 'absent' THEN 'registry-404' ELSE 'unverified' END AS reason FROM r)"""


def part_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(diffs, registry, repo_top, siblings): one diff of two files for every part."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("case_id"), F.lower("p_type").alias("own"), F.split("p_name", " ").alias("ws"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")).alias("brand"), "p_size", "p_brand")
    path = F.concat(F.lit("src/"), "own", F.lit("/p"), "case_id", F.lit(".py"))
    lines = F.concat(F.transform("ws", lambda w: F.concat(F.lit("+import "), w)), F.array(F.concat(F.lit("+from "), "brand", F.lit(" import x")), F.concat(F.lit("+import "), "own", F.lit(".sub as y")), F.lit("+import os")))
    text = F.concat(
        F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"), F.array_join(lines, "\n"),
        F.lit("\ndiff --git a/requirements.txt b/requirements.txt\n--- a/requirements.txt\n+++ b/requirements.txt\n@@ -0,0 +1 @@\n+"), F.col("brand"), F.lit("==1.0\n"),
    )
    first = p.select(F.get("ws", F.lit(0)).alias("name"), F.lit(True).alias("exists"))
    registry = first.unionByName(p.where("length(p_brand) = 7").select(F.col("brand").alias("name"), F.lit(False).alias("exists"))).distinct()
    second = F.get("ws", F.lit(1)).alias("top")
    siblings = p.where("p_size BETWEEN 11 AND 25").select("case_id", F.concat(F.lit("src/"), "own").alias("dir"), second)
    return p.select("case_id", text.alias("diff")), registry, p.where("p_size > 25").select("case_id", second), siblings


@query("q60_scan_many", f"WITH {PART_SQL} SELECT kind, reason, count(*)::BIGINT AS n, sum(line)::BIGINT AS lines, sum(p_partkey)::BIGINT AS cases FROM d GROUP BY ALL")
def q60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every decision of a diff per part: all rules of the cascade, with a repository's names and its siblings."""
    table, registry, top, beside = part_inputs(spark, sf_dir)
    found = scan.decisions(spark, table, registry, top, beside)
    kind = F.when(F.col("kind") == "requirement", "requirement").otherwise("import").alias("kind")
    return found.groupBy(kind, "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("line").alias("lines"), F.sum(F.col("case_id").cast("long")).alias("cases"))


@query("q60b_findings_many", f"""
WITH {PART_SQL}, f AS (SELECT * FROM d WHERE reason LIKE 'registry-404%')
SELECT p_partkey::VARCHAR AS case_id, string_agg(name || ':' || line, ',' ORDER BY kind = 'requirement', line) AS found FROM f GROUP BY 1
""")
def q60b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of each diff, in order."""
    table, registry, top, beside = part_inputs(spark, sf_dir)
    found = scan.scan(spark, table, registry, top, beside)
    listed = F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(":", "name", F.col("line").cast("string")).alias("t"))))
    return found.groupBy("case_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), ",").alias("found"))


@query("q61_distinct_lookups", f"WITH {PART_SQL} SELECT DISTINCT {norm_sql('name')} AS norm FROM c")
def q61(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that a source without a table would be asked for, each once."""
    table = part_inputs(spark, sf_dir)[0]
    none = spark.createDataFrame([], "name string, exists boolean")
    return cascade.distinct_names(scan.decisions(spark, table, none, known_once=True))


@query("q62_case_names", f"""
WITH t AS (SELECT *, {norm_sql('name')} AS norm FROM {inline.TRUTHS.sql()}), f AS (SELECT *, {norm_sql('name')} AS norm FROM {inline.FINDINGS.sql()}),
h AS (SELECT t.case_id, t.name, t.norm, bool_or(f.norm IS NOT NULL AND (coalesce(t.file, '') = '' OR f.file = t.file)) AS hit, bool_or(f.norm IS NOT NULL) AND NOT bool_or(coalesce(f.file, '') <> '') AS nowhere FROM t LEFT JOIN f ON f.case_id = t.case_id AND f.norm = t.norm GROUP BY ALL),
x AS (SELECT DISTINCT f.case_id, f.name FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.hit AND h.case_id = f.case_id AND h.norm = f.norm))
SELECT c.case_id, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM h WHERE hit AND h.case_id = c.case_id), '') AS tp, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM x WHERE x.case_id = c.case_id), '') AS fp,
  coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM h WHERE NOT coalesce(hit, false) AND h.case_id = c.case_id), '') AS fn, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM h WHERE NOT coalesce(hit, false) AND nowhere AND h.case_id = c.case_id), '') AS unlocated
FROM {inline.CASES.sql()} c
""")
def q62(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.case_names(inline.CASES.frame(spark), inline.TRUTHS.frame(spark), inline.FINDINGS.frame(spark))
    return found.select("case_id", *[F.array_join(f"{c}_names", ",").alias(c) for c in ("tp", "fp", "fn", "unlocated")])


@query("q63_first_match", "SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE event_type = 'error' GROUP BY user_id")
def q63(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return corpus.first_match(rows_, ["user_id"], ["event_id"], F.col("event_type") == "error").select("user_id", "event_id", "value")


@query("q64_first_party_of_repo", """
SELECT DISTINCT * FROM (SELECT 'b_' || p_brand AS repo, lower(p_type) AS top FROM part UNION ALL SELECT 'b_' || p_brand, split_part(p_name, ' ', 1) FROM part WHERE p_size > 40 UNION ALL SELECT 'b_Brand#1', 'known')
""")
def q64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of changed files, of a listing and known beforehand, together."""
    p = read(spark, sf_dir, "part").withColumn("repo", F.concat(F.lit("b_"), "p_brand")).withColumn("case_id", F.col("p_partkey"))
    files = p.select("case_id", F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/x.py")).alias("new_path"))
    known = spark.createDataFrame([("b_Brand#1", "known")], "repo string, top string")
    return repo.first_party_of_repo(files, p.select("case_id", "repo"), p.where("p_size > 40").select("repo", F.substring_index("p_name", " ", 1).alias("top")), known)


@query("q65_list_upkeep", """
SELECT 'lost' AS what, n_name AS name, NULL::BIGINT AS n FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT 'missing', 'names', count(*)::BIGINT FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT 'listed', 'whole: false', count(*)::BIGINT FROM nation WHERE n_nationkey < 20
""")
def q65(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regenerated list that lost names: which ones, and whether it covers what it must."""
    names_ = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    new = names_.where("n_nationkey < 20")
    whole = corpus.coverage(new, names_, 10)
    gone = corpus.lost(names_, new).select(F.lit("lost").alias("what"), "name", F.lit(None).cast("long").alias("n"))
    missing = whole.select(F.lit("missing").alias("what"), F.lit("names").alias("name"), F.col("missing").alias("n"))
    return gone.unionByName(missing).unionByName(whole.select(F.lit("listed").alias("what"), F.concat(F.lit("whole: "), F.col("whole").cast("string")).alias("name"), F.col("listed").alias("n")))


@query("q65b_standard_names", rows("listed_enough boolean, missing long", [(True, 0)]))
def q65b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard names cover the interpreter that runs."""
    here = spark.createDataFrame([(n,) for n in {*sys.stdlib_module_names, *sys.builtin_module_names}], "name string")
    return corpus.coverage(refdata.stdlib(spark), here, 280).select((F.col("listed") > 280).alias("listed_enough"), "missing")


@query("q66_context_preference", """
SELECT 'c' || p_partkey AS ctx_id, lower(p_type) AS name FROM part WHERE p_size > 25 UNION ALL SELECT 'c' || p_partkey, split_part(p_name, ' ', 1) FROM part WHERE p_size <= 25
""")
def q66(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A captured listing comes before a checkout."""
    p = read(spark, sf_dir, "part").withColumn("ctx_id", F.concat(F.lit("c"), F.col("p_partkey").cast("string")))
    return repo.preferred(p.where("p_size > 25").select("ctx_id", F.lower("p_type").alias("name")), p.select("ctx_id", F.substring_index("p_name", " ", 1).alias("name")))


@query("q67_headless", rows("case_id string, warning string", [("plain", "no file section"), ("late", "no file section")]))
def q67(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are no diff at all, which would pass in silence."""
    return diffs.headless(spark.createDataFrame([("plain", "--- a\n+++ b\n"), ("late", "x diff --git a b\n"), ("blank", " \n"), ("none", None), ("good", "note\ndiff --git a/a b/a\n")], "case_id string, diff string"))


@query("q68_mining_report", """
WITH c AS (SELECT n_name AS repo, CASE WHEN o_orderstatus = 'P' THEN 'not merged' WHEN o_totalprice > 200000 THEN 'too large' ELSE 'kept' END AS gate, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT repo, '{"examined":' || sum(n)::BIGINT || ',"gates":{' || string_agg('"' || gate || '":' || n, ',' ORDER BY gate) || '}}' AS body FROM c GROUP BY repo
""")
def q68(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of two runs, over early and late orders, merged."""
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.withColumnRenamed("n_name", "repo")
    gates = [("not merged", "o_orderstatus = 'P'"), ("too large", "o_totalprice > 200000")]
    early = F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")
    return corpus.mining_report(corpus.funnel(joined.where(early), "repo", gates), corpus.funnel(joined.where(~early), "repo", gates))


@query("q69_tagged_contexts", "SELECT p_partkey AS id, p_brand AS repo, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'context/' || p_brand || '.json' WHEN p_size > 25 THEN 'old' END AS context FROM part")
def q69(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("repo"), F.when(F.col("p_size") > 25, "old").alias("context"))
    found = spark.createDataFrame([(b, f"context/{b}.json") for b in ("Brand#1", "Brand#2")], "repo string, context string")
    return sinks.tag_contexts(cases, found).select("id", "repo", "context")


@query("q70_import_lines", rows("case_id string, module string, raw string", [
    ("plain", "a.b", "import a.b, c as d; import e"), ("plain", "c", "import a.b, c as d; import e"), ("plain", "e", "import a.b, c as d; import e"), ("plain", "f.g", "from f.g import ("), ("plain", ".", "from . import j"), ("plain", "..k", "from ..k import l"),
    ("traps", "yes", 's = "import no" ; import yes'), ("traps", "z", "if x: import z"), ("traps", "t", "try: import t"), ("traps", "u", "import \\"), ("nested", "inner", "import inner"), ("nested", "m", "from m import (a, # c"),
]))
def q70(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that each import starts on, trimmed."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("text"), (i + 1).alias("new_line"), F.lit(True).alias("added")))
    images = SOURCES.frame(spark).select("case_id", F.lit(1).alias("file_id"), F.lit("x.py").alias("file"), lines.alias("rows"))
    return imports.lexed_imports(images).select("case_id", "module", "raw")


@query("q71_touched_siblings", "SELECT DISTINCT p_brand AS ctx_id, lower(p_type) AS dir, split_part(p_name, ' ', 2) AS name FROM part WHERE (p_brand, lower(p_type)) IN (SELECT p_brand, lower(p_type) FROM part WHERE p_size > 45)")
def q71(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("ctx_id"), F.lower("p_type").alias("dir"), F.get(F.split("p_name", " "), F.lit(1)).alias("name"), "p_size")
    return repo.touched(p.select("ctx_id", "dir", "name").distinct(), p.where("p_size > 45"))


@query("q72_marked_comment", f"SELECT case_id, '<!-- found -->' || chr(10) || CASE WHEN count(*) = 1 THEN '1 name could not be found' ELSE count(*) || ' names could not be found' END AS start FROM {inline.FINDINGS.sql()} GROUP BY case_id")
def q72(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment that a later run can find again."""
    body = render.findings_markdown(inline.FINDINGS.frame(spark), marker="found")
    return body.select("case_id", F.substring_index("body", "\n", 2).alias("start"))


@query("q73_adjudicated", rows("case_id string, name string", [("e", "kept")]))
def q73(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.adjudicated(readers.manifest(spark, staging.put(spark, CORPUS) + "/manifest.jsonl"))


@query("q74_name_expressions", "SELECT p_name AS name, format('{:.1f}%', p_size / 7.0 * 100) AS share, CASE WHEN p_size > 25 THEN 'f' || p_size || ':' || p_size ELSE 'f' || p_size END AS place FROM part")
def q74(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    file = F.concat(F.lit("f"), F.col("p_size").cast("string"))
    return p.select(F.col("p_name").alias("name"), names.percent(F.col("p_size") / 7.0).alias("share"), names.location(file, F.when(F.col("p_size") > 25, F.col("p_size"))).alias("place"))


@query("q75_near_truths", "SELECT s_suppkey, (s_suppkey, s_nationkey) IN (SELECT p_partkey, p_size FROM part) AS same FROM supplier")
def q75(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag by several keys."""
    pairs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("s_suppkey"), F.col("p_size").alias("s_nationkey"))
    return cascade.flag(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), pairs, ["s_suppkey", "s_nationkey"], "same").select("s_suppkey", "same")


@query("q76_issue_actions", "SELECT n_name AS title, min(s_suppkey) AS number, CASE WHEN min(s_suppkey) IS NULL THEN 'open' ELSE 'update' END AS action FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY n_name")
def q76(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One issue per title, found again by its title."""
    nation = read(spark, sf_dir, "nation")
    issues = read(spark, sf_dir, "supplier").where("s_acctbal > 9000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("number"), F.col("n_name").alias("title"))
    return corpus.issue_actions(nation.select(F.col("n_name").alias("title"), F.lit("b").alias("body")), issues).drop("body")


@query("q77_verified_assets", """
SELECT p_brand AS release, p_partkey::VARCHAR AS name, CASE WHEN p_size > 40 THEN 'unlisted' WHEN p_size > 20 THEN 'failed' ELSE 'verified' END AS verdict FROM part
""")
def q77(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads against the lines of their release's list of digests."""
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("release"), F.col("p_partkey").cast("string").alias("name"), F.sha2(F.col("p_partkey").cast("string").cast("binary"), 256).alias("sha256"), "p_size")
    said = F.when(F.col("p_size") > 20, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.upper("sha256"))
    line = F.when(F.col("p_size") <= 40, F.concat(said, F.lit("  *"), "name"))
    sums = p.groupBy("release").agg(F.concat(F.lit("# sums\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    return corpus.verified_assets(p.drop("p_size"), sums).select("release", "name", "verdict")


def _answers(address: str) -> live.Answer:
    """What a registry would say: by the length of the name asked for, and nothing at all for some."""
    name = address.split("/")[-2]
    return live.Answer(None, error="URLError: no route") if len(name) > 4 else live.Answer({3: 404, 4: 200}.get(len(name), 429), "{}")


@query("q78_live_lookups", f"""
WITH {PART_SQL}, n AS (SELECT DISTINCT name FROM c WHERE kind = 'import' AND name = ws[1])
SELECT name, CASE length(name) WHEN 3 THEN 404 WHEN 4 THEN 200 ELSE CASE WHEN length(name) > 4 THEN NULL ELSE 429 END END::INT AS status, CASE length(name) WHEN 4 THEN true WHEN 3 THEN false END AS "exists" FROM n
""")
def q78(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names asked of a source without a table; what doesn't answer is unknown."""
    first = read(spark, sf_dir, "part").select(F.substring_index("p_name", " ", 1).alias("dist"))
    return live.registry(cascade.distinct_names(first), "https://host/pypi/", _answers, "2026-01-01", tasks=2, pause=0).select("name", "status", "exists")


@query("q79_live_diffs", rows("case_id string, diff string, error string", [("a", "{}", None), ("b", None, "status 404"), ("c", None, "URLError: no route"), ("d", None, "status 429")]))
def q79(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs that can't be had are null and say why."""
    cases = spark.createDataFrame([("a", "h/abcd/x"), ("b", "h/abc/x"), ("c", "h/abcdef/x"), ("d", "h/a/x")], "case_id string, address string")
    return live.diffs(cases, _answers, pause=0)


def _new(path: str, *lines: str) -> str:
    return f"diff --git a/{path} b/{path}\n--- /dev/null\n+++ b/{path}\n@@ -0,0 +1,{len(lines)} @@\n" + "".join(f"+{x}\n" for x in lines)


_SEEDED = {"h1": (_new("m.py", "import os", "import fakelib as f"), "fakelib", "m.py", "import"), "h2": (_new("n.py", "from ghostpkg import x", "import json"), "ghostpkg", "n.py", "import"), "h3": (_new("requirements.txt", "phantom-lib==1.0", "six"), "phantom_lib", "requirements.txt", "requirement")}
_CLEAN = {"c1": _new("a.py", "import sys", "import re"), "c2": _new("README.md", "import this line"), "c3": _new("b.py", "x = 1")}
GOLDEN = {
    "manifest.jsonl": "\n".join([*(json.dumps({"id": i, "label": "hallucination", "truth": [{"name": n, "file": f, "kind": k}]}) for i, (_, n, f, k) in _SEEDED.items()), *(json.dumps({"id": i, "label": "clean"}) for i in _CLEAN)]),
    **{f"diffs/{i}.diff": d for i, (d, *_) in _SEEDED.items()}, **{f"diffs/{i}.diff": d for i, d in _CLEAN.items()},
}


@query("q80_golden_counts", rows("tool string, label string, cases long, tp long, fp long, fn long", [
    ("every", "clean", 3, 0, 3, 0), ("every", "hallucination", 3, 2, 2, 1), ("listed", "clean", 3, 0, 0, 0), ("listed", "hallucination", 3, 3, 0, 0), ("none", "clean", 3, 0, 0, 0), ("none", "hallucination", 3, 0, 0, 3),
]))
def q80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a corpus folder to scores: its cases, their diffs, three tools, and what they hit, miss and invent."""
    found = readers.case_diffs(spark, staging.put(spark, GOLDEN))
    cases = found.select("case_id", F.lit("golden").alias("corpus"), "label")
    truths = found.select("case_id", F.posexplode("truth").alias("truth_id", "t")).select("case_id", "truth_id", "t.name", "t.file", "t.kind")
    lines = diffs.coarse_added(found.select("case_id", "diff"))
    out = None
    for tool, said in {"every": imports.every_import_once(lines), "listed": imports.listed_imports(lines, ["fakelib", "ghostpkg", "phantom_lib"]), "none": imports.no_findings(lines)}.items():
        one = scoring.case_counts(cases, truths, said.select("case_id", "name", "file")).groupBy("label").agg(F.count(F.lit(1)).alias("cases"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("tool", F.lit(tool))
        out = one if out is None else out.unionByName(one)
    return out
