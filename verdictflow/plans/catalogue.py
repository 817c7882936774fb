"""The query catalogue: every operator over the driver's tables or over inline inputs, with DuckDB SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics, names
from ..operators import cascade, corpus, diffs, imports, manifests, render, repo, scoring
from ..sources import readers, refdata
from . import inline, scan

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def norm_sql(x: str) -> str:
    return f"lower(regexp_replace(trim({x}), '[-_.]+', '-', 'g'))"


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, token: distinct lower-case words of each whole text."""
    text = F.lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", "source", "lang", F.explode(F.array_distinct(F.split(text, "[^a-z]+"))).alias("token")).where("token <> ''")


TOKENS_SQL = """tok AS (
  SELECT DISTINCT doc_id, source, lang, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS token FROM documents
), t AS (SELECT * FROM tok WHERE token <> ''), reg AS (
  SELECT DISTINCT unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS token FROM benchmark
), fp AS (SELECT source, token FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) > 1)"""


@query("q01_cascade_verdicts", f"""
WITH {TOKENS_SQL}
SELECT CASE WHEN length(t.token) <= 2 THEN 'suppress' WHEN fp.token IS NOT NULL THEN 'suppress' WHEN lang <> 'en' OR lang IS NULL THEN 'silent' WHEN reg.token IS NOT NULL THEN 'suppress' ELSE 'fire' END AS verdict,
  CASE WHEN length(t.token) <= 2 THEN 'stdlib' WHEN fp.token IS NOT NULL THEN 'first-party' WHEN lang <> 'en' OR lang IS NULL THEN 'unverified' WHEN reg.token IS NOT NULL THEN 'registry-hit' ELSE 'registry-404' END AS reason,
  count(*)::BIGINT AS n
FROM t LEFT JOIN fp USING (source, token) LEFT JOIN reg ON reg.token = t.token GROUP BY ALL
""")
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over words: short ones as standard, a source's shared ones as first-party, benchmark words as registry."""
    t = tokens(read(spark, sf_dir, "documents")).groupBy("source", "lang", "token").agg(F.count(F.lit(1)).alias("n"))
    known = read(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"))).alias("token")).distinct().withColumn("known", F.lit(True))
    shared = F.sum("n").over(Window.partitionBy("source", "token")) > 1
    rows = t.withColumn("shared", shared & F.col("source").isNotNull()).join(known, "token", "left")
    rows = rows.withColumns({
        "kind": F.lit("import"), "top": F.col("token"), "in_stdlib": F.length("token") <= 2, "in_first_party": F.col("shared"), "in_repo": F.lit(False), "in_sibling": F.lit(False),
        "registry": F.when(F.coalesce(F.col("lang"), F.lit("")) != "en", "unknown").when(F.col("known"), "exists").otherwise("absent"),
    })
    return cascade.histogram(cascade.decide(rows, cascade.IMPORT_RULES), "n")


@query("q02_name_normalize", f"SELECT p_partkey AS id, {norm_sql('p_name')} AS norm FROM part UNION ALL SELECT s_suppkey, {norm_sql('s_name')} FROM supplier UNION ALL SELECT n_nationkey::BIGINT, {norm_sql('n_name')} FROM nation")
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read(spark, sf_dir, t).select(F.col(k).cast("long").alias("id"), names.normalize(F.col(c)).alias("norm")) for t, k, c in (("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name"), ("nation", "n_nationkey", "n_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LINES_SQL = f"""raw AS (
  SELECT case_id, g - 1 AS pos, ls[g] AS raw FROM (SELECT case_id, ls, unnest(range(1, len(ls) + 1)) AS g FROM (SELECT case_id, string_split(diff, chr(10)) AS ls FROM {inline.DIFFS.sql()}))
  WHERE NOT (g = len(ls) AND ls[g] = '')
), f AS (
  SELECT *, sum(CASE WHEN starts_with(raw, 'diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY pos) AS file_id FROM raw
), h AS (
  SELECT *, sum(CASE WHEN starts_with(raw, '@@') THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, file_id ORDER BY pos) AS hunk_id, starts_with(raw, '@@') AS is_head FROM f WHERE file_id > 0
), k AS (
  SELECT *, regexp_matches(first(raw) OVER w, '^@@ -[0-9]+(,[0-9]+)? [+][0-9]+(,[0-9]+)? @@') AS good, first(raw) OVER w AS head FROM h WINDOW w AS (PARTITION BY case_id, file_id, hunk_id ORDER BY pos)
), c AS (
  SELECT *, CASE WHEN good THEN regexp_extract(head, '^@@ -([0-9]+)', 1)::INT END AS os, CASE WHEN good THEN coalesce(nullif(regexp_extract(head, '^@@ -[0-9]+,([0-9]+)', 1), ''), '1')::INT END AS oc,
    CASE WHEN good THEN regexp_extract(head, ' [+]([0-9]+)', 1)::INT END AS ns, CASE WHEN good THEN coalesce(nullif(regexp_extract(head, ' [+][0-9]+,([0-9]+)', 1), ''), '1')::INT END AS nc,
    CASE WHEN NOT is_head AND hunk_id > 0 AND (raw = '' OR raw[1] IN ('-', ' ')) THEN 1 ELSE 0 END AS o, CASE WHEN NOT is_head AND hunk_id > 0 AND (raw = '' OR raw[1] IN ('+', ' ')) THEN 1 ELSE 0 END AS n
  FROM k
), b AS (
  SELECT *, coalesce(sum(o) OVER w, 0)::INT AS ob, coalesce(sum(n) OVER w, 0)::INT AS nb FROM c WINDOW w AS (PARTITION BY case_id, file_id, hunk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, NOT is_head AND hunk_id > 0 AND coalesce(good AND (ob < oc OR nb < nc), false) AS body FROM b
), m AS (
  SELECT *, CASE WHEN body THEN CASE WHEN raw = '' OR raw[1] = ' ' THEN 'context' WHEN raw[1] = '+' THEN 'added' WHEN raw[1] = '-' THEN 'deleted' WHEN raw[1] = '\\' THEN 'marker' ELSE 'bad' END END AS kind FROM l
), e AS (
  SELECT case_id, file_id, hunk_id, CASE WHEN NOT bool_and(good) THEN 'malformed hunk header' WHEN bool_or(coalesce(kind = 'bad', false)) THEN 'bad line prefix'
    WHEN bool_or(body AND (ob + o > oc OR nb + n > nc)) THEN 'hunk overrun' WHEN sum(CASE WHEN body THEN o ELSE 0 END) < max(oc) OR sum(CASE WHEN body THEN n ELSE 0 END) < max(nc) THEN 'truncated hunk' END AS error
  FROM m WHERE hunk_id > 0 GROUP BY ALL
), err AS (SELECT case_id, arg_min(error, file_id * 1000 + hunk_id) AS error FROM e WHERE error IS NOT NULL GROUP BY case_id),
body AS (
  SELECT case_id, file_id, hunk_id, pos, kind, raw[2:] AS text, CASE WHEN kind <> 'added' THEN os + ob END AS old_line, CASE WHEN kind <> 'deleted' THEN ns + nb END AS new_line FROM m
  WHERE body AND kind <> 'marker' AND case_id NOT IN (SELECT case_id FROM err)
)"""


@query("q03_diff_line_map", f"WITH {LINES_SQL} SELECT case_id, file_id::BIGINT AS file_id, hunk_id::BIGINT AS hunk_id, pos::BIGINT AS pos, kind, text, old_line::BIGINT AS old_line, new_line::BIGINT AS new_line FROM body")
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diffs.body_lines(diffs.classified(inline.DIFFS.frame(spark))).drop("section")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("file_id", "hunk_id", "pos", "old_line", "new_line")})


@query("q04_diff_errors", f"WITH {LINES_SQL} SELECT case_id, error FROM err")
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.errors(diffs.classified(inline.DIFFS.frame(spark)))


@query("q05_diff_stats", f"""
SELECT case_id, sum(CASE WHEN starts_with(raw, 'diff --git ') THEN 1 ELSE 0 END)::BIGINT AS n_files,
  sum(CASE WHEN (starts_with(raw, '+') AND NOT starts_with(raw, '+++')) OR (starts_with(raw, '-') AND NOT starts_with(raw, '---')) THEN 1 ELSE 0 END)::BIGINT AS n_changed
FROM (SELECT case_id, unnest(string_split(diff, chr(10))) AS raw FROM {inline.DIFFS.sql()}) GROUP BY case_id
""")
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.diff_stats(inline.DIFFS.frame(spark))


#: Lines that only look like headers, a deleted file, lines before the first header, and what reads imports differently.
COARSE = inline.Inline("case_id string, diff string", [
    *inline.DIFFS.rows,
    ("odd", "+import early\n++x;\ndiff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -1 +1,9 @@\n+import numpy as np, pandas\n+import os , sys,json # all\n+from .near import x\n+from pkg.sub import y\n++import plus\n+  import inner\n+import os\n+import\n+from x import\n"),
    ("removed", "diff --git a/old.py b/old.py\n--- a/old.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-import a\n+import ghost\n"),
    ("needs", "diff --git a/requirements-dev.txt b/requirements-dev.txt\n--- a/requirements-dev.txt\n+++ b/requirements-dev.txt\n@@ -0,0 +1,9 @@\n+Left_Pad==1.0\n+  six\n+# note\n+-r other.txt\n+git+https://h/x\n+name @ file\n+yaml>=2 ; python_version > '3'\n+\"Quoted>=1\",\n+left.pad\n"),
    ("conf", "diff --git a/setup.cfg b/setup.cfg\n--- a/setup.cfg\n+++ b/setup.cfg\n@@ -0,0 +1,3 @@\n+    left-pad>=1,\n+    yaml\n+name = yaml\n"),
])


@query("q05b_coarse_added", f"""
WITH raw AS (SELECT case_id, g - 1 AS pos, ls[g] AS raw FROM (SELECT case_id, ls, unnest(range(1, len(ls) + 1)) AS g FROM (SELECT case_id, string_split(diff, chr(10)) AS ls FROM {COARSE.sql()}))),
p AS (SELECT *, nullif(last_value(CASE WHEN starts_with(raw, '+++ b/') THEN raw[7:] WHEN starts_with(raw, '+++ ') THEN '' END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY pos), '') AS path FROM raw)
SELECT case_id, pos::BIGINT AS pos, path, raw[2:] AS content FROM p WHERE starts_with(raw, '+') AND NOT starts_with(raw, '+++')
""")
def q05b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.coarse_added(COARSE.frame(spark)).withColumn("pos", F.col("pos").cast("long"))


FILES_EXPECTED = inline.Inline("case_id string, file_id long, old_path string, new_path string, is_new boolean, is_deleted boolean, is_binary boolean", [
    ("basic", 1, "pkg/app.py", "pkg/app.py", False, False, False), ("new", 1, None, "tests/data/x.py", True, False, False), ("new", 2, None, "src/core/util.py", True, False, False), ("gone", 1, "a.py", None, False, True, False), ("gone", 2, "i.png", "i.png", False, False, True),
    ("tricky", 1, "q.sql", "q.sql", False, False, False), ("tricky", 2, "requirements.txt", "requirements.txt", False, False, False), ("toml", 1, "pyproject.toml", "pyproject.toml", False, False, False),
    ("truncated", 1, "t.py", "t.py", False, False, False), ("overrun", 1, "o.py", "o.py", False, False, False), ("header", 1, "h.py", "h.py", False, False, False), ("prefix", 1, "p.py", "p.py", False, False, False),
])


@query("q05c_diff_files", f"SELECT * FROM {FILES_EXPECTED.sql()}")
def q05c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.files(diffs.classified(inline.DIFFS.frame(spark))).withColumn("file_id", F.col("file_id").cast("long"))


SPECS = inline.Inline("line string", [(x,) for x in ("six==1.0", "  Flask>=2 # web", "# none", "", "-r other.txt", "my_pkg[extra] ; python_version > '3'", "git+https://x/y", "a @ b", "./local", "'quoted'", "name#frag", "zope.interface", "-e .", "_x", "a;b # c")])


@query("q06_requirements", f"""
WITH s AS (SELECT line, trim(line) AS t FROM {inline.Inline.sql(SPECS)}),
c AS (SELECT line, t, replace(replace(trim(split_part(trim(split_part(t, ' #', 1)), ';', 1)), '"', ''), '''', '') AS b FROM s)
SELECT line, regexp_extract(trim(b), '^[A-Za-z0-9][A-Za-z0-9._-]*') AS name FROM c
WHERE t <> '' AND NOT starts_with(t, '#') AND NOT starts_with(t, '-') AND trim(b) <> '' AND NOT contains(b, '://') AND NOT contains(b, ' @ ') AND NOT contains(b, '/') AND NOT starts_with(b, '.') AND NOT starts_with(b, '-')
  AND regexp_extract(trim(b), '^[A-Za-z0-9][A-Za-z0-9._-]*') <> ''
""")
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.requirements(SPECS.frame(spark), "line")


@query("q07_pyproject_deps", f"""
SELECT * FROM {inline.Inline("case_id string, pos long, name string", [("toml", 6, "left-pad"), ("toml", 7, "other"), ("toml", 12, "httpx"), ("toml", 15, "pytest"), ("toml", 15, "ruff")]).sql()}
""")
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = diffs.classified(inline.DIFFS.frame(spark))
    toml = diffs.files(lines).where(F.col("new_path").endswith("pyproject.toml")).select("case_id", "file_id")
    return manifests.toml_dependencies(diffs.body_lines(lines).join(toml, ["case_id", "file_id"])).select("case_id", F.col("pos").cast("long").alias("pos"), "name")


#: Added lines with their files, by the rule of q05b.
ADDED_SQL = f"""raw AS (SELECT case_id, g - 1 AS pos, ls[g] AS raw FROM (SELECT case_id, ls, unnest(range(1, len(ls) + 1)) AS g FROM (SELECT case_id, string_split(diff, chr(10)) AS ls FROM {COARSE.sql()}))),
p AS (SELECT *, nullif(last_value(CASE WHEN starts_with(raw, '+++ b/') THEN raw[7:] WHEN starts_with(raw, '+++ ') THEN '' END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY pos), '') AS path FROM raw),
a AS (SELECT case_id, pos::BIGINT AS pos, path, raw[2:] AS content FROM p WHERE starts_with(raw, '+') AND NOT starts_with(raw, '+++'))"""


@query("q08_imports_regex", f"""
WITH {ADDED_SQL}, f AS (SELECT *, ends_with(path, '.py') AS py, regexp_matches(path, '(^|/)requirements[^/]*[.]txt$') AS req, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS spec,
  regexp_extract(content, '^\\s*import\\s+([A-Za-z_][\\w.]*(?:\\s*,\\s*[A-Za-z_][\\w.]*)*)', 1) AS imp, regexp_extract(content, '^\\s*from\\s+([A-Za-z_.][\\w.]*)\\s+import\\b', 1) AS org FROM a),
n AS (
  SELECT case_id, pos, unnest(regexp_split_to_array(imp, '\\s*,\\s*')) AS name, unnest(range(len(regexp_split_to_array(imp, '\\s*,\\s*')))) AS k, 'import' AS kind FROM f WHERE py AND imp <> ''
  UNION ALL SELECT case_id, pos, org, 0, CASE WHEN starts_with(org, '.') THEN 'relative' ELSE 'from-import' END FROM f WHERE py AND imp = '' AND org <> ''
  UNION ALL SELECT case_id, pos, regexp_extract(spec, '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1), 0, 'requirement' FROM f
    WHERE req AND NOT py AND spec[1] NOT IN ('#', '-') AND NOT contains(spec, '://') AND NOT contains(spec, ' @ ') AND regexp_matches(spec, '^[A-Za-z0-9]')
)
SELECT case_id, pos, k::INT AS k, name, kind, CASE kind WHEN 'relative' THEN '' WHEN 'requirement' THEN {norm_sql("name")} ELSE split_part(name, '.', 1) END AS top FROM n
""")
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = diffs.coarse_added(COARSE.frame(spark))
    return imports.qa_candidates(lines).select("case_id", F.col("pos").cast("long").alias("pos"), "k", "name", "kind", "top")


SOURCES = inline.Inline("case_id string, text string", [
    ("plain", "import a.b, c as d; import e\nfrom f.g import (\n  h,\n  i)\nfrom . import j\nfrom ..k import l"),
    ("traps", "x = '''\nimport no\n'''\n# import no\ns = \"import no\" ; import yes\nif x: import z\ntry: import t\nexcept ImportError: pass\nimport \\\n  u"),
    ("nested", "def f():\n    import inner\n    return {'import': 1}\nfrom m import (a, # c\n b)"),
])
LEXED = inline.Inline("case_id string, kind string, module string, top string, line long", [
    ("plain", "import", "a.b", "a", 1), ("plain", "import", "c", "c", 1), ("plain", "import", "e", "e", 1), ("plain", "from-import", "f.g", "f", 2), ("plain", "relative", ".", "", 5), ("plain", "relative", "..k", "", 6),
    ("traps", "import", "yes", "yes", 5), ("traps", "import", "z", "z", 6), ("traps", "import", "t", "t", 7), ("traps", "import", "u", "u", 9), ("nested", "import", "inner", "inner", 2), ("nested", "from-import", "m", "m", 4),
])


@query("q09_imports_lexed", f"SELECT * FROM {LEXED.sql()}")
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("text"), (i + 1).alias("new_line"), F.lit(True).alias("added")))
    images = SOURCES.frame(spark).select("case_id", F.lit(1).alias("file_id"), F.lit("x.py").alias("file"), rows.alias("rows"))
    return imports.lexed_imports(images).select("case_id", "kind", "module", "top", F.col("line").cast("long").alias("line"))


@query("q10_first_party", f"""
WITH p AS (SELECT path FROM {inline.PATHS.sql()} UNION ALL SELECT regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) FROM pages)
SELECT top, count(*)::BIGINT AS n FROM (SELECT regexp_replace(CASE WHEN split_part(path, '/', 1) = 'src' AND contains(path, '/') THEN split_part(path, '/', 2) ELSE split_part(path, '/', 1) END, '[.]py$', '') AS top FROM p) GROUP BY top
""")
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path"))
    return inline.PATHS.frame(spark).unionByName(urls).groupBy(names.top_component(F.col("path")).alias("top")).agg(F.count(F.lit(1)).alias("n"))


@query("q11_fixture_paths", f"""
SELECT path, regexp_matches(path, '(^|/)(testdata|test-data|test_data|fixtures|__snapshots__|snapshots)/') OR regexp_matches(path, '(^|/)(test|tests|testing)/data/') OR regexp_matches(path, '^(test|tests|testing)/(.*/)?data/') AS fixture,
  ends_with(path, '.py') OR ends_with(path, '.pyi') AS python, regexp_matches(path, '(^|/)pyproject[.]toml$|(^|/)requirements[^/]*[.]txt$|(^|/)requirements/[^/]+[.]txt$') AS manifest FROM {inline.PATHS.sql()}
""")
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return inline.PATHS.frame(spark).select("path", names.is_fixture_data(p).alias("fixture"), names.is_python(p).alias("python"), names.is_manifest(p).alias("manifest"))


@query("q12_repo_index", f"""
SELECT * FROM {inline.Inline("ctx_id string, name string", [("r", "setup"), ("r", "src"), ("r", "alpha"), ("r", "beta")]).sql()}
""")
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.top_level(inline.LISTING.frame(spark))


USES = inline.Inline("case_id string, ctx_id string, file string, top string", [("u1", "r", "libs/python/beta/x.py", "helper"), ("u2", "r", "other/x.py", "helper"), ("u3", "r", "tools/y.py", "run"), ("u4", "r", "z.py", "setup"), ("u5", "q", "tools/y.py", "run")])


@query("q13_sibling_join", f"""
WITH e AS (SELECT ctx_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS base, is_dir FROM {inline.LISTING.sql()} WHERE NOT contains(path, 'node_modules') AND len(string_split(path, '/')) <= 5),
s AS (SELECT DISTINCT ctx_id, dir, CASE WHEN is_dir THEN base ELSE regexp_replace(base, '[.]pyi?$', '') END AS top FROM e WHERE NOT starts_with(base, '.') AND (is_dir OR regexp_matches(base, '[.]pyi?$')))
SELECT u.*, s.top IS NOT NULL AS in_sibling FROM {USES.sql()} u LEFT JOIN s ON s.ctx_id = u.ctx_id AND s.top = u.top AND s.dir = regexp_extract(u.file, '^(.*)/[^/]*$', 1)
""")
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = repo.siblings(inline.LISTING.frame(spark)).withColumnRenamed("name", "top")
    return cascade.flag(USES.frame(spark).withColumn("dir", names.dirname(F.col("file"))), near, ["ctx_id", "dir", "top"], "in_sibling").drop("dir")


WANTED = inline.Inline("dist string", [("Requests",), ("flask",), ("left.pad",), ("rate-limited",), ("nowhere",), ("MY_PKG",)])


@query("q14_registry_tristate", f"""
SELECT d.dist, CASE WHEN r."exists" THEN 'exists' WHEN NOT r."exists" THEN 'absent' ELSE 'unknown' END AS registry
FROM {WANTED.sql()} d LEFT JOIN (SELECT {norm_sql('name')} AS norm, bool_or("exists") AS "exists" FROM {inline.REGISTRY.sql().replace("exists", '"exists"')} GROUP BY 1) r ON r.norm = {norm_sql('d.dist')}
""")
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.lookup(WANTED.frame(spark), inline.REGISTRY.frame(spark))


@query("q15_registry_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events WHERE value IS NOT NULL GROUP BY user_id")
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest definite row of each key."""
    rows = read(spark, sf_dir, "events").where("value IS NOT NULL")
    return rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


def toy_tool(spark: SparkSession, sf_dir: str, kind: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """cases, truths and findings: a case per labelled document's source, low quality as truth, shortness as finding."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    case = F.coalesce("source", F.lit("none")).alias("case_id")
    truths = docs.where("quality = 0").select(case, F.col("doc_id").alias("truth_id"), F.col("doc_id").cast("string").alias("name"), F.lit("doc").alias("file"), F.col(kind).alias("kind"))
    found = docs.where("n_chars < 200").select(case, F.col("doc_id").cast("string").alias("name"), F.lit("doc").alias("file"))
    cases = docs.groupBy(case).agg(F.count_if(F.col("quality") == 0).alias("bad")).select("case_id", F.when(F.col("case_id") < "src15", "a").otherwise("b").alias("corpus"), F.when(F.col("bad") > 0, "hallucination").otherwise("clean").alias("label"))
    return cases, truths, found


TOY_SQL = """d AS (SELECT coalesce(source, 'none') AS case_id, lang, quality, n_chars < 200 AS f FROM documents JOIN labels USING (doc_id)),
c AS (SELECT case_id, CASE WHEN case_id < 'src15' THEN 'a' ELSE 'b' END AS corpus, CASE WHEN sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) > 0 THEN 'hallucination' ELSE 'clean' END AS label,
  sum(CASE WHEN f THEN 1 ELSE 0 END)::BIGINT AS findings, sum(CASE WHEN f AND quality = 0 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN f AND quality <> 0 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN NOT f AND quality = 0 THEN 1 ELSE 0 END)::BIGINT AS fn FROM d GROUP BY case_id)"""


@query("q16_score_cases", f"WITH {TOY_SQL} SELECT * FROM c")
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.case_counts(*toy_tool(spark, sf_dir))


@query("q17_score_kinds", f"WITH {TOY_SQL} SELECT coalesce(nullif(lang, ''), '?') AS kind, sum(CASE WHEN f THEN 1 ELSE 0 END)::BIGINT AS hits, count(*)::BIGINT AS total FROM d WHERE quality = 0 GROUP BY 1")
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.kind_counts(*toy_tool(spark, sf_dir)[1:])


@query("q18_score_rollup", f"""
WITH {TOY_SQL}, r AS (SELECT CASE WHEN grouping(corpus) = 1 THEN 'TOTAL' ELSE corpus END AS corpus, count(*)::BIGINT AS cases, sum(findings)::BIGINT AS findings, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(CASE WHEN label = 'clean' THEN findings ELSE 0 END)::BIGINT AS noise FROM c GROUP BY ROLLUP (corpus)),
m AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + fn, 0) AS q FROM r)
SELECT corpus, cases, findings, tp, fp, fn, noise, round(p, 9) AS precision, round(q, 9) AS recall, round(CASE WHEN p + q = 0 THEN 0.0 ELSE 2 * p * q / (p + q) END, 9) AS f1 FROM m
""")
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.corpus_report(scoring.case_counts(*toy_tool(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("q19_match_modes", f"""
WITH t AS (SELECT *, {norm_sql('name')} AS norm FROM {inline.TRUTHS.sql()}), f AS (SELECT *, {norm_sql('name')} AS norm FROM {inline.FINDINGS.sql()}), modes AS (SELECT unnest(['file', 'name']) AS mode)
SELECT mode, t.case_id, truth_id, coalesce(bool_or(f.norm IS NOT NULL AND (mode = 'name' OR coalesce(t.file, '') = '' OR f.file = t.file)), false) AS hit,
  NOT coalesce(bool_or(f.norm IS NOT NULL AND (mode = 'name' OR coalesce(t.file, '') = '' OR f.file = t.file)), false) AND bool_or(f.norm IS NOT NULL) AND NOT bool_or(coalesce(f.file, '') <> '') AS unlocated
FROM modes, t LEFT JOIN f ON f.case_id = t.case_id AND f.norm = t.norm GROUP BY ALL
""")
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f = inline.TRUTHS.frame(spark), inline.FINDINGS.frame(spark)
    one = lambda mode: scoring.credited(t, f, mode).select(F.lit(mode).alias("mode"), "case_id", "truth_id", "hit", "unlocated")
    return one("file").unionByName(one("name"))


@query("q20_findings_parse", f"""
SELECT * FROM {inline.Inline("case_id string, n long, failed boolean, crashed boolean", [("blank", 0, False, False), ("empty", 0, False, False), ("two", 2, False, False), ("object", 0, True, False), ("numbers", 0, True, False), ("noname", 0, True, False), ("text", 0, True, False), ("crash", 0, False, True)]).sql()}
""")
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.run_status(readers.parse_findings(inline.RUNS.frame(spark))).select("case_id", F.size("findings").cast("long").alias("n"), F.col("error").isNotNull().alias("failed"), "crashed")


GATES = [("not merged", "o_orderstatus = 'P'"), ("too old", "o_orderdate < timestamp_ntz'1995-01-01'"), ("bot", "c_mktsegment = 'MACHINERY'"), ("too large", "o_totalprice > 200000"), ("no import", "o_orderpriority LIKE '5%'")]


@query("q21_funnel", """
SELECT n_name, gate, count(*)::BIGINT AS n FROM (SELECT n_name, CASE WHEN o_orderstatus = 'P' THEN 'not merged' WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'too old' WHEN c_mktsegment = 'MACHINERY' THEN 'bot'
  WHEN o_totalprice > 200000 THEN 'too large' WHEN o_orderpriority LIKE '5%' THEN 'no import' ELSE 'kept' END AS gate
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY ALL
""")
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return corpus.funnel(rows, "n_name", GATES)


@query("q22_cap_per_group", """
SELECT o_custkey, o_orderkey, keep FROM (SELECT o_custkey, o_orderkey, keep, coalesce(sum(keep::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
FROM (SELECT *, o_orderstatus <> 'P' AS keep FROM orders)) WHERE k < 3
""")
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("keep", F.col("o_orderstatus") != "P")
    return corpus.examined_until_full(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "keep", 3).select("o_custkey", "o_orderkey", "keep")


@query("q23_quarantine_split", "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'review' ELSE 'kept' END AS part FROM documents")
def q23(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, review = corpus.quarantine(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id")
    return kept.withColumn("part", F.lit("kept")).unionByName(review.withColumn("part", F.lit("review")))


@query("q24_name_table", f"""
WITH {TOKENS_SQL}, s AS (SELECT token AS name, source AS case_id, min(doc_id) AS o, arg_min(lang, doc_id) AS status FROM t WHERE length(token) > 3 GROUP BY ALL)
SELECT name, arg_min(status, o) AS status, string_agg(case_id, ',' ORDER BY o, case_id) AS cases FROM s GROUP BY name
""")
def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(read(spark, sf_dir, "documents")).where("length(token) > 3").select(F.col("token").alias("name"), F.col("source").alias("case_id"), "doc_id", F.col("lang").alias("status"), F.lit("").alias("evidence"))
    return corpus.name_table(rows, ["name"], "doc_id").select("name", "status", F.array_join("cases", ",").alias("cases"))


@query("q25_contamination", "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts inside documents: the second to fifth word find the candidates, then the whole text is compared.

    Items of fewer than six words have no such key; each document is searched for them.
    """
    items = read(spark, sf_dir, "benchmark").where("text IS NOT NULL").withColumn("w", F.split("text", r"\s+"))
    short = items.where(F.size("w") < 6).select("item_id", F.col("text").alias("passage"))
    items = items.where(F.size("w") >= 6).select("item_id", F.col("text").alias("passage"), F.xxhash64(F.slice("w", 2, 4)).alias("key"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL").withColumn("w", F.split("text", r"\s+"))
    keys = F.transform("w", lambda x, i: F.xxhash64(F.slice("w", i + 1, 4)))
    found = docs.select("doc_id", F.explode(F.array_distinct(keys)).alias("key")).join(items.select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    found = found.join(items.select("item_id", "passage"), "item_id").join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id")
    searched = docs.join(short, F.contains("text", "passage")).select("doc_id", "item_id")
    return found.unionByName(searched).distinct()


@query("q26_existence_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


OLD_SET = inline.Inline("name string", [(n,) for n in ("NATION_0", "NATION_7", "NATION_99", "ATLANTIS")])


@query("q27_set_decay", f"""
SELECT name, 'lost' AS change FROM {OLD_SET.sql()} WHERE name NOT IN (SELECT n_name FROM nation) UNION ALL SELECT n_name, 'added' FROM nation WHERE n_name NOT IN (SELECT name FROM {OLD_SET.sql()})
""")
def q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, old = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), OLD_SET.frame(spark)
    return old.subtract(now).withColumn("change", F.lit("lost")).unionByName(now.subtract(old).withColumn("change", F.lit("added")))


TYPOS = inline.Inline("name string", [(n,) for n in ("widgt", "bolts", "rood", "smal", "lagre", "xxxxxxxx", "cold", "bleu", "gearr")])


@query("q28_fuzzy_top1", f"""
WITH k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS near FROM part), p AS (SELECT t.name, near, levenshtein(t.name, near) AS d FROM {TYPOS.sql()} t, k)
SELECT name, arg_min(near, (d, near)) AS near, min(d)::BIGINT AS distance FROM p WHERE d <= 2 GROUP BY name
""")
def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.nearest(TYPOS.frame(spark), read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("name")))


@query("q29_render_json", """SELECT * FROM (VALUES
('c1', '[{"name":"fake-lib","file":"a.py","line":3,"kind":"import","message":"m1"},{"name":"fake.lib","file":"z.py","line":4,"kind":"import","message":"m2"},{"name":"Other"}]'),
('c2', '[{"name":"gone","kind":"import","message":"m4"},{"name":"dup","file":"x.py","line":9,"kind":"import","message":"m5"},{"name":"dup","file":"x.py","line":2,"kind":"import","message":"m6"}]'),
('c3', '[]'), ('c4', '[{"name":"noise","file":"n.py","line":1,"kind":"import","message":"m7"},{"name":"noise","file":"n.py","line":2,"kind":"import","message":"m8"}]'), ('c5', '[]')) v(case_id, body)""")
def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.findings_json(inline.CASES.frame(spark), inline.FINDINGS.frame(spark))


@query("q30_render_markdown", f"""
SELECT case_id, CASE WHEN count(*) = 1 THEN '1 name could not be found' ELSE count(*) || ' names could not be found' END || chr(10) || chr(10) || '| name | where | evidence |' || chr(10) || '|---|---|---|' || chr(10) ||
  string_agg('| ' || name || ' | ' || CASE WHEN coalesce(file, '') = '' THEN '-' WHEN line > 0 THEN '[' || file || ':' || line || '](https://h/r/' || file || '#L' || line || ')' ELSE '[' || file || '](https://h/r/' || file || ')' END || ' | ' || coalesce(evidence, '') || ' |', chr(10) ORDER BY coalesce(file, ''), line, ord) AS body
FROM {inline.FINDINGS.sql()} GROUP BY case_id
""")
def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.findings_markdown(inline.FINDINGS.frame(spark), "https://h/r/")


@query("q31_first_seen_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("q32_state_locf", "SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM conversations")
def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    event = F.when(F.col("role") != "assistant", F.col("role"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(event, ignorenulls=True).over(before).alias("state"))


@query("q33_merge_upsert", """
WITH o AS (SELECT user_id, count(*)::BIGINT AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), w AS (SELECT user_id, count(*)::BIGINT AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT user_id, CASE WHEN o.n IS NULL THEN 'insert' WHEN w.n IS NULL THEN 'delete' WHEN o.n = w.n THEN 'keep' ELSE 'update' END AS action, coalesce(w.n, o.n) AS n FROM o FULL JOIN w USING (user_id)
""")
def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as two runs, before and since a date; what the second does to the first."""
    e = read(spark, sf_dir, "events")
    count = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return corpus.upsert(count(e.where("ts < timestamp'2024-01-15'")), count(e.where("ts >= timestamp'2024-01-15'")), "user_id", "n")


@query("q33b_merge_counts", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def q33b(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    count = lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return corpus.merge_counts(count(e.where("event_id % 2 = 0")), count(e.where("event_id % 2 = 1")), ["event_type"], "n")


@query("q34_json_props", "SELECT event_type, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999999999")).cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(F.lit(1)).alias("n"))


@query("q35_scan_findings", f"""
SELECT * FROM {inline.Inline("case_id string, name string, file string, line long, kind string, message string, evidence string", [
    ("basic", "pandas", "pkg/app.py", 22, "import", "'pandas' is imported, but the registry has no such name (looked up as pandas)", "registry: absent as pandas"),
    ("tricky", "my_pkg", "requirements.txt", 5, "requirement", "'my_pkg' is required, but the registry has no such name (looked up as my_pkg)", "registry: absent as my_pkg"),
    ("toml", "left-pad", "pyproject.toml", 5, "requirement", "'left-pad' is required, but the registry has no such name (looked up as left-pad)", "registry: absent as left-pad"),
]).sql()}
""")
def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole scans, from diff texts to findings."""
    return scan.scan(spark, inline.DIFFS.frame(spark), inline.REGISTRY.frame(spark)).drop("ord").withColumn("line", F.col("line").cast("long"))


@query("q36_reference_tools", f"""
WITH {ADDED_SQL}, i AS (SELECT *, regexp_extract(content, '^\\s*(?:import|from)\\s+([a-zA-Z0-9_]+)', 1) AS name FROM a),
r AS (SELECT case_id, pos, path, CASE WHEN name <> '' THEN name ELSE regexp_extract(trim(trim(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), ','), chr(34) || chr(39)), '^\\s*([A-Za-z0-9][A-Za-z0-9._-]+)\\s*(?:(?:===|==|>=|<=|~=|!=|>|<)\\S*\\s*,?\\s*$|$)', 1) END AS name FROM i)
SELECT 'every' AS tool, case_id, name, arg_min(coalesce(path, '-'), pos) AS file, min(pos) AS pos FROM i WHERE name <> '' GROUP BY case_id, name
UNION ALL SELECT 'listed', case_id, arg_min(name, pos), arg_min(coalesce(path, '-'), pos), min(pos) FROM r WHERE {norm_sql("name")} IN ('pandas', 'yaml', 'left-pad') GROUP BY case_id, {norm_sql("name")}
""")
def q36(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = diffs.coarse_added(COARSE.frame(spark))
    tools = {"every": imports.every_import_once(lines), "listed": imports.listed_imports(lines, ["Pandas", "yaml", "left_pad"]), "none": imports.no_findings(lines)}
    out = None
    for name, df in tools.items():
        df = df.select(F.lit(name).alias("tool"), "case_id", "name", F.coalesce("file", F.lit("-")).alias("file"), F.col("pos").cast("long").alias("pos"))
        out = df if out is None else out.unionByName(df)
    return out


METRICS = inline.Inline("tp long, fp long, fn long", [(tp, fp, fn) for tp in (0, 4, 7) for fp in (0, 5, 11) for fn in (0, 2, 9)])


@query("q37_metrics", f"""
WITH m AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS p, tp::DOUBLE / nullif(tp + fn, 0) AS r FROM {METRICS.sql()})
SELECT tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM m
""")
def q37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_metrics(METRICS.frame(spark)).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("q38_reference_data", f"""
SELECT * FROM {inline.Inline("name string, standard boolean, dist string", [("os", True, None), ("distutils", True, None), ("annotationlib", True, None), ("typing_extensions", True, None), ("yaml", False, "PyYAML"), ("requests", False, None), ("cv2", False, "opencv-python")]).sql()}
""")
def q38(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(n,) for n in ("os", "distutils", "annotationlib", "typing_extensions", "yaml", "requests", "cv2")], "name string")
    flagged = cascade.flag(wanted, refdata.stdlib(spark), ["name"], "standard")
    return flagged.join(refdata.aliases(spark).withColumnRenamed("import_name", "name"), "name", "left")
