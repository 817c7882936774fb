"""Small inputs that stand in the code, for queries over data that the tables don't hold, on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Row = tuple


class Inline:
    """Rows with a schema such as "case_id string, pos long"."""

    def __init__(self, schema: str, rows: list[Row]) -> None:
        self.schema, self.rows = schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self) -> str:
        """A parenthesised DuckDB query."""
        kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}
        cols = [c.split() for c in self.schema.split(", ")]
        one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
        rows = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in self.rows)
        return "(SELECT " + ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in cols) + f" FROM (VALUES {rows}) AS v(" + ", ".join(n for n, _ in cols) + "))"


DIFFS = Inline("case_id string, diff string", [
    ("basic", "preamble\ndiff --git a/pkg/app.py b/pkg/app.py\nindex 1..2 100644\n--- a/pkg/app.py\n+++ b/pkg/app.py\n@@ -1,4 +1,5 @@ def main():\n import os\n-import old\n+import requests\n+from flask import Flask\n \n x = 1\n@@ -20 +21,2 @@\n y = 2\n+import numpy as np, pandas\n"),
    ("new", "diff --git a/tests/data/x.py b/tests/data/x.py\nnew file mode 100644\n--- /dev/null\n+++ b/tests/data/x.py\n@@ -0,0 +1,2 @@\n+import hidden\n+import two\ndiff --git a/src/core/util.py b/src/core/util.py\nnew file mode 100644\n--- /dev/null\n+++ b/src/core/util.py\t2024-01-01\n@@ -0,0 +1,3 @@\n+import core\n+from .near import a\n+import yaml\n\\ No newline at end of file\n"),
    ("gone", "diff --git a/a.py b/a.py\ndeleted file mode 100644\n--- a/a.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-import a\n-import b\ndiff --git a/i.png b/i.png\nBinary files a/i.png and b/i.png differ\n"),
    ("tricky", "diff --git a/q.sql b/q.sql\n--- a/q.sql\n+++ b/q.sql\n@@ -1,3 +1,3 @@\n one\n--- a comment\n+++ counter\n\ndiff --git a/requirements.txt b/requirements.txt\n--- a/requirements.txt\n+++ b/requirements.txt\n@@ -1,2 +1,6 @@\n six==1.0\n+Flask>=2 # web\n+# none\n+-r other.txt\n+my_pkg[extra] ; python_version > '3'\n git+https://x/y\n"),
    ("toml", "diff --git a/pyproject.toml b/pyproject.toml\n--- a/pyproject.toml\n+++ b/pyproject.toml\n@@ -3,3 +3,6 @@ [project]\n name = \"x\"\n+dependencies = [\n+  \"left-pad>=1\",\n+  'other',\n ]\n x = 1\n@@ -30,2 +33,6 @@ [tool.poetry.dependencies]\n python = \"^3.9\"\n+httpx = \"^1\"\n+python = \"3\"\n+[dependency-groups]\n+dev = [\"pytest\", \"ruff\"]\n \n"),
    ("truncated", "diff --git a/t.py b/t.py\n--- a/t.py\n+++ b/t.py\n@@ -1,3 +1,3 @@\n a\n+import z\n"),
    ("overrun", "diff --git a/o.py b/o.py\n--- a/o.py\n+++ b/o.py\n@@ -1,1 +1,2 @@\n-a\n-b\n+c\n+d\n"),
    ("header", "diff --git a/h.py b/h.py\n--- a/h.py\n+++ b/h.py\n@@@ -1 -1 +1 @@@\n a\n"),
    ("prefix", "diff --git a/p.py b/p.py\n--- a/p.py\n+++ b/p.py\n@@ -1,2 +1,2 @@\n a\n*b\n"),
])

REGISTRY = Inline("name string, status int, exists boolean, checked string", [
    ("requests", 200, True, "2024-01-01"), ("Flask", 200, True, "2024-01-01"), ("numpy", 200, True, "2024-01-01"), ("pandas", 404, False, "2024-01-02"),
    ("PyYAML", 200, True, "2024-01-01"), ("left_pad", 404, False, "2024-01-01"), ("my-pkg", 404, False, "2024-01-01"), ("httpx", 200, True, "2024-01-01"), ("rate.limited", 429, None, "2024-01-01"),
])

LISTING = Inline("ctx_id string, path string, is_dir boolean", [
    ("r", "setup.py", False), ("r", "README.md", False), ("r", "src", True), ("r", "src/alpha", True), ("r", "src/alpha/__init__.py", False), ("r", "src/alpha/sub", True), ("r", "src/alpha/sub/__init__.py", False),
    ("r", "libs/python/beta", True), ("r", "libs/python/beta/__init__.py", False), ("r", "libs/python/beta/helper.pyi", False), ("r", "node_modules/x", True), ("r", "node_modules/x/__init__.py", False), ("r", ".github", True), ("r", "tools/run.py", False), ("r", "a/b/c/d/e/f/g.py", False),
])

PATHS = Inline("path string", [(p,) for p in ("data.py", "tests/data/x.py", "tests/test_x.py", "pkg/testdata/a/b.py", "app/data/loader.py", "app/tests/data/x.py", "app/fixtures.py", "a/__snapshots__/x.py", "src/core/util.py", "src/mod.py", "mod.py", "lib/x.pyi", "test-data/y", "requirements-dev.txt", "requirements/base.txt", "sub/pyproject.toml", "requirements.md", "data/tests/x.py")])

TRUTHS = Inline("case_id string, truth_id long, name string, file string, kind string", [
    ("c1", 1, "Fake_Lib", "a.py", "import"), ("c1", 2, "other", None, "requirement"), ("c2", 3, "gone", "b.py", "import"), ("c2", 4, "dup", "b.py", ""), ("c3", 5, "lost", "c.py", "import"),
])
FINDINGS = Inline("case_id string, ord long, name string, file string, line int, kind string, message string, evidence string", [
    ("c1", 1, "fake-lib", "a.py", 3, "import", "m1", "404"), ("c1", 2, "fake.lib", "z.py", 4, "import", "m2", "404"), ("c1", 3, "Other", None, 0, "", None, None), ("c2", 4, "gone", "", 0, "import", "m4", "404"),
    ("c2", 5, "dup", "x.py", 9, "import", "m5", "404"), ("c2", 6, "dup", "x.py", 2, "import", "m6", "404"), ("c4", 7, "noise", "n.py", 1, "import", "m7", "404"), ("c4", 8, "noise", "n.py", 2, "import", "m8", "404"),
])
CASES = Inline("case_id string, corpus string, label string", [("c1", "seeded", "hallucination"), ("c2", "seeded", "hallucination"), ("c3", "seeded", "hallucination"), ("c4", "good", "clean"), ("c5", "good", "clean")])
RUNS = Inline("case_id string, stdout string, stderr string, returncode int", [
    ("blank", " \n", "", 0), ("empty", "[]", "", 0), ("two", '[{"name":"a","line":3},{"name":"b","file":"f.py"}]', "", 1), ("object", '{"name":"a"}', "", 0), ("numbers", "[1,2]", "", 0), ("noname", '[{"file":"x"}]', "", 0), ("text", "boom", "", 2), ("crash", "", "Traceback", 1),
])
