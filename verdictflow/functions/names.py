"""Name and path expressions.  All are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that hold fixture data anywhere, and roots under which a plain "data" directory does.
FIXTURE_DIRS = ("testdata", "test-data", "test_data", "fixtures", "__snapshots__", "snapshots")
TEST_ROOTS = ("test", "tests", "testing")
# Directories that a repository listing leaves out.
SKIPPED_DIRS = (".git", ".hg", ".svn", ".tox", ".nox", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "build", "dist", ".eggs", "site-packages")
MAX_DEPTH = 5
# File names that declare dependencies.
MANIFESTS = r"(^|/)pyproject\.toml$|(^|/)requirements[^/]*\.txt$|(^|/)requirements/[^/]+\.txt$"


def normalize(name: Column) -> Column:
    """PEP 503: trimmed, runs of ``-_.`` as one hyphen, lower case."""
    return F.lower(F.regexp_replace(F.trim(name), "[-_.]+", "-"))


def dirname(path: Column) -> Column:
    """Parent directory; empty for a top-level name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def top_of(module: Column) -> Column:
    return F.substring_index(module, ".", 1)


def top_component(path: Column) -> Column:
    """The import root that a path provides: its first component, or the second under ``src``; ``.py`` is cut off."""
    parts = F.split(path, "/")
    top = F.when((F.get(parts, F.lit(0)) == "src") & (F.size(parts) > 1), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    return F.regexp_replace(top, r"\.py$", "")


def module_name(name: Column, is_dir: Column) -> Column:
    """The module that a directory entry provides; null if none."""
    return F.when(name.startswith("."), None).when(is_dir, name).when(name.rlike(r"\.pyi?$"), F.regexp_replace(name, r"\.pyi?$", ""))


def is_fixture_data(path: Column) -> Column:
    """Whether a directory of the path marks its files as data that no program runs."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    rooted = F.get(parts, F.lit(0)).isin(*TEST_ROOTS)
    bare = F.filter(dirs, lambda d, i: (d == "data") & (rooted | F.coalesce(F.get(parts, i - 1).isin(*TEST_ROOTS), F.lit(False))))
    return F.exists(dirs, lambda d: d.isin(*FIXTURE_DIRS)) | (F.size(bare) > 0)


def is_python(path: Column) -> Column:
    return path.endswith(".py") | path.endswith(".pyi")


def is_manifest(path: Column) -> Column:
    return path.rlike(MANIFESTS)


def skipped(path: Column) -> Column:
    """Whether a listing leaves the entry out: in a skipped directory, or deeper than MAX_DEPTH."""
    parts = F.split(path, "/")
    return F.exists(parts, lambda d: d.isin(*SKIPPED_DIRS)) | (F.size(parts) > MAX_DEPTH)


def percent(x: Column) -> Column:
    """One decimal; a dash where undefined."""
    return F.when(x.isNotNull(), F.format_string("%.1f%%", x * 100)).otherwise("-")


def location(file: Column, line: Column) -> Column:
    return F.when(F.coalesce(file, F.lit("")) == "", "-").when(F.coalesce(line, F.lit(0)) > 0, F.concat(file, F.lit(":"), line.cast("string"))).otherwise(file)


def link(base: Column, file: Column, line: Column) -> Column:
    at = F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), file)
    return F.when(F.coalesce(file, F.lit("")) == "", None).when(F.coalesce(line, F.lit(0)) > 0, F.concat(at, F.lit("#L"), line.cast("string"))).otherwise(at)
