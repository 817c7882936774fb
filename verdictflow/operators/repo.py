"""Repository listings: top-level modules and the modules visible beside a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import basename, dirname, module_name, skipped, top_component


def entries(listing: DataFrame) -> DataFrame:
    """listing (ctx_id, path, is_dir) with dir and the module name that each entry provides."""
    rows = listing.where(~skipped(F.col("path")))
    return rows.withColumn("dir", dirname(F.col("path"))).withColumn("name", module_name(basename(F.col("path")), F.col("is_dir"))).where("name IS NOT NULL")


def siblings(listing: DataFrame) -> DataFrame:
    return entries(listing).select("ctx_id", "dir", "name").distinct()


def top_level(listing: DataFrame) -> DataFrame:
    """Root entries, children of any src, and package roots: packages whose parent directory is none."""
    rows = entries(listing)
    rooted = rows.where((F.col("dir") == "") | (F.col("dir") == "src") | F.col("dir").endswith("/src")).select("ctx_id", "name")
    packages = rows.where("name = '__init__' AND NOT is_dir").select("ctx_id", "dir").distinct()
    inner = packages.select("ctx_id", F.col("dir").alias("parent"))
    roots = packages.where("dir <> ''").withColumn("parent", dirname(F.col("dir"))).join(inner, ["ctx_id", "parent"], "left_anti")
    return rooted.unionByName(roots.select("ctx_id", basename(F.col("dir")).alias("name"))).distinct()


def first_party(files: DataFrame) -> DataFrame:
    """(case_id, top) that the files of a case provide after the change."""
    return files.where("new_path <> ''").select("case_id", top_component(F.col("new_path")).alias("top")).distinct()


def first_party_of_repo(files: DataFrame, repos: DataFrame, listed: DataFrame, known: DataFrame) -> DataFrame:
    """(repo, top) of all cases of a repository together: from changed files, its listing and names known beforehand.

    repos: (case_id, repo); listed: (repo, top) of the root and src; known: (repo, top).
    """
    changed = first_party(files).join(repos, "case_id").select("repo", "top")
    return changed.unionByName(listed.select("repo", "top")).unionByName(known.select("repo", "top")).distinct()


def preferred(captured: DataFrame, checkout: DataFrame) -> DataFrame:
    """Of two relations (ctx_id, ...): the captured rows, and a checkout's where nothing was captured of a ctx_id."""
    return captured.unionByName(checkout.join(captured.select("ctx_id").distinct(), "ctx_id", "left_anti"))


def touched(listed: DataFrame, changed: DataFrame) -> DataFrame:
    """Siblings of directories with changed files only."""
    return listed.join(changed.select("ctx_id", "dir").distinct(), ["ctx_id", "dir"], "left_semi")
