"""From diffs to findings: one plan for any number of diffs.

The lines of all diffs are classified once, with the paths of their files and the errors of their cases, partitioned by
case; they are kept while the branches for requirements, TOML files and Python files read them.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_fixture_data, is_manifest, is_python
from ..operators import cascade, diffs, imports, manifests, render, repo
from ..operators.sinks import ORDER
from ..sources import refdata

COLUMNS = ("case_id", *ORDER, "kind", "top", "file", "line", "verdict", "reason", "dist", "evidence")


def lines_of(diff_table: DataFrame) -> DataFrame:
    """The classified lines of sound diffs with their files, kept for the branches that read them."""
    lines = diffs.with_paths(diffs.classified(diff_table)).where("error IS NULL")
    return lines.drop("error").persist(StorageLevel.MEMORY_AND_DISK)


def declared(body: DataFrame) -> DataFrame:
    """Names that added lines of manifests require."""
    toml = F.col("file").endswith(".toml")
    cols = ["case_id", "file_id", "pos", "k", "file", F.col("new_line").alias("line"), F.col("name").alias("top")]
    by_line = manifests.requirements(body.where(~toml & (F.col("kind") == "added"))).withColumn("k", F.lit(0)).select(*cols)
    in_toml = manifests.toml_dependencies(body.where(toml)).select(*cols)
    return by_line.unionByName(in_toml).withColumn("kind", F.lit("requirement"))


def decisions(spark: SparkSession, diff_table: DataFrame, registry: DataFrame, repo_top: DataFrame | None = None, siblings: DataFrame | None = None, known_once: bool = False) -> DataFrame:
    """COLUMNS of every candidate, in ORDER within its case.  A file of fixture data gives one decision and no candidate.

    The lines stay in Spark's cache until release() is called with the result.
    evidence says where the registry's answer comes from; with known_once the registry has one row per normalised name.
    """
    lines = lines_of(diff_table)
    live = lines.where("NOT is_deleted AND NOT is_binary AND new_path IS NOT NULL")
    marked = live.withColumn("fixture", is_fixture_data(F.col("new_path"))).withColumnRenamed("new_path", "file")
    body = diffs.body_of(marked.where("NOT fixture"), "file")
    found = imports.lexed_imports(diffs.images_of(body.where(is_python(F.col("file")))))
    provided = repo.first_party(lines.where("raw LIKE 'diff --git %'"))
    resolved = cascade.resolve_imports(found, refdata.stdlib(spark), refdata.aliases(spark), registry, provided, repo_top, siblings, known_once=known_once).withColumn("part", F.lit(2))
    required = cascade.resolve_dependencies(declared(body.where(is_manifest(F.col("file")))), registry, known_once).withColumn("part", F.lit(1))
    none = F.lit(None).cast("string")
    skipped = lines.where(is_fixture_data(F.col("new_path")) & F.col("raw").startswith("diff --git ")).select(
        "case_id", "file_id", F.lit(0).alias("part"), F.col("pos"), F.lit(0).alias("k"), F.lit("file").alias("kind"), none.alias("top"), F.col("new_path").alias("file"), F.lit(None).cast("int").alias("line"),
        F.lit("suppress").alias("verdict"), F.lit(cascade.FIXTURE).alias("reason"), none.alias("dist"), none.alias("evidence"),
    )
    evidence = F.when(F.col("registry") != "unknown", F.concat(F.lit("registry: "), "registry", F.lit(" as "), "dist"))
    both = [df.withColumn("evidence", evidence).select(*COLUMNS) for df in (required, resolved)]
    out = cascade.closed(skipped.select(*COLUMNS).unionByName(both[0]).unionByName(both[1]))
    out._verdictflow_lines = lines
    return out


def scan(spark: SparkSession, diff_table: DataFrame, registry: DataFrame, repo_top: DataFrame | None = None, siblings: DataFrame | None = None, known_once: bool = False) -> DataFrame:
    """Findings: case_id, name, file, line, kind, message, evidence, and ord, their order in the case."""
    found = decisions(spark, diff_table, registry, repo_top, siblings, known_once)
    out = render.findings(found)
    out._verdictflow_lines = found._verdictflow_lines
    return out


def release(result: DataFrame) -> None:
    """Let go of the lines that decisions() or scan() keeps, once nothing reads their result any more."""
    result._verdictflow_lines.unpersist()
