"""The resolution cascade: an ordered list of rules compiled into one CASE over join flags.

A verdict is suppress, fire or silent.  A lookup that finds no row is unknown, and unknown is silent, never fire.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import dirname, normalize

VERDICTS = ("suppress", "fire", "silent")
FIXTURE = "fixture-data"


@dataclass(frozen=True)
class Rule:
    """condition is an SQL predicate over the candidate's flags; the first true rule decides."""

    condition: str
    verdict: str
    reason: str


IMPORT_RULES = (
    Rule("kind = 'relative'", "suppress", "relative"),
    Rule("coalesce(top, '') = ''", "silent", "no-name"),
    Rule("in_stdlib", "suppress", "stdlib"),
    Rule("in_first_party", "suppress", "first-party"),
    Rule("in_repo", "suppress", "first-party/repo"),
    Rule("in_sibling", "suppress", "first-party/sibling"),
    Rule("registry = 'exists'", "suppress", "registry-hit"),
    Rule("registry = 'absent'", "fire", "registry-404"),
    Rule("true", "silent", "unverified"),
)
DEPENDENCY_RULES = (
    Rule("coalesce(top, '') = ''", "silent", "no-name"),
    Rule("registry = 'exists'", "suppress", "registry-hit/manifest"),
    Rule("registry = 'absent'", "fire", "registry-404/manifest"),
    Rule("true", "silent", "unverified/manifest"),
)
QA_RULES = (
    Rule("kind = 'relative'", "suppress", "relative"),
    Rule("kind = 'requirement' AND registry = 'exists'", "suppress", "pypi"),
    Rule("kind = 'requirement'", "silent", "unresolved"),
    Rule("in_stdlib", "suppress", "stdlib"),
    Rule("in_first_party", "suppress", "first-party"),
    Rule("registry = 'exists' AND aliased", "suppress", "pypi-alias"),
    Rule("registry = 'exists'", "suppress", "pypi"),
    Rule("true", "silent", "unresolved"),
)


def closed(decisions: DataFrame) -> DataFrame:
    """decisions, or an error if a verdict and reason are not among those that the rules can give."""
    known = {(r.verdict, r.reason) for rules in (IMPORT_RULES, DEPENDENCY_RULES, QA_RULES) for r in rules} | {("suppress", FIXTURE), ("suppress", "adjudicated-keep")}
    found = F.concat_ws(" ", F.coalesce("verdict", F.lit("null")), F.coalesce("reason", F.lit("null")))
    inside = found.isin(sorted(" ".join(x) for x in known))
    return decisions.withColumn("verdict", F.when(inside, F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("no such decision: "), found)).cast("string")))


def decide(candidates: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    verdict, reason = F, F
    for r in rules:
        verdict = verdict.when(F.expr(r.condition), r.verdict)
        reason = reason.when(F.expr(r.condition), r.reason)
    return candidates.withColumn("verdict", verdict).withColumn("reason", reason)


def flag(candidates: DataFrame, names: DataFrame, on: list[str], out: str) -> DataFrame:
    """candidates with a boolean: is there a row of names with the same keys?"""
    return candidates.join(names.select(*on).distinct().withColumn(f"__{out}", F.lit(True)), on, "left").withColumn(out, F.coalesce(f"__{out}", F.lit(False))).drop(f"__{out}")


def registry_status(exists: Column) -> Column:
    return F.when(exists, "exists").when(~exists, "absent").otherwise("unknown")


def distinct_names(candidates: DataFrame, dist: str = "dist") -> DataFrame:
    """norm: each normalised name once, as many lookups as a source without a table would get."""
    return candidates.select(normalize(F.col(dist)).alias("norm")).where("norm <> ''").distinct()


def lookup(candidates: DataFrame, registry: DataFrame, dist: str = "dist", known_once: bool = False) -> DataFrame:
    """candidates with registry = exists, absent or unknown, by normalised name.

    With known_once the registry has one row per normalised name already, and is not grouped.  A name that very many
    candidates share is a skewed partition of the candidates' side, which Spark splits.
    """
    known = registry.select(normalize(F.col("name")).alias("__norm"), F.col("exists").alias("__exists"))
    if not known_once:
        known = known.groupBy("__norm").agg(F.bool_or("__exists").alias("__exists"))
    joined = candidates.withColumn("__norm", normalize(F.col(dist))).join(known, "__norm", "left")
    return joined.withColumn("registry", registry_status(F.col("__exists"))).drop("__norm", "__exists")


def resolve_imports(candidates: DataFrame, stdlib: DataFrame, aliases: DataFrame, registry: DataFrame, first_party: DataFrame, repo_top: DataFrame | None = None, siblings: DataFrame | None = None, rules: tuple[Rule, ...] = IMPORT_RULES, known_once: bool = False) -> DataFrame:
    """candidates (case_id, kind, top, file, ...) with dist, verdict and reason.

    first_party: (case_id, top); repo_top: (case_id, top); siblings: (case_id, dir, top).  Without a repository the
    flags are false.  stdlib and aliases are fixed lists of a few hundred distinct names, so they are broadcast.
    """
    df = candidates.join(F.broadcast(stdlib.select(F.col("name").alias("top"), F.lit(True).alias("__std"))), "top", "left")
    df = df.withColumn("in_stdlib", F.coalesce("__std", F.lit(False))).drop("__std")
    df = flag(df, first_party, ["case_id", "top"], "in_first_party")
    df = flag(df, repo_top, ["case_id", "top"], "in_repo") if repo_top is not None else df.withColumn("in_repo", F.lit(False))
    df = df.withColumn("dir", dirname(F.col("file")))
    df = flag(df, siblings, ["case_id", "dir", "top"], "in_sibling") if siblings is not None else df.withColumn("in_sibling", F.lit(False))
    df = df.join(F.broadcast(aliases.withColumnRenamed("import_name", "top").withColumnRenamed("dist", "__dist")), "top", "left")
    imported = F.col("__dist").isNotNull() & (F.col("kind") != "requirement")  # a requirement names the distribution itself
    df = df.withColumn("aliased", imported).withColumn("dist", F.when(imported, F.col("__dist")).otherwise(F.col("top"))).drop("__dist")
    return decide(lookup(df, registry, known_once=known_once), rules)


def adjudicate(decisions: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """Unresolved decisions (case_id, top, name, ...) whose top or full name the owner has adjudicated are kept.

    adjudicated: (case_id, name).
    """
    df = flag(decisions, adjudicated.withColumnRenamed("name", "top"), ["case_id", "top"], "__by_top")
    df = flag(df, adjudicated, ["case_id", "name"], "__by_name")
    kept = (F.col("reason") == "unresolved") & (F.col("__by_top") | F.col("__by_name"))
    return df.withColumns({"verdict": F.when(kept, "suppress").otherwise(F.col("verdict")), "reason": F.when(kept, "adjudicated-keep").otherwise(F.col("reason"))}).drop("__by_top", "__by_name")


def resolve_dependencies(candidates: DataFrame, registry: DataFrame, known_once: bool = False) -> DataFrame:
    return decide(lookup(candidates.withColumn("dist", F.col("top")), registry, known_once=known_once), DEPENDENCY_RULES)


def histogram(decisions: DataFrame, weight: str | None = None) -> DataFrame:
    """Rows by verdict and reason; with a weight, a row stands for that many."""
    return decisions.groupBy("verdict", "reason").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def new_verdicts(known: DataFrame, fetched: DataFrame) -> DataFrame:
    """The registry table after a run: definite answers only, the latest for each name."""
    both = known.unionByName(fetched.where("exists IS NOT NULL")).withColumn("name", normalize(F.col("name")))
    return both.groupBy("name").agg(F.max_by(F.struct("status", "exists", "checked"), "checked").alias("v")).select("name", "v.*")
