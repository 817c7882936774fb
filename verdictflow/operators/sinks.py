"""Sinks: what a run writes.  Each replaces or extends a table of its own; none needs a driver loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cascade, corpus, render

#: The columns by which a scan's decisions are in order within their case.
ORDER = ("file_id", "part", "pos", "k")


def explain_log(decisions: DataFrame) -> DataFrame:
    """One tab-separated line per decision: verdict, reason, name, place, detail; ord is its order in the case."""
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    ord_ = [F.struct(*ORDER).alias("ord")] if set(ORDER) <= set(decisions.columns) else []
    return decisions.select("case_id", *ord_, F.concat_ws("\t", "verdict", "reason", F.coalesce("top", F.lit("-")), place, F.coalesce("dist", F.lit("-"))).alias("line"))


def write_findings(cases: DataFrame, findings: DataFrame, path: str) -> None:
    """A JSON array per case, empty ones included."""
    render.findings_json(cases, findings).write.mode("overwrite").parquet(path)


def write_registry(spark: SparkSession, known: DataFrame, fetched: DataFrame, path: str) -> DataFrame:
    """Definite verdicts, the latest of each name, written beside the old table and returned from there."""
    cascade.new_verdicts(known, fetched).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def write_contexts(top: DataFrame, siblings: DataFrame, path: str) -> None:
    """Captured listings by repository, as JSON with sorted lists."""
    names = top.groupBy("ctx_id").agg(F.array_sort(F.collect_set("name")).alias("top_level"))
    by_dir = siblings.groupBy("ctx_id", "dir").agg(F.array_sort(F.collect_set("name")).alias("names"))
    maps = by_dir.groupBy("ctx_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dir", "names")))).alias("siblings"))
    names.join(maps, "ctx_id", "left").repartition("ctx_id").write.mode("overwrite").partitionBy("ctx_id").json(path)


def tag_contexts(cases: DataFrame, contexts: DataFrame) -> DataFrame:
    """cases (..., repo, context) with the context of their repository; what was there stays where there is none.

    contexts: (repo, context), one row per repository.
    """
    found = contexts.select("repo", F.col("context").alias("__context"))
    return cases.join(found, "repo", "left").withColumn("context", F.coalesce("__context", "context")).drop("__context")


def stamp_absent(truths: DataFrame, snapshot: DataFrame, today: str) -> DataFrame:
    """truths (..., name, verified_absent) with today's stamp, only if every name is still absent from the snapshot.

    The gate is one row, read before the plan is made.
    """
    if not fresh(truths.select("name"), snapshot).first()["still_absent"]:
        return truths
    return truths.withColumn("verified_absent", F.lit(today))


def write_quarantine(cases: DataFrame, flagged: DataFrame, kept_path: str, review_path: str, key: str = "case_id") -> None:
    kept, review = corpus.quarantine(cases, flagged, key)
    kept.write.mode("overwrite").parquet(kept_path)
    review.write.mode("append").parquet(review_path)


def verification_report(decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences by status, names by repository, unresolved candidates.

    decisions: (case_id, repo, ord, kind, name, top, file, line, reason, evidence, signals), ord over all candidates.
    """
    rows = decisions.withColumnRenamed("reason", "status")
    named = rows.withColumn("name", F.coalesce(F.nullif("top", F.lit("")), "name"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")), corpus.name_table(named, ["repo", "kind", "name"], "ord"), rows.where("status = 'unresolved'").select("case_id", "ord", "name", "top", "file", "line", "kind", "evidence", "signals")


def write_verification_report(decisions: DataFrame, path: str) -> None:
    """The report's parts as JSON, in folders of the path."""
    for name, part in zip(("occurrences", "names", "unresolved"), verification_report(decisions), strict=True):
        part.write.mode("overwrite").json(f"{path}/{name}")


def exit_code(findings: DataFrame, errors: DataFrame) -> DataFrame:
    """2 if a case failed, else 1 if anything was found, else 0."""
    codes = findings.select(F.lit(1).alias("code")).unionByName(errors.select(F.lit(2).alias("code")))
    return codes.agg(F.coalesce(F.max("code"), F.lit(0)).alias("code"))


def annotations(findings: DataFrame) -> DataFrame:
    """A workflow warning per finding."""
    return findings.select("case_id", F.format_string("::warning file=%s,line=%d::%s", F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), F.coalesce("message", F.lit(""))).alias("line"))


def fresh(absent: DataFrame, snapshot: DataFrame) -> DataFrame:
    """One row: still_absent, whether no name that must be absent has since appeared in the snapshot."""
    found = cascade.lookup(absent.withColumn("dist", F.col("name")), snapshot)
    return found.agg(F.coalesce(F.bool_and(F.col("registry") == "absent"), F.lit(True)).alias("still_absent"), F.count_if(F.col("registry") == "exists").alias("appeared"))
