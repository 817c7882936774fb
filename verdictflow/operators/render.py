"""Findings as JSON arrays and as markdown tables; reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import link, location, percent
from . import scoring

FIELDS = ("name", "file", "line", "kind", "message")


def findings_json(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """case_id, body: an array per case, ``[]`` without findings; empty fields are left out."""
    item = F.struct(F.col("name"), F.nullif("file", F.lit("")).alias("file"), F.nullif("line", F.lit(0)).alias("line"), F.nullif("kind", F.lit("")).alias("kind"), F.nullif("message", F.lit("")).alias("message"))
    rows = findings.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("f")))), lambda x: x["f"]).alias("fs"))
    return cases.select("case_id").join(rows, "case_id", "left").select("case_id", F.coalesce(F.to_json("fs"), F.lit("[]")).alias("body"))


def findings_markdown(findings: DataFrame, link_base: str = "", marker: str = "") -> DataFrame:
    """case_id, body: a heading and a table row per finding, by file and line; cases without findings have no row.

    A marker is a hidden first line by which a later run finds the comment that holds the body.
    """
    label = location(F.col("file"), F.col("line"))
    target = link(F.lit(link_base), F.col("file"), F.col("line")) if link_base else F.lit(None).cast("string")
    where = F.when(target.isNotNull(), F.concat(F.lit("["), label, F.lit("]("), target, F.lit(")"))).otherwise(label)
    row = F.concat(F.lit("| "), "name", F.lit(" | "), where, F.lit(" | "), F.coalesce("evidence", F.lit("")), F.lit(" |"))
    out = findings.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), "ord", row.alias("row")))).alias("rows"))
    heading = F.when(F.col("n") == 1, "1 name could not be found").otherwise(F.concat(F.col("n").cast("string"), F.lit(" names could not be found")))
    head = F.lit(f"<!-- {marker} -->\n" if marker else "")
    return out.select("case_id", F.concat(head, heading, F.lit("\n\n| name | where | evidence |\n|---|---|---|\n"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n")).alias("body"))


def report_text(report: DataFrame) -> DataFrame:
    """corpus, line: one aligned row per corpus, a dash where a metric is undefined."""
    cells = [F.rpad("corpus", 14, " "), *[F.lpad(F.col(c).cast("string"), 6, " ") for c in ("cases", "tp", "fp", "fn", "noise")], *[F.lpad(percent(F.col(c)), 8, " ") for c in ("precision", "recall", "f1")]]
    return report.select("corpus", F.concat_ws(" ", *cells).alias("line"))


def report_json(tool: str, match: str, cases: DataFrame, truths: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """body: one JSON document with every corpus by name and the total; undefined metrics are null.

    errors: (case_id, error).
    """
    both = lambda df: df.join(cases.select("case_id", "corpus"), "case_id").withColumn("corpus", F.explode(F.array("corpus", F.lit("TOTAL"))))
    credit = both(scoring.credited(truths, findings, match)).withColumn("kind", F.coalesce(F.nullif("kind", F.lit("")), F.lit("?")))
    kinds = credit.groupBy("corpus", "kind").agg(F.struct(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total")).alias("v"))
    kinds = kinds.groupBy("corpus").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "v")))).alias("kinds"))
    unlocated = credit.groupBy("corpus").agg(F.count_if("unlocated").alias("unlocated"))
    said = both(errors).groupBy("corpus").agg(F.transform(F.array_sort(F.collect_list(F.struct("case_id", "error"))), lambda e: F.concat(e["case_id"], F.lit(": "), e["error"])).alias("errors"))
    rows = scoring.corpus_report(scoring.case_counts(cases, truths, findings, match))
    for df in (kinds, unlocated, said):
        rows = rows.join(df, "corpus", "left")
    kinds_type = "map<string,struct<hits:bigint,total:bigint>>"
    item = F.struct(
        "corpus", "cases", "findings", "tp", "fp", "fn", "precision", "recall", "f1", "noise", F.coalesce("kinds", F.create_map().cast(kinds_type)).alias("kinds"),
        F.coalesce("unlocated", F.lit(0)).alias("unlocated"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
    )
    rows = rows.select("corpus", F.to_json(item, {"ignoreNullFields": "false"}).alias("j"))
    out = rows.agg(F.array_sort(F.collect_list(F.when(F.col("corpus") != "TOTAL", F.struct("corpus", "j")))).alias("c"), F.max(F.when(F.col("corpus") == "TOTAL", F.col("j"))).alias("total"))
    none = '{"corpus":"TOTAL","cases":0,"findings":0,"tp":0,"fp":0,"fn":0,"precision":null,"recall":null,"f1":null,"noise":0,"kinds":{},"unlocated":0,"errors":[]}'
    head = F.regexp_replace(F.to_json(F.struct(F.lit(tool).alias("tool"), F.lit(match).alias("match"))), r"\}$", "")
    return out.select(F.concat(head, F.lit(',"corpora":['), F.array_join(F.transform("c", lambda x: x["j"]), ","), F.lit('],"total":'), F.coalesce("total", F.lit(none)), F.lit("}")).alias("body"))


def findings(decisions: DataFrame) -> DataFrame:
    """The fired decisions with messages; ord is their order in the case."""
    said = F.concat(F.lit("'"), "top", F.lit("' is "), F.when(F.col("kind") == "requirement", "required").otherwise("imported"), F.lit(", but the registry has no such name (looked up as "), "dist", F.lit(")"))
    kind = F.when(F.col("kind") == "requirement", "requirement").otherwise("import")
    return decisions.where("verdict = 'fire'").select("case_id", F.struct("file_id", "part", "pos", "k").alias("ord"), F.col("top").alias("name"), "file", "line", kind.alias("kind"), said.alias("message"), "evidence")
