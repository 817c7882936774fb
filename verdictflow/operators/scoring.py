"""Findings against truths: credit, counts per case, kind and corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import with_metrics
from ..functions.names import normalize


def credited(truths: DataFrame, findings: DataFrame, match: str = "file") -> DataFrame:
    """truths (case_id, truth_id, name, file, kind) with hit and unlocated.

    A truth is hit by a finding of the same normalised name in its case whose file is the truth's, unless the truth has
    none or names alone are matched.  A missed one whose namesakes all lack a file is unlocated.
    """
    t = truths.withColumn("norm", normalize(F.col("name"))).alias("t")
    f = findings.select("case_id", normalize(F.col("name")).alias("norm"), "file").alias("f")
    located = F.lit(True) if match == "name" else (F.coalesce(F.col("t.file"), F.lit("")) == "") | F.col("f.file").eqNullSafe(F.col("t.file"))
    joined = t.join(f, (F.col("t.case_id") == F.col("f.case_id")) & (F.col("t.norm") == F.col("f.norm")), "left")
    found = F.col("f.norm").isNotNull()
    out = joined.groupBy("t.case_id", "t.truth_id", "t.name", "t.file", "t.kind", "t.norm").agg(F.bool_or(found & located).alias("hit"), F.bool_or(found).alias("named"), F.bool_or(F.coalesce(F.col("f.file"), F.lit("")) != "").alias("placed"))
    return out.withColumn("hit", F.coalesce("hit", F.lit(False))).withColumn("unlocated", ~F.col("hit") & F.col("named") & ~F.col("placed")).drop("named", "placed")


def false_positives(truths: DataFrame, findings: DataFrame, match: str = "file") -> DataFrame:
    """case_id, name: distinct raw names whose normalised name earned no credit in the case."""
    credit = credited(truths, findings, match).where("hit").select("case_id", "norm").distinct()
    rows = findings.withColumn("norm", normalize(F.col("name")))
    return rows.join(credit, ["case_id", "norm"], "left_anti").select("case_id", "name").distinct()


def case_counts(cases: DataFrame, truths: DataFrame, findings: DataFrame, match: str = "file") -> DataFrame:
    """One row per case (case_id, label, corpus): findings, tp, fp, fn."""
    hits = credited(truths, findings, match).groupBy("case_id").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fn"))
    fps = false_positives(truths, findings, match).groupBy("case_id").agg(F.count(F.lit(1)).alias("fp"))
    n = findings.groupBy("case_id").agg(F.count(F.lit(1)).alias("findings"))
    out = cases.join(n, "case_id", "left").join(hits, "case_id", "left").join(fps, "case_id", "left")
    return out.select("case_id", "corpus", "label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("findings", "tp", "fp", "fn")])


def case_names(cases: DataFrame, truths: DataFrame, findings: DataFrame, match: str = "file") -> DataFrame:
    """case_id, tp_names, fp_names, fn_names, unlocated_names: sorted lists for every case."""
    credit = credited(truths, findings, match)
    sort = lambda cond, name: F.array_sort(F.collect_list(F.when(cond, F.col(name)))).alias
    hits = credit.groupBy("case_id").agg(sort(F.col("hit"), "name")("tp_names"), sort(~F.col("hit"), "name")("fn_names"), sort(F.col("unlocated"), "name")("unlocated_names"))
    fps = false_positives(truths, findings, match).groupBy("case_id").agg(F.array_sort(F.collect_list("name")).alias("fp_names"))
    rows = cases.select("case_id").join(hits, "case_id", "left").join(fps, "case_id", "left")
    return rows.select("case_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("tp_names", "fp_names", "fn_names", "unlocated_names")])


def kind_counts(truths: DataFrame, findings: DataFrame, match: str = "file") -> DataFrame:
    rows = credited(truths, findings, match).withColumn("kind", F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("?")))
    return rows.groupBy("kind").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total"))


def corpus_report(counts: DataFrame) -> DataFrame:
    """Per corpus and in total; the total's metrics come from summed counts."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("findings", "tp", "fp", "fn")]
    noise = F.sum(F.when(F.col("label") == "clean", F.col("findings")).otherwise(0)).cast("long").alias("noise")
    out = counts.rollup("corpus").agg(F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("cases"), *sums, noise)
    return with_metrics(out.withColumn("corpus", F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col("corpus"))).drop("__g"))
