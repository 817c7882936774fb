"""The corpus pipeline: documents through quality rules, classifier, near-dedup, source mixing and BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdictflow.llm import bpe, common, minhash_dedup, mixing, pu_classifier, quality_rules

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("quality_classifier", pu_classifier.stage),
    ("near_dedup", minhash_dedup.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: The classifier is trained, so SQL cannot express its stage; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written to the shared folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            common.discard(docs)
        docs = out
    return docs
