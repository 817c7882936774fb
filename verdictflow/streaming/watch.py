"""A streaming front end: files of diffs as they arrive, scanned by the batch plan and merged into a findings table.

The reference behaviour is batch only; this is an addition.  Every micro-batch runs the same plan as ``plans.scan`` over
its own diffs.  The sink is keyed by batch id, so a batch that is run again after a failure replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.scan import release, scan
from ..sources.readers import as_diffs


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """case_id, diff of each file that appears in folder."""
    return as_diffs(spark.readStream.format("text").option("wholetext", True).load(folder))


def watch(spark: SparkSession, folder: str, registry: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        found = scan(batch.sparkSession, batch, registry)
        found.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        release(found)

    writer = incoming(spark, folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
