"""Small files written by the driver, for inputs that a run brings itself; on the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session without the setting takes a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/verdictflow/staged-{uuid.uuid4().hex}"


def put(spark: SparkSession, files: dict[str, str]) -> str:
    """Write texts by their paths inside a new shared folder; the folder."""
    folder = shared_folder(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, text in files.items():
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = at.getFileSystem(conf).create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
    return folder
