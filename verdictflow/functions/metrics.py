"""Quality metrics; undefined values are null, never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision(tp: Column, fp: Column) -> Column:
    return F.try_divide(tp.cast("double"), (tp + fp).cast("double"))


def recall(tp: Column, fn: Column) -> Column:
    return F.try_divide(tp.cast("double"), (tp + fn).cast("double"))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.try_divide(2 * p * r, p + r))


def with_metrics(df: DataFrame) -> DataFrame:
    """df (tp, fp, fn) with precision, recall and f1."""
    df = df.withColumn("precision", precision(F.col("tp"), F.col("fp"))).withColumn("recall", recall(F.col("tp"), F.col("fn")))
    return df.withColumn("f1", f1(F.col("precision"), F.col("recall")))
