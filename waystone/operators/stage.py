"""Cutting a plan: write a result once to the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Store ``df`` as parquet in the shared folder.

    Used where a result feeds several branches: it is computed once, its size
    is known to the planner, and a lost executor does not lose it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
