"""Parquet tables as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with at least one task per core.

    Taking strings apart is far more work per byte than scanning them. A table in fewer splits
    than cores is therefore dealt out first; a larger one is left as scanned.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
