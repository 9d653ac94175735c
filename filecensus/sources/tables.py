"""Parquet tables as inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Give every core rows to work on if a table comes in fewer splits than cores.

    ``rows`` must be a plain table read: counting its splits then runs nothing.
    A table of many files passes through untouched; only a small one, such as a single
    row group, is shuffled once so that content rules do not run in one task.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
