"""Helpers that the corpus operators share."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filecensus.session import work_dir

# Workers get this subpackage's functions themselves, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules["filecensus.llm"])

#: Spark removes the shuffle files of a query as soon as it has ended.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word: everything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table that later steps read more than once, where all executors see it.

    Shuffle files of the write go when it ends; without the setting they wait until the driver happens to
    collect its garbage, and asking for that after each of many small steps makes its heap grow.
    """
    path = work_dir(df.sparkSession, label)
    with dropped_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside drop their shuffle files at their end; the session's own setting comes back."""
    own = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, own)


def release(table: DataFrame) -> None:
    """Empty a table of :func:`stored` that no later step reads, so that its files do not wait for the job's end."""
    files = table.inputFiles()
    if files:
        table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


def words_of(text: Column) -> Column:
    """Words of a text as an array, none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Id and text hash of a row, which tell rows that share an id (or have none) apart; never null, nulls are equal."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(text, F.length(text)).alias("content"))
