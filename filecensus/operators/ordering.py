"""Sort orders and top-k lists.  ``path`` breaks ties, so results do not depend on tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filecensus.operators import rollups


def sort_keys(by: str, tie: list[str]) -> list[Column]:
    """Largest first, newest first, by name, or by category and size; unknown means size."""
    orders = {
        "size": [F.desc("size_bytes")],
        "date": [F.desc("modified_timestamp")],
        "name": [F.asc(F.lower("filename"))],
        "category": [F.asc("category"), F.desc("size_bytes")],
    }
    return [*orders.get(by, orders["size"]), *[F.asc(c) for c in tie]]


def sort_files(files: DataFrame, by: str = "size", tie: list[str] = ["path"]) -> DataFrame:
    return files.orderBy(*sort_keys(by, tie))


def top_files(files: DataFrame, n: int, by: str = "size", tie: list[str] = ["path"]) -> DataFrame:
    """First ``n`` rows of a sort order; each task keeps ``n`` rows at most."""
    return sort_files(files, by, tie).limit(n)


def sort_by_column(files: DataFrame, column: str, ascending: bool = True, tie: list[str] = ["path"]) -> DataFrame:
    """Sort by any column, texts without regard to case."""
    text = isinstance(files.schema[column].dataType, T.StringType)
    key = F.lower(column) if text else F.col(column)
    return files.orderBy(key.asc() if ascending else key.desc(), *[F.asc(c) for c in tie])


def partitioned(rows: DataFrame) -> DataFrame:
    """Sorted rows with the number of their partition and their place in it, to be written once."""
    spot = F.monotonically_increasing_id()
    return rows.withColumns({"_part": F.shiftright(spot, 33), "_place": spot.bitwiseAND((1 << 33) - 1)})


def positions(written: DataFrame) -> DataFrame:
    """Number written, partitioned rows from 1 in their order; no task holds all of them."""
    parts = written.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = written.join(F.broadcast(before), "_part")
    return numbered.withColumn("position", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def top_extensions(files: DataFrame, n: int = 8) -> DataFrame:
    ranked = rollups.by_extension(files).orderBy(F.desc("total_size"), F.asc("extension"))
    return rollups.with_bars(ranked.limit(n))


def categories_by_size(files: DataFrame) -> DataFrame:
    barred = rollups.with_bars(rollups.by_category(files))
    return barred.orderBy(F.desc("total_size"), F.asc("category"))


def categories_by_name(files: DataFrame) -> DataFrame:
    return rollups.by_category(files).orderBy("category")


def most_recent(rows: DataFrame, time: str, tie: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows; later keys win ties."""
    return rows.orderBy(F.desc(time), *[F.desc(c) for c in tie]).limit(n)


def first_items(items: Column, n: int) -> Column:
    """A list cut to its first entries for display."""
    return F.slice(items, 1, n)
