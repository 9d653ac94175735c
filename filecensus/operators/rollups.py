"""Counts and bytes by category, extension, folder and risk.

Each is one aggregation with map-side combine; only group keys times tasks are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filecensus.functions import paths, sizes


def _count_and_size(grouped) -> DataFrame:
    return grouped.agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("total_size"))


def by_category(files: DataFrame, keys: list[str] = []) -> DataFrame:
    """A file counts in each of its categories."""
    return _count_and_size(
        files.select(*keys, F.explode("categories").alias("category"), "size_bytes").groupBy(*keys, "category")
    )


def by_primary_category(files: DataFrame) -> DataFrame:
    """A file counts once, in its first category."""
    return _count_and_size(files.groupBy("category"))


def by_extension(files: DataFrame, keys: list[str] = []) -> DataFrame:
    label = sizes.extension_label(F.col("extension")).alias("extension")
    return _count_and_size(files.groupBy(*keys, label))


def totals(files: DataFrame, keys: list[str] = []) -> DataFrame:
    """Each row once, folders included; an empty scan has 0 files and 0 bytes."""
    return files.groupBy(*keys).agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size"),
    )


def by_column(files: DataFrame, column: str) -> DataFrame:
    """Row counts per value, e.g. of confidence or detection_method."""
    return files.groupBy(column).agg(F.count("*").alias("n_files"))


def with_size_text(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("size_human", sizes.format_size(F.col("total_size")))


def with_bars(rollup: DataFrame) -> DataFrame:
    """Share of the largest row; for bounded rollups only (categories, a top-k list)."""
    largest = F.max("total_size").over(W.partitionBy(F.lit(1)))
    return rollup.withColumn("bar_percent", sizes.bar_percent(F.col("total_size"), largest))


def summary(files: DataFrame, keys: list[str]) -> DataFrame:
    """One row per scan: totals and the map of totals per category, from one pass.

    Each file counts once under NULL for the totals and once in each category.  The map
    has at most one entry per known category, so gathering it is bounded.
    """
    counted_in = F.concat(F.array(F.lit(None).cast("string")), F.col("categories"))
    per_category = _count_and_size(
        files.select(*keys, "size_bytes", F.explode(counted_in).alias("category")).groupBy(*keys, "category")
    )
    whole, category = F.col("category").isNull(), F.col("category")
    entry = F.struct(
        category,
        F.struct(
            F.col("n_files").alias("count"),
            F.col("total_size").alias("size"),
            sizes.format_size(F.col("total_size")).alias("size_human"),
        ),
    )
    return per_category.groupBy(*keys).agg(
        F.max(F.when(whole, F.col("n_files"))).alias("total_files"),
        F.max(F.when(whole, F.col("total_size"))).alias("total_size"),
        F.map_from_entries(F.collect_list(F.when(~whole, entry))).alias("by_category"),
    )


def folder_tree(files: DataFrame, keys: list[str]) -> DataFrame:
    """Files and bytes below every folder at any depth; ``folder`` is relative, root is ``""``.

    Rows are repeated once per ancestor before a map-side combine, so the root folder
    costs one shuffled row per task.
    """
    rel = paths.relative(F.col("path"), F.col("scan_path"))
    return _count_and_size(
        files.select(*keys, "size_bytes", F.explode(paths.ancestors(rel)).alias("folder")).groupBy(*keys, "folder")
    )


def folder_sizes(listing: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes below every folder of the unfiltered listing, hidden and skipped ones included."""
    return folder_tree(listing.filter(~F.col("is_directory")), keys)


def risk_banners(files: DataFrame) -> DataFrame:
    """Counts behind the warning banners, in one pass."""

    def has(name: str) -> Column:
        return F.array_contains("categories", name)

    danger = F.col("risk_level") == "danger"
    embedded = danger & ~has("secret") & F.contains("risk_reason", F.lit("embedded secret"))
    return files.agg(
        F.count_if(danger).alias("danger_files"),
        F.count_if(F.col("risk_level") == "warning").alias("warning_files"),
        F.count_if(has("source")).alias("source_files"),
        F.count_if(has("skill")).alias("skill_files"),
        F.count_if(has("secret")).alias("secret_files"),
        F.count_if(embedded).alias("embedded_secret_files"),
    )


def optional_columns(files: DataFrame) -> DataFrame:
    """Does any row have an owner, does any have a hash?"""
    return files.agg(
        F.coalesce(F.bool_or(F.col("owner").isNotNull()), F.lit(False)).alias("has_permissions"),
        F.coalesce(F.bool_or(F.col("hash").isNotNull()), F.lit(False)).alias("has_hashes"),
    )


def size_thresholds(rows: DataFrame, size: str, thresholds: list[str]) -> DataFrame:
    """Rows at or above each size text, all thresholds in one pass."""
    counts = [F.count_if(F.col(size) >= sizes.parse_size(F.lit(t))) for t in thresholds]
    pairs = [F.struct(F.lit(t).alias("threshold"), c.alias("n_files")) for t, c in zip(thresholds, counts)]
    return rows.agg(F.array(*pairs).alias("counts")).select(F.inline("counts"))
