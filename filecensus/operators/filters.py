"""Which entries of a listing a scan reports: hidden names, skipped folders, depth, links,
checkpoint folders, size and category.

All walking rules look at the entry's own path only, so they are row-local: no join with a
table of folders and no shuffle is needed to leave a subtree out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecensus.functions import paths
from filecensus.functions.text import strings, unicode_regex
from filecensus.operators import rules as R

CHECKPOINT_FOLDER = (
    rf"(?i)^((?:[^/]+/)*?(?:{R.CHECKPOINT_WORDS})[-_](?:{R.CHECKPOINT_ENDINGS}))/"
)
HIDDEN_SEGMENT = r"(^|/)\."
SKIPPED_SEGMENT = r"(^|/)(" + "|".join(re.escape(n) for n in R.SKIPPED_FOLDERS) + r")/"


@dataclass(frozen=True)
class ScanOptions:
    """What a scan lists and computes."""

    max_depth: int | None = None
    min_size_bytes: int = 0
    categories: tuple[str, ...] = ()
    include_hidden: bool = False
    follow_symlinks: bool = False
    compute_permissions: bool = False
    compute_hashes: bool = False


def checkpoint_folder(relpath: Column, is_directory: Column) -> Column:
    """The shallowest checkpoint folder at or above an entry, or NULL."""
    probe = F.when(is_directory, F.concat(relpath, F.lit("/"))).otherwise(relpath)
    return F.nullif(F.regexp_extract(probe, unicode_regex(CHECKPOINT_FOLDER), 1), F.lit(""))


def reached(entry: Column, options: ScanOptions) -> Column:
    """Does the walk get to the entry with this relative path?"""
    ok = ~entry.rlike(SKIPPED_SEGMENT)
    if not options.include_hidden:
        ok = ok & ~entry.rlike(HIDDEN_SEGMENT)
    if options.max_depth is not None:
        ok = ok & (paths.depth(entry) <= options.max_depth)
    return ok


def walk(listing: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Entries a scan reaches, with ``relpath`` and ``checkpoint`` (relative folder or NULL).

    Entries below a checkpoint folder stay in, whatever their own names are, because the
    folder's size and hash cover all of them.
    """
    is_directory = F.col("is_directory")
    placed = listing.withColumn(
        "relpath", paths.relative(F.col("path"), F.col("scan_path"))
    ).withColumn("checkpoint", checkpoint_folder(F.col("relpath"), is_directory))
    placed = placed.filter(reached(F.coalesce("checkpoint", "relpath"), options))
    if not options.follow_symlinks and "is_symlink" in listing.columns:
        placed = placed.filter(~F.col("is_symlink") | F.col("checkpoint").isNotNull())
    return placed


def plain_files(walked: DataFrame) -> DataFrame:
    """Files outside checkpoint folders."""
    return walked.filter(F.col("checkpoint").isNull() & ~F.col("is_directory"))


def collapse_checkpoints(walked: DataFrame, keys: list[str]) -> DataFrame:
    """One row per checkpoint folder, sized by everything below it.

    Grouping is on the folder found in each path; sums are combined map-side, so a folder
    with very many files costs one row per task in the shuffle.
    """
    below = walked.filter(F.col("checkpoint").isNotNull())
    own = F.col("is_directory") & (F.col("relpath") == F.col("checkpoint"))
    carried = [
        F.max(F.when(own, F.col(c))).alias(c)
        for c in ("modified_timestamp", "mode", "owner", "group")
        if c in walked.columns
    ]
    size = F.when(~F.col("is_directory"), F.col("size_bytes"))
    return (
        below.groupBy(*keys, "checkpoint")
        .agg(F.coalesce(F.sum(size), F.lit(0)).alias("size_bytes"), F.count(size).alias("n_files"), *carried)
        .withColumns(
            {
                "path": F.concat(
                    F.regexp_replace("scan_path", "/+$", ""), F.lit("/"), F.col("checkpoint")
                ),
                "filename": paths.basename(F.col("checkpoint")),
                "is_directory": F.lit(True),
            }
        )
    )


def at_least(files: DataFrame, min_size_bytes: int) -> DataFrame:
    """Inclusive lower size bound."""
    return files.filter(F.col("size_bytes") >= min_size_bytes)


def in_categories(files: DataFrame, wanted: list[str]) -> DataFrame:
    """Files with any of the categories; no wish means all files."""
    if not wanted:
        return files
    return files.filter(F.arrays_overlap("categories", strings(wanted)))


def passing(files: DataFrame, options: ScanOptions) -> DataFrame:
    sized = at_least(files, options.min_size_bytes) if options.min_size_bytes else files
    return in_categories(sized, list(options.categories))


def risky(files: DataFrame) -> DataFrame:
    return files.filter(F.col("risk_level").isin("danger", "warning"))


def with_permission_issues(files: DataFrame) -> DataFrame:
    return files.filter(F.col("permission_alert").isNotNull())


def primary_category_over(files: DataFrame, category: str, size_bytes: int) -> DataFrame:
    """Files whose first category is ``category`` and that are larger than ``size_bytes``."""
    return files.filter((F.col("category") == category) & (F.col("size_bytes") > size_bytes))
