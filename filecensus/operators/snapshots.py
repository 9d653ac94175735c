"""Comparing snapshots of an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filecensus.operators.lookup import lookup_join

FILE_COLUMNS = ["filename", "size_bytes", "categories", "hash"]


def last_per_path(files: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the last row of each key; other columns travel in one struct."""
    rest = [c for c in files.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("_last")
    return files.groupBy(*keys).agg(last).select(*keys, "_last.*")


def diff(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Added, modified and deleted files between two snapshots, one row each.

    ``keys`` identify a file and end with ``path``.  Both sides are shuffled once on whole
    file keys, which are unique per snapshot, so no key is hot.  A file is modified if both
    hashes are known and differ.
    """
    side = [*keys, *FILE_COLUMNS]
    old = previous.select(*keys, F.struct(*FILE_COLUMNS).alias("old"))
    new = current.select(*side).select(*keys, F.struct(*FILE_COLUMNS).alias("new"))
    action = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "deleted")
        .when(F.col("old.hash") != F.col("new.hash"), "modified")
    )
    kept = F.coalesce("new", "old")
    modified = F.col("action") == "modified"
    return (
        old.join(new, keys, "full_outer")
        .withColumn("action", action)
        .filter(F.col("action").isNotNull())
        .select(
            *keys,
            "action",
            kept["filename"].alias("filename"),
            kept["size_bytes"].alias("size_bytes"),
            kept["categories"].alias("categories"),
            F.when(modified, F.col("old.size_bytes")).alias("previous_size"),
            F.when(modified, F.col("old.hash")).alias("previous_hash"),
            F.when(modified, F.col("new.hash")).alias("current_hash"),
        )
    )


def new_paths(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(previous.select(*keys), keys, "left_anti")


def deleted_paths(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return previous.join(current.select(*keys), keys, "left_anti")


def diff_summary(changes: DataFrame, keys: list[str] = []) -> DataFrame:
    return changes.groupBy(*keys).agg(
        F.count_if(F.col("action") == "added").alias("new"),
        F.count_if(F.col("action") == "modified").alias("changed"),
        F.count_if(F.col("action") == "deleted").alias("deleted"),
        (F.count("*") > 0).alias("has_changes"),
    )


def with_previous(
    reports: DataFrame, order: list[str] = ["received_at", "report_id"], also: list[str] = []
) -> DataFrame:
    """Add the report before each report of the same machine and scan path, and its columns ``also``.

    The sequence is cut by day: the predecessor is looked for within the day, and a day's
    first report takes the last one of the day before it.  So no window holds the whole
    history of a machine that sends very many reports.  Reports of the unknown machine may be of
    any host: each is a sequence of its own.
    """
    path = F.when(F.col("machine_id") == "unknown", F.col("report_id")).otherwise(F.coalesce("scan_path", F.lit("")))
    dated = reports.withColumns({"_day": F.to_date("received_at"), "_path": path})
    sequence = ["machine_id", "_path"]
    info = F.struct("report_id", "scan_time", *also).alias("_info")
    days = dated.groupBy(*sequence, "_day").agg(F.max_by(info, F.struct(*order)).alias("_last"))
    by_day = W.partitionBy(*sequence).orderBy("_day")
    days = days.withColumn("_before", F.lag("_last").over(by_day)).drop("_last")
    within = W.partitionBy(*sequence, "_day").orderBy(*order)
    chained = dated.withColumn("_within", F.lag(F.struct("report_id", "scan_time", *also)).over(within))
    before = F.coalesce("_within", "_before")
    return (
        chained.join(days, [*sequence, "_day"], "left")
        .withColumns(
            {
                "previous_report_id": before["report_id"],
                "previous_time": before["scan_time"],
                **{f"previous_{c}": before[c] for c in also},
            }
        )
        .drop("_day", "_path", "_within", "_before")
    )


def consecutive_changes(files: DataFrame, sequenced: DataFrame) -> DataFrame:
    """Changes of each report against its predecessor; ``report_id`` is the later one.

    ``sequenced`` comes from :func:`with_previous`.  Files of both reports meet under the
    later report's id, so all pairs are compared in one full outer join.
    """
    later = sequenced.filter("previous_report_id IS NOT NULL")
    current = lookup_join(files, later.select("report_id"), ["report_id"], "inner")
    renamed = files.withColumnRenamed("report_id", "previous_report_id")
    previous = lookup_join(
        renamed, later.select("previous_report_id", "report_id"), ["previous_report_id"], "inner"
    )
    return diff(previous, current, ["report_id", "path"])


def log_entries(changes: DataFrame, sequenced: DataFrame) -> DataFrame:
    """One log row per scan: baseline, clean or changes_detected, with counts."""
    counts = diff_summary(changes, ["report_id"])
    entry = sequenced.join(counts, "report_id", "left")
    first = F.col("previous_report_id").isNull()
    status = (
        F.when(first, "baseline").when(F.col("has_changes"), "changes_detected").otherwise("clean")
    )
    message = F.when(first, "No previous report — this scan is the new baseline").when(
        F.col("has_changes").isNull(), "No changes detected"
    )
    return entry.select(
        F.col("received_at").alias("timestamp"),
        "machine_id",
        "scan_path",
        F.col("report_id").alias("report_file"),
        status.alias("status"),
        message.alias("message"),
        F.col("previous_report_id").alias("compared_to"),
        F.col("previous_time").alias("compared_time"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("new", "changed", "deleted")],
    )


def changed_scans(log: DataFrame) -> DataFrame:
    return log.filter(F.col("status") == "changes_detected")


def log_files(log: DataFrame) -> DataFrame:
    """One row per changed file of a log read from JSON lines."""
    changed = changed_scans(log)
    return changed.select("timestamp", "machine_id", "scan_path", "report_file", F.inline("files"))
