"""Permission alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecensus.functions import modes, text

# Category sets, alert codes and reasons.
CONFIDENTIAL = ["secret", "agent"]
SENSITIVE = ["model", "secret", "checkpoint", "config", "agent", "data", "vector"]
REASONS = {
    "world_writable": "World-writable — anyone on the system can modify this file",
    "world_readable_secret": "Secret file is world-readable — restrict to owner only (chmod 600)",
    "world_readable_agent": "Agent/prompt file is world-readable — consider restricting access (chmod 640)",
    "group_writable": "Sensitive AI file is group-writable — any group member can modify it",
    "too_open": "Non-source AI file has world-execute permission — unusual, review permissions",
}


def _any_of(names: list[str]) -> Column:
    return F.arrays_overlap("categories", text.strings(names))


def _finding() -> Column:
    """Which reason applies to the mode string, most serious first."""
    perms = F.col("permissions")

    def at(position: int) -> Column:
        return F.substr(perms, F.lit(position + 1), F.lit(1))

    return F.when(F.length(perms) >= 10, (
        F.when(at(8) == "w", "world_writable")
        .when((at(7) == "r") & _any_of(["secret"]), "world_readable_secret")
        .when((at(7) == "r") & _any_of(CONFIDENTIAL), "world_readable_agent")
        .when((at(5) == "w") & _any_of(SENSITIVE), "group_writable")
        .when(
            ~at(9).isin("-", "S", "T") & (at(0) != "d") & ~_any_of(["source"]) & _any_of(SENSITIVE),
            "too_open",
        )
    ))


def add_permissions(files: DataFrame) -> DataFrame:
    """Mode string from mode bits."""
    return files.withColumn("permissions", modes.mode_string(F.col("mode")))


def add_permission_alerts(files: DataFrame) -> DataFrame:
    """Alert code and reason from ``permissions`` and ``categories``; NULL where all is well."""
    finding = F.col("_finding")
    reason = F.when(finding == "world_writable", REASONS["world_writable"])
    for code in list(REASONS)[1:]:
        reason = reason.when(finding == code, REASONS[code])
    code = F.when(finding.startswith("world_readable"), "world_readable").otherwise(finding)
    return (
        files.withColumn("_finding", _finding())
        .withColumns({"permission_alert": code, "permission_alert_reason": reason})
        .drop("_finding")
    )


def permission_alert_counts(files: DataFrame) -> DataFrame:
    return (
        files.filter(F.col("permission_alert").isNotNull())
        .groupBy("permission_alert")
        .agg(F.count("*").alias("n_files"))
    )
