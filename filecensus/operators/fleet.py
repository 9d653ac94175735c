"""Reports of many machines: nodes, alerts, changes and the overview.

``reports`` has one row per report, ``files`` one row per report and file.  Lists that a
report would nest without bound (paths behind an alert) are tables here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from filecensus.operators import ordering
from filecensus.operators.lookup import lookup_join

# Attributes of a node, alert kinds with severity and message.
NODE_ATTRIBUTES = [
    "hostname", "fqdn", "ip_address", "mac_address", "os", "os_version", "os_release",
    "platform", "architecture", "username",
]
ALERTS = {
    "secrets_found": ("critical", "%d secret/credential file(s) found on %s"),
    "deserialization_risk": ("warning", "%d file(s) with deserialization risk on %s"),
    "permissions": ("warning", "%d file(s) with overly permissive access on %s"),
    "embedded_secrets": ("critical", "%d file(s) with embedded secrets on %s"),
}


def _latest() -> Column:
    return F.struct("received_at", "report_id")


def latest_reports(reports: DataFrame) -> DataFrame:
    """The newest report of each machine; equal times are decided by report id."""
    rest = [c for c in reports.columns if c != "machine_id"]
    newest = F.max_by(F.struct(*rest), _latest()).alias("_r")
    return reports.groupBy("machine_id").agg(newest).select("machine_id", "_r.*")


def node_registry(reports: DataFrame) -> DataFrame:
    """Nodes from the append-only reports: no upsert is needed.

    Attributes come from the newest report even where it has none; first_seen and last_seen
    are the extremes of the arrival times.
    """
    attributes = F.max_by(F.struct(*NODE_ATTRIBUTES), _latest()).alias("_a")
    scan = F.struct("total_files", "total_size", "scan_path")
    return (
        reports.groupBy("machine_id")
        .agg(
            attributes,
            F.min("received_at").alias("first_seen"),
            F.max("received_at").alias("last_seen"),
            F.count("*").alias("report_count"),
            F.max_by(scan, _latest()).alias("_s"),
        )
        .select(
            "machine_id",
            "_a.*",
            "first_seen",
            "last_seen",
            "report_count",
            F.col("_s.total_files").alias("latest_files"),
            F.col("_s.total_size").alias("latest_size"),
            F.col("_s.scan_path").alias("latest_scan_path"),
        )
    )


def nodes_by_last_seen(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(F.desc("last_seen"), F.asc("machine_id"))


def node_with_latest_report(reports: DataFrame, machine_id: str) -> DataFrame:
    """One node and its newest report; the filter reaches the scan of the reports table."""
    mine = reports.filter(F.col("machine_id") == machine_id)
    return node_registry(mine).join(
        latest_reports(mine).select("machine_id", "report_id", "scan_time", "by_category"), "machine_id", "left"
    )


def scan_history(reports: DataFrame, limit: int = 50, machine_id: str | None = None) -> DataFrame:
    """Newest reports of one machine, or of each; ranking is cut to ``limit`` before the shuffle."""
    columns = [
        "report_id", "machine_id", "received_at", "scan_time", "scan_path", "total_files",
        "total_size", "scan_duration",
    ]
    if machine_id is not None:
        mine = reports.filter(F.col("machine_id") == machine_id).select(*columns)
        return ordering.most_recent(mine, "received_at", ["report_id"], limit)
    newest = W.partitionBy("machine_id").orderBy(F.desc("received_at"), F.desc("report_id"))
    ranked = reports.select(*columns).withColumn("_n", F.row_number().over(newest))
    return ranked.filter(F.col("_n") <= limit).drop("_n")


def fleet_totals(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count("*").alias("total_nodes"),
        F.coalesce(F.sum(F.coalesce("latest_files", F.lit(0))), F.lit(0)).alias("total_files"),
        F.coalesce(F.sum(F.coalesce("latest_size", F.lit(0))), F.lit(0)).alias("total_size"),
    )


def fleet_categories(reports: DataFrame) -> DataFrame:
    """Category totals over the newest report of each machine."""
    newest = reports.groupBy("machine_id").agg(F.max_by("by_category", _latest()).alias("by_category"))
    return (
        newest.select(F.explode("by_category").alias("category", "_t"))
        .groupBy("category")
        .agg(F.sum("_t.count").alias("n_files"), F.sum("_t.size").alias("total_size"))
    )


def _alert_tests() -> dict[str, Column]:
    reason = F.col("risk_reason")
    return {
        "secrets_found": F.array_contains("categories", "secret"),
        # The report format spells the reason "Pickle deserialization ...", so the word is
        # looked for anywhere in it.
        "deserialization_risk": (F.col("risk_level") == "danger")
        & F.contains(F.lower(reason), F.lit("deserialization")),
        "permissions": F.length("permission_alert") > 0,
        "embedded_secrets": F.startswith(reason, F.lit("Possible embedded")),
    }


def alerts(reports: DataFrame, files: DataFrame) -> DataFrame:
    """Up to four alerts per report, each with the number of files behind it.

    Files are counted per report first (map-side combine); only one row per report meets
    the reports table.
    """
    counts = files.groupBy("report_id").agg(
        *[F.count_if(test).alias(kind) for kind, test in _alert_tests().items()]
    )
    one_each = reports.select("report_id", "machine_id", "hostname", "received_at")
    found = [
        F.struct(
            F.lit(kind).alias("alert_type"),
            F.lit(severity).alias("severity"),
            F.format_string(message, F.col(kind), F.col("hostname")).alias("message"),
            F.col(kind).alias("n_files"),
        )
        for kind, (severity, message) in ALERTS.items()
    ]
    return (
        one_each.join(counts, "report_id")
        .select(
            "report_id",
            "machine_id",
            F.col("received_at").alias("created_at"),
            F.inline(F.filter(F.array(*found), lambda a: a["n_files"] > 0)),
        )
        .withColumn("acknowledged", F.lit(0).cast("long"))
    )


def alert_files(files: DataFrame) -> DataFrame:
    """All files behind the alerts, one row each; the permission alert shows their permissions."""
    hits = F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in _alert_tests().items()]))
    found = files.select("report_id", F.explode(hits).alias("alert_type"), "path", "permissions")
    perms = F.when(F.col("alert_type") == "permissions", F.col("permissions"))
    return found.select("report_id", "alert_type", "path", perms.alias("perms"))


def acknowledge(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Alerts with those marked that somebody has dealt with: ``seen`` has report_id and alert_type.

    Alerts stay as they were written; what was seen is a table of its own that is met when they are read.
    """
    marks = seen.select("report_id", "alert_type").distinct().withColumn("_seen", F.lit(1).cast("long"))
    marked = lookup_join(found, marks, ["report_id", "alert_type"], "left")
    return marked.withColumn("acknowledged", F.greatest(F.coalesce("_seen", F.lit(0)), F.col("acknowledged"))).drop("_seen")


def unacknowledged(found: DataFrame) -> DataFrame:
    return found.filter(F.col("acknowledged") == 0)


def alert_severity(found: DataFrame) -> DataFrame:
    return unacknowledged(found).groupBy("severity").agg(F.count("*").alias("n_alerts"))


def recent_alerts(found: DataFrame, nodes: DataFrame, limit: int = 100) -> DataFrame:
    """Newest alerts with their host names; cut to ``limit`` before the join.

    Every alert has a node, because nodes are derived from the same reports.
    """
    newest = ordering.most_recent(found, "created_at", ["report_id", "alert_type"], limit)
    return nodes.select("machine_id", "hostname").join(F.broadcast(newest), "machine_id")


def recent_changes(changes: DataFrame, nodes: DataFrame, limit: int = 100) -> DataFrame:
    newest = ordering.most_recent(changes, "detected_at", ["report_id", "file_path"], limit)
    return nodes.select("machine_id", "hostname").join(F.broadcast(newest), "machine_id")


def alerts_with_host(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """All alerts with host names."""
    return lookup_join(found, nodes.select("machine_id", "hostname"), ["machine_id"], "inner")


def changes_with_host(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """All changes with host names."""
    return lookup_join(changes, nodes.select("machine_id", "hostname"), ["machine_id"], "inner")


CHANGE_LISTS = {"new_files": "new", "changed_files": "modified", "deleted_files": "deleted"}


def reported_changes(documents: DataFrame) -> DataFrame:
    """Changes a report itself lists, if its integrity status is ``changes_detected``.

    Works inside each document: the three lists are concatenated and unnested, no shuffle.
    """

    def tag(name: str, kind: str) -> Column:
        def change(f: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("change_type"),
                f["path"].alias("file_path"),
                f["filename"].alias("filename"),
                F.to_json(f).alias("details"),
            )

        return F.transform(F.coalesce(F.col(f"integrity.{name}"), F.array()), change)

    tagged = [tag(name, kind) for name, kind in CHANGE_LISTS.items()]
    return documents.filter(F.col("integrity.status") == "changes_detected").select(
        "report_id", "machine_id", F.col("received_at").alias("detected_at"), F.inline(F.concat(*tagged))
    )


def computed_changes(changes: DataFrame, reports: DataFrame) -> DataFrame:
    """Snapshot differences in the fleet's vocabulary (``new`` for added)."""
    kind = F.when(F.col("action") == "added", "new").otherwise(F.col("action"))
    details = F.to_json(
        F.struct(
            "path", "filename", "size_bytes", "categories", "previous_size", "previous_hash", "current_hash"
        )
    )
    one_each = reports.select("report_id", "machine_id", F.col("received_at").alias("detected_at"))
    return lookup_join(changes, one_each, ["report_id"], "inner").select(
        "report_id",
        "machine_id",
        "detected_at",
        kind.alias("change_type"),
        F.col("path").alias("file_path"),
        "filename",
        details.alias("details"),
    )


def receipts(reports: DataFrame, found: DataFrame, changes: DataFrame) -> DataFrame:
    """What was stored for each report."""
    n_alerts = found.groupBy("report_id").agg(F.count("*").alias("alerts_generated"))
    n_changes = changes.groupBy("report_id").agg(F.count("*").alias("changes_detected"))
    return (
        reports.select("report_id", "machine_id", "hostname")
        .join(n_alerts, "report_id", "left")
        .join(n_changes, "report_id", "left")
        .select(
            F.lit("accepted").alias("status"),
            "machine_id",
            "hostname",
            "report_id",
            F.coalesce("alerts_generated", F.lit(0)).alias("alerts_generated"),
            F.coalesce("changes_detected", F.lit(0)).alias("changes_detected"),
        )
    )
