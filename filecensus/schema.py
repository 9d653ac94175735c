"""Schemas of the inventory and of everything that crosses a file boundary."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SYSTEM = T.StructType(
    _strings(
        "hostname", "fqdn", "ip_address", "mac_address", "machine_id", "os", "os_version",
        "os_release", "platform", "architecture", "username", "python_version",
    )
)

TOTALS = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("count", T.LongType()),
            T.StructField("size", T.LongType()),
            T.StructField("size_human", T.StringType()),
        ]
    ),
)

SCAN_METADATA = T.StructType(
    _strings("scan_path", "scan_time", "exported_at")
    + [T.StructField("total_files", T.LongType()), T.StructField("total_size_bytes", T.LongType())]
    + _strings("total_size_human")
    + [
        T.StructField("scan_duration_seconds", T.DoubleType()),
        T.StructField("by_category", TOTALS),
        T.StructField("by_extension", TOTALS),
        T.StructField("errors", T.ArrayType(T.StringType())),
    ]
)

JSON_METADATA = T.StructType(
    [T.StructField("total_files", T.LongType()), T.StructField("total_size", T.LongType()), T.StructField("by_category", TOTALS)]
    + _strings("total_size_human", "scan_time", "exported_at")
    + [
        T.StructField("system", SYSTEM),
        T.StructField("scan_duration_seconds", T.DoubleType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
    ]
)

EXTENSION_TOTALS = T.StructType(
    _strings("extension") + [T.StructField("n_files", T.LongType()), T.StructField("total_size", T.LongType())] + _strings("size_human")
)

REPORT_FILE = T.StructType(
    _strings("path", "filename", "extension", "category")
    + [
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("size_bytes", T.LongType()),
    ]
    + _strings("size_human", "modified")
    + [T.StructField("modified_timestamp", T.DoubleType())]
    + _strings(
        "type", "detection_method", "confidence", "risk_level", "risk_reason", "owner", "group",
        "permissions", "permission_alert", "permission_alert_reason", "hash",
    )
)

CHANGED_FILE = T.StructType(
    _strings("path", "filename")
    + [
        T.StructField("size_bytes", T.LongType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("previous_size", T.LongType()),
    ]
    + _strings("previous_hash", "current_hash")
)

INTEGRITY = T.StructType(
    _strings("status", "message", "previous_report", "previous_time")
    + [
        T.StructField(n, T.ArrayType(CHANGED_FILE))
        for n in ("new_files", "changed_files", "deleted_files")
    ]
    + [
        T.StructField(
            "summary",
            T.StructType([T.StructField(n, T.LongType()) for n in ("new", "changed", "deleted")]),
        )
    ]
)

# A report may arrive in parts, so that no document has to hold all files of a huge scan.
# A plain report is its own only part; report_id and received_at may be left out.
REPORT = T.StructType(
    [
        T.StructField("system", SYSTEM),
        T.StructField("scan_metadata", SCAN_METADATA),
        T.StructField("files", T.ArrayType(REPORT_FILE)),
        T.StructField("integrity", INTEGRITY),
        T.StructField("report_id", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("part_no", T.LongType()),
        T.StructField("n_parts", T.LongType()),
    ]
)

LOG_FILE = T.StructType(
    _strings("action")
    + list(CHANGED_FILE.fields)
)

LOG = T.StructType(
    [T.StructField("timestamp", T.TimestampType())]
    + _strings("scan_path", "report_file", "status", "message", "compared_to", "compared_time")
    + [T.StructField(n, T.LongType()) for n in ("new", "changed", "deleted")]
    + [T.StructField("files", T.ArrayType(LOG_FILE))]
    + _strings("machine_id")
    + [T.StructField("part_no", T.LongType()), T.StructField("n_parts", T.LongType())]
)
