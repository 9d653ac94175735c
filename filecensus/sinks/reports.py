"""Report exports: JSON, CSV, report parts and the integrity log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecensus import schema
from filecensus.functions import sizes
from filecensus.operators import rollups
from filecensus.operators.lookup import lookup_join

# Column order of the CSV report.
CSV_COLUMNS = [
    "path", "filename", "extension", "category", "categories", "size_bytes", "size_human",
    "modified", "type", "detection_method", "confidence", "risk_level", "risk_reason",
]
OWNER_COLUMNS = ["owner", "group", "permissions"]
ALERT_COLUMNS = ["permission_alert", "permission_alert_reason"]
CHANGE_LISTS = {"added": "new_files", "modified": "changed_files", "deleted": "deleted_files"}
PART_COLUMNS = ["report_id", "received_at", "part_no", "n_parts"]
FILES_PER_PART = 1000


def entry_type(is_directory: Column) -> Column:
    return F.when(is_directory, "directory").otherwise("file")


def _described(files: DataFrame) -> DataFrame:
    present = {f.name for f in files.schema}
    missing = [c for c in [*OWNER_COLUMNS, *ALERT_COLUMNS, "hash"] if c not in present]
    for column in missing:
        files = files.withColumn(column, F.lit(None).cast("string"))
    return files.withColumns(
        {
            "size_human": sizes.format_size(F.col("size_bytes")),
            "modified": sizes.format_timestamp(F.col("modified_timestamp")),
            "type": entry_type(F.col("is_directory")),
        }
    )


def csv_rows(files: DataFrame) -> DataFrame:
    """The CSV report; owner and hash columns only if some row has a value."""
    described = _described(files)
    flags = rollups.optional_columns(described).first()
    columns = list(CSV_COLUMNS)
    columns += OWNER_COLUMNS if flags["has_permissions"] else []
    columns += ["hash"] if flags["has_hashes"] else []
    return described.withColumn("categories", F.array_join("categories", "|")).select(*columns)


def write_csv(files: DataFrame, path: str) -> None:
    csv_rows(files).write.option("header", True).option("escape", '"').csv(path)


def json_files(files: DataFrame, keys: list[str] = []) -> DataFrame:
    """File entries of a JSON report; NULL columns are left out when written.

    Permission columns appear for rows with an owner.  ``keys`` are carried in front.
    """
    has_owner = F.col("owner").isNotNull()
    blank = ("extension", "risk_reason")
    at = CSV_COLUMNS.index("type")
    columns = [*CSV_COLUMNS[:at], "modified_timestamp", *CSV_COLUMNS[at:]]
    return _described(files).select(
        *keys,
        *[F.coalesce(c, F.lit("")).alias(c) if c in blank else F.col(c) for c in columns],
        "owner",
        *[F.when(has_owner, F.col(c)).alias(c) for c in [*OWNER_COLUMNS[1:], *ALERT_COLUMNS]],
        "hash",
    )


def with_size_texts(by_key: Column) -> Column:
    """Add ``size_human`` to every entry of a map of totals."""
    return F.transform_values(
        by_key,
        lambda _, t: F.struct(
            t["count"].alias("count"), t["size"].alias("size"), sizes.format_size(t["size"]).alias("size_human")
        ),
    )


def scan_metadata(files: DataFrame, keys: list[str]) -> DataFrame:
    """One metadata row per scan."""
    return rollups.summary(files, keys).withColumn("total_size_human", sizes.format_size(F.col("total_size")))


def write_json_report(files: DataFrame, keys: list[str], path: str, system: dict | None = None, scan: dict | None = None) -> None:
    """Report of any size: ``files`` as JSON lines, ``metadata`` and ``extensions`` beside it.

    ``system`` (host, versions, ...) and ``scan`` (scan_time, scan_duration, errors) are said of
    every scan in ``metadata``; the duration may be a column of the metadata row.
    """
    said = scan or {}
    duration = said.get("scan_duration", 0.0)
    duration = duration if isinstance(duration, Column) else F.lit(float(duration))
    json_files(files).write.json(f"{path}/files")
    scan_metadata(files, keys).withColumns(
        {
            "system": F.struct(*[F.lit(v).alias(k) for k, v in (system or {"hostname": None}).items()]),
            "scan_time": F.lit(said.get("scan_time")).cast("string"),
            "exported_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            "scan_duration_seconds": sizes.round_half_even(duration, 2),
            "errors": F.array(*map(F.lit, said.get("errors", []))).cast("array<string>"),
        }
    ).write.json(f"{path}/metadata")
    rollups.with_size_text(rollups.by_extension(files, keys)).write.json(f"{path}/extensions")


def write_named_reports(documents: DataFrame, folder: str) -> None:
    """Write report documents (of ``report_parts``) one by one, each in a folder named by time, machine and part.

    The documents are indented JSON over several lines, as a single machine would save them.
    """
    machine = F.coalesce(F.col("system.machine_id"), F.lit("unknown"))
    time = F.date_format("received_at", "yyyyMMdd_HHmmss")
    name = F.format_string("scan_%s_%s-%06d.json", time, machine, "part_no")
    text = F.to_json(F.struct(*documents.columns), {"pretty": "true"})
    documents.select(text.alias("value"), name.alias("report_file")).write.partitionBy("report_file").text(folder)


def report_parts(
    reports: DataFrame,
    files: DataFrame,
    changes: DataFrame | None = None,
    per_part: int = FILES_PER_PART,
) -> DataFrame:
    """Report documents of bounded size, ready for ``write.json``.

    A scan of at most ``per_part`` files is one document in the usual form; a larger one
    comes in parts that repeat its header.  ``changes`` (from ``consecutive_changes``) become
    the integrity lists, in the part their path belongs to.  So no document gathers much
    more than ``per_part`` entries of a list, however large the scan is.
    """
    entry = json_files(files, ["report_id"])
    entry = entry.select(
        "report_id",
        "path",
        F.lit("file").alias("kind"),
        F.struct(*entry.columns[1:]).alias("entry"),
        F.lit(None).cast(schema.CHANGED_FILE).alias("change"),
    )
    if changes is not None:
        change = F.struct(*schema.CHANGED_FILE.fieldNames()).alias("change")
        entry = entry.unionByName(
            changes.select("report_id", "path", F.col("action").alias("kind"), change), allowMissingColumns=True
        )
    counts = entry.groupBy("report_id").agg(F.ceil(F.count("*") / per_part).cast("long").alias("n_parts"))
    headers = _headers(reports).join(counts, "report_id", "left").withColumn(
        "n_parts", F.coalesce("n_parts", F.lit(1).cast("long"))
    )
    numbered = lookup_join(entry, counts, ["report_id"], "inner").withColumn(
        "part_no", F.pmod(F.xxhash64("path"), F.col("n_parts"))
    )
    lists = [F.array_sort(F.collect_list("entry"), _by_path).alias("files")]
    for kind, name in CHANGE_LISTS.items():
        of_kind = F.when(F.col("kind") == kind, F.col("change"))
        lists.append(F.array_sort(F.collect_list(of_kind), _by_path).alias(name))
    parts = numbered.groupBy("report_id", "part_no").agg(*lists)
    slots = headers.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))
    documents = slots.join(parts, ["report_id", "part_no"], "left")
    if changes is None:
        return documents.select("system", "scan_metadata", "files", *PART_COLUMNS)
    any_change = sum((F.size(F.coalesce(n, F.array())) for n in CHANGE_LISTS.values()), F.lit(0)) > 0
    status = (
        F.when(F.col("previous_report_id").isNull(), "no_baseline")
        .when(any_change, "changes_detected")
        .otherwise("clean")
    )
    integrity = F.struct(
        status.alias("status"),
        F.col("previous_report_id").alias("previous_report"),
        "previous_time",
        *CHANGE_LISTS.values(),
    )
    return documents.select(
        "system", "scan_metadata", "files", integrity.alias("integrity"), *PART_COLUMNS
    )


def _headers(reports: DataFrame) -> DataFrame:
    """``system`` and ``scan_metadata`` of each report."""
    identity = [
        F.col(n) if n in reports.columns else F.lit(None).cast("string").alias(n)
        for n in schema.SYSTEM.fieldNames()
    ]
    meta = F.struct(
        "scan_path",
        "scan_time",
        F.col("scan_time").alias("exported_at"),
        "total_files",
        F.col("total_size").alias("total_size_bytes"),
        sizes.format_size(F.col("total_size")).alias("total_size_human"),
        F.bround("scan_duration", 2).alias("scan_duration_seconds"),
        with_size_texts(F.col("by_category")).alias("by_category"),
    )
    sequence = [c for c in ("previous_report_id", "previous_time") if c in reports.columns]
    return reports.select(
        "report_id", "received_at", F.struct(*identity).alias("system"), meta.alias("scan_metadata"), *sequence
    )


def _by_path(a: Column, b: Column) -> Column:
    return F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0)


def log_lines(entries: DataFrame, changes: DataFrame, per_line: int = FILES_PER_PART) -> DataFrame:
    """Integrity log lines with their file lists.

    A scan with at most ``per_line`` changes is one line; more are spread over several lines
    that repeat the entry and its counts.
    """
    total = F.col("new") + F.col("changed") + F.col("deleted")
    headed = entries.withColumn(
        "n_parts", F.greatest(F.ceil(total / per_line), F.lit(1)).cast("long")
    )
    keys = headed.select(F.col("report_file").alias("report_id"), "n_parts")
    numbered = lookup_join(changes, keys, ["report_id"], "inner").withColumn(
        "part_no", F.pmod(F.xxhash64("path"), F.col("n_parts"))
    )
    listed = F.struct(*schema.LOG_FILE.fieldNames())
    lists = numbered.groupBy(F.col("report_id").alias("report_file"), "part_no").agg(
        F.array_sort(F.collect_list(listed), _by_path).alias("files")
    )
    slots = headed.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))
    lines = slots.join(lists, ["report_file", "part_no"], "left")
    empty = F.array().cast(schema.LOG["files"].dataType)
    return lines.withColumn("files", F.coalesce("files", empty)).select(*schema.LOG.fieldNames())


def append_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").json(path)
