"""Scan reports and integrity logs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filecensus import schema


def read_reports(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Report documents, one row each, with the name of their file.

    Reports of one machine are JSON documents over several lines; report parts written by
    this package are JSON lines (``multi_line=False``), which split into many tasks.
    """
    reader = spark.read.schema(with_corrupt(schema.REPORT)).option("multiLine", multi_line)
    found = reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return found.withColumn("report_file", F.col("_metadata.file_name"))


def with_corrupt(struct):
    return type(struct)([*struct.fields, T.StructField("_corrupt_record", T.StringType())])


def latest_report_file(documents: DataFrame, prefix: str = "scan_") -> DataFrame:
    """Name of the newest report file: the greatest of the time-stamped names."""
    names = documents.filter(
        F.col("report_file").startswith(prefix) & F.col("report_file").endswith(".json")
    )
    return names.agg(F.max("report_file").alias("report_file"))


def newest_report(spark: SparkSession, folder: str, prefix: str = "scan_") -> list[str]:
    """Paths of the newest report in a folder: of its documents, those with the greatest time-stamped name.

    A document is a file ``scan_<time>...json`` or a folder of that name with a file inside, as Spark writes it; parts of one
    report end in ``-<six digits>.json``.  Only names are listed, no document is opened, and what the driver gets are
    the parts of one report.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    name = F.regexp_extract("path", rf"/(?:report_file=)?({prefix}[^/]*\.json)(?:/[^/]*)?$", 1)
    stem = F.regexp_replace(name, r"-\d{6}\.json$", ".json")
    reports = listed.select("path", stem.alias("stem")).filter("stem <> ''")
    newest = reports.agg(F.max("stem").alias("stem"))
    return sorted(r["path"] for r in reports.join(newest, "stem").collect())


def read_json_report(spark: SparkSession, path: str, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, metadata and extension totals of a JSON report, with the maps of totals as maps."""
    named = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    extension = T.StructType([*named.fields, *schema.EXTENSION_TOTALS.fields])
    metadata = T.StructType([*named.fields, *schema.JSON_METADATA.fields])
    read = lambda struct, part: spark.read.schema(struct).json(f"{path}/{part}")
    return read(schema.REPORT_FILE, "files"), read(metadata, "metadata"), read(extension, "extensions")


def is_valid() -> Column:
    """A report has some field of scan metadata, or files."""
    said = F.coalesce(F.to_json("scan_metadata"), F.lit("{}")) != "{}"
    return said | (F.size(F.coalesce("files", F.array())) > 0)


def identified(documents: DataFrame) -> DataFrame:
    """Fill what a report may lack: machine, host, id, part number and arrival time.

    The id of a report without one is a digest of the whole document, files included, so a
    replayed document gets the same id again and two different ones never share one.
    """
    unknown = F.lit("unknown")
    said = F.to_json(F.struct("system", "scan_metadata", "files", "part_no", "n_parts"), {"ignoreNullFields": "false"})
    return (
        documents.withColumns(
            {
                "machine_id": F.coalesce("system.machine_id", unknown),
                "hostname": F.coalesce("system.hostname", unknown),
            }
        )
        .withColumn("report_id", F.coalesce("report_id", F.substr(F.sha2(said, 256), F.lit(1), F.lit(16))))
        .withColumns(
            {
                "received_at": F.coalesce("received_at", F.current_timestamp()),
                "part_no": F.coalesce("part_no", F.lit(0)),
                "n_parts": F.coalesce("n_parts", F.lit(1)),
            }
        )
    )


HEADER = [
    "report_id", "machine_id", "hostname", "received_at", "scan_time", "scan_path", "total_files",
    "total_size", "scan_duration", "by_category", "fqdn", "ip_address", "mac_address", "os",
    "os_version", "os_release", "platform", "architecture", "username",
]


def part_headers(documents: DataFrame) -> DataFrame:
    """Report columns of each identified document or part, without its files."""
    meta, system = "scan_metadata.", "system."
    totals = {
        "total_files": F.coalesce(F.col(meta + "total_files"), F.lit(0)),
        "total_size": F.coalesce(F.col(meta + "total_size_bytes"), F.lit(0)),
        "scan_duration": F.coalesce(F.col(meta + "scan_duration_seconds"), F.lit(0.0)),
    }
    columns = []
    for name in HEADER:
        if name in totals:
            columns.append(totals[name].alias(name))
        elif name in ("scan_time", "scan_path", "by_category"):
            columns.append(F.col(meta + name).alias(name))
        elif name in ("report_id", "machine_id", "hostname", "received_at"):
            columns.append(F.col(name))
        else:
            columns.append(F.col(system + name).alias(name))
    return documents.select(*columns, "part_no", "n_parts")


def report_files(documents: DataFrame) -> DataFrame:
    """One row per listed file; unnesting stays inside each document."""
    return documents.select(
        "report_id", "machine_id", F.col("scan_metadata.scan_path").alias("scan_path"), "part_no", F.inline("files")
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An integrity log of JSON lines."""
    return spark.read.schema(schema.LOG).json(path)
