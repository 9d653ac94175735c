"""Continuous ingestion of machine reports.

Every micro-batch writes folders of its own and overwrites them when it is replayed.  Parts that
came before are dropped by Spark's keyed state before a batch is seen, so what a batch reads is
small: its own rows, the reports still waiting for parts, the last report of each machine
and path, and the file lists of the reports it is compared with.  Only a report that arrives
out of order makes a batch look at the machine's earlier report headers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecensus import schema
from filecensus.operators import fleet, snapshots
from filecensus.operators.lookup import lookup_join
from filecensus.session import work_dir
from filecensus.sources import reports as source

POLL_SECONDS = 30
SEQUENCE = ["machine_id", "scan_path"]
ORDER = ["received_at", "report_id"]
LAST = [*ORDER, "scan_time", *SEQUENCE, "batches"]
KEY = ["report_id", "part_no", "rejected"]


class FleetStore:
    """Append-only parquet tables, one folder per micro-batch.

    ``reports`` are the complete reports, ``rejects`` the documents that are none,
    ``computed_changes`` the differences of each report to the one before it as far as reports are
    known now, and ``alerts``, ``alert_files``, ``files``, ``changes`` what their names say.  ``compact_every`` batches the
    last reports of all machines are written anew; between, only those that changed.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 16):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every

    def table(self, name: str) -> str:
        return f"{self.path}/{name}"

    def folder(self, name: str, batch_id: int) -> str:
        return f"{self.table(name)}/batch_id={batch_id}"

    def write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self.folder(name, batch_id))

    def of_batches(self, name: str, batches: Iterable[int], like: DataFrame | None = None) -> DataFrame:
        """Rows of some batches, whose folders alone are listed and read; none has the columns of ``like``."""
        folders = [self.folder(name, b) for b in sorted(set(batches))]
        if not folders:
            return like.limit(0).withColumn("batch_id", F.lit(0))
        return self.spark.read.option("basePath", self.table(name)).parquet(*folders)

    def read(self, name: str) -> DataFrame:
        if name == "reports":
            return self._all("progress").filter("have >= want").drop("have", "want", "least_part")
        if name == "rejects":
            return self._all("accepted").filter("rejected").select("_raw", "batch_id").withColumnRenamed("_raw", "_corrupt_record")
        if name == "computed_changes":
            linked = self._all("pairs").groupBy("report_id").agg(F.max("batch_id").alias("batch_id"))
            return lookup_join(self._all(name), linked, ["report_id", "batch_id"], "left_semi")
        return self._all(name)

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.table(name))

    def commit(self, batch_id: int) -> None:
        """Say once, for other streams, that a batch is whole; a replay after that says nothing."""
        path = self.folder("commits", batch_id)
        try:
            if not self.spark.read.schema("batch long").json(path).isEmpty():
                return
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
        self.spark.range(1, numPartitions=1).select(F.lit(batch_id).cast("long").alias("batch")).write.mode("overwrite").json(path)


def report_stream(spark: SparkSession, path: str, multi_line: bool = False, max_files: int | None = None) -> DataFrame:
    """Report documents as they arrive in a folder, with unreadable ones marked."""
    reader = (
        spark.readStream.schema(source.with_corrupt(schema.REPORT))
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def incoming(documents: DataFrame) -> DataFrame:
    """Identified documents; those that are no report are marked ``rejected`` and keep their text in ``_raw``."""
    fields = [c for c in documents.columns if c != "_corrupt_record"]
    unread = F.col("_corrupt_record") if "_corrupt_record" in documents.columns else F.lit(None).cast("string")
    raw = F.coalesce(unread, F.to_json(F.struct(*fields)))
    marked = documents.withColumn("rejected", ~source.is_valid()).withColumn("_raw", F.when(F.col("rejected"), raw))
    marked = marked.withColumn("report_id", F.when(F.col("rejected"), F.sha2("_raw", 256)).otherwise(F.col("report_id")))
    return source.identified(marked.drop("_corrupt_record"))


def first_arrivals(stream: DataFrame, forget_after: str | None = None) -> DataFrame:
    """Incoming documents without those that came before, by report and part.

    The keys seen are keyed state of the stream.  They are kept for good, or, with ``forget_after`` (such as "30 days"), until
    reports received that much later have come; a replay after that counts as new.
    """
    found = incoming(stream)
    if forget_after is None:
        return found.dropDuplicates(KEY)
    return found.withWatermark("received_at", forget_after).dropDuplicatesWithinWatermark(KEY)


def ingest_batch(store: FleetStore):
    """Store one micro-batch of first arrivals, then whatever became complete.

    A report is complete once all its parts are stored; only then do its report row,
    alerts and changes appear, so each report yields them once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store.write(batch, "accepted", batch_id)
        accepted = store.of_batches("accepted", [batch_id]).filter("NOT rejected").drop("batch_id")
        _together(
            lambda: store.write(source.report_files(accepted).sortWithinPartitions("report_id"), "files", batch_id),
            lambda: store.write(fleet.reported_changes(accepted), "changes", batch_id),
            lambda: store.write(_progress(store, accepted, batch_id), "progress", batch_id),
        )
        fresh = store.of_batches("progress", [batch_id]).filter("have >= want").drop("batch_id")
        own = _files_of(store, fresh, {batch_id})
        last = _last_reports(store, fresh, batch_id)
        _together(
            lambda: store.write(fleet.alerts(fresh, own), "alerts", batch_id),
            lambda: store.write(fleet.alert_files(own), "alert_files", batch_id),
            lambda: store.write(_linked(store, fresh, last, batch_id), "pairs", batch_id),
            lambda: _write_last(store, fresh, last, batch_id),
        )
        pairs = store.of_batches("pairs", [batch_id]).drop("batch_id")
        before = pairs.select(F.col("previous_report_id").alias("report_id"), F.col("previous_batches").alias("batches"))
        compared = _files_of(store, pairs.select("report_id", "batches").union(before).distinct(), set())
        changes = snapshots.consecutive_changes(compared, pairs)
        store.write(fleet.computed_changes(changes, pairs), "computed_changes", batch_id)
        store.commit(batch_id)

    return run


def _together(*writes: Callable[[], None]) -> None:
    """Run small writes that do not need each other at the same time; the first failure is raised once all have ended."""
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(w) for w in writes]:
            done.result()


def _progress(store: FleetStore, accepted: DataFrame, batch_id: int) -> DataFrame:
    """One row per report that waited for parts or got some: how many it has, and its header.

    What waited stands in the folder of the batch before, so no history is read.
    """
    columns = [c for c in source.HEADER if c != "report_id"]
    arrived = source.part_headers(accepted).select(
        "report_id", *columns, F.array(F.lit(batch_id)).alias("batches"), F.lit(1).cast("long").alias("have"),
        F.col("n_parts").alias("want"), F.col("part_no").alias("least_part"),
    )
    waiting = store.of_batches("progress", range(max(0, batch_id - 1), batch_id), arrived).filter("have < want")
    header = F.max_by(F.struct(*columns), -F.col("least_part")).alias("_h")
    return (
        arrived.unionByName(waiting.select(*arrived.columns))
        .groupBy("report_id")
        .agg(
            header,
            F.array_distinct(F.flatten(F.collect_list("batches"))).alias("batches"),
            F.sum("have").alias("have"),
            F.max("want").alias("want"),
            F.min("least_part").alias("least_part"),
        )
        .select("report_id", "_h.*", "batches", "have", "want", "least_part")
    )


def _known_batches(rows: DataFrame, column: str) -> set[int]:
    """The batches whose folders hold the files of some reports: at most one number per batch."""
    return {r[0] for r in rows.select(F.explode(column)).distinct().collect()}


def _files_of(store: FleetStore, reports: DataFrame, batches: set[int]) -> DataFrame:
    """Files of the given reports; only the folders that hold some are read."""
    batches = batches | _known_batches(reports, "batches")
    if not batches:
        return store.of_batches("files", [], source.report_files(source.identified(_no_documents(store.spark)))).drop("batch_id")
    files = store.of_batches("files", batches)
    spots = reports.select("report_id", F.explode("batches").alias("batch_id"))
    return lookup_join(files, spots, ["report_id", "batch_id"], "left_semi").drop("batch_id")


def _no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema.REPORT)


def _sequenced(reports: DataFrame) -> DataFrame:
    """The columns that place a report in the sequence of its machine and path; unknown machines have none."""
    return reports.filter("machine_id <> 'unknown'").select(*LAST)


def _last_reports(store: FleetStore, fresh: DataFrame, batch_id: int) -> DataFrame:
    """The last report of every machine and path before this batch: the last compaction and what changed since."""
    whole = batch_id - batch_id % store.compact_every  # compacted are the batches before this one
    like = _sequenced(fresh)
    parts = [store.of_batches("last", range(whole, batch_id), like)]
    if whole:
        parts.append(store.of_batches("last_whole", [whole - 1]))
    rows = parts[0].select(*LAST)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*LAST))
    return _newest(rows)


def _newest(rows: DataFrame) -> DataFrame:
    rest = [c for c in LAST if c not in SEQUENCE]
    newest = F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("_r")
    return rows.groupBy(*SEQUENCE).agg(newest).select("_r.*", *SEQUENCE).select(*LAST)


def _same_sequence(left: DataFrame, right: DataFrame):
    return (left["machine_id"] == right["machine_id"]) & left["scan_path"].eqNullSafe(right["scan_path"])


def _linked(store: FleetStore, fresh: DataFrame, last: DataFrame, batch_id: int) -> DataFrame:
    """Pairs of neighbouring reports of which one is fresh.

    A report later than all before it follows the last one known.  Of a machine and path with a report that
    comes late, all headers are put in order again; the pair that the late one parts is linked anew and thereby replaced.
    """
    placed = _sequenced(fresh)
    late = placed.join(
        last.select(*[F.col(c).alias(f"_{c}") for c in [*SEQUENCE, *ORDER]]),
        (F.col("machine_id") == F.col("_machine_id")) & F.col("scan_path").eqNullSafe(F.col("_scan_path"))
        & (F.struct(*ORDER) < F.struct(*[F.col(f"_{c}").alias(c) for c in ORDER])),
    ).select(*SEQUENCE).distinct()
    touched = placed.select(*SEQUENCE).distinct()
    known = last.join(touched, _same_sequence(last, touched), "left_semi")
    if batch_id and not late.isEmpty():
        history = _sequenced(store.of_batches("progress", range(batch_id)).filter("have >= want"))
        known = known.unionByName(history.join(late, _same_sequence(history, late), "left_semi")).dropDuplicates(["report_id"])
    rows = placed.withColumn("fresh", F.lit(True)).unionByName(known.withColumn("fresh", F.lit(False)))
    ordered = snapshots.with_previous(rows, ORDER, ["batches", "fresh"])
    wanted = F.col("previous_report_id").isNotNull() & (F.col("fresh") | F.col("previous_fresh"))
    return ordered.filter(wanted).select(
        "report_id", "previous_report_id", "previous_time", "machine_id", "received_at", "batches", "previous_batches"
    )


def _write_last(store: FleetStore, fresh: DataFrame, last: DataFrame, batch_id: int) -> None:
    placed = _sequenced(fresh)
    touched = placed.select(*SEQUENCE).distinct()
    changed = _newest(placed.unionByName(last.join(touched, _same_sequence(last, touched), "left_semi")))
    store.write(changed, "last", batch_id)
    if batch_id % store.compact_every == store.compact_every - 1:
        store.write(_newest(placed.unionByName(last)), "last_whole", batch_id)


def _ingestion(stream: DataFrame, store: FleetStore, forget_after: str | None):
    return (
        first_arrivals(stream, forget_after)
        .writeStream.foreachBatch(ingest_batch(store))
        .option("checkpointLocation", store.table("_stream"))
    )


def run_available(stream: DataFrame, store: FleetStore, forget_after: str | None = None) -> None:
    """Ingest everything that has arrived and stop."""
    _ingestion(stream, store, forget_after).trigger(availableNow=True).start().awaitTermination()


def run_continuously(stream: DataFrame, store: FleetStore, seconds: int = POLL_SECONDS, forget_after: str | None = None):
    """Keep ingesting; returns the running query."""
    return _ingestion(stream, store, forget_after).trigger(processingTime=f"{seconds} seconds").start()


def node_stream(stream: DataFrame) -> DataFrame:
    """Running node registry: state is one row per machine, and the ids of the reports that were counted.

    A replayed report is not counted again, and a late one changes only what its time lets it.
    """
    valid = incoming(stream).filter(~F.col("rejected") & (F.col("part_no") == 0)).dropDuplicates(["report_id"])
    return fleet.node_registry(source.part_headers(valid))


def running_nodes(spark: SparkSession, path: str, work: str | None = None) -> DataFrame:
    """The registry after everything that has arrived; with the same ``work`` folder it goes on where it stopped."""
    work = work or work_dir(spark, "stream-nodes")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/result/batch_id={batch_id}")

    (
        node_stream(report_stream(spark, path))
        .writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{work}/_stream")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return _last_result(spark, work)


def _last_result(spark: SparkSession, work: str) -> DataFrame:
    results = spark.read.parquet(f"{work}/result")
    newest = results.agg(F.max("batch_id").alias("batch_id")).scalar()
    return results.filter(F.col("batch_id") == newest).drop("batch_id")


def count_alerts(store: FleetStore, work: str):
    """Add the alerts of newly committed batches to the counts so far."""

    def run(commits: DataFrame, batch_id: int) -> None:
        fresh = [r["batch"] for r in commits.select("batch").distinct().collect()]
        counts = fleet.alert_severity(store.of_batches("alerts", fresh, store.read("alerts")))
        if batch_id:
            counts = counts.unionByName(store.spark.read.parquet(f"{work}/result/batch_id={batch_id - 1}"))
        total = counts.groupBy("severity").agg(F.sum("n_alerts").alias("n_alerts"))
        total.write.mode("overwrite").parquet(f"{work}/result/batch_id={batch_id}")

    return run


def running_alert_counts(spark: SparkSession, store: FleetStore, work: str | None = None) -> DataFrame:
    """Alerts by severity over all committed batches.

    The stream reads the log of commits, in which every batch stands once, and not the alerts' folders, whose files a
    replay replaces; so each batch is counted once however often it ran.  With the same ``work`` folder it goes on.
    """
    work = work or work_dir(spark, "stream-alerts")
    commits = spark.readStream.schema("batch long").json(f"{store.table('commits')}/*")
    (
        commits.writeStream.foreachBatch(count_alerts(store, work))
        .option("checkpointLocation", f"{work}/_stream")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return _last_result(spark, work)
