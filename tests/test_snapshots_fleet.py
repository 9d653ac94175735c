"""Snapshot differences, fleet tables, report documents, logs and streams."""

import csv
import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from filecensus import schema
from filecensus.operators import fleet, snapshots
from filecensus.session import work_dir
from filecensus.sinks import reports as sink
from filecensus.sources import reports as source
from filecensus.streaming import ingest

FILE_DDL = (
    "machine_id string, scan_path string, report_id string, path string, filename string, extension string, "
    "category string, categories array<string>, size_bytes bigint, modified_timestamp double, "
    "is_directory boolean, detection_method string, confidence string, risk_level string, risk_reason string, "
    "owner string, `group` string, permissions string, permission_alert string, permission_alert_reason string, hash string"
)
START = dt.datetime(2026, 1, 1, 20, 0)
PICKLE = "Pickle deserialization can execute arbitrary code"


def file(report, path, digest, categories=("data",), risk="none", reason=None, alert=None, size=10):
    machine = report.split("-")[0]
    return (
        machine, "/d", report, path, path.rsplit("/")[-1], ".csv", categories[0], list(categories), size, 1.0, False,
        "extension", "high", risk, reason, "root", "ml", "-rw-rw-rw-", alert, alert and "because", digest,
    )


def scans():
    rows = [file("a-0", f"/d/{i}", f"h{i}") for i in range(30)]
    rows += [file("a-1", f"/d/{i}", f"h{i}" if i % 5 else f"H{i}") for i in range(3, 33)]
    rows += [file("a-2", f"/d/{i}", f"h{i}" if i % 5 else f"H{i}") for i in range(3, 33)]
    rows += [file("b-0", "/d/k", None, ("secret",), "danger", "Secret")]
    rows += [file("b-0", f"/d/p{i:02}", None, ("model", "data"), "danger", PICKLE, "world_writable") for i in range(25)]
    rows += [file("b-0", "/d/e", None, ("source",), "danger", "Possible embedded secret/credential detected")]
    rows += [file("b-1", "/d/k", "new", ("secret",), "danger", "Secret")]
    return rows


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(scans(), FILE_DDL).cache()


@pytest.fixture(scope="module")
def reports(spark, files):
    from filecensus.operators import rollups

    order = F.substring_index("report_id", "-", -1).cast("int")
    received = F.timestamp_seconds(F.lit(int(START.replace(tzinfo=dt.timezone.utc).timestamp())) + order * 7200)
    rows = rollups.summary(files, ["machine_id", "scan_path", "report_id"]).withColumns(
        {
            "received_at": received,
            "scan_time": F.date_format(received, "yyyy-MM-dd'T'HH:mm:ss"),
            "scan_duration": F.lit(1.234),
            "hostname": F.concat(F.lit("host-"), "machine_id"),
            "os": F.when(order == 0, "Linux"),
        }
    )
    for name in fleet.NODE_ATTRIBUTES:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(name))
    return rows.cache()


@pytest.fixture(scope="module")
def sequenced(reports):
    return snapshots.with_previous(reports).cache()


@pytest.fixture(scope="module")
def changes(files, sequenced):
    return snapshots.consecutive_changes(files, sequenced).cache()


def triples(rows):
    return sorted((r.report_id, r.action, r.path) for r in rows.collect())


def expected_changes():
    by = {}
    for row in scans():
        by.setdefault(row[2], {})[row[3]] = row[-1]
    out = []
    for old, new in (("a-0", "a-1"), ("a-1", "a-2"), ("b-0", "b-1")):
        out += [(new, "added", p) for p in by[new].keys() - by[old].keys()]
        out += [(new, "deleted", p) for p in by[old].keys() - by[new].keys()]
        both = by[new].keys() & by[old].keys()
        out += [(new, "modified", p) for p in both if by[new][p] and by[old][p] and by[new][p] != by[old][p]]
    return sorted(out)


def test_consecutive_changes(changes):
    assert triples(changes) == expected_changes()


def test_diff_is_empty_for_equal_and_mirrored_for_swapped(files):
    keys = ["machine_id", "scan_path", "path"]
    one, two = files.filter("report_id = 'a-0'"), files.filter("report_id = 'a-1'")
    assert snapshots.diff(one, one, keys).isEmpty()
    ahead = {(r.path, r.action) for r in snapshots.diff(one, two, keys).collect()}
    back = {(r.path, r.action) for r in snapshots.diff(two, one, keys).collect()}
    swap = {"added": "deleted", "deleted": "added", "modified": "modified"}
    assert {(p, swap[a]) for p, a in ahead} == back
    added = {r.path for r in snapshots.new_paths(one, two, keys).collect()}
    gone = {r.path for r in snapshots.deleted_paths(one, two, keys).collect()}
    assert added == {p for p, a in ahead if a == "added"} and gone == {p for p, a in ahead if a == "deleted"}


def test_previous_report_over_many_days(spark):
    random.seed(3)
    rows = []
    for machine in "xyz":
        for i in range(60):
            moment = START + dt.timedelta(minutes=random.choice([0, 10, 700, 3000]) * i)
            rows.append((machine, "/p" if i % 4 else "/q", f"{machine}{i:03}", moment, f"t{i}"))
    given = spark.createDataFrame(rows, "machine_id string, scan_path string, report_id string, received_at timestamp, scan_time string")
    expected = {}
    for key in {(r[0], r[1]) for r in rows}:
        ordered = sorted((r[3], r[2]) for r in rows if (r[0], r[1]) == key)
        for before, (_, report) in zip([(None, None), *ordered], ordered):
            expected[report] = before[1]
    found = snapshots.with_previous(given).collect()
    assert {r.report_id: r.previous_report_id for r in found} == expected


def test_last_row_per_path_wins(spark):
    given = spark.createDataFrame([("/a", 1, "x"), ("/a", 3, "z"), ("/a", 2, "y"), ("/b", 1, "q")], "path string, n int, v string")
    found = snapshots.last_per_path(given, ["path"], "n").collect()
    assert {r.path: r.v for r in found} == {"/a": "z", "/b": "q"}


def test_log_round_trip(spark, changes, sequenced):
    entries = snapshots.log_entries(changes, sequenced)
    status = {r.report_file: (r.status, r.new, r.changed, r.deleted) for r in entries.collect()}
    assert status["a-0"] == ("baseline", 0, 0, 0) == status["b-0"]
    assert status["a-2"] == ("clean", 0, 0, 0)
    assert status["a-1"] == ("changes_detected", 3, 5, 3)
    for per_line in (1000, 4):
        path = work_dir(spark, "log")
        sink.append_log(sink.log_lines(entries, changes, per_line), path)
        log = source.read_log(spark, path)
        shown = sorted((r.report_file, r.action, r.path) for r in snapshots.log_files(log).collect())
        assert shown == expected_changes()
        assert log.filter("part_no = 0").count() == 5
        assert max(len(r.files) for r in log.collect()) <= (1000 if per_line == 1000 else 20)


def test_alerts(files, reports):
    found = {(r.report_id, r.alert_type): r for r in fleet.alerts(reports, files).collect()}
    assert {k: r.n_files for k, r in found.items()} == {
        ("b-0", "secrets_found"): 1, ("b-0", "deserialization_risk"): 25, ("b-0", "permissions"): 25,
        ("b-0", "embedded_secrets"): 1, ("b-1", "secrets_found"): 1,
    }
    assert found["b-0", "secrets_found"].message == "1 secret/credential file(s) found on host-b"
    assert found["b-0", "embedded_secrets"].severity == "critical"
    listed = fleet.alert_files(files).filter("report_id = 'b-0'").collect()
    assert sum(r.alert_type == "deserialization_risk" for r in listed) == 25
    assert sorted(r.path for r in listed if r.alert_type == "permissions") == [f"/d/p{i:02}" for i in range(25)]


def test_nodes_and_overview(files, reports):
    nodes = {r.machine_id: r for r in fleet.node_registry(reports).collect()}
    assert nodes["a"].report_count == 3 and nodes["a"].latest_files == 30
    assert nodes["a"].os is None and nodes["a"].first_seen == START
    assert nodes["a"].last_seen == START + dt.timedelta(hours=4)
    assert tuple(fleet.fleet_totals(fleet.node_registry(reports)).first()) == (2, 31, 310)
    categories = {r.category: (r.n_files, r.total_size) for r in fleet.fleet_categories(reports).collect()}
    assert categories == {"data": (30, 300), "secret": (1, 10)}
    history = fleet.scan_history(reports, 2, "a").collect()
    assert [r.report_id for r in history] == ["a-2", "a-1"]
    assert fleet.scan_history(reports, 2).count() == 4
    assert fleet.node_with_latest_report(reports, "b").first().report_id == "b-1"


def test_csv_and_json_reports(spark, files, tmp_path):
    one = files.filter("report_id = 'b-0'")
    sink.write_csv(one, str(tmp_path / "csv"))
    lines = [row for part in (tmp_path / "csv").glob("*.csv") for row in csv.DictReader(open(part))]
    assert len(lines) == 27
    assert list(lines[0]) == sink.CSV_COLUMNS + sink.OWNER_COLUMNS
    assert {"model|data", "secret", "source"} == {r["categories"] for r in lines}
    hashed = sink.csv_rows(files.filter("report_id = 'a-0'").withColumn("owner", F.lit(None).cast("string")))
    assert hashed.columns == sink.CSV_COLUMNS + ["hash"]
    sink.write_json_report(one, ["report_id"], str(tmp_path / "json"), {"hostname": "h"}, {"errors": ["e"], "scan_duration": 1.005})
    read = lambda name: [json.loads(x) for p in (tmp_path / "json" / name).glob("*.json") for x in open(p)]
    (meta,) = read("metadata")
    assert meta["system"] == {"hostname": "h"} and meta["errors"] == ["e"] and meta["total_files"] == 27
    assert [r["n_files"] for r in read("extensions") if r["extension"] == ".csv"] == [27]
    assert len(read("files")) == 27 and "hash" not in read("files")[0] and read("files")[0]["owner"] == "root"


def test_reports_without_identity_stay_apart(spark, tmp_path):
    texts = [
        '{"scan_metadata": {}, "files": [{"path": "/a", "filename": "a"}]}', '{"files": [{"path": "/b", "filename": "b"}]}',
        '{"files": [{"path": "/b", "filename": "b"}]}', '{"scan_metadata": {}}', '{"scan_metadata": {"scan_path": "/x"}}', "{broken",
    ]
    for k, text in enumerate(texts):
        (tmp_path / f"{k}.json").write_text(text)
    given = source.read_reports(spark, str(tmp_path), multi_line=False).cache()
    assert given.filter(~source.is_valid()).count() == 2
    ids = [r.report_id for r in source.identified(given.filter(source.is_valid())).collect()]
    assert len(ids) == 4 and len(set(ids)) == 3


def test_unknown_machines_have_no_sequence(spark):
    rows = [(f"r{k}", machine, "/d", f"2026-01-0{k + 1} 00:00:00", None) for k, machine in enumerate(["unknown", "unknown", "m", "m"])]
    reports = spark.createDataFrame(rows, "report_id string, machine_id string, scan_path string, received_at string, scan_time string")
    found = snapshots.with_previous(reports.withColumn("received_at", F.to_timestamp("received_at"))).collect()
    assert {r.report_id: r.previous_report_id for r in found} == {"r0": None, "r1": None, "r2": None, "r3": "r2"}


def parts(sequenced, files, changes, per_part=7):
    return sink.report_parts(sequenced, files, changes, per_part)


def test_report_parts_hold_everything_once(sequenced, files, changes):
    documents = source.identified(parts(sequenced, files, changes)).cache()
    shown = source.report_files(documents)
    assert sorted((r.report_id, r.path) for r in shown.collect()) == sorted((r[2], r[3]) for r in scans())
    kinds = {"new": "added", "modified": "modified", "deleted": "deleted"}
    listed = sorted((r.report_id, kinds[r.change_type], r.file_path) for r in fleet.reported_changes(documents).collect())
    assert listed == expected_changes()
    assert documents.filter("report_id = 'b-1'").first().n_parts > 1
    whole = parts(sequenced, files, changes, 10_000).groupBy("report_id").count().collect()
    assert all(r["count"] == 1 for r in whole)


def check_store(store, reports, files):
    stored = store.read("reports")
    assert sorted(r.report_id for r in stored.collect()) == ["a-0", "a-1", "a-2", "b-0", "b-1"]
    alerts = fleet.alerts(reports, files)
    columns = ["report_id", "alert_type", "severity", "message", "n_files"]
    assert sorted(store.read("alerts").select(*columns).collect()) == sorted(alerts.select(*columns).collect())
    kinds = {"new": "added", "modified": "modified", "deleted": "deleted"}
    found = store.read("computed_changes").collect()
    assert sorted((r.report_id, kinds[r.change_type], r.file_path) for r in found) == expected_changes()


def test_stream_equals_batch_in_one_and_many_batches(spark, sequenced, reports, files, changes):
    documents = parts(sequenced, files, changes).cache()
    together = work_dir(spark, "feed")
    documents.write.json(together)
    store = ingest.FleetStore(spark, work_dir(spark, "store"))
    ingest.run_available(ingest.report_stream(spark, together), store)
    check_store(store, reports, files)

    apart = work_dir(spark, "feed")
    store = ingest.FleetStore(spark, work_dir(spark, "store"))
    late = (F.col("report_id") == "a-1") & (F.col("part_no") == 0)
    early = F.col("report_id").isin("a-0", "b-0", "a-1") & ~late
    for arriving in (early, late, F.col("report_id").isin("a-2", "b-1"), late | early):
        documents.filter(arriving).coalesce(1).write.mode("append").json(apart)
        ingest.run_available(ingest.report_stream(spark, apart), store)
    check_store(store, reports, files)
    counts = ingest.running_alert_counts(spark, store).collect()
    assert {r.severity: r.n_alerts for r in counts} == {"critical": 3, "warning": 2}

    replayed = ingest.incoming(source.read_reports(spark, apart, multi_line=False).drop("report_file")).filter("report_id IN ('a-2', 'b-1')")
    ingest.ingest_batch(store)(replayed.dropDuplicates(ingest.KEY), 2)
    check_store(store, reports, files)
    work = work_dir(spark, "counts")
    for _ in range(2):
        counts = ingest.running_alert_counts(spark, store, work).collect()
        assert {r.severity: r.n_alerts for r in counts} == {"critical": 3, "warning": 2}


def test_alerts_of_a_replayed_batch_are_counted_once(spark, sequenced, reports, files, changes):
    """A batch that runs again after its counts were handed on, and a crash before its commit."""
    documents = ingest.incoming(parts(sequenced, files, changes)).dropDuplicates(ingest.KEY)
    store, work = ingest.FleetStore(spark, work_dir(spark, "store")), work_dir(spark, "counts")
    batches = [documents.filter(F.col("report_id").isin("a-0", "b-0")), documents.filter(F.col("report_id").isin("a-1", "a-2", "b-1"))]
    ingest.ingest_batch(store)(batches[0], 0)
    first = sorted(ingest.running_alert_counts(spark, store, work).collect())
    ingest.ingest_batch(store)(batches[0], 0)
    assert sorted(ingest.running_alert_counts(spark, store, work).collect()) == first
    commit, store.commit = store.commit, lambda batch_id: None
    ingest.ingest_batch(store)(batches[1], 1)
    assert sorted(ingest.running_alert_counts(spark, store, work).collect()) == first
    store.commit = commit
    for _ in range(2):
        ingest.ingest_batch(store)(batches[1], 1)
        counts = ingest.running_alert_counts(spark, store, work).collect()
        assert {r.severity: r.n_alerts for r in counts} == {"critical": 3, "warning": 2}


@pytest.mark.parametrize("order", [(2, 1, 0), (0, 2, 1)])
def test_reports_out_of_order_are_linked_again(spark, sequenced, reports, files, changes, order):
    """Whatever the order of arrival, with replays in every batch, changes and nodes are those of the whole."""
    documents = parts(sequenced, files, changes).cache()
    path, work = work_dir(spark, "feed"), work_dir(spark, "nodes")
    store = ingest.FleetStore(spark, work_dir(spark, "store"), compact_every=2)
    came = F.lit(False)
    for scan in order:
        now = F.col("report_id").endswith(f"-{scan}")
        documents.filter(now | came).write.mode("append").json(path)
        came = came | now
        ingest.run_available(ingest.report_stream(spark, path), store)
        nodes = ingest.running_nodes(spark, path, work)
    check_store(store, reports, files)
    assert sorted(map(tuple, nodes.collect()), key=repr) == sorted(
        map(tuple, fleet.node_registry(sequenced.select(*reports.columns)).select(*nodes.columns).collect()), key=repr
    )


def test_a_batch_reads_no_history(spark):
    """What a batch reads from the store stays the same while the store grows."""

    class Counting(ingest.FleetStore):
        read_files = 0

        def of_batches(self, name, batches, like=None):
            batches = list(batches)
            found = super().of_batches(name, batches, like)
            Counting.read_files += sum(os.path.getsize(f.removeprefix("file://")) for f in (found.inputFiles() if batches else []))
            return found

    store = Counting(spark, work_dir(spark, "store"), compact_every=2)
    run, sizes = ingest.ingest_batch(store), []
    for n in range(6):
        rows = [
            json.dumps({"system": {"machine_id": f"m{m}", "hostname": "h"}, "report_id": f"m{m}-{n}", "received_at": f"2026-01-01T0{n}:00:00Z",
                        "scan_metadata": {"scan_path": "/x"}, "files": [{"path": f"/x/{k}", "filename": "k", "hash": f"{n}{k}"} for k in range(20)]})
            for m in range(5)
        ]
        batch = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", source.with_corrupt(schema.REPORT)).alias("d")).select("d.*")
        Counting.read_files = 0
        run(ingest.incoming(batch).dropDuplicates(ingest.KEY), n)
        sizes.append(Counting.read_files)
    assert store.read("computed_changes").count() == 5 * 5 * 20
    assert max(sizes[4:]) < 1.1 * max(sizes[2:4])


def test_plain_documents_and_rejects(spark, tmp_path):
    plain = {
        "system": {"hostname": "h1", "machine_id": "m1"},
        "scan_metadata": {"scan_path": "/x", "scan_time": "2026-01-01T00:00:00", "total_files": 1, "total_size_bytes": 5,
                          "by_category": {"secret": {"count": 1, "size": 5}}},
        "files": [{"path": "/x/k", "filename": "k", "categories": ["secret"], "size_bytes": 5, "risk_level": "danger"}],
        "integrity": {"status": "changes_detected", "new_files": [{"path": "/x/k", "filename": "k"}]},
    }
    (tmp_path / "scan_1.json").write_text(json.dumps(plain, indent=2))
    (tmp_path / "scan_2.json").write_text("{}")
    (tmp_path / "scan_3.json").write_text("{ not json")
    (tmp_path / "scan_4.json").write_text(json.dumps({"files": [{"path": "/y"}]}, indent=2))
    store = ingest.FleetStore(spark, work_dir(spark, "store"))
    ingest.run_available(ingest.report_stream(spark, str(tmp_path), multi_line=True), store)
    assert sorted(r.machine_id for r in store.read("reports").collect()) == ["m1", "unknown"]
    assert store.read("rejects").count() == 2
    assert [r.file_path for r in store.read("changes").collect()] == ["/x/k"]
    receipts = fleet.receipts(store.read("reports"), store.read("alerts"), store.read("changes")).collect()
    assert {(r.machine_id, r.alerts_generated, r.changes_detected) for r in receipts} == {("m1", 1, 1), ("unknown", 0, 0)}
    documents = source.read_reports(spark, str(tmp_path))
    assert source.latest_report_file(documents).first().report_file == "scan_4.json"


def test_newest_report_is_found_by_name(spark, tmp_path):
    """Older documents are never opened, parts belong together, other files are no reports."""
    for name in ("scan_20260101_000000.json", "scan_20260102_000000.json", "other_20270101.json", "scan_20280101.txt"):
        (tmp_path / name).write_text("not json at all")
    for part in range(2):
        (tmp_path / f"scan_20260103_000000-{part:06}.json").write_text(json.dumps({"files": [{"path": f"/{part}"}]}, indent=1))
    paths = source.newest_report(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["scan_20260103_000000-000000.json", "scan_20260103_000000-000001.json"]
    files = source.report_files(source.identified(source.read_reports(spark, paths)))
    assert sorted(r.path for r in files.collect()) == ["/0", "/1"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "readme.md").write_text("x")
    assert source.newest_report(spark, str(tmp_path / "none")) == []
