"""Walking rules, checkpoint folders, folder hashes, rollups and sort orders."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from filecensus.operators import filters, hashing, lookup, ordering, rollups

PATHS = {
    "a.csv": 1, "sub/b.csv": 2, "sub/deep/c.csv": 4, ".hidden/d.csv": 8, "node_modules/e.js": 16,
    "venv/lib/f.py": 32, "run-01/w.bin": 64, "run-01/.state/g": 128, "run-01/model-best/h.json": 256,
    "sub/Checkpoint_final/i.pt": 512, ".git/run-2/j": 1024, "env.py": 2048, "run-x/k.csv": 4096,
    "sub/.l.csv": 8192, "run-01x/m.csv": 16384,
}


@pytest.fixture(scope="module")
def listing(spark):
    rows = [("m", "/r", f"/r/{p}", p.rsplit("/")[-1], n, False, False) for p, n in PATHS.items()]
    rows.append(("m", "/r", "/r/step-5", "step-5", 4096, True, False))
    rows.append(("m", "/r", "/r/link.csv", "link.csv", 9, False, True))
    return spark.createDataFrame(
        rows, "machine_id string, scan_path string, path string, filename string, size_bytes bigint, "
        "is_directory boolean, is_symlink boolean"
    )


def reached(listing, **options):
    walked = filters.walk(listing, filters.ScanOptions(**options))
    return sorted(r.path[3:] for r in filters.plain_files(walked).collect())


def test_hidden_and_skipped(listing):
    assert reached(listing) == ["a.csv", "env.py", "run-01x/m.csv", "run-x/k.csv", "sub/b.csv", "sub/deep/c.csv"]
    shown = reached(listing, include_hidden=True)
    assert ".hidden/d.csv" in shown and "sub/.l.csv" in shown
    assert ".git/run-2/j" not in shown and "venv/lib/f.py" not in shown


def test_depth_and_links(listing):
    assert reached(listing, max_depth=0) == ["a.csv", "env.py"]
    assert "sub/deep/c.csv" not in reached(listing, max_depth=1)
    assert "link.csv" in reached(listing, follow_symlinks=True)


def test_checkpoint_folders(listing):
    def folders(**options):
        walked = filters.walk(listing, filters.ScanOptions(**options))
        rows = filters.collapse_checkpoints(walked, ["machine_id", "scan_path"]).collect()
        return {r.path: (r.size_bytes, r.n_files, r.filename) for r in rows}

    found = folders()
    assert found == {
        "/r/run-01": (64 + 128 + 256, 3, "run-01"),
        "/r/sub/Checkpoint_final": (512, 1, "Checkpoint_final"),
        "/r/step-5": (0, 0, "step-5"),
    }
    assert sorted(folders(max_depth=0)) == ["/r/run-01", "/r/step-5"]


def test_folder_tree_against_brute_force(listing):
    expected = defaultdict(lambda: [0, 0])
    for path, size in {**PATHS, "link.csv": 9}.items():
        parts = path.split("/")[:-1]
        for n in range(len(parts) + 1):
            expected["/".join(parts[:n])][0] += 1
            expected["/".join(parts[:n])][1] += size
    rows = rollups.folder_sizes(listing, ["machine_id", "scan_path"]).collect()
    assert {r.folder: [r.n_files, r.total_size] for r in rows} == dict(expected)


@pytest.mark.parametrize("batch_rows", [7, 10000])
def test_folder_hashes_stream_through_batches(spark, batch_rows):
    """Folders over many Arrow batches, shared partitions, null keys and files without a hash."""
    rows = [("hot", 1, f"d/{i:03}é", f"{i:064x}") for i in range(300)]
    rows += [("warm", n, f"f{i}", f"{i:064x}") for i in range(30) for n in (1, None)]
    rows += [("cold", 1, "x", "1" * 64), ("cold", 1, "unreadable", None), ("blank", 1, "y", None), (None, 1, "z", "2" * 64)]
    given = spark.createDataFrame(rows, "folder string, no int, rel string, hash string").repartition(5)
    expected = {}
    for key in {r[:2] for r in rows}:
        lines = sorted(f"{r}:{h}" for *k, r, h in rows if tuple(k) == key and h)
        expected[key] = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        found = hashing.folder_hashes(given, ["folder", "no"]).collect()
        assert {(r.folder, r.no): r.folder_hash for r in found} == expected and len(found) == len(expected)
        assert hashing.folder_hashes(given.limit(0), ["folder", "no"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_folder_of_many_lines_hashes_in_one_pass(spark):
    """A folder of 250,000 lines beside small ones, with the corpus operators imported or not."""
    ids = spark.range(250_100)
    folder = F.when(F.col("id") < 250_000, "huge").otherwise(F.col("id").cast("string"))
    lines = ids.select(folder.alias("folder"), F.lpad(F.col("id").cast("string"), 9, "0").alias("rel"), F.md5(F.col("id").cast("string")).alias("hash"))
    found = {r.folder: r.folder_hash for r in hashing.folder_hashes(lines, ["folder"]).collect()}
    whole = hashlib.sha256()
    for i in range(250_000):
        whole.update(("\n" * (i > 0) + f"{i:09}:{hashlib.md5(str(i).encode()).hexdigest()}").encode())
    assert len(found) == 101 and found["huge"] == whole.hexdigest()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_with_hot_and_null_keys(spark, how):
    big = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("k"), "id"
    )
    small = big.filter("k IS NOT NULL AND (k = 'hot' OR id > 1000)").select("k").distinct()
    if how in ("inner", "left"):
        small = small.withColumn("v", F.length("k"))
    known = {r.k for r in small.collect()}
    near = [r.id for r in lookup.lookup_join(big, small, ["k"], how).collect()]
    keep = {"inner": lambda k: k in known, "left_semi": lambda k: k in known, "left": lambda k: True, "left_anti": lambda k: k not in known}[how]
    assert sorted(near) == [r.id for r in big.orderBy("id").collect() if keep(r.k)]


FILES = [
    ("/b", "B.csv", ".csv", ["data"], 10, 3.0, "none", None),
    ("/a", "a.pkl", ".pkl", ["model", "data"], 30, 1.0, "danger", "Pickle deserialization can execute arbitrary code"),
    ("/c", "c.py", ".py", ["source"], 10, 2.0, "danger", "Possible embedded secret/credential detected"),
    ("/d", "run-1", None, ["checkpoint"], 500, 9.0, "none", None),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = spark.createDataFrame(
        FILES, "path string, filename string, extension string, categories array<string>, size_bytes bigint, "
        "modified_timestamp double, risk_level string, risk_reason string"
    )
    return rows.withColumn("category", F.element_at("categories", 1)).withColumn("scan", F.lit(1))


def test_rollups(files):
    by = {r.category: (r.n_files, r.total_size) for r in rollups.by_category(files).collect()}
    assert by == {"data": (2, 40), "model": (1, 30), "source": (1, 10), "checkpoint": (1, 500)}
    first = {r.category: r.n_files for r in rollups.by_primary_category(files).collect()}
    assert sum(first.values()) == len(FILES) and first["model"] == 1
    ext = {r.extension: r.total_size for r in rollups.by_extension(files).collect()}
    assert ext["[dir]"] == 500
    assert tuple(rollups.totals(files).first()) == (4, 550)
    assert tuple(rollups.totals(files.limit(0)).first()) == (0, 0)
    row = rollups.summary(files, ["scan"]).first()
    assert (row.total_files, row.total_size) == (4, 550)
    assert {k: (v["count"], v["size"]) for k, v in row.by_category.items()} == by
    banners = rollups.risk_banners(files).first().asDict()
    assert banners["danger_files"] == 2 and banners["embedded_secret_files"] == 1 and banners["source_files"] == 1


def test_sort_orders(files):
    def order(by):
        return [r.path for r in ordering.sort_files(files, by).collect()]

    assert order("size") == ["/d", "/a", "/b", "/c"] == order("unknown")
    assert order("date") == ["/d", "/b", "/c", "/a"]
    assert order("name") == ["/a", "/b", "/c", "/d"]
    assert order("category") == ["/d", "/b", "/a", "/c"]
    assert [r.path for r in ordering.top_files(files, 2).collect()] == ["/d", "/a"]
    down = ordering.sort_by_column(files, "filename", ascending=False).collect()
    assert [r.path for r in down] == ["/d", "/c", "/b", "/a"]
    top = ordering.top_extensions(files, 2).collect()
    assert [(r.extension, r.bar_percent) for r in top] == [("[dir]", 100.0), (".pkl", 6.0)]


def test_filters(files):
    assert filters.at_least(files, 30).count() == 2
    assert filters.in_categories(files, ["data", "source"]).count() == 3
    assert filters.in_categories(files, []).count() == 4
    assert filters.risky(files).count() == 2
    assert filters.primary_category_over(files, "model", 29).count() == 1
