"""Scanning real folders."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from filecensus.operators import rules as R
from filecensus.operators.filters import ScanOptions
from filecensus.sources import filetree

TREE = {
    "train.csv": b"1234",
    "big.parquet": b"x" * 10000,
    "w.safetensors": b"password = abcdefghijkl",
    "app.py": b"API_KEY = 'abcdefghijklmnop1234'\n",
    "conf/config.yaml": b"model: a\r\nepochs: 3\r\n",
    "conf/other.yaml": b"services: nginx",
    "conf/vec.db": b"SQLite format 3\0\xff\xfe EMBEDDING",
    "conf/gguf.bin": b"GGUF\0\0",
    "conf/rules_v2.txt": b"\xffyou are an assistant",
    "conf/late_rules.txt": b"x" * 3000 + b"you are an assistant",
    "deep/er/still/m.onnx": b"1",
    ".hidden/h.parquet": b"22",
    "node_modules/x.js": b"1",
    "runs/checkpoint-10/model.bin": b"z" * 1024,
    "runs/checkpoint-10/.tmp/state": b"y" * 10,
    "runs/checkpoint-10/node_modules/dep.js": b"w" * 5,
    "runs/step_5/run-1/a": b"1",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for name, content in TREE.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    os.chmod(base / "train.csv", 0o666)
    os.symlink(base / "train.csv", base / "link.csv")
    os.symlink(base / "conf", base / "linked")
    os.symlink(base, base / "conf" / "cycle")
    os.symlink(base / "gone", base / "broken.csv")
    (base / "runs" / "epoch-1").mkdir()
    return str(base)


def scan(spark, root, **options):
    found, errors = filetree.scan(spark, root, ScanOptions(**options), tasks=4)
    return {r.path[len(root) + 1 :]: r for r in found.collect()}, errors.collect()


DEFAULT = [
    "app.py", "big.parquet", "conf/config.yaml", "conf/gguf.bin", "conf/late_rules.txt", "conf/rules_v2.txt", "conf/vec.db",
    "deep/er/still/m.onnx", "runs/checkpoint-10", "runs/epoch-1", "runs/step_5", "train.csv", "w.safetensors",
]


def test_scan_with_hashes_and_permissions(spark, root):
    rows, errors = scan(spark, root, compute_hashes=True, compute_permissions=True)
    assert sorted(rows) == DEFAULT and errors == []
    for name, row in rows.items():
        if not row.is_directory:
            assert row.hash == hashlib.sha256(TREE[name]).hexdigest()
            assert row.size_bytes == len(TREE[name])
    folder = rows["runs/checkpoint-10"]
    assert folder.size_bytes == 1024 + 10 + 5 and folder.categories == ["checkpoint"]
    lines = sorted(
        f"{n[len('runs/checkpoint-10/'):]}:{hashlib.sha256(c).hexdigest()}"
        for n, c in TREE.items() if n.startswith("runs/checkpoint-10/")
    )
    assert folder.hash == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert rows["runs/epoch-1"].hash == hashlib.sha256(b"").hexdigest()
    assert rows["train.csv"].permission_alert == "world_writable"
    assert rows["train.csv"].permissions == "-rw-rw-rw-" and folder.permissions.startswith("d")
    assert rows["app.py"].risk_reason == R.EMBEDDED_SECRET_REASON
    assert rows["w.safetensors"].risk_level == "none"
    assert rows["conf/vec.db"].categories == ["vector"]


def test_options(spark, root):
    rows, _ = scan(spark, root, include_hidden=True, max_depth=1)
    assert ".hidden/h.parquet" in rows and "deep/er/still/m.onnx" not in rows
    assert "runs/checkpoint-10" in rows and "owner" not in rows["train.csv"].asDict()
    rows, _ = scan(spark, root, min_size_bytes=1000, categories=("data", "checkpoint"))
    assert sorted(rows) == ["big.parquet", "runs/checkpoint-10"]


def test_linked_folders_end_in_no_cycle(spark, tmp_path):
    (tmp_path / "zdir" / "sub").mkdir(parents=True)
    (tmp_path / "zdir" / "a.csv").write_text("x")
    for link, target in (("alink", "zdir"), ("blink", "zdir"), ("zdir/sub/up", "."), ("zdir/self", "zdir")):
        (tmp_path / link).symlink_to(tmp_path / target, target_is_directory=True)
    rows, errors = scan(spark, str(tmp_path), follow_symlinks=True)
    assert sorted(rows) == ["alink/a.csv", "blink/a.csv", "zdir/a.csv"] and errors == []


def test_links_across_the_root_and_into_each_other(spark, tmp_path):
    """A link out of the tree, back over its root, two folders that link to each other, and one folder linked twice."""
    outside, root = tmp_path / "outside", tmp_path / "root"
    for folder in (outside / "data", root / "one", root / "two"):
        folder.mkdir(parents=True)
    (outside / "data" / "o.csv").write_text("x")
    (root / "r.csv").write_text("x")
    (root / "one" / "1.csv").write_text("x")
    for link, target in (("out", outside), ("one/to_two", root / "two"), ("two/to_one", root / "one"), ("one/up", tmp_path)):
        (root / link).symlink_to(target, target_is_directory=True)
    rows, errors = scan(spark, str(root), follow_symlinks=True)
    found = {p.rsplit("/", 1)[0] if "/" in p else "" for p in rows}
    assert found == {"", "one", "out/data", "two/to_one", "one/up/outside/data", "two/to_one/up/outside/data"} and errors == []
    assert sorted(scan(spark, str(root))[0]) == ["one/1.csv", "r.csv"]


def test_a_folder_of_many_entries_is_dealt_to_tasks(spark, tmp_path):
    """One folder of 100,000 entries is listed in shares, each name once."""
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "in").mkdir()
    for k in range(100_000):
        (tmp_path / "many" / f"{k:06}.csv").touch()
    listed = filetree.list_tree(spark, str(tmp_path), tasks=8, share_bytes=1 << 18)
    assert listed.filter("is_file").select("filename").distinct().count() == listed.filter("is_file").count() == 100_000
    per_file = listed.filter("is_file").groupBy(F.input_file_name()).count().collect()
    assert len(per_file) >= 4 and max(r["count"] for r in per_file) < 60_000


def test_files_are_opened_only_for_the_columns_asked_for(spark, root):
    found, _ = filetree.scan(spark, root, ScanOptions(compute_hashes=True, compute_permissions=True), tasks=4)

    def plan(*columns):
        return found.select(*columns)._jdf.queryExecution().optimizedPlan().toString()

    assert "file_hash" not in plan("path", "category", "size_bytes") and "file_access" not in plan("path", "category", "size_bytes")
    assert "file_hash" in plan("path", "hash") and "file_access" not in plan("path", "hash")
    assert "file_access" in plan("path", "permission_alert") and "file_hash" not in plan("path", "permission_alert")


def test_errors_do_not_stop_a_scan(spark, tmp_path):
    rows, errors = scan(spark, str(tmp_path / "missing"))
    assert rows == {} and errors[0].error.startswith("OS error scanning")


def test_heads_can_be_enough(spark, root):
    found, _ = filetree.scan(spark, root, rules=R.Rules(window=R.FILE_HEADS), tasks=4)
    paths = [r.path[len(root) + 1 :] for r in found.collect()]
    assert sorted(paths) == [p for p in DEFAULT if p != "conf/late_rules.txt"]


def test_findings_far_into_long_files(spark, tmp_path):
    """A secret across a chunk edge behind 10 MB, keywords in different chunks, characters cut by an edge."""
    secret = b"API_KEY = 'abcdefghijklmnop1234'\n"
    chunk = 1 << 20
    (tmp_path / "late.py").write_bytes(b"#" * (11 * chunk - 12) + secret + b"x" * chunk)
    (tmp_path / "clean.py").write_bytes(b"#" * (11 * chunk) + b"api_key = short\n")
    (tmp_path / "long_rules.txt").write_bytes(b"You are one\n" + "é".encode() * (3 * chunk) + b"an assistant")
    (tmp_path / "one_rule.txt").write_bytes(b"you are one\n" + "é".encode() * chunk + b"you are one")
    (tmp_path / "far.db").write_bytes(b"SQLite format 3\0" + b"\xff" * (2 * chunk - 20) + b"EMBEDDING")
    rows, _ = scan(spark, str(tmp_path))
    assert rows["late.py"].risk_reason == R.EMBEDDED_SECRET_REASON and rows["clean.py"].risk_level == "none"
    assert rows["long_rules.txt"].categories == ["agent", "document"] and "one_rule.txt" not in rows
    assert rows["far.db"].categories == ["vector"]


@pytest.mark.parametrize("span, chunk, overlap", [(64, 16, 40), (1 << 20, 100, 64), (10_000, 1000, 64)])
def test_ranges_and_chunks_find_what_whole_files_hold(spark, tmp_path, span, chunk, overlap):
    """Files cut into ranges and chunks at every place give the findings of the whole text."""
    from filecensus.operators import classify as C
    from filecensus.operators import contents
    from filecensus.operators.secrets import any_rule

    key = b"\xc3\xa9\xffpassword: hunter2hunter2\r\nEPOCHS"
    for at in range(0, 90, 3):
        (tmp_path / f"{at:02}.yaml").write_bytes("ü".encode() * at + key + b"-" * 70 + b"SQLite format 3 " * (at % 2) + b" lora")
    (tmp_path / "empty.yaml").write_bytes(b"")
    rules = R.Rules()
    files = sorted(tmp_path.iterdir())
    listed = spark.createDataFrame(
        [(str(p), p.stat().st_size, True, True) for p in files] + [(str(tmp_path / "gone"), 5, True, True)],
        "path string, total_bytes long, needs_text boolean, needs_bytes boolean",
    )
    found = filetree.content_facts(listed, rules, 4, span, chunk, overlap)
    tests = {**contents.tests(), "secret": found["secret_text"]}
    got = {r.path: r.asDict() for r in found.select("path", *[t.alias(n) for n, t in tests.items()]).collect()}
    whole = spark.createDataFrame(
        [(str(p), p.read_bytes().decode("utf-8", "ignore").replace("\r\n", "\n"), p.read_bytes()) for p in files],
        "path string, head string, head_bytes binary",
    )
    wanted = {**C.head_tests(rules.window), "secret": any_rule(whole["head"], rules)}
    want = {r.path: r.asDict() for r in whole.select("path", *[t.alias(n) for n, t in wanted.items()]).collect()}
    assert got == want


def test_tree_as_a_data_source(spark, root, tmp_path):
    """All entries in parts of any number, errors beside them, a huge folder in shares, links that lead back."""
    from filecensus.sources import treesource

    treesource.register(spark)
    expected = {p for folder, inner, names in os.walk(root) for p in (os.path.join(folder, n) for n in inner + names)}
    for partitions in (1, 3, 200):
        found = spark.read.format("filetree").option("partitions", partitions).load(root)
        rows = found.collect()
        assert {r.path for r in rows} == expected and len(rows) == len(expected)
        assert {r.path for r in rows if r.is_file} == {p for p in expected if os.path.isfile(p) and not os.path.islink(p)}
    followed = spark.read.format("filetree").option("follow_symlinks", True).load(root)
    files = {r.path[len(root) + 1 :] for r in followed.filter("is_file").collect()}
    assert {"linked/config.yaml", "link.csv"} <= files and not any("cycle" in f for f in files)
    missing = spark.read.format("filetree").load(str(tmp_path / "gone"))
    assert [r.error.startswith("OS error scanning") for r in missing.collect()] == [True]
    (tmp_path / "many").mkdir()
    for k in range(20_000):
        (tmp_path / "many" / f"{k:05}.csv").touch()
    dealt = spark.read.format("filetree").option("partitions", 8).option("share_bytes", 1 << 17).load(str(tmp_path))
    per_task = dealt.filter("is_file").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 20_000 and len(per_task) >= 3
