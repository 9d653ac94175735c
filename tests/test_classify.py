"""Classification, risk, secrets and permissions on literal files."""

import pytest
from pyspark.sql import functions as F

from filecensus.operators import classify as C
from filecensus.operators import permissions as P
from filecensus.operators import rules as R
from filecensus.operators.secrets import flag_embedded_secrets, secret_hits, secret_rule_counts

SCHEMA = "path string, filename string, size_bytes bigint, head string, head_bytes binary, machine_id string"


def files(spark, *entries):
    """Entries are (path, content) or (path, content, size)."""
    rows = []
    for entry in entries:
        path, content = entry[:2]
        raw = content if isinstance(content, bytes) else content.encode()
        size = entry[2] if len(entry) > 2 else len(raw)
        rows.append((path, path.rsplit("/", 1)[-1], size, raw.decode("utf-8", "ignore"), raw, "m"))
    return spark.createDataFrame(rows, SCHEMA)


def classify(spark, *entries, rules=None, listing=False):
    given = files(spark, *entries)
    rows = flag_embedded_secrets(C.classify(given, rules, given if listing else None), rules)
    return {r.path: r for r in rows.collect()}


SQLITE = b"SQLite format 3\0" + b"\xff\xfe\0"
CASES = [
    ("train.csv", "", "data", "extension", "high", "none"),
    ("TRAIN.CSV", "", "data", "extension", "high", "none"),
    ("m.safetensors", "", "model", "extension", "high", "none"),
    ("m.pkl", "", "model,data", "extension", "medium", "danger"),
    ("m.pickle", "", "model,data", "extension", "medium", "danger"),
    ("m.joblib", "", "model,data", "extension", "high", "warning"),
    ("a.index", "", "vector", "extension", "medium", "none"),
    ("n.ipynb", "", "config,source", "extension", "high", "none"),
    ("m.ckpt", "", "model,checkpoint", "extension", "high", "none"),
    ("SKILL.md", "", "skill,document", "filename", "high", "none"),
    ("skill.md", "", "document", "extension", "high", "none"),
    ("system_prompt.md", "", "agent,document", "filename", "high", "none"),
    ("agent_config.yaml", "", "agent,config", "filename", "high", "none"),
    ("goals.py", "", "source", "extension", "high", "none"),
    ("goals.json", "", "agent,config", "filename", "high", "none"),
    ("persona.py", "", "agent,config", "filename", "high", "none"),
    ("AGENTS.md", "", "agent,document", "filename", "high", "none"),
    ("MLmodel", "", "agent,config", "filename", "high", "none"),
    (".cursorrules", "", "agent,config", "filename", "high", "none"),
    ("credentials.json", "", "secret", "filename", "high", "danger"),
    ("id_rsa", "", "secret", "filename", "high", "danger"),
    (".env", "", "secret", "filename", "high", "danger"),
    (".env.prod", "", "secret", "filename", "high", "danger"),
    ("x.pem", "", "secret", "extension", "high", "danger"),
    ("x.token", "", "secret", "extension", "high", "danger"),
    ("config.yaml", "model: a\nlearning_rate: 1\nbatch_size: 2\nepochs: 3", "config", "heuristic", "medium", "none"),
    ("prompt_template.yaml", "system_prompt: your role is a persona", "agent,config", "heuristic", "medium", "none"),
    ("search_agent.yaml", "tool_use function_call actions langchain", "skill,config", "heuristic", "medium", "none"),
    ("scraper_plugin.json", "actions plugin", "skill,config", "heuristic", "medium", "none"),
    ("rules_v2.txt", "you are an assistant", "agent,document", "heuristic", "medium", "none"),
    ("model.bin", b"GGUF" + b"\0" * 9, "model", "heuristic", "medium", "warning"),
    ("ggml.bin", b"ggml", "model", "heuristic", "medium", "warning"),
    ("zip.bin", b"PK\3\4", "model", "heuristic", "medium", "warning"),
    ("v.db", SQLITE + b"EMBEDDING vectors", "vector", "heuristic", "medium", "none"),
    ("u.sqlite3", SQLITE + b"CREATE TABLE users", "data", "heuristic", "medium", "none"),
]
UNCLASSIFIED = [
    ("docker-compose.yaml", "services: nginx ports"),
    ("settings.json", "model training epochs"),
    ("my_agent.yaml", "nothing"),
    ("goal_tracker.yaml", "plain"),
    ("random.bin", b"\0\1\2\3"),
    ("fake.db", b"not a database"),
    ("notes.txt", "you are an assistant"),
    ("Makefile", "all:"),
    ("a.tar.gz", ""),
]


def test_rules_in_order(spark):
    found = classify(spark, *[(f"/{i}/{c[0]}", c[1]) for i, c in enumerate(CASES)])
    for i, (name, _, categories, method, confidence, risk) in enumerate(CASES):
        row = found[f"/{i}/{name}"]
        shown = (",".join(row.categories), row.detection_method, row.confidence, row.risk_level)
        assert shown == (categories, method, confidence, risk), name
        assert row.category == row.categories[0]


def test_no_rule_no_row(spark):
    given = [(f"/{i}/{n}", c) for i, (n, c) in enumerate(UNCLASSIFIED)]
    assert classify(spark, *given) == {}
    kept = C.classify(files(spark, *given), keep_unclassified=True).collect()
    assert len(kept) == len(given) and all(r.rule is None and r.risk_level is None for r in kept)


def test_extensions_shown(spark):
    found = classify(spark, ("/id_rsa", ""), ("/.env", ""), ("/.env.local", ""), ("/SKILL.md", ""), ("/MLmodel", ""))
    shown = {p: r.extension for p, r in found.items()}
    assert shown == {"/id_rsa": "id_rsa", "/.env": ".env", "/.env.local": ".local", "/SKILL.md": ".md", "/MLmodel": None}


def test_large_binary_beside_model_config(spark):
    big = R.LARGE_BINARY_BYTES + 1
    found = classify(
        spark,
        ("/a/w.bin", b"xx", big), ("/a/config.json", ""),
        ("/b/w.bin", b"xx", big), ("/b/other.json", ""),
        ("/c/w.bin", b"xx", big - 1), ("/c/tokenizer.json", ""),
        listing=True,
    )
    assert sorted(found) == ["/a/w.bin"]
    assert found["/a/w.bin"].risk_reason == R.BINARY_REASON


def test_windows_limit_what_is_seen(spark):
    late = "x" * 2048 + " you are an assistant"
    assert classify(spark, ("/rules_v2.txt", late), rules=R.Rules(window=R.FILE_HEADS)) == {}
    assert len(classify(spark, ("/rules_v2.txt", late))) == 1
    secret = "x" * 4096 + " password: abcdefghij"
    seen = classify(spark, ("/a.md", secret), rules=R.Rules(window=R.FILE_HEADS))
    assert seen["/a.md"].risk_level == "none"
    assert classify(spark, ("/a.md", secret))["/a.md"].risk_level == "danger"


def test_embedded_secrets(spark):
    found = classify(
        spark,
        ("/a.py", 'API_KEY = "abcdefghijklmnop1234"'),
        ("/b.py", "print('hello')"),
        ("/c.safetensors", "password = abcdefghijkl"),
        ("/d.pkl", "password = abcdefghijkl"),
        ("/e.md", "-----BEGIN RSA PRIVATE KEY-----"),
        ("/f.txt", "password = abcdefghijkl"),
    )
    risks = {p: (r.risk_level, r.risk_reason) for p, r in found.items()}
    assert risks["/a.py"] == ("danger", R.EMBEDDED_SECRET_REASON) == risks["/e.md"]
    assert risks["/b.py"] == ("none", None) == risks["/c.safetensors"]
    assert risks["/d.pkl"][1].startswith("Pickle")
    assert "/f.txt" not in risks


def test_secret_hits_agree_with_regexes_alone(spark):
    import re

    from tests.test_functions import SAMPLES

    given = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, t string").withColumn("g", F.lit("x"))
    found = sorted((r.i, r.rule_id) for r in secret_hits(given, "t").collect())
    expected = sorted((i, n) for i, s in enumerate(SAMPLES) for n, p in R.SECRET_CONTENT if re.search(p, s))
    assert found == expected
    counts = {r.rule_id: r.n_rows for r in secret_rule_counts(given, "t", "g").collect()}
    assert counts == {n: sum(r == n for _, r in expected) for n, _ in R.SECRET_CONTENT}


def test_overrides(spark):
    with pytest.warns(UserWarning):
        rules = R.Rules().with_overrides(
            {
                "extensions": {"weights": ["model"], ".xml": "config", ".odd": ["nope"]},
                "risks": {".exe": {"level": "danger", "reason": "r"}, ".md": "warning", ".js": "fatal", ".weights": {}},
                "ambiguous": [".csv"],
                "ignore_extensions": [".pkl", "json"],
            }
        )
    found = classify(
        spark, ("/a.weights", ""), ("/b.xml", ""), ("/c.odd", ""), ("/d.exe", ""), ("/e.md", ""), ("/f.csv", ""),
        ("/g.pkl", ""), ("/scraper_plugin.json", "actions plugin"), ("/h.js", ""), rules=rules,
    )
    assert sorted(found) == ["/a.weights", "/b.xml", "/e.md", "/h.js"]
    assert (found["/a.weights"].risk_level, found["/a.weights"].risk_reason) == ("warning", R.DEFAULT_RISK_REASON)
    assert (found["/e.md"].risk_level, found["/e.md"].risk_reason) == ("warning", R.DEFAULT_RISK_REASON)
    assert found["/b.xml"].categories == ["config"]


def test_config_files(tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"extensions": {".sql": ["source"]}}')
    bad.write_text("{")
    assert R.Rules.from_json(str(good)).extensions[".sql"] == ["source"]
    with pytest.warns(UserWarning, match="failed to load"):
        assert R.Rules.from_json(str(bad)) == R.Rules()


ALERTS = [
    ("-rw-rw-rw-", "source", "world_writable"),
    ("-rw-r--r--", "secret", "world_readable"),
    ("-rw-r--r--", "agent", "world_readable"),
    ("-rw-r--r--", "model", None),
    ("-rw-rw----", "model", "group_writable"),
    ("-rw-rw----", "document", None),
    ("-rwxr-x--x", "data", "too_open"),
    ("drwxr-x--x", "checkpoint", None),
    ("-rwxr-x--x", "config,source", None),
    ("-rwxr-x--x", "document", None),
    ("-rwxr-x--T", "data", None),
    ("-rwxr-x--t", "data", "too_open"),
    ("-rw", "secret", None),
    (None, "secret", None),
]


def test_permission_alerts(spark):
    rows = spark.createDataFrame(
        [(i, p, c.split(",")) for i, (p, c, _) in enumerate(ALERTS)], "i int, permissions string, categories array<string>"
    )
    shown = P.add_permission_alerts(rows).orderBy("i").collect()
    assert [r.permission_alert for r in shown] == [a for _, _, a in ALERTS]
    assert shown[1].permission_alert_reason == P.REASONS["world_readable_secret"]
    assert shown[2].permission_alert_reason == P.REASONS["world_readable_agent"]
    counts = {r.permission_alert: r.n_files for r in P.permission_alert_counts(P.add_permission_alerts(rows)).collect()}
    assert counts == {"world_writable": 1, "world_readable": 2, "group_writable": 1, "too_open": 2}
