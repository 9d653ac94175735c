"""Column expressions against the Python behaviour they stand for."""

import os
import re
import stat

import pytest
from pyspark.sql import functions as F

from filecensus.functions import modes, paths, sizes, text
from filecensus.operators import rules as R


def column(spark, values, ddl, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "size, shown",
    [
        (0, "0 B"), (512, "512 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"),
        (1024**2, "1.0 MB"), (1024**3, "1.0 GB"), (int(4.5 * 1024**3), "4.5 GB"), (1024**4, "1.0 TB"),
        (1280, "1.2 KB"), (1792, "1.8 KB"), (1024**5, "1.0 PB"), (3 * 1024**6, "3072.0 PB"),
    ],
)
def test_format_size(spark, size, shown):
    assert column(spark, [size, None], "bigint", sizes.format_size) == [shown, "0 B"]


PARSED = {
    "100": 100, "100B": 100, "1K": 1024, "1KB": 1024, "10M": 10 * 1024**2, "10mb": 10 * 1024**2,
    "1.5GB": int(1.5 * 1024**3), "  10 MB  ": 10 * 1024**2, "2T": 2 * 1024**4,
}


def test_parse_size(spark):
    assert column(spark, list(PARSED), "string", sizes.parse_size) == list(PARSED.values())
    assert [sizes.size_option(t) for t in PARSED] == list(PARSED.values())


@pytest.mark.parametrize("bad", ["abc", "10XB", "", "-5K", "1.5.2K"])
def test_parse_size_rejects(spark, bad):
    with pytest.raises(ValueError):
        sizes.size_option(bad)
    with pytest.raises(Exception, match="Invalid size format"):
        column(spark, [bad], "string", sizes.parse_size)
    assert column(spark, [bad], "string", lambda c: sizes.parse_size(c, strict=False)) == [None]


def test_format_timestamp_floors(spark):
    shown = column(spark, [0.0, 1_700_000_000.99], "double", sizes.format_timestamp)
    assert shown == ["1970-01-01 00:00:00", "2023-11-14 22:13:20"]


def test_labels(spark):
    assert column(spark, [".csv", "", None], "string", sizes.extension_label) == [".csv", "[dir]", "[dir]"]
    assert column(spark, ["a" * 64], "string", sizes.short_hash) == ["a" * 12 + "…"]


NAMES = [
    "a.csv", "A.CSV", ".bashrc", "..x", "..x.y", "a.", "a.b.c", "noext", "...", ".a.b", "a b.Tar.Gz",
    "Ünï.PDF", ".env.local", "a..b",
]


def test_extension_and_stem(spark):
    expected = [os.path.splitext(n)[1].lower() or None for n in NAMES]
    assert column(spark, NAMES, "string", paths.extension) == expected
    assert column(spark, NAMES, "string", paths.stem) == [os.path.splitext(n.lower())[0] for n in NAMES]


def test_path_parts(spark):
    given = ["/a/b/c.txt", "/c", "c", "/a/"]
    assert column(spark, given, "string", paths.basename) == [os.path.basename(p) for p in given]
    assert column(spark, given, "string", paths.dirname) == ["/a/b", "/", None, "/a"]
    assert column(spark, ["a/b/c", "x"], "string", paths.ancestors) == [["", "a", "a/b"], [""]]
    assert column(spark, ["a/b/c", "x"], "string", paths.depth) == [2, 0]


def test_mode_string_for_all_modes(spark):
    kinds = [stat.S_IFREG, stat.S_IFDIR, stat.S_IFLNK, stat.S_IFSOCK, stat.S_IFBLK, stat.S_IFCHR, stat.S_IFIFO]
    given = [kind | bits for kind in kinds for bits in range(0o10000)]
    shown = column(spark, given, "int", modes.mode_string)
    assert shown == [stat.filemode(m) for m in given]


SAMPLES = [
    "api_key = abcdefgh12345678", "API-KEY:'ééééééééééééééééé'", "apikey = \"0123456789abcdef",
    "ſecret: 12345678", "PASSWD=longenough", "pwd = short", "bearer: " + "x" * 16, "Access Token: abc",
    "AKIA" + "A" * 16, "akia" + "A" * 16, "ghp_" + "a" * 36, "sk-" + "1" * 20,
    "-----BEGIN\nRSA PRIVATE\tKEY-----", "postgres://u:p@h", "MYSQL://a b@", "mongodb+srv://x@y",
    "model-１２", "nothing to see", "", "passwd\x1c=\x1ffollowing", "acceſſ_token = abcdefghijklmnopqr",
]


def test_unicode_regex_agrees_with_python(spark):
    patterns = [p for _, p in R.SECRET_CONTENT] + [R.SKILL_NAME, R.AGENT_NAME, R.ENV_NAME, R.SECRET_NAME, r"\d+\S[^\s\w]"]
    for pattern in patterns:
        found = column(spark, SAMPLES, "string", lambda c, p=pattern: text.matches(c, p))
        assert found == [bool(re.search(pattern, s)) for s in SAMPLES], pattern


def test_keyword_hits_count_substrings_once(spark):
    given = ["system_prompt", "QLoRA lora lora", "", "nothing"]
    assert column(spark, given, "string", lambda c: text.keyword_hits(c, R.AI_KEYWORDS)) == [2, 2, 0, 0]


def test_decoding_skips_invalid_bytes(spark):
    given = [b"ab\xffc\r\nd\re", "é€".encode(), b"\xc3"]
    expected = [g.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for g in given]
    assert column(spark, given, "binary", text.decode_ignoring_errors) == expected


def test_machine_id(spark):
    import hashlib

    row = spark.range(1).select(text.machine_id(F.lit("aa:bb"), F.lit("host")).alias("m")).first()
    assert row.m == hashlib.sha256(b"aa:bb:host").hexdigest()[:16]
