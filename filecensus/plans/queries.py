"""Registered queries over the driver tables, each beside its SQL counterpart."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecensus import schema
from filecensus.functions import sizes, text
from filecensus.operators import classify as C
from filecensus.operators import contents, filters, fleet, hashing, ordering, rollups, snapshots
from filecensus.operators import rules as R
from filecensus.operators import secrets as S
from filecensus.operators.lookup import lookup_join
from filecensus.plans import demo, oracle
from filecensus.session import work_dir
from filecensus.sinks import reports as sink
from filecensus.sources import reports as source
from filecensus.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

INV = oracle.inventory()
SCANS = oracle.SCANS
FILE_KEYS = ["machine_id", "path"]


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table that later steps read more than once."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(demo.scan_files(spark, sf_dir), "scans")


def time_text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# --- rollups ---------------------------------------------------------------------------


@query(
    INV + "SELECT category, COUNT(*) AS n_files, CAST(SUM(size_bytes) AS BIGINT) AS total_size FROM "
    "(SELECT size_bytes, unnest(string_split(categories, '|')) AS category FROM inv) GROUP BY category"
)
def category_rollup(spark, sf_dir):
    return rollups.by_category(demo.inventory(spark, sf_dir))


@query(
    INV + "SELECT COALESCE(extension, '[dir]') AS extension, COUNT(*) AS n_files, "
    "CAST(SUM(size_bytes) AS BIGINT) AS total_size FROM inv GROUP BY 1"
)
def extension_rollup(spark, sf_dir):
    return rollups.by_extension(demo.inventory(spark, sf_dir))


@query(
    INV + "SELECT category, COUNT(*) AS n_files, CAST(SUM(size_bytes) AS BIGINT) AS total_size FROM inv GROUP BY category"
)
def primary_category_rollup(spark, sf_dir):
    return rollups.by_primary_category(demo.inventory(spark, sf_dir))


@query(INV + "SELECT COUNT(*) AS total_files, CAST(SUM(size_bytes) AS BIGINT) AS total_size FROM inv")
def scan_totals(spark, sf_dir):
    return rollups.totals(demo.inventory(spark, sf_dir))


@query(
    INV + f"SELECT category, n_files, total_size, {oracle.size_text('total_size')} AS size_human FROM ("
    "SELECT category, COUNT(*) AS n_files, CAST(SUM(size_bytes) AS BIGINT) AS total_size FROM "
    "(SELECT size_bytes, unnest(string_split(categories, '|')) AS category FROM inv) GROUP BY category)"
)
def rollup_report(spark, sf_dir):
    return rollups.with_size_text(rollups.by_category(demo.inventory(spark, sf_dir)))


@query(
    INV + "SELECT machine_id, total_files, total_size, category, n_files, category_size FROM "
    "(SELECT machine_id, COUNT(*) AS total_files, CAST(SUM(size_bytes) AS BIGINT) AS total_size FROM inv GROUP BY machine_id) "
    "JOIN (SELECT machine_id, category, COUNT(*) AS n_files, CAST(SUM(size_bytes) AS BIGINT) AS category_size FROM "
    "(SELECT machine_id, size_bytes, unnest(string_split(categories, '|')) AS category FROM inv) GROUP BY ALL) USING (machine_id)"
)
def scan_summary(spark, sf_dir):
    rows = rollups.summary(demo.inventory(spark, sf_dir), ["machine_id"])
    return rows.select(
        "machine_id", "total_files", "total_size", F.explode("by_category").alias("category", "t")
    ).select(
        "machine_id", "total_files", "total_size", "category",
        F.col("t.count").alias("n_files"), F.col("t.size").alias("category_size"),
    )


@query(INV + "SELECT confidence, COUNT(*) AS n_files FROM inv GROUP BY confidence")
def confidence_mix(spark, sf_dir):
    return rollups.by_column(demo.inventory(spark, sf_dir), "confidence")


@query(INV + "SELECT detection_method, COUNT(*) AS n_files FROM inv GROUP BY detection_method")
def method_mix(spark, sf_dir):
    return rollups.by_column(demo.inventory(spark, sf_dir), "detection_method")


@query(
    INV + "SELECT machine_id, COALESCE(folder, '') AS folder, COUNT(*) AS n_files, CAST(SUM(size_bytes) AS BIGINT) AS total_size FROM ("
    "SELECT machine_id, size_bytes, unnest(list_transform(range(0, len(string_split(substr(path, 7), '/'))), "
    "lambda n: array_to_string(string_split(substr(path, 7), '/')[1:n], '/'))) AS folder FROM inv) GROUP BY ALL"
)
def tree_rollup(spark, sf_dir):
    return rollups.folder_tree(demo.inventory(spark, sf_dir), ["machine_id", "scan_path"]).drop("scan_path")


@query(
    INV + "SELECT machine_id, COALESCE(folder, '') AS folder, COUNT(*) AS n_files, CAST(SUM(size_bytes) AS BIGINT) AS total_size FROM ("
    "SELECT machine_id, size_bytes, unnest(list_transform(range(0, len(string_split(rel, '/'))), "
    "lambda n: array_to_string(string_split(rel, '/')[1:n], '/'))) AS folder FROM listing) GROUP BY ALL"
)
def dir_sizes(spark, sf_dir):
    return rollups.folder_sizes(demo.listing(spark, sf_dir), ["machine_id", "scan_path"]).drop("scan_path")


@query(
    INV + "SELECT COUNT(*) FILTER (WHERE risk_level = 'danger') AS danger_files, "
    "COUNT(*) FILTER (WHERE risk_level = 'warning') AS warning_files, "
    f"COUNT(*) FILTER (WHERE {oracle.overlaps('categories', ['source'])}) AS source_files, "
    f"COUNT(*) FILTER (WHERE {oracle.overlaps('categories', ['skill'])}) AS skill_files, "
    f"COUNT(*) FILTER (WHERE {oracle.overlaps('categories', ['secret'])}) AS secret_files, "
    f"COUNT(*) FILTER (WHERE risk_level = 'danger' AND NOT {oracle.overlaps('categories', ['secret'])} "
    "AND contains(risk_reason, 'embedded secret')) AS embedded_secret_files FROM inv"
)
def risk_banners(spark, sf_dir):
    return rollups.risk_banners(demo.inventory(spark, sf_dir))


THRESHOLDS = ["512", "1K", "2.5KB", " 10 kb ", "1MB", "0.5GB"]


@query(
    "SELECT threshold, COUNT(d.doc_id) AS n_files FROM (VALUES "
    + ", ".join(f"('{t}', {sizes.size_option(t)})" for t in THRESHOLDS)
    + ") AS t(threshold, bytes) LEFT JOIN documents d ON strlen(d.text) >= t.bytes GROUP BY threshold"
)
def size_threshold_counts(spark, sf_dir):
    docs = demo.table(spark, sf_dir, "documents").select(F.octet_length("text").alias("size_bytes"))
    return rollups.size_thresholds(docs, "size_bytes", THRESHOLDS)


@query(
    f"SELECT size_human, COUNT(*) AS n_files, MIN(parsed) AS parsed FROM (SELECT size_human, "
    "CAST(floor(CAST(split_part(size_human, ' ', 1) AS DOUBLE) * CASE split_part(size_human, ' ', 2) "
    "WHEN 'B' THEN 1 WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 END) AS BIGINT) AS parsed FROM "
    f"(SELECT {oracle.size_text('strlen(text)')} AS size_human FROM documents)) GROUP BY size_human"
)
def size_texts(spark, sf_dir):
    docs = demo.table(spark, sf_dir, "documents").select(F.octet_length("text").cast("long").alias("n"))
    texts = docs.select(sizes.format_size(F.col("n")).alias("size_human"))
    parsed = F.min(sizes.parse_size(F.col("size_human"), strict=False)).alias("parsed")
    return texts.groupBy("size_human").agg(F.count("*").alias("n_files"), parsed)


# --- classification, risk, secrets, permissions ------------------------------------------


@query(
    INV + "SELECT machine_id, path, filename, extension, categories, category, rule, detection_method, confidence, "
    "risk_level, risk_reason, CAST(size_bytes AS BIGINT) AS size_bytes, CASE is_dir WHEN 1 THEN 'directory' ELSE 'file' END AS type FROM inv"
)
def classify_files(spark, sf_dir):
    return demo.inventory(spark, sf_dir).select(
        "machine_id", "path", "filename", "extension", F.array_join("categories", "|").alias("categories"),
        "category", "rule", "detection_method", "confidence", "risk_level", "risk_reason",
        "size_bytes", sink.entry_type(F.col("is_directory")).alias("type"),
    )


@query(INV + "SELECT machine_id, path FROM files WHERE rule IS NULL")
def unclassified_files(spark, sf_dir):
    files = filters.plain_files(filters.walk(demo.contents(spark, sf_dir)))
    return C.classify(files, listing=demo.listing(spark, sf_dir), keep_unclassified=True).filter("rule IS NULL").select(*FILE_KEYS)


@query(INV + "SELECT machine_id, path, risk_level, risk_reason FROM inv WHERE risk_level IN ('danger', 'warning')")
def risk_map(spark, sf_dir):
    return filters.risky(demo.inventory(spark, sf_dir)).select(*FILE_KEYS, "risk_level", "risk_reason")


@query(INV + "SELECT machine_id, path, categories FROM files WHERE embedded")
def embedded_secrets(spark, sf_dir):
    rows = demo.inventory(spark, sf_dir).filter(F.startswith("risk_reason", F.lit("Possible embedded")))
    return rows.select(*FILE_KEYS, F.array_join("categories", "|").alias("categories"))


SECRET_RULES = R.Rules().with_secrets(oracle.TOKEN_RULE)
_TEXTS = (
    "(SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL "
    "SELECT 'conversations', conv_id, text FROM conversations UNION ALL SELECT 'pages', page_id, html FROM pages)"
)


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("documents", "doc_id", "text"), ("conversations", "conv_id", "text"), ("pages", "page_id", "html")]
    frames = [
        demo.content_table(spark, sf_dir, name).select(
            F.lit(name).alias("origin"), F.col(ident).alias("id"), F.col(body).alias("text")
        )
        for name, ident, body in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "SELECT origin, rule_id, n_rows FROM ("
    + " UNION ALL ".join(
        f"SELECT origin, '{name}' AS rule_id, COUNT(*) FILTER (WHERE regexp_matches(text, {oracle.rx(regex)})) AS n_rows "
        f"FROM {_TEXTS} GROUP BY origin"
        for name, regex in SECRET_RULES.secrets
    )
    + ")"
)
def secret_rule_hits(spark, sf_dir):
    return S.secret_rule_counts(all_texts(spark, sf_dir), "text", "origin", SECRET_RULES)


@query(
    f"WITH {oracle.LISTING} "
    + " UNION ALL ".join(
        f"SELECT machine_id, path, '{name}' AS rule_id FROM listing WHERE regexp_matches(head, {oracle.rx(regex)})"
        for name, regex in SECRET_RULES.secrets
    )
)
def secret_findings(spark, sf_dir):
    rows = demo.contents(spark, sf_dir).select("machine_id", "path", "head")
    return S.secret_hits(rows, "head", SECRET_RULES)


@query(
    INV + f"SELECT machine_id, path, {oracle.PERMISSIONS} AS permissions, permission_alert, permission_alert_reason "
    "FROM files WHERE rule IS NOT NULL AND permission_alert IS NOT NULL"
)
def permission_alerts(spark, sf_dir):
    rows = filters.with_permission_issues(demo.classified(spark, sf_dir))
    return rows.select(*FILE_KEYS, "permissions", "permission_alert", "permission_alert_reason")


@query(
    INV + "SELECT permission_alert, COUNT(*) AS n_files FROM files WHERE rule IS NOT NULL AND permission_alert IS NOT NULL GROUP BY 1"
)
def permission_alert_counts(spark, sf_dir):
    from filecensus.operators.permissions import permission_alert_counts as counts

    return counts(demo.classified(spark, sf_dir))


OVERRIDES = {
    "extensions": {"md": "config", ".gz": ["data"], ".xyz": ["nonsense"], ".txt": ["document"]},
    "risks": {".go": {"level": "warning", "reason": "Review before use"}, ".js": "danger", ".sh": "fatal"},
    "ambiguous": [".csv"],
    "ignore_extensions": [".pkl", "png", ".json"],
}
_OVERRIDDEN = [
    (
        {".md": (e, "config", *rest), ".go": (e, c, a, f, "warning", "Review before use"),
         ".js": (e, c, a, f, "danger", "Custom risk rule"), ".csv": (e, c, 1, f, lv, rs)}.get(e, (e, c, *rest))
    )
    for e, c, *rest in oracle._EXT_ROWS
    for a, f, lv, rs in [rest]
    if e not in (".pkl", ".png", ".json")
] + [(".gz", "data", 0, "high", None, None), (".txt", "document", 0, "high", None, None)]


@query(
    oracle.inventory(rules=oracle.ext_table(_OVERRIDDEN))
    + "SELECT machine_id, path, categories, detection_method, risk_level, risk_reason FROM files WHERE rule IS NOT NULL"
)
def rule_override(spark, sf_dir):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rules = R.Rules().with_overrides(OVERRIDES)
    files = filters.plain_files(filters.walk(demo.contents(spark, sf_dir)))
    rows = S.flag_embedded_secrets(C.classify(files, rules, demo.listing(spark, sf_dir)), rules)
    return rows.select(
        *FILE_KEYS, F.array_join("categories", "|").alias("categories"), "detection_method", "risk_level", "risk_reason"
    )


@query(
    f"WITH {oracle.LISTING} SELECT file_id, {oracle.PERMISSIONS} AS permissions, "
    "strftime(to_timestamp(modified_timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS modified, "
    f"filename, {oracle.EXT.format('filename')} AS extension, {oracle.STEM.format('filename')} AS stem, "
    "regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, length(rel) - length(replace(rel, '/', '')) AS depth, "
    "machine_id FROM listing"
)
def derived_columns(spark, sf_dir):
    from filecensus.functions import modes, paths

    rel = paths.relative(F.col("path"), F.col("scan_path"))
    return demo.listing(spark, sf_dir).select(
        "file_id",
        modes.mode_string(F.col("mode")).alias("permissions"),
        sizes.format_timestamp(F.col("modified_timestamp")).alias("modified"),
        "filename",
        F.coalesce(paths.extension(F.col("filename")), F.lit("")).alias("extension"),
        paths.stem(F.col("filename")).alias("stem"),
        paths.dirname(F.col("path")).alias("folder"),
        paths.depth(rel).cast("long").alias("depth"),
        "machine_id",
    )


CHUNKED = ["categories", "rule", "risk_level", "risk_reason"]


@query(INV + "SELECT machine_id, path, categories, rule, risk_level, risk_reason FROM files WHERE rule IS NOT NULL")
def chunked_content(spark, sf_dir):
    """Classification and secrets from chunks of the contents, as files of any length are read."""
    rules = R.Rules()
    files = filters.plain_files(filters.walk(demo.contents(spark, sf_dir)))
    chunks = contents.text_chunks(files, FILE_KEYS, "head", "head_bytes", size=3000, overlap=1000)
    known = lookup_join(files.drop("head", "head_bytes"), contents.facts(chunks, FILE_KEYS, rules), FILE_KEYS, "left")
    rows = C.classify(known, rules, demo.listing(spark, sf_dir), tests=contents.tests())
    rows = S.flag_embedded_secrets(rows, rules, F.col("secret_text"))
    return rows.select(*FILE_KEYS, F.array_join("categories", "|").alias("categories"), *CHUNKED[1:])


_CUT = "doc_id % 53 + 1"


@query(
    "SELECT doc_id, replace(replace(left(text, list_max(list_filter(range(0, 55), "
    f"lambda m: strlen(left(text, m)) <= {_CUT}))), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS head FROM documents"
)
def lenient_decode(spark, sf_dir):
    """Text of bytes that begin with invalid ones and end inside a character."""
    raw = F.substr(F.encode("text", "UTF-8"), F.lit(1), F.expr(_CUT).cast("int"))
    head = text.decode_ignoring_errors(F.concat(F.unhex(F.lit("FF80")), raw))
    return demo.table(spark, sf_dir, "documents").select("doc_id", head.alias("head"))


# --- hashing -------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS hash, substr(sha256(text), 1, 12) || '…' AS short_hash FROM documents")
def content_hash(spark, sf_dir):
    digest = hashing.text_hash(F.col("text"))
    rows = demo.content_table(spark, sf_dir, "documents").select("doc_id", digest.alias("hash"))
    return rows.withColumn("short_hash", sizes.short_hash(F.col("hash")))


@query(
    INV + "SELECT machine_id, checkpoint, sha256(string_agg(line, chr(10) ORDER BY line)) AS folder_hash FROM ("
    "SELECT machine_id, checkpoint, substr(rel, length(checkpoint) + 2) || ':' || sha256(head) AS line "
    "FROM walked WHERE checkpoint IS NOT NULL) GROUP BY ALL"
)
def dir_hash(spark, sf_dir):
    below = filters.walk(demo.listing(spark, sf_dir)).filter("checkpoint IS NOT NULL")
    lines = below.select(
        "machine_id", "checkpoint",
        F.substr("relpath", F.length("checkpoint") + 2).alias("rel"),
        hashing.text_hash(F.col("head")).alias("hash"),
    )
    return hashing.folder_hashes(lines, ["machine_id", "checkpoint"])


# --- walking rules and filters ----------------------------------------------------------------


@query(
    INV + "SELECT machine_id, scan_path || '/' || checkpoint AS path, CAST(size_bytes AS BIGINT) AS size_bytes, n_files FROM folders"
)
def checkpoint_collapse(spark, sf_dir):
    walked = filters.walk(demo.listing(spark, sf_dir))
    folders = filters.collapse_checkpoints(walked, ["machine_id", "scan_path"])
    return folders.select("machine_id", "path", "size_bytes", "n_files")


@query(
    INV + "SELECT machine_id, path, CAST(size_bytes AS BIGINT) AS size_bytes FROM files "
    "WHERE rule = 'binary_model' AND filename = 'pytorch_model.bin'"
)
def bin_siblings(spark, sf_dir):
    rows = demo.inventory(spark, sf_dir).filter(
        (F.col("rule") == "binary_model") & (F.col("filename") == "pytorch_model.bin")
    )
    return rows.select(*FILE_KEYS, "size_bytes")


@query(INV + "SELECT machine_id, path, CAST(size_bytes AS BIGINT) AS size_bytes FROM inv WHERE size_bytes >= 4096")
def min_size_filter(spark, sf_dir):
    return filters.at_least(demo.inventory(spark, sf_dir), sizes.size_option("4KB")).select(*FILE_KEYS, "size_bytes")


@query(INV + f"SELECT machine_id, path FROM inv WHERE {oracle.overlaps('categories', ['data', 'agent'])}")
def category_any_filter(spark, sf_dir):
    return filters.in_categories(demo.inventory(spark, sf_dir), ["data", "agent"]).select(*FILE_KEYS)


@query(
    INV + f"SELECT machine_id, path, CAST(size_bytes AS BIGINT) AS size_bytes FROM inv "
    f"WHERE {oracle.overlaps('categories', ['config'])} AND size_bytes >= 1024"
)
def dashboard_filter(spark, sf_dir):
    options = filters.ScanOptions(min_size_bytes=1024, categories=("config",))
    return filters.passing(demo.inventory(spark, sf_dir), options).select(*FILE_KEYS, "size_bytes")


@query(INV + "SELECT machine_id, path, CAST(size_bytes AS BIGINT) AS size_bytes FROM inv WHERE category = 'model' AND size_bytes > 102400")
def big_models(spark, sf_dir):
    return filters.primary_category_over(demo.inventory(spark, sf_dir), "model", 102400).select(*FILE_KEYS, "size_bytes")


@query(oracle.inventory(hidden=True, depth=1) + "SELECT machine_id, path, category FROM inv")
def hidden_skip_depth(spark, sf_dir):
    options = filters.ScanOptions(include_hidden=True, max_depth=1)
    return demo.inventory(spark, sf_dir, options).select(*FILE_KEYS, "category")


_FOLLOWED = oracle.reached("COALESCE(checkpoint, rel)")


@query(
    INV + "SELECT machine_id, path, followed FROM listing, (VALUES (true), (false)) AS f(followed) "
    f"WHERE {_FOLLOWED} AND (followed OR file_id % 7 <> 3 OR checkpoint IS NOT NULL)"
)
def link_policy(spark, sf_dir):
    """Entries a scan reaches with links followed or left out, every seventh file being a link."""
    linked = demo.listing(spark, sf_dir).drop("head", "head_bytes").withColumn("is_symlink", F.col("file_id") % 7 == 3)
    walked = [
        filters.walk(linked, filters.ScanOptions(follow_symlinks=f)).select(*FILE_KEYS, F.lit(f).alias("followed")) for f in (True, False)
    ]
    return walked[0].unionByName(walked[1])


# --- sort orders ------------------------------------------------------------------------------


@query(
    INV + "SELECT machine_id, path, CAST(size_bytes AS BIGINT) AS size_bytes FROM inv ORDER BY size_bytes DESC, path, machine_id LIMIT 25"
)
def sort_topn_size(spark, sf_dir):
    top = ordering.top_files(demo.inventory(spark, sf_dir), 25, "size", ["path", "machine_id"])
    return top.select(*FILE_KEYS, "size_bytes")


@query(
    INV + "SELECT machine_id, path, category FROM inv ORDER BY category, size_bytes DESC, path, machine_id LIMIT 40"
)
def sort_topn_category(spark, sf_dir):
    top = ordering.top_files(demo.inventory(spark, sf_dir), 40, "category", ["path", "machine_id"])
    return top.select(*FILE_KEYS, "category")


@query(INV + "SELECT machine_id, path FROM inv ORDER BY lower(filename), path, machine_id LIMIT 40")
def sort_topn_name(spark, sf_dir):
    top = ordering.top_files(demo.inventory(spark, sf_dir), 40, "name", ["path", "machine_id"])
    return top.select(*FILE_KEYS)


@query(
    INV + "SELECT machine_id, path FROM files WHERE rule IS NOT NULL ORDER BY modified_timestamp DESC, path, machine_id LIMIT 40"
)
def sort_topn_date(spark, sf_dir):
    rows = demo.classified(spark, sf_dir)
    return ordering.top_files(rows, 40, "date", ["path", "machine_id"]).select(*FILE_KEYS)


@query(
    INV + "SELECT machine_id, path, risk_level, ROW_NUMBER() OVER (ORDER BY lower(risk_level) DESC, path, machine_id) AS position FROM inv"
)
def sort_by_column(spark, sf_dir):
    rows = demo.inventory(spark, sf_dir).select(*FILE_KEYS, "risk_level")
    sorted_rows = ordering.sort_by_column(rows, "risk_level", False, ["path", "machine_id"])
    return ordering.positions(stored(ordering.partitioned(sorted_rows), "sorted"))


@query(
    INV + "SELECT extension, n_files, total_size, CAST(format('{:.1f}', total_size / MAX(total_size) OVER () * 100) AS DOUBLE) AS bar_percent FROM ("
    "SELECT COALESCE(extension, '[dir]') AS extension, COUNT(*) AS n_files, CAST(SUM(size_bytes) AS BIGINT) AS total_size "
    "FROM inv GROUP BY 1 ORDER BY total_size DESC, extension LIMIT 8)"
)
def top_extensions(spark, sf_dir):
    return ordering.top_extensions(demo.inventory(spark, sf_dir), 8)


@query(
    INV + "SELECT category, n_files, total_size, CAST(format('{:.1f}', total_size / MAX(total_size) OVER () * 100) AS DOUBLE) AS bar_percent, "
    "ROW_NUMBER() OVER (ORDER BY total_size DESC, category) AS position FROM ("
    "SELECT category, COUNT(*) AS n_files, CAST(SUM(size_bytes) AS BIGINT) AS total_size FROM "
    "(SELECT size_bytes, unnest(string_split(categories, '|')) AS category FROM inv) GROUP BY category)"
)
def categories_by_size(spark, sf_dir):
    found = ordering.categories_by_size(demo.inventory(spark, sf_dir))
    return ordering.positions(stored(ordering.partitioned(found), "sorted"))


@query(
    INV + "SELECT category, COUNT(*) AS n_files, CAST(SUM(size_bytes) AS BIGINT) AS total_size, "
    "ROW_NUMBER() OVER (ORDER BY category) AS position FROM "
    "(SELECT size_bytes, unnest(string_split(categories, '|')) AS category FROM inv) GROUP BY category"
)
def categories_by_name(spark, sf_dir):
    found = ordering.categories_by_name(demo.inventory(spark, sf_dir))
    return ordering.positions(stored(ordering.partitioned(found), "sorted"))


@query(INV + "SELECT machine_id, path, array_to_string(string_split(categories, '|')[1:1], '|') AS shown FROM inv")
def category_display_cut(spark, sf_dir):
    shown = F.array_join(ordering.first_items(F.col("categories"), 1), "|").alias("shown")
    return demo.inventory(spark, sf_dir).select(*FILE_KEYS, shown)


# --- snapshots --------------------------------------------------------------------------------


def _sequenced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = stored_scans(spark, sf_dir)
    return files, stored(snapshots.with_previous(demo.reports(files)), "reports")


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files, reports = _sequenced(spark, sf_dir)
    return files, reports, snapshots.consecutive_changes(files, reports)


CHANGE_COLUMNS = "report_id, path, action, filename, CAST(size_bytes AS BIGINT) AS size_bytes, categories, CAST(previous_size AS BIGINT) AS previous_size, previous_hash, current_hash"


def _flat_changes(changes: DataFrame) -> DataFrame:
    return changes.withColumn("categories", F.array_join("categories", "|"))


@query(SCANS + f"SELECT {CHANGE_COLUMNS} FROM chg")
def integrity_diff(spark, sf_dir):
    return _flat_changes(_changes(spark, sf_dir)[2])


@query(SCANS + "SELECT report_id, CAST(new AS BIGINT) AS new, CAST(changed AS BIGINT) AS changed, CAST(deleted AS BIGINT) AS deleted, CAST(1 AS BIGINT) AS has_changes FROM chg_n")
def integrity_summary(spark, sf_dir):
    rows = snapshots.diff_summary(_changes(spark, sf_dir)[2], ["report_id"])
    return rows.withColumn("has_changes", F.col("has_changes").cast("long"))


_LOG = (
    "SELECT strftime(s.received_at, '%Y-%m-%d %H:%M:%S') AS timestamp, s.machine_id, s.scan_path, s.report_id AS report_file, "
    "CASE WHEN previous_report_id IS NULL THEN 'baseline' WHEN n.report_id IS NOT NULL THEN 'changes_detected' ELSE 'clean' END AS status, "
    "CASE WHEN previous_report_id IS NULL THEN 'No previous report — this scan is the new baseline' "
    "WHEN n.report_id IS NULL THEN 'No changes detected' END AS message, "
    "previous_report_id AS compared_to, previous_time AS compared_time, CAST(COALESCE(new, 0) AS BIGINT) AS new, "
    "CAST(COALESCE(changed, 0) AS BIGINT) AS changed, CAST(COALESCE(deleted, 0) AS BIGINT) AS deleted "
    "FROM seq s LEFT JOIN chg_n n ON s.report_id = n.report_id"
)


def _written_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reports, changes = _changes(spark, sf_dir)
    changes = stored(changes, "changes")
    path = work_dir(spark, "log")
    sink.append_log(sink.log_lines(snapshots.log_entries(changes, reports), changes), path)
    return source.read_log(spark, path)


@query(SCANS + _LOG)
def integrity_log(spark, sf_dir):
    log = _written_log(spark, sf_dir).filter("part_no = 0")
    return log.drop("files", "part_no", "n_parts").withColumn("timestamp", time_text("timestamp"))


@query(
    SCANS + "SELECT r.machine_id, c.report_id AS report_file, c.action, c.path, CAST(c.size_bytes AS BIGINT) AS size_bytes, "
    "c.categories, c.previous_hash, c.current_hash FROM chg c JOIN rep r ON c.report_id = r.report_id"
)
def log_explode(spark, sf_dir):
    rows = snapshots.log_files(_written_log(spark, sf_dir))
    return _flat_changes(rows).select(
        "machine_id", "report_file", "action", "path", "size_bytes", "categories", "previous_hash", "current_hash"
    )


SNAPSHOT_KEYS = ["machine_id", "scan_path", "path"]


@query(
    SCANS + "SELECT c.machine_id, c.scan_path, c.path FROM sf c ANTI JOIN (SELECT * FROM sf WHERE scan_no = 1) p "
    "USING (machine_id, scan_path, path) WHERE c.scan_no = 2"
)
def new_paths(spark, sf_dir):
    files = stored_scans(spark, sf_dir)
    rows = snapshots.new_paths(files.filter("scan_no = 1"), files.filter("scan_no = 2"), SNAPSHOT_KEYS)
    return rows.select(*SNAPSHOT_KEYS)


@query(
    SCANS + "SELECT c.machine_id, c.scan_path, c.path FROM sf c ANTI JOIN (SELECT * FROM sf WHERE scan_no = 1) p "
    "USING (machine_id, scan_path, path) WHERE c.scan_no = 0"
)
def deleted_paths(spark, sf_dir):
    files = stored_scans(spark, sf_dir)
    rows = snapshots.deleted_paths(files.filter("scan_no = 0"), files.filter("scan_no = 1"), SNAPSHOT_KEYS)
    return rows.select(*SNAPSHOT_KEYS)


@query(
    SCANS + "SELECT machine_id, path, hash, CAST(scan_no AS BIGINT) AS scan_no FROM sf "
    "QUALIFY ROW_NUMBER() OVER (PARTITION BY machine_id, path ORDER BY scan_no DESC) = 1"
)
def last_by_path(spark, sf_dir):
    files = demo.scan_files(spark, sf_dir).select("machine_id", "path", "hash", F.col("scan_no").cast("long").alias("scan_no"))
    return snapshots.last_per_path(files, FILE_KEYS, "scan_no")


# --- fleet --------------------------------------------------------------------------------------


def _fleet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = stored_scans(spark, sf_dir)
    return demo.reports(files), files


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.reports(demo.scan_files(spark, sf_dir))


_NODES = (
    "SELECT n.machine_id, l.hostname, l.hostname || '.example.org' AS fqdn, "
    "CASE WHEN l.scan_no < 2 THEN '10.0.0.1' END AS ip_address, 'v' || l.scan_no AS os_version, "
    "strftime(n.first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(n.last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, "
    "n.report_count, l.total_files AS latest_files, l.total_size AS latest_size, l.scan_path AS latest_scan_path "
    "FROM (SELECT machine_id, MIN(received_at) AS first_seen, MAX(received_at) AS last_seen, COUNT(*) AS report_count "
    "FROM rep GROUP BY machine_id) n JOIN lat l USING (machine_id)"
)
NODE_COLUMNS = [
    "machine_id", "hostname", "fqdn", "ip_address", "os_version", "first_seen", "last_seen",
    "report_count", "latest_files", "latest_size", "latest_scan_path",
]


def _node_view(nodes: DataFrame) -> DataFrame:
    shown = nodes.withColumns({c: time_text(c) for c in ("first_seen", "last_seen")})
    return shown.select(*NODE_COLUMNS)


@query(SCANS + _NODES)
def nodes(spark, sf_dir):
    return _node_view(fleet.nodes_by_last_seen(fleet.node_registry(_reports(spark, sf_dir))))


@query(
    SCANS + "SELECT machine_id, report_id, scan_time, total_files, total_size FROM lat"
)
def latest_report(spark, sf_dir):
    rows = fleet.latest_reports(_reports(spark, sf_dir))
    return rows.select("machine_id", "report_id", "scan_time", "total_files", "total_size")


@query(
    SCANS + "SELECT report_id, machine_id, scan_time, scan_path, total_files, total_size FROM rep "
    "QUALIFY ROW_NUMBER() OVER (PARTITION BY machine_id ORDER BY received_at DESC, report_id DESC) <= 50"
)
def scan_history(spark, sf_dir):
    rows = fleet.scan_history(_reports(spark, sf_dir))
    return rows.select("report_id", "machine_id", "scan_time", "scan_path", "total_files", "total_size")


@query(
    SCANS + "SELECT COUNT(*) AS total_nodes, CAST(SUM(total_files) AS BIGINT) AS total_files, "
    "CAST(SUM(total_size) AS BIGINT) AS total_size FROM lat"
)
def fleet_overview(spark, sf_dir):
    return fleet.fleet_totals(fleet.node_registry(_reports(spark, sf_dir)))


@query(
    SCANS + "SELECT category, CAST(SUM(n_files) AS BIGINT) AS n_files, CAST(SUM(c.total_size) AS BIGINT) AS total_size "
    "FROM rep_cat c JOIN lat USING (report_id) GROUP BY category"
)
def fleet_categories(spark, sf_dir):
    return fleet.fleet_categories(_reports(spark, sf_dir))


NODE = "src7"
_NODE_ID = f"substr(sha256(md5('{NODE}') || ':{NODE}'), 1, 16)"


@query(
    SCANS + "SELECT n.machine_id, l.hostname, n.report_count, strftime(n.last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, "
    "l.total_files AS latest_files, l.report_id, l.scan_time, c.category, c.n_files FROM "
    "(SELECT machine_id, MAX(received_at) AS last_seen, COUNT(*) AS report_count FROM rep GROUP BY machine_id) n "
    f"JOIN lat l USING (machine_id) JOIN rep_cat c ON l.report_id = c.report_id WHERE n.machine_id = {_NODE_ID}"
)
def node_detail(spark, sf_dir):
    """One node with its newest report."""
    digest = hashlib.md5(NODE.encode()).hexdigest()
    ident = hashlib.sha256(f"{digest}:{NODE}".encode()).hexdigest()[:16]
    found = fleet.node_with_latest_report(_reports(spark, sf_dir), ident)
    return found.select(
        "machine_id", "hostname", "report_count", time_text("last_seen"), "latest_files", "report_id", "scan_time",
        F.explode("by_category").alias("category", "t"),
    ).withColumn("n_files", F.col("t.count")).drop("t")


ALERT_COLUMNS = ["report_id", "machine_id", "created_at", "alert_type", "severity", "message", "n_files", "acknowledged"]


def _alert_view(found: DataFrame) -> DataFrame:
    return found.withColumn("created_at", time_text("created_at")).select(*ALERT_COLUMNS)


@query(SCANS + f"SELECT {', '.join(ALERT_COLUMNS)} FROM alr")
def alerts(spark, sf_dir):
    return _alert_view(fleet.alerts(*_fleet(spark, sf_dir)))


@query(
    SCANS + "SELECT report_id, alert_type, path, CASE WHEN alert_type = 'permissions' THEN permissions END AS perms FROM kinds"
)
def alert_files(spark, sf_dir):
    return fleet.alert_files(stored_scans(spark, sf_dir))


@query(SCANS + "SELECT severity, COUNT(*) AS n_alerts FROM alr GROUP BY severity")
def alert_severity(spark, sf_dir):
    return fleet.alert_severity(fleet.alerts(*_fleet(spark, sf_dir)))


@query(
    SCANS + "SELECT report_id, alert_type, severity, n_files, acknowledged FROM (SELECT * REPLACE "
    "(CAST(CASE WHEN report_id LIKE '%-0' AND alert_type = 'permissions' THEN 1 ELSE 0 END AS BIGINT) AS acknowledged) FROM alr) "
    "WHERE acknowledged = 0"
)
def open_alerts(spark, sf_dir):
    """Alerts that nobody has dealt with; the permission alerts of the first scans have been."""
    found = stored(fleet.alerts(*_fleet(spark, sf_dir)), "alerts")
    seen = found.filter(F.col("report_id").endswith("-0") & (F.col("alert_type") == "permissions"))
    rows = fleet.unacknowledged(fleet.acknowledge(found, seen))
    return rows.select("report_id", "alert_type", "severity", "n_files", "acknowledged")


@query(
    SCANS + "SELECT machine_id, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, "
    "ROW_NUMBER() OVER (ORDER BY last_seen DESC, machine_id) AS position FROM "
    "(SELECT machine_id, MAX(received_at) AS last_seen FROM rep GROUP BY machine_id)"
)
def node_order(spark, sf_dir):
    """Nodes with their place in the order of last contact."""
    rows = fleet.nodes_by_last_seen(fleet.node_registry(_reports(spark, sf_dir)))
    ordered = ordering.partitioned(rows.select("machine_id", time_text("last_seen")))
    return ordering.positions(stored(ordered, "sorted"))


@query(
    SCANS + "SELECT report_id, hostname, created_at, alert_type, severity, message FROM alr "
    "ORDER BY created_at DESC, report_id DESC, alert_type DESC LIMIT 50"
)
def recent_alerts(spark, sf_dir):
    reports, files = _fleet(spark, sf_dir)
    reports = stored(reports, "reports")
    rows = fleet.recent_alerts(fleet.alerts(reports, files), fleet.node_registry(reports), 50)
    return rows.select("report_id", "hostname", time_text("created_at"), "alert_type", "severity", "message")


_CHANGE_ROWS = (
    "SELECT c.report_id, r.machine_id, strftime(r.received_at, '%Y-%m-%d %H:%M:%S') AS detected_at, "
    "CASE c.action WHEN 'added' THEN 'new' ELSE c.action END AS change_type, c.path AS file_path, c.filename, "
    "r.hostname, c.previous_hash FROM chg c JOIN rep r ON c.report_id = r.report_id"
)


@query(SCANS + f"SELECT * EXCLUDE (hostname) FROM ({_CHANGE_ROWS})")
def changes(spark, sf_dir):
    files, reports, found = _changes(spark, sf_dir)
    documents = sink.report_parts(reports, files, found)
    rows = fleet.reported_changes(source.identified(documents))
    previous = F.get_json_object("details", "$.previous_hash").alias("previous_hash")
    return rows.select(
        "report_id", "machine_id", time_text("detected_at"), "change_type", "file_path", "filename", previous
    )


@query(
    SCANS + f"SELECT report_id, machine_id, detected_at, change_type, file_path, filename, hostname FROM ({_CHANGE_ROWS}) "
    "ORDER BY detected_at DESC, report_id DESC, file_path DESC LIMIT 50"
)
def recent_changes(spark, sf_dir):
    _, reports, found = _changes(spark, sf_dir)
    rows = fleet.recent_changes(fleet.computed_changes(found, reports), fleet.node_registry(reports), 50)
    return rows.select(
        "report_id", "machine_id", time_text("detected_at"), "change_type", "file_path", "filename", "hostname"
    )


_RECEIPTS = (
    "SELECT 'accepted' AS status, r.machine_id, r.hostname, r.report_id, COALESCE(a.n, 0) AS alerts_generated, "
    "COALESCE(c.n, 0) AS changes_detected FROM rep r "
    "LEFT JOIN (SELECT report_id, COUNT(*) AS n FROM alr GROUP BY 1) a USING (report_id) "
    "LEFT JOIN (SELECT report_id, COUNT(*) AS n FROM chg GROUP BY 1) c USING (report_id)"
)


@query(SCANS + _RECEIPTS)
def ingest_receipts(spark, sf_dir):
    files, reports, found = _changes(spark, sf_dir)
    return fleet.receipts(reports, fleet.alerts(reports, files), found)


# --- streaming ------------------------------------------------------------------------------------


def arrivals(spark: SparkSession, sf_dir: str) -> Iterator[str]:
    """A folder of JSON lines a stream can pick up, handed out after each arrival of reports.

    The middle scans come late, after the last ones, and the first scans come again with them.
    """
    files, reports, found = _changes(spark, sf_dir)
    documents = stored(sink.report_parts(reports, files, found), "documents")
    path = work_dir(spark, "feed")
    middle = F.col("report_id").endswith("-1")
    for arriving in (~middle, middle | F.col("report_id").endswith("-0")):
        documents.filter(arriving).write.mode("append").json(path)
        yield path


def ingested(spark: SparkSession, sf_dir: str) -> Iterator[ingest.FleetStore]:
    """The fleet store after each arrival."""
    store = ingest.FleetStore(spark, work_dir(spark, "fleet"))
    for path in arrivals(spark, sf_dir):
        ingest.run_available(ingest.report_stream(spark, path), store)
        yield store


@query(SCANS + _RECEIPTS)
def stream_ingest(spark, sf_dir):
    """All arrivals at once, replays among them."""
    *_, path = arrivals(spark, sf_dir)
    store = ingest.FleetStore(spark, work_dir(spark, "fleet"))
    ingest.run_available(ingest.report_stream(spark, path), store)
    return fleet.receipts(store.read("reports"), store.read("alerts"), store.read("changes"))


@query(SCANS + _NODES)
def stream_nodes(spark, sf_dir):
    work = work_dir(spark, "stream-nodes")
    *_, found = (ingest.running_nodes(spark, path, work) for path in arrivals(spark, sf_dir))
    return _node_view(found)


@query(SCANS + "SELECT severity, COUNT(*) AS n_alerts FROM alr GROUP BY severity")
def stream_alert_counts(spark, sf_dir):
    work = work_dir(spark, "stream-alerts")
    *_, found = (ingest.running_alert_counts(spark, store, work) for store in ingested(spark, sf_dir))
    return found


@query(SCANS + f"SELECT * EXCLUDE (previous_hash, hostname) FROM ({_CHANGE_ROWS})")
def stream_changes(spark, sf_dir):
    *_, store = ingested(spark, sf_dir)
    return store.read("computed_changes").select(
        "report_id", "machine_id", time_text("detected_at"), "change_type", "file_path", "filename"
    )


# --- sinks and file sources ---------------------------------------------------------------------


@query(
    INV + f"""SELECT path, filename, extension, category, categories, CAST(size_bytes AS BIGINT) AS size_bytes,
    {oracle.size_text('size_bytes')} AS size_human,
    strftime(to_timestamp(modified_timestamp) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS modified, 'file' AS type,
    detection_method, confidence, risk_level, risk_reason, owner, "group", {oracle.PERMISSIONS} AS permissions, sha256(head) AS hash
    FROM files WHERE rule IS NOT NULL"""
)
def csv_report(spark, sf_dir):
    rows = demo.classified(spark, sf_dir).withColumn("hash", F.sha2("head", 256)).drop("head", "head_bytes")
    path = work_dir(spark, "csv")
    sink.write_csv(stored(rows, "rows"), path)
    types = ", ".join(
        f"`{c}` {'bigint' if c == 'size_bytes' else 'string'}"
        for c in [*sink.CSV_COLUMNS, *sink.OWNER_COLUMNS, "hash"]
    )
    return spark.read.option("header", True).option("escape", '"').schema(types).csv(path)


@query(
    INV + f"""SELECT path, COALESCE(extension, '') AS extension, category, categories, CAST(size_bytes AS BIGINT) AS size_bytes,
    {oracle.size_text('size_bytes')} AS size_human, risk_level, COALESCE(risk_reason, '') AS risk_reason,
    owner, {oracle.PERMISSIONS} AS permissions, permission_alert, modified_timestamp FROM files WHERE rule IS NOT NULL"""
)
def json_report(spark, sf_dir):
    rows = demo.classified(spark, sf_dir).drop("head", "head_bytes")
    path = work_dir(spark, "json")
    sink.write_json_report(stored(rows, "rows"), ["machine_id", "scan_path"], path)
    back = spark.read.schema(schema.REPORT_FILE).json(f"{path}/files")
    return back.select(
        "path", "extension", "category", F.array_join("categories", "|").alias("categories"), "size_bytes",
        "size_human", "risk_level", "risk_reason", "owner", "permissions", "permission_alert", "modified_timestamp",
    )


@query(
    INV + f"""SELECT path, filename, COALESCE(extension, '') AS extension, category, categories, CAST(size_bytes AS BIGINT) AS size_bytes,
    'file' AS type, detection_method, confidence, risk_level FROM files WHERE rule IS NOT NULL"""
)
def csv_report_plain(spark, sf_dir):
    """The CSV report of a scan without permissions and hashes: it has no such columns."""
    rows = demo.classified(spark, sf_dir).drop("head", "head_bytes", *sink.OWNER_COLUMNS, *sink.ALERT_COLUMNS)
    path = work_dir(spark, "csv")
    sink.write_csv(stored(rows, "rows"), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    if back.columns != sink.CSV_COLUMNS:
        raise ValueError(f"unexpected columns {back.columns}")
    blank = F.coalesce("extension", F.lit("")).alias("extension")
    return back.select(
        "path", "filename", blank, "category", "categories", F.col("size_bytes").cast("long").alias("size_bytes"), "type",
        "detection_method", "confidence", "risk_level",
    )


_SCAN_FILES = (
    "sized AS (SELECT machine_id, size_bytes, COALESCE(NULLIF(extension, ''), '[dir]') AS ext, categories FROM files WHERE rule IS NOT NULL), "
    "scan_sizes AS (SELECT machine_id, COUNT(*) AS n, CAST(SUM(size_bytes) AS BIGINT) AS s FROM sized GROUP BY 1), "
    "parts AS (SELECT machine_id, 'extension' AS kind, ext AS name, COUNT(*) AS n_files, CAST(SUM(size_bytes) AS BIGINT) AS total_size "
    "FROM sized GROUP BY ALL UNION ALL SELECT machine_id, 'category', name, COUNT(*), CAST(SUM(size_bytes) AS BIGINT) FROM "
    "(SELECT machine_id, size_bytes, unnest(string_split(categories, '|')) AS name FROM sized) GROUP BY ALL)"
)


@query(
    INV + f", {_SCAN_FILES} SELECT machine_id, kind, name, n_files, total_size, {oracle.size_text('total_size')} AS size_human, "
    f"n AS scan_files, {oracle.size_text('s')} AS scan_size, round_even(CAST(n AS DOUBLE) / 8, 2) AS seconds, 'two' AS last_error "
    "FROM parts JOIN scan_sizes USING (machine_id)"
)
def json_report_metadata(spark, sf_dir):
    """Metadata and extension totals of a JSON report, written and read back."""
    rows, keys = stored(demo.classified(spark, sf_dir).drop("head", "head_bytes"), "rows"), ["machine_id", "scan_path"]
    path = work_dir(spark, "json")
    said = {"scan_duration": F.col("total_files") / 8, "scan_time": "2026-01-01T00:00:00", "errors": ["one", "two"]}
    sink.write_json_report(rows, keys, path, {"hostname": "node"}, said)
    _, metadata, extensions = source.read_json_report(spark, path, keys)
    whole = metadata.select(
        "machine_id", F.col("total_files").alias("scan_files"), F.col("total_size_human").alias("scan_size"),
        F.col("scan_duration_seconds").alias("seconds"), F.element_at("errors", -1).alias("last_error"), "by_category",
    )
    shown = ["kind", "name", "n_files", "total_size", "size_human"]
    by_category = whole.select("machine_id", F.explode("by_category").alias("name", "t")).select(
        "machine_id", F.lit("category").alias("kind"), "name", F.col("t.count").alias("n_files"),
        F.col("t.size").alias("total_size"), F.col("t.size_human").alias("size_human"),
    )
    by_extension = extensions.withColumnsRenamed({"extension": "name"}).withColumn("kind", F.lit("extension"))
    parts = by_category.unionByName(by_extension.select("machine_id", *shown))
    return lookup_join(parts, whole.drop("by_category"), ["machine_id"], "inner")


@query(
    SCANS + "SELECT report_id, path, category, CAST(size_bytes AS BIGINT) AS size_bytes, hash FROM sf WHERE report_id = "
    "(SELECT report_id FROM rep ORDER BY received_at DESC, machine_id DESC LIMIT 1)"
)
def newest_report_files(spark, sf_dir):
    """Files of the newest report in a folder of report documents, found by name."""
    files, reports = _sequenced(spark, sf_dir)
    folder = work_dir(spark, "report-documents")
    sink.write_named_reports(sink.report_parts(reports, files), folder)
    documents = source.read_reports(spark, source.newest_report(spark, folder))
    return source.report_files(source.identified(documents)).select("report_id", "path", "category", "size_bytes", "hash")
