"""Ordered classification of files by name, extension and content.

The first rule that matches wins.  Names and extensions are decided before any content
is touched: the content columns are read only inside branches that need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filecensus.functions import paths, text
from filecensus.operators import rules as R
from filecensus.operators.lookup import lookup_join

# What follows from each rule that does not depend on the extension.
OUTCOMES = [
    ("skill_name", ["skill", "document"], "filename", "high", "none", None),
    ("agent_document_name", ["agent", "document"], "filename", "high", "none", None),
    ("agent_config_name", ["agent", "config"], "filename", "high", "none", None),
    ("secret_name", ["secret"], "filename", "high", "danger", R.SECRET_FILE_REASON),
    ("extension", None, "extension", None, None, None),
    ("agent_text", ["agent", "document"], "heuristic", "medium", "none", None),
    ("agent_config", ["agent", "config"], "heuristic", "medium", "none", None),
    ("skill_config", ["skill", "config"], "heuristic", "medium", "none", None),
    ("ai_yaml", ["config"], "heuristic", "medium", "none", None),
    ("binary_model", ["model"], "heuristic", "medium", "warning", R.BINARY_REASON),
    ("vector_database", ["vector"], "heuristic", "medium", "none", None),
    ("database", ["data"], "heuristic", "medium", "none", None),
]
OUTCOME_SCHEMA = (
    "rule string, o_categories array<string>, detection_method string, o_confidence string, "
    "o_level string, o_reason string"
)
UNCLASSIFIED = "none"


def name_rule(name: Column, ext: Column, stem: Column) -> Column:
    """Which rule a file's whole name triggers, or NULL."""
    extension = F.coalesce(ext, F.lit(""))
    needs_extension = stem.isin(R.AGENT_STEMS_NEEDING_EXTENSION)
    agent = (stem.isin(R.AGENT_STEMS) | name.isin(R.AGENT_EXACT_NAMES)) & (
        ~needs_extension | extension.isin(R.AGENT_EXTENSIONS)
    )
    return (
        F.when(name == R.SKILL_EXACT_NAME, "skill_name")
        .when(agent & extension.isin(".md", ".txt"), "agent_document_name")
        .when(agent, "agent_config_name")
        .when(text.matches_any(name, [R.ENV_NAME, R.SECRET_NAME]), "secret_name")
    )


def _branch() -> Column:
    """The content test a file is due for, after names and plain extensions."""
    ext, ambiguous = F.col("_ext"), F.coalesce(F.col("rule_ambiguous"), F.lit(False))
    return (
        F.when(F.col("_name_rule").isNotNull(), F.col("_name_rule"))
        .when(F.col("rule_categories").isNotNull() & ~ambiguous, "extension")
        .when(ambiguous & ext.isin(".yaml", ".yml"), "yaml")
        .when(ambiguous & (ext == ".json"), "json")
        .when(ambiguous & (ext == ".bin"), "bin")
        .when(ambiguous & ext.isin(".db", ".sqlite", ".sqlite3"), "db")
        .when(~ambiguous & (ext == ".txt"), "txt")
    )


def head_tests(window: R.Window) -> dict[str, Column]:
    """What the content rules ask of a file, answered from ``head`` and ``head_bytes``."""
    head, raw = F.col("head"), F.col("head_bytes")
    start = text.first_chars(head, window.keyword_chars)
    magic = F.lit(False)
    for word, length in R.BINARY_MAGIC.items():
        magic = magic | (text.magic(raw, length) == word.encode().hex().upper())
    limit = window.database_bytes
    chunk = raw if limit is None else F.substr(raw, F.lit(1), F.lit(limit))
    counted = {
        "agent": (start, R.AGENT_KEYWORDS),
        "skill": (start, R.SKILL_KEYWORDS),
        "yaml": (text.first_chars(head, window.yaml_chars), R.AI_KEYWORDS),
    }
    return {name: text.keyword_hits(seen, words) >= R.KEYWORD_THRESHOLD for name, (seen, words) in counted.items()} | {
        "magic": magic,
        "sqlite": text.magic(raw, len(R.SQLITE_MAGIC)) == R.SQLITE_MAGIC.encode().hex().upper(),
        "vector": text.contains_any(F.decode(chunk, "ISO-8859-1"), R.VECTOR_DB_WORDS),
    }


def _content_rule(tests: dict[str, Column]) -> Column:
    """The final rule.  Content is looked at only in branches that need it."""
    branch, name = F.col("_branch"), F.col("filename")
    agent = text.matches(name, R.AGENT_NAME) & tests["agent"]
    skill = text.matches(name, R.SKILL_NAME) & tests["skill"]
    by_siblings = (F.col("size_bytes") > R.LARGE_BINARY_BYTES) & F.col("_model_folder")
    return F.coalesce(
        F.when(branch == "txt", F.when(agent, "agent_text"))
        .when(
            branch.isin("yaml", "json"),
            F.when(agent, "agent_config")
            .when(skill, "skill_config")
            .when((branch == "yaml") & tests["yaml"], "ai_yaml"),
        )
        .when(branch == "bin", F.when(tests["magic"] | by_siblings, "binary_model"))
        .when(branch == "db", F.when(tests["sqlite"], F.when(tests["vector"], "vector_database").otherwise("database")))
        .otherwise(branch),
        F.lit(UNCLASSIFIED),
    )


def model_folders(listing: DataFrame) -> DataFrame:
    """Folders holding both a ``.bin`` file and a model config file.

    ``listing`` is the unfiltered listing, of which only names and paths are read; partial
    aggregation leaves one row per folder and task before the shuffle.
    """
    name = F.col("filename")
    indicator, binary = name.isin(R.MODEL_FOLDER_FILES), F.lower(name).endswith(".bin")
    return (
        listing.filter(indicator | binary)
        .groupBy("machine_id", paths.dirname(F.col("path")).alias("_parent"))
        .agg(F.bool_or(indicator).alias("_has_config"), F.bool_or(binary).alias("_has_binary"))
        .filter("_has_config AND _has_binary")
        .select("machine_id", "_parent", F.lit(True).alias("_model_folder"))
    )


def classify(
    files: DataFrame,
    rules: R.Rules | None = None,
    listing: DataFrame | None = None,
    keep_unclassified: bool = False,
    tests: dict[str, Column] | None = None,
) -> DataFrame:
    """Add categories, category, detection method, confidence and risk to files.

    ``files`` needs path, filename, size_bytes, head (text) and head_bytes (binary); instead of the last two,
    ``tests`` may answer what the content rules ask (``contents.tests``).
    ``listing`` (machine_id, path, filename of *all* files) switches on the
    rule that a large ``.bin`` beside a model config is a model.  Rows no rule matches are
    dropped unless ``keep_unclassified``.
    """
    rules = rules or R.Rules()
    spark: SparkSession = files.sparkSession
    table = rules.extension_rules(spark)
    if len(rules.extensions) + len(rules.risks) + len(rules.ambiguous) <= 100_000:
        table = F.broadcast(table)
    name = F.col("filename")
    named = files.withColumn("_ext", paths.extension(name)).withColumn(
        "_name_rule", name_rule(name, F.col("_ext"), paths.stem(name))
    )
    ruled = named.join(table, F.col("_ext") == F.col("rule_extension"), "left")
    ruled = ruled.withColumn("_branch", _branch())
    if listing is None:
        ruled = ruled.withColumn("_model_folder", F.lit(False))
    else:
        # Only large binaries meet the listing; no other row, and so hardly any text, is shuffled.
        due = F.coalesce((F.col("_branch") == "bin") & (F.col("size_bytes") > R.LARGE_BINARY_BYTES), F.lit(False))
        asking = ruled.filter(due).withColumn("_parent", paths.dirname(F.col("path")))
        asking = lookup_join(asking, model_folders(listing), ["machine_id", "_parent"], "left")
        ruled = (
            ruled.filter(~due)
            .withColumn("_model_folder", F.lit(False))
            .unionByName(asking.withColumn("_model_folder", F.coalesce("_model_folder", F.lit(False))).drop("_parent"))
        )
    decided = ruled.withColumn("rule", _content_rule(tests or head_tests(rules.window)))
    return _describe(decided, keep_unclassified).drop(
        "_ext", "_name_rule", "_branch", "_model_folder", *R.EXTENSION_RULES.fieldNames()
    )


def _describe(decided: DataFrame, keep_unclassified: bool) -> DataFrame:
    """Look up what the rule means.

    ``rule`` is never NULL and its meaning comes from a join, so filters on categories or
    risk stop above the join and the content tests are not repeated inside them.
    """
    outcomes = F.broadcast(R.local_table(decided.sparkSession, OUTCOMES, OUTCOME_SCHEMA))
    joined = decided.join(outcomes, "rule", "left" if keep_unclassified else "inner")
    ext, name, rule = F.col("_ext"), F.col("filename"), F.col("rule")
    by_extension, known = rule == "extension", F.col("detection_method").isNotNull()
    risk = F.when(by_extension, F.coalesce("rule_risk_level", F.lit("none"))).otherwise(F.col("o_level"))
    reason = F.when(by_extension, F.col("rule_risk_reason")).otherwise(F.col("o_reason"))
    return joined.select(
        "*",
        F.when(rule == "secret_name", F.coalesce(ext, name)).otherwise(ext).alias("extension"),
        F.when(by_extension, F.col("rule_categories")).otherwise(F.col("o_categories")).alias("categories"),
        F.when(by_extension, F.col("rule_confidence")).otherwise(F.col("o_confidence")).alias("confidence"),
        risk.alias("risk_level"),
        reason.alias("risk_reason"),
    ).withColumns(
        {"category": F.element_at("categories", 1), "rule": F.when(known, rule)}
    ).drop("o_categories", "o_confidence", "o_level", "o_reason")


def checkpoint_rows(folders: DataFrame) -> DataFrame:
    """Describe collapsed checkpoint folders as classified rows."""
    return folders.withColumns(
        {
            "extension": F.lit(None).cast("string"),
            "categories": F.array(F.lit("checkpoint")),
            "category": F.lit("checkpoint"),
            "rule": F.lit("checkpoint_folder"),
            "detection_method": F.lit("pattern"),
            "confidence": F.lit("high"),
            "risk_level": F.lit("none"),
            "risk_reason": F.lit(None).cast("string"),
        }
    )
