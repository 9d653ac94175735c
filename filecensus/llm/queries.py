"""Registered corpus queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecensus.llm import (
    alignment,
    conversation_repair,
    decontaminate,
    language_model,
    licenses,
    mixing,
    ngram_join,
    packing,
    quality,
    secrets_scan,
    suffix_dedup,
    token_counts,
    toxicity,
)
from filecensus.llm.shared import crc_remainder, documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query()
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets overlap by 80 % or more."""
    found = ngram_join.set_components(documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id")


@query()
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without strings of 200 bytes that also start elsewhere."""
    found = suffix_dedup.repeated_spans(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["high"] - s["low"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


@query()
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every text and whether it is kept by the weighed votes of the rules."""
    found = quality.assess(documents(spark, sf_dir))
    return found.select("doc_id", *quality.MEASURES, "base_failed", "kept", "quality")


@query(
    """
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
    ), drawn AS (
      SELECT *, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || size) AS draw FROM sized
    ), sources AS (
      SELECT source, sum(size)::BIGINT AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
      FROM drawn GROUP BY source
    ), filled AS (
      -- sources in the order in which a rising level clamps them, and the level if all before are clamped
      SELECT *, 3 * source_size / weight AS reach,
             (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
               / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM sources
      WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), levels AS (SELECT max(level) FILTER (level <= reach) AS level FROM filled
    ), targets AS (
      SELECT source, source_size, CASE WHEN source_size > 0 THEN least(weight * levels.level, 3.0::DOUBLE * source_size) ELSE 0 END AS target
      FROM sources, levels
    ), goals AS (
      SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS repeats FROM targets
    ), units AS (
      SELECT source, draw, sum(size) AS words, count(*) AS n,
             sum(sum(size)) OVER (PARTITION BY source ORDER BY draw) - sum(size) AS so_far
      FROM drawn GROUP BY source, draw
    )
    SELECT d.doc_id, d.size, g.source_size::BIGINT AS source_size, g.target::DOUBLE AS target,
           (g.repeats * d.size + CASE
              WHEN floor(g.target)::BIGINT - g.repeats * g.source_size >= u.so_far + u.words THEN d.size
              WHEN floor(g.target)::BIGINT - g.repeats * g.source_size <= u.so_far THEN 0
              ELSE (floor(g.target)::BIGINT - g.repeats * g.source_size - u.so_far) // u.n END)::BIGINT AS taken
    FROM drawn d
    JOIN goals g ON g.source IS NOT DISTINCT FROM d.source
    JOIN units u ON u.source IS NOT DISTINCT FROM d.source AND u.draw = d.draw
    """
)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document by a mix of sources weighing 1, 2, 3 with at most three repetitions."""
    found = mixing.mix(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text: those of fixed patterns, and strings that look random."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = secrets_scan.scan(docs, secrets_scan.train(secrets_scan.corpus_samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, secrets_scan.KINDS), F.sha2(secrets_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secrets_scan.listed(F.col("spans")).alias("spans"),
    )


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by a model of the labelled rows outside the held-out fifth."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score(docs, toxicity.fitted(docs, labels))
    return found.select(
        "doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wording in every text, by fixed phrases and by templates."""
    found = licenses.scan(documents(spark, sf_dir))
    base = F.filter("found", lambda m: m["base"])
    label = lambda column: F.array_join(F.sort_array(F.array_distinct(F.transform(column, lambda m: m["label"]))), ",")
    longest = F.array_max(F.transform("found", lambda m: m["end"] - m["start"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("found")).alias("labels"),
        # the longer the exact wording, the surer
        F.coalesce(1 - 1 / (1 + longest), F.lit(0.0)).alias("score"),
    )


@query()
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, a few replaced words allowed."""
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece tokens of every text."""
    return token_counts.count_tokens(documents(spark, sf_dir), token_counts.PieceCounter(token_counts.load_vocabulary()))


@query()
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text under the attention model, beside the add-one word model."""
    return language_model.score(documents(spark, sf_dir))


@query()
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two vocabularies that end together in every text, and how common their links are."""
    return alignment.alignment_digests(documents(spark, sf_dir))


@query()
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4,096 tokens that hold the sources in the proportions of the whole."""
    pieces = packing.pack(documents(spark, sf_dir))
    crc = packing.ids_crc32(F.col("ids")).alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


@query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest edits that put each damaged conversation right."""
    rows = conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversation_repair.summaries(conversation_repair.repair(conversation_repair.with_faults(rows)))
