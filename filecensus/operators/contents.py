"""Content rules over files that come in chunks.

A file's content is rows ``(start, text, raw)``: chunks in which each but the last repeats the
beginning of the next, so that what a rule looks for stands whole in one of them if it is no
longer than that.  Rules are tested chunk by chunk and one aggregation with map-side combine
puts a file's findings together, so no row ever holds a whole file.  Keywords found in
different chunks count together: each chunk gives the set of those it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecensus.functions import text
from filecensus.operators import rules as R
from filecensus.operators import secrets

#: Characters or bytes that a chunk repeats of the next one.
OVERLAP = 65_536
CHUNK = 1 << 20


def keyword_set(content: Column, keywords: list[str]) -> Column:
    """The keywords (at most 63) that occur in the lower-cased text, one bit each."""

    def bits(lowered: Column) -> Column:
        held = [F.when(F.contains(lowered, F.lit(k)), F.lit(1 << n)).otherwise(F.lit(0)) for n, k in enumerate(keywords)]
        return reduce(lambda a, b: a.bitwiseOR(b), held).cast("long")

    return text.let(F.lower(content), bits)


def _seen(column: str, limit: int | None) -> Column:
    """What a rule sees of a chunk: all, or the beginning of the first chunk, which must reach that far."""
    if limit is None:
        return F.col(column)
    return F.when(F.col("start") == 0, F.substr(F.col(column), F.lit(1), F.lit(limit)))


def facts(chunks: DataFrame, keys: list[str], rules: R.Rules) -> DataFrame:
    """What the content rules found in each file: ``keys`` plus one column per finding.

    ``chunks`` has ``keys``, ``start`` (0 for a file's first chunk), ``text`` and ``raw``; either may be NULL.
    """
    window = rules.window
    words = _seen("text", window.keyword_chars)
    opening = F.when(F.col("start") == 0, F.substr(F.col("raw"), F.lit(1), F.lit(len(R.SQLITE_MAGIC))))
    database = F.decode(_seen("raw", window.database_bytes), "ISO-8859-1")
    tested = chunks.select(
        *keys,
        keyword_set(words, R.AGENT_KEYWORDS).alias("agent_set"),
        keyword_set(words, R.SKILL_KEYWORDS).alias("skill_set"),
        keyword_set(_seen("text", window.yaml_chars), R.AI_KEYWORDS).alias("yaml_set"),
        text.contains_any(database, R.VECTOR_DB_WORDS).alias("vector_word"),
        secrets.any_rule(_seen("text", window.secret_chars), rules).alias("secret_text"),
        opening.alias("opening"),
    )
    return tested.groupBy(*keys).agg(
        *[F.bit_or(c).alias(c) for c in ("agent_set", "skill_set", "yaml_set")],
        *[F.bool_or(c).alias(c) for c in ("vector_word", "secret_text")],
        F.max("opening").alias("opening"),
    )


FACTS = ["agent_set", "skill_set", "yaml_set", "vector_word", "secret_text", "opening"]


def tests() -> dict[str, Column]:
    """The tests that classification asks for, from the columns of ``facts``; a file without chunks passes none."""
    opening = F.hex("opening")
    known = lambda test: F.coalesce(test, F.lit(False))
    magic = [F.startswith(opening, F.lit(word.encode().hex().upper())) for word in R.BINARY_MAGIC]
    counted = {
        name: known(F.bit_count(f"{name}_set") >= R.KEYWORD_THRESHOLD) for name in ("agent", "skill", "yaml")
    }
    return counted | {
        "magic": known(reduce(lambda a, b: a | b, magic)),
        "sqlite": known(opening == R.SQLITE_MAGIC.encode().hex().upper()),
        "vector": known(F.col("vector_word")),
    }


def text_chunks(rows: DataFrame, keys: list[str], content: str, raw: str | None, size: int, overlap: int) -> DataFrame:
    """Chunks of texts (and bytes) that stand in a column, ``size`` long and ``overlap`` more."""
    length = F.greatest(F.length(content), F.length(raw)) if raw else F.length(content)
    last = F.greatest(F.coalesce(length, F.lit(0)) - 1, F.lit(0))
    starts = F.sequence(F.lit(0), (last / size).cast("int")).alias("starts")
    part = lambda c: F.substr(F.col(c), F.col("start") + 1, F.lit(size + overlap))
    placed = rows.select(*keys, content, *([raw] if raw else []), F.explode(starts).alias("n"))
    placed = placed.withColumn("start", F.col("n") * size)
    return placed.select(
        *keys, "start", part(content).alias("text"), (part(raw) if raw else F.lit(None).cast("binary")).alias("raw")
    )
