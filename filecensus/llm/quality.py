"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecensus.llm.shared import stored, words_of

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Votes of a rule in a pattern.
GOOD, BAD, NONE = "g", "b", "-"
#: Rule: measure, at most this is a vote for good (None: the rule knows its kind of junk only),
#: at least this a vote for bad.  Otherwise it abstains.
RULES: dict[str, tuple[str, float | None, float]] = {
    "prose": ("try_divide(n_other, word_chars)", 0.10, 0.20),
    "repetition": ("try_divide(n_repeat_words, n_words)", None, 0.30),
    "symbols": ("try_divide(n_symbols, n_words)", None, 0.10),
    "lines": ("try_divide(n_dup_lines, n_lines)", None, 0.40),
    "upper": ("try_divide(n_upper, word_chars)", None, 0.40),
    "marks": ("try_divide(n_marks, n_words)", None, 0.30),
    "variety": ("1 - try_divide(n_distinct, n_words)", None, 0.90),
    "length": ("abs(try_divide(word_chars, n_words) - 5.5)", None, 6.0),
}
WINDOW = 3


def _without(characters: str) -> Column:
    return F.length("text") - F.length(F.translate("text", characters, ""))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures of each text (a null text is empty), one pass, no shuffle.

    n_repeat_words: the hashes of all three-word windows are sorted with their places, equal
    neighbours give the repeated windows, and the words they cover are counted in text order.
    """
    names = [c for c in docs.columns if c not in MEASURES and c != "text"]
    keep = [F.col(c) for c in names]
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(*keep, text, F.col("text").alias("own_text")).select(
        *names, "own_text", "text", words_of(F.col("text")).alias("words"), lines.alias("lines"),
        _without(SYMBOLS).cast("long").alias("n_symbols"), _without(UPPER).cast("long").alias("n_upper"), _without("!?").cast("long").alias("n_marks"),
        F.length(F.regexp_replace("text", r"[\p{L}\x20\x09-\x0D]+", "")).alias("n_other"),
    )
    at = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    windows = F.when(
        F.size("words") > WINDOW,
        F.transform(at, lambda i: F.xxhash64(*(F.element_at("words", (i + k).cast("int")) for k in range(WINDOW)))),
    )
    second = first.select(
        "*", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"), windows.alias("windows"),
    ).drop("words", "lines")
    third = second.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    size = F.size("sorted")
    repeated = F.transform(
        "sorted",
        lambda x, j: F.when(
            ((j > 0) & (F.get("sorted", j - 1)["h"] == x["h"])) | ((j < size - 1) & (F.get("sorted", j + 1)["h"] == x["h"])), x["i"]
        ),
    )
    fourth = third.withColumn("starts", F.sort_array(F.filter(repeated, lambda i: i.isNotNull()))).drop("sorted")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"), i.alias("last")),
        lambda acc: acc["total"],
    )
    fifth = fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("starts", "text")
    return fifth.withColumnRenamed("own_text", "text")


def failed_base() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> Column:
    """One letter per rule; a measure without a value (an empty text) abstains."""
    cast = [
        F.when(F.lit(False) if good is None else F.expr(measure) <= good, GOOD).when(F.expr(measure) >= bad, BAD).otherwise(NONE)
        for measure, good, bad in RULES.values()
    ]
    return F.concat(*cast)


def fit(patterns: list[tuple[str, int]], rounds: int = 60) -> dict[str, float]:
    """Posterior probability of good quality of each vote pattern, by expectation-maximisation.

    ``patterns`` has at most 3 ** len(RULES) rows, whatever the number of documents.  Each rule has a
    table of vote probabilities per class, abstaining included; rules start out believed right 9 to 1.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return {}
    rules = range(len(RULES))
    prior = 0.5
    tables = [{True: {GOOD: 0.72, BAD: 0.08, NONE: 0.2}, False: {GOOD: 0.08, BAD: 0.72, NONE: 0.2}} for _ in rules]
    posterior: dict[str, float] = {}
    for _ in range(rounds):
        for pattern, _n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(tables[r][True][pattern[r]] / tables[r][False][pattern[r]]) for r in rules
            )
            posterior[pattern] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        weight = sum(posterior[p] * n for p, n in patterns)
        prior = min(0.99, max(0.01, (weight + 1) / (total + 2)))
        for r in rules:
            for side in (True, False):
                mass = dict.fromkeys((GOOD, BAD, NONE), 1.0)
                mass[GOOD if side else BAD] += 2.0
                for p, n in patterns:
                    mass[p[r]] += n * (posterior[p] if side else 1 - posterior[p])
                whole = sum(mass.values())
                tables[r][side] = {k: v / whole for k, v in mass.items()}
    return posterior


def judged(rows: DataFrame, posterior: dict[str, float]) -> DataFrame:
    """Adds base_failed, quality (posterior) and kept to rows that have measures and votes."""
    learned = [F.lit(x) for p, q in sorted(posterior.items()) for x in (p, q)]
    quality = F.element_at(F.create_map(*learned), F.col("votes")) if learned else F.lit(None).cast("double")
    return rows.withColumn("base_failed", failed_base()).withColumn("quality", F.coalesce(quality, F.lit(0.5))).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)
    )


def pattern_counts(rows: DataFrame) -> list[tuple[str, int]]:
    return sorted((r["votes"], r["count"]) for r in rows.where("n_words > 0").groupBy("votes").count().collect())


def assess(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, votes, base_failed, quality, kept) of every row of ``docs`` (doc_id, text).

    An empty, blank or null text has no words, fails the base and teaches the rules nothing.
    Repeated rows count as often as they come.
    """
    rows = stored(measured(docs.select("doc_id", "text")).withColumn("votes", votes()).select("doc_id", *MEASURES, "votes"), "votes")
    return judged(rows, fit(pattern_counts(rows)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.

    Rows are written once beside their measures and votes, so no measure is worked out twice.
    """
    renamed = docs.select(F.struct(*map(F.col, docs.columns)).alias("row"), "text")
    rows = measured(renamed).withColumn("votes", votes()).select("row", "n_words", "n_repeat_words", "votes")
    rows = stored(rows, "judged")
    return judged(rows, fit(pattern_counts(rows))).where("kept").select("row.*")
