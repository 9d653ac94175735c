"""Embedded-secret scan."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecensus.functions import text
from filecensus.operators import rules as R


def scannable() -> Column:
    """Classified files that are not flagged yet and not of a binary category."""
    binary = text.strings(R.NOT_SCANNED_FOR_SECRETS)
    return (
        F.col("categories").isNotNull()
        & (F.col("risk_level") != "danger")
        & ~F.arrays_overlap("categories", binary)
    )


# Letters that match s and i without regard to case but are not lower-cased to them.
ODD_LETTERS = ["ſ", "ı"]


def _with_tests(seen: Column, rules: R.Rules, combine) -> Column:
    """``combine`` of one test per rule on the text.

    Most texts hold none of a rule's anchor words, which a substring search on the
    lower-cased text finds out many times faster than the regex; the regex decides the rest.
    """

    def tests(lowered: Column) -> Column:
        odd = F.contains(lowered, F.lit(ODD_LETTERS[0])) | F.contains(lowered, F.lit(ODD_LETTERS[1]))
        found = []
        for name, regex in rules.secrets:
            hit = text.matches(seen, regex)
            anchors = R.SECRET_ANCHORS.get(name) if (name, regex) in R.SECRET_CONTENT else None
            if anchors:
                likely = [F.contains(lowered, F.lit(word)) for word in anchors]
                hit = (reduce(or_, likely) | odd) & hit
            found.append(hit)
        return combine(found)

    return text.let(F.lower(seen), tests)


def any_rule(seen: Column, rules: R.Rules) -> Column:
    """Does some secret rule match the text?"""
    return _with_tests(seen, rules, lambda tests: reduce(or_, tests))


def flag_embedded_secrets(files: DataFrame, rules: R.Rules | None = None, found: Column | None = None) -> DataFrame:
    """Raise files whose text matches a secret rule to danger.

    The cheap guard stands first, so texts are searched only for rows that can change.  ``found``
    says whether a rule matches where that was worked out before, else ``head`` is searched.
    """
    rules = rules or R.Rules()
    if found is None:
        found = any_rule(text.first_chars(F.col("head"), rules.window.secret_chars), rules)
    return (
        files.withColumn("_embedded", F.when(scannable(), F.coalesce(found, F.lit(False))).otherwise(F.lit(False)))
        .withColumns(
            {
                "risk_level": F.when(F.col("_embedded"), "danger").otherwise(F.col("risk_level")),
                "risk_reason": F.when(F.col("_embedded"), R.EMBEDDED_SECRET_REASON).otherwise(
                    F.col("risk_reason")
                ),
            }
        )
        .drop("_embedded")
    )


def secret_hits(rows: DataFrame, text_col: str, rules: R.Rules | None = None) -> DataFrame:
    """One row per input row and matching rule, with ``rule_id`` added."""
    rules = rules or R.Rules()
    names = [name for name, _ in rules.secrets]
    seen = text.first_chars(F.col(text_col), rules.window.secret_chars)
    ids = _with_tests(
        seen, rules, lambda tests: F.array(*[F.when(t, F.lit(n)) for n, t in zip(names, tests)])
    )
    return rows.withColumn("rule_id", F.explode(F.array_compact(ids))).drop(text_col)


def secret_rule_counts(rows: DataFrame, text_col: str, group: str, rules: R.Rules | None = None) -> DataFrame:
    """Rows matching each rule per ``group``, rules without a match included, in one pass."""
    rules = rules or R.Rules()
    names = [name for name, _ in rules.secrets]
    seen = text.first_chars(F.col(text_col), rules.window.secret_chars)
    flags = _with_tests(seen, rules, lambda tests: F.array(*tests))
    tested = rows.select(group, flags.alias("_flags"))
    counts = [F.count_if(F.col("_flags")[i]).alias(name) for i, name in enumerate(names)]
    return tested.groupBy(group).agg(*counts).unpivot(group, names, "rule_id", "n_rows")
