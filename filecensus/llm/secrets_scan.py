"""Secrets in texts: fixed patterns, and random-looking strings found by two Markov models.

One first-order character model is learned from random strings, one from ordinary identifiers; a string
whose log-likelihood under the first exceeds that under the second by a margin is a secret.
Everything runs as column expressions; the models are one literal array of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern and group of the value whose length counts, with the least length, in the order of kinds.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (
        r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
        r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
        2,
        6,
    ),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"((?<![0-9a-f])[0-9a-f]{24,})", 1, 24),
}
LEARNED = "random"
ORDER = [*KINDS, LEARNED]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings of the alphabet that the models judge have at least this many characters.
LEAST = 16
CANDIDATE = rf"((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}})"
#: Least log-likelihood ratio, in nats, of a string and per character.
MARGIN, PER_CHARACTER = 8.0, 0.25
#: About so many documents give samples to the models.
SAMPLE_DOCS = 4000

SPAN = "struct<kind:string,start:int,end:int>"
NO_SPANS = f"CAST(array() AS array<{SPAN}>)"


def spans_of(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Leftmost non-overlapping matches whose group is long enough, as places in code points.

    The texts between matches come from splitting at them, so places are running sums of lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("full"), values.alias("value")
    )
    empty = F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("spans"))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.length(piece["full"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
        fits = F.length(piece["value"]) >= least
        return F.struct(end.alias("at"), F.when(fits, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(pieces, empty, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), found).otherwise(F.expr(NO_SPANS))


# --- the two models ----------------------------------------------------------------------


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of each character after each other, row by row, from (sample, label).

    Label 1 marks random strings, 0 ordinary ones.  Counts are one aggregation with at most
    2 * 68 * 67 rows; one is added to every count, so unseen pairs and an empty class are defined.
    """
    size = len(ALPHABET)
    kept = samples.select(F.regexp_replace("sample", "[^A-Za-z0-9+/_=-]", "").alias("sample"), "label").where("length(sample) > 0")
    pairs = kept.select(
        "label",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.length("sample")),
                lambda i: F.struct(
                    F.when(i > 1, F.substring("sample", i - 1, F.lit(1))).otherwise("").alias("a"), F.substring("sample", i, F.lit(1)).alias("b")
                ),
            )
        ).alias("pair"),
    )
    counts = [{}, {}]
    for row in pairs.groupBy("label", "pair.a", "pair.b").count().collect():
        counts[row["label"]][row["a"], row["b"]] = row["count"]
    ratios = []
    for a in ["", *ALPHABET]:
        sums = [sum(counts[k].get((a, b), 0) for b in ALPHABET) for k in (0, 1)]
        for b in ALPHABET:
            p = [math.log((counts[k].get((a, b), 0) + 1) / (sums[k] + size)) for k in (0, 1)]
            ratios.append(p[1] - p[0])
    return ratios


def corpus_samples(docs: DataFrame) -> DataFrame:
    """Labelled samples: words of about SAMPLE_DOCS documents, and as many digests of those words.

    A word that a fixed pattern would take as a secret is no ordinary sample.  Digests are random by
    construction; they come as hexadecimal, as base 64 and as upper case, as keys do.
    """
    total = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < F.lit(min(1 << 20, (SAMPLE_DOCS << 20) // max(total, 1) + 1)))
    words = chosen.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z0-9+/_=-]{4,})"), F.lit(1)))).alias("word"))
    words = words.groupBy("word").count().select("word")
    secret = F.lit(False)
    for pattern, _, _ in KINDS.values():
        secret = secret | F.col("word").rlike(pattern)
    digest = F.sha2("word", 256)
    made = F.array(F.substring(digest, 1, 32), F.rtrim(F.translate(F.base64(F.unhex(digest)), "=", "")), F.upper(F.translate(F.base64(F.unhex(F.sha2(F.upper("word"), 256))), "+/=", "")))
    ordinary = words.where(~secret).select(F.col("word").alias("sample"), F.lit(0).alias("label"))
    return ordinary.union(words.select(F.explode(made).alias("sample"), F.lit(1).alias("label")))


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string of the alphabet under the two models."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    size = len(ALPHABET)
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    total = F.aggregate(
        codes,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, c: F.struct((acc["sum"] + F.element_at(table, acc["last"] * size + c)).alias("sum"), c.alias("last")),
    )
    return total["sum"]


# --- the operator ------------------------------------------------------------------------


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """``docs`` with base, the spans of the fixed patterns, and spans, those and the learned ones.

    spans are sorted by start, then kind.  Learned spans (kind ``random``) touch no base span.  A null or
    empty text has none.  Columns named base or spans are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [c for c in docs.columns if c not in ("base", "spans")]
    rows = docs.select(*keep, text.alias("_text"))
    rows = rows.select(
        *keep, "_text", *(spans_of(F.col("_text"), *rule, kind).alias(f"_{kind}") for kind, rule in KINDS.items()),
        spans_of(F.col("_text"), CANDIDATE, 1, LEAST, LEARNED).alias("_candidates"),
    )
    rows = rows.withColumn("base", F.concat(*(f"_{k}" for k in KINDS))).drop(*(f"_{k}" for k in KINDS))
    free = F.filter(
        "_candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    )
    rows = rows.withColumn("_free", F.when(F.size("_candidates") > 0, free).otherwise(F.col("_candidates"))).drop("_candidates")

    def random(span: Column) -> Column:
        value = F.substring(F.col("_text"), span["start"] + 1, span["end"] - span["start"])
        score = ratio(value, model)
        return (score >= MARGIN) & (score >= PER_CHARACTER * F.length(value))

    rows = rows.withColumn("_learned", F.when(F.size("_free") > 0, F.filter("_free", random)).otherwise(F.col("_free")))
    return rows.select(*keep, in_order(F.col("base")).alias("base"), in_order(F.concat("base", "_learned")).alias("spans"))


def in_order(spans: Column) -> Column:
    """Spans by start, then kind in the order of KINDS."""
    place = F.array(*map(F.lit, ORDER))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("place"), s.alias("span")))
    return F.transform(F.sort_array(keyed), lambda k: k["span"])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by the mark; overlapping spans share one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in text and n_chars (if there) counted again; no row is lost."""
    found = scan(docs, train(corpus_samples(docs))).withColumn("text", masked(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", n_chars)
    return found.select(*docs.columns)
