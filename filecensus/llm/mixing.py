"""Mix sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecensus.llm.shared import stored, words_of

#: Draws are dealt into 16^DIGITS bins per source when the cut is looked for.
DIGITS = 4


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def draw_of(doc_id: Column, size: Column, seed: str) -> Column:
    """The seeded place of a row in its source: hexadecimal text, evenly spread, the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string")))


def source_targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Adds the target words of each source (source, source_size) by water-filling.

    All sizes together are dealt out by weight.  A source whose share exceeds ``max_epochs`` times its size is
    clamped there and the excess is shared again, by weight, until none is above: each round is one
    aggregation to a single row, and a round clamps at least one more source.
    """
    # Ranks in code point order without one task that holds all sources: sorted
    # partitions are numbered and offset by the sizes of those before.
    ordered = stored(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources"
    )
    parts = ordered.groupBy("part").count()
    offsets = parts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = stored(
        ordered.join(F.broadcast(offsets), "part").select(
            "source", "source_size",
            F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).alias("weight"),
        ),
        "weights",
    )
    cap = (F.col("source_size") * max_epochs).cast("double")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        # clamped sources are those whose cap the level of the round before has reached
        above = F.lit(False) if clamped < 0 else F.col("weight") * F.lit(level) > cap
        row = weighed.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if row[0] == clamped:
            break
        clamped = row[0]
        level = (total - max_epochs * (row[1] or 0)) / row[2] if row[2] else float("inf")
    return weighed.withColumn("target", F.when(F.col("source_size") > 0, F.least(F.col("weight") * F.lit(level), cap)).otherwise(0.0))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` with the columns size, source_size, target and taken.

    size is the number of words (a null or blank text: 0), target the words its source is to give, taken
    the words the mix takes of this row.  Every row of a source is taken whole as often as the target
    goes into the source; what is left over goes to rows in the order of seeded draws, the last of them
    in part, so that the taken words of a source add up to its target.  Rows that share
    id and size share a draw and divide its part evenly.  A null source is a source of its own, the last one;
    clashing column names of ``docs`` are replaced.
    """
    docs = docs.withColumn("size", word_count(F.col("text")))
    docs = docs.withColumn("draw", draw_of(F.col("doc_id"), F.col("size"), seed))
    sizes = stored(docs.select("source", "size", "draw"), "sizes")
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("repeats", whole.cast("long")).withColumn(
        "rest", F.floor("target") - F.col("repeats") * F.col("source_size")
    )
    # The bin, then the draw, at which the rest of the target is used up.
    bins = sizes.groupBy("source", F.substring("draw", 1, DIGITS).alias("bin")).agg(F.sum("size").alias("words"))
    until = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    goals = targets.select(F.col("source").alias("goal_source"), "rest")
    same = F.col("source").eqNullSafe(F.col("goal_source"))
    cut_bins = (
        bins.withColumn("before", until - F.col("words")).join(goals, same)
        .where("before <= rest AND rest < before + words").select(F.col("source").alias("cut_source"), F.col("bin").alias("cut_bin"), "before", "rest")
    )
    inside = (
        sizes.withColumn("bin", F.substring("draw", 1, DIGITS))
        .join(cut_bins, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("bin") == F.col("cut_bin")))
        .groupBy("source", "draw").agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    )
    so_far = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("draw")) - F.col("words")
    cuts = (
        inside.withColumn("so_far", so_far).where("so_far <= rest AND rest < so_far + words")
        .select(F.col("source").alias("cut_source"), F.col("draw").alias("cut"), F.floor((F.col("rest") - F.col("so_far")) / F.col("rows")).alias("part"))
    )
    plan = stored(
        targets.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
        .select(F.col("source").alias("plan_source"), "source_size", "target", "repeats", "cut", "part"),
        "plan",
    )
    extra = F.when(F.col("draw") < F.col("cut"), F.col("size")).when(F.col("draw") == F.col("cut"), F.col("part")).otherwise(0)
    names = [c for c in docs.columns if c not in ("source_size", "target", "taken", "draw", "size")]
    return docs.select(*names, "size", "draw").join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select(
        *names, "size", "source_size", "target", (F.col("repeats") * F.col("size") + extra).cast("long").alias("taken")
    )
