"""Exact Jaccard self-join on word shingles by prefix index lists and set relations.

A set's shingles are put in one global order (shingles seen often go last) and only the
first ones enter the index, so that two similar sets always share an entry.  Three set
relations keep the work near the number of links:

* equal sets are one class, whatever the number of documents;
* the answers of a set come from a highly similar set: every list proposes its members to one
  pivot, and what is known of the pivots bounds the overlap of any two of their members;
* lists whose members are connected already are skipped whole; size blocks serve the choice of
  further pivots only, and the last join meets all pairs of the other lists and filters them by size and position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filecensus.llm import kernel
from filecensus.llm.components import components
from filecensus.llm.shared import release, row_key, stored

#: At most this many shingles count as frequent; see ``frequent_shingles``.
FREQUENT_BOUND = 1 << 20
LEAST_FREQUENT = 32
TOKEN_BITS = np.uint64((1 << 63) - 1)
HOT_BIT = np.uint64(1 << 63)
#: Parity bits of a set, 64 in each column.
LANES = 4
BITS = [f"bits{lane}" for lane in range(LANES)]
#: Further pivots of a list; they only save single comparisons, which come after them anyway.
PIVOTS = 3
#: First entries of a set by which a pair that was met before is known again; the few others are told apart later.
KNOWN_AGAIN = 8
#: Size of the bit table that tells wanted sets apart.
SPOTS = 1 << 22


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per block: first row, all 63-bit shingle hashes in row order, bounds by row."""
    for block in kernel.blocks(column):
        found = kernel.words(block)
        hashes = kernel.word_hashes(block, found)
        counts = np.diff(found.bounds)
        grams = kernel.shingle_hashes(hashes, width)
        # Rows with enough words take each full window, shorter ones their whole sequence.
        pieces = []
        for r in np.flatnonzero(counts):
            low, high = found.bounds[r], found.bounds[r + 1]
            if counts[r] >= width:
                pieces.append((r, np.unique(grams[low : high - width + 1] & TOKEN_BITS)))
            else:
                whole = kernel.shingle_hashes(hashes[low:high], int(counts[r])) ^ kernel.mix(counts[r : r + 1].astype(np.uint64))
                pieces.append((r, whole & TOKEN_BITS))
        sizes = np.zeros(block.rows, dtype=np.int64)
        for r, piece in pieces:
            sizes[r] = len(piece)
        tokens = np.concatenate([p for _, p in pieces]) if pieces else np.zeros(0, np.uint64)
        yield block.first, tokens, np.concatenate(([0], np.cumsum(sizes)))


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of shingles that many documents hold; only the order depends on them.

    Each task reports the shingles it meets in two or more documents of a block.  The total
    of all counts is at most the number of shingles, so a threshold of total / FREQUENT_BOUND
    proves the bound of what the driver holds and broadcasts (8 MB).
    """

    def repeated(batches):
        for batch in batches:
            for _, tokens, _ in _sets(batch.column(0), width):
                ordered = np.sort(tokens)
                first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
                counts = np.diff(np.concatenate((first, [len(ordered)])))
                many = counts >= 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ordered[first][many].view(np.int64)), pa.array(counts[many].astype(np.int64))],
                    names=["token", "c"],
                )

    counted = stored(
        docs.select("text").mapInArrow(repeated, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
        .where(F.col("c") >= LEAST_FREQUENT),
        "frequent",
    )
    total = counted.agg(F.sum("c")).first()[0] or 0
    least = max(LEAST_FREQUENT, -(-total // FREQUENT_BOUND))
    found = counted.where(F.col("c") >= least).select("token").toArrow().column("token").to_numpy()
    return np.sort(found.astype(np.int64)).view(np.uint64)


def prefix_index(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, set_id, n, prefix, bits): size, first shingles in the global order and parity bits of each document's set.

    A partner of a set of n holds at least ceil(percent * n / 100) of its shingles, so the
    first n - that + 1 in a common order hold a shared one.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, width))

    def index(batches):
        hot = frequent.value
        for batch in batches:
            fps, sizes, prefixes, bits = [], [], [], [[] for _ in range(LANES)]
            for _, tokens, bounds in _sets(batch.column(1), width):
                if len(hot) and len(tokens):
                    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                    tokens = tokens | np.where(hot[at] == tokens, HOT_BIT, np.uint64(0))
                mixed = np.concatenate(([np.uint64(0)], np.cumsum(kernel.mix(tokens & TOKEN_BITS))))
                size = np.diff(bounds)
                fps.append(kernel.mix((mixed[bounds[1:]] - mixed[bounds[:-1]]) ^ (size.astype(np.uint64) << np.uint64(40))))
                sizes.append(size)
                for lane, own in enumerate(parities(tokens & TOKEN_BITS, bounds)):
                    bits[lane].append(own)
                keep = np.where(size > 0, size - -(-size * percent // 100) + 1, 0)
                for r in range(len(size)):
                    own = np.sort(tokens[bounds[r] : bounds[r + 1]])[: keep[r]]
                    prefixes.append((own & TOKEN_BITS).view(np.int64))
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)),
                    pa.array(np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)),
                    kernel.lists(flat, ends),
                    *(pa.array(np.concatenate(b).view(np.int64) if b else np.zeros(0, np.int64)) for b in bits),
                ],
                names=["doc_id", "set_id", "n", "prefix", *BITS],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        index, f"doc_id {kind}, set_id long, n long, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS)
    )


def parities(tokens: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Per row, for each of 64 * LANES residues, whether an odd number of tokens has it.

    Sets that differ in d shingles differ in at most d of these bits.
    """
    out = []
    for lane in range(LANES):
        own = np.where((tokens >> np.uint64(6)) % np.uint64(LANES) == lane, np.uint64(1) << (tokens & np.uint64(63)), np.uint64(0))
        sums = np.bitwise_xor.accumulate(own) if len(own) else own
        sums = np.concatenate(([np.uint64(0)], sums))
        out.append(sums[bounds[1:]] ^ sums[bounds[:-1]])
    return out


def set_rows(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(set_id, tokens) of every document whose set may be one of ``wanted`` (set_id).

    A bit table of fixed size tells most other documents apart where they are read, so no text is shuffled.
    """
    spots = wanted.select(F.pmod("set_id", F.lit(SPOTS)).alias("spot")).distinct().toArrow().column("spot").to_numpy()
    table = np.zeros(SPOTS, dtype=bool)
    table[spots] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(table))

    def whole(batches):
        table = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for _, tokens, bounds in _sets(batch.column(0), width):
                mixed = np.concatenate(([np.uint64(0)], np.cumsum(kernel.mix(tokens))))
                size = np.diff(bounds)
                fps = kernel.mix((mixed[bounds[1:]] - mixed[bounds[:-1]]) ^ (size.astype(np.uint64) << np.uint64(40))).view(np.int64)
                keep = np.flatnonzero(table[fps % SPOTS] & (size > 0))
                flat = [tokens[bounds[r] : bounds[r + 1]] for r in keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(fps[keep]),
                        kernel.lists(np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum(size[keep])))),
                    ],
                    names=["set_id", "tokens"],
                )

    return docs.select("text").mapInArrow(whole, "set_id long, tokens array<long>")


def linked(overlap: Column, n1: Column, n2: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def needed(n1: Column, n2: Column, percent: int) -> Column:
    """Least overlap of two sets of these sizes that link."""
    return F.ceil((percent * (n1 + n2)) / (100 + percent))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds the exact overlap o of the sets x and y of each pair."""
    left = pairs.join(sets.select(F.col("set_id").alias("y"), F.col("tokens").alias("ty")), "y")
    both = left.join(sets.select(F.col("set_id").alias("x"), F.col("tokens").alias("tx")), "x")
    return both.withColumn("o", F.size(F.array_intersect("tx", "ty")).cast("long")).drop("tx", "ty")


def still_possible(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y, nx, ny, ...) whose prefixes do not rule a link out.

    Of two prefixes, the one that ends first in the common order has nothing outside the other
    prefix that the other set could still hold, so the overlap is at most that set's size
    less what its prefix does not share.
    """
    shared = F.size(F.array_intersect("tx", "ty"))
    bound = F.greatest(F.col("nx") - F.size("tx"), F.col("ny") - F.size("ty")) + shared
    left = pairs.join(prefixes.select(F.col("set_id").alias("y"), F.col("prefix").alias("ty")), "y")
    both = left.join(prefixes.select(F.col("set_id").alias("x"), F.col("prefix").alias("tx")), "x")
    return both.where(bound >= needed(F.col("nx"), F.col("ny"), percent)).drop("tx", "ty")


def set_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) of every row of ``docs`` (doc_id, text).

    A set is the distinct ``width``-word shingles of the lower-cased text, the whole sequence
    if it has fewer words; sets link when 100 * overlap >= percent * union, and component_id is the
    least doc_id that links reach.  A null, empty or blank text has no set, n_shingles 0 and
    itself as component; repeated rows and rows with a null id take part like any other; equal
    texts have equal sets and link.
    """
    index = stored(prefix_index(docs, width, percent), "prefixes")
    members = index.select("doc_id", "set_id", "n")
    prefixes = index.where("n > 0").groupBy("set_id", "n").agg(F.any_value("prefix").alias("prefix"))
    lists = prefixes.select("set_id", "n", F.posexplode("prefix").alias("pos", "token"))
    by_token = Window.partitionBy("token")
    # A list with one set links nothing.  The least set_id is the pivot of its list.
    lists = stored(
        lists.withColumn("pivot", F.min(F.struct("set_id", "n")).over(by_token))
        .withColumn("last", F.max("set_id").over(by_token))
        .where(F.col("pivot.set_id") != F.col("last"))
        .select("token", "set_id", "n", "pos", F.col("pivot.set_id").alias("pivot"), F.col("pivot.n").alias("pivot_n")),
        "lists",
    )
    company = stored(prefixes.join(lists.select("set_id").distinct(), "set_id", "left_semi"), "company")

    def whole_sets(wanted: DataFrame) -> DataFrame:
        """Sets that pairs ask for."""
        wanted = stored(wanted, "wanted")
        found = set_rows(docs, width, wanted).join(wanted, "set_id", "left_semi")
        return stored(found.groupBy("set_id").agg(F.any_value("tokens").alias("tokens")), "sets")

    def ends(pairs: DataFrame, *columns: str) -> DataFrame:
        found = pairs.select(F.col(columns[0]).alias("set_id")).distinct()
        for c in columns[1:]:
            found = found.union(pairs.select(c).distinct())
        return found.distinct()

    small, large = F.least("n", "pivot_n"), F.greatest("n", "pivot_n")
    proposed = (
        lists.where((F.col("set_id") != F.col("pivot")) & (100 * small >= percent * large))
        .select(F.col("set_id").alias("x"), F.col("pivot").alias("y"), F.col("n").alias("nx"), F.col("pivot_n").alias("ny"))
        .distinct()
    )
    star_pairs = stored(still_possible(proposed, company, percent), "star-pairs")
    sets = whole_sets(ends(star_pairs, "x", "y"))

    def with_sets(pairs: DataFrame, *columns: str) -> DataFrame:
        """All sets read so far and those that the pairs ask for besides."""
        return sets.union(whole_sets(ends(pairs, *columns).join(sets, "set_id", "left_anti")))

    is_link = linked(F.col("o"), F.col("nx"), F.col("ny"), percent)
    stars = stored(overlaps(star_pairs, sets), "stars").where(is_link)
    known = stored(components(stars.select(F.col("x").alias("a"), F.col("y").alias("b"))), "known")

    # Each set's best pivot, and how many of its shingles that pivot lacks; its own without one.
    best = (
        stars.groupBy("x").agg(F.max_by(F.struct("y", (F.col("nx") - F.col("o")).alias("extra")), F.struct("o", "y")).alias("best"))
        .select(F.col("x").alias("set_id"), F.col("best.y").alias("center"), F.col("best.extra").alias("extra"))
    )
    centered = stored(
        lists.select("token", "set_id", "n", "pos").join(best, "set_id", "left")
        .withColumn("center", F.coalesce("center", "set_id")).withColumn("extra", F.coalesce("extra", F.lit(0)))
        .withColumn("block", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)),
        "centered",
    )
    release(lists)

    def mixed_lists() -> DataFrame:
        """Lists that hold more than one component; the others are skipped."""
        placed = centered.join(known.withColumnRenamed("vertex", "set_id"), "set_id", "left")
        placed = placed.withColumn("component", F.coalesce("component", "set_id"))
        ends_of = placed.withColumn("low", F.min("component").over(by_token)).withColumn("high", F.max("component").over(by_token))
        return ends_of.where("low <> high").drop("low", "high")

    def entered(n1: str, pos1: str, n2: str, pos2: str) -> Column:
        """Sizes and places in the two sets still allow a link."""
        sizes = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
        return sizes & (F.least(F.col(n1) - F.col(pos1), F.col(n2) - F.col(pos2)) >= needed(F.col(n1), F.col(n2), percent))

    # Components join by further pivots of each list and size block, before single pairs are met.
    by_block = Window.partitionBy("token", "near")
    blocked = mixed_lists().withColumn("near", F.explode(F.array("block", F.col("block") - 1)))
    pivots = F.array(
        *(F.min(F.struct(F.xxhash64("token", "set_id", F.lit(k)).alias("h"), "set_id", "n", "pos", "component")).over(by_block) for k in range(PIVOTS))
    )
    offered = (
        blocked.withColumn("pivots", F.array_distinct(pivots)).withColumn("p", F.explode("pivots"))
        .select("set_id", "n", "pos", "component", F.col("p.set_id").alias("y"), F.col("p.n").alias("ny"), F.col("p.pos").alias("py"), F.col("p.component").alias("cy"))
        .where((F.col("component") != F.col("cy")) & entered("n", "pos", "ny", "py"))
        .select(F.col("set_id").alias("x"), "y", F.col("n").alias("nx"), "ny").distinct()
    )
    pairs = stored(still_possible(offered, company, percent), "pairs")
    sets = with_sets(pairs, "x", "y")
    links = overlaps(pairs, sets).where(is_link).select(F.col("x").alias("a"), F.col("y").alias("b"))
    known = stored(components(known.select(F.col("vertex").alias("a"), F.col("component").alias("b")).union(links)), "known")

    # A pair is kept where it is met first: no later entry is, if its first shared entry is among the first of both.
    parity = index.where("n > 0").groupBy("set_id").agg(*(F.any_value(b).alias(b) for b in BITS))
    first = company.select("set_id", F.slice("prefix", 1, KNOWN_AGAIN).alias("first"))
    placed = mixed_lists().join(parity, "set_id").join(first, "set_id")
    placed = stored(placed.withColumn("earlier", F.slice("first", F.lit(1), F.least("pos", F.lit(KNOWN_AGAIN)))).drop("first"), "placed")
    members = stored(members, "members")
    release(centered)
    release(index)

    def side(name: str, frame: DataFrame) -> DataFrame:
        kept = ("set_id", "n", "pos", "component", "center", "extra", "earlier", *BITS)
        return frame.select("token", *(F.col(c).alias(f"{c}_{name}") for c in kept))

    # Bits in which two sets differ are shingles that only one of them has.
    apart = sum(F.bit_count(F.col(f"{b}_x").bitwiseXOR(F.col(f"{b}_y"))) for b in BITS)
    entries = (
        side("x", placed).join(side("y", placed), "token")
        .where(apart <= F.col("n_x") + F.col("n_y") - 2 * needed(F.col("n_x"), F.col("n_y"), percent))
        .where((F.col("component_x") != F.col("component_y")) & entered("n_x", "pos_x", "n_y", "pos_y"))
        .where((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("set_id_x") < F.col("set_id_y"))))
        .where(~F.arrays_overlap("earlier_x", "earlier_y"))
        .select(
            F.col("set_id_x").alias("x"), F.col("set_id_y").alias("y"), F.col("n_x").alias("nx"), F.col("n_y").alias("ny"),
            F.col("center_x").alias("cx"), F.col("center_y").alias("cy"), F.col("extra_x").alias("ex"), F.col("extra_y").alias("ey"),
        )
        .distinct()
    )
    crossing = stored(still_possible(entries, company, percent), "crossing")
    sets = with_sets(crossing, "x", "y", "cx", "cy")
    # An overlap of members is at most that of their pivots plus what each pivot lacks.
    centers = stored(overlaps(crossing.select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct(), sets), "centers")
    open_pairs = (
        crossing.join(centers.select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("o").alias("between")), ["cx", "cy"])
        .where(F.col("between") + F.col("ex") + F.col("ey") >= needed(F.col("nx"), F.col("ny"), percent))
        .select("x", "y", "nx", "ny")
    )
    links = overlaps(open_pairs, sets).where(is_link)
    joined = components(known.select(F.col("vertex").alias("a"), F.col("component").alias("b")).union(links.select("x", "y")))
    labelled = members.join(joined.withColumnRenamed("vertex", "set_id"), "set_id", "left").withColumn(
        "component", F.when(F.col("n") > 0, F.coalesce("component", "set_id"))
    )
    least = labelled.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least_id"))
    return labelled.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "set_id",
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"),
    )


def one_per_component(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that another row of their component stands for.

    The row with the least doc_id stays, of rows of a component that repeat its id one; rows are told apart by
    id and text, so a row whose id comes again in another component is judged by its own.  Rows without
    words and rows with a null id stay as they are.  Columns are kept.
    """
    keyed = docs.where(F.col("doc_id").isNotNull()).select(row_key().alias("doc_id"), "text")
    found = stored(set_components(keyed, width, percent).where("n_shingles > 0"), "found")
    dropped = found.where("component_id <> doc_id").select("doc_id").distinct()
    again = found.groupBy("doc_id").count().where("count > 1").select("doc_id").join(dropped, "doc_id", "left_anti")
    once = docs.join(again.select(F.col("doc_id").alias("gone")), row_key() == F.col("gone"), "left_semi").dropDuplicates(["doc_id", "text"])
    rest = docs.join(dropped.union(again).withColumnRenamed("doc_id", "gone"), row_key() == F.col("gone"), "left_anti")
    return rest.unionByName(once)
