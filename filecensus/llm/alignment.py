"""Alignment of the tokens of two vocabularies on the same text.

Merge-path partitioning: the byte offsets at which tokens of A and of B end are two sorted lists.
Diagonals through their merge, each found by binary search, divide it into pieces of equal
work that need nothing of each other.  Each piece gives the offsets both lists share; a shared
offset whose two ends lie on both sides of a diagonal is found by the piece behind it.  The
shared offsets of all pieces, stitched, cut the tokens into groups.

How often an id pair is linked in the whole corpus comes from one aggregation.  The pairs
that are met most, as many as a fixed bound allows, travel to every task; the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecensus.llm import kernel, tokens
from filecensus.llm.shared import stored

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Merge steps of a piece.
PIECE_WORK = 1 << 15
#: Pairs that travel to every task, at most: 17 bytes each.
COMMON_PAIRS = 1 << 20


class Vocabulary(NamedTuple):
    """An encoder of slices and the bytes of every id."""

    encode: object
    bytes: list[bytes]

    def spans(self) -> np.ndarray:
        return np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))


def _byte_alphabet() -> dict[str, int]:
    """The character by which a byte-level vocabulary writes each byte: itself if it prints, else one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + n): b for n, b in enumerate(others)}


def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary of the ``tokenizers`` library; slices keep their leading space."""
    tokenizer = tokens.library_tokenizer(path, plain_specials=True)
    alphabet = _byte_alphabet()
    spelled = sorted((i, entry) for entry, i in tokenizer.get_vocab(with_added_tokens=True).items())
    entries = [bytes(alphabet[c] for c in entry) for _, entry in spelled]
    return Vocabulary(tokens.library_encoder(path, plain_specials=True), entries)


def piece_level(path: str) -> Vocabulary:
    """A piece vocabulary with byte pieces, which puts the leading space in itself."""
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)
    count = processor.get_piece_size()
    entries = [
        bytes([int(processor.id_to_piece(i)[3:5], 16)]) if processor.is_byte(i)
        else processor.id_to_piece(i).replace(SPACE_MARK, " ").encode()
        for i in range(count)
    ]
    lone = processor.piece_to_id(SPACE_MARK)  # of a slice that is but the space at a text's end

    def encode(texts: list[str]) -> list[list[int]]:
        return [ids or [lone] for ids in processor.encode([t[1:] for t in texts], num_threads=1)]

    return Vocabulary(encode, entries)


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where diagonals ``work`` merge steps apart cut the merge of two sorted lists: (taken of a, taken of b).

    Equal values are taken from a first.  All diagonals are searched at once, each by bisection of its own.
    """
    total = len(a) + len(b)
    steps = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(steps), dtype=bool)
        at = np.flatnonzero(open_)
        first[at] = a[middle[at]] <= b[steps[at] - 1 - middle[at]]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low, steps - low


def shared_ends(a: np.ndarray, b: np.ndarray, work: int = PIECE_WORK) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of a, of b) of the values that both strictly rising lists hold, found piece by piece."""
    of_a, of_b = diagonals(a, b, work)
    found = [_piece(a, b, *piece) for piece in zip(of_a.tolist(), of_a[1:].tolist(), of_b.tolist(), of_b[1:].tolist())]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(side) for side in zip(*found))


def _piece(a, b, a_low: int, a_high: int, b_low: int, b_high: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlaps of one piece; the value of a just before it may have its equal at the piece's beginning."""
    back = max(0, a_low - 1)
    mine, others = a[back:a_high], b[b_low:b_high]
    at = np.searchsorted(mine, others)
    hit = at < len(mine)
    hit[hit] = mine[at[hit]] == others[hit]
    return back + at[hit], b_low + np.flatnonzero(hit)


class Aligned(NamedTuple):
    """Tokens of a block's rows and their groups; group g ends behind token a_cut[g] of A and b_cut[g] of B."""

    a: np.ndarray
    b: np.ndarray
    a_bounds: np.ndarray  # of the rows
    b_bounds: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    bounds: np.ndarray  # groups of the rows


class Aligner:
    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.vocabularies = a, b
        self.spans = a.spans(), b.spans()
        if not all(s.all() for s in self.spans):
            raise ValueError("a token without bytes has no end of its own")
        self.known = tokens.SliceIds(a.encode, b.encode)

    def align(self, block: kernel.Block) -> Aligned:
        """Rows are a space and a text; rows with an empty text, or whose tokens do not spell it, have no tokens."""
        found = tokens.before_spaces(block)
        sums = kernel.prefix_sums(block.data, kernel.CASED_VALUES)
        numbers = self.known.lookup(block, found, kernel.slice_hash(sums, found.starts, found.ends))
        sound = self._sound(block, found, numbers)
        fair = (tokens.per_row(~sound, found.bounds) == 0) & (np.diff(block.offsets) > 1)
        keep = np.repeat(fair, np.diff(found.bounds))
        row = np.repeat(np.arange(block.rows), np.diff(found.bounds))[keep]
        bounds = np.searchsorted(row, np.arange(block.rows + 1))
        sides = []
        for which, spans in enumerate(self.spans):
            ids, counts = self.known.ids(numbers[keep], which)
            first = np.concatenate(([0], np.cumsum(counts)))[bounds]
            sides.append((ids, first, np.cumsum(spans[ids])))
        (a, a_bounds, a_ends), (b, b_bounds, b_ends) = sides
        a_cut, b_cut = shared_ends(a_ends, b_ends)
        return Aligned(a, b, a_bounds, b_bounds, a_cut, b_cut, np.searchsorted(a_cut, a_bounds))

    def _sound(self, block: kernel.Block, found: tokens.Slices, numbers: np.ndarray) -> np.ndarray:
        """Whether both vocabularies spell each slice; every distinct slice is spelled out once a block."""
        values, first, which, _ = kernel.distinct(numbers.astype(np.uint64))
        first = np.sort(first)
        sound = np.ones(len(found.starts), dtype=bool)
        sizes = (found.ends - found.starts)[first]
        given = tokens.gather(block.data, found.starts[first], sizes)
        edges = np.cumsum(sizes) - sizes
        bad = np.zeros(len(first), dtype=bool)
        for side, vocabulary in enumerate(self.vocabularies):
            ids, counts = self.known.ids(numbers[first], side)
            spelled = tokens.per_row(self.spans[side][ids], np.concatenate(([0], np.cumsum(counts))))
            bad |= spelled != sizes
            if bad.any():  # lengths differ already: leave those out of the comparison of bytes
                ids = ids[np.repeat(~bad, counts)]
            text = np.frombuffer(b"".join(map(vocabulary.bytes.__getitem__, ids.tolist())), np.uint8)
            fits = np.repeat(~bad, sizes)
            differs = np.zeros(len(given), dtype=bool)
            differs[fits] = given[fits] != text
            if len(given):
                bad |= np.add.reduceat(differs, edges) > 0
        flawed = set(numbers[first[bad]].tolist())
        if flawed:
            sound = ~np.isin(numbers, list(flawed))
        return sound


_DIGITS = 10


def _decimal(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to top - 1, left-aligned, and how many there are."""
    table = np.zeros((top, _DIGITS), np.uint8)
    sizes = np.zeros(top, np.int64)
    numbers = np.arange(top)
    for k in range(_DIGITS):
        sizes[numbers >= 10**k if k else numbers >= 0] = k + 1
    for k in range(_DIGITS):
        left = np.flatnonzero(sizes > k)
        table[left, k] = numbers[left] // 10 ** (sizes[left] - 1 - k) % 10 + ord("0")
    return table, sizes


def group_texts(found: Aligned, digits: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """Every row's groups as ``a1,a2|b1;a3|b2,b3``."""
    table, sizes = digits
    groups = len(found.a_cut)
    a_group = np.searchsorted(found.a_cut, np.arange(len(found.a)))
    b_group = np.searchsorted(found.b_cut, np.arange(len(found.b)))
    behind_a = np.concatenate(([0], found.b_cut + 1))[:groups]  # tokens of B before each group
    a_at = np.arange(len(found.a)) + behind_a[a_group]
    b_at = np.arange(len(found.b)) + (found.a_cut + 1)[b_group]
    ids, mark = np.empty(len(a_at) + len(b_at), np.int64), np.full(len(a_at) + len(b_at), ord(","), np.uint8)
    ids[a_at], ids[b_at] = found.a, found.b
    mark[a_at[found.a_cut]], mark[b_at[found.b_cut]] = ord("|"), ord(";")
    size = sizes[ids]
    ends = np.cumsum(size + 1)
    starts = ends - size - 1
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        longer = np.flatnonzero(size > k)
        out[starts[longer] + k] = table[ids[longer], k]
    out[ends - 1] = mark
    # a row's last mark is no part of its text
    tokens_before = found.a_bounds + found.b_bounds
    edges = np.concatenate(([0], ends))[tokens_before]
    last = np.zeros(len(out), dtype=bool)
    last[edges[1:][np.diff(edges) > 0] - 1] = True
    kept = edges - np.concatenate(([0], np.cumsum(np.diff(edges) > 0)))
    return pa.LargeStringArray.from_buffers(
        len(edges) - 1, pa.py_buffer(kept.astype(np.int64).tobytes()), pa.py_buffer(out[~last].tobytes())
    ).cast(pa.string())


def aligned(docs: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, pairs, times) of every row of ``docs`` (doc_id, text).

    A encodes a space and the text, B the text; ``groups`` spells the ids of each group, ``pairs`` are the row's distinct linked
    ids as a * size of B + b, rising, ``times`` how many of its links each pair has.  A text that is null, empty, or not what the
    tokens of A or B spell (a text with the space mark itself) has no tokens.  Special tokens' strings are text.  Repeated rows are
    aligned like any other, other columns are not read.  A task holds blocks of about 1 MB, or one longer text.
    """
    a_path, b_path = tokens.tokenizer_path(a), tokens.tokenizer_path(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level(a_path), piece_level(b_path))
        width = len(aligner.spans[1])
        digits = _decimal(max(map(len, aligner.spans)))
        none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        for batch in batches:
            texts = pc.binary_join_element_wise(none, pc.fill_null(batch.column(1).cast(pa.large_string()), none), space)
            for block in kernel.blocks(texts):
                found = aligner.align(block)
                row = np.repeat(np.arange(block.rows, dtype=np.int64), np.diff(found.bounds))
                pair = found.a[found.a_cut].astype(np.int64) * width + found.b[found.b_cut]
                order = np.lexsort((pair, row))
                row, pair = row[order], pair[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
                at = np.flatnonzero(new)
                bounds = np.searchsorted(row[at], np.arange(block.rows + 1))
                times = np.diff(np.append(at, len(row))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.rows), pa.array(np.diff(found.a_bounds)), pa.array(np.diff(found.b_bounds)),
                     pa.array(np.diff(found.bounds)), group_texts(found, digits), kernel.lists(pair[at], bounds), kernel.lists(times, bounds)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"],
                )

    own = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {own}, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>"
    )


def piece_count(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): links of every pair in all rows, and whether no other pair of its B id has more.

    Rows bring their distinct pairs with counts, which Spark adds up before it deals them; the highest count by B id has at most
    one row per id of B.
    """
    links = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("l.pairs", "l.times")
    counts = stored(links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "alignment-pairs")
    highest = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("top"))
    joined = counts.join(F.broadcast(highest), F.col("pair") % width == F.col("b"))
    return joined.select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _common_from(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` pairs have that many links."""
    classes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("pairs"))
    so_far, least = 0, 64
    for k, pairs in sorted(((r["k"], r["pairs"]) for r in classes.collect()), reverse=True):  # at most 63 rows
        if (so_far := so_far + pairs) > most:
            break
        least = k
    return least


def with_link_counts(found: DataFrame, width: int, common: int = COMMON_PAIRS) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to rows that have a unique ``row``, ``pairs`` and ``times``, which go.

    ``count_sum`` adds up, over the row's links, how many links of all rows hold the same pair; ``n_best`` counts the links whose
    pair has the most links of its B id, ties included.
    """
    spark = found.sparkSession
    counts = stored(pair_counts(found, width), "alignment-counts")
    least = _common_from(counts, common)
    frequent = counts.where(F.floor(F.log2("n")) >= least).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("pair", "n", "best")))
    kept = [f for f in found.schema if f.name not in ("pairs", "times")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    names = [f.name for f in kept]
    partly = found.select(*names, "pairs", "times").mapInArrow(
        _looked_up(shared), f"{schema}, n_best long, count_sum long, pairs array<long>, times array<int>"
    )
    partly = stored(partly, "alignment-rows")
    rare = partly.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", "l.pairs", "l.times")
    met = rare.join(counts, F.col("pairs") == F.col("pair")).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    more = lambda total, extra: (F.col(total) + F.coalesce(extra, F.lit(0))).alias(total)
    return partly.join(met, "row", "left").select(*names, more("n_best", "more_best"), more("count_sum", "more_sum"))


def _looked_up(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in batch.columns[-2:]]
            own, times = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
            bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))))
            at = np.searchsorted(pairs, own)
            hit = at < len(pairs)
            hit[hit] = pairs[at[hit]] == own[hit]
            total, top = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            total[hit] = n[at[hit]] * times[hit]
            top[hit] = np.where(best[at[hit]], times[hit], 0)
            left = np.concatenate(([0], np.cumsum(~hit)))[bounds]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(tokens.per_row(top, bounds)), pa.array(tokens.per_row(total, bounds)),
                 kernel.lists(own[~hit], left), kernel.lists(times[~hit].astype(np.int32), left)],
                names=[*batch.schema.names[:-2], "n_best", "count_sum", "pairs", "times"],
            )

    return run


def alignment_digests(docs: DataFrame, a: str = A_VOCABULARY, b: str = B_VOCABULARY) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    As ``aligned``, with the groups hashed (rows without tokens have an empty text there) and the corpus-wide counts of the links.
    Every shared offset links one token of A with one of B, so links are as many as groups.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = aligned(docs, a, b).withColumn("groups_sha256", digest).drop("groups").withColumn("row", F.monotonically_increasing_id())
    rows = with_link_counts(stored(found, "alignment-docs"), piece_count(tokens.tokenizer_path(b)))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
