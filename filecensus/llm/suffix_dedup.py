"""Repeated-passage removal with longest-previous-factor arrays over blocks of suffixes.

A window is a string of ``length`` bytes.  Its anchor is the least hash of the short byte
grams inside it, so equal windows have equal anchors wherever they stand.  Consecutive windows
of one anchor form a stretch; stretches whose anchor occurs elsewhere are dealt out by anchor,
and all copies of a window meet in one block.  There the window starts are put in suffix order
(ranks of 8, 24, 72, ... bytes), the previous and next smaller positions in that order give the
longest earlier match of each start (previous and next larger ones: the longest later match).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filecensus.llm import kernel
from filecensus.llm.shared import stored

GRAM = 24
#: Bytes of stretches whose suffixes are sorted at once; anchors with more are split by window.
SUFFIX_BLOCK = 1 << 20
#: A stretch is cut after this many windows.
STRETCH = 1 << 14


# --- anchors and stretches ---------------------------------------------------------------


def stretches(block: kernel.Block, length: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, anchor, whether its gram stands there twice, hash of the bytes) of every stretch."""
    size = len(block.data)
    empty = np.zeros(0, np.int64)
    if size < length:
        return empty, empty, empty, empty, empty.astype(bool), empty
    sums = kernel.prefix_sums(block.data, kernel.CASED_VALUES)
    at = np.arange(size - GRAM + 1)
    grams, width = kernel.slice_hash(sums, at, at + GRAM), length - GRAM + 1
    least = kernel.sliding_min(grams, width)
    inside = (np.repeat(block.offsets[1:], np.diff(block.offsets))[: len(least)] - np.arange(len(least))) >= length
    change = np.ones(len(least) + 1, dtype=bool)
    change[1:-1] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    edges = np.flatnonzero(change)
    begin, count = edges[:-1], np.diff(edges)
    begin, count = begin[inside[begin]], count[inside[begin]]
    parts = -(-count // STRETCH)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, count = np.repeat(begin, parts) + nth * STRETCH, np.minimum(np.repeat(count, parts) - nth * STRETCH, STRETCH)
    row = np.searchsorted(block.offsets, begin, side="right") - 1
    # A gram is some window's anchor if the largest minimum of the windows around it is its own hash.
    pad = np.zeros(width - 1, np.uint64)
    around = ~kernel.sliding_min(~np.concatenate((pad, np.where(inside, least, np.uint64(0)), pad)), width)
    anchors = np.flatnonzero(around == grams)
    low, high = np.searchsorted(anchors, begin), np.searchsorted(anchors, begin + count + width - 1)
    stretch = np.repeat(np.arange(len(begin)), high - low)
    held = anchors[np.arange(len(stretch)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[stretch]]
    own = grams[held] == least[begin][stretch]
    twice = np.bincount(stretch[own], minlength=len(begin)) > 1
    copy = kernel.slice_hash(sums, begin, begin + count + length - 1).view(np.int64)
    return row + block.first, begin - block.offsets[row], count, least[begin].view(np.int64), twice, copy


def _find_stretches(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            content = batch.column(0).to_numpy()
            fresh = np.array([c not in seen and not seen.add(c) for c in content.tolist()], dtype=bool)
            for block in kernel.blocks(batch.column(1)):
                row, start, count, anchor, twice, copy = stretches(block, length)
                new = fresh[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[new]), pa.array(content[row[new]]),
                        pa.array(start[new].astype(np.int64)), pa.array(count[new].astype(np.int64)), pa.array(twice[new]),
                        pa.array(copy[new]),
                    ],
                    names=["anchor", "content", "start", "windows", "twice", "copy"],
                )

    return find


# --- suffix order of one block -----------------------------------------------------------


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.uint64)))
    ranks = np.empty(len(keys), dtype=np.uint64)
    ranks[order] = np.cumsum(new)
    return ranks


def _joined(ranks: np.ndarray, at: np.ndarray, offsets: list[int]) -> np.ndarray:
    keys = np.zeros(len(at), dtype=np.uint64)
    for o in offsets:
        keys = (keys << np.uint64(21)) | ranks[at + o]
    return keys


def _previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier smaller value, -1 without one, by jumping over larger ones."""
    found = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(found >= 0)
    while len(todo):
        todo = todo[(found[todo] >= 0) & (values[found[todo]] > values[todo])]
        found[todo] = found[found[todo]]
    return found


def match_lengths(data: np.ndarray, starts: np.ndarray, length: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Longest match, cut at ``length``, of each start with an earlier and with a later start.

    Shorter matches are worked out with ``exact`` only, else they are 0.  ``starts`` ascend, each with at least ``length`` bytes behind it; the block has fewer than
    2^21 bytes, so that three ranks fit a 64-bit key.
    """
    size = len(data)
    padded = np.concatenate((data, np.zeros(4 * length, np.uint8)))
    at = np.arange(size + 2 * length)
    keys = np.zeros(len(at), dtype=np.uint64)
    for k in range(8):
        keys = (keys << np.uint64(8)) | padded[k : k + len(at)]
    levels = [(8, _ranks(keys))]
    while 3 * levels[-1][0] <= length:
        width, ranks = levels[-1]
        ranks = np.concatenate((ranks, np.zeros(2 * width, np.uint64)))
        levels.append((3 * width, _ranks(_joined(ranks, at, [0, width, 2 * width]))))
    width, ranks = levels[-1]
    keys = _joined(ranks, starts, sorted({0, min(width, length - width), length - width}))
    order = np.argsort(keys, kind="stable")
    places, keys = starts[order], keys[order]

    def common(other: np.ndarray) -> np.ndarray:
        have = other >= 0
        if not exact:
            return np.where(have & (keys == keys[other]), length, 0)
        a, b = places[have], places[other[have]]
        done = np.zeros(len(a), dtype=np.int64)
        for width, ranks in reversed([(1, padded), *levels]):
            todo = np.arange(len(a))
            while len(todo):
                todo = todo[(done[todo] < length) & (ranks[a[todo] + done[todo]] == ranks[b[todo] + done[todo]])]
                done[todo] += width
        out = np.zeros(len(places), dtype=np.int64)
        out[have] = np.minimum(done, length)
        return out

    def nearest(values: np.ndarray) -> np.ndarray:
        after = _previous_smaller(values[::-1])[::-1]
        after = np.where(after >= 0, len(values) - 1 - after, -1)
        return np.maximum(common(_previous_smaller(values)), common(after))

    earlier, later = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
    earlier[order], later[order] = nearest(places), nearest(-places)
    return earlier, later


def _match_block(rows: list[tuple[int, int, bytes]], length: int, keep: str) -> pa.RecordBatch:
    """Runs of window starts to remove, from stretches (content, start, bytes) in text order."""
    sizes = np.array([len(r[2]) for r in rows])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8)
    counts = sizes - length + 1
    base = np.cumsum(counts) - counts
    nth = np.arange(counts.sum()) - np.repeat(base, counts)
    earlier, later = match_lengths(data, np.repeat(ends - sizes, counts) + nth, length)
    hit = (earlier if keep == "first" else np.maximum(earlier, later)) >= length
    opens = hit & np.concatenate(([True], ~hit[:-1]))
    opens[base] = hit[base]
    closes = hit & np.concatenate((~hit[1:], [True]))
    closes[base + counts - 1] = hit[base + counts - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    row = np.searchsorted(base, first, side="right") - 1
    content, start = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    return pa.RecordBatch.from_arrays(
        [pa.array(content[row]), pa.array(start[row] + nth[first]), pa.array(last - first + 1)],
        names=["content", "start", "windows"],
    )


def _match(length: int, keep: str):
    """Stretches sorted by anchor, in blocks that hold whole anchors."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, mark = 0, 0  # mark: where the last anchor's rows begin
        last = None
        for batch in batches:
            for anchor, content, start, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if anchor != last:
                    last, mark = anchor, len(held)
                if size + len(text) >= SUFFIX_BLOCK and mark:
                    yield _match_block(held[:mark], length, keep)
                    held, mark = held[mark:], 0
                    size = sum(len(r[2]) for r in held)
                held.append((content, start, text))
                size += len(text)
        if held:
            yield _match_block(held, length, keep)

    return match


def _window_hashes(length: int):
    """One row per window of an anchor too large for a block."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, start = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for block in kernel.blocks(batch.column(3), 256 << 10):
                counts = np.diff(block.offsets) - length + 1
                row = np.repeat(np.arange(block.rows), counts)
                nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                at = block.offsets[row] + nth
                halves = [
                    kernel.slice_hash(kernel.prefix_sums(block.data, v), at, at + length).view(np.int64)
                    for v in (kernel.CASED_VALUES, kernel.mix(kernel.CASED_VALUES))
                ]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, halves), pa.array(content[row + block.first]), pa.array(start[row + block.first] + nth)],
                    names=["h1", "h2", "content", "start"],
                )

    return hashes


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each stretch of a text."""
    names = ["anchor", "content", "start", "bytes", "ord", "hot"]

    def flush(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        rows, size = [], 0
        for i in range(batch.num_rows):
            content, order, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py().encode()
            for run in batch.column(3)[i].as_py():
                piece = text[run["start"] : run["start"] + run["bytes"]]
                rows.append((run["anchor"], content, run["start"], piece, order, run["hot"]))
                size += len(piece)
                if size > SUFFIX_BLOCK:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)


def _spans(runs: list[dict], length: int) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for low, high in sorted((r["start"], r["start"] + r["windows"] - 1 + length) for r in runs):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return [(a, b) for a, b in merged]


def _remove(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py().encode()
                spans = _spans(batch.column(2)[i].as_py(), length)
                rest, at = hashlib.sha256(), 0
                for low, high in [*spans, (len(text), len(text))]:
                    rest.update(text[at:low])
                    at = high
                out.append((batch.column(0)[i].as_py(), spans, rest.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([[{"low": a, "high": b} for a, b in o[1]] for o in out], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
                    pa.array([o[2] for o in out], pa.string()),
                ],
                names=["content", "spans", "kept_sha256"],
            )

    return remove


def repeated_spans(docs: DataFrame, length: int = 200, keep: str = "none") -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256) of every row of ``docs`` (doc_id, text).

    spans are the maximal byte ranges covered by strings of ``length`` bytes that also start
    elsewhere in any row, overlaps and the same row included; with ``keep="first"`` only those that
    start earlier, rows taken by their least doc_id, so that the first copy stays.  A null text is empty;
    texts shorter than ``length`` have no span; repeated rows are copies of each other, of which
    ``keep="first"`` leaves the one with the least id (of equal ids each).
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} bytes or more")
    text = F.coalesce("text", F.lit("")).alias("text")
    docs = docs.select("doc_id", text)
    content = F.xxhash64("text", F.octet_length("text")).alias("content")
    places = docs.select(content, "text").where(F.octet_length("text") >= length).mapInArrow(
        _find_stretches(length), "anchor long, content long, start long, windows long, twice boolean, copy long"
    )
    # Equal stretches are one: all but the first have a copy elsewhere, and the first meets the
    # other stretches of the anchor.  Places are in the order of their rows' least ids.
    contents = docs.groupBy(content).agg(F.any_value("text").alias("text"), F.min("doc_id").cast("long").alias("ord"))
    if keep == "first":
        places = places.join(docs.groupBy(content).agg(F.min("doc_id").cast("long").alias("ord")), "content")
    else:
        places = places.withColumn("ord", F.lit(0).cast("long"))
    by_copy, by_anchor = Window.partitionBy("anchor", "copy", "windows"), Window.partitionBy("anchor")
    place, size = F.struct("ord", "content", "start"), F.col("windows") + (length - 1)
    shared = stored(
        places.repartition("anchor").withColumn("copies", F.count("*").over(by_copy))
        .withColumn("lead", place == F.min(place).over(by_copy))
        .withColumn("low", F.min(F.struct("copy", "windows")).over(by_anchor)).withColumn("high", F.max(F.struct("copy", "windows")).over(by_anchor))
        .withColumn("again", F.max("twice").over(by_anchor))
        .withColumn("hot", F.sum(F.when(F.col("lead"), size)).over(by_anchor) >= SUFFIX_BLOCK // 2)
        .where("copies > 1 OR low <> high OR again")
        .select("anchor", "content", "start", "windows", "ord", "copies", "lead", "hot", F.expr("low <> high OR again").alias("open")),
        "shared",
    )
    copied = shared.where("NOT lead" if keep == "first" else "copies > 1").select("content", "start", "windows")
    runs = shared.where("lead AND open").groupBy("content").agg(
        F.collect_set(F.struct("start", size.alias("bytes"), "anchor", "hot")).alias("runs")  # tasks may share a content
    )
    pieces = stored(
        contents.join(runs, "content").select("content", "ord", "text", "runs").mapInArrow(
            _cut_out, "anchor long, content long, start long, bytes binary, ord long, hot boolean"
        ),
        "stretches",
    )
    dealt = pieces.where("NOT hot").repartition("anchor").sortWithinPartitions("anchor", "ord", "content", "start")
    matched = dealt.select("anchor", "content", "start", "bytes").mapInArrow(_match(length, keep), "content long, start long, windows long")
    # An anchor with more bytes than a block: its windows meet by their 128-bit hashes instead.
    same = Window.partitionBy("h1", "h2")
    hashed = (
        pieces.where("hot").select("anchor", "content", "start", "bytes")
        .mapInArrow(_window_hashes(length), "h1 long, h2 long, content long, start long")
    )
    if keep == "first":
        order = pieces.where("hot").select("content", "ord").distinct()
        hashed = hashed.join(order, "content").withColumn("first", F.min(F.struct("ord", "content", "start")).over(same)).where(
            "first.content <> content OR first.start <> start"
        )
    else:
        hashed = hashed.withColumn("copies", F.count("*").over(same)).where("copies > 1")
    found = copied.union(matched).union(hashed.select("content", "start", F.lit(1).cast("long").alias("windows")))
    rows = docs.select("doc_id", content, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    copies = rows.groupBy("content").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    per_content = stored(
        contents.select("content", "text")
        .join(found.groupBy("content").agg(F.collect_list(F.struct("start", "windows")).alias("found")), "content")
        .select("content", "text", "found")
        .mapInArrow(_remove(length), "content long, spans array<struct<low:long,high:long>>, kept_sha256 string"),
        "spans",
    )
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    if keep == "first":
        whole = whole & ~F.col("doc_id").eqNullSafe(F.col("least"))
    none = F.expr("CAST(array() AS array<struct<low:bigint,high:bigint>>)")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("n_bytes").alias("high")))
    return (
        rows.join(copies, "content").join(per_content, "content", "left")
        .select(
            "doc_id", "n_bytes",
            F.when(whole, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"),
            F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )
    )
