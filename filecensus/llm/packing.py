"""Packing documents into full sequences that hold all sources in target proportions.

Mixture-controlled: sources are queues of tokens, and deficit round-robin serves them in
rounds of one window's length.  In a round a source is owed its share of the window; whole
tokens of that are sent and the fraction stays as its deficit for the next round.  When a
queue runs dry its share goes to the others by their weights.  The rounds, one after the
other, are one stream that is cut every ``width`` tokens.

What a source has sent by the end of a round depends on its weight and on how far the
weighted service has come by then, so any task works out the rounds of its documents, with
the deficits they start from, without having seen the rounds before.  Only the tokens of a
source in each input partition are added up across partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from filecensus.llm import kernel, tokens
from filecensus.llm.shared import stored

VOCABULARY = "word_bpe_49k.json"
END = 2  # the id behind every document
WIDTH = 4096
#: Rounds of sources that are worked out at once.
ROUND_CELLS = 1 << 20


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """(doc_id, source, ids, n, part, before) of every row: its ids with the end, as little-endian numbers.

    An id has 16 bits if the whole vocabulary fits in them, else 32.  ``before`` counts the ids of the same source earlier in the task ``part``.  A null text has the end alone.
    """
    path = tokens.tokenizer_path(vocabulary)
    kind = _id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        known = tokens.SliceIds(tokens.word_encoder(path))
        sent: dict[str | None, int] = {}
        for batch in batches:
            for block in kernel.blocks(batch.column(1)):
                found = tokens.between_spaces(block)
                ids, counts = known.ids(known.lookup(block, found, _hashes(block, found)))
                n = tokens.per_row(counts, found.bounds)
                at = np.cumsum(n)  # where each row's end goes
                whole = np.insert(ids, at, end).astype(kind)
                sources = batch.column(2).slice(block.first, block.rows)
                before = np.empty(block.rows, np.int64)
                for r, (source, size) in enumerate(zip(sources.to_pylist(), (n + 1).tolist())):
                    before[r] = sent.get(source, 0)
                    sent[source] = sent.get(source, 0) + size
                bounds = np.concatenate(([0], np.cumsum(n + 1))) * np.dtype(kind).itemsize
                binary = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), block.rows, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(whole.tobytes())]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.rows), sources, binary, pa.array(n + 1),
                     pa.array(np.full(block.rows, part, np.int64)), pa.array(before)],
                    names=["doc_id", "source", "ids", "n", "part", "before"],
                )

    own = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.col("source").cast("string").alias("source")).mapInArrow(
        run, f"doc_id {own}, source string, ids binary, n long, part long, before long"
    )


def _id_type(path: str) -> str:
    return "<u2" if tokens.library_tokenizer(path, plain_specials=False).get_vocab_size() <= 1 << 16 else "<u4"


def _hashes(block: kernel.Block, found: tokens.Slices) -> np.ndarray:
    """Slice hashes blind to the case of A-Z, which this vocabulary lowers, but for slices with ``<``."""
    hashes = kernel.slice_hash(kernel.prefix_sums(block.data), found.starts, found.ends)
    opened = np.flatnonzero(block.data == ord("<"))
    if len(opened):
        own = np.unique(np.searchsorted(found.starts, opened, side="right") - 1)
        sums = kernel.prefix_sums(block.data, kernel.CASED_VALUES)
        hashes[own] = kernel.slice_hash(sums, found.starts[own], found.ends[own])
    return hashes


class Rounds:
    """Service of the sources: what each has sent by the end of each round.

    ``sizes`` are the tokens of the sources in order, ``weights`` their shares.  The weighted
    service ``v`` is the tokens sent for a weight of one; source k has sent
    floor(min(size, weight * v)) of its tokens, and all its tokens by the last round.
    """

    def __init__(self, sizes: np.ndarray, weights: np.ndarray, width: int = WIDTH):
        self.sizes, self.weights, self.width = sizes, weights.astype(float), width
        self.total = int(sizes.sum())
        self.count = -(-self.total // width)
        dry = np.unique(np.concatenate(([0.0], sizes / self.weights)))  # services at which a queue runs dry
        self.dry = dry
        self.all_sent = np.array([np.minimum(sizes, self.weights * v).sum() for v in dry.tolist()])

    def sent(self, source: np.ndarray, rounds: np.ndarray) -> np.ndarray:
        """Tokens of a source sent before each round; arrays of the same shape."""
        v = np.interp(np.minimum(rounds * float(self.width), self.all_sent[-1]), self.all_sent, self.dry)
        whole = np.floor(np.minimum(self.sizes[source], self.weights[source] * v)).astype(np.int64)
        return np.where(rounds >= self.count, self.sizes[source], np.minimum(whole, self.sizes[source]))

    def round_of(self, source: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round that sends each token of a source."""
        v = np.minimum((token + 1) / self.weights[source], self.dry[-1])
        rounds = np.clip(np.ceil(np.interp(v, self.dry, self.all_sent) / self.width).astype(np.int64) - 1, 0, self.count - 1)
        while (late := self.sent(source, rounds) > token).any():
            rounds = rounds - late
        while (early := self.sent(source, rounds + 1) <= token).any():
            rounds = rounds + early
        return rounds

    def places(self, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the stream each source's turn begins in each round, and what it had sent; rounds x sources."""
        source = np.arange(len(self.sizes))[None, :]
        before, after = self.sent(source, rounds[:, None]), self.sent(source, rounds[:, None] + 1)
        turns = after - before
        return before.sum(axis=1)[:, None] + np.cumsum(turns, axis=1) - turns, before


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row ``counts[row]`` items: the row of each and its number in the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _stretches(rounds: Rounds, source: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of documents in the stream: (row, start in the document, length, place), cut by round and window.

    Documents are tokens ``low`` to ``low + n - 1`` of their source's queue.
    """
    first, last = rounds.round_of(source, low), rounds.round_of(source, low + n - 1)
    row, k = _ragged(last - first + 1)
    number = first[row] + k
    start = np.maximum(rounds.sent(source[row], number), low[row])
    end = np.minimum(rounds.sent(source[row], number + 1), (low + n)[row])
    some = end > start
    row, number, start, end = row[some], number[some], start[some], end[some]
    place = np.empty(len(row), np.int64)
    distinct, which = np.unique(number, return_inverse=True)
    step = max(1, ROUND_CELLS // len(rounds.sizes))
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(0, len(distinct), step)).tolist() + [len(order)]
    for b, (a, z) in enumerate(zip(cuts, cuts[1:])):
        begins, before = rounds.places(distinct[b * step : (b + 1) * step])
        at, own = order[a:z], which[order[a:z]] - b * step
        place[at] = begins[own, source[row[at]]] + start[at] - before[own, source[row[at]]]
    # a turn may cross the end of a window, and the last tokens are cut into powers of two
    edges = _tail(rounds.total, rounds.width)
    size = end - start
    window = lambda p: np.where(p < edges[0], p // rounds.width, edges[0] // rounds.width + np.searchsorted(edges, p, side="right") - 1)
    head = window(place)
    piece, k = _ragged(window(place + size - 1) - head + 1)
    sequence = head[piece] + k
    opens, closes = _edges(sequence, edges, rounds.width)
    begin = np.maximum(place[piece], opens)
    length = np.minimum((place + size)[piece], closes) - begin
    return row[piece], (start - low[row])[piece] + begin - place[piece], length, sequence, begin - opens


def _tail(total: int, width: int) -> np.ndarray:
    """Edges of the last sequences: the rest behind the last full window, as falling powers of two."""
    edges, rest = [total - total % width], total % width
    while rest:
        edges.append(edges[-1] + (1 << rest.bit_length() - 1))
        rest -= 1 << rest.bit_length() - 1
    return np.array(edges, np.int64)


def _edges(sequence: np.ndarray, edges: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each sequence opens and closes in the stream."""
    full = edges[0] // width
    at = np.clip(sequence - full, 0, len(edges) - 1)
    opens = np.where(sequence < full, sequence * width, edges[at])
    return opens, np.where(sequence < full, opens + width, edges[np.minimum(at + 1, len(edges) - 1)])


def pack(
    docs: DataFrame, weights: dict[str | None, float] | None = None, width: int = WIDTH,
    vocabulary: str = VOCABULARY, end: int = END,
) -> DataFrame:
    """(doc_id, source, start, length, ids, doc_tokens, sequence_id, offset) of every piece of ``docs`` (doc_id, text, source).

    Every document is its ids and ``end``; a null or empty text is the end alone.  Sequences have ``width`` tokens, but for
    the last few, which are powers of two, so nothing is padded.  Sources stand in code point order, null last, and share
    every window by ``weights`` (positive; by default the tokens they hold, so that all last to the end); a weight that is
    not given is 1.  Rows that repeat, in whole or by id, are documents of their own.  An empty table gives no pieces.
    Columns of ``docs`` other than these three are not read.  ``ids`` are the piece's ids as little-endian 32-bit numbers.
    A text is held by one task; a piece never is larger than a window.

    The driver holds one row per source (a mixture names its sources, so they are few); the table of sums by source and
    task is joined, so Spark broadcasts it only while its size allows that.
    """
    rows = stored(encoded(docs, vocabulary, end), "packing-ids")
    task = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = stored(task.select("source", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin")), "packing-sums")
    sizes = starts.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.asc_nulls_last("source")).collect()
    named = {r["source"]: k for k, r in enumerate(sizes)}
    shares = [float(r["n"]) if weights is None else float(weights.get(r["source"], 1.0)) for r in sizes]
    queue = rows.join(
        starts.select(F.col("source").alias("own"), F.col("part").alias("own_part"), "begin"),
        F.col("source").eqNullSafe(F.col("own")) & (F.col("part") == F.col("own_part")),
    ).select("doc_id", "source", "ids", "n", (F.col("begin") + F.col("before")).alias("low"))
    shared = docs.sparkSession.sparkContext.broadcast(([r["n"] for r in sizes], shares, width, named))
    own = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {own}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"
    return queue.mapInArrow(_pieces(shared, _id_type(tokens.tokenizer_path(vocabulary))), schema)


def _pieces(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, weights, width, named = shared.value
        rounds = Rounds(np.array(sizes, np.int64), np.array(weights), width) if sizes else None
        for batch in batches:
            for block in kernel.blocks(batch.column(2)):
                rows = slice(block.first, block.first + block.rows)
                doc_ids, names = batch.column(0)[rows], batch.column(1)[rows]
                n, low = (batch.column(c).to_numpy(zero_copy_only=False)[rows] for c in (3, 4))
                source = np.fromiter((named[s] for s in names.to_pylist()), np.int64, block.rows)
                row, start, length, sequence, offset = _stretches(rounds, source, low, n)
                begin = block.offsets[row] // np.dtype(kind).itemsize + start
                ids = block.data.view(kind).astype("<u4")
                # pieces stand in the order of their rows, so their ids are the block's bytes, cut anew
                order = np.lexsort((start, row))
                row, start, length, sequence, offset, begin = (x[order] for x in (row, start, length, sequence, offset, begin))
                bounds = (np.append(begin, len(ids)) * 4).astype(np.int32)
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids.tobytes())])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(at), names.take(at), *map(pa.array, (start, length)), ids, *map(pa.array, (n[row], sequence, offset))],
                    names=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return run


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, segments): each sequence whole, with (doc_id, offset, length) of its pieces in order.

    A sequence is bounded by the window's width, so grouping by it gathers little.
    """
    piece = F.struct("offset", "length", "doc_id", "ids")
    found = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.sum("length").alias("length"))
    joined = F.aggregate("pieces", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    segments = F.transform("pieces", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["offset"].alias("offset"), p["length"].alias("length")))
    return found.select("sequence_id", "length", joined.alias("ids"), segments.alias("segments"))


def ids_crc32(ids: Column) -> Column:
    """CRC-32 of a piece's id bytes."""
    return F.crc32(ids)
