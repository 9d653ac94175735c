"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its byte n-grams, of its beginnings and of the word itself, all hashed into
one table, so an unseen misspelling shares most of its vectors with the known spelling.  A
chunk of words is the mean of its words; a text is as toxic as its most toxic chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecensus.llm import kernel
from filecensus.llm.shared import crc_remainder

BUCKETS, DIMENSIONS = 1 << 16, 8
GRAMS, BEGINNINGS = (3, 4, 5), (3, 4, 5, 6)
WIDTH, STRIDE = 32, 16
#: Logit of a text without words.
WORDLESS = -2.0
#: Bounds of the training sample: documents per label, chunks per document.
SAMPLE_DOCS, SAMPLE_CHUNKS = {0: 4000, 1: 1500}, 128
ROUNDS, DOC_BATCH, RATE, DECAY = 6, 64, 0.02, 0.3
#: Small samples are gone through more often, up to about so many steps.
LEAST_STEPS = 300


def word_grams(block: kernel.Block) -> tuple[kernel.Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of a block and, for each kind of gram, (word index, bucket) of all its grams."""
    found = kernel.words(block, kernel.ALNUM)
    sums = kernel.prefix_sums(block.data)
    _, inverse = kernel.powers(len(sums))
    index = np.arange(len(found.starts))
    length = found.ends - found.starts

    def bucket(low: np.ndarray, high: np.ndarray, kind: int) -> np.ndarray:
        hashed = (sums[high] - sums[low]) * inverse[low] + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return ((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int32)

    grams = [(index, bucket(found.starts, found.ends, 1))]
    for n in BEGINNINGS:
        have = np.flatnonzero(length > n)
        grams.append((have, bucket(found.starts[have], found.starts[have] + n, 2)))
    for n in GRAMS:
        counts = np.maximum(length - n + 1, 0)
        word = np.repeat(index, counts)
        low = np.repeat(found.starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        grams.append((word, bucket(low, low + n, 3)))
    return found, grams


def chunk_bounds(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end) of overlapping chunks that cover all words of each row."""
    counts = np.diff(bounds)
    chunks = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WIDTH) // STRIDE)), 0)
    row = np.repeat(np.arange(len(counts)), chunks)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    low = bounds[row] + nth * STRIDE
    return row, low, np.minimum(low + WIDTH, bounds[row + 1])


# --- training ----------------------------------------------------------------------------


def sample_chunks(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """(doc, label, words) chunks of a bounded sample of the labelled rows outside the held-out part.

    About SAMPLE_DOCS documents of each label, of each at most SAMPLE_CHUNKS evenly spaced chunks.
    """
    usable = labels.select("doc_id", F.col("toxic").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), modulus) != 0)
    ).groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30))
    bound = {k: min(1 << 30, (n << 30) // max(1, totals.get(k, 0))) for k, n in SAMPLE_DOCS.items()}
    share = F.when(F.col("label") == 1, bound[1]).otherwise(bound[0])
    chosen = usable.where(place < share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for block in kernel.blocks(batch.column(2)):
                found = kernel.words(block, kernel.ALNUM)
                row, low, high = chunk_bounds(found.bounds)
                rows = []
                for r in range(block.rows):
                    own = np.flatnonzero(row == r)
                    for c in own[np.unique(np.linspace(0, len(own) - 1, min(len(own), SAMPLE_CHUNKS)).astype(int))] if len(own) else []:
                        text = block.data[found.starts[low[c]] : found.ends[high[c] - 1]].tobytes()
                        rows.append((ids[block.first + r], marks[block.first + r], text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary())],
                    names=["doc", "label", "words"],
                )

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col("doc_id").cast("long") if whole else F.xxhash64("doc_id")
    return joined.select(number.alias("doc_id"), F.col("label").cast("int"), "text").mapInArrow(cut, "doc long, label int, words binary")


class _Bags:
    """Sampled documents as chunks of distinct words, and those words as buckets, in document order."""

    def __init__(self, docs: np.ndarray, labels: np.ndarray, texts: pa.Array):
        order = np.argsort(docs, kind="stable")
        docs, texts = docs[order], texts.take(pa.array(order))
        seen: dict[int, int] = {}
        parts: list[np.ndarray] = []
        words, sizes = [], []
        for block in kernel.blocks(texts):
            found, grams = word_grams(block)
            distinct, at, which = np.unique(kernel.word_hashes(block, found), return_index=True, return_inverse=True)
            ids = np.array([seen.setdefault(k, len(seen)) for k in distinct.tolist()], dtype=np.int64)
            fresh = np.zeros(len(found.starts), dtype=bool)
            fresh[at[ids >= len(parts)]] = True
            rows = np.concatenate([word[fresh[word]] for word, _ in grams])
            flat = np.concatenate([bucket[fresh[word]] for word, bucket in grams])
            by_word = np.argsort(rows, kind="stable")
            rows, flat = rows[by_word], flat[by_word]
            for i in at[ids >= len(parts)][np.argsort(ids[ids >= len(parts)])]:
                parts.append(flat[np.searchsorted(rows, i) : np.searchsorted(rows, i, side="right")])
            words.append(ids[which])
            sizes.append(np.diff(found.bounds))
        self.word = np.concatenate(words)
        self.chunk_bounds = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        self.gram = np.concatenate(parts)
        self.gram_bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        self.doc_bounds = np.concatenate((first, [len(docs)]))
        self.labels = labels[order][first]


def _pick(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places between the bounds of the given rows, and the row (by number) of each."""
    sizes = (bounds[1:] - bounds[:-1])[rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + bounds[rows][owner], owner


def train(docs: np.ndarray, labels: np.ndarray, texts: pa.Array, seed: int = 7) -> tuple[np.ndarray, float]:
    """Learned logit of every bucket and of an empty text, from chunks (document, label, text).

    Embeddings and softmax are trained together with Adam on batches of documents.  In the first rounds every
    chunk of a document carries its label; then a document teaches by its most toxic chunk, as the
    others of a toxic one may well be clean.  A seventh of the documents is set aside to place the cut.
    """
    if not len(texts) or labels.min() == labels.max():
        return np.zeros(BUCKETS, np.float32), -2.0
    bags = _Bags(docs, labels, texts)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags.labels))
    aside, teaching = (order[: len(order) // 7], order[len(order) // 7 :]) if len(order) >= 70 else (order, order)
    table = rng.normal(0, 0.1, (DIMENSIONS, BUCKETS)).astype(np.float32)
    top = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, top, bias)]
    positive = max(1e-9, (bags.labels[teaching] == 1).mean())

    def forward(at: np.ndarray):
        chunks, doc = _pick(bags.doc_bounds, at)
        places, chunk = _pick(bags.chunk_bounds, chunks)
        distinct, word = np.unique(bags.word[places], return_inverse=True)
        where, owner = _pick(bags.gram_bounds, distinct)
        gram = bags.gram[where]
        per_word, per_chunk = np.bincount(owner, minlength=len(distinct)), np.maximum(1, np.bincount(chunk, minlength=len(chunks)))
        vectors = [np.bincount(owner, table[d][gram], len(distinct)) / per_word for d in range(DIMENSIONS)]
        means = np.stack([np.bincount(chunk, v[word], len(chunks)) for v in vectors], axis=1) / per_chunk[:, None]
        logits = means @ top + bias
        return logits[:, 1] - logits[:, 0], doc, means, (chunk, word, owner, gram, per_word, per_chunk)

    per_round = -(-len(teaching) // DOC_BATCH)
    rounds = max(ROUNDS, min(60, -(-LEAST_STEPS // per_round)))
    step, steps = 0, rounds * per_round
    for turn in range(rounds):
        mixed = rng.permutation(teaching)
        for low in range(0, len(mixed), DOC_BATCH):
            at = mixed[low : low + DOC_BATCH]
            step += 1
            odds, doc, means, (chunk, word, owner, gram, per_word, per_chunk) = forward(at)
            label = bags.labels[at][doc]
            weight = np.where(label == 1, 0.5 / positive, 0.5 / (1 - positive)) / len(at)
            if turn < max(1, rounds // 6):
                weight = weight / np.bincount(doc)[doc]
            else:
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                weight = np.where(odds >= np.maximum.reduceat(odds, first)[doc], weight, 0.0)
            error = (weight * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - label))[:, None] * np.array([-1.0, 1.0])
            d_means = (error @ top.T) / per_chunk[:, None]
            grads = [np.empty_like(table), means.T @ error, error.sum(0)]
            for d in range(DIMENSIONS):
                d_words = np.bincount(word, d_means[chunk, d], len(per_word)) / per_word
                grads[0][d] = np.bincount(gram, d_words[owner], BUCKETS)
            rate = RATE * (1 - 0.9 * step / steps)
            for value, grad, (m, v) in zip((table, top, bias), grads, state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7) + rate * DECAY * value
    # The cut between the labels on the documents aside: the middle of the best places for it.
    best = []
    for low in range(0, len(aside), DOC_BATCH):
        odds, doc, _, _ = forward(aside[low : low + DOC_BATCH])
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        best.append(np.maximum.reduceat(odds, first))
    odds, label = np.concatenate(best), bags.labels[aside]
    cuts = np.unique(np.concatenate((odds - 1e-6, odds + 1e-6)))
    loss = [4 * np.sum((odds >= c) & (label == 0)) / max(1, np.sum(label == 0)) + np.sum((odds < c) & (label == 1)) / max(1, np.sum(label == 1)) for c in cuts]
    good = cuts[np.array(loss) <= min(loss) + 1e-9]
    side = top[:, 1] - top[:, 0]
    return (side @ table).astype(np.float32), float(bias[1] - bias[0] - np.clip((good[0] + good[-1]) / 2, -6, 6))


# --- scoring -----------------------------------------------------------------------------


def odds_of(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    """Logit of the most toxic chunk of every text; a text without words has a fixed one that says clean."""
    out = np.full(len(texts), min(bias, WORDLESS))
    for block in kernel.blocks(texts):
        found, grams = word_grams(block)
        total, count = np.zeros(len(found.starts)), np.zeros(len(found.starts))
        for word, bucket in grams:
            total += np.bincount(word, table[bucket], len(total))
            count += np.bincount(word, minlength=len(total))
        sums = np.concatenate(([0.0], np.cumsum(total / np.maximum(count, 1))))
        row, low, high = chunk_bounds(found.bounds)
        if len(row):
            odds = (sums[high] - sums[low]) / (high - low) + bias
            begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            out[block.first + row[begins]] = np.maximum.reduceat(odds, begins)
    return out


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text); the model (256 KB) is broadcast.

    score is the probability of the most toxic chunk.  A null, empty or wordless text holds nothing toxic: its score is
    below 0.5 whatever was learned.  Repeated rows are scored alike, an empty table gives no rows, ids may be of any type.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            out = odds_of(batch.column(1), table, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")


def fitted(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> tuple[np.ndarray, float]:
    """The model of the labelled rows outside the held-out part; without both labels every text is clean."""
    rows = sample_chunks(docs, labels, modulus).toArrow().combine_chunks()
    if not rows.num_rows:
        return np.zeros(BUCKETS, np.float32), -2.0
    column = rows.column("words").combine_chunks()
    return train(rows.column("doc").to_numpy(), rows.column("label").to_numpy().astype(np.int64), column)
