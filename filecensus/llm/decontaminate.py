"""Benchmark passages in documents by spaced seeds and substitution-tolerant verification.

A seed is a run of words of which a fixed mask ignores some, so a replaced word under an ignored place
leaves the seed's hash as it is.  Hashes of the benchmark are joined with those of every place of every document;
around a hit, item and document are compared word by word along its diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filecensus.llm import kernel
from filecensus.llm.shared import row_key

#: Words under a 1 are hashed, those under a 0 ignored.
MASKS = ("11101101111", "11011100111", "1110011011011", "1111111")
#: Benchmark words that one pass over the documents takes along (each with a few hashes, about 10 MB).
BLOCK_WORDS = 1 << 17
#: A passage is found if this many words agree, or this share of an item's words.
LEAST_WORDS, SHARE = 13, 0.6
#: What a differing word costs in the best stretch along a diagonal, an agreeing one being 1.
PENALTY = 2.0
BITS = 20


def seed_hashes(hashes: np.ndarray, bounds: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word in the row, hash) of every place where the mask fits into a row."""
    count = len(hashes) - len(mask) + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:count]
    fits = np.flatnonzero(np.arange(count) + len(mask) <= bounds[row + 1])
    total = np.zeros(len(fits), dtype=np.uint64)
    for k in np.flatnonzero(np.array(list(mask)) == "1"):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[fits + k]
    return row[fits], fits - bounds[row[fits]], kernel.mix(total)


class Probe:
    """Word hashes and seeds of a block of benchmark items, with a bit table in front of the seeds."""

    def __init__(self, ids: list, texts: list):
        block = next(kernel.blocks(pa.array(texts, pa.large_string()), 1 << 62))
        found = kernel.words(block, kernel.ALNUM)
        self.ids, self.hashes, self.bounds = ids, kernel.word_hashes(block, found), found.bounds
        self.seeds = []
        for mask in MASKS:
            row, at, hashed = seed_hashes(self.hashes, self.bounds, mask)
            order = np.argsort(hashed, kind="stable")
            bits = np.zeros(1 << BITS, dtype=bool)
            bits[hashed >> np.uint64(64 - BITS)] = True
            self.seeds.append((mask, hashed[order], row[order], at[order], bits))

    @classmethod
    def of(cls, state: dict) -> Probe:
        """A probe from the attributes of another, which travel as plain arrays."""
        probe = cls.__new__(cls)
        probe.__dict__.update(state)
        return probe

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """Distinct (row, item, diagonal) of equal seeds; a diagonal is the item's first word in the row."""
        out = set()
        for mask, seeds, items, places, bits in self.seeds:
            row, at, hashed = seed_hashes(hashes, bounds, mask)
            near = np.flatnonzero(bits[hashed >> np.uint64(64 - BITS)])
            low, high = np.searchsorted(seeds, hashed[near]), np.searchsorted(seeds, hashed[near], side="right")
            for k, a, b in zip(near[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                out.update((int(row[k]), int(items[j]), int(at[k] - places[j])) for j in range(a, b))
        return sorted(out)

    def verified(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, first word, words, agreeing words) of the best stretch of each (row, item)."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, diagonal in self.hits(hashes, bounds):
            own, text = self.hashes[self.bounds[item] : self.bounds[item + 1]], hashes[bounds[row] : bounds[row + 1]]
            low, high = max(0, -diagonal), min(len(own), len(text) - diagonal)
            same = own[low:high] == text[diagonal + low : diagonal + high]
            sums = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0, -PENALTY))))
            gain = sums - np.minimum.accumulate(sums)
            end = int(gain.argmax())
            start = int(np.flatnonzero(sums[: end + 1] == sums[: end + 1].min())[-1])
            agree = int(same[start:end].sum())
            if agree >= min(LEAST_WORDS, max(1, int(np.ceil(SHARE * len(own))))):
                found = (agree, diagonal + low + start, end - start)
                best[row, item] = max(best.get((row, item), found), found)
        for (row, item), (agree, start, size) in best.items():
            yield row, item, start, size, agree


def _blocks_of_items(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"].split()) + 1
        if size >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, n_equal) of every benchmark item found in a row of ``docs``.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered.  Items are taken along in blocks
    of bounded size, one pass over the documents per block, so memory does not grow with the benchmark.
    Items shorter than the shortest mask are not looked for.  Null and empty texts hold
    nothing; repeated rows each give their rows.
    """
    spark = docs.sparkSession
    own, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {own}, item_id {item_kind}, first_word long, n_words long, n_equal long"
    item_type = pa.int64() if item_kind in ("bigint", "long") else pa.int32() if item_kind == "int" else pa.string()

    def finder(shared):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = Probe.of(shared.value)
            for batch in batches:
                rows = []
                for block in kernel.blocks(batch.column(1)):
                    found = kernel.words(block, kernel.ALNUM)
                    for row, item, start, size, agree in probe.verified(kernel.word_hashes(block, found), found.bounds):
                        rows.append((block.first + row, probe.ids[item], start, size, agree))
                places, *rest = (pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), item_type, *[pa.int64()] * 3]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(places), *rest],
                    names=["doc_id", "item_id", "first_word", "n_words", "n_equal"],
                )

        return find

    found = spark.createDataFrame([], schema)
    for ids, texts in _blocks_of_items(benchmark):
        shared = spark.sparkContext.broadcast(vars(Probe(ids, texts)))
        found = found.union(docs.select("doc_id", "text").mapInArrow(finder(shared), schema))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns.

    Each row is judged by its own text: one that shares its id with a row that goes, or like it has none, stays.
    """
    found = leaks(docs.select(row_key().alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("leaked")).distinct()
    return docs.join(found, row_key() == F.col("leaked"), "left_anti")
