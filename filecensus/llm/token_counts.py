"""Greedy word-piece counts by one linear pass: a vocabulary trie with failure links.

A node's failure link leads to what is left of its string after the longest-match pieces are
taken off, and the number of those pieces is stored with the link, so a count never
builds a piece nor goes back.  All distinct words of a block move through the trie together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from filecensus.llm import kernel

#: Public vocabulary: a line per piece, base 64 and rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAD = 0x20


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class PieceCounter:
    """Trie edges as sorted keys node * 256 + byte; node 0 is the root.

    Every single byte has to be a piece, so that every string can be cut.
    """

    def __init__(self, pieces: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in set(pieces) | {bytes([b]) for b in range(256)}:
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    is_piece.append(False)
                node = children[node][b]
            is_piece[node] = True
        link, popped = [0] * len(children), [0] * len(children)
        level = list(children[0].values())
        for node in level:
            popped[node] = 1  # a byte is a piece: nothing is left
        while level:
            below = []
            for parent in level:
                for b, node in children[parent].items():
                    below.append(node)
                    if is_piece[node]:
                        popped[node] = 1
                        continue
                    at, pops = link[parent], popped[parent]
                    while b not in children[at]:
                        pops += popped[at]
                        at = link[at]
                    link[node], popped[node] = children[at][b], pops
            level = below
        edges = sorted((node << 8 | b, to) for node, own in enumerate(children) for b, to in own.items())
        self.keys = np.array([k for k, _ in edges], dtype=np.int64)
        self.targets = np.array([t for _, t in edges], dtype=np.int64)
        self.link, self.popped = np.array(link), np.array(popped)
        rest = np.zeros(len(children), dtype=np.int64)  # pieces left when the text ends at a node
        todo = np.arange(len(children))
        while (todo != 0).any():
            rest += np.where(todo != 0, self.popped[todo], 0)
            todo = np.where(todo != 0, self.link[todo], 0)
        self.rest = rest

    @classmethod
    def of(cls, state: dict) -> PieceCounter:
        """A counter from the attributes of another, which travel as plain arrays."""
        counter = cls.__new__(cls)
        counter.__dict__.update(state)
        return counter

    def _step(self, nodes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = nodes << 8 | data
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return self.keys[at] == wanted, self.targets[at]

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of a space followed by each slice."""
        order = np.argsort(starts - ends, kind="stable")  # longest first: those still moving are in front
        low, size = starts[order], (ends - starts)[order]
        total = np.zeros(len(starts), dtype=np.int64)
        node = np.full(len(starts), self._step(np.array([0]), np.array([LEAD]))[1][0])
        for k in range(int(size[0]) if len(size) else 0):
            moving = int(np.searchsorted(-size, -k, side="left"))
            todo, byte = np.arange(moving), data[low[:moving] + k].astype(np.int64)
            while len(todo):
                have, target = self._step(node[todo], byte[todo])
                node[todo[have]] = target[have]
                todo = todo[~have]
                total[todo] += self.popped[node[todo]]
                node[todo] = self.link[node[todo]]
        out = np.empty_like(total)
        out[order] = total + self.rest[node]
        return out


def count_tokens(docs: DataFrame, counter: PieceCounter) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of ``docs`` (doc_id, text).

    A word is anything between ASCII white space; it is cut, with a space in front, into the longest pieces
    from the left.  A null, empty or blank text has no words and no tokens.  The automaton, of the
    size of the vocabulary file, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(counter))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.of(shared.value)
        for batch in batches:
            n_words, n_tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for block in kernel.blocks(batch.column(1)):
                found = kernel.words(block)
                sums = kernel.prefix_sums(block.data, kernel.CASED_VALUES)
                _, first, word, _ = kernel.distinct(kernel.slice_hash(sums, found.starts, found.ends))
                pieces = counter.counts(block.data, found.starts[first], found.ends[first])
                running = np.concatenate(([0], np.cumsum(pieces[word])))
                rows = slice(block.first, block.first + block.rows)
                n_words[rows], n_tokens[rows] = np.diff(found.bounds), np.diff(running[found.bounds])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    own = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {own}, n_words long, n_tokens long")
