"""Token ids of whole texts by public tokenizers, each distinct slice of text encoded once.

A text is cut where no token of the vocabulary can reach across, so the ids of a text are
the ids of its slices in order.  Slices repeat, so a task remembers their ids up to a bound.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

from filecensus.llm import kernel

#: Remembered slices and ids of a task; beyond them the memory starts anew.
SLICE_BOUND, ID_BOUND = 1 << 19, 1 << 23

PRINTED = np.zeros(256, dtype=bool)  # ASCII that is neither white space nor control
PRINTED[0x21:0x7F] = True
LETTER = np.zeros(256, dtype=bool)
for _low in (ord("A"), ord("a")):
    LETTER[_low : _low + 26] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[ord("0") : ord("9") + 1] = True
MARK = PRINTED & ~LETTER & ~DIGIT


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers by its name; a path is left as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def library_tokenizer(path: str, plain_specials: bool):
    """A vocabulary file of the ``tokenizers`` library; ``plain_specials`` takes special tokens as text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


def library_encoder(path: str, plain_specials: bool) -> Callable[[list[str]], list[list[int]]]:
    tokenizer = library_tokenizer(path, plain_specials)
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


#: Words that are encoded in one text, and what they consist of.
JOINED = 1000
LATIN_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def word_encoder(path: str, word_end: str = "</w>") -> Callable[[list[str]], list[list[int]]]:
    """As ``library_encoder`` for a vocabulary of lower-case words that marks word ends.

    Its normalizer and pattern do no more to a word of Latin-1 letters than to lower them, so such words go
    to the model directly, many in one text: each ends with an id whose entry has the mark.
    """
    tokenizer = library_tokenizer(path, plain_specials=False)
    from tokenizers import Tokenizer, pre_tokenizers

    model = Tokenizer(tokenizer.model)
    model.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    entries = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(entries.values()) + 1, dtype=bool)
    ends[[i for entry, i in entries.items() if entry.endswith(word_end)]] = True

    def encode(texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(texts)
        is_plain = [LATIN_WORD.fullmatch(t) is not None for t in texts]
        plain = [k for k, p in enumerate(is_plain) if p]
        other = [k for k, p in enumerate(is_plain) if not p]
        parts = [plain[low : low + JOINED] for low in range(0, len(plain), JOINED)]
        joined = [" ".join([texts[k] for k in part]).lower() for part in parts]
        for part, found in zip(parts, model.encode_batch_fast(joined, add_special_tokens=False)):
            ids = found.ids
            cuts = (np.flatnonzero(ends[ids]) + 1).tolist()
            if len(cuts) != len(part):
                raise ValueError("the vocabulary does not end every word with the mark")
            for k, low, high in zip(part, [0, *cuts], cuts):
                out[k] = ids[low:high]
        for k, found in zip(other, tokenizer.encode_batch_fast([texts[k] for k in other], add_special_tokens=False)):
            out[k] = found.ids
        return out

    return encode


class Slices(NamedTuple):
    """Slice i is data[starts[i]:ends[i]]; row r has the slices bounds[r] to bounds[r + 1] - 1."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def _row_starts(block: kernel.Block) -> np.ndarray:
    begins = np.zeros(len(block.data), dtype=bool)
    first = block.offsets[:-1]
    begins[first[first < block.offsets[1:]]] = True
    return begins


def before_spaces(block: kernel.Block) -> Slices:
    """Rows cut in front of every space that follows a printed ASCII character.

    No pattern of a byte-level vocabulary and no piece with a space mark inside reaches across.
    """
    begins = _row_starts(block)
    begins[1:] |= (block.data[1:] == 0x20) & PRINTED[block.data[:-1]]
    starts = np.flatnonzero(begins)
    return Slices(starts, np.append(starts[1:], len(block.data)), np.searchsorted(starts, block.offsets))


def between_spaces(block: kernel.Block) -> Slices:
    """Words between ASCII white space, cut between a letter and a mark too.

    A word with ``<`` stays whole, since it may be the text of a special token.
    """
    found = kernel.words(block)
    data = block.data
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = MARK[data[1:]] & LETTER[data[:-1]]
    opened = np.flatnonzero(data == ord("<"))
    for word in np.unique(np.searchsorted(found.starts, opened, side="right") - 1).tolist():
        cut[found.starts[word] : found.ends[word]] = False
    begins = cut.copy()
    begins[found.starts] = True
    starts = np.flatnonzero(begins)
    word = np.searchsorted(found.starts, starts, side="right") - 1
    ends = np.minimum(found.ends[word], np.append(starts[1:], len(data)))
    return Slices(starts, ends, np.searchsorted(starts, block.offsets))


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + counts[i]] of every i, one after the other."""
    before = np.cumsum(counts) - counts
    return flat[np.repeat(starts - before, counts) + np.arange(int(counts.sum()))]


class SliceIds:
    """Ids of slices under one or more encoders, by a 64-bit hash of the slice."""

    def __init__(self, *encoders: Callable[[list[str]], list[list[int]]]):
        self.encoders = encoders
        self._clear()

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.flat = [np.zeros(0, np.int32) for _ in self.encoders]
        self.used = [0] * len(self.encoders)
        self.starts = [np.zeros(0, np.int64) for _ in self.encoders]
        self.counts = [np.zeros(0, np.int64) for _ in self.encoders]

    def _add(self, which: int, lists: list[list[int]]) -> None:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        used, total = self.used[which], int(counts.sum())
        if used + total > len(self.flat[which]):
            self.flat[which] = np.concatenate((self.flat[which][:used], np.zeros(used + total + 4096, np.int32)))
        self.flat[which][used : used + total] = np.fromiter((i for ids in lists for i in ids), np.int32, total)
        self.used[which] = used + total
        self.starts[which] = np.append(self.starts[which], used + np.cumsum(counts) - counts)
        self.counts[which] = np.append(self.counts[which], counts)

    def lookup(self, block: kernel.Block, slices: Slices, hashes: np.ndarray) -> np.ndarray:
        """A number per slice, for :meth:`ids`; valid until the next lookup."""
        if len(self.index) > SLICE_BOUND or max(self.used) > ID_BOUND:
            self._clear()
        values, first, which, _ = kernel.distinct(hashes)
        known = len(self.index)
        own = np.fromiter((self.index.setdefault(h, len(self.index)) for h in values.tolist()), np.int64, len(values))
        fresh = np.flatnonzero(own >= known)  # numbered in the order of values
        if len(fresh):
            raw = block.data.tobytes()
            low, high = slices.starts[first[fresh]].tolist(), slices.ends[first[fresh]].tolist()
            texts = [raw[a:b].decode() for a, b in zip(low, high)]
            for n, encode in enumerate(self.encoders):
                self._add(n, encode(texts))
        return own[which]

    def ids(self, numbers: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slices in order, and how many each slice has."""
        counts = self.counts[which][numbers]
        return gather(self.flat[which], self.starts[which][numbers], counts), counts


def per_row(counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the slices' counts by row."""
    running = np.concatenate(([0], np.cumsum(counts)))
    return np.diff(running[bounds])
