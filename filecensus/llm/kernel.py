"""Vectorised byte kernels: texts of one Arrow batch as one byte buffer with row offsets.

All kernels work on UTF-8 bytes, treat a null text as empty, never let a word or window
cross two rows, and hold one block of about ``BLOCK`` bytes (or one longer text) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
#: Bytes whose hash sums are held at once, 8 bytes each, to stay in a core's cache.
HASHED_AT_ONCE = 1 << 16
SPACE = b" \t\n\x0b\x0c\r"

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_values() -> np.ndarray:
    """A fixed 64-bit value per byte, A-Z valued as a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


VALUES = _byte_values()
CASED_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
SPACED = np.ones(256, dtype=bool)
SPACED[list(SPACE)] = False
ALNUM = np.zeros(256, dtype=bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_low : _high + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: list[np.ndarray] = []


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least ``size`` of each."""
    if not _powers or len(_powers[0]) < size:
        size = max(size, BLOCK + 4096)
        _powers[:] = [
            np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, b, dtype=np.uint64))))
            for b in (_BASE, _INVERSE)
        ]
    return _powers[0], _powers[1]


class Block(NamedTuple):
    """Rows ``first`` to ``first + len(offsets) - 1`` of a batch; row i is data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """The rows of a text or binary column in order, in blocks of at most ``size`` bytes or one row."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        own = offsets[first : last + 1]
        yield Block(first, data[own[0] : own[-1]], own - own[0])
        first = last


class Words(NamedTuple):
    """Word i is data[starts[i]:ends[i]]; row r has the words bounds[r] to bounds[r + 1] - 1."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def words(block: Block, members: np.ndarray = SPACED) -> Words:
    """Maximal runs of bytes of ``members`` (default: anything but ASCII white space) inside rows."""
    size = len(block.data)
    inside = np.zeros(size + 2, dtype=bool)
    inside[1:-1] = members[block.data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = block.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < size)]
    begins[cuts] = inside[1:-1][cuts]
    ends[cuts - 1] = inside[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, block.offsets))


def prefix_sums(data: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Running sums of byte values times powers: any slice's hash is a difference of two."""
    power, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=sums[1:])
    return sums


def slice_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices; equal bytes give equal hashes wherever they stand."""
    _, inverse = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(block: Block, found: Words) -> np.ndarray:
    return slice_hash(prefix_sums(block.data), found.starts, found.ends)


def word_hashes_in_parts(block: Block, found: Words) -> np.ndarray:
    """As :func:`word_hashes`, for at most ``HASHED_AT_ONCE`` bytes or one word at a time; a hash does not depend on the place."""
    out = np.empty(len(found.starts), np.uint64)
    low = 0
    while low < len(out):
        first = found.starts[low]
        high = max(low + 1, int(np.searchsorted(found.ends, first + HASHED_AT_ONCE, side="right")))
        starts, ends = found.starts[low:high] - first, found.ends[low:high] - first
        out[low:high] = slice_hash(prefix_sums(block.data[first : first + ends[-1]]), starts, ends)
        low = high
    return out


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values ascending, a place of each, which one every value is, and how often each comes."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    which = np.empty(len(values), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[first], order[first], which, np.diff(np.append(first, len(values)))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (across rows too; mask by row)."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + count]
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in two passes whatever the width."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list column of the values between consecutive bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
