"""Column expressions on POSIX mode bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filecensus.functions.text import strings

# File-type bits and the letter each shows first in a mode string.
FILE_TYPES = {0o140000: "s", 0o120000: "l", 0o100000: "-", 0o060000: "b", 0o040000: "d", 0o020000: "c", 0o010000: "p"}


TRIPLES = ["---", "--x", "-w-", "-wx", "r--", "r-x", "rw-", "rwx"]


def _triple(mode: Column, shift: int, special: int, letter: str) -> Column:
    """Read, write and execute of one class; a special bit replaces the execute letter."""
    bits = F.shiftright(mode, shift).bitwiseAND(F.lit(7))
    plain = F.element_at(strings(TRIPLES), bits + 1)
    mark = F.when(bits.bitwiseAND(F.lit(1)) != 0, letter).otherwise(letter.upper())
    marked = F.concat(F.substr(plain, F.lit(1), F.lit(2)), mark)
    return F.when(mode.bitwiseAND(F.lit(special)) != 0, marked).otherwise(plain)


def mode_string(mode: Column) -> Column:
    """Ten characters such as ``-rw-r--r--``."""
    kind = F.create_map(*[F.lit(v) for pair in FILE_TYPES.items() for v in pair])
    first = F.coalesce(F.try_element_at(kind, mode.bitwiseAND(F.lit(0o170000))), F.lit("?"))
    return F.concat(
        first,
        _triple(mode, 6, 0o4000, "s"),
        _triple(mode, 3, 0o2000, "s"),
        _triple(mode, 0, 0o1000, "t"),
    )
