"""Column expressions on file names and ``/``-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading dots belong to the stem; the suffix starts at the last dot after them.
SUFFIX_REGEX = r"(?s)^\.*[^.].*?(\.[^.]*)\z"


def extension(name: Column) -> Column:
    """Lower-cased last suffix with its dot, or NULL."""
    return F.nullif(F.lower(F.regexp_extract(name, SUFFIX_REGEX, 1)), F.lit(""))


def stem(name: Column) -> Column:
    """Lower-cased name without its last suffix."""
    lowered = F.lower(name)
    suffix = F.regexp_extract(lowered, SUFFIX_REGEX, 1)
    return F.substr(lowered, F.lit(1), F.length(lowered) - F.length(suffix))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Path up to the last slash; NULL for a path without one."""
    cut = F.length(path) - F.length(basename(path)) - 1
    return F.when(cut > 0, F.substr(path, F.lit(1), cut)).when(cut == 0, F.lit("/"))


def relative(path: Column, root: Column) -> Column:
    """``path`` below ``root`` without a leading slash (``path`` must start with ``root``)."""
    return F.ltrim(F.substr(path, F.length(root) + 1), F.lit("/"))


def depth(relpath: Column) -> Column:
    """Number of folders between the root and the entry; entries of the root have 0."""
    return F.length(relpath) - F.length(F.replace(relpath, F.lit("/"), F.lit("")))


def ancestors(relpath: Column) -> Column:
    """Every folder above ``relpath``, relative and shallowest first; ``""`` is the root."""
    parts = F.split(relpath, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
