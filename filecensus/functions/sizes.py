"""Column expressions for byte sizes, times and short labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Binary units of the size texts.
UNITS = {"B": 0, "K": 1, "KB": 1, "M": 2, "MB": 2, "G": 3, "GB": 3, "T": 4, "TB": 4}
SIZE_REGEX = r"^(\d+(?:\.\d+)?)\s*([A-Z]{0,2})$"


def format_size(size: Column) -> Column:
    """``N B`` below 1024, else one decimal in KB to PB; NULL counts as 0.

    ``bround`` goes first because ``%.1f`` on the JVM rounds ties up, while the size texts
    round them to even.
    """
    size = F.coalesce(size, F.lit(0))
    text = F.when(size < 1024, F.concat(size.cast("long").cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        shown = F.format_string(f"%.1f {unit}", F.bround(size / float(1024**power), 1))
        text = text.when(size / float(1024**power) < 1024, shown)
    return text.otherwise(F.format_string("%.1f PB", F.bround(size / float(1024**5), 1)))


def parse_size(text: Column, strict: bool = True) -> Column:
    """Bytes of a text such as ``1.5GB``; bad text is an error, or NULL if not ``strict``."""
    cleaned = F.upper(F.trim(text))
    number = F.regexp_extract(cleaned, SIZE_REGEX, 1).try_cast("double")
    unit = F.regexp_extract(cleaned, SIZE_REGEX, 2)
    factor = F.when(unit == "", F.lit(1.0))
    for name, power in UNITS.items():
        factor = factor.when(unit == name, F.lit(float(1024**power)))
    value = (number * factor).cast("long")
    if not strict:
        return value
    bad = F.raise_error(F.concat(F.lit("Invalid size format: "), text))
    return F.when(text.isNull() | value.isNotNull(), value).otherwise(bad.cast("long"))


def size_option(text: str) -> int:
    """Bytes of a size text given as a job option (driver side): a number, then a unit or nothing."""
    cleaned = text.strip().upper()
    number = cleaned.rstrip("".join(UNITS)).rstrip()
    power = UNITS.get(cleaned[len(number) :].strip() or "B")
    whole, point, part = number.partition(".")
    if power is None or not whole.isdecimal() or (point and not part.isdecimal()):
        raise ValueError(f"not a size: {text!r}; give a number and one of {', '.join(UNITS)}")
    return int(float(number) * 1024**power)


def format_timestamp(seconds: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-dd HH:mm:ss`` in the session time zone, floored."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd HH:mm:ss")


def round_half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def short_hash(digest: Column) -> Column:
    """First 12 characters and an ellipsis."""
    return F.concat(F.substr(digest, F.lit(1), F.lit(12)), F.lit("…"))


def extension_label(extension: Column) -> Column:
    """Blank extensions are shown as ``[dir]``."""
    return F.coalesce(F.nullif(extension, F.lit("")), F.lit("[dir]"))


def bar_percent(size: Column, largest: Column) -> Column:
    """Share of the largest entry in percent, one decimal; the largest counts as 1 at least."""
    return F.bround(size / F.greatest(largest, F.lit(1)) * 100, 1)
