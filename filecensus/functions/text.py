"""Column expressions on text: regexes with Unicode classes, keyword counts, decoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members of the Unicode classes behind \s, \w and \d, as they stand inside brackets.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CLASSES = {"s": SPACE, "w": r"\p{L}\p{N}_", "d": r"\p{Nd}"}


def unicode_regex(pattern: str) -> str:
    r"""A rule's regex with Unicode ``\s \w \d`` and Unicode case folding for the JVM.

    The JVM's own ``\s`` and ``\w`` are ASCII unless ``(?U)`` is set, and ``(?U)`` counts
    marks and joiners as word characters, so the classes are written out.
    """
    out, in_brackets, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair[0] == "\\" and pair[1:].lower() in CLASSES:
            members = CLASSES[pair[1].lower()]
            if not in_brackets:
                out.append(f"[^{members}]" if pair[1].isupper() else f"[{members}]")
            elif pair[1].islower():
                out.append(members)
            else:
                out.append(f"&&[^{members}]")
            i += 2
            continue
        if pair[0] == "\\":
            out.append(pair)
            i += 2
            continue
        if pair[0] in "[]":
            in_brackets = pair[0] == "["
        out.append(pair[0])
        i += 1
    body = "".join(out)
    return "(?d)" + body.replace("(?i)", "(?iu)")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(unicode_regex(pattern))


def matches_any(text: Column, patterns: list[str]) -> Column:
    """True if one of the regexes is found; later ones are not tried after a hit."""
    return reduce(lambda a, b: a | b, [matches(text, p) for p in patterns], F.lit(False))


def strings(values: list[str]) -> Column:
    """A literal array of texts, built in one call."""
    quoted = ("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({', '.join(quoted)})")


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur in the lower-cased text, each counted once."""
    return let(F.lower(text), lambda t: F.size(F.filter(strings(keywords), lambda k: F.contains(t, k))))


def contains_any(text: Column, words: list[str]) -> Column:
    """Does one of the words occur in the lower-cased text?"""
    return let(F.lower(text), lambda t: F.exists(strings(words), lambda w: F.contains(t, w)))


def first_chars(text: Column, limit: int | None) -> Column:
    """The first ``limit`` characters, or the whole text for None."""
    return text if limit is None else F.substr(text, F.lit(1), F.lit(limit))


def decode_ignoring_errors(raw: Column) -> Column:
    """UTF-8 bytes as text without the bytes that are not valid UTF-8; line ends become ``\\n``."""
    text = F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n")


def magic(raw: Column, length: int) -> Column:
    """Upper-case hex of the first bytes."""
    return F.hex(F.substr(raw, F.lit(1), F.lit(length)))


def machine_id(mac: Column, hostname: Column) -> Column:
    return F.substr(F.sha2(F.concat(mac, F.lit(":"), hostname), 256), F.lit(1), F.lit(16))
