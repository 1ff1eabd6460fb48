"""Column builders over text: pattern tables, whitespace, fences, counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from gradeloom import fixed_values as fv

UNICODE = "(?U)"
UNICODE_NOCASE = "(?iU)"


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """True when `pattern` is found; word classes are Unicode-aware."""
    return F.coalesce(text, F.lit("")).rlike((UNICODE_NOCASE if ignore_case else UNICODE) + pattern)


def count_matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    flags = UNICODE_NOCASE if ignore_case else UNICODE
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(flags + pattern)).cast("bigint")


def first_match(text: Column, table: Iterable[tuple[str, str]], default: Column | None = None) -> Column:
    """Ordered pattern table as one CASE WHEN: the first pattern found decides."""
    chain = None
    for pattern, value in table:
        test = text.rlike(pattern)
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return chain.otherwise(F.lit(None) if default is None else default)


def contains_any(text: Column, markers: Iterable[str]) -> Column:
    """OR of plain substring tests; stays in whole-stage codegen."""
    test = F.lit(False)
    for marker in markers:
        test = test | text.contains(marker)
    return test


def count_contained(text: Column, markers: Iterable[str]) -> Column:
    """How many of the markers occur (each counted once)."""
    total = F.lit(0)
    for marker in markers:
        total = total + text.contains(marker).cast("int")
    return total.cast("bigint")


def squash(text: Column) -> Column:
    """Runs of whitespace become one space; ends trimmed; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Whitespace off both ends; looks at the ends only."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a plain string, by length difference."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit(""))))
            / F.lit(len(needle))).cast("bigint")


def extension(path: Column) -> Column:
    """Text after the last dot, lower case; the whole path when there is none."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def language_of(path: Column) -> Column:
    ext = extension(path)
    chain = None
    for suffix, name in fv.LANGUAGE_OF_EXTENSION.items():
        chain = (F.when(ext == suffix, name) if chain is None else chain.when(ext == suffix, name))
    return chain.otherwise(ext)


def extract_code(reply: Column) -> Column:
    """Longest fenced block (first on ties) without its outer newlines, else the trimmed reply."""
    blocks = F.regexp_extract_all(reply, F.lit("(?s)" + fv.FENCE), F.lit(1))
    ranked = F.transform(blocks, lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("at"), b.alias("b")))
    longest = F.array_max(ranked).getField("b")
    return F.when(F.size(blocks) > 0, F.regexp_replace(longest, r"^\n+|\n+$", "")).otherwise(strip(reply))


def has_code(text: Column) -> Column:
    return matches(text, fv.HAS_CODE)


def looks_like_code(text: Column) -> Column:
    parts = lines(text)
    codey = F.size(F.filter(parts, lambda l: l.rlike(UNICODE + fv.CODE_LIKE_LINE)))
    return (F.size(parts) >= 3) & (codey >= 2)
