"""Comparison of arrays of free-text statements by content.

Two arrays are the same if they hold the same set of statements, where order,
repetition, letter case, white space and blank or null statements do not count
and a null array equals an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind, as a character class for Java and for RE2 alike.
WHITE_SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+"


def normal_statement(text: Column) -> Column:
    """``text`` without white space and letter case; ``upper`` first, so that one
    letter with two lower-case forms (or none of one letter) compares equal."""
    return F.lower(F.upper(F.regexp_replace(text, WHITE_SPACE, "")))


def statement_set(statements: Column) -> Column:
    """Sorted distinct normal statements; null and all-blank arrays give an empty array."""
    kept = F.filter(F.transform(statements, normal_statement), lambda s: s.isNotNull() & (s != ""))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def statement_digest(*arrays: Column) -> Column:
    """64-bit digest of one or more statement arrays, taken together.

    It is only ever compared within one entity, where an accidental match of two
    different states has a chance of 2^-64 for each comparison.
    """
    parts: list[Column] = []
    for array in arrays:
        normal = statement_set(array)
        parts += [F.size(normal), normal]
    return F.xxhash64(*parts)
