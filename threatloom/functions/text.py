"""Column helpers for text tests and literal lookups."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only, as tag comparison does."""
    return F.translate(column, _UPPER, _UPPER.lower())


def any_of(column: Column, words: Iterable[str]) -> Column:
    """True if any word occurs.  Plain substring tests stay inside generated code."""
    test = F.lit(False)
    for word in words:
        test = test | column.contains(word)
    return test


def first_of(column: Column, words: Iterable[str]) -> Column:
    """The first listed word that occurs, else null."""
    return F.coalesce(*[F.when(column.contains(word), F.lit(word)) for word in words])


def word_hit(lowered: Column, keyword: str) -> Column:
    """Whole-word hit with ASCII word boundaries.

    Java's ``\\b`` counts letters such as e-acute as word characters, so the boundary is
    spelled out.  The cheap substring test runs first; the regex only on its hits.
    """
    pattern = f"(?<![0-9A-Za-z_]){re.escape(keyword)}(?![0-9A-Za-z_])"
    return lowered.contains(keyword) & lowered.rlike(pattern)


def count_words(lowered: Column, keywords: Iterable[str]) -> Column:
    total = F.lit(0)
    for keyword in keywords:
        total = total + word_hit(lowered, keyword).cast("int")
    return total


def lookup(table: dict, key: Column) -> Column:
    """Value of a fixed table; null when the key is absent.

    The table becomes one constant map in the plan: no join and nothing broadcast.
    """
    entries: list[Column] = []
    for name, value in table.items():
        entries.append(F.lit(name))
        entries.append(literal(value))
    return F.try_element_at(F.create_map(*entries), key)


def literal(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(item) for item in value]) if value else F.array().cast("array<string>")
    return F.lit(value)


def strings(values: Iterable[str]) -> Column:
    """Array of string literals, typed even when empty."""
    values = list(values)
    if values:
        return F.array(*[F.lit(v) for v in values])
    return F.array().cast("array<string>")


def strip_count_suffix(column: Column) -> Column:
    """Cut at the last " (" when there is one."""
    return F.regexp_replace(column, r"(?s)^(.*) \(.*$", "$1")


def truncated(column: Column, limit: int, keep: int | None = None) -> Column:
    """Text cut to ``keep`` characters plus "..." when longer than ``limit``."""
    keep = limit if keep is None else keep
    return F.when(F.length(column) > limit, F.concat(F.substring(column, 1, keep), F.lit("..."))).otherwise(column)


def quoted_path(line: Column) -> Column:
    """First quoted part that starts with "/", trying the three quote signs in turn."""
    tries = []
    for quote in ('"', "'", "`"):
        parts = F.filter(F.split(line, quote), lambda part: part.startswith("/"))
        tries.append(F.when(line.contains(quote), F.try_element_at(parts, F.lit(1))))
    return F.coalesce(*tries, F.lit("unknown"))


def file_location(file: Column, line: Column) -> Column:
    """Location as shown in reports."""
    return (
        F.when(file == "", "-")
        .when(line > 0, F.concat(F.lit("`"), file, F.lit(":"), line.cast("string"), F.lit("`")))
        .otherwise(F.concat(F.lit("`"), file, F.lit("`")))
    )


def repo_name(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(url, "/"), -1), r"\.git$", "")


def repo_short_id(url: Column) -> Column:
    return F.right(url, F.lit(20))
