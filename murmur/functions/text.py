"""Column helpers for text rules; all stay in the JVM. NULL text gives NULL or 0 as stated by SQL."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def contains_any(c: Column | str, items: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in items:
        out = out | F.contains(F.col(c) if isinstance(c, str) else c, F.lit(w))
    return out


def count_sub(c: Column | str, w: str) -> Column:
    """Number of non-overlapping occurrences of w. Bytes are counted, which a string knows, not characters."""
    c = F.col(c) if isinstance(c, str) else c
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(w), F.lit("")))) / len(w.encode())).cast("bigint")


def count_all(c: Column | str, items: Sequence[str]) -> Column:
    """Occurrences of all items together; overlapping items count each for itself."""
    total = F.lit(0).cast("bigint")
    for w in items:
        total = total + count_sub(c, w)
    return total


def first_match(c: Column | str, table: Iterable[tuple[str, str | None]], default: str | None = None) -> Column:
    """Value of the first key of the table that the text contains."""
    c = F.col(c) if isinstance(c, str) else c
    out = None
    for key, value in table:
        hit = F.contains(c, F.lit(key))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(default).cast("string") if out is None else out.otherwise(F.lit(default))


def first_rule(c: Column | str, table: Iterable[tuple[str, str]]) -> Column:
    """First value whose pattern is found."""
    out = None
    for value, pattern in table:
        hit = F.rlike(c, F.lit(f"(?d){pattern}"))
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(None).cast("string") if out is None else out


def first_words(c: Column | str, table: Iterable[tuple[str, Sequence[str]]]) -> Column:
    """First value of which any word is contained."""
    out = None
    for value, items in table:
        hit = contains_any(c, items)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return F.lit(None).cast("string") if out is None else out


def missing(c: Column | str, to: str = "unknown") -> Column:
    """NULL and '' become `to`."""
    return F.coalesce(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(to))


def sentences(c: Column | str, pattern: str) -> Column:
    """Stripped sentences that aren't empty, as an array."""
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def pct(cond: Column, digits: int = 1) -> Column:
    """Share of rows in per cent; rows where the condition is NULL count as not fulfilled."""
    return F.bround(F.avg(F.coalesce(cond.cast("int"), F.lit(0))) * 100, digits)


def around(text: Column, position: Column, size: Column, n: int) -> Column:
    """Text from n characters before a match (1-based position) to n after it."""
    start = F.greatest(F.lit(1), position - n)
    return F.substring(text, start, position - start + size + n)


def percent_text(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))
