"""Column functions over log text: masks, tokens, templates and their presentation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILDCARD = "<#*#>"

Mask = tuple[str, str]


def _java_replacement(text: str) -> str:
    """RE2 replacement text (``\\1`` groups, ``\\\\`` backslash) in Java's notation."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            nxt = text[i + 1]
            out.append(f"${nxt}" if nxt.isdigit() else "\\\\")
            i += 2
            continue
        out.append("\\$" if c == "$" else c)
        i += 1
    return "".join(out)


def mask(content: Column, masks: Iterable[Mask]) -> Column:
    """Replace every match of each mask, in list order."""
    return reduce(
        lambda c, m: F.regexp_replace(c, F.lit(m[0]), F.lit(_java_replacement(m[1]))), masks, content
    )


def pad_delimiters(masked: Column, delimiters: Iterable[str]) -> Column:
    """Put one space behind every delimiter character."""
    return reduce(lambda c, d: F.replace(c, F.lit(d), F.lit(f"{d} ")), delimiters, masked)


def tokenize(padded: Column) -> Column:
    """Split on single spaces, keeping empty tokens."""
    return F.split(padded, " ", -1)


def token_count(tokens: Column) -> Column:
    return F.size(tokens).cast("long")


def parameter_count(masked: Column) -> Column:
    """1 if the masked text holds a placeholder, else 0 (the pattern is greedy, so it matches once)."""
    return masked.rlike(r"<#.*#>").cast("long")


def template_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, NULL as the empty string."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def name_matches(path: Column, keyword: str) -> Column:
    """Case-folded substring search in the file name."""
    return F.contains(F.lower(basename(path)), F.lit(keyword.strip().lower()))


def status(is_extracted: Column) -> Column:
    return F.when(is_extracted, F.lit("EXTRACTED")).otherwise(F.lit("NOT_EXTRACTED"))


def in_all(filters: dict[str, Sequence[str]]) -> Column:
    """``col IN (values)`` per column, AND across columns; no filters keep every row."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f"`{c}`").cast("string").isin(list(values)) for c, values in filters.items()],
        F.lit(True),
    )


def contains_keyword(column: Column, keyword: str, ignore_case: bool = False) -> Column:
    text = column.cast("string")
    if ignore_case:
        return F.contains(F.lower(text), F.lit(keyword.lower()))
    return F.contains(text, F.lit(keyword))
