"""Masking, search and naming of text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a secret and what replaces it. Word starts and blanks are spelled out so that
# they mean the same on every Java release.
_BLANK = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_START = r"(?<![A-Za-z0-9_])"
SECRET_PATTERNS = (
    # (text that must occur for the pattern to match, lower case; pattern; replacement)
    (("://",), rf"(?i)(postgres(?:ql)?://[^:{_BLANK}/@]+:)[^@{_BLANK}]+@", "$1[REDACTED]@"),
    (("bearer",), rf"(?i){_START}Bearer[{_BLANK}]+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (("eyj",), rf"{_START}eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}", "[REDACTED_JWT]"),
    (("sb_",), rf"{_START}sb_(secret|publishable)_[A-Za-z0-9_-]+", "[REDACTED_SUPABASE_KEY]"),
    (
        ("passw", "pwd", "secret", "token", "key", "authorization"),
        rf"(?i){_START}(password|passwd|pwd|secret|token|api[_-]?key|service[_-]?role[_-]?key|authorization)"
        rf"[{_BLANK}]*[=:][{_BLANK}]*(\"[^\"]*\"|'[^']*'|[^{_BLANK},;]+)",
        "$1=[REDACTED]",
    ),
)
MAX_LOG_TEXT = 1000

# Fact names that may carry personal data or secrets.
FORBIDDEN_FACT = r"(?i)password|secret|token|key|phone|email|name|address"


def redact(text: Column) -> Column:
    """Mask secrets in the whole text.

    A plain substring test decides whether a pattern has to run at all; most texts hold no secret.
    """
    lower, masked = F.lower(text), text
    for hints, pattern, replacement in SECRET_PATTERNS:
        possible = reduce(lambda a, b: a | b, (lower.contains(h) for h in hints))
        masked = F.when(possible, F.regexp_replace(masked, pattern, replacement)).otherwise(masked)
    return masked


def shorten(text: Column, max_length: int = MAX_LOG_TEXT) -> Column:
    """The first ``max_length`` characters and an ellipsis, for those who want less than the whole text."""
    return F.when(F.length(text) > max_length, F.concat(F.substring(text, 1, max_length), F.lit("…"))).otherwise(text)


def contains_text(columns: Sequence[Column], query: str) -> Column:
    """Case-insensitive substring in any of several columns; an empty query matches everything."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    texts = (F.lower(F.coalesce(c.cast("string"), F.lit(""))).contains(wanted) for c in columns)
    return reduce(lambda a, b: a | b, texts)


def allow_list_fields(record: Column, fields: Mapping[str, str]) -> Column:
    """Keep only the listed fields of a JSON record; everything else is dropped by the schema."""
    return F.from_json(record, ", ".join(f"`{name}` {kind}" for name, kind in fields.items()))


def forbidden_facts(facts: Column) -> Column:
    """Keys of a map that must not appear in a message."""
    return F.filter(F.map_keys(facts), lambda k: k.rlike(FORBIDDEN_FACT))


def qualified_name(schema: Column, table: Column) -> Column:
    return F.when(schema == "public", table).otherwise(F.concat_ws(".", schema, table))


def short_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^public\.", "")


def file_safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.-]", "_")


def scope(df: DataFrame, column: str, value: str | int | None) -> DataFrame:
    """Optional equality filter: no value means no filter at all in the plan."""
    return df if value is None else df.where(F.col(column) == value)
