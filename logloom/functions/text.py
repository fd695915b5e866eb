"""Column functions on text: blank tests, trimming, folding, hashing, redaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secrets and what stands in for them, in this order.
REDACTIONS = (
    (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", "[REDACTED_JWT]"),
    (r"(?i)(password|pwd)(?U:\s*)=(?U:\s*)[^;\"'\s]+", "$1=[REDACTED]"),
    (r"(?i)(api[_-]?key|apikey|x-api-key)(?U:\s*)[=:](?U:\s*)[A-Za-z0-9_\-]{16,}", "$1=[REDACTED_KEY]"),
    (r"(?i)Bearer(?U:\s+)[A-Za-z0-9_\-\.]{20,}", "Bearer [REDACTED_TOKEN]"),
)
# Short spellings of severities.
SEVERITY_ALIASES = {"WARN": "WARNING", "ERR": "ERROR", "CRIT": "CRITICAL"}


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def non_blank(c: Column) -> Column:
    return F.when(c.rlike(r"(?U)\S"), c)


def trim_quotes(c: Column) -> Column:
    return F.regexp_replace(c, r'^"+|"+$', "")


def first_non_blank(fields: Column, keys: Sequence[str]) -> Column:
    """The first value of ``keys`` (lower case) in a map with lower-case keys that isn't blank."""
    return F.coalesce(*(non_blank(F.try_element_at(fields, F.lit(k))) for k in keys))


def fold_severity(c: Column) -> Column:
    """Upper case, with short spellings written out; others stay as they are."""
    upper = F.upper(trim(c))
    out = F.coalesce(*(F.when(upper == a, F.lit(b)) for a, b in SEVERITY_ALIASES.items()), upper)
    return out


def event_hash(source_id: Column, raw_text: Column) -> Column:
    """SHA-256 of source and text, in hex."""
    return F.sha2(F.concat(source_id, F.lit("|"), raw_text).cast("binary"), 256)


def point_id(chunk_id: Column) -> Column:
    """MD5 of the chunk id, written as a GUID: its first three groups are little-endian."""
    h = F.md5(chunk_id.cast("binary"))

    def group(*pairs: int) -> Column:
        return F.concat(*(F.substring(h, 2 * p + 1, 2) for p in pairs))

    return F.concat_ws("-", group(3, 2, 1, 0), group(5, 4), group(7, 6), group(8, 9), group(10, 11, 12, 13, 14, 15))


def redact(c: Column, rules: Sequence[tuple[str, str]] = REDACTIONS) -> Column:
    """The text with its secrets replaced, rule by rule."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(replacement))
    return c


def tokens(c: Column) -> Column:
    """Words between spaces, trimmed, without empty ones. Line breaks within a word stay.

    White space with a space in it parts words, so one replacement and one split do it, without a function on every word.
    """
    joined = trim(F.regexp_replace(c, r"(?U)(?<!\s)[\s&&[^ ]]*+ \s*+", " "))
    return F.when(joined != "", F.split(joined, " ")).otherwise(F.when(c.isNotNull(), F.array().cast("array<string>")))


def terms(question: Column) -> Column:
    """Distinct lower-case terms of a question."""
    return F.array_distinct(F.filter(F.split(F.lower(question), r"[ \t\r\n.,:;\-_]"), lambda x: x != ""))


def overlap(question_terms: Column, text: Column) -> Column:
    """Share of the terms that the text contains anywhere; 0 without terms."""
    low = F.lower(text)
    hits = F.size(F.filter(question_terms, lambda t: F.contains(low, t)))
    return F.when(F.size(question_terms) > 0, hits / F.size(question_terms)).otherwise(F.lit(0.0))


def iso(ts: Column) -> Column:
    """A timestamp as text with seven decimals and the offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSxxx")
