"""Raw entries to named fields: noise filter and parser tiers.

The tiers, in order: JSON, timestamp and JSON, timestamp and pairs, five comma parts, configured patterns, pairs,
timestamp and text, text. What needs exact JSON or a scan for pairs runs in one Arrow function, which sees only
texts that can be of those tiers; all else is built-in expressions. Null texts have no fields and a null message.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.config import NOISE, SYSLOG_RULE, RegexRule
from logloom.functions.jsontext import Fields, as_text, object_items
from logloom.functions.text import first_non_blank, non_blank, trim, trim_quotes

# The names of comma parts, of the message, and of fields that may hold nested JSON.
COMMA_NAMES = ("timestamp", "severity", "service_name", "trace_id", "message")
MESSAGE_NAMES = ("message", "msg", "log", "text")
NESTED_NAMES = ("MessageBody", "message", "ExtraData", "payload")
# The shapes of lines.
STAMP = r"\d{4}-\d{2}-\d{2}(?:[ T]\d{2}\s*:\s*\d{2}\s*:\s*\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?"
STAMPED = rf"^({STAMP})\s+([\s\S]+)$"
STAMPED_JSON = rf"^({STAMP})\s+(\{{[\s\S]+\}})\s*$"
MARKER = r'"([a-zA-Z0-9_\-]+)"\s*:\s*|\b([a-zA-Z0-9_\-]+)\s*=\s*'
PAIR = r'([a-zA-Z_][a-zA-Z0-9_]*)=("[^"]+"|\S+)'
LEVEL = r"^(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\b[:\- ]*([\s\S]*)$"
CORRELATION = r"Correlation[_ ]ID[:=]\s*([a-zA-Z0-9\-:]+)"
REQUEST = r"requestId:\s*([^\s,]+)"

_STAMPED, _STAMPED_JSON, _MARKER, _PAIR = (re.compile(x) for x in (STAMPED, STAMPED_JSON, MARKER, PAIR))
_QUOTED = re.compile(r'"(?:[^"]|(?<=\\)")*"?')
_BARE = re.compile(r"[^, \]}]*")
_BRACE = {"{": re.compile(r'(?<!\\)"|[{}]'), "[": re.compile(r'(?<!\\)"|[\[\]]')}


def drop_noise(raw: DataFrame, patterns: Sequence[str] = NOISE) -> DataFrame:
    """Without entries that match any of the patterns anywhere, in any case. Blank patterns are ignored."""
    used = [f"(?:{p})" for p in patterns if p and p.strip()]
    return raw.filter(~F.coalesce(F.col("raw_text").rlike("(?i)" + "|".join(used)), F.lit(False))) if used else raw


def _nested(fields: Fields) -> None:
    """Properties of nested objects fill fields that are missing, blank or null."""

    def fill(items: list[tuple[str, object, str]]) -> None:
        for name, value, written in items:
            have = fields.find(name)
            text = as_text(value, written, "")
            if (have is None or not have.strip() or have == "null") and text.strip():
                fields[name] = text
            if isinstance(value, dict):
                fill(object_items(written))

    for name in NESTED_NAMES:
        text = (fields.find(name) or "").strip()
        if text.startswith("{"):
            try:
                items = object_items(text)
            except ValueError:
                continue
            fill(items)


def _block(text: str, at: int) -> str:
    """The balanced block that begins at ``at``; brackets within quotes don't count."""
    depth, quoted = 0, False
    for m in _BRACE[text[at]].finditer(text, at):
        if m[0] == '"':
            quoted = not quoted
        elif not quoted:
            depth += 1 if m[0] == text[at] else -1
            if depth == 0:
                return text[at : m.end()]
    return text[at:]


def parse_json(text: str) -> Fields | None:
    if not text.startswith("{"):
        return None
    fields = Fields()
    try:
        for name, value, written in object_items(text):
            fields[name] = as_text(value, written, "null")
    except ValueError:
        return None
    _nested(fields)
    return fields or None


def parse_stamped_json(text: str) -> Fields | None:
    if not (m := _STAMPED_JSON.match(text)):
        return None
    fields = Fields()
    fields["timestamp"] = m[1]
    try:
        for name, value, written in object_items(m[2]):
            fields[name] = as_text(value, written, "")
    except ValueError:
        return None

    def given(name: str) -> str | None:
        value = fields.find(name)
        return value if value and value.strip() else None

    if body := given("MessageBody"):
        fields["message"] = body
    if level := given("LogLevel"):
        fields["severity"] = level
    if (day := given("LogDate")) and (time := given("LogTime")):
        fields["timestamp"] = f"{day} {time}"
    _nested(fields)
    return fields if len(fields) > 1 else None


def parse_stamped_pairs(text: str) -> Fields | None:
    if not (m := _STAMPED.match(text)):
        return None
    rest = m[2].strip()
    fields = Fields()
    fields["timestamp"] = m[1]
    for marker in _MARKER.finditer(rest):
        at = marker.end()
        if at >= len(rest):
            continue
        first = rest[at]
        if first in _BRACE:
            value = _block(rest, at)
        elif first == '"':
            value = _QUOTED.match(rest, at)[0].strip('"')
        else:
            value = _BARE.match(rest, at)[0].strip()
        fields[marker[1] or marker[2]] = value
    if len(fields) < 2:
        return None
    _nested(fields)
    return fields


def parse_pairs(text: str) -> Fields | None:
    fields = Fields()
    for m in _PAIR.finditer(text):
        fields[m[1]] = m[2].strip().strip('"')
    if fields and fields.find("message") is None:
        fields["message"] = text
    return fields or None


_MAP = T.MapType(T.StringType(), T.StringType())


@F.pandas_udf(T.StructType([T.StructField("tier", T.StringType()), T.StructField("json", _MAP), T.StructField("pairs", _MAP)]))
def _scan(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        tier = found = pairs = None
        if text is not None:
            for tier, parser in (("json", parse_json), ("stamped_json", parse_stamped_json), ("stamped_pairs", parse_stamped_pairs)):
                if found := parser(text):
                    break
            else:
                tier, pairs = None, parse_pairs(text)
        rows.append((tier, dict(found) if found else None, dict(pairs) if pairs else None))
    return pd.DataFrame(rows, columns=["tier", "json", "pairs"])


def translate(pattern: str) -> tuple[str, list[tuple[str, int]]]:
    """A pattern with plain groups for named ones, and each name's group number."""
    out, names, count, at = [], [], 0, 0
    token = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?<(?![=!])([^>]+)>|\((?!\?)", re.S)
    for m in token.finditer(pattern):
        out.append(pattern[at : m.start()])
        at = m.end()
        if m[1]:
            count += 1
            names.append((m[1], count))
            out.append("(")
        else:
            count += m[0] == "("
            out.append(m[0])
    return "(?sU)" + "".join(out) + pattern[at:], names


def _rule_fields(text: Column, pattern: str, names: list[tuple[str, int]]) -> Column:
    """The named groups that aren't blank."""
    pairs = []
    for name, number in names:
        pairs += [F.lit(name), trim_quotes(trim(non_blank(F.regexp_extract(text, pattern, number))))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _stamped_text(text: Column) -> Column:
    """Fields of a text that begins with a timestamp."""
    message = trim(F.regexp_extract(text, "(?U)" + STAMPED, 2))
    level = "(?iU)" + LEVEL
    has_level = message.rlike(level)
    trace = non_blank(F.regexp_extract(text, "(?iU)" + CORRELATION, 1))
    request = F.when(trace.isNull(), non_blank(F.regexp_extract(text, "(?iU)" + REQUEST, 1)))
    pairs = {
        "timestamp": F.regexp_extract(text, "(?U)" + STAMPED, 1),
        "message": F.when(has_level, trim(F.regexp_extract(message, level, 2))).otherwise(message),
        "severity": F.when(has_level, F.regexp_extract(message, level, 1)),
        "trace_id": trace,
        "request_id": request,
    }
    made = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v)))
    return F.map_filter(made, lambda _, v: v.isNotNull())


def parse(raw: DataFrame, rules: Sequence[RegexRule] = (SYSLOG_RULE,)) -> DataFrame:
    """``raw`` with ``tier``, ``fields`` and ``parsed_message``.

    The tier of a row is settled first, by one test after the other; then only that tier's fields are made.
    """
    t = F.col("_text")
    # All that the scanned tiers can match holds one of these marks.
    scannable = t.contains("{") | t.contains("=") | t.contains('"')
    scanned = raw.withColumn("_text", trim(F.col("raw_text"))).withColumn("_scan", _scan(F.when(scannable, t)))
    used = [(f"rule:{r.name}", *translate(r.pattern)) for r in rules if r.pattern and r.pattern.strip()]
    used = [(name, pattern, names) for name, pattern, names in used if names]
    parts = F.split(t, ",", 5)
    tier = F.when(F.col("_scan.tier").isNotNull(), F.col("_scan.tier")).when(F.size(parts) == 5, "commas")
    for name, pattern, names in used:
        some = F.concat(*(F.regexp_extract(t, pattern, k) for _, k in names))
        tier = tier.when(t.rlike(pattern) & some.rlike(r"(?U)\S"), name)
    tier = tier.when(F.col("_scan.pairs").isNotNull(), "pairs").when(t.rlike("(?U)" + STAMPED), "stamped_text").when(t.isNotNull(), "text")
    own = F.col("tier")
    commas = F.map_from_arrays(F.array(*map(F.lit, COMMA_NAMES)), F.transform(parts, trim))
    fields = F.when(own == "commas", commas)
    for name, pattern, names in used:
        fields = fields.when(own == name, _rule_fields(t, pattern, names))
    fields = fields.when(own == "pairs", F.col("_scan.pairs")).when(own == "stamped_text", _stamped_text(t))
    fields = fields.when(own == "text", F.create_map(F.lit("message"), "raw_text")).otherwise(F.col("_scan.json"))
    made = scanned.withColumn("tier", tier).withColumn("fields", fields).withColumn("_low", F.transform_keys("fields", lambda k, _: F.lower(k)))
    message = F.when(own == "text", F.col("raw_text")).otherwise(F.coalesce(first_non_blank(F.col("_low"), MESSAGE_NAMES), F.col("raw_text")))
    return made.withColumn("parsed_message", message).drop("_text", "_scan", "_low")
