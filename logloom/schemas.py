"""Schemas of the records between the stages."""

from __future__ import annotations

RAW = "source_id string, source_type string, raw_text string, ingested_at_utc timestamp, attributes map<string,string>"
PARSED = RAW + ", tier string, fields map<string,string>, parsed_message string"
_META = (
    "source_id string, source_type string, timestamp_utc timestamp, severity string, service_name string, trace_id string, {text}log_hash string, "
    "payload map<string,string>, correlation_id string, module string, method string, log_source string, destination string, brn string, "
    "billing_account string, denomination_id string, account_id string, ip string, status_code int"
)
NORMALIZED = _META.format(text="message string, ")
CHUNK = _META.format(text="") + ", chunk_index int, chunk_id string, text string"
POINT = CHUNK + ", point_id string, vector array<float>"
MESSAGES = "session_id string, seq bigint, role string, content string, ts timestamp"


def names(schema: str) -> list[str]:
    """Top-level column names of one of these schemas."""
    depth, out, start = 0, [], 0
    for k, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:k].split()[0])
            start = k + 1
    return out
