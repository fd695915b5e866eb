"""Queries of the operators on data in general: times, hot keys, drifting schemas, log lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.operators import drift, loglines, skew, timestamps


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": timestamps.p1_found,
        "p1_normalized": timestamps.normalized,
        "p3_found": skew.p3_found,
        "p3_pairs": skew.p3_pairs,
        "p4_found": drift.p4_found,
        "p4_gaps": drift.p4_gaps,
        "p4_schema": drift.p4_schema,
        "p4_records": drift.p4_records,
        "p7_found": loglines.p7_found,
        "p7_entries": loglines.p7_entries,
    }


_SEVERITIES = {
    "debug": ("DEBUG", "DBG", "TRACE", "VERBOSE"),
    "info": ("INFO", "INF", "INFORMATION", "NOTICE"),
    "warning": ("WARNING", "WARN", "WRN"),
    "error": ("ERROR", "ERR"),
    "critical": ("CRITICAL", "CRIT", "CRT", "FATAL", "FTL"),
}


def _count(name: str, aliases: tuple[str, ...]) -> str:
    quoted = ", ".join(f"'{a}'" for a in aliases)
    return f"count(*) FILTER (WHERE upper(trim(severity)) IN ({quoted})) AS n_{name}"


def oracle_sql() -> dict[str, str]:
    known = ", ".join(f"'{a}'" for x in _SEVERITIES.values() for a in x)
    counts = ", ".join(_count(k, v) for k, v in _SEVERITIES.items())
    return {
        "p3_found": """
            SELECT service_name, module FROM log_entries
            WHERE service_name IS NOT NULL AND module IS NOT NULL
            GROUP BY service_name, module
            HAVING count(*) * 50 > (SELECT count(*) FROM log_entries)""",
        "p3_pairs": f"""
            SELECT service_name, module, count(*) AS n_rows, {counts},
              count(*) FILTER (WHERE severity IS NULL OR upper(trim(severity)) NOT IN ({known})) AS n_other,
              min(load_day) AS first_day, max(load_day) AS last_day,
              count(DISTINCT CASE WHEN lower(trim(trace_id)) NOT IN ('', 'n/a') THEN trace_id END) AS n_traces
            FROM log_entries GROUP BY service_name, module""",
    }
