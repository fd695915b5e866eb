"""Problem 3: results for every key although a handful of keys holds most rows.

The input is read in equal splits. In each split the keys are dictionary-encoded and counted into dense numpy
arrays (bincount by key and severity, scatter-reduced spans of days); only one small block of arrays for each key
in the split leaves it, and the blocks are summed by a distributed reduction. So a key that holds a third of all
rows costs each split as much as any other, and the reduction sees one row of it a split.

Defined results: keys are taken as written, null and blank ones too, as groups of their own (nulls together).
Severities outside the five are counted as other, null ones too. Trace ids that are null, blank or ``n/a`` are no
traces. Repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", "OTHER")
# Spellings and abbreviations of severities.
ALIASES = {
    "DEBUG": ("DEBUG", "DBG", "TRACE", "VERBOSE"),
    "INFO": ("INFO", "INF", "INFORMATION", "NOTICE"),
    "WARNING": ("WARNING", "WARN", "WRN"),
    "ERROR": ("ERROR", "ERR"),
    "CRITICAL": ("CRITICAL", "CRIT", "CRT", "FATAL", "FTL"),
}
_CODE = {alias: SEVERITIES.index(name) for name, aliases in ALIASES.items() for alias in aliases}
#: A split hands on its arrays when it has met so many keys, so that its memory is bounded however many there are.
KEYS_AT_ONCE = 500_000

_BLOCK = "service_name string, module string, counts array<bigint>, first_day int, last_day int"


def _severity_codes(column: pa.Array) -> np.ndarray:
    """0 to 5 for each row; every distinct spelling is looked at once."""
    coded = column.dictionary_encode()
    table = np.array([_CODE.get((x or "").strip().upper(), 5) for x in coded.dictionary.to_pylist()] + [5], np.int64)
    return table[coded.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = len(SEVERITIES)
    ids: dict[tuple, int] = {}
    counts = np.zeros(0, np.int64)
    first, last = np.zeros(0, np.int64), np.zeros(0, np.int64)
    none_first, none_last = np.iinfo(np.int32).max, np.iinfo(np.int32).min

    def flush() -> pa.RecordBatch:
        keys = list(ids)
        n = len(keys)
        seen = first[:n] != none_first
        block = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(counts[: n * width]))
        arrays = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), block]
        arrays += [pa.array(x[:n].astype(np.int32), mask=~seen) for x in (first, last)]
        ids.clear()
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _BLOCK.split(", ")])

    for batch in batches:
        service, module, severity, day = (batch.column(k) for k in range(4))
        a, b = service.dictionary_encode(), module.dictionary_encode()
        a_names, b_names = a.dictionary.to_pylist() + [None], b.dictionary.to_pylist() + [None]
        a_codes = a.indices.fill_null(len(a_names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        b_codes = b.indices.fill_null(len(b_names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs, codes = np.unique(a_codes * len(b_names) + b_codes, return_inverse=True)
        own = np.array([ids.setdefault((a_names[p // len(b_names)], b_names[p % len(b_names)]), len(ids)) for p in pairs.tolist()], np.int64)
        if (need := len(ids)) > len(first):
            size = max(1024, 2 * need)
            counts = np.concatenate([counts, np.zeros((size - len(first)) * width, np.int64)])
            first, last = (np.concatenate([x, np.full(size - len(x), v, np.int64)]) for x, v in ((first, none_first), (last, none_last)))
        if len(pairs):
            codes = own[codes]
            n = need * width
            counts[:n] += np.bincount(codes * width + _severity_codes(severity), minlength=n)
            valid = np.asarray(day.is_valid())
            days = day.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[valid]
            np.minimum.at(first, codes[valid], days)
            np.maximum.at(last, codes[valid], days)
        if len(ids) > KEYS_AT_ONCE:
            yield flush()
            counts, first, last = (np.zeros(0, np.int64) for _ in range(3))
    if ids:
        yield flush()


def pair_counts(entries: DataFrame) -> DataFrame:
    """service_name, module, n_rows, counts by severity, first and last load_day of every pair."""
    days = F.unix_date("load_day").alias("day")
    parts = entries.select("service_name", "module", "severity", days).mapInArrow(_blocks, _BLOCK)
    sums = [F.sum(F.col("counts")[k]).alias(f"n_{s.lower()}") for k, s in enumerate(SEVERITIES)]
    out = parts.groupBy("service_name", "module").agg(*sums, F.min("first_day").alias("a"), F.max("last_day").alias("b"))
    n_rows = sum((F.col(f"n_{s.lower()}") for s in SEVERITIES[1:]), F.col(f"n_{SEVERITIES[0].lower()}"))
    return out.select(
        "service_name", "module", n_rows.alias("n_rows"), *(f"n_{s.lower()}" for s in SEVERITIES),
        F.date_from_unix_date("a").alias("first_day"), F.date_from_unix_date("b").alias("last_day"),
    )


def pair_traces(entries: DataFrame) -> DataFrame:
    """service_name, module, n_traces: exact. Traces are made distinct first, by a key that spreads a hot pair."""
    trace = F.col("trace_id")
    real = entries.filter(trace.isNotNull() & ~F.lower(F.trim(trace)).isin("", "n/a"))
    return real.select("service_name", "module", "trace_id").distinct().groupBy("service_name", "module").agg(F.count("*").alias("n_traces"))


def pair_results(entries: DataFrame) -> DataFrame:
    """All results of every pair."""
    counts, traces = pair_counts(entries).alias("a"), pair_traces(entries).alias("b")
    same = F.col("a.service_name").eqNullSafe(F.col("b.service_name")) & F.col("a.module").eqNullSafe(F.col("b.module"))
    return counts.join(traces, same, "left").select("a.*", F.coalesce("n_traces", F.lit(0)).alias("n_traces"))


def p3_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by severity, span of load_day and distinct traces of every pair."""
    return pair_results(spark.read.parquet(f"{sf}/log_entries.parquet"))


def p3_found(spark: SparkSession, sf: str, share: int = 50) -> DataFrame:
    """The pairs without nulls that hold more than one ``share``-th of all rows."""
    entries = spark.read.parquet(f"{sf}/log_entries.parquet")
    total = entries.agg(F.count("*")).scalar()
    return pair_counts(entries).filter(F.col("service_name").isNotNull() & F.col("module").isNotNull() & (F.col("n_rows") * share > total)).select("service_name", "module")
