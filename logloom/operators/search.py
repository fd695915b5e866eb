"""Retrieval: metadata filter, exact cosine search, one chunk an event, lexical re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.config import SearchOptions
from logloom.functions.text import SEVERITY_ALIASES, overlap, terms


@dataclass(frozen=True)
class QueryFilter:
    """All set conditions must hold; blank ones are ignored. Bounds of time are inclusive."""

    service_name: str | None = None
    severity: str | None = None
    source_type: str | None = None
    correlation_id: str | None = None
    module: str | None = None
    method: str | None = None
    brn: str | None = None
    denomination_id: str | None = None
    account_id: str | None = None
    from_utc: datetime | None = None
    to_utc: datetime | None = None
    #: Also map short spellings of severities; off, as stored severities are matched by upper case only.
    fold_severity: bool = False

    def predicates(self, time: str = "timestamp_utc") -> list[Column]:
        out = []
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in ("from_utc", "to_utc", "fold_severity") or value is None or not value.strip():
                continue
            if f.name == "severity":
                value = value.upper()
                value = SEVERITY_ALIASES.get(value, value) if self.fold_severity else value
            out.append(F.col(f.name) == value)
        if self.from_utc is not None:
            out.append(F.col(time) >= F.lit(self.from_utc))
        if self.to_utc is not None:
            out.append(F.col(time) <= F.lit(self.to_utc))
        return out

    def apply(self, points: DataFrame, time: str = "timestamp_utc") -> DataFrame:
        """Before any limit, so that the limit counts matching points only; reaches the scan."""
        found = self.predicates(time)
        return points.filter(reduce(lambda a, b: a & b, found)) if found else points


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays as doubles; null if one is null, all zero or holds a value that isn't
    finite, or if their lengths differ."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0) & (n < float("inf")), dot(a, b) / n)


def cosine_to(vector: Sequence[float]) -> Callable[[Column], Column]:
    """The same against one given vector: a matrix product for each Arrow batch, without a copy of the values."""
    q = np.asarray(vector, np.float64)
    norm = float(np.sqrt(q @ q))

    @F.arrow_udf(T.DoubleType())
    def run(vectors: pa.Array) -> pa.Array:
        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.combine_chunks()
        sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(sizes == len(q))
        out, ok = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
        if len(rows) and 0 < norm < np.inf:
            taken = vectors if len(rows) == len(sizes) else vectors.take(pa.array(rows))
            x = taken.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float64)
            with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                n = np.sqrt(np.einsum("ij,ij->i", x, x)) * norm
                out[rows], ok[rows] = (x @ q) / n, (n > 0) & (n < np.inf)
        return pa.array(out, mask=~ok)

    return run


def search(points: DataFrame, vector: Sequence[float] | Column, limit: int, query_filter: QueryFilter | None = None, vector_col: str = "vector", id_col: str = "point_id") -> DataFrame:
    """The ``limit`` (at least 1) points of highest cosine, with ``score``; equal scores by id. Exact.

    Points without a score (null, zero or other-sized vectors) are left out.
    """
    kept = query_filter.apply(points) if query_filter else points
    score = cosine(F.col(vector_col), vector) if isinstance(vector, Column) else cosine_to(vector)(F.col(vector_col))
    # Points without a score come last and are dropped after the limit: a filter before it would compute scores twice.
    top = kept.withColumn("score", score).orderBy(F.desc_nulls_last("score"), id_col).limit(max(1, limit))
    return top.filter(F.col("score").isNotNull())


def best_per_event(candidates: DataFrame, event: str = "log_hash", id_col: str = "point_id") -> DataFrame:
    """The highest score of each event; equal ones by id."""
    order = W.partitionBy(event).orderBy(F.desc("score"), id_col)
    return candidates.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def rerank(candidates: DataFrame, question: str | Column, options: SearchOptions = SearchOptions(), text: str = "text") -> DataFrame:
    """``candidates`` with ``rank_score``: similarity and lexical overlap, or similarity alone."""
    if not options.rerank:
        return candidates.withColumn("rank_score", F.col("score"))
    q = question if isinstance(question, Column) else F.lit(question)
    return candidates.withColumn("rank_score", options.similarity_weight * F.col("score") + options.overlap_weight * overlap(terms(q), F.col(text)))


def retrieve(points: DataFrame, question: str, vector: Sequence[float], k: int | None = None, query_filter: QueryFilter | None = None, options: SearchOptions = SearchOptions(), id_col: str = "point_id", event: str = "log_hash", vector_col: str = "vector", text: str = "text") -> DataFrame:
    """The k best chunks for a question, ``rank`` from 1. Fewer if candidates share events."""
    k = max(1, k if k is not None else options.top_k)
    found = search(points, vector, options.over_fetch * k, query_filter, vector_col, id_col)
    ranked = rerank(best_per_event(found, event, id_col), question, options, text)
    top = ranked.orderBy(F.desc("rank_score"), F.desc("score"), id_col).limit(k)
    order = W.orderBy(F.desc("rank_score"), F.desc("score"), id_col)  # over k rows
    return top.withColumn("rank", F.row_number().over(order))


# What stands for missing metadata of a retrieved chunk.
DEFAULTS = {"severity": "INFO", "service_name": "unknown", "source_id": "unknown", "source_type": "unknown", "trace_id": "n/a", "correlation_id": "n/a", "module": "", "method": "", "log_source": "", "destination": ""}


def with_defaults(found: DataFrame, now: Column) -> DataFrame:
    """Retrieved chunks with defaults for what is missing; ``now`` for a missing time."""
    have = [c for c in DEFAULTS if c in found.columns]
    out = found.fillna({c: DEFAULTS[c] for c in have})
    return out.withColumn("timestamp_utc", F.coalesce("timestamp_utc", now)) if "timestamp_utc" in found.columns else out
