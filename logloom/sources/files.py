"""Log files as DataFrames of raw entries, in batch and as a stream.

``logloom_files`` is a Spark data source: files are cut into byte ranges that executors read on their own, each giving
the events that begin in it, so that one large file is no single task. It needs paths that executors can open.
``read_text`` does the same with built-in operators on any file system that Spark reads, for files under 2 GB.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from logloom import schemas
from logloom.config import LogSource
from logloom.sources.checkpoints import Checkpoints
from logloom.sources.events import START, clamp, events

FORMAT = "logloom_files"
#: Bytes of a file in one task.
RANGE_BYTES = 128 << 20


def check_sources(sources: Sequence[LogSource]) -> list[LogSource]:
    """The sources, if all are of a known type; ValueError otherwise."""
    for s in sources:
        if s.type.strip().lower() != "file":
            raise ValueError(f"source {s.id}: unknown type {s.type!r}")
    return list(sources)


class Range(InputPartition):
    def __init__(self, source: dict, begin: int, end: int, first: bool, size: int):
        self.source, self.begin, self.end, self.first, self.size = source, begin, end, first, size


def ranges(source: dict, start: int, size: int, step: int) -> list[Range]:
    """Ranges of at most ``step`` bytes from ``start`` to ``size``."""
    cuts = list(range(start, size, max(1, step)))
    return [Range(source, a, min(a + step, size), a == start, size) for a in cuts]


def read_range(part: Range, now: datetime) -> Iterator[tuple]:
    s = part.source
    try:
        for text, a, b in events(s["path"], part.begin, part.end, part.first, part.size):
            yield s["id"], s["source_type"], text, now, {"path": s["path"], "start_offset": str(a), "end_offset": str(b)}
    except FileNotFoundError:
        return


def _size(path: str) -> int:
    try:
        return os.path.getsize(path)
    except OSError:
        return 0  # a missing file has no events


class LogFiles(DataSource):
    """Options: sources (JSON list of id, path, source_type), offsets (JSON by key), ingested_at, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return schemas.RAW

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


class _Plan:
    def __init__(self, options: dict):
        self.sources = json.loads(options["sources"])
        self.offsets = json.loads(options.get("offsets", "{}"))
        self.step = int(options.get("range_bytes", RANGE_BYTES))
        at = options.get("ingested_at")
        self.now = datetime.fromisoformat(at) if at else None

    def key(self, source: dict) -> str:
        return Checkpoints.key(source["id"], source["path"])

    def sizes(self) -> dict[str, int]:
        return {self.key(s): _size(s["path"]) for s in self.sources}

    def plan(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        out = []
        for s in self.sources:
            size = end.get(self.key(s), 0)
            out += ranges(s, clamp(start.get(self.key(s), 0), size), size, self.step)
        return out


class _Reader(_Plan, DataSourceReader):
    def partitions(self) -> list[Range]:
        sizes = json.loads(json.dumps(self.sizes()))
        return self.plan(self.offsets, sizes) or [Range({"id": "", "path": os.devnull, "source_type": ""}, 0, 0, True, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return read_range(partition, self.now or datetime.now(timezone.utc))


class _StreamReader(_Plan, DataSourceStreamReader):
    """Offsets are byte offsets of all files; Spark keeps them and commits them after the sink."""

    def initialOffset(self) -> dict:
        return dict(self.offsets)

    def latestOffset(self) -> dict:
        return self.sizes()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.plan(start, end)

    def read(self, partition: Range) -> Iterator[tuple]:
        return read_range(partition, self.now or datetime.now(timezone.utc))

    def commit(self, end: dict) -> None:
        pass


def _options(sources: Sequence[LogSource], ingested_at: datetime | None, offsets: dict[str, int], range_bytes: int) -> dict[str, str]:
    listed = [{"id": s.id, "path": os.path.abspath(s.path), "source_type": s.source_type} for s in check_sources(sources)]
    out = {"sources": json.dumps(listed), "offsets": json.dumps(offsets), "range_bytes": str(range_bytes)}
    return out | ({"ingested_at": ingested_at.isoformat()} if ingested_at else {})


def read_files(spark: SparkSession, sources: Sequence[LogSource], ingested_at: datetime, offsets: dict[str, int] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The raw entries of all sources from their offsets to their ends."""
    spark.dataSource.register(LogFiles)
    return spark.read.format(FORMAT).options(**_options(sources, ingested_at, offsets or {}, range_bytes)).load()


def stream_files(spark: SparkSession, sources: Sequence[LogSource], range_bytes: int = RANGE_BYTES, ingested_at: datetime | None = None) -> DataFrame:
    """The raw entries of all sources as a stream. An event still being written at the end of a file is cut."""
    spark.dataSource.register(LogFiles)
    return spark.readStream.format(FORMAT).options(**_options(sources, ingested_at, {}, range_bytes)).load()


def current_sizes(sources: Sequence[LogSource]) -> dict[str, int]:
    """Offsets after all that is in the files now."""
    return {Checkpoints.key(s.id, s.path): _size(s.path) for s in sources}


def read_text(spark: SparkSession, source: LogSource, ingested_at: datetime) -> DataFrame:
    """The raw entries of one source, by built-in operators: lines with running offsets, events by a running sum."""
    check_sources([source])
    files = spark.read.text(source.path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    raw = files.select("file", F.posexplode(F.split("value", "\n")).alias("k", "raw"))
    whole = W.partitionBy("file").orderBy("k")
    size = F.octet_length("raw") + 1
    placed = raw.withColumn("at", F.coalesce(F.sum(size).over(whole.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    line = F.regexp_replace(F.regexp_replace("raw", r"\r$", ""), "^﻿", "")
    kept = placed.withColumn("line", line).filter(F.col("line").rlike(r"(?U)\S"))
    begins = F.col("line").rlike("(?U)" + START) | (F.row_number().over(whole) == 1)
    numbered = kept.withColumn("begins", begins).withColumn("event", F.sum(F.col("begins").cast("int")).over(whole))
    ends = placed.groupBy("file").agg((F.max(F.col("at") + F.octet_length("raw"))).alias("size"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    made = numbered.groupBy("file", "event").agg(F.min("at").alias("start"), text.alias("raw_text")).join(ends, "file")
    following = F.lead("start").over(W.partitionBy("file").orderBy("event"))
    spans = made.withColumn("stop", F.coalesce(following, "size"))
    attributes = F.create_map(F.lit("path"), "file", F.lit("start_offset"), F.col("start").cast("string"), F.lit("end_offset"), F.col("stop").cast("string"))
    return spans.select(F.lit(source.id).alias("source_id"), F.lit(source.source_type).alias("source_type"), "raw_text", F.lit(ingested_at).alias("ingested_at_utc"), attributes.alias("attributes"))
