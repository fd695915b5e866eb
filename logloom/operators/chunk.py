"""Normalised entries to overlapping chunks of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schemas
from logloom.functions.text import iso, redact, tokens


def windows(words: Column, size: int = 512, overlap: int = 64) -> Column:
    """An array of (chunk_index, words) structs: windows of ``size`` words, each overlapping the one before.

    ``words`` should be a plain column, as it is looked at for every window.

    Sizes below 8 count as 8, overlaps are cut to 0 and ``size`` - 1. No words, no windows.
    """
    size = max(8, size)
    step = max(1, size - min(max(overlap, 0), size - 1))
    last = F.ceil(F.greatest(F.lit(0), F.size(words) - size) / step).cast("int")
    made = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("chunk_index"), F.slice(words, k * step + 1, size).alias("words")))
    return F.when(F.size(words) > 0, made)


def chunk_id(log_hash: Column, index: Column) -> Column:
    return F.format_string("%s-%04d", log_hash, index)


def render(severity="severity", message="message") -> Column:
    """An entry as one text: time, severity, service, trace, message and payload."""
    payload = F.when(F.size("payload") > 0, F.concat(F.lit(" payload="), F.to_json("payload"))).otherwise("")
    head = F.concat(iso(F.col("timestamp_utc")), F.lit(" ["), severity, F.lit("] "), "service_name", F.lit(" trace="), "trace_id", F.lit(" "), F.coalesce(message, F.lit("")))
    return F.concat(head, F.coalesce(payload, F.lit("")))


def chunk(entries: DataFrame, size: int = 512, overlap: int = 64, redacted: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """The chunks of every entry, secrets replaced after cutting; columns in ``keep`` stay."""
    cut = entries.withColumn("_words", tokens(render())).withColumn("_w", F.explode(windows(F.col("_words"), size, overlap)))
    text = F.array_join("_w.words", " ")
    out = cut.withColumn("chunk_index", F.col("_w.chunk_index")).withColumn("chunk_id", chunk_id(F.col("log_hash"), F.col("_w.chunk_index")))
    return out.withColumn("text", redact(text) if redacted else text).select(*schemas.names(schemas.CHUNK), *keep)
