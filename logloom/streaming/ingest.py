"""The ingest pipeline, as a batch run and as a stream, and its schedule."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logloom import schemas
from logloom.config import LogSource, Options
from logloom.functions.text import is_blank
from logloom.operators.chunk import chunk
from logloom.operators.embed import Embedder, to_points
from logloom.operators.normalize import normalize
from logloom.operators.parse import drop_noise, parse
from logloom.sources.checkpoints import Checkpoints
from logloom.sources.files import current_sizes, read_files, stream_files
from logloom.sources.store import PointStore

log = logging.getLogger(__name__)

RESULT = "raw_logs_read int, chunks_created int, vectors_upserted int, completed_at_utc timestamp"


def raw_to_points(raw: DataFrame, options: Options = Options(), factory: Callable[[], Embedder] | None = None) -> DataFrame:
    """Raw entries to points, without noise: a plan without a shuffle."""
    return _to_points(_kept(raw, options), options, factory)


def _kept(raw: DataFrame, options: Options) -> DataFrame:
    return drop_noise(raw, options.ingest.noise_patterns) if options.ingest.drop_noise else raw


def _to_points(kept: DataFrame, options: Options, factory: Callable[[], Embedder] | None) -> DataFrame:
    o = options.ingest
    chunks = chunk(normalize(parse(kept.filter(~is_blank(F.col("raw_text"))), o.rules)), o.chunk_tokens, o.overlap_tokens)
    return to_points(chunks, factory, options.embedding.batch_size, options.embedding.dims, options.embedding.parallel_batches, o.processing_batch_size)


def _distinct(raw: DataFrame) -> DataFrame:
    """One of each source's equal texts, the first by time of ingestion, with ``_copies``. They would be one point, so none is embedded
    twice; texts are counted before they are shuffled."""
    rest = [c for c in raw.columns if c not in ("source_id", "raw_text")]
    one = F.min_by(F.struct(*rest), "ingested_at_utc").alias("_rest")
    return raw.groupBy("source_id", "raw_text").agg(one, F.count("*").alias("_copies")).select("source_id", "raw_text", "_rest.*", "_copies")


def _seen(observation: Observation) -> int:
    """What was counted; 0 where nothing came that far, as empty parts of a plan are left out when it runs."""
    try:
        return observation.get["n"]
    except Exception:
        return 0


def _ingest(raw: DataFrame, store: PointStore, options: Options, now: datetime, factory) -> dict[str, int]:
    """Writes the points of ``raw``; then retention, unless there were none. Counts as the data passes, copies included."""
    read, left, made = Observation(), Observation(), Observation()
    n = F.count(F.lit(1)).alias("n")
    kept = _kept(raw.observe(read, n), options).observe(left, n)
    once = _distinct(kept.select(*schemas.names(schemas.RAW)))
    # The copies ride along in the attributes, which no later stage reads.
    counted = once.withColumn("attributes", F.create_map(F.lit("copies"), F.col("_copies").cast("string"))).drop("_copies")
    o = options.ingest
    entries = normalize(parse(counted.filter(~is_blank(F.col("raw_text"))), o.rules), keep=("attributes",))
    chunks = chunk(entries, o.chunk_tokens, o.overlap_tokens, keep=("attributes",))
    made_chunks = chunks.observe(made, F.coalesce(F.sum(F.col("attributes")["copies"].cast("bigint")), F.lit(0)).alias("n")).drop("attributes")
    e = options.embedding
    store.upsert(to_points(made_chunks, factory, e.batch_size, e.dims, e.parallel_batches, o.processing_batch_size), distinct=True)
    log.info("%d entries dropped as noise", _seen(read) - _seen(left))
    counts = {"raw_logs_read": _seen(read), "chunks_created": _seen(made), "vectors_upserted": _seen(made)}
    if counts["chunks_created"]:
        store.delete_before(now - timedelta(days=options.ingest.retention_days))
    return counts


def run_ingest(spark: SparkSession, store: PointStore, options: Options, now: datetime, factory: Callable[[], Embedder] | None = None) -> DataFrame:
    """One batch run over all sources from their saved offsets, saved again after the points are stored. One row of counts."""
    store.ensure()
    checkpoints = Checkpoints(options.ingest.checkpoint_file) if options.ingest.use_checkpoints else None
    sizes = current_sizes(options.sources)
    offsets = {k: checkpoints.get(k) for k in sizes} if checkpoints else {}
    counts = _ingest(read_files(spark, options.sources, now, offsets), store, options, now, factory)
    if checkpoints:
        checkpoints.save(sizes)
    return spark.createDataFrame([(*counts.values(), now)], RESULT)


def stream_ingest(spark: SparkSession, store: PointStore, options: Options, checkpoint: str, poll_seconds: int | None = None, factory: Callable[[], Embedder] | None = None, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> StreamingQuery:
    """The same as a stream: offsets are committed after the points are stored, and points are keyed by content, so a
    batch that is run again changes nothing. Without ``poll_seconds`` it takes what is there and ends.
    """
    store.ensure()

    def sink(batch: DataFrame, _: int) -> None:
        log.info("ingested %s", _ingest(batch, store, options, clock(), factory))

    writer = stream_files(spark, options.sources).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if poll_seconds is None else {"processingTime": f"{max(1, poll_seconds)} seconds"}
    return writer.trigger(**trigger).start()


def respond(run: Callable[[], DataFrame]) -> tuple[int, dict]:
    """(200, the counts), or the error: 503 if a connection or file failed somewhere in the chain of causes, else 500."""
    try:
        return 200, run().first().asDict()
    except Exception as e:
        causes, cause = [], e
        while cause is not None and cause not in causes:
            causes.append(cause)
            cause = cause.__cause__ or cause.__context__
        status = 503 if any(isinstance(c, OSError) for c in causes) else 500
        inner = str(causes[-1]) if len(causes) > 1 else None
        return status, {"error": "Ingestion failed", "detail": str(e), "inner": inner}


class Scheduler:
    """Calls ``run`` on a schedule; a call is left out while another is at work, and errors are logged only. After a run
    ``maintain``, if given, goes on in a thread of its own, one at a time."""

    def __init__(self, run: Callable[[], object], options: Options, maintain: Callable[[], object] | None = None):
        self.run, self.options, self.maintain = run, options.scheduler, maintain
        self._upkeep = threading.Lock()
        self._busy, self._stop = threading.Lock(), threading.Event()
        self._threads: list[threading.Thread] = []

    def tick(self) -> bool:
        """Whether it ran."""
        if not self._busy.acquire(blocking=False):
            return False
        try:
            self.run()
        except Exception:
            log.exception("ingestion failed")
        finally:
            self._busy.release()
        if self.maintain and self._upkeep.acquire(blocking=False):
            threading.Thread(target=self._maintain, daemon=True).start()
        return True

    def _maintain(self) -> None:
        try:
            self.maintain()
        except Exception:
            log.exception("maintenance failed")
        finally:
            self._upkeep.release()

    def start(self) -> None:
        o = self.options
        if o.run_on_start:
            self.tick()
        loops = [max(1, o.batch_hours) * 3600] * o.daily_batch + [max(1, o.poll_seconds)] * o.polling
        if not loops:
            log.info("no schedule is enabled")
        for seconds in loops:
            thread = threading.Thread(target=self._loop, args=(seconds,), daemon=True)
            thread.start()
            self._threads.append(thread)

    def _loop(self, seconds: float) -> None:
        due = time.monotonic() + seconds
        while not self._stop.wait(max(0.0, due - time.monotonic())):
            self.tick()
            due = time.monotonic() + seconds

    def stop(self) -> None:
        self._stop.set()


def health() -> dict[str, str]:
    return {"status": "ok"}


def point_store(spark: SparkSession, path: str) -> PointStore:
    return PointStore(spark, path, schemas.POINT)
