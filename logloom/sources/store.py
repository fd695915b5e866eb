"""The table of points: upserts without rewriting, retention, reads of the latest version, several writers.

Points are kept in segments, directories of parquet files that never change. An upsert appends a segment with only the
batch's points; a manifest of the next number names the segments in order. Making that file fails if it is there, so of two
writers one goes on from what the other wrote: nothing is lost without a lock, which would have to be broken when
its holder dies. An upsert costs as much as its batch. maintain() runs apart from the writers: it merges neighbouring segments of like size, so
that a point is rewritten as often as the table's size grows fourfold, and removes what no frame can still be reading.

A read scans every segment with all filters pushed down and drops the points that a later segment has; for that only the
keys of the later segments are read, and vectors aren't shuffled while those keys are few enough to be broadcast.
"""

from __future__ import annotations

import json
import logging
import os
import re
import shutil
import time
import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

_MANIFEST = re.compile(r"manifest-(\d{12})\.json")


class PointStore:
    """A folder that driver and executors share."""

    #: Neighbouring segments of a tier from which merging them pays, and how many times a tier is larger than the one before.
    TIER, GROWTH = 4, 4.0
    #: Seconds for which merged segments and old manifests stay, as frames that were made before may read them.
    GRACE = 3600.0

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "point_id", time: str = "timestamp_utc"):
        self.spark, self.path, self.schema, self.key, self.time = spark, path, schema, key, time

    def ensure(self) -> None:
        """Makes the table if it isn't there."""
        os.makedirs(self.path, exist_ok=True)
        if not self._numbers():
            self._create(0, {"segments": [], "retired": []})

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for m in map(_MANIFEST.fullmatch, os.listdir(self.path)) if m)

    def _file(self, number: int) -> str:
        return os.path.join(self.path, f"manifest-{number:012}.json")

    def _create(self, number: int, state: dict) -> bool:
        """Whether the manifest of this number is ours: it appears whole or not at all, and only once."""
        temporary = os.path.join(self.path, f".{uuid.uuid4().hex}.tmp")
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(state, f)
        try:
            os.link(temporary, self._file(number))
        except FileExistsError:
            return False
        finally:
            os.unlink(temporary)
        return True

    def _state(self) -> tuple[int, dict]:
        while True:
            number = self._numbers()[-1]
            try:
                with open(self._file(number), encoding="utf-8") as f:
                    return number, json.load(f)
            except FileNotFoundError:  # replaced and removed meanwhile
                continue

    def _segments(self) -> list[dict]:
        return self._state()[1]["segments"]

    def _change(self, change: Callable[[list[dict]], list[dict] | None]) -> bool:
        """Replaces the segments by ``change`` of the latest ones, again if another writer was first; False if it gives None."""
        while True:
            number, state = self._state()
            segments = change([dict(s) for s in state["segments"]])
            if segments is None:
                return False
            gone = {s["name"] for s in state["segments"]} - {s["name"] for s in segments}
            retired = state["retired"] + [{"name": n, "at": time.time()} for n in sorted(gone)]
            if self._create(number + 1, {"segments": segments, "retired": retired}):
                return True

    def _write(self, points: DataFrame) -> dict | None:
        """A segment of the points, or None without any. Rows of a day come together, in files of the size that AQE aims at,
        however many rows a day has."""
        name = f"segment-{uuid.uuid4().hex}"
        folder = os.path.join(self.path, name)
        points.withColumn("day", F.to_date(self.time)).hint("rebalance", "day").write.partitionBy("day").parquet(folder)
        files = [os.path.join(d, f) for d, _, found in os.walk(folder) for f in found if f.endswith(".parquet")]
        if not any(os.path.basename(os.path.dirname(f)).startswith("day=") for f in files):
            shutil.rmtree(folder, ignore_errors=True)
            return None
        return {"name": name, "cutoff": None, "bytes": sum(map(os.path.getsize, files))}

    def upsert(self, points: DataFrame, order: Column | None = None, distinct: bool = False) -> None:
        """Replaces points by key. Of equal keys in the batch the last by ``order`` stays, or any if equal; ``distinct`` says
        that there are none. No points change nothing."""
        self.ensure()
        if not distinct:
            rank = W.partitionBy(self.key).orderBy(order if order is not None else F.desc(self.time))
            points = points.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")
        if (segment := self._write(points)) is not None:
            self._change(lambda segments: [*segments, segment])

    def delete_before(self, cutoff: datetime) -> None:
        """Removes points with a time before ``cutoff``. Later upserts aren't touched."""
        self.ensure()
        stamp = cutoff.isoformat()
        self._change(lambda segments: [{**s, "cutoff": max(filter(None, (s["cutoff"], stamp)))} for s in segments])

    def _segment(self, s: dict, retained: bool) -> DataFrame:
        df = self.spark.read.schema(self.schema + ", day date").parquet(os.path.join(self.path, s["name"]))
        if not s["cutoff"] or not retained:
            return df
        limit = F.lit(datetime.fromisoformat(s["cutoff"]))
        # The day prunes whole folders; points without a time stay.
        return df.filter((F.col(self.time) >= limit) & (F.col("day") >= F.to_date(limit)) | F.col(self.time).isNull())

    def _merged(self, segments: list[dict], retained: bool = True) -> DataFrame:
        """The latest version of every point of neighbouring segments, without those that retention has removed if ``retained``. A
        point that is removed from a later segment doesn't come back from an earlier one."""
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        if len(segments) == 1:
            return self._segment(segments[0], retained).drop("day")
        parts = [self._segment(s, retained).drop("day").withColumn("_k", F.lit(k)) for k, s in enumerate(segments)]
        keys = [self.spark.read.schema(self.schema).parquet(os.path.join(self.path, s["name"])).select(F.col(self.key).alias("_key"), F.lit(k).alias("_k")) for k, s in enumerate(segments) if k]
        newest = reduce(DataFrame.unionByName, keys).groupBy("_key").agg(F.max("_k").alias("_newest"))
        joined = reduce(DataFrame.unionByName, parts).join(newest, F.col(self.key) == F.col("_key"), "left")
        return joined.filter(F.col("_newest").isNull() | (F.col("_newest") == F.col("_k"))).drop("_k", "_key", "_newest")

    def read(self) -> DataFrame:
        """The latest version of every point."""
        self.ensure()
        return self._merged(self._segments())

    def _replace(self, old: list[dict]) -> bool:
        """Writes neighbouring segments as one; False if they have changed meanwhile. Points that retention has removed are left out
        only if no earlier segment can have them; else they stay under the cutoff that the segments share."""
        first = self._segments()[0] == old[0]
        if (segment := self._write(self._merged(old, first))) and not first:
            segment["cutoff"] = old[0]["cutoff"]

        def change(segments: list[dict]) -> list[dict] | None:
            k = next((k for k, s in enumerate(segments) if s["name"] == old[0]["name"]), None)
            if k is None or segments[k : k + len(old)] != old:
                return None
            return segments[:k] + ([segment] if segment else []) + segments[k + len(old) :]

        if self._change(change):
            return True
        if segment:
            shutil.rmtree(os.path.join(self.path, segment["name"]), ignore_errors=True)
        return False

    def compact(self) -> bool:
        """One segment of all."""
        self.ensure()
        return not (old := self._segments()) or self._replace(old)

    def _mergeable(self, segments: list[dict]) -> list[dict]:
        """The longest run of TIER or more neighbours of which none is more than GROWTH times as large as those after it together, and
        which share a cutoff or begin with the first segment."""
        best: list[dict] = []
        for end in range(len(segments), 0, -1):
            run, total = [segments[end - 1]], segments[end - 1]["bytes"]
            alike = [run]
            for s in reversed(segments[: end - 1]):
                if s["bytes"] > self.GROWTH * total:
                    break
                run, total = [s, *run], total + s["bytes"]
                if s is segments[0] or len({x["cutoff"] for x in run}) == 1:
                    alike.append(run)
            if len(alike[-1]) >= self.TIER and len(alike[-1]) > len(best):
                best = alike[-1]
        return best

    def maintain(self) -> int:
        """Merges tiers while there are any to merge, then removes what has been replaced for GRACE seconds. How many merges were made.
        Writers and readers go on meanwhile; run by one process at a time it wastes nothing."""
        self.ensure()
        merges = 0
        while (run := self._mergeable(self._segments())) and self._replace(run):
            merges += 1
        self._vacuum()
        return merges

    def _vacuum(self) -> None:
        before = time.time() - self.GRACE
        number, state = self._state()
        gone = [s["name"] for s in state["retired"] if s["at"] <= before]
        if gone and self._create(number + 1, {**state, "retired": [s for s in state["retired"] if s["at"] > before]}):
            for name in gone:
                shutil.rmtree(os.path.join(self.path, name), ignore_errors=True)
        for old in self._numbers()[:-1]:
            try:
                if os.path.getmtime(self._file(old)) <= before:
                    os.unlink(self._file(old))
            except FileNotFoundError:
                pass
