"""Where jobs cut their lineage: the folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where that is unset, as in tests, a local one is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: list[str] = []


@atexit.register
def _forget() -> None:
    """What is left in folders that this process can open goes with it; no frame outlives the driver."""
    for path in _written:
        if path.startswith(("file:", "/")):
            shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    The files outlive every executor, so a lost one costs a task and no lineage is run again. They stay until
    release() or the end of the driver, as frames that read them are lazy.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes what this driver has materialized so far; call it when no frame that reads it is used any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in (gone := _written[:]):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _written.remove(path)
    return len(gone)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, in at least as many partitions as there are cores, before work that outweighs moving it.

    Small files come as few partitions. Where a scan has enough of them, as on large inputs, nothing is moved.
    """
    if (plan := getattr(df, "_jdf", None)) is None:  # a remote session doesn't tell its partitions
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.queryExecution().toRdd().getNumPartitions() < cores else df
