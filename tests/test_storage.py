import os
import uuid

from logloom.functions import storage


def test_materialize_and_release(spark):
    name = uuid.uuid4().hex  # the folder may hold what other runs left
    df = storage.materialize(spark.range(5), name)
    folder = storage.shared_dir(spark)
    made = lambda: [p for p in os.listdir(folder.removeprefix("file://")) if p.startswith(name)]
    assert spark.conf.get("spark.checkpoint.dir") == folder and df.count() == 5 and len(made()) == 1
    assert storage.materialize(spark.range(0), name).count() == 0 and len(made()) == 2
    assert storage.release(spark) >= 2 and not made()


def test_spread(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    assert storage.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100, numPartitions=64)
    assert storage.spread(wide) is wide
