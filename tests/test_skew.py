from datetime import date

from logloom.functions.skew import join_by_size, total_rows
from logloom.operators import skew
from pyspark.sql import functions as F

SCHEMA = "service_name string, module string, severity string, load_day date, trace_id string"


def test_pairs_with_nulls_and_repeats(spark):
    rows = [("a", "m", "warn", date(2026, 1, 2), "t1")] * 2 + [("a", "m", "Error ", None, "n/a"), ("a", None, None, date(2026, 1, 1), None), (None, None, "x", date(2026, 1, 3), " "), ("a ", "m", "FTL", date(2026, 1, 3), "t2")]
    got = {(r["service_name"], r["module"]): r for r in skew.pair_results(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 4
    am = got["a", "m"]
    assert (am["n_rows"], am["n_warning"], am["n_error"], am["n_traces"]) == (3, 2, 1, 1)
    assert (am["first_day"], am["last_day"]) == (date(2026, 1, 2), date(2026, 1, 2))
    assert got["a", None]["n_other"] == 1 and got["a", None]["n_traces"] == 0
    assert got["a ", "m"]["n_critical"] == 1
    assert got[None, None]["n_rows"] == 1


def test_empty(spark):
    assert skew.pair_results(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_keys_flush(spark, monkeypatch):
    monkeypatch.setattr(skew, "KEYS_AT_ONCE", 10)
    rows = [(f"s{k % 97}", "m", "INFO", date(2026, 1, 1), f"t{k}") for k in range(1000)]
    got = skew.pair_counts(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 97 and got.agg(F.sum("n_rows")).first()[0] == 1000


def test_join_by_size_keeps_hot_and_cold(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), "id")
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    out = join_by_size(rows, sizes, ["k"], "n", total_rows(sizes, "n"))
    assert out.count() == 5000 and out.filter("k = 0 and first = 0").count() == 2000
