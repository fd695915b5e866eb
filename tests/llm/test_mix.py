import pytest

from logloom.llm import mix
from pyspark.sql import functions as F


def test_budgets_go_to_siblings_first():
    supply = {("a", "en"): 100, ("a", "de"): 10, ("b", "en"): 1000, ("c", "en"): 5}
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3), "d": (0.0, 1)}
    got = mix.budgets(supply, targets, 200)
    # c is used up at 15; of the other 185 the 5/8 of a are more than it has.
    assert got == {("c", "en"): 15, ("a", "en"): 100, ("a", "de"): 10, ("b", "en"): pytest.approx(75)}
    assert sum(got.values()) == pytest.approx(200)
    exact = mix.budgets(supply, targets)
    total = sum(exact.values())
    assert exact["c", "en"] == pytest.approx(15) and total == pytest.approx(75)
    assert exact["b", "en"] / total == pytest.approx(0.3)
    assert mix.budgets({}, targets) == {}
    assert sum(mix.budgets(supply, targets, 1e9).values()) == 100 + 10 + 2000 + 15


def test_a_language_that_runs_out_gives_to_its_siblings_only():
    supply = {("a", "en"): 900, ("a", "de"): 900, ("b", "en"): 900, ("b", "de"): 10}
    targets = {"a": (0.5, 1), "b": (0.5, 1)}
    got = mix.budgets(supply, targets, 800)
    # Of 400 for b the share of de is 400 * 910 / 2710, of which it has 10; en of b takes the rest, a isn't touched.
    assert got["b", "de"] == 10 and got["b", "en"] == pytest.approx(390)
    assert got["a", "de"] == pytest.approx(400 * 910 / 2710) and got["a", "en"] + got["a", "de"] == pytest.approx(400)
    given = mix.budgets(supply, targets, 800, languages={"en": 1.0, "de": 3.0})
    assert given["a", "de"] == pytest.approx(300) and given["b", "en"] == pytest.approx(390)
    assert mix.budgets(supply, targets, 800, languages={"en": 1.0}).get(("a", "de"), 0) == 0


def test_a_source_that_runs_out_gives_to_its_domain_first():
    supply = {("a", "en"): 10, ("b", "en"): 1000, ("c", "en"): 1000}
    targets = {"a": (0.3, 1), "b": (0.2, 1), "c": (0.5, 1)}
    got = mix.budgets(supply, targets, 100, {"a": "x", "b": "x", "c": "y"})
    assert got == {("a", "en"): 10, ("b", "en"): pytest.approx(40), ("c", "en"): pytest.approx(50)}
    flat = mix.budgets(supply, targets, 100)
    assert flat["c", "en"] == pytest.approx(90 * 5 / 7)
    more = mix.budgets(supply | {("b", "en"): 20}, targets, 100, {"a": "x", "b": "x", "c": "y"})
    assert more == {("a", "en"): 10, ("b", "en"): 20, ("c", "en"): pytest.approx(70)}


def test_documents_are_not_shuffled_by_leaf(spark, tmp_path):
    rows = [(k, "big" if k % 3 else "small", "en", 10) for k in range(300)]
    docs(spark, rows).write.parquet(f"{tmp_path}/docs")
    targets = spark.createDataFrame([("big", 0.9, 1, "d"), ("small", 0.1, 3, "d")], "source string, target_share double, max_repeats int, domain string")
    plan = mix.mix(spark.read.parquet(f"{tmp_path}/docs"), targets, 1000)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert "hashpartitioning(source" not in line or "bucket" in line or "language" in line and "before" not in line, line
    joins = [line for line in plan.splitlines() if "Join" in line and "epochs" not in line]
    assert any("BroadcastHashJoin [source" in line and "BuildRight" in line for line in joins), plan


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, language string, n_tokens bigint")


def test_mix_and_shares(spark):
    rows = [(k, "big", "en", 10) for k in range(2000)] + [(5000 + k, "small", "de", 10) for k in range(20)] + [(9000, "none", "en", 10)]
    targets = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 3), ("absent", 0.0, 2), ("big", None, None)], "source string, target_share double, max_repeats int")
    d = docs(spark, rows + [(None, "big", "en", 10)]).withColumn("epochs", F.lit(7)).withColumn("rest", F.lit(7))
    got = mix.mix(d, targets, seed=1)
    targets = targets.filter("target_share is not null")
    out = {r["source"]: r for r in mix.shares(got, targets).collect()}
    assert out["small"]["tokens"] == 600 and out["small"]["most_repeats"] == 3 and out["big"]["tokens"] == pytest.approx(5400, abs=10)
    assert out["big"]["met"] and out["absent"]["tokens"] == 0
    assert got.filter("source = 'none'").count() == 0 and got.select("doc_id").distinct().count() == got.count()
    part = mix.mix(d, targets, total=250, seed=1)
    assert {r["source"]: r["tokens"] for r in mix.shares(part, targets).collect()} == {"big": pytest.approx(225, abs=10), "small": pytest.approx(25, abs=10), "absent": 0}
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, mix.mix(d, targets, total=250, seed=1).collect()))
    other = mix.mix(d, targets, total=250, seed=2)
    assert {r["doc_id"] for r in other.collect()} != {r["doc_id"] for r in part.collect()}
    short = {r["source"]: r for r in mix.shares(mix.mix(d, targets, total=1e6), targets).collect()}
    assert short["big"]["tokens"] == 20_000 and short["small"]["tokens"] == 600 and not short["big"]["met"]
    assert mix.mix(d.limit(0), targets).count() == 0


def test_sizes(spark):
    rows = [(1, "a", "EN-us", "hello world"), (2, "a", None, None), (3, "b", "de", "x"), (4, None, "de", "x"), (5, "a", "fr", "x"), (6, "a", "de", "")]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = {r["doc_id"]: (r["language"], r["n_tokens"]) for r in mix.sized(d, targets).collect()}
    assert got == {1: ("en", 2), 5: ("fr", 1)}


def test_a_poor_source_does_not_cut_the_mix(spark, tmp_path):
    rows = [(k, "rich", "en", f"some words of document {k} about this and that") for k in range(200)] + [(999, "poor", "en", "just a few words")]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("rich", 0.93, 2), ("poor", 0.07, 4)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {r["source"]: r for r in mix.p9_shares(spark, str(tmp_path)).collect()}
    copies = {r["doc_id"]: r["copies"] for r in mix.p9_mix(spark, str(tmp_path)).collect()}
    assert copies[999] == 4 and len(copies) >= 195
    assert got["poor"]["most_repeats"] == 4 and not got["poor"]["met"] and got["rich"]["tokens"] > 10 * got["poor"]["tokens"]
