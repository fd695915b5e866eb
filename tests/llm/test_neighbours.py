import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import neighbours as nb
from pyspark.sql import functions as F

SCHEMA = "point_no bigint, vector array<float>"


def brute(rows, k, dims):
    points = {i: np.array(v, np.float64) for i, v in rows if v is not None and len(v) == dims and all(x is not None for x in v)}
    points = {i: (v / np.linalg.norm(v)).astype(np.float32) for i, v in points.items() if np.isfinite(v).all() and np.linalg.norm(v) > 0}
    ids = np.array(sorted(points))
    x = np.stack([points[i] for i in ids]).astype(np.float64)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {int(i): ({int(ids[j]) for j in np.lexsort((ids, -np.round(s[r], 9)))[:k]}, np.sort(s[r])[::-1][k - 1]) for r, i in enumerate(ids)}


def found(df, k, dims):
    out = {}
    for r in nb.neighbours(df, k, dims).collect():
        out.setdefault(r["point"], set()).add(r["other"])
    return out


def clustered(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dims))
    return centres[rng.integers(len(centres), size=n)] * rng.uniform(0.5, 3, (n, 1)) + 0.3 * rng.normal(size=(n, dims))


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nb, "SCAN", 100)
    monkeypatch.setattr(nb, "BUCKET", 200)
    monkeypatch.setattr(nb, "BLOCK", 64)
    monkeypatch.setattr(nb, "QUERIES", 100)
    monkeypatch.setattr(nb, "RERANK", 24)
    x = clustered(3000, 32)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    want, got = brute(rows, 5, 32), found(spark.createDataFrame(rows, SCHEMA), 5, 32)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(got[i] & w) for i, (w, _) in want.items()) / (5 * len(want)) >= 0.9


def test_recall_where_neighbours_lie_in_many_lists(spark, monkeypatch):
    monkeypatch.setattr(nb, "PROBES", 2)
    monkeypatch.setattr(nb, "SCAN", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 12)) @ rng.normal(size=(12, 32))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    want, got = brute(rows, 5, 32), found(spark.createDataFrame(rows, SCHEMA), 5, 32)
    assert sum(len(got[i] & w) for i, (w, _) in want.items()) / (5 * len(want)) >= 0.9


def table(spark, x):
    x = np.ascontiguousarray(x, np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
    return spark.createDataFrame(pa.table([pa.array(np.arange(len(x))), lists], ["point_no", "vector"])).repartition(4)


def sampled_recall(spark, x, k=5, dims=128):
    """Of 300 points, the share of the k nearest by brute force that are found."""
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    asked = np.random.default_rng(9).choice(len(x), 300, replace=False)
    scores = unit[asked] @ unit.T
    scores[np.arange(len(asked)), asked] = -9
    want = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    ids = spark.createDataFrame([(int(i),) for i in asked], "point bigint")
    got = {}
    for r in nb.neighbours(table(spark, x), k, dims).join(ids, "point").collect():
        got.setdefault(r["point"], set()).add(r["other"])
    return sum(len(got[int(i)] & set(map(int, w))) for i, w in zip(asked, want)) / (k * len(asked))


def test_recall_on_broad_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 128))
    x = centres[rng.integers(200, size=60_000)] + 0.6 * rng.normal(size=(60_000, 128))
    assert sampled_recall(spark, x) >= 0.9


def test_recall_on_a_manifold(spark):
    rng = np.random.default_rng(6)
    assert sampled_recall(spark, rng.normal(size=(20_000, 16)) @ rng.normal(size=(16, 128)) + 0.01 * rng.normal(size=(20_000, 128))) >= 0.9


def test_oversized_lists_are_split(monkeypatch):
    monkeypatch.setattr(nb, "PART", 256)
    monkeypatch.setattr(nb, "OVERSIZE", 1024)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 16))
    x[:3000] = x[0] + 0.02 * rng.normal(size=(3000, 16))
    x = np.ascontiguousarray(x / np.linalg.norm(x, axis=1, keepdims=True), np.float32)
    index = nb.Index(x[::3].copy(), 4, len(x))
    visits, _ = index.assign(x)
    assert np.bincount(visits[:, 0]).max() <= 1200 and len(index.centroids) > 4
    monkeypatch.setattr(nb, "FLAT", 8)
    assert 24 <= len(nb.coarse(x, 32, rng)) <= 40


def test_queries_go_to_few_buckets(monkeypatch):
    monkeypatch.setattr(nb, "BUCKET", 500)
    x = clustered(5000, 32, 4)
    x = np.ascontiguousarray(x / np.linalg.norm(x, axis=1, keepdims=True), np.float32)
    index = nb.Index(x[::2].copy(), 64, len(x))
    visits, _ = index.assign(x)
    buckets = nb._distinct_first(index.bucket[visits])
    lists = buckets.to_pylist()
    assert all(b[0] == index.bucket[v[0]] and sorted(b) == sorted(set(index.bucket[v].tolist())) for b, v in zip(lists, visits))
    assert sum(map(len, lists)) < 0.7 * visits.size and len(set(index.bucket.tolist())) > 3


def test_assign_is_cut_into_small_blocks(monkeypatch):
    rng = np.random.default_rng(8)
    x = np.ascontiguousarray(rng.normal(size=(500, 16)), np.float32)
    index = nb.Index(x, 16, len(x))
    whole = index.assign(x)
    monkeypatch.setattr(nb, "PRODUCTS", 64)
    parts = index.assign(x)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_recall_is_reported_against_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(nb, "QUERIES", 16)
    x = clustered(2000, 16)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(5000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    row = nb.recall(df, 5, 16).first()
    assert row["n_queries"] == 20 and row["n_true"] == 100 and row["recall"] >= 0.9
    units = nb.usable(df, 16)
    exact = {}
    for block in nb.exact_nearest(units, units.filter("point < 20"), 5):
        for r in block.collect():
            exact.setdefault(r["point"], set()).add(r["other"])
    assert exact == {i: w for i, (w, _) in brute(rows, 5, 16).items() if i < 20}
    assert nb.recall(df.limit(0), 5, 16).first()["recall"] is None


def test_odd_vectors_copies_and_ties(spark):
    x = clustered(60, 8, 1)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(100 + k, rows[7][1]) for k in range(12)] + [(200 + k, rows[9][1]) for k in range(2)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] + [1.0] * 7), (304, [float("inf")] + [1.0] * 7), (305, [1.0] * 9), (None, [1.0] * 8), (306, [None] + [1.0] * 7), (5, rows[5][1])]
    want, got = brute(rows[:74], 5, 8), found(spark.createDataFrame(rows, SCHEMA).withColumn("same", F.lit(1)).withColumn("list", F.lit(1)), 5, 8)
    assert set(got) == set(want)
    assert got[7] == {100, 101, 102, 103, 104} and got[111] == {7, 100, 101, 102, 103} and {200, 201} <= got[9]
    assert sum(len(got[i] & w) for i, (w, _) in want.items()) / (5 * len(want)) >= 0.98


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_points(spark, n):
    rows = [(k, [float(k + 1), 1.0]) for k in range(n)]
    got = found(spark.createDataFrame(rows, SCHEMA), 5, 2)
    assert got == {k: set(range(n)) - {k} for k in range(n) if n > 1}
