"""Problem 5: the most similar vectors of every vector.

An inverted file: coarse centroids (spherical k-means on a bounded sample) give each vector a list, and its residual is
product-quantised. Every vector is also a query and visits the lists of its nearest centroids; there a table of
inner products with the codewords ranks the codes (asymmetric distances), and the best are reranked by exact cosines.
How many lists and codes that is, is measured: the exact nearest of some vectors among all are looked up, so many lists are
visited that RECALL of them are met, all lists if it must be, and so large a share of a list's codes is reranked that RECALL of them are
among these. What the search loses is reported by recall(), for
every vector whose id is divisible by 100, against exact_nearest(), the exact way.

Lists that the sample shows to hold more than OVERSIZE vectors are split by centroids of their own, so their number grows with the
data, up to the size of the sample. Lists whose centroids are near each other form a bucket, so that a query, whose lists mostly lie
together, is sent to one or two buckets instead of every list on its own. Buckets and the queries that visit them are cut into blocks of
bounded size, so even one that holds a third of all vectors becomes a grid of tasks. The copies of a vector are each other's nearest, found by its hash alone. Of a vector
with many copies only the k + 1 of smallest id can be among the nearest of others and are searched; no vector is
shuffled but to the lists it is in or visits.

Defined results: vectors that are null, all zero, hold a value that isn't finite or haven't ``dims`` elements are
neither given nor counted, nor are points without id. Of equal cosines the smaller id is nearer. With fewer than k other vectors all are
neighbours. Empty tables give empty results. Rows of one id with equal vectors are one point; an id with different
vectors has the nearest of them all and never itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.skew import HOT_SHARE, join_by_size
from logloom.functions.storage import materialize, spread

#: The bounded sample that the index is fitted on: so many vectors, more only with the number of lists.
SAMPLE, SAMPLE_A_LIST, SAMPLE_AT_MOST = 20_000, 16, 262_144
LISTS_AT_MOST = SAMPLE_AT_MOST // SAMPLE_A_LIST
#: Lists that a query visits at least: this many, more if they are short, to meet about SCAN vectors.
PROBES, SCAN = 4, 1024
#: More are visited until this share of the exact nearest of MEASURED vectors lies in them, and more codes of a list are reranked until
#: this share of those is among them.
RECALL, MEASURED = 0.97, 256
PARTS, CODES = 16, 256
#: Codes reranked exactly for each query and block, at least; where half of a block is, all of it is compared exactly, which is faster.
RERANK = 64
#: Vectors that a bucket is meant to hold, vectors of a bucket in one block, and queries that visit it in one task.
BUCKET, BLOCK, QUERIES = 8192, 16_384, 16_384
#: Vectors above which a list is split, vectors that its parts are meant to hold, and rounds in which that is tried.
OVERSIZE, PART, SPLITS = 16_384, 4096, 3
#: Numbers in one block of products when vectors are compared with all centroids.
PRODUCTS = 1 << 22
#: Centroids that are fitted at once; more are fitted in two levels.
FLAT = 1024
SEED = 7


def kmeans(x: np.ndarray, k: int, rounds: int, spherical: bool, rng: np.random.Generator) -> np.ndarray:
    """k centroids; empty ones are set on the points farthest from theirs."""
    centroids = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near, score = nearest(x, centroids, spherical)
        counts = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
        full = counts > 0
        centroids[full] = np.add.reduceat(x[order], begins[full], axis=0) / counts[full, None]
        if (~full).any():
            centroids[~full] = x[np.argsort(score, kind="stable")[: (~full).sum()]]
        if spherical:
            centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return np.ascontiguousarray(centroids, np.float32)


def nearest(x: np.ndarray, centroids: np.ndarray, spherical: bool) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and how near it is (larger is nearer)."""
    half = 0 if spherical else (centroids**2).sum(axis=1) / 2
    near, score = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    step = max(1, PRODUCTS // max(len(centroids), 1))
    for a in range(0, len(x), step):
        s = x[a : a + step] @ centroids.T - half
        near[a : a + step] = s.argmax(axis=1)
        score[a : a + step] = s.max(axis=1)
    return near, score


def coarse(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k spherical centroids; many are fitted within the clusters of some first ones, by their sizes."""
    if k <= FLAT:
        return kmeans(x, k, 10, True, rng)
    first = kmeans(x, math.isqrt(k), 10, True, rng)
    near, _ = nearest(x, first, True)
    sizes = np.bincount(near, minlength=len(first))
    parts = np.minimum(np.maximum(1, np.rint(sizes * k / len(x)).astype(np.int64)), np.maximum(sizes, 1))
    return np.concatenate([kmeans(x[near == c], int(parts[c]), 10, True, rng) if sizes[c] else first[c : c + 1] for c in range(len(first))])


class Index:
    """Coarse centroids and the codebooks of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, n: int):
        rng = np.random.default_rng(SEED)
        self.centroids = coarse(sample, lists, rng)
        near, _ = nearest(sample, self.centroids, True)
        for _ in range(SPLITS):
            members = np.bincount(near, minlength=len(self.centroids))
            sizes = members * (n / len(sample))
            over = np.flatnonzero((sizes > OVERSIZE) & (members > 1))
            if not len(over):
                break
            split = [kmeans(sample[near == c], int(min(members[c], math.ceil(sizes[c] / PART))), 10, True, rng) for c in over]
            self.centroids = np.ascontiguousarray(np.concatenate([np.delete(self.centroids, over, axis=0), *split]), np.float32)
            near, _ = nearest(sample, self.centroids, True)
        buckets = min(len(self.centroids), max(1, math.ceil(n / BUCKET)))
        self.bucket = nearest(self.centroids, coarse(self.centroids, buckets, rng), True)[0].astype(np.int32)
        self.probes = min(len(self.centroids), max(PROBES, math.ceil(SCAN * len(self.centroids) / n)))
        residuals = sample - self.centroids[near]
        self.parts = next(p for p in range(min(PARTS, sample.shape[1]), 0, -1) if sample.shape[1] % p == 0)
        codes = min(CODES, len(sample))
        blocks = residuals.reshape(len(sample), self.parts, -1)
        self.codebooks = np.stack([kmeans(np.ascontiguousarray(blocks[:, p]), codes, 8, False, rng) for p in range(self.parts)])
        self.share = 0.0  # of a block's codes that are reranked

    def codes_of(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The codes of the residuals in the given lists."""
        residuals = (x - self.centroids[lists]).reshape(len(x), self.parts, -1)
        return np.stack([nearest(np.ascontiguousarray(residuals[:, p]), self.codebooks[p], False)[0] for p in range(self.parts)], axis=1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each part the products of each query with the codewords."""
        split = queries.reshape(len(queries), self.parts, -1)
        return [split[:, p] @ self.codebooks[p].T for p in range(self.parts)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists each vector visits, nearest first, and the code of its residual in the first."""
        step = max(1, PRODUCTS // len(self.centroids))
        parts = [self._assign(x[a : a + step]) for a in range(0, len(x), step)]
        return np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])

    def _assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scores = x @ self.centroids.T
        if self.probes < scores.shape[1]:
            visits = np.argpartition(-scores, self.probes - 1, axis=1)[:, : self.probes]
        else:
            visits = np.broadcast_to(np.arange(scores.shape[1]), scores.shape).copy()
        order = np.argsort(-np.take_along_axis(scores, visits, axis=1), axis=1, kind="stable")
        visits = np.take_along_axis(visits, order, axis=1)
        return visits.astype(np.int32), self.codes_of(x, visits[:, 0])

    def search(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, neighbour, cosine) of the k nearest in one block of a list, for each query."""
        out = []
        step = max(1, (1 << 22) // max(len(ids), self.parts * self.codebooks.shape[1]))
        keep = min(len(ids), max(RERANK, 8 * k, math.ceil(self.share * len(ids))))
        for a in range(0, len(queries), step):
            q, q_ids = queries[a : a + step], query_ids[a : a + step]
            if 2 * keep < len(ids):
                # The centroid's share of the product is the same for the whole list and changes no order.
                approx = np.zeros((len(q), len(ids)), np.float32)
                for p, table in enumerate(self.tables(q)):
                    approx += table[:, codes[:, p]]
                short = np.argpartition(-approx, keep - 1, axis=1)[:, :keep]
                exact = np.empty(short.shape, np.float32)
                for b in range(0, len(q), 512):
                    exact[b : b + 512] = np.einsum("qd,qkd->qk", q[b : b + 512], x[short[b : b + 512]], optimize=False)
                found = ids[short]
            else:
                exact = q @ x.T
                found = np.broadcast_to(ids, exact.shape)
            exact = np.where(found == q_ids[:, None], -np.inf, exact)
            order = np.lexsort((found, -exact), axis=1)[:, :k]
            near, cosine = np.take_along_axis(found, order, axis=1), np.take_along_axis(exact, order, axis=1)
            ok = np.isfinite(cosine)
            rows = np.arange(a, a + len(q))
            out.append((np.broadcast_to(rows[:, None], near.shape)[ok], near[ok], cosine[ok]))
        return tuple(np.concatenate(c) for c in zip(*out))


_UNIT = "point bigint, same binary, unit binary"


def _units(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            rows = np.flatnonzero((np.asarray(vectors.value_lengths().fill_null(-1)) == dims) & np.asarray(batch.column(0).is_valid()))
            taken = vectors.take(pa.array(rows))
            flat = taken.flatten()
            x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), dims).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                scale = np.abs(x).max(axis=1, initial=0)
                good = np.isfinite(scale) & (scale > 0)
                rows, x = rows[good], x[good] / scale[good, None]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
            ids = batch.column(0).take(pa.array(rows))
            units = [r.tobytes() for r in x.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([ids, pa.array([xxhash.xxh3_128_digest(u) for u in units], pa.binary()), pa.array(units, pa.binary())], ["point", "same", "unit"])

    return run


def usable(points: DataFrame, dims: int) -> DataFrame:
    """point, same (equal for equal directions), unit (the vector at unit length, packed)."""
    return points.select(*points.columns[:2]).mapInArrow(_units(dims), _UNIT)


def _matrix(column: pa.Array, dtype=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


_EXACT = "query int, point bigint, cosine float, unit binary"


def _exact(shared, k: int):
    """The k nearest in a split of each of some queries. Vectors whose key (their hash, or their id) is the query's don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_hash, keys, q = shared.value
        rows_of: dict = {}
        for row, key in enumerate(keys):
            rows_of.setdefault(key, []).append(row)
        points, cosines = np.zeros((len(q), k), np.int64), np.full((len(q), k), -np.inf, np.float32)
        units = np.zeros((len(q), k, q.shape[1]), np.float32)
        step = max(1, PRODUCTS // len(q))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, own, x = batch.column(0).to_numpy(), batch.column(1 if by_hash else 0).to_pylist(), _matrix(batch.column(2))
            for a in range(0, len(ids), step):
                part = x[a : a + step]
                scores = q @ part.T
                for c, key in enumerate(own[a : a + step]):
                    if key in rows_of:
                        scores[rows_of[key], c] = -np.inf
                keep = min(k, len(part))
                top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
                both = np.concatenate([cosines, np.take_along_axis(scores, top, axis=1)], axis=1)
                order = np.argsort(-both, axis=1, kind="stable")[:, :k]
                cosines = np.take_along_axis(both, order, axis=1)
                points = np.take_along_axis(np.concatenate([points, ids[a : a + step][top]], axis=1), order, axis=1)
                units = np.take_along_axis(np.concatenate([units, part[top]], axis=1), order[:, :, None], axis=1)
        ok = np.isfinite(cosines)
        columns = [pa.array(np.nonzero(ok)[0].astype(np.int32)), pa.array(points[ok]), pa.array(cosines[ok]), pa.array([u.tobytes() for u in units[ok]], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _EXACT.split(", ")])

    return run


def _nearest_to(vectors: DataFrame, keys: list, queries: np.ndarray, k: int, by_hash: bool) -> DataFrame:
    """query (its row), point, cosine, unit: the exact k nearest of each given vector; one pass over all."""
    shared = vectors.sparkSession.sparkContext.broadcast((by_hash, keys, queries))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "point"))
    split = vectors.select("point", "same", "unit").mapInArrow(_exact(shared, k), _EXACT).dropDuplicates(["query", "point"])
    return split.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def exact_nearest(vectors: DataFrame, queries: DataFrame, k: int) -> Iterator[DataFrame]:
    """point, other, cosine of the exact k nearest of each query, a frame for each block of QUERIES of them. Both as usable() gives
    them. Blocks are by hash; each is a bounded broadcast and one pass over all vectors."""
    blocks = max(1, math.ceil(queries.count() / (QUERIES // 2)))
    numbered = queries.withColumn("_block", F.pmod(F.xxhash64("point"), F.lit(blocks)))
    for block in range(blocks):
        own = numbered.filter(F.col("_block") == block).select("point", "unit").orderBy("point").toArrow()
        if not own.num_rows:
            continue
        ids = own.column("point").to_pylist()
        found = _nearest_to(vectors, ids, _matrix(own.column("unit").combine_chunks()), k, False)
        rows = F.broadcast(vectors.sparkSession.createDataFrame(list(enumerate(ids)), "query int, id bigint"))
        yield found.join(rows, "query").select(F.col("id").alias("point"), F.col("point").alias("other"), "cosine")


def tune(vectors: DataFrame, index: Index, sample: np.ndarray, sames: list[bytes], rows: np.ndarray, k: int) -> None:
    """Sets how many lists are visited and what share of their codes is reranked, by the exact k nearest among all vectors of
    the given rows of the sample."""
    queries = sample[rows]
    found = _nearest_to(vectors, sames, queries, k, True).select("query", "unit").toArrow()  # k rows a measured vector
    row = found.column("query").to_numpy()
    if not len(row):
        return
    units = _matrix(found.column("unit").combine_chunks())
    lists, _ = nearest(units, index.centroids, True)
    scores = queries @ index.centroids.T
    ranks = np.concatenate([(scores[row[a : a + 64]] > scores[row[a : a + 64], lists[a : a + 64]][:, None]).sum(axis=1) for a in range(0, len(row), 64)])
    quantile = math.ceil(RECALL * len(ranks)) - 1
    index.probes = max(index.probes, int(np.sort(ranks)[quantile]) + 1)
    # Where the code of each of the nearest stands among those of the sample in its list.
    own, _ = nearest(sample, index.centroids, True)
    order = np.argsort(own, kind="stable")
    ends = np.cumsum(np.bincount(own, minlength=len(index.centroids)))
    tables, codes = index.tables(queries), index.codes_of(units, lists)
    shares = np.empty(len(row))
    for r, (q, at) in enumerate(zip(row, lists)):
        members = order[ends[at - 1] if at else 0 : ends[at]]
        there = index.codes_of(sample[members], own[members]) if len(members) else np.zeros((0, index.parts), np.uint8)
        approx = sum(t[q][there[:, p]] for p, t in enumerate(tables))
        shares[r] = ((approx > sum(t[q][codes[r, p]] for p, t in enumerate(tables))).sum() + 1) / (len(members) + 1)
    index.share = float(np.sort(shares)[quantile])


def fit(vectors: DataFrame, n: int, k: int) -> Index | None:
    """Fits on a sample of at most SAMPLE_AT_MOST of ``n`` vectors, those of smallest hash."""
    if n == 0:
        return None
    lists = min(LISTS_AT_MOST, 1 << max(0, round(math.log2(math.sqrt(n)))))
    size = min(SAMPLE_AT_MOST, max(SAMPLE, SAMPLE_A_LIST * lists))
    most = (1 << 63) - 1 if 1.2 * size >= n else -(1 << 63) + (1 << 64) * 12 * size // (10 * n)  # so that few are sorted
    sample = vectors.withColumn("h", F.xxhash64("same")).filter(F.col("h") <= most).orderBy("h", "point").limit(size).select("same", "unit").toArrow()
    units = _matrix(sample.column(1).combine_chunks())
    index = Index(units, lists, n)
    some = np.random.default_rng(SEED + 1).choice(len(units), min(MEASURED, len(units)), replace=False)
    tune(vectors, index, units, sample.column(0).take(pa.array(some)).to_pylist(), some, k)
    return index


_ASSIGNED = "point bigint, unit binary, visits array<int>, code binary, buckets array<int>"


def _distinct_first(buckets: np.ndarray) -> pa.ListArray:
    """The distinct values of each row, the row's first one first."""
    new = np.ones(buckets.shape, bool)
    for k in range(1, buckets.shape[1]):
        new[:, k] = (buckets[:, :k] != buckets[:, k : k + 1]).all(axis=1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new.sum(axis=1))]).astype(np.int32)), pa.array(buckets[new]))


def _assign(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            visits, codes = own.assign(_matrix(batch.column(1)))
            places = pa.array(np.arange(0, visits.size + 1, visits.shape[1], dtype=np.int32))
            lists = pa.ListArray.from_arrays(places, pa.array(visits.ravel()))
            columns = [batch.column(0), batch.column(1), lists, pa.array([c.tobytes() for c in codes], pa.binary()), _distinct_first(own.bucket[visits])]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _ASSIGNED.split(", ")])

    return run


_NEAR = "point bigint, other bigint, cosine float"


def _few_copies(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows by id, of equal vectors the first ``most`` only."""
    order = np.argsort(ids, kind="stable")
    _, same = np.unique(np.ascontiguousarray(x[order]).view(f"V{x.dtype.itemsize * x.shape[1]}").ravel(), return_inverse=True)
    grouped = np.argsort(same, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(same))[:-1]])
    rank = np.empty(len(order), np.int64)
    rank[grouped] = np.arange(len(order)) - starts[same[grouped]]
    return order[rank < most]


def _best_of_rows(rows: np.ndarray, near: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """The positions of the k nearest of each row."""
    order = np.lexsort((near, -cosine, rows))
    counts = np.bincount(rows)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[rank < k]


def _search(index, k: int):
    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["point", "other", "cosine"]
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float32())], names)
        if not block.num_rows or not queries.num_rows:
            return none
        own, ids, q_ids, lists = index.value, block.column("point").to_numpy(), queries.column("query").to_numpy(), block.column("list").to_numpy()
        x, q = _matrix(block.column("unit").combine_chunks()), _matrix(queries.column("q_unit").combine_chunks())
        codes = _matrix(block.column("code").combine_chunks(), np.uint8)
        few = _few_copies(ids, x, k + 1)
        few = few[np.argsort(lists[few], kind="stable")]
        ids, x, codes, lists = ids[few], x[few], codes[few], lists[few]
        visits = queries.column("q_visits").combine_chunks()
        row = np.repeat(np.arange(len(q_ids)), visits.value_lengths().to_numpy(zero_copy_only=False))
        visited = visits.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(visited, kind="stable")
        row, visited = row[order], visited[order]
        found = []
        starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(lists)]):
            asking = row[np.searchsorted(visited, lists[a]) : np.searchsorted(visited, lists[a], side="right")]
            if len(asking):
                at, near, cosine = own.search(ids[a:b], x[a:b], codes[a:b], q_ids[asking], q[asking], k)
                found.append((asking[at], near, cosine))
        if not found:
            return none
        rows, near, cosine = (np.concatenate(c) for c in zip(*found))
        best = _best_of_rows(rows, near, cosine, k)
        return pa.table([pa.array(q_ids[rows[best]]), pa.array(near[best]), pa.array(cosine[best])], names)

    return run


def nearest_of_all(vectors: DataFrame, n: int, k: int) -> DataFrame:
    """point, other, cosine of about the k nearest of each vector. ``vectors``: point, same, unit, about ``n`` rows."""
    spark = vectors.sparkSession
    fitted = fit(vectors, n, k)
    if fitted is None:
        return spark.createDataFrame([], _NEAR)
    index = spark.sparkContext.broadcast(fitted)  # no more centroids than the sample has vectors, and the codebooks
    # Stored, as it is read three times.
    assigned = materialize(vectors.select("point", "unit").mapInArrow(_assign(index), _ASSIGNED), "assigned")
    # How many blocks each bucket has and how many groups of queries visit it; a row a bucket.
    visits = assigned.select(F.posexplode("buckets").alias("rank", "bucket"))
    sizes = visits.groupBy("bucket").agg(F.count("*").alias("q"), F.count_if(F.col("rank") == 0).alias("n")).filter("n > 0")
    grid = F.broadcast(sizes.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("q") / QUERIES).cast("int").alias("groups")))
    members = assigned.select("point", "unit", "code", F.col("visits")[0].alias("list"), F.col("buckets")[0].alias("bucket")).join(grid, "bucket")
    members = members.withColumn("block", F.pmod(F.xxhash64("point"), "blocks").cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    queries = assigned.select(F.col("point").alias("query"), F.col("unit").alias("q_unit"), F.col("visits").alias("q_visits"), F.explode("buckets").alias("bucket")).join(grid, "bucket")
    queries = queries.withColumn("group", F.pmod(F.xxhash64("query"), "groups").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["bucket", "block", "group"]
    queries = queries.select(*(F.col(c).alias(f"q_{c}") for c in cell), "query", "q_unit", "q_visits")
    found = members.select(*cell, "point", "unit", "code", "list").groupBy(*cell).cogroup(queries.groupBy(*(f"q_{c}" for c in cell))).applyInArrow(_search(index, k), _NEAR)
    return found


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each point of those found, each once; a few rows a point."""
    once = found.groupBy("point", "other").agg(F.max("cosine").alias("cosine"))
    order = W.partitionBy("point").orderBy(F.desc("cosine"), "other")
    return once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def neighbours(points: DataFrame, k: int = 5, dims: int = 128) -> DataFrame:
    """point, other, cosine: the k nearest others of every usable point. ``points``: an id, a vector."""
    units = usable(points, dims)
    keys = materialize(units.select("point", "same").distinct(), "keys")
    n = keys.count()
    # Copies: the k + 1 of smallest id of each vector; the limit by rank is applied before the shuffle.
    rank = F.row_number().over(W.partitionBy("same").orderBy("point"))
    first = keys.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    ids = first.groupBy("same").agg(F.sort_array(F.collect_list("point")).alias("ids")).filter(F.size("ids") > 1)
    several = materialize(keys.groupBy("same").agg(F.count("*").alias("n")).filter("n > 1").join(ids, "same"), "copies")
    copies = join_by_size(keys, several, ["same"], "n", F.lit(n))
    # Nearer than anything that is found by search, whatever its rounding.
    within = copies.select("point", F.explode("ids").alias("other"), F.lit(2.0).cast("float").alias("cosine")).filter("point <> other")
    # Surplus copies of vectors that hold more than a thousandth of all, fewer than a thousand vectors, aren't searched.
    hot = several.filter((F.col("n") > k + 1) & (F.col("n") * HOT_SHARE > n)).select("same", F.element_at("ids", -1).alias("last"))
    searched = units.join(F.broadcast(hot), "same", "left").filter(F.col("last").isNull() | (F.col("point") <= F.col("last"))).drop("last")
    near = nearest_of_all(searched, n, k)
    return _best(near.unionByName(within), k).withColumn("cosine", F.least("cosine", F.lit(1.0).cast("float")))


def _pairs(near: DataFrame) -> DataFrame:
    return near.select(F.least("point", "other").alias("point_a"), F.greatest("point", "other").alias("point_b")).distinct()


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/vector_points.parquet").select("point_no", "vector"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of points of which at least one is among the 5 nearest of the other."""
    return _pairs(neighbours(_points(spark, sf)))


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 nearest of every point, with cosines."""
    return neighbours(_points(spark, sf))


def recall(points: DataFrame, k: int = 5, dims: int = 128, every: int = 100) -> DataFrame:
    """n_queries, n_true, n_found, recall: of the exact k nearest of all vectors whose id is divisible by ``every``, how many
    neighbours() gives. One row."""
    units = materialize(usable(points, dims), "units")
    queries = units.filter(F.col("point") % every == 0).dropDuplicates(["point"])
    spark = points.sparkSession
    exact = spark.createDataFrame([], _NEAR)
    for block in exact_nearest(units, queries, k):
        exact = exact.unionByName(block)
    exact = materialize(exact, "exact")
    found = neighbours(points, k, dims).filter(F.col("point") % every == 0).select("point", "other", F.lit(1).alias("hit"))
    both = exact.join(found, ["point", "other"], "left")
    counts = both.agg(F.count_distinct("point").alias("n_queries"), F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    return counts.withColumn("recall", F.try_divide("n_found", "n_true"))


def p5_recall(spark: SparkSession, sf: str) -> DataFrame:
    """What share of the exact 5 nearest p5_neighbours gives, of every point whose number is divisible by 100."""
    return recall(_points(spark, sf))
