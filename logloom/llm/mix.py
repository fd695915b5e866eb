"""Problem 9: a mix of sources by target weights.

Weights go down a tree of domain, source and language. The weight of a source is its target share, that of a domain the sum of its
sources' (a column ``domain`` of the targets names it; without one all are of one domain), that of a language its share
of all tokens of its domain, or as given. Capacities are apart from weights: what the documents of a leaf hold at the capped number of
repeats. A node that can't use its share leaves the rest to its siblings by their weights, and only what they can't use either
goes to the level above: a language that runs out gives to the other languages of its source, a source to those of its domain. Each leaf then takes whole
epochs of its documents and a prefix of one more, by tokens, in an order seeded by epoch. The prefix needs no task that sees a
whole leaf: documents are spread over hash buckets, the buckets' tokens are summed up in order, and each document adds
its place in its bucket.

Targets are of sources whatever their languages, so sources stand above languages.

Defined results: documents without id and of null or unlisted sources are never used, documents without tokens add nothing and are
never used either. A listed source without documents has an actual share of 0, its share goes to the others. Languages are codes of two or
three letters, without region and case; null and other spellings are one leaf, ``other``. Without
a given total, the total is the largest for which every source that has documents gets its share exactly (up to
half a document); with a given total, shortages are shared out and reported. The queries give the tokens of all listed
documents as the total, so that one poor source doesn't cut the whole mix. Targets with nulls
count for nothing, a null domain is one of its own. Empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.storage import materialize, spread
from logloom.llm.tokens import VOCABULARY, count_tokens

#: The leaf of what is no language code.
OTHER = "other"
#: Buckets of a leaf: two to the power of this.
BUCKET_BITS = 12


def share_out(amount: float, weights: dict, capacity: dict) -> dict:
    """``amount`` by weight, none above its capacity; what some can't take goes to the rest by weight."""
    given = dict.fromkeys(weights, 0.0)
    open_ = {k for k in weights if capacity[k] > 0 and weights[k] > 0}
    left = amount
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if given[k] + left * weights[k] / total >= capacity[k] - 1e-9}
        if not full:
            for k in open_:
                given[k] += left * weights[k] / total
            break
        for k in full:
            left -= capacity[k] - given[k]
            given[k] = float(capacity[k])
        open_ -= full
    return given


def budgets(
    supply: dict[tuple[str, str], int], targets: dict[str, tuple[float, int]], total: float | None = None,
    domains: dict[str, str | None] | None = None, languages: dict[str, float] | None = None,
) -> dict[tuple[str, str], float]:
    """Tokens for each leaf (source, language). targets: share and most repeats of each source; domains: that of each
    source; languages: the weight of each, 0 for those not named, instead of its share of its domain's tokens."""
    by_source: dict[str, dict[tuple[str, str], int]] = defaultdict(dict)
    for leaf, tokens in supply.items():
        if leaf[0] in targets:
            by_source[leaf[0]][leaf] = tokens
    spoken: dict[str | None, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    tree: dict[str | None, list[str]] = defaultdict(list)
    for s in targets:
        tree[domain := (domains or {}).get(s)].append(s)
        for leaf, tokens in by_source[s].items():
            spoken[domain][leaf[1]] += tokens
    weights = {s: targets[s][0] for s in targets}
    leaf_weights = {leaf: (spoken[(domains or {}).get(leaf[0])] if languages is None else languages).get(leaf[1], 0.0) for s in targets for leaf in by_source[s]}
    capacity = {s: sum(n for leaf, n in by_source[s].items() if leaf_weights[leaf] > 0) * targets[s][1] for s in targets}
    if total is None:
        live = [s for s in targets if capacity[s] > 0 and weights[s] > 0]
        scale = sum(weights[s] for s in live)
        total = min((capacity[s] * scale / weights[s] for s in live), default=0.0)
    out = {}
    usable = {d: sum(capacity[s] for s in own if weights[s] > 0) for d, own in tree.items()}
    for domain, amount in share_out(total, {d: sum(weights[s] for s in own) for d, own in tree.items()}, usable).items():
        for source, part in share_out(amount, {s: weights[s] for s in tree[domain]}, capacity).items():
            leaves = by_source[source]
            out |= share_out(part, {k: leaf_weights[k] for k in leaves}, {k: n * targets[source][1] for k, n in leaves.items()})
    return out


def _language(lang):
    code = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(code != "", code).otherwise(OTHER)


def sized(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, source, language, n_tokens of the documents of listed sources, counted once and stored."""
    listed = docs.select("doc_id", "source", _language(F.col("lang")).alias("language"), "text").join(targets.select("source"), "source", "left_semi")
    counted = count_tokens(listed.select("doc_id", "source", "language", "text"), "text", path)
    return materialize(counted.filter(F.col("n_tokens") > 0), "sized")


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, languages: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, language, n_tokens, copies of every document in the mix. ``docs`` as sized() gives them.

    The driver sees one row for each target and for each leaf, at most one a target and language code.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "source", "language", "n_tokens").filter("doc_id is not null")
    usable = targets.filter("source is not null and target_share is not null and max_repeats is not null")
    usable = usable if "domain" in targets.columns else usable.withColumn("domain", F.lit(None).cast("string"))
    goals, domains = {}, {}
    for r in usable.collect():
        goals[r["source"]], domains[r["source"]] = (r["target_share"], r["max_repeats"]), r["domain"]
    supply = {(r["source"], r["language"]): r["n"] for r in docs.groupBy("source", "language").agg(F.sum("n_tokens").alias("n")).collect()}
    rows = []
    for leaf, amount in budgets(supply, goals, total, domains, languages).items():
        epochs = min(int(amount // supply[leaf]), goals[leaf[0]][1])
        rest = amount - epochs * supply[leaf] if epochs < goals[leaf[0]][1] else 0.0
        rows.append((*leaf, epochs, rest))
    # One row a leaf: the documents stay where they are, whatever share of them a leaf holds.
    plan = F.broadcast(spark.createDataFrame(rows, "source string, language string, epochs int, rest double"))
    # The last epoch's own order: by a hash of the document, seeded by the epoch.
    planned = docs.join(plan, ["source", "language"]).withColumn("place", F.xxhash64(F.lit(seed), "epochs", "doc_id"))
    planned = planned.withColumn("bucket", F.shiftrightunsigned("place", 64 - BUCKET_BITS))
    sums = planned.groupBy("source", "language", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = W.partitionBy("source", "language").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "language", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("source", "language", "bucket").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = planned.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(sums, ["source", "language", "bucket"])
    taken = F.col("before") + F.col("inside") + F.col("n_tokens") / 2 <= F.col("rest")
    return placed.withColumn("copies", F.col("epochs") + taken.cast("int")).filter("copies > 0").select("doc_id", "source", "language", "n_tokens", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with what the mix holds of it; ``met`` to within a hundredth of all tokens."""
    own = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_repeats")
    )
    both = targets.select("source", "target_share", "max_repeats").join(own, "source", "left").fillna(0, ["tokens", "documents", "most_repeats"])
    everything = F.sum("tokens").over(W.partitionBy())  # one row a target
    share = F.when(everything > 0, F.col("tokens") / everything).otherwise(0.0)
    return both.select("source", "target_share", share.alias("actual_share"), "tokens", "documents", "max_repeats", "most_repeats").withColumn(
        "met", F.abs(F.col("actual_share") - F.col("target_share")) <= 0.01
    )


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    targets = spark.read.parquet(f"{sf}/mix_targets.parquet")
    return sized(spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "text")), targets), targets


def _all_tokens(docs: DataFrame) -> float:
    """The tokens of all documents of listed sources: a total that no single poor source lowers."""
    return float(docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"])


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, source, language, n_tokens, copies: the documents of the mix of as many tokens as all listed sources have, and how often each is used."""
    docs, targets = _tables(spark, sf)
    return mix(docs, targets, _all_tokens(docs))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares of p9_mix, with the shortages."""
    docs, targets = _tables(spark, sf)
    return shares(mix(docs, targets, _all_tokens(docs)), targets)


def p9_shares_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The shares of the largest mix in which every source with documents gets its share."""
    docs, targets = _tables(spark, sf)
    return shares(mix(docs, targets), targets)


def p9_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """What p9_mix takes of each leaf: tokens with their repeats, and of its supply."""
    docs, targets = _tables(spark, sf)
    taken = mix(docs, targets, _all_tokens(docs)).groupBy("source", "language").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"))
    supply = docs.groupBy("source", "language").agg(F.sum("n_tokens").alias("supply"))
    return supply.join(F.broadcast(taken), ["source", "language"], "left").fillna(0, ["tokens", "documents"])
