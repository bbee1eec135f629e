"""Metadata shortcuts: how far metadata alone gives the author away, alignment of positive pairs, topic strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The field sets of the shortcut schemes.
SCHEMES = {
    "all_authors": [], "language_only": ["lang"], "primary_genre_only": ["primary_genre"], "fine_genre_only": ["genre"],
    "language_primary_genre": ["lang", "primary_genre"], "language_fine_genre": ["lang", "genre"], "full_metadata": ["lang", "genre", "source", "length_bucket"],
}


def author_pool(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """(fields, author, rank, pool_size): authors of each metadata cell by matching documents, all documents, id."""
    total = candidates.groupBy("author_id").agg(F.count(F.lit(1)).alias("total"))
    c = candidates.groupBy(*fields, "author_id").agg(F.count(F.lit(1)).alias("match")).join(total, "author_id")
    w = W.partitionBy(*fields)
    rank = F.row_number().over(w.orderBy(F.desc("match"), F.desc("total"), "author_id"))
    return c.select(*fields, "author_id", rank.alias("rank"), F.count(F.lit(1)).over(w).alias("pool_size"))


def harmonic_mean_rank(n: Column) -> Column:
    """Expected reciprocal rank in a random order of n: H(n) / n."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / i) / n


def scheme_rows(pairs: DataFrame, candidates: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """One row for each (query, positive) pair: pool size, whether and where the true author stands, and what a guess
    from the pool is expected to get. Pools are sized once a cell; the harmonic sum once a size."""
    pool = author_pool(candidates, fields)
    sizes = pool.groupBy(*fields).agg(F.max("pool_size").alias("pool_size")) if fields else pool.agg(F.coalesce(F.max("pool_size"), F.lit(0)).alias("pool_size"))
    j = pairs.join(sizes, fields, "left") if fields else pairs.crossJoin(sizes)  # one row
    j = j.withColumn("pool_size", F.coalesce("pool_size", F.lit(0)))
    ranks = pool.select(*fields, "author_id", "rank")
    j = j.join(ranks, [*fields, "author_id"], "left")
    h = j.select("pool_size").distinct().where("pool_size > 0").select("pool_size", harmonic_mean_rank(F.col("pool_size")).alias("h"))
    j = j.join(h, "pool_size", "left")
    there = F.col("rank").isNotNull()
    return j.select(
        F.lit(name).alias("scheme"), "query_id", "lang", "pool_size", F.col("rank"), F.when(there, 1.0 / F.col("pool_size")).otherwise(F.lit(0.0)).alias("expected_1"),
        F.when(there, F.least(5.0 / F.col("pool_size"), F.lit(1.0))).otherwise(F.lit(0.0)).alias("expected_5"), F.when(there, F.col("h")).otherwise(F.lit(0.0)).alias("expected_mrr"),
    )


def scheme_summary(rows: DataFrame, *by: str) -> DataFrame:
    n, pct = F.count(F.lit(1)), lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double")) * 100
    q = F.percentile("pool_size", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    rate = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    out = rows.groupBy("scheme", *by).agg(
        n.alias("n_pairs"), pct(F.col("pool_size") > 0).alias("pct_pool"), pct(F.col("rank").isNotNull()).alias("pct_covered"), F.avg("pool_size").alias("pool_mean"), q.alias("q"),
        pct(F.col("pool_size") <= 1).alias("pct_le_1"), pct(F.col("pool_size") <= 5).alias("pct_le_5"), pct(F.col("pool_size") <= 10).alias("pct_le_10"),
        F.avg("expected_1").alias("expected_1"), F.avg("expected_5").alias("expected_5"), F.avg("expected_mrr").alias("expected_mrr"),
        rate((F.col("rank") == 1).cast("double")).alias("first_1"), rate((F.col("rank") <= 5).cast("double")).alias("first_5"), rate(1.0 / F.col("rank")).alias("first_mrr"),
    )
    return out.select("scheme", *by, "n_pairs", "pct_pool", "pct_covered", "pool_mean", F.col("q")[0].alias("pool_median"), F.col("q")[1].alias("pool_p90"), F.col("q")[2].alias("pool_p95"), "pct_le_1", "pct_le_5", "pct_le_10", "expected_1", "expected_5", "expected_mrr", "first_1", "first_5", "first_mrr")


def span(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """(author_id, n_docs, distinct values of each field)."""
    return candidates.where("author_id is not null").groupBy("author_id").agg(F.count(F.lit(1)).alias("n_docs"), *[F.countDistinct(f).alias(f"n_{f}") for f in fields])


def span_summary(spans: DataFrame, fields: list[str]) -> DataFrame:
    """(metric, n_authors, pct) of authors with a single value."""
    from .stats import flag_rates

    return flag_rates(spans, {f"single_{f}": F.col(f"n_{f}") == 1 for f in fields})


def strata(docs: DataFrame, by: list[str], least: int = 30, per_cluster: int = 40, most: int = 12) -> DataFrame:
    """(by, n_docs, clusters, status): how many topic clusters each stratum gets."""
    n = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"))
    x = F.col("n_docs")
    size_cap = F.greatest(F.lit(3), F.floor(x / F.lit(per_cluster)))
    guess = F.greatest(F.lit(3), F.bround(F.sqrt(x.cast("double")) / 2, 0))
    k = F.least(F.greatest(F.lit(3), F.least(F.lit(most), guess, size_cap)), x).cast("int")
    small = x < least
    return n.select(*by, "n_docs", F.when(small, 0).otherwise(k).alias("clusters"), F.when(small, "too_small").otherwise("clustered").alias("status"))


def topic_clusters(docs: DataFrame, key: str, text: str, by: list[str], features: int = 4096, seed: int = 42, **sizes: int) -> DataFrame:
    """(key, by, topic_cluster): k-means on hashed TF-IDF in each stratum. Strata are few (language and genre); each is
    one distributed fit over its own rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    from ..functions import text as X
    from ..session import stash

    plan = [r for r in strata(docs, by, **sizes).where("status = 'clustered'").collect()]  # a row a stratum
    tf = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features).transform(docs.where(F.length(text) > 0).select(key, *by, X.tokens(F.lower(text)).alias("tokens")))
    weighted = Normalizer(inputCol="w", outputCol="features").transform(IDF(inputCol="tf", outputCol="w", minDocFreq=2).fit(tf).transform(tf)).select(key, *by, "features").persist()
    out = None
    for r in plan:
        mine = weighted
        for b in by:
            mine = mine.where(F.col(b).eqNullSafe(F.lit(r[b])))
        if mine.limit(r.clusters).count() < r.clusters:
            continue
        c = KMeans(k=r.clusters, seed=seed, maxIter=10, featuresCol="features", predictionCol="topic_cluster").fit(mine).transform(mine).select(key, *by, "topic_cluster")
        out = c if out is None else out.unionByName(c)
    if out is None:
        out = weighted.select(key, *by, F.lit(0).alias("topic_cluster")).limit(0)
    return stash(out, "topics")
