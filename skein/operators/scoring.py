"""Retrieval and verification metrics on scored pairs, dense scoring, chance levels.

Scored pairs have query_id, candidate_id, score and positive (boolean).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KS = [1, 3, 5, 10]
#: Scores are compared at this many decimals wherever they are grouped, which bounds the number of distinct ones.
DECIMALS = 6
BLOCK_QUERIES, BLOCK_ROWS = 2_048, 50_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_scores(queries: DataFrame, rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Cosine of every query with every row of another id: (query_id, candidate_id, score, positive, query_label).

    Blocks of queries meet blocks of rows in one matrix product each; a task holds one block of either side. The
    numbers of blocks come from the two counts, so memory doesn't grow with the tables.
    """
    nq, nr = max(queries.count(), 1), max(rows.count(), 1)
    bq, br = -(-nq // BLOCK_QUERIES), max(-(-nr // BLOCK_ROWS), min(nr, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # new attributes on the query side: both sides may come from one table, and shared ones would be pruned
    q = queries.select(F.col(key).alias(key), F.col(vector).alias(vector), F.col(label).alias(label), F.pmod(F.xxhash64(key), F.lit(bq)).alias("qb")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(br - 1)).cast("array<bigint>")))
    r = rows.select(key, vector, label, F.pmod(F.xxhash64(key), F.lit(br)).alias("rb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1)).cast("array<bigint>")))
    kind = rows.schema[key].dataType.simpleString()

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "candidate_id": [], "score": [], "positive": [], "query_label": []})
        x, y = (np.stack(f[vector].to_numpy()).astype(np.float64) for f in (a, b))
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
        y /= np.maximum(np.sqrt((y * y).sum(1, keepdims=True)), 1e-300)
        s = x @ y.T
        i, j = np.nonzero(a[key].to_numpy()[:, None] != b[key].to_numpy()[None, :])
        la, lb = a[label].to_numpy(), b[label].to_numpy()
        return pd.DataFrame({"query_id": a[key].to_numpy()[i], "candidate_id": b[key].to_numpy()[j], "score": s[i, j], "positive": la[i] == lb[j], "query_label": la[i]})

    out = f"query_id {kind}, candidate_id {kind}, score double, positive boolean, query_label {rows.schema[label].dataType.simpleString()}"
    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(score, out)


def topk(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best candidates of each query; equal scores by candidate id. Ranks are pruned before the shuffle."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def ideal_gain(n: Column, k: int) -> Column:
    """Discounted gain of the best ranking of ``n`` positives, cut at ``k``."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n.cast("int"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def ranking(scored: DataFrame, ks: list[int] = KS) -> DataFrame:
    """For each query with a positive: n_candidates, n_positives, recall, success and ndcg at each k, and mrr. Cut-offs
    are clipped to the number of candidates in the formula, not in the label; mrr counts strictly better candidates."""
    base = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum(F.col("positive").cast("int")).alias("n_positives"), F.max(F.when(F.col("positive"), F.col("score"))).alias("best")).where("n_positives > 0")
    better = scored.join(base.select("query_id", "best"), "query_id").groupBy("query_id").agg(F.sum((F.col("score") > F.col("best")).cast("int")).alias("better"))
    top = topk(scored, max(ks)).where("positive")
    gains = top.groupBy("query_id").agg(*[F.sum((F.col("rank") <= k).cast("int")).alias(f"h{k}") for k in ks], *[F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))).alias(f"g{k}") for k in ks])
    j = base.join(better, "query_id").join(gains, "query_id", "left")
    cols = []
    for k in ks:
        hits = F.coalesce(F.col(f"h{k}"), F.lit(0))
        cols += [(hits / F.col("n_positives")).alias(f"recall_{k}"), (hits > 0).cast("double").alias(f"success_{k}"), (F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / ideal_gain(F.col("n_positives"), k)).alias(f"ndcg_{k}")]
    return j.select("query_id", "n_candidates", "n_positives", *cols, (1 / (F.col("better") + 1.0)).alias("mrr"))


def mean_ranking(per_query: DataFrame, *by: str) -> DataFrame:
    names = [c for c in per_query.columns if c.startswith(("recall_", "success_", "ndcg_")) or c == "mrr"]
    return (per_query.groupBy(*by) if by else per_query.groupBy()).agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(c).alias(c) for c in names], F.min("n_candidates").alias("min_pool"), F.max("n_candidates").alias("max_pool"))


def by_score(scored: DataFrame, *by: str) -> DataFrame:
    """(by, score, p, n): positives and negatives at each distinct score."""
    return scored.groupBy(*by, F.round("score", DECIMALS).alias("score")).agg(F.sum(F.col("positive").cast("bigint")).alias("p"), F.sum((~F.col("positive")).cast("bigint")).alias("n"))


def eer(grouped: DataFrame, *by: str) -> DataFrame:
    """Equal error rate from ``by_score`` rows: the first change of sign of false-positive minus false-negative rate,
    interpolated. A group without positives or negatives has no row."""
    w = W.partitionBy(*by)
    down = w.orderBy(F.desc("score"))
    run = down.rowsBetween(W.unboundedPreceding, 0)
    r = grouped.withColumn("all_p", F.sum("p").over(w)).withColumn("all_n", F.sum("n").over(w)).where("all_p > 0 and all_n > 0")
    r = r.withColumn("x1", F.sum("n").over(run) / F.col("all_n")).withColumn("y1", (F.col("all_p") - F.sum("p").over(run)) / F.col("all_p"))
    r = r.withColumn("x0", F.coalesce(F.lag("x1").over(down), F.lit(0.0))).withColumn("y0", F.coalesce(F.lag("y1").over(down), F.lit(1.0)))
    cross = F.signum(F.col("x0") - F.col("y0")) != F.signum(F.col("x1") - F.col("y1"))
    first = r.where(cross).withColumn("__r", F.row_number().over(down)).where("__r = 1")
    denominator = (F.col("y0") - F.col("x0")) + (F.col("x1") - F.col("y1"))
    t = F.least(F.greatest((F.col("y0") - F.col("x0")) / denominator, F.lit(0.0)), F.lit(1.0))
    value = F.when(denominator == 0, (F.col("x0") + F.col("y0")) / 2).otherwise(F.col("x0") + t * (F.col("x1") - F.col("x0")))
    return first.select(*by, F.col("all_p").alias("n_positive"), F.col("all_n").alias("n_negative"), value.alias("eer"))


def roc_auc(grouped: DataFrame, *by: str) -> DataFrame:
    """Area under the curve from ``by_score`` rows: average ranks over ties."""
    w = W.partitionBy(*by)
    below = w.orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    r = grouped.withColumn("before", F.coalesce(F.sum(F.col("p") + F.col("n")).over(below), F.lit(0)))
    rank = F.col("before") + (F.col("p") + F.col("n") + 1) / 2
    s = (r.groupBy(*by) if by else r.groupBy()).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.sum(F.col("p") * rank).alias("s")).where("all_p > 0 and all_n > 0")
    return s.select(*by, F.col("all_p").alias("n_positive"), F.col("all_n").alias("n_negative"), ((F.col("s") - F.col("all_p") * (F.col("all_p") + 1) / 2) / (F.col("all_p") * F.col("all_n"))).alias("roc_auc"))


def sampled_negatives(scored: DataFrame, n: int, seed: int) -> DataFrame:
    """All positives and at most ``n`` negatives of each query, by hash."""
    from ..functions.text import shuffle_key

    u = shuffle_key(seed, F.concat_ws(":", "query_id", "candidate_id"))
    neg = scored.where("not positive").withColumn("__r", F.row_number().over(W.partitionBy("query_id").orderBy(u, "candidate_id"))).where(F.col("__r") <= n).drop("__r")
    return scored.where("positive").unionByName(neg)


def chance(sizes: DataFrame, ks: list[int] = KS) -> DataFrame:
    """Expected success, recall and ndcg at k and mrr of a random ranking for each (n_candidates, n_positives); worked
    out once for each distinct pair and joined back by the caller."""
    d = sizes.select("n_candidates", "n_positives").distinct()
    n, r = F.col("n_candidates").cast("double"), F.col("n_positives").cast("double")
    cols = []
    for k in ks:
        kk = F.least(F.lit(k), F.col("n_candidates").cast("int"))
        miss = F.aggregate(F.sequence(F.lit(0), kk - 1), F.lit(1.0), lambda p, i: p * F.greatest(n - r - i, F.lit(0.0)) / (n - i))
        gain = F.aggregate(F.sequence(F.lit(1), kk), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        cols += [(1 - miss).alias(f"success_{k}"), (kk / n).alias(f"recall_{k}"), (r / n * gain / ideal_gain(F.col("n_positives"), k)).alias(f"ndcg_{k}")]
    init = F.struct((r / n).alias("p"), F.lit(0.0).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        # p: chance that the first positive stands at place i
        after = acc["p"] * F.greatest(n - r - i + 1, F.lit(0.0)) / F.greatest(n - i, F.lit(1.0))
        return F.struct(after.alias("p"), (acc["s"] + acc["p"] / i).alias("s"))

    mrr = F.aggregate(F.sequence(F.lit(1), F.col("n_candidates").cast("int") - F.col("n_positives").cast("int") + 1), init, step, lambda acc: acc["s"])
    return d.select("n_candidates", "n_positives", *cols, mrr.alias("mrr"))


def chance_adjusted(value: Column, expected: Column) -> Column:
    """0 at chance, 1 at best; null where chance is certain."""
    return F.when(expected < 1, (value - expected) / (1 - expected))


def max_similarity(q: Column, c: Column) -> Column:
    """Late interaction: mean over the query's token vectors of the best dot product with the candidate's."""
    best = F.transform(q, lambda x: F.array_max(F.transform(c, lambda y: dot(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(q)


def pooled(tokens: Column, dims: int) -> Column:
    """Mean of the token vectors, scaled to unit length."""
    total = F.aggregate(tokens, F.array_repeat(F.lit(0.0), dims), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    mean = F.transform(total, lambda x: x / F.size(tokens))
    norm = F.sqrt(dot(mean, mean))
    return F.transform(mean, lambda x: x / norm)


def batched(blocks: Iterator[pd.DataFrame], f) -> Iterator[pd.DataFrame]:
    """Apply a batch scorer to each Arrow batch."""
    for b in blocks:
        yield f(b)
