"""Release filter with repaired references, and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def release_filter(docs: DataFrame, truth: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Documents of allowed sources, and the ground truth whose query survives, its positives limited to documents that
    do; queries without positives go. Repeated deliveries of a document count once."""
    kept = docs.where(F.col("source").isin(allowed)).dropDuplicates(["doc_id"])
    ids = kept.select("doc_id")
    pairs = truth.join(ids.withColumnRenamed("doc_id", "query_id"), "query_id", "left_semi").select("query_id", "author_id", F.explode("positive_ids").alias("doc_id"))
    left = pairs.join(ids, "doc_id", "left_semi").groupBy("query_id", "author_id").agg(F.sort_array(F.collect_set("doc_id")).alias("positive_ids"))
    return kept, left


def consistency(docs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of counts: documents, unique ids, queries, ground-truth rows, queries without ground truth, positives
    that don't exist, and the share of candidates that are some query's positive."""
    d = docs.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("n_ids"))
    ids = docs.select("doc_id", "retrieval_role").distinct()
    queries = ids.where("retrieval_role = 'query'").select(F.col("doc_id").alias("query_id"))
    t = truth.agg(F.count(F.lit(1)).alias("n_truth"), F.countDistinct("query_id").alias("n_truth_ids"))
    q = queries.agg(F.count(F.lit(1)).alias("n_queries"))
    without = queries.join(truth.select("query_id"), "query_id", "left_anti").agg(F.count(F.lit(1)).alias("n_queries_without"))
    pos = truth.select(F.explode("positive_ids").alias("doc_id"))
    missing = pos.join(ids, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n_missing"))
    cand = ids.where("retrieval_role = 'candidate'")
    used = cand.join(pos.distinct(), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n_used"))
    n_c = cand.agg(F.count(F.lit(1)).alias("n_candidates"))
    out = d
    for one in (t, q, without, missing, used, n_c):
        out = out.crossJoin(one)  # one row each
    return out.withColumn("coverage", F.when(F.col("n_candidates") > 0, F.col("n_used") / F.col("n_candidates")).otherwise(F.lit(0.0)))


def size_class(n):
    """Size class of a release."""
    out = F.lit("1M<n")
    for most, name in reversed([(1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M")]):
        out = F.when(n < most, name).otherwise(out)
    return out
