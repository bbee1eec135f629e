"""Leaderboards from a long result table (model, grouping, bucket, metric, value, n_queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X


def best_by_metric(results: DataFrame, *by: str) -> DataFrame:
    """The best model of each metric and group: highest value, lowest for error rates; of equals the greatest name."""
    good = F.when(X.lower_is_better("metric"), -F.col("value")).otherwise(F.col("value"))
    r = F.row_number().over(W.partitionBy(*by, "metric").orderBy(F.desc(good), F.desc("model")))
    return results.where("value is not null").withColumn("r", r).where("r = 1").select(*by, "metric", "model", "value")


def top_two(results: DataFrame, *by: str) -> DataFrame:
    good = F.when(X.lower_is_better("metric"), -F.col("value")).otherwise(F.col("value"))
    r = F.dense_rank().over(W.partitionBy(*by, "metric").orderBy(F.desc(good)))
    return results.where("value is not null").withColumn("place", r).where("place <= 2").select(*by, "metric", "model", "value", "place")


def by_type(results: DataFrame) -> DataFrame:
    """Mean and median over the models of a family."""
    r = results.withColumn("family", X.model_family("model"))
    return r.groupBy("family", "metric").agg(F.count("value").alias("n_models"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"))


def difficulty(results: DataFrame, *by: str) -> DataFrame:
    """Mean and spread over models for each slice: where all models are weak."""
    return results.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("worst"), F.max("value").alias("best"), (F.max("value") - F.min("value")).alias("spread"))


def gap_to_baseline(results: DataFrame, baselines: list[str], *by: str) -> DataFrame:
    """Each model's distance to the best baseline, positive where the model is better."""
    sign = F.when(X.lower_is_better("metric"), F.lit(-1.0)).otherwise(F.lit(1.0))
    b = best_by_metric(results.where(F.col("model").isin(baselines)), *by).select(*by, "metric", F.col("value").alias("baseline"))
    return results.where(~F.col("model").isin(baselines)).join(b, [*by, "metric"]).select(*by, "metric", "model", "value", "baseline", (sign * (F.col("value") - F.col("baseline"))).alias("gap"))


def wide(results: DataFrame, slices: list[str], column: str = "bucket") -> DataFrame:
    """Slices as columns with the mean over those that are there."""
    p = results.groupBy("model", "metric").pivot(column, slices).agg(F.first("value"))
    n = sum((F.col(s).isNotNull().cast("int") for s in slices), F.lit(0))
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in slices), F.lit(0.0))
    return p.withColumn("macro", F.when(n > 0, total / n))


def rollup_genre(results: DataFrame) -> DataFrame:
    """From genres to primary genres: counts (num_...) add up, pool sizes take the extremes (min_..., max_...), all other
    metrics are weighted by queries."""
    r = results.withColumn("primary_genre", X.primary("bucket"))
    weighted = F.when(F.sum("n_queries") > 0, F.sum(F.col("value") * F.col("n_queries")) / F.sum("n_queries"))
    name = F.col("metric")
    value = F.when(name.startswith("num_"), F.sum("value")).when(name.startswith("min_"), F.min("value")).when(name.startswith("max_"), F.max("value")).otherwise(weighted)
    return r.groupBy("model", "metric", "primary_genre").agg(F.sum("n_queries").alias("n_queries"), value.alias("value"))
