"""Pools, samples and comparisons that the audits and reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import shuffle_key
from ..plans.skew import in_order
from .sampling import largest_gap_quotas, targets_of

#: Strata whose quotas the driver plans; more are refused.
MOST_STRATA = 10_000


def capped_pool(scored: DataFrame, most: int, seed: int) -> DataFrame:
    """Scored pairs with at most ``most`` candidates of each query: all positives, then others by a hash of the pair, so
    each query has a draw of its own. More positives than ``most`` stay too."""
    u = shuffle_key(seed, F.concat_ws(":", "query_id", "candidate_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("positive"), u, "candidate_id"))
    positives = scored.where("positive")
    others = scored.withColumn("__r", rank).where(F.col("__r") <= most).where("not positive").drop("__r")
    return positives.unionByName(others)


def phase_sample(df: DataFrame, phase: str, key: str, total: int, shares: dict[str, float], seed: int) -> DataFrame:
    """``total`` rows in which each phase has its share, as far as it has rows; uniform within the phase. Rows of other
    phases are left out."""
    quota = F.lit(0)
    for name, n in targets_of(total, shares).items():
        quota = F.when(F.col(phase) == name, n).otherwise(quota)
    return in_order(df.where(F.col(phase).isin(list(shares))), [phase], shuffle_key(seed, F.col(key)), key, "__r").where(F.col("__r") <= quota).drop("__r")


def stratified_sample(df: DataFrame, by: list[str], key: str, total: int, seed: int) -> DataFrame:
    """About ``total`` rows, from each stratum in proportion, one at least (see largest_gap_quotas). Null values form
    strata of their own."""
    name = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in by])
    d = df.withColumn("__stratum", name)
    counts = d.groupBy("__stratum").agg(F.count(F.lit(1)).alias("n")).limit(MOST_STRATA + 1).collect()
    if len(counts) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    quotas = largest_gap_quotas({r["__stratum"]: r.n for r in sorted(counts)}, total)
    plan = F.broadcast(df.sparkSession.createDataFrame([(k, v) for k, v in quotas.items() if v], "__stratum string, __quota int"))  # at most MOST_STRATA rows
    ranked = in_order(d.join(plan, "__stratum"), ["__stratum"], shuffle_key(seed, F.col(key)), key, "__r")
    return ranked.where(F.col("__r") <= F.col("__quota")).select(*df.columns)


def pair_kind(same_author: Column, same_source: Column) -> Column:
    """What a near pair tells: one author across sources or in one source, or two authors."""
    author = F.when(F.coalesce(same_author, F.lit(False)), "same_author").otherwise("other_author")
    return F.concat(author, F.lit("_"), F.when(F.coalesce(same_source, F.lit(False)), "same_source").otherwise("other_source"))


def kind_summary(pairs: DataFrame, *by: str, score: str = "score") -> DataFrame:
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(score).alias("mean_score"), F.percentile(score, F.lit(0.9)).alias("p90_score"))


def top_examples(rows: DataFrame, by: list[str], order: list, n: int = 3) -> DataFrame:
    """The first ``n`` rows of each group with their place; the rank is pruned before the shuffle."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def side_by_side(tables: dict[str, DataFrame], fields: list[str]) -> DataFrame:
    """(field, value, and for each table its rows and their share in per cent), a row for each value that any has."""
    every = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("__name"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("__name", "x.field", "x.value")
        one = one.groupBy("__name", "field", "value").agg(F.count(F.lit(1)).alias("n"))
        every = one if every is None else every.unionByName(one)
    every = every.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("__name", "field")))
    aggs = []
    for name in tables:
        mine = F.col("__name") == name
        aggs += [F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias(f"n_{name}"), F.coalesce(F.sum(F.when(mine, F.col("pct"))), F.lit(0.0)).alias(f"pct_{name}")]
    return every.groupBy("field", "value").agg(*aggs)


def episodes(df: DataFrame, author: str, key: str, most: int, seed: int) -> DataFrame:
    """(author, place, key): for each author a number of draws with replacement from its documents. The number follows
    Beta(3, 1) up to ``most``, and all draws are fixed by hashes of author and place."""
    from .training import episode_size

    u = lambda *parts: F.conv(F.substring(shuffle_key(seed, F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rows = in_order(df.where(F.col(author).isNotNull()).select(author, key), [author], shuffle_key(seed, F.col(key)), key, "__i", "__n")
    authors = rows.where("__i = 1").select(author, F.col("__n").alias("n"), episode_size(u(F.col(author)), most).alias("size"))
    draws = authors.select(author, "n", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("place"))
    draws = draws.withColumn("__i", (F.floor(u(F.col(author), F.col("place").cast("string")) * F.col("n")) + 1).cast("int"))
    return draws.join(rows.select(author, F.col("__i").cast("int").alias("__i"), key), [author, "__i"]).select(author, "place", key)


def symmetric_info_nce(scored: DataFrame, temperature: float = 0.07) -> DataFrame:
    """One row: the contrastive loss with queries as anchors, with candidates as anchors, and their mean."""
    from .training import info_nce

    there = info_nce(scored, temperature).select("n_queries", F.col("loss").alias("query_loss"))
    back = info_nce(scored.select(F.col("candidate_id").alias("query_id"), "score", "positive"), temperature).select(F.col("n_queries").alias("n_candidates"), F.col("loss").alias("candidate_loss"))
    return there.crossJoin(back).withColumn("loss", (F.col("query_loss") + F.col("candidate_loss")) / 2)  # one row each


def supervised_contrastive(scored: DataFrame, temperature: float = 0.07) -> DataFrame:
    """One row: mean over queries with a positive of the mean negative log share of each positive among all."""
    e = F.exp(F.col("score") / F.lit(temperature))
    q = scored.groupBy("query_id").agg(F.avg(F.when(F.col("positive"), F.col("score") / F.lit(temperature))).alias("s"), F.log(F.sum(e)).alias("t")).where("s is not null")
    return q.agg(F.count(F.lit(1)).alias("n_queries"), F.avg(F.col("t") - F.col("s")).alias("loss"))
