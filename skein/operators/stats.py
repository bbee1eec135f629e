"""Corpus statistics: counts and shares, author balance, entropy, overlap, duplicates, cell risk.

Every function takes a DataFrame and returns one; nothing is collected. Shares use windows over the already grouped
rows, so the large table is shuffled once, after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


def rows() -> Column:
    """Number of rows; a function, because columns need a running session."""
    return F.count(F.lit(1))


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(rows().alias("n_docs"))


def counts_with_share(df: DataFrame, by: list[str], within: list[str] | None = None) -> DataFrame:
    """Counts by ``by`` and each one's percentage of its ``within`` group (of everything if none)."""
    total = F.sum("n_docs").over(W.partitionBy(*(within or [])))
    return counts(df, *by).withColumn("pct", F.col("n_docs") * 100.0 / total)


def counts_by_each(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n_docs) for several fields in one pass, by grouping sets over an expanded row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(rows().alias("n_docs"))


def number_summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quantiles; nulls don't count. One row a group."""
    q = F.percentile(value, F.array(*map(F.lit, QUANTILES)))
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("q")]
    out = (df.groupBy(*by) if by else df.groupBy()).agg(*aggs)
    return out.select(*by, "n", "mean", "std", "min", "max", *[F.col("q")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(QUANTILES)])


def distinct_by(df: DataFrame, what: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(what).alias("n_distinct"))


def size_distribution(df: DataFrame, key: str) -> DataFrame:
    """(n_docs, n_keys, share): how many keys have so many rows."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(rows().alias("n_docs"))
    out = sizes.groupBy("n_docs").agg(rows().alias("n_keys"))
    return out.withColumn("share", F.col("n_keys") / F.sum("n_keys").over(W.partitionBy()))


def balance(df: DataFrame, key: str, *by: str) -> DataFrame:
    """How unevenly keys share the rows of each group: number of keys, mean, median and largest, top key (the smaller
    of equals), shares of the largest and the five largest, Gini and Herfindahl-Hirschman index.

    Ranks are taken over (group, key) counts: one row a key, not one a document.
    """
    sizes = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(rows().alias("x"))
    down = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("x"), key))
    up = F.row_number().over(W.partitionBy(*by).orderBy("x", F.desc(key)))
    r = sizes.withColumn("down", down).withColumn("up", up)
    total, n = F.sum("x"), rows()
    out = (r.groupBy(*by) if by else r.groupBy()).agg(
        total.alias("n_docs"), n.alias("n_keys"), F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"), F.max("x").alias("largest"),
        F.max(F.when(F.col("down") == 1, F.col(key))).alias("top_key"), (F.sum(F.when(F.col("down") == 1, F.col("x"))) / total).alias("top1_share"), (F.sum(F.when(F.col("down") <= 5, F.col("x"))) / total).alias("top5_share"),
        (F.lit(2.0) * F.sum(F.col("up") * F.col("x")) / (n * total) - (n + 1) / n).alias("gini"), (F.sum(F.col("x") * F.col("x")) / (total * total)).alias("hhi"),
    )
    return out


def cell_risk(df: DataFrame, key: str, *by: str) -> DataFrame:
    """Cells where few authors or one author dominate: high under 5 authors or from 40 % for the top one, medium under
    15 or from 25 %, else low."""
    b = balance(df, key, *by).select(*by, "n_docs", "n_keys", "top1_share")
    risk = F.when((F.col("n_keys") < 5) | (F.col("top1_share") >= 0.4), "high").when((F.col("n_keys") < 15) | (F.col("top1_share") >= 0.25), "medium").otherwise("low")
    return b.withColumn("risk", risk)


def entropy(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_docs, n_values, entropy in bits, normalised by the values' number, dominant value and its share)."""
    c = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(rows().alias("n"))
    total = F.sum("n").over(W.partitionBy(key))
    p = c.withColumn("p", F.col("n") / total).withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), value)))
    out = p.groupBy(key).agg(F.sum("n").alias("n_docs"), rows().alias("n_values"), F.sum(-F.col("p") * F.log2("p")).alias("entropy"), F.max(F.when(F.col("rank") == 1, F.col(value))).alias("dominant"), F.max("p").alias("dominant_share"))
    return out.withColumn("normalised", F.when(F.col("n_values") > 1, F.col("entropy") / F.log2(F.col("n_values").cast("double"))).otherwise(F.lit(0.0)))


def majority(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the most frequent value, the smaller of equals."""
    c = df.where(F.col(key).isNotNull()).groupBy(key, value).agg(rows().alias("n"))
    first = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), F.asc_nulls_last(value)))
    return c.withColumn("r", first).where("r = 1").select(key, value, "n")


def value_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """(value_a < value_b, n_keys): how many keys have both. Pairs are made within a key's distinct values, of which
    there are as many as the value has classes."""
    v = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("v")).where(F.size("v") > 1)
    later = F.transform("v", lambda a, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda b: F.struct(a.alias("value_a"), b.alias("value_b"))))
    return v.select(F.explode(F.flatten(later)).alias("p")).groupBy("p.value_a", "p.value_b").agg(rows().alias("n_keys"))


def membership(df: DataFrame, key: str, group: str) -> DataFrame:
    """(groups, n_keys): in which combination of groups keys occur."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(group)), "+").alias("groups"))
    return g.groupBy("groups").agg(rows().alias("n_keys"))


def overlap_matrix(df: DataFrame, key: str, group: str) -> DataFrame:
    """(group_a, group_b, n_keys) of shared keys, the diagonal included."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(group).alias("g"))
    return g.select(F.explode("g").alias("group_a"), "g").select("group_a", F.explode("g").alias("group_b")).groupBy("group_a", "group_b").agg(rows().alias("n_keys"))


def duplicate_groups(df: DataFrame, key: str, doc: str, author: str, **flags: str) -> DataFrame:
    """(key, n_docs, n_authors, a flag for each named column with several values, the first eight ids) of repeated keys.
    The ids are kept as a bounded array: the smallest so many by rank, not a list of all."""
    r = df.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(doc)))
    first = F.array_join(F.sort_array(F.collect_set(F.when(F.col("__r") <= 8, F.col(doc)))), ",")
    cross = [(F.countDistinct(c) > 1).alias(name) for name, c in flags.items()]
    return r.groupBy(key).agg(rows().alias("n_docs"), F.countDistinct(author).alias("n_authors"), *cross, first.alias("first_ids")).where("n_docs > 1")


def top_with_other(df: DataFrame, value: str, n: int, *by: str) -> DataFrame:
    """Counts of the ``n`` most frequent values of each group, the rest together as ``other``."""
    c = df.groupBy(*by, value).agg(rows().alias("n_docs"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n_docs"), F.asc_nulls_last(value)))
    name = F.when(rank <= n, F.coalesce(F.col(value), F.lit("unknown"))).otherwise("other")
    return c.withColumn("label", name).groupBy(*by, "label").agg(F.sum("n_docs").alias("n_docs"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Row shares of a fixed list of column values."""
    c = df.groupBy(row).pivot(column, values).agg(rows())
    total = sum((F.coalesce(F.col(v), F.lit(0)) for v in values), F.lit(0))
    return c.select(row, *[(F.coalesce(F.col(v), F.lit(0)) / F.greatest(total, F.lit(1))).alias(v) for v in values])


def overview(df: DataFrame, author: str, length: str, fields: list[str]) -> DataFrame:
    """One row: documents, authors, documents per author (mean, median, p90, p95, max), distinct values of each field
    and the mean length."""
    a = df.where(F.col(author).isNotNull()).groupBy(author).agg(rows().alias("x"))
    per = a.agg(rows().alias("n_authors"), F.avg("x").alias("mean_docs"), F.percentile("x", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))).alias("q"), F.max("x").alias("max_docs"))
    whole = df.agg(rows().alias("n_docs"), F.avg(length).alias("mean_length"), *[F.countDistinct(f).alias(f"n_{f}") for f in fields])
    out = whole.crossJoin(per)  # one row each
    return out.select("n_docs", "n_authors", "mean_docs", F.col("q")[0].alias("median_docs"), F.col("q")[1].alias("p90_docs"), F.col("q")[2].alias("p95_docs"), "max_docs", "mean_length", *[f"n_{f}" for f in fields])


def stage_flow(stages: DataFrame, order: str, count: str) -> DataFrame:
    """Retention over ordered stages: kept of the first stage, and kept and dropped from one stage to the next. The
    table has a row a stage, so its window without partition is no bottleneck."""
    w = W.partitionBy().orderBy(order)
    first, before = F.first(count).over(w), F.lag(count).over(w)
    zero_safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return stages.select(*stages.columns, zero_safe(F.col(count), first).alias("of_first"), zero_safe(F.col(count), before).alias("of_previous"), (F.coalesce(before, F.col(count)) - F.col(count)).alias("dropped"))


def flag_rates(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(metric, pairs, matches, pct): one pass over all flags, unpivoted; a null flag is no match."""
    cols = df.agg(rows().alias("pairs"), *[F.sum(F.coalesce(c, F.lit(False)).cast("bigint")).alias(k) for k, c in flags.items()])
    stack = ", ".join(f"'{k}', `{k}`" for k in flags)
    long = cols.select("pairs", F.expr(f"stack({len(flags)}, {stack}) as (metric, matches)"))
    return long.select("metric", "pairs", "matches", F.when(F.col("pairs") > 0, F.col("matches") * 100.0 / F.col("pairs")).otherwise(F.lit(0.0)).alias("pct"))
