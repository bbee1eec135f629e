"""Sampling and caps. Every random choice is an order by a seeded hash, so it is the same under any partitioning.

Caps by a literal rank within a key: Spark prunes such ranks before the shuffle (WindowGroupLimit), so a hot key never
reaches one task whole. Ranks against a planned quota go by ranges of the random key (plans.skew.in_order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import shuffle_key
from ..plans.skew import in_order, sized

#: Wanted shares of the languages and of the length buckets.
LANGUAGE_WEIGHTS = {"en": 0.35, "zh": 0.10, "es": 0.10, "ar": 0.08, "fr": 0.08, "ru": 0.08, "de": 0.08, "ja": 0.05, "ko": 0.05, "hi": 0.03}
LENGTH_WEIGHTS = {"short": 0.15, "medium": 0.50, "long": 0.20, "extra_long": 0.15}


def half_even(x: float) -> int:
    """Round half to even, as Python does."""
    return round(x)


def targets_of(total: int, weights: dict[str, float]) -> dict[str, int]:
    """Rounded shares of ``total``; the whole difference goes to the first key."""
    out = {k: half_even(total * w) for k, w in weights.items()}
    if out:
        first = next(iter(out))
        out[first] += total - sum(out.values())
    return out


def capped(df: DataFrame, most: int, *by: str, order: list) -> DataFrame:
    """At most ``most`` rows of each group, first in ``order``."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")


def author_cap(df: DataFrame, author: str, key: str, most: int, seed: int) -> DataFrame:
    """A uniform sample of at most ``most`` documents of each author; authors unknown are no author and dropped."""
    return capped(df.where(F.col(author).isNotNull()), most, author, order=[shuffle_key(seed, F.col(key)), key])


def author_limits(df: DataFrame, author: str, key: str, least: int, fallback: int, most: int, seed: int) -> DataFrame:
    """``author_cap`` for authors with at least ``least`` documents; authors with ``fallback`` up to ``least`` are kept
    as second choice and marked. Column ``author_class``: full or fallback."""
    capped_ = sized(df, author, "author_docs").where(F.col("author_docs") >= fallback)
    marked = capped_.withColumn("author_class", F.when(F.col("author_docs") >= least, "full").otherwise("fallback"))
    return author_cap(marked, author, key, most, seed)


def dataset_cap(df: DataFrame, group: str, key: str, default: int, overrides: dict[str, int], seed: int) -> DataFrame:
    """A cap for each source after a shuffle; some sources have their own."""
    cap = F.lit(default)
    for name, n in overrides.items():
        cap = F.when(F.col(group) == name, n).otherwise(cap)
    largest = max([default, *overrides.values()])
    rank = F.row_number().over(W.partitionBy(group).orderBy(shuffle_key(seed, F.col(key)), key))
    return df.withColumn("__r", rank).where(F.col("__r") <= largest).where(F.col("__r") <= cap).drop("__r")


def quota_sample(df: DataFrame, cell: list[str], key: str, quotas: DataFrame, seed: int) -> DataFrame:
    """At most ``quota`` documents of each cell. ``quotas`` (cell columns, quota) is a small planned table."""
    ranked = in_order(df.join(F.broadcast(quotas), cell), cell, shuffle_key(seed, F.col(key)), key, "pick")
    return ranked.where(F.col("pick") <= F.col("quota"))


def bucket_fill(df: DataFrame, group: str, bucket: str, key: str, target: int, weights: dict[str, float], seed: int) -> DataFrame:
    """``target`` documents of each group: first by the buckets' quotas, then, where buckets were short, from all that
    is left. Column ``pass`` tells which pass took the document."""
    quota = F.lit(0)
    for name, n in targets_of(target, weights).items():
        quota = F.when(F.col(bucket) == name, n).otherwise(quota)
    u = shuffle_key(seed, F.col(key))
    r = in_order(df, [group, bucket], u, key, "__i").withColumn("__u", u).withColumn("__first", F.col("__i") <= quota).drop("__i")
    order = F.row_number().over(W.partitionBy(group).orderBy(F.desc("__first"), "__u", key))
    r = r.withColumn("__r", order).where(F.col("__r") <= target)
    return r.withColumn("pass", F.when(F.col("__first"), "quota").otherwise("fill")).drop("__u", "__first", "__r")


def planned_fill(df: DataFrame, group: str, cell: str, key: str, targets: dict[str, int], weights: dict[str, float], seed: int) -> DataFrame:
    """``bucket_fill`` for all groups in one plan, each with its own target: first by the cells' shares of the target,
    then from what is left, null and unweighted cells included. Groups without target are left out. Both ranks go by
    ranges of the random key, so neither a group nor a cell is ever in one task."""
    spark = df.sparkSession
    plan = [(g, t, c, n) for g, t in targets.items() for c, n in targets_of(t, weights).items()]
    goals = F.broadcast(spark.createDataFrame(list(targets.items()), f"{group} string, __target int"))  # groups x cells of the plan
    quotas = F.broadcast(spark.createDataFrame([(g, c, n) for g, _, c, n in plan], f"{group} string, {cell} string, __quota int"))
    u = shuffle_key(seed, F.col(key))
    r = in_order(df.join(goals, group), [group, cell], u, key, "__i").join(quotas, [group, cell], "left")
    r = r.withColumn("__first", F.coalesce(F.col("__i") <= F.col("__quota"), F.lit(False)))
    r = in_order(r, [group], F.concat(F.when(F.col("__first"), "0").otherwise("8"), u), key, "__r").where(F.col("__r") <= F.col("__target"))
    return r.select(*df.columns, F.when(F.col("__first"), "quota").otherwise("fill").alias("pass"))


def genre_key(genre, targets: list[str]):
    """The first target that the genre equals or lies under, else null."""
    out = F.lit(None).cast("string")
    for t in reversed(targets):
        out = F.when((genre == t) | genre.startswith(f"{t}/"), t).otherwise(out)
    return out


def genre_spill(df: DataFrame, group: str, genre: str, key: str, target: int, weights: dict[str, float], seed: int) -> DataFrame:
    """Genre quotas of each group, then a spill from leftovers and genres without target until ``target`` is reached.
    Leftovers are told by the document's key, which is unique."""
    goals = targets_of(target, weights)
    g = genre_key(F.col(genre), list(goals))
    quota = F.lit(0)
    for name, n in goals.items():
        quota = F.when(F.col("target_genre") == name, n).otherwise(quota)
    u = shuffle_key(seed, F.col(key))
    r = in_order(df.withColumn("target_genre", g), [group, "target_genre"], u, key, "__i").withColumn("__u", u)
    r = r.withColumn("__first", F.col("target_genre").isNotNull() & (F.col("__i") <= quota)).drop("__i")
    order = F.row_number().over(W.partitionBy(group).orderBy(F.desc("__first"), "__u", key))
    r = r.withColumn("__r", order).where(F.col("__r") <= target)
    return r.withColumn("pass", F.when(F.col("__first"), "quota").otherwise("spill")).drop("__u", "__first", "__r")


def deficits(df: DataFrame, cell: list[str], quotas: DataFrame) -> DataFrame:
    """(cell, quota, selected, missing) of cells that fall short, empty cells included."""
    have = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    out = quotas.join(have, cell, "left").select(*cell, "quota", F.least("quota", F.coalesce("n", F.lit(0))).alias("selected"))
    return out.withColumn("missing", F.col("quota") - F.col("selected")).where("missing > 0")


def language_targets(counts: DataFrame, lang: str, n: str, total: int, weights: dict[str, float]) -> DataFrame:
    """(lang, n, target) of the languages with a weight and documents: shares of ``total``, rounded, held to what is
    there. ``counts`` has a row a language.

    All is a formula over at most len(weights) rows: the rounding difference d goes to the first d languages in order of
    weight; what the caps cut off fills the others' slack in that order, each taking what the slack before it leaves.
    Without any weighted language all count alike."""
    order = [(k, float(w), i) for i, (k, w) in enumerate(sorted(weights.items(), key=lambda x: -x[1])) if w > 0]
    rows = counts.where(F.col(lang).isNotNull() & (F.col(n) > 0)).select(F.col(lang).alias("lang"), F.col(n).cast("bigint").alias("n"))
    known = rows.join(F.broadcast(counts.sparkSession.createDataFrame(order, "lang string, w double, i int")), "lang", "left")
    every = W.partitionBy()
    known = known.withColumn("goal", F.least(F.lit(total), F.sum("n").over(every))).withColumn("some", F.max(F.col("w").isNotNull()).over(every))
    known = known.where(~F.col("some") | F.col("w").isNotNull()).withColumn("w", F.coalesce("w", F.lit(1.0)))
    known = known.withColumn("first", F.bround(F.col("goal") * F.col("w") / F.sum("w").over(every), 0).cast("bigint"))
    by_weight = every.orderBy(F.desc("w"), "i", "lang")
    known = known.withColumn("place", F.row_number().over(by_weight)).withColumn("off", F.col("goal") - F.sum("first").over(every))
    repaired = F.col("first") + F.when(F.col("place") <= F.abs("off"), F.signum(F.col("off").cast("double"))).otherwise(0).cast("bigint")
    known = known.withColumn("held", F.least(repaired, F.col("n"))).withColumn("slack", F.col("n") - F.col("held")).withColumn("rest", F.col("goal") - F.sum("held").over(every))
    before = F.sum("slack").over(by_weight) - F.col("slack")
    more = F.greatest(F.lit(0), F.least(F.col("slack"), F.col("rest") - before))
    return known.select(F.col("lang").alias(lang), F.col("n").alias(n), (F.col("held") + more).alias("target"))


def balanced_pick(df: DataFrame, group: str, key: str, total: int, seed: int) -> DataFrame:
    """``total`` documents, evenly over the groups in their order, the remainder to the first ones, then filled from
    what is left. Groups are few (languages): their list is planned from counts."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy().orderBy(F.asc_nulls_first(group))) - 1  # over one row a group
    n_groups = F.count(F.lit(1)).over(W.partitionBy())
    quota = F.floor(F.lit(total) / n_groups).cast("int") + (place < F.pmod(F.lit(total), n_groups)).cast("int")
    quotas = sizes.select(F.col(group).alias("__g"), quota.alias("__q"))
    u = shuffle_key(seed, F.col(key))
    r = in_order(df, [group], u, key, "__n").withColumn("__u", u)
    r = r.join(F.broadcast(quotas), F.col(group).eqNullSafe(F.col("__g"))).withColumn("picked", F.col("__n") <= F.col("__q"))
    first = r.where("picked")
    more = r.where(~F.col("picked")).orderBy("__u", key).limit(total)  # TakeOrdered: only the smallest of each partition move
    both = first.unionByName(more).orderBy(F.desc("picked"), "__u", key).limit(total)
    return both.drop("__u", "__n", "__q", "__g")


def uniform_cap(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    return df.orderBy(shuffle_key(seed, F.col(key)), key).limit(most)


def largest_gap_quotas(sizes: dict[str, int], total: int) -> dict[str, int]:
    """Proportional quotas with at least one each; the rounding is repaired where quota and exact share differ most."""
    whole = sum(sizes.values())
    if not whole:
        return {k: 0 for k in sizes}
    total = min(total, whole)
    exact = {k: total * n / whole for k, n in sizes.items()}
    out = {k: min(n, max(1, int(exact[k]))) if n else 0 for k, n in sizes.items()}
    while sum(out.values()) != total:
        short = sum(out.values()) < total
        able = [k for k in sizes if (out[k] < sizes[k] if short else out[k] > 1)]
        if not able:
            break
        k = max(able, key=lambda k: ((exact[k] - out[k]) if short else (out[k] - exact[k]), k))
        out[k] += 1 if short else -1
    return out
