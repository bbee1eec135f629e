"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A key is hot when it holds more than 1 / HOT_PARTS of the rows, so there are fewer than HOT_PARTS hot keys: the
#: list of hot keys is small whatever the input, which is what makes broadcasting it safe.
HOT_PARTS = 400
#: Ranges of a random key in which the rows of a group are ranked apart.
RANGES = 4096


def hot_keys(left: DataFrame, key: str, total: int, parts: int = HOT_PARTS) -> DataFrame:
    """The fewer than ``parts`` keys that hold more than total / parts rows each. Pre-aggregated before the shuffle."""
    floor = max(total // parts, 10_000)
    return left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > floor).select(key)


def split_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner equi-join of many ``left`` rows with ``right``, which has one row for each key. Rows of hot keys meet
    a broadcast of the right rows of those keys (bounded by the number of hot keys) and never move; all others are
    shuffled as usual. Nothing is dropped: the two halves are disjoint by key."""
    hot_right = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    cold = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return cold.unionByName(left.join(hot_right, key).select(*cold.columns))


def sized(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the number of rows of each row's key; rows with a null key are left out. Counted before the shuffle; the rows
    of hot keys don't move."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    total = counts.agg(F.coalesce(F.sum(name), F.lit(0)).alias("n")).first().n
    hot = counts.where(F.col(name) > max(total // HOT_PARTS, 10_000)).select(key)
    return split_join(df.where(F.col(key).isNotNull()), counts, key, hot)


def in_order(df: DataFrame, by: list[str], u: Column, key: str, rank: str, size: str | None = None, ranges: int = RANGES) -> DataFrame:
    """Adds the exact rank, from 1, of each row within its group in the order of ``u`` (hexadecimal digits), then ``key``,
    and the group's size if named. Groups may be of any size: rows are ranked within ``ranges`` ranges of u, and the
    ranges' counts are added up first, so no task holds a group. Null group values are equal to each other."""
    placed = df.withColumn("__u", u).withColumn("__range", F.pmod(F.conv(F.substring("__u", 1, 6), 16, 10).cast("bigint") * ranges / F.lit(1 << 24), F.lit(ranges)).cast("int"))
    counts = placed.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(*by)  # at most ``ranges`` rows a group
    counts = counts.withColumns({"__before": F.sum("__c").over(w.orderBy("__range")) - F.col("__c"), "__whole": F.sum("__c").over(w)}).drop("__c")
    names = {c: f"__g{i}" for i, c in enumerate([*by, "__range"])}
    right = counts.select(*[F.col(c).alias(n) for c, n in names.items()], "__before", "__whole")
    same = F.lit(True)
    for c, n in names.items():
        same &= F.col(c).eqNullSafe(F.col(n))
    at = F.row_number().over(W.partitionBy(*by, "__range").orderBy("__u", key))
    out = placed.join(right, same).withColumn(rank, at + F.col("__before"))
    if size:
        out = out.withColumn(size, F.col("__whole"))
    return out.drop("__u", "__range", "__before", "__whole", *names.values())
