"""Author text maps, pairs, windows, negatives and forward loss values for contrastive training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import shuffle_key


#: About as many ids does a row of the author map hold at most.
BLOCK = 4096


def author_map(df: DataFrame, author: str, key: str, least: int = 2, block: int = BLOCK) -> DataFrame:
    """(author, n_docs, ids): all documents of the authors with enough of them. An author with more than ``block`` has
    several rows, the documents dealt to them by hash, so a third of all rows doesn't become one huge row; n_docs is the
    author's whole number in each."""
    rows = df.where(F.col(author).isNotNull()).select(author, key)
    n = rows.groupBy(author).agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least)
    # authors in one block are gathered as they are; only the large ones, fewer than rows / block, are dealt
    large = F.broadcast(n.where(F.col("n_docs") > block).select(F.col(author), F.ceil(F.col("n_docs") / F.lit(block)).alias("__parts")))
    dealt = rows.join(large, author, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(key), F.col("__parts")), F.lit(0)))
    ids = dealt.groupBy(author, "__part").agg(F.sort_array(F.collect_list(key)).alias("ids")).drop("__part")
    return n.join(ids, author)


def two_examples(df: DataFrame, author: str, key: str, seed: int) -> DataFrame:
    """(author, anchor, positive): two documents of each author with two or more, by hash."""
    w = W.partitionBy(author).orderBy(shuffle_key(seed, F.col(key)), key)
    r = df.where(F.col(author).isNotNull()).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 2)
    out = r.groupBy(author).agg(F.max(F.when(F.col("__r") == 1, F.col(key))).alias("anchor"), F.max(F.when(F.col("__r") == 2, F.col(key))).alias("positive"))
    return out.where("positive is not null")


def windows(tokens: Column, width: int, most: int) -> Column:
    """Windows of ``width`` tokens, the last one shorter; if there are more than ``most``, so many at even spacing."""
    n = F.ceil(F.size(tokens) / F.lit(width)).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(tokens, i * width + 1, width))
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(every, (F.bround(i * (n - 1) / F.lit(float(max(most - 1, 1))), 0) + 1).cast("int")))
    return F.when(n <= most, every).otherwise(picked)


def controlled_negatives(df: DataFrame, author: str, key: str, source: str, genre: str, seed: int, most: int = 4) -> DataFrame:
    """(anchor, negative, level): for each document another author's, best of the same source and genre (1), then the
    same source (2), then the same genre (3), then any (4).

    No all-pairs join: in each cell documents stand in a hash order, and the next document of another author is looked
    for among the next ``most`` places; the first level that has one wins. Authors that fill more of a cell than that
    find their negatives by the cell's first document of another author.
    """
    d = df.where(F.col(author).isNotNull()).select(key, author, source, genre).withColumn("__u", shuffle_key(seed, F.col(key)))
    levels = [[source, genre], [source], [genre], []]
    found = []
    for i, cell in enumerate(levels):
        part = [F.col(c) for c in cell] or [F.substring("__u", 1, 2)]  # all rows: any hash part will do
        w = W.partitionBy(*part).orderBy("__u", key)
        ahead = F.collect_list(F.struct(F.col(author).alias("a"), F.col(key).alias("k"))).over(w.rowsBetween(1, most))
        other = F.filter(ahead, lambda x: x["a"] != F.col(author))
        firsts = d.groupBy(*cell, author).agg(F.min(F.struct("__u", key)).alias("first")).withColumn("__r", F.row_number().over(W.partitionBy(*(cell or [F.lit(1)])).orderBy("first"))).where(F.col("__r") <= 2)
        firsts = firsts.groupBy(*cell).agg(F.max(F.when(F.col("__r") == 1, F.struct(F.col(author).alias("a"), F.col(f"first.{key}").alias("k")))).alias("f1"), F.max(F.when(F.col("__r") == 2, F.struct(F.col(author).alias("a"), F.col(f"first.{key}").alias("k")))).alias("f2"))
        j = d.withColumn("__o", other)
        j = j.join(F.broadcast(firsts), cell, "left") if cell else j.crossJoin(F.broadcast(firsts))  # a row a cell; cells are sources x genres
        back = F.when(F.col("f1.a") != F.col(author), F.col("f1.k")).otherwise(F.col("f2.k"))
        known = F.lit(True)
        for c in cell:  # a null source or genre is like no other
            known &= F.col(c).isNotNull()
        found.append(j.select(key, F.when(known, F.when(F.size("__o") > 0, F.col("__o")[0]["k"]).otherwise(back)).alias(f"n{i + 1}")))
    out = found[0]
    for f in found[1:]:
        out = out.join(f, key)
    names = [F.col(f"n{i}") for i in range(1, 5)]
    level = F.when(names[0].isNotNull(), 1).when(names[1].isNotNull(), 2).when(names[2].isNotNull(), 3).otherwise(4)
    return out.select(F.col(key).alias("anchor"), F.coalesce(*names).alias("negative"), level.alias("level")).where("negative is not null")


def episode_size(u: Column, most: int) -> Column:
    """Episode length from a uniform number by the inverse of Beta(3, 1)."""
    return F.greatest(F.lit(1), F.ceil(F.pow(u, F.lit(1.0 / 3.0)) * most)).cast("int")


def info_nce(scored: DataFrame, temperature: float = 0.07) -> DataFrame:
    """One row: mean over queries of the negative log share of the positives' exponentiated scores among all."""
    e = F.exp(F.col("score") / F.lit(temperature))
    q = scored.groupBy("query_id").agg(F.sum(F.when(F.col("positive"), e)).alias("p"), F.sum(e).alias("t")).where("p is not null")
    return q.agg(F.count(F.lit(1)).alias("n_queries"), F.avg(-F.log(F.col("p") / F.col("t"))).alias("loss"))


def triplet(df: DataFrame, positive: str, negative: str, margin: float = 0.2) -> Column:
    return F.greatest(F.lit(0.0), F.col(negative) - F.col(positive) + F.lit(margin))
