"""Splitting into train, dev and test, and retrieval tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import shuffle_key
from ..plans.skew import in_order
from ..session import stash

RATIOS = {"train": 0.8, "dev": 0.1, "test": 0.1}


def split_counts(n, ratios: dict[str, float] = RATIOS) -> dict:
    """Columns with the number of each split's rows among ``n``: floors, then one each by largest remainder; equal
    remainders go to the earlier split. The counts add up to ``n``."""
    names = list(ratios)
    exact = {k: n * F.lit(ratios[k]) for k in names}
    floor = {k: F.floor(exact[k] + F.lit(1e-9)) for k in names}
    rest = n - sum((floor[k] for k in names), F.lit(0))
    left = {k: F.round(exact[k] - floor[k], 9) for k in names}
    out = {}
    for i, k in enumerate(names):
        ahead = sum((((left[j] > left[k]) | ((left[j] == left[k]) & F.lit(m < i))).cast("int") for m, j in enumerate(names) if j != k), F.lit(0))
        out[k] = (floor[k] + (ahead < rest).cast("int")).cast("bigint")
    return out


def stratified(df: DataFrame, by: list[str], key: str, seed: int, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """A split for each document, in proportion within every stratum."""
    r = in_order(df, by, shuffle_key(seed, F.col(key)), key, "__r", "__n")
    sizes = split_counts(F.col("__n"), ratios)
    split, upto = F.lit(None).cast("string"), F.lit(0)
    for k in ratios:
        upto = upto + sizes[k]
        split = F.coalesce(split, F.when(F.col("__r") <= upto, F.lit(k)))
    return r.withColumn("split", split).drop("__r", "__n")


#: An author is large when it has more than 1 / LARGE_PARTS of a language's documents: fewer than LARGE_PARTS each.
LARGE_PARTS = 1000


def author_aware(df: DataFrame, author: str, lang: str, ratios: dict[str, float] = RATIOS, seed: int = 42) -> DataFrame:
    """(author, dominant language, n_docs, split): each author whole in one split, each language in proportion.

    The few large authors of a language are planned first, largest first, each into the split with most room left. The
    small ones stand in hash order on a line as long as their documents; the line is cut in proportion to the room left,
    and an author belongs to the split in whose stretch its middle lies. So no task sees all authors of a language, and
    a split misses its share by half a small author at most unless a large one exceeds it."""
    c = df.where(F.col(author).isNotNull()).groupBy(author, lang).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy(author).orderBy(F.desc("n"), F.asc_nulls_last(lang)))
    total = F.sum("n").over(W.partitionBy(author))
    a = c.select(F.col(author).alias("author"), F.coalesce(lang, F.lit("")).alias("lang"), total.alias("n_docs"), first.alias("r")).where("r = 1").drop("r")
    a = stash(a.withColumn("u", F.pmod(F.xxhash64("author", F.lit(seed)), F.lit(1 << 40))), "authors")
    sums = a.groupBy("lang").agg(F.sum("n_docs").alias("all"))
    a = a.join(F.broadcast(sums), "lang").withColumn("large", F.col("n_docs") > F.greatest(F.col("all") / F.lit(LARGE_PARTS), F.lit(1)))  # a row a language
    room = {(r.lang, k): v * r.all for r in sums.collect() for k, v in ratios.items()}
    planned = []
    for r in sorted(a.where("large").select("lang", "author", "n_docs").collect(), key=lambda r: (r.lang, -r.n_docs, r.author)):
        k = max(ratios, key=lambda k: room[r.lang, k])
        room[r.lang, k] -= r.n_docs
        planned.append((r.author, k))
    spark = df.sparkSession
    large = a.join(F.broadcast(spark.createDataFrame(planned, "author string, split string")), "author")
    small = a.where("not large").withColumn("range", F.shiftright("u", 28).cast("int"))
    w = W.partitionBy("lang")
    ranges = small.groupBy("lang", "range").agg(F.sum("n_docs").alias("c")).withColumns({"start": F.sum("c").over(w.orderBy("range")) - F.col("c"), "whole": F.sum("c").over(w)}).drop("c")
    before = F.sum("n_docs").over(W.partitionBy("lang", "range").orderBy("u", "author")) - F.col("n_docs")
    line = small.join(ranges, ["lang", "range"]).withColumn("middle", (F.col("start") + before + F.col("n_docs") / 2) / F.col("whole"))
    edges = []
    for x in {x for x, _ in room}:
        left = {k: max(room[x, k], 0.0) for k in ratios}
        left = {k: v for k, v in left.items() if v > 0} or {max(ratios, key=lambda k: ratios[k]): 1.0}
        whole, upto = sum(left.values()), 0.0
        for i, (k, v) in enumerate(left.items()):
            edges.append((x, k, upto / whole if i else -1.0, (upto + v) / whole if i < len(left) - 1 else 2.0))
            upto += v
    cut = F.broadcast(spark.createDataFrame(edges, "lang string, split string, low double, high double"))
    hit = line.join(cut, "lang").where("middle > low and middle <= high")
    return large.select("author", "lang", "n_docs", "split").unionByName(hit.select("author", "lang", "n_docs", "split"))


def _grouped(df: DataFrame, author: str, by: list[str] | None) -> tuple[DataFrame, list[str]]:
    """The rows with an author, and one column that names the author and its ``by`` columns."""
    group = [*(by or []), author]
    return df.where(F.col(author).isNotNull()).withColumn("__group", F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in group])), group


def retrieval_roles(df: DataFrame, author: str, key: str, seed: int, by: list[str] | None = None) -> DataFrame:
    """candidate or query for each document by its author's number n: 1 none, 2 one each, 3 two candidates and a query,
    4 and more two each; the rest is dropped. ``by`` adds columns to the author, e.g. the split. The rank is cut at four
    before the shuffle, and only then does the number of documents join."""
    rows, _ = _grouped(df, author, by)
    n = rows.groupBy("__group").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    rank = F.row_number().over(W.partitionBy("__group").orderBy(shuffle_key(seed, F.col(key)), key))
    r = rows.withColumn("__i", rank).where("__i <= 4").join(n, "__group")
    candidates = F.when(F.col("__n") == 2, 1).otherwise(2)
    role = F.when(F.col("__i") <= candidates, "candidate").when(F.col("__i") <= candidates + F.when(F.col("__n") >= 4, 2).otherwise(1), "query")
    return r.withColumn("retrieval_role", role).where("retrieval_role is not null").select(*df.columns, "retrieval_role")


def keep_all_roles(df: DataFrame, author: str, key: str, seed: int, by: list[str] | None = None) -> DataFrame:
    """Every document gets a role: the first half, rounded up, of an author's documents are candidates."""
    rows, group = _grouped(df, author, by)
    r = in_order(rows, ["__group"], shuffle_key(seed, F.col(key)), key, "__i", "__n")
    return r.select(*df.columns, F.when(F.col("__i") <= F.ceil(F.col("__n") / 2), "candidate").otherwise("query").alias("retrieval_role"))


def ground_truth(roles: DataFrame, author: str, key: str, by: list[str] | None = None) -> DataFrame:
    """(query_id, positive_ids, author): with ``retrieval_roles`` an author has at most two candidates in a split."""
    group = [*(by or []), author]
    c = roles.where("retrieval_role = 'candidate'").groupBy(*group).agg(F.sort_array(F.collect_list(key)).alias("positive_ids"))
    q = roles.where("retrieval_role = 'query'").select(F.col(key).alias("query_id"), *group)
    return q.join(c, group).select("query_id", "positive_ids", author, *(by or []))


def position_ids(df: DataFrame, order: list[str], prefix: str = "doc") -> DataFrame:
    """``prefix_000000`` by place in ``order``. Rows are range-partitioned and sorted, each partition counted, and the
    offsets (one number a partition) added: no task sees all rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id())
    placed = stash(placed, "ranges")
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    offsets = F.broadcast(sizes.select("__p", (F.sum("n").over(W.partitionBy().orderBy("__p")) - F.col("n")).alias("__o")))  # a row a partition
    rank = F.row_number().over(W.partitionBy("__p").orderBy(*order))
    at = placed.join(offsets, "__p").withColumn("__i", rank + F.col("__o") - 1)
    return at.withColumn("new_id", F.format_string(f"{prefix}_%06d", "__i")).drop("__p", "__o", "__i")
