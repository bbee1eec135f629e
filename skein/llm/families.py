"""Problem 2: splits that keep related records together, over an incremental persisted component table.

Records are related by author id, by raw document within source and by reported author links. The link keys of the
records are the nodes of a graph. The component table persists each key's component and, for each batch, the merges of
components that the batch brings: a parent table, whose chains over the batches are flattened by pointer jumping. Only
components that a batch touches enter the graph of that batch (components.py). A component that has a split keeps it;
one that touches several splits, by delivered records or by a merge, is quarantined; new components fill the splits'
deficits, the large ones by greatest deficit, the small ones in hash order by running sums against the deficits left, so
each split's share is met to within half a small component.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.skew import hot_keys, split_join
from ..session import stash, workdir
from .components import components
from .store import read_state, write_state

SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}
#: A component is large when it holds more than 1 / LARGE_PARTS of the records: there are fewer than LARGE_PARTS such.
LARGE_PARTS = 1000
#: Ranges of the hash order whose sums the driver adds up.
RANGES = 4096


def plain_id(c: str | F.Column) -> F.Column:
    """Ids and names are compared without case and outer blanks; a blank one is none."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(c != "", c)


def _number(rows: DataFrame, key: str, ids: DataFrame, total: int, name: str) -> DataFrame:
    """Replace the string key by its number; null stays null."""
    known = split_join(rows.where(F.col(key).isNotNull()), ids.toDF(key, name), key, hot_keys(rows, key, total)).drop(key)
    return known.unionByName(rows.where(F.col(key).isNull()).drop(key).withColumn(name, F.lit(None).cast("bigint")))


class ComponentTable:
    """Link keys, their components and the components' splits, kept between batches of records.

    Folders under ``path``, each written once: keys (link_key, id), merges (node, root: which component a key or an older
    component belongs to) and splits (component, n, split, status), one for each round; a state file names the rounds and
    is replaced last, so a batch that fails leaves the table as it was. Opening a path continues its table.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{workdir(spark)}/skein/components-{uuid.uuid4().hex}"
        self.state = read_state(spark, f"{self.path}/table.json") or {"rounds": 0, "next": 0, "batches": [], "splits": None}

    def _read(self, name: str, schema: str, rounds: list[int]) -> DataFrame:
        folders = [f"{self.path}/{name}/{k}" for k in rounds]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/{number}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/{number}")

    def keys(self) -> DataFrame:
        return self._read("keys", "link_key string, id bigint", list(range(self.state["rounds"])))

    def merges(self) -> DataFrame:
        """(node, root): the component that each merged key or component belongs to now. A node is merged once, into a
        root of its round, which a later round may merge again: pointer jumping halves these chains."""
        parent = self._read("merges", "node bigint, root bigint", list(range(self.state["rounds"])))
        if self.state["rounds"] < 2:
            return parent
        total = parent.count()
        while True:
            parent = stash(parent, "parents")
            top = parent.toDF("root", "over")
            hot = hot_keys(parent, "root", total)
            moved = parent.join(top.select("root"), "root", "left_semi").limit(1).count()
            if not moved:
                return parent
            up = split_join(parent, top, "root", hot).select("node", F.col("over").alias("root"))
            parent = up.unionByName(parent.join(top.select("root"), "root", "left_anti").select("node", "root"))

    def add(self, docs: DataFrame, links: DataFrame, delivered: DataFrame | None = None, shares: dict[str, float] | None = None, batch: str | None = None, seed: int = 7) -> DataFrame:
        """Add a batch of records; returns (doc_id, family, group_doc_id) of it. family is the component's number now,
        group_doc_id the smallest doc_id of the batch in it. With ``shares`` the components also get their splits.

        ``docs`` has doc_id, author_id, source, raw_id; ``links`` has author_id_a, author_id_b (repeated, reversed and
        self pairs and ids without documents are fine). A document without author id, source or raw id is related to
        none by that key; one without any key is its own family. A batch whose name is known changes nothing.
        """
        number = self.state["rounds"]
        again = batch is not None and batch in self.state["batches"]
        raw = F.substring_index("raw_id", "#", 1)
        d = docs.select(
            F.col("doc_id").cast("string"),
            F.concat(F.lit("a:"), plain_id("author_id")).alias("ak"),
            F.concat(F.lit("r:"), plain_id("source"), F.lit("|"), raw).alias("rk"),
        )
        d = stash(d, "keys")
        pairs = links.select(F.concat(F.lit("a:"), plain_id("author_id_a")).alias("x"), F.concat(F.lit("a:"), plain_id("author_id_b")).alias("y")).where("x is not null and y is not null")
        names = d.select(F.col("ak").alias("link_key")).union(d.select("rk")).union(pairs.select("x")).union(pairs.select("y")).where("link_key is not null").distinct()
        if number:
            names = stash(names, "names")
            known = self.keys().join(names, "link_key", "left_semi").join(self.merges().toDF("id", "root"), "id", "left").select("link_key", F.coalesce("root", "id").alias("id"))
            fresh = names.join(self.keys(), "link_key", "left_anti")
        else:
            known, fresh = None, names
        if not again:
            fresh = self._write(fresh.withColumn("id", F.monotonically_increasing_id() + F.lit(self.state["next"])), "keys", number)
            ids = fresh if known is None else stash(known.unionByName(fresh), "ids")
        else:
            ids = stash(known, "ids")
        total = d.count()
        d = stash(_number(_number(d, "ak", ids, total, "a"), "rk", ids, total, "r"), "numbered")
        edges = d.select("a", "r").where("a is not null and r is not null").toDF("a", "b").distinct()
        linked = pairs.join(ids.toDF("x", "a"), "x").join(ids.toDF("y", "b"), "y").select("a", "b")
        roots = components(edges.unionByName(linked)).toDF("node", "root").where("node <> root")
        if not again:
            roots = self._write(roots, "merges", number)
            top = fresh.agg(F.max("id").alias("n")).first().n
            self.state |= {"rounds": number + 1, "next": self.state["next"] if top is None else top + 1}
        d = d.select("doc_id", F.coalesce("r", "a").alias("node"))
        alone = d.where("node is null").select("doc_id", F.concat(F.lit("d:"), F.col("doc_id")).alias("family"))
        some = d.where("node is not null")
        # nodes outside all edges are their own roots
        roots = roots.unionByName(some.select("node").distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
        rooted = split_join(some, roots, "node", hot_keys(some, "node", total)).select("doc_id", F.col("root").cast("string").alias("family"))
        placed = stash(rooted.unionByName(alone), "families")
        first = placed.groupBy("family").agg(F.min("doc_id").alias("group_doc_id"))
        grouped = stash(split_join(placed, first, "family", hot_keys(placed, "family", total)).select("doc_id", "family", "group_doc_id"), "grouped")
        if not again:
            if shares is not None:
                self._settle(grouped, delivered, shares, seed)
            if batch is not None:
                self.state["batches"] = [*self.state["batches"], batch]
            write_state(self.spark, f"{self.path}/table.json", self.state)
        return grouped

    def splits(self) -> DataFrame:
        """(family, n, split, status) of every component that has been given a split or quarantined, by its number now."""
        was = self._read("splits", "family string, n bigint, split string, status string", [] if self.state["splits"] is None else [self.state["splits"]])
        return was

    def _settle(self, grouped: DataFrame, delivered: DataFrame | None, shares: dict[str, float], seed: int) -> None:
        sizes = _sized(grouped, delivered)
        was = self.splits().join(self.merges().select(F.col("node").cast("string").alias("family"), "root"), "family", "left")
        was = was.select(F.coalesce(F.col("root").cast("string"), "family").alias("family"), "n", F.col("split").alias("lo"), F.col("split").alias("hi"), (F.col("status") == "quarantined").alias("held"))
        both = was.unionByName(sizes.withColumn("held", F.lit(False)))
        both = both.groupBy("family").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("held").alias("held"))
        filled = _filled(both, shares, seed).select("family", "n", "split", "status")
        number = self.state["rounds"] - 1
        self._write(filled, "splits", number)
        self.state["splits"] = number


def families(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, family, group_doc_id) of every document, by a component table of its own (see ComponentTable.add)."""
    return ComponentTable(docs.sparkSession).add(docs, links)


def torn(grouped: DataFrame, split: DataFrame) -> DataFrame:
    """(group_doc_id, split): each split that a family in more than one split touches. Records delivered several times
    count once; rows without split or of unknown documents are ignored."""
    at = split.select(F.col("doc_id").cast("string"), "split").where("split is not null").distinct()
    touched = grouped.select("doc_id", "group_doc_id").join(at, "doc_id").select("group_doc_id", "split").distinct()
    many = touched.groupBy("group_doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return touched.join(many, "group_doc_id", "left_semi").select("group_doc_id", "split")


def _sized(grouped: DataFrame, delivered: DataFrame | None) -> DataFrame:
    """(family, n, lo, hi): size, smallest and greatest delivered split."""
    sizes = grouped.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    if delivered is None:
        return sizes.withColumns({"lo": F.lit(None).cast("string"), "hi": F.lit(None).cast("string")})
    at = delivered.select(F.col("doc_id").cast("string"), "split").where("split is not null").distinct()
    was = grouped.select("doc_id", "family").join(at, "doc_id").groupBy("family").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    return sizes.join(was, "family", "left")


def _filled(sizes: DataFrame, shares: dict[str, float], seed: int) -> DataFrame:
    """(family, n, split, status) of (family, n, lo, hi, held). Driver memory: LARGE_PARTS rows, RANGES sums."""
    if not shares or any(v < 0 for v in shares.values()) or abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must be non-negative and add up to 1")
    status = F.when(F.col("held") | (F.col("lo") != F.col("hi")), "quarantined").when(F.col("lo").isNull(), "new").otherwise("kept")
    sizes = sizes.select("family", "n", status.alias("status"), F.when(status == "kept", F.col("lo")).alias("split"), F.xxhash64("family", F.lit(seed)).alias("u"))
    sizes = stash(sizes, "sizes")
    sums = {(r.status, r.split): r.n for r in sizes.groupBy("status", "split").agg(F.sum("n").alias("n")).collect()}
    total = sum(n for (s, _), n in sums.items() if s != "quarantined")
    deficit = {k: v * total - sums.get(("kept", k), 0) for k, v in shares.items()}
    fresh = sizes.where("status = 'new'")
    is_large = F.col("n") > max(total // LARGE_PARTS, 1)
    chosen = []
    for r in sorted(fresh.where(is_large).select("family", "n").collect(), key=lambda r: (-r.n, r.family)):  # under LARGE_PARTS rows
        k = max(deficit, key=lambda k: (deficit[k], k))
        deficit[k] -= r.n
        chosen.append((r.family, k))
    spark = sizes.sparkSession
    large = fresh.where(is_large).join(F.broadcast(spark.createDataFrame(chosen, "family string, picked string")), "family").select("family", "n", F.col("picked").alias("split"), "status")
    # the small ones in hash order: a component's middle on the running sum falls into the room of one split
    small = fresh.where(~is_large).withColumn("range", F.pmod(F.shiftrightunsigned("u", 52), F.lit(RANGES)).cast("int"))
    reached, starts = 0, []
    for r in sorted(small.groupBy("range").agg(F.sum("n").alias("n")).collect()):
        starts.append((r.range, reached))
        reached += r.n
    room = {k: max(v, 0.0) for k, v in deficit.items()}
    scale = reached / sum(room.values()) if sum(room.values()) else 0.0
    before = F.sum("n").over(W.partitionBy("range").orderBy(F.col("u").bitwiseAND((1 << 52) - 1), "family").rowsBetween(W.unboundedPreceding, -1))
    middle = F.col("start") + F.coalesce(before, F.lit(0)) + F.col("n") / 2
    fill, edge = F.lit(None).cast("string"), 0.0
    for k, v in room.items():
        edge += v * scale
        fill = F.coalesce(fill, F.when(F.col("middle") < edge, F.lit(k)))
    fill = F.coalesce(fill, F.lit(max(room, key=lambda k: (room[k], shares[k]))))
    ordered = small.join(F.broadcast(spark.createDataFrame(starts, "range int, start bigint")), "range").withColumn("middle", middle)
    small = ordered.select("family", "n", fill.alias("split"), "status")
    return sizes.where("status <> 'new'").select("family", "n", "split", "status").unionByName(large).unionByName(small)


def assign(grouped: DataFrame, delivered: DataFrame | None = None, shares: dict[str, float] | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, group_doc_id, split, status): every document of a family in one split.

    status is kept (the family's only delivered split), new, or quarantined (the family is delivered in several splits;
    split is null). Shares count documents outside quarantine.
    """
    filled = _filled(_sized(grouped, delivered).withColumn("held", F.lit(False)), shares or SHARES, seed)
    return with_splits(grouped, stash(filled, "filled"))


def with_splits(grouped: DataFrame, splits: DataFrame) -> DataFrame:
    """(doc_id, group_doc_id, split, status) of records by their families' splits."""
    hot = hot_keys(grouped, "family", grouped.count())
    return split_join(grouped, splits.select("family", "split", "status"), "family", hot).select("doc_id", "group_doc_id", "split", "status")


def in_batches(docs: DataFrame, links: DataFrame, delivered: DataFrame, shares: dict[str, float] | None = None, batches: int = 2) -> DataFrame:
    """As ``assign``, but the records come in so many batches through a persisted table that is opened again for each:
    (doc_id, group_doc_id, split, status) after the last one. A component keeps the split that an earlier batch gave it;
    status is new only for components of the last batch."""
    spark = docs.sparkSession
    table = ComponentTable(spark)
    for i in range(batches):
        mine = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i)
        ComponentTable(spark, table.path).add(mine, links, delivered, shares or SHARES, f"batch {i} of {batches}")
    table = ComponentTable(spark, table.path)
    return with_splits(table.add(docs, links, batch=f"batch {batches - 1} of {batches}"), table.splits())


def shares_reached(assigned: DataFrame) -> DataFrame:
    """(split, status, n_docs, n_groups): what each split got, quarantine included."""
    parts = assigned.groupBy("split", "status", "group_doc_id").agg(F.count(F.lit(1)).alias("n"))
    return parts.groupBy("split", "status").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_groups"))
