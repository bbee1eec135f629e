"""Connected components by hooking to the smallest neighbour, pointer jumping and edge contraction.

Each round every node hooks to its smallest neighbour, the parent forest is flattened by pointer jumping, and the
edges are rewritten to roots; edges inside a tree vanish. The edge table shrinks by at least half of its nodes each
round, so the number of rounds is logarithmic. Every round is a written table: a lost executor costs one round.
Nothing is collected but row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import hot_keys, split_join
from ..session import release, stash


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b: bigint); root is the smallest node of the component.

    Null ends and self pairs are ignored, except that a self pair's node is its own component; repeated and reversed
    pairs count once. An empty table gives an empty result. A node with a third of all edges is met by a broadcast of
    its parent (see split_join), so no task gets its edges together.
    """
    e = edges.select("a", "b").where("a is not null and b is not null")
    nodes_alone = e.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    e = stash(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = held = None  # held: the table that labels reads
    left = e.count()
    while left:
        ends = e.union(e.select("b", "a"))
        parent = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        parent = written = stash(parent, "parents")
        while True:  # pointer jumping: each pass halves the depth
            hot = hot_keys(parent, "up", left)
            top = parent.select(F.col("node").alias("up"), F.col("up").alias("up2"))
            jumped = stash(split_join(parent, top, "up", hot).select("node", F.col("up2").alias("up"), (F.col("up") != F.col("up2")).alias("moved")), "jumped")
            release(written)
            written, parent = jumped, jumped.select("node", "up")
            if not jumped.where("moved").limit(1).count():
                break
        left_end = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        right_end = parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        e1 = split_join(e, left_end, "a", hot_keys(e, "a", left)).select("ra", "b")
        e2 = split_join(e1, right_end, "b", hot_keys(e, "b", left)).select("ra", "rb").where("ra <> rb")
        after = stash(e2.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        release(e)
        e, left = after, after.count()
        if labels is None:
            labels, held = parent.select("node", F.col("up").alias("root")), written
        else:
            old = labels.select("node", F.col("root").alias("key"))
            named = parent.select(F.col("node").alias("key"), F.col("up").alias("to"))
            labels = stash(old.join(named, "key", "left").select("node", F.coalesce("to", "key").alias("root")), "labels")
            release(held, written)
            held = labels
    if labels is None:
        return nodes_alone.distinct()
    return labels.unionByName(nodes_alone.distinct().join(labels, "node", "left_anti"))
