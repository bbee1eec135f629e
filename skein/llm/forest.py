"""The LSH forest of problems 1 and 6: sorted prefix tries of signatures with prefixes of adaptive length.

A path of DEPTH components is packed into two numbers whose order is the order of the trie: ``head`` holds the tree and
the first components, ``tail`` the others. Rows are partitioned by a prefix and sorted by path, so the records below a
trie node are one run of neighbours; a run gives its pairs as it is read. A run of more than CROWD records is no bucket:
its rows are passed on to the next longer prefix, down to the whole path. A record that is matched at longer prefixes in
some trees has a lower chance of being found. Its chance at the threshold s is 1 - prod (1 - s^depth) over its trees;
where it is under the target, the prefixes in its other trees are shortened as far as is needed, and if that is not
enough its crowded runs are matched in full. So crowding costs time, but no recall.

Rows with a negative head are fingerprints: they match as a whole only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, stash
from . import textkit as T

TREES, DEPTH = 32, 8
#: Bits of a component in head and tail, and the number of components in head. A component's chance of agreeing by
#: accident is 2^-11 or 2^-10, far under the similarity of unlike texts of one language.
HEAD_BITS, TAIL_BITS, IN_HEAD = 11, 10, 5
#: Records below a trie node from which on its prefix is lengthened; blocks of a run that is matched in full.
CROWD, BLOCKS = 256, 16
#: Bits of a row's tag: the number of substrings below, then the sides it is on (both unset: pairs within one table).
SIZE, LEFT, RIGHT = (1 << 28) - 1, 1 << 28, 1 << 29


def packed(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, tail) of the paths of a (texts, DEPTH, TREES) signature."""
    n = len(signature)
    mixed = T.mix(signature)
    head = np.broadcast_to(np.arange(TREES, dtype=np.uint64), (n, TREES)).copy()
    tail = np.zeros((n, TREES), np.uint64)
    for p in range(DEPTH):
        if p < IN_HEAD:
            head = (head << np.uint64(HEAD_BITS)) | (mixed[:, p] >> np.uint64(64 - HEAD_BITS))
        else:
            tail = (tail << np.uint64(TAIL_BITS)) | (mixed[:, p] >> np.uint64(64 - TAIL_BITS))
    return head.view(np.int64), tail.astype(np.int32)


def first_depth(threshold: float, target: float) -> int:
    """The longest prefix at which the forest finds the target share of pairs at the threshold."""
    return next((k for k in range(DEPTH, 1, -1) if 1 - (1 - threshold**k) ** TREES >= target), 1)


def _prefix(depth: int) -> list[Column]:
    if depth <= IN_HEAD:
        return [F.when(F.col("head") < 0, F.col("head")).otherwise(F.shiftright("head", HEAD_BITS * (IN_HEAD - depth)))]
    return [F.col("head"), F.shiftright("tail", TAIL_BITS * (DEPTH - depth))]


def _runs(depth: int, threshold: float, crowd: int):
    """Pairs of each run of equal prefixes; the rows of crowded runs as they are, without b."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("head", pa.int64()), ("tail", pa.int32()), ("tag", pa.int32())])

    def prefixes(head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if depth <= IN_HEAD:
            return np.where(head < 0, head, head >> (HEAD_BITS * (IN_HEAD - depth))), np.zeros(len(head), np.int32)
        return head, tail >> (TAIL_BITS * (DEPTH - depth))

    def rows(cols: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.nulls(len(cols[0]), pa.int64()), *(pa.array(c) for c in cols[1:])], schema=schema)

    def pairs(rid: np.ndarray, tag: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.arange(len(rid))
        for step in range(1, crowd):
            at = at[at + step < len(rid)]
            at = at[number[at + step] == number[at]]
            if not len(at):
                return
            i, j = at, at + step
            n, m = tag[i] & SIZE, tag[j] & SIZE
            ok = (rid[i] != rid[j]) & (np.minimum(n, m) >= threshold * np.maximum(n, m))  # the similarity is at most the ratio of sizes
            i, j = i[ok], j[ok]
            if len(tag) and tag[0] & (LEFT | RIGHT):
                there, back = (tag[i] & LEFT != 0) & (tag[j] & RIGHT != 0), (tag[j] & LEFT != 0) & (tag[i] & RIGHT != 0)
                a, b = np.concatenate((rid[i[there]], rid[j[back]])), np.concatenate((rid[j[there]], rid[i[back]]))
            else:
                a, b = np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])
            if len(a):
                empty = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *empty], schema=schema)

    def close(cols: list[np.ndarray], number: np.ndarray, force: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of whole runs, the first of them a crowded one's rest if ``force``."""
        if not len(number):
            return
        size = np.bincount(number)
        if force:
            size[0] = crowd + 1
        many = size[number] > crowd
        if many.any():
            yield rows([c[many] for c in cols])
        calm = ~many & (size[number] > 1)
        yield from pairs(cols[0][calm], cols[3][calm], number[calm])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
        open_crowd = None  # prefix of a crowded run whose first rows have been passed on
        for batch in batches:
            cols = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns)]
            if not len(cols[0]):
                continue
            x, y = prefixes(cols[1], cols[2])
            number = np.cumsum(np.concatenate(([False], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            last = int(np.searchsorted(number, number[-1]))
            force = open_crowd == (x[0], y[0])
            yield from close([c[:last] for c in cols], number[:last], force)
            crowded = len(number) - last > crowd or (force and last == 0)
            open_crowd = (x[-1], y[-1]) if crowded else None
            if crowded:
                yield rows([c[last:] for c in cols])
            held = [c[:0] if crowded else c[last:] for c in cols]
        yield from close(held, np.zeros(len(held[0]), np.int64), False)

    return run


def _level(paths: DataFrame, depth: int, threshold: float, crowd: int) -> DataFrame:
    sorted_ = paths.select("rid", "head", "tail", "tag").repartition(*_prefix(depth)).sortWithinPartitions("head", "tail")
    return stash(sorted_.mapInArrow(_runs(depth, threshold, crowd), "a bigint, b bigint, head bigint, tail int, tag int"), f"trie-{depth}")


def _joined(some: DataFrame, other: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """All pairs of rows of equal keys, in BLOCKS blocks of each key, so that no task has a whole key."""
    x = some.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(BLOCKS)).cast("int")).select(F.col("rid").alias("a"), F.col("tag").alias("ta"), "block", *keys)
    y = other.select(F.col("rid").alias("b"), F.col("tag").alias("tb"), F.explode(F.array(*map(F.lit, range(BLOCKS)))).alias("block"), *keys)
    n, m = F.col("ta").bitwiseAND(SIZE), F.col("tb").bitwiseAND(SIZE)
    met = x.join(y, ["block", *keys]).where((F.col("a") != F.col("b")) & (F.least(n, m) >= F.lit(threshold) * F.greatest(n, m)))
    there = (F.col("ta").bitwiseAND(LEFT) != 0) & (F.col("tb").bitwiseAND(RIGHT) != 0)
    back = (F.col("tb").bitwiseAND(LEFT) != 0) & (F.col("ta").bitwiseAND(RIGHT) != 0)
    one_table = F.col("ta").bitwiseAND(LEFT | RIGHT) == 0
    both = F.array(F.when(one_table, F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), F.when(there, F.struct("a", "b")), F.when(back, F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return met.select(F.explode(both).alias("p")).where("p is not null").select("p.a", "p.b")


def candidates(paths: DataFrame, threshold: float, target: float, crowd: int = CROWD) -> DataFrame:
    """Distinct pairs (a, b) of rids that share a prefix in any tree or a fingerprint. ``paths`` has rid, head, tail and
    tag; without sides a < b, else a is on the left and b on the right. A pair at the threshold is found with a
    probability of at least ``target``, whatever the crowding."""
    ship(paths.sparkSession)
    start = first_depth(threshold, target)
    found = _level(paths, start, threshold, crowd)
    pairs = found.where("b is not null").select("a", "b")
    rest = found.where("b is null").select(F.col("a").alias("rid"), "head", "tail", "tag")
    if not rest.limit(1).count():
        return pairs.distinct()
    pairs = pairs.unionByName(_joined(rest.where("head < 0"), rest.where("head < 0"), ["head"], threshold))
    crowded = rest = rest.where("head >= 0")
    missed = [math.log(1 - threshold**k) if k else 0.0 for k in range(DEPTH + 1)]
    lost = rest.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * (missed[start + 1] - missed[start]) if start < DEPTH else F.lit(0.0)).alias("more"))
    for depth in range(start + 1, DEPTH + 1):
        found = _level(rest, depth, threshold, crowd)
        pairs = pairs.unionByName(found.where("b is not null").select("a", "b"))
        rest = found.where("b is null").select(F.col("a").alias("rid"), "head", "tail", "tag")
        if depth < DEPTH:
            lost = lost.unionByName(rest.groupBy("rid").agg(F.lit(0).cast("bigint").alias("n"), (F.count(F.lit(1)) * (missed[depth + 1] - missed[depth])).alias("more")))
    pairs = pairs.unionByName(_joined(rest, rest, ["head", "tail"], threshold))
    # records whose chance fell under the target: the longest shorter prefix of their other trees that makes up for it
    log_miss = F.lit(TREES * missed[start]) + F.col("more")
    goal = math.log(1 - target)
    short = lost.groupBy("rid").agg(F.sum("n").alias("n"), F.sum("more").alias("more")).where(log_miss > goal)
    depth = F.coalesce(*(F.when(log_miss + (TREES - F.col("n")) * (missed[k] - missed[start]) <= goal, F.lit(k)) for k in range(start - 1, 0, -1)), F.lit(0))
    short = stash(short.select("rid", depth.alias("depth")), "short")
    for k in sorted(r.depth for r in short.select("depth").distinct().collect()):  # at most DEPTH numbers
        mine = short.where(F.col("depth") == k).select("rid")
        if k == 0:
            keyed = crowded.withColumns({f"key{i}": c for i, c in enumerate(_prefix(start))})
            pairs = pairs.unionByName(_joined(keyed.join(mine, "rid", "left_semi"), keyed, [c for c in keyed.columns if c.startswith("key")], threshold))
            continue
        keyed = paths.where("head >= 0").withColumn("key", _prefix(k)[0] if k <= IN_HEAD else F.xxhash64(*_prefix(k)))
        calm = keyed.join(mine, "rid", "left_semi").join(crowded.select("rid", "head"), ["rid", "head"], "left_anti")
        pairs = pairs.unionByName(_joined(calm, keyed, ["key"], threshold))
    return pairs.distinct()
