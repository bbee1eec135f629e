"""Problem 8: items into containers of fixed capacity, by matching large items and best-fitting the small ones.

Sizes are integers up to the capacity, so the packing is solved on the histogram of sizes: items over a third of the
capacity are matched, largest first with the largest partner that still fits, two to a container at most; smaller ones,
largest first, go into the tightest gap. The solution is a list of patterns with multiplicities, whose length depends
on the capacity and not on the number of items. A full piece is a container by itself. Each other item finds its
container from its rank among the items of its size; a size is ranked in hash parts of about PART items, so no task
ranks all items of one size, however many there are.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ship, stash
from .sizes import measured

CAPACITY, PART = 1024, 200_000


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (sizes in one container, number of such containers) for so many items of each size (1..capacity)."""
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    third = capacity // 3
    large = sorted(s for s in left if s > third)
    gaps: dict[int, list[list]] = {}
    open_gaps: list[int] = []

    def put(sizes: list[int], n: int) -> None:
        gap = capacity - sum(sizes)
        if gap not in gaps:
            gaps[gap] = []
            insort(open_gaps, gap)
        gaps[gap].append([sizes, n])

    while large:
        s = large[-1]
        k = bisect_left(large, capacity - s + 1) - 1
        if k < 0:  # no partner fits
            put([s], left.pop(s))
            large.pop()
            continue
        t = large[k]
        if t == s:
            pairs, odd = divmod(left.pop(s), 2)
            large.pop()
            if pairs:
                put([s, s], pairs)
            if odd:
                rest = [x for x in large if x <= capacity - s]
                if rest:
                    put([s, rest[-1]], 1)
                    left[rest[-1]] -= 1
                    if not left[rest[-1]]:
                        large.remove(rest[-1])
                        del left[rest[-1]]
                else:
                    put([s], 1)
            continue
        m = min(left[s], left[t])
        put([s, t], m)
        for x in (s, t):
            left[x] -= m
            if not left[x]:
                large.remove(x)
                del left[x]
    for s in sorted((s for s in left if s <= third), reverse=True):
        n = left[s]
        while n:
            k = bisect_left(open_gaps, s)
            if k == len(open_gaps):  # no gap is wide enough: new containers, each as full as it gets
                per = capacity // s
                whole, rest = divmod(n, per)
                if whole:
                    put([s] * per, whole)
                if rest:
                    put([s] * rest, 1)
                break
            gap = open_gaps[k]
            group = gaps[gap][-1]
            fit = max(1, min(gap // s, n // group[1])) if n >= group[1] else 1
            m = min(group[1], n // fit)
            group[1] -= m
            if not group[1]:
                gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    open_gaps.remove(gap)
            put([*group[0], *[s] * fit], m)
            n -= m * fit
    return [(sizes, n) for groups in gaps.values() for sizes, n in groups]


def _items(sized: DataFrame, capacity: int) -> DataFrame:
    """One row for each piece: full pieces of an oversized document, then its rest."""
    n = F.ceil(F.col("size") / F.lit(capacity)).cast("int")
    cut = sized.where("size > 0").withColumn("n_pieces", n).withColumn("piece_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select("doc_id", "piece_no", "n_pieces", (F.col("piece_no") * F.lit(capacity)).alias("first"), F.least(F.lit(capacity), F.col("size") - F.col("piece_no") * F.lit(capacity)).cast("int").alias("size"))


def containers(docs: DataFrame, measure: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece_no, n_pieces, first, size, container): every item in one container of at most ``capacity``.

    Only documents over the capacity have more than one piece; first is the piece's offset in units or tokens. Null
    and empty texts fill nothing and have no row. Equal documents are items of their own. Driver memory: the histogram
    (a number a size, and one for each PART items more) and the patterns.
    """
    ship(docs.sparkSession)
    items = stash(_items(measured(docs, measure), capacity), "items")
    counts = {r.size: r.n for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_full = counts.pop(capacity, 0)
    slots: dict[int, list[tuple[int, int]]] = {}
    used: dict[int, int] = {}
    first = n_full
    for sizes, n in pack(counts, capacity):
        for s in sizes:
            slots.setdefault(s, []).append((used.get(s, 0), first))
            used[s] = used.get(s, 0) + n
        first += n
    where = {s: (np.array([a for a, _ in v], np.int64), np.array([b for _, b in v], np.int64)) for s, v in slots.items()}
    n_parts = np.ones(capacity + 1, np.int64)
    for s, n in [*counts.items(), (capacity, n_full)]:
        n_parts[s] = max(1, -(-n // PART))
    spark = docs.sparkSession
    parts = F.broadcast(spark.createDataFrame([(s, int(n_parts[s])) for s in [*counts, capacity]], "size int, parts int"))  # a row a size
    parted = items.join(parts, "size").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("parts")).cast("int"))
    starts: dict[tuple[int, int], int] = {}
    begun: dict[int, int] = {}
    for r in sorted(parted.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r.size, r.part)):
        starts[r.size, r.part] = begun.get(r.size, 0)
        begun[r.size] = begun.get(r.size, 0) + r.n
    schema = pa.schema([("doc_id", pa.string()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("first", pa.int64()), ("size", pa.int32()), ("container", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, part, rank = (b.column(k).to_numpy() for k in (4, 5, 6))
            out = np.zeros(len(size), np.int64)
            order = np.lexsort((part, size))
            for group in np.split(order, np.flatnonzero((np.diff(size[order]) != 0) | (np.diff(part[order]) != 0)) + 1):
                if len(group):
                    s, at = int(size[group[0]]), rank[group] - 1 + starts[int(size[group[0]]), int(part[group[0]])]
                    if s == capacity:
                        out[group] = at
                        continue
                    begin, box = where[s]
                    k = np.searchsorted(begin, at, "right") - 1
                    out[group] = box[k] + at - begin[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out)], schema=schema)

    rank = F.row_number().over(W.partitionBy("size", "part").orderBy("doc_id", "piece_no")).cast("bigint")
    ranked = parted.select(F.col("doc_id").cast("string"), F.col("piece_no").cast("int"), F.col("n_pieces").cast("int"), F.col("first").cast("bigint"), F.col("size").cast("int"), "part", rank.alias("rank"))
    return ranked.mapInArrow(place, "doc_id string, piece_no int, n_pieces int, first bigint, size int, container bigint")


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(fill_percent, n_containers): how full the containers are, in steps of a tenth."""
    each = placed.groupBy("container").agg(F.sum("size").alias("used"))
    return each.groupBy((F.floor(F.col("used") * 10 / F.lit(capacity)) * 10).cast("int").alias("fill_percent")).agg(F.count(F.lit(1)).alias("n_containers"))
