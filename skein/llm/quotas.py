"""Problem 5: a sample that matches target proportions, by controlled rounding and exact random-key quotas.

Cells are language x (genre, length bucket). The fractional quotas are raised to the cells' minima, held to what there
is, and scaled so that they add up to the sample; the two-way table is then rounded by a maximum flow that gives every
cell, every row total and every column total one of its two neighbouring integers. Each cell takes its quota's smallest
random keys: a histogram of key ranges finds the range that holds the last one, so only that range is ranked.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stash
from .labels import language_code

#: Targets are a table of wishes; more cells than this are refused, which bounds what the driver holds and broadcasts.
MOST_CELLS = 10_000
RANGES = 4096


def primary_genre(genre: Column) -> Column:
    """The part before the first slash, lower case, _ for spaces; null for a missing or blank one."""
    c = F.regexp_replace(F.trim(F.substring_index(F.lower(F.trim(genre)), "/", 1)), " ", "_")
    return F.when(c != "", c)


def bucket_name(bucket: Column) -> Column:
    c = F.regexp_replace(F.lower(F.trim(bucket)), "-", "_")
    return F.when(c != "", c)


def in_cells(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, genre, length_bucket) with the cell's canonical names; rows that are in no cell are left out."""
    made = docs.select(F.col("doc_id").cast("string"), language_code(F.col("lang")).alias("lang"), primary_genre(F.col("genre")).alias("genre"), bucket_name(F.col("length_bucket")).alias("length_bucket"))
    return made.where("lang is not null and genre is not null and length_bucket is not null")


def fractional(wanted: list[float], least: list[float], there: list[int], total: int) -> list[float]:
    """Quotas between min(least, there) and there, in proportion to ``wanted`` otherwise, that add up to ``total`` as
    far as the bounds allow."""
    low = [float(min(m, a)) for m, a in zip(least, there)]

    def at(scale: float) -> list[float]:
        return [min(max(w * scale, b), float(a)) for w, b, a in zip(wanted, low, there)]

    lo, hi = 0.0, 1.0
    while sum(at(hi)) < total and hi < 1e12:
        hi *= 2
    if sum(at(hi)) <= total:
        return at(hi)
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(at(mid)) < total else (lo, mid)
    return at(hi)


def controlled_rounding(cells: dict[tuple, float]) -> dict[tuple, int]:
    """Integers for a table keyed by (row, column): each cell, row total, column total and the grand total become the
    floor or the ceiling of the fractional one. A maximum flow over the fractions with lower bounds on the totals."""
    whole = {k: math.floor(v + 1e-9) for k, v in cells.items()}
    part = {k: max(0.0, v - whole[k]) for k, v in cells.items()}
    part = {k: (0.0 if v < 1e-7 else v) for k, v in part.items()}
    rows, cols = {}, {}
    for (r, c), v in part.items():
        rows[r] = rows.get(r, 0.0) + v
        cols[c] = cols.get(c, 0.0) + v
    graph: dict = {}

    def edge(a, b, cap: int) -> None:
        if cap > 0:
            graph.setdefault(a, {})[b] = graph.setdefault(a, {}).get(b, 0) + cap
            graph.setdefault(b, {}).setdefault(a, 0)

    floor, ceil = (lambda v: math.floor(v + 1e-6)), (lambda v: math.ceil(v - 1e-6))
    total = sum(part.values())
    demand: dict = {}

    def bounded(a, b, lo: int, hi: int) -> None:
        edge(a, b, hi - lo)
        demand[b] = demand.get(b, 0) + lo
        demand[a] = demand.get(a, 0) - lo

    for r, v in rows.items():
        bounded("s", ("r", r), floor(v), ceil(v))
    for (r, c), v in part.items():
        if v > 0:
            edge(("r", r), ("c", c), 1)
    for c, v in cols.items():
        bounded(("c", c), "t", floor(v), ceil(v))
    bounded("t", "s", floor(total + 0.5), floor(total + 0.5))
    need = 0
    for node, d in demand.items():
        edge("S", node, d)
        edge(node, "T", -d)
        need += max(d, 0)
    if need != _max_flow(graph, "S", "T"):
        raise ArithmeticError("no controlled rounding found")
    return {(r, c): whole[r, c] + (1 if part[r, c] > 0 and graph[("c", c)].get(("r", r), 0) > 0 else 0) for r, c in cells}


def _max_flow(graph: dict, s, t) -> int:
    flow = 0
    while True:
        back = {s: None}
        todo = deque([s])
        while todo and t not in back:
            a = todo.popleft()
            for b, cap in graph.get(a, {}).items():
                if cap > 0 and b not in back:
                    back[b] = a
                    todo.append(b)
        if t not in back:
            return flow
        b = t
        step = min(graph[a][b] for a, b in _path(back, t))
        for a, b in _path(back, t):
            graph[a][b] -= step
            graph[b][a] += step
        flow += step


def _path(back: dict, t) -> list[tuple]:
    out = []
    while back[t] is not None:
        out.append((back[t], t))
        t = back[t]
    return out


def cell_report(docs: DataFrame, targets: DataFrame, part: int = 10) -> DataFrame:
    """One row for each target cell: lang, genre, length_bucket, n_docs, wanted (share of the sample, rounded down, or
    the minimum if that is larger), quota (after controlled rounding), short (fewer documents than wanted).

    The sample is a ``part``-th of all rows of ``docs``, rows in no cell included. An empty table makes every cell with
    a minimum short.
    """
    counts = in_cells(docs).groupBy("lang", "genre", "length_bucket").agg(F.count(F.lit(1)).alias("n_docs"))
    goals = targets.groupBy("lang", "genre", "length_bucket").agg(F.sum("share_ppm").alias("share_ppm"), F.max("min_docs").alias("min_docs"))
    rows = goals.join(counts, ["lang", "genre", "length_bucket"], "left").limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} target cells")
    n = docs.count() // part
    rows.sort(key=lambda r: (str(r.lang), str(r.genre), str(r.length_bucket)))
    least = [r.min_docs or 0 for r in rows]
    wanted = [(r.share_ppm or 0) * n / 1e6 for r in rows]
    there = [r.n_docs or 0 for r in rows]
    exact = fractional(wanted, least, there, n)
    whole = controlled_rounding({(r.lang, (r.genre, r.length_bucket)): v for r, v in zip(rows, exact)})
    out = []
    for r, m, a in zip(rows, least, there):
        goal = max(m, (r.share_ppm or 0) * n // 1_000_000)
        out.append((r.lang, r.genre, r.length_bucket, a, goal, min(whole[r.lang, (r.genre, r.length_bucket)], a), a < goal))
    return docs.sparkSession.createDataFrame(out, "lang string, genre string, length_bucket string, n_docs bigint, wanted bigint, quota bigint, short boolean")


def sample(docs: DataFrame, targets: DataFrame, part: int = 10, seed: int = 7) -> DataFrame:
    """(doc_id, lang, genre, length_bucket): exactly the quota of each cell, uniformly at random by key. Documents of
    equal key are told apart by doc_id."""
    report = cell_report(docs, targets, part).where("quota > 0").select("lang", "genre", "length_bucket", "quota")
    cell = ["lang", "genre", "length_bucket"]
    keyed = in_cells(docs).withColumn("u", F.xxhash64("doc_id", F.lit(seed))).withColumn("band", F.pmod(F.shiftrightunsigned("u", 52), F.lit(RANGES)).cast("int"))
    keyed = stash(keyed.join(F.broadcast(report.select(*cell)), cell, "left_semi"), "keyed")
    bands = keyed.groupBy(*cell, "band").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(report), cell)
    upto = F.sum("n").over(W.partitionBy(*cell).orderBy("band"))
    last = bands.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n")).where("before < quota and upto >= quota")
    last = F.broadcast(last.select(*cell, F.col("band").alias("last"), (F.col("quota") - F.col("before")).alias("more")))  # a row a cell
    near = keyed.join(last, cell)
    rank = F.row_number().over(W.partitionBy(*cell).orderBy("u", "doc_id"))
    edge = near.where("band = last").withColumn("rank", rank).where("rank <= more")
    return near.where("band < last").select("doc_id", *cell).unionByName(edge.select("doc_id", *cell))
