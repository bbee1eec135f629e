"""Problem 9: sources mixed to target weights, by pivotal dependent rounding in a reduction tree.

A source that needs f copies of each document gives every document floor(f) copies and rounds the fraction by the
pivotal method: two fractions at a time, mass moves at random from one to the other until one is 0 or 1. Documents are
taken in order of size, so mass moves between documents of like size and the source's total size is kept almost
exactly. Leaves of the tree are (source, bucket) groups of about LEAF documents; each leaves at most one fraction, and
the fractions are combined FAN at a time.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stash
from .families import plain_id
from .sizes import UNITS, measured

LEAF, FAN = 20_000, 16
#: Targets are a small table of wishes; more sources than this are refused, which bounds what the driver holds.
MOST_SOURCES = 10_000


def pivotal(fractions: list[float], rng: random.Random) -> tuple[list[int | None], float]:
    """Round in order; the result has one None at most, the place of the fraction left, which is the second value."""
    out: list[int | None] = [None] * len(fractions)
    held, p = -1, 0.0
    for i, q in enumerate(fractions):
        if q <= 1e-12 or q >= 1 - 1e-12:
            out[i] = int(q > 0.5)
            continue
        if held < 0:
            held, p = i, q
            continue
        s = p + q
        if s < 1:
            if rng.random() * s < p:
                out[i] = 0
            else:
                out[held], held = 0, i
            p = s
        else:
            if rng.random() * (2 - s) < 1 - q:
                out[held], held = 1, i
            else:
                out[i] = 1
            p = s - 1
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[held], held = int(p > 0.5), -1
    return out, (p if held >= 0 else 0.0)


def plan(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """For each target source: wanted and available size, copies of each document, and whether it falls short. Sources
    are compared without case and outer blanks; a repeated target row is an error."""
    have = {r.source: r.size for r in sized.groupBy("source").agg(F.sum("size").alias("size")).join(F.broadcast(targets.select(plain_id("source").alias("source"))), "source", "left_semi").collect()}
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    rows = targets.select("source", plain_id("source").alias("name"), "target_ppm", "max_repeats").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES or len({r.name for r in rows}) < len(rows):
        raise ValueError("targets must name each source once, and not too many")
    out = []
    for r in rows:
        there, ppm, most = have.get(r.name, 0), r.target_ppm or 0, r.max_repeats or 0
        rate = min(ppm * total / 1e6 / there, float(most)) if there else 0.0
        out.append({"source": r.source, "name": r.name, "target_ppm": ppm, "max_repeats": most, "target_size": ppm * total / 1e6, "available_size": there, "rate": rate, "short": ppm * total > most * there * 1_000_000})
    return out


def _level(rows: DataFrame, seed: int) -> DataFrame:
    """Round the fractions of each (name, node); copies is null where one is left."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["size", "doc_id"])
        done, rest = pivotal(g.fraction.tolist(), random.Random(f"{seed}:{key[0]}:{key[1]}:{len(g)}"))
        g["extra"] = pd.array(done, dtype="Int32")
        g["fraction"] = [rest if x is None else float(x) for x in done]
        return g[["doc_id", "name", "size", "base", "fraction", "node", "extra"]]

    return rows.groupBy("name", "node").applyInPandas(run, "doc_id string, name string, size bigint, base int, fraction double, node bigint, extra int")


def mix(docs: DataFrame, targets: DataFrame, measure: str = UNITS, seed: int = 7, leaf: int = LEAF, fan: int = FAN) -> tuple[DataFrame, list[dict]]:
    """(doc_id, source, size, copies >= 1) and the plan. Documents without source or text, or of a source without
    target, are in no mix, but count for the total size."""
    sized = stash(measured(docs.select(F.col("doc_id").cast("string"), plain_id("source").alias("source"), "text"), measure, "source"), "sized")
    goals = plan(sized, targets)
    spark = docs.sparkSession
    rates = F.broadcast(spark.createDataFrame([(g["name"], g["rate"]) for g in goals], "name string, rate double"))  # at most MOST_SOURCES rows
    rows = sized.where("size > 0").withColumnRenamed("source", "name").join(rates, "name").where("rate > 0")
    n = max(rows.count(), 1)
    leaves = -(-n // leaf)
    base = F.floor("rate").cast("int")
    now = rows.select("doc_id", "name", "size", base.alias("base"), (F.col("rate") - base).alias("fraction"), F.pmod(F.xxhash64("doc_id"), F.lit(leaves)).cast("bigint").alias("node"))
    done = None
    while True:
        step = stash(_level(now, seed), "level")
        whole = step.where("extra is not null").select("doc_id", "name", "size", (F.col("base") + F.col("extra")).alias("copies"))
        done = whole if done is None else done.unionByName(whole)
        rest = step.where("extra is null")
        if leaves == 1:
            break
        leaves = -(-leaves // fan)
        now = rest.withColumn("node", F.floor(F.col("node") / F.lit(fan)).cast("bigint")).drop("extra")
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))  # the last fraction of each source
    last = rest.select("doc_id", "name", "size", (F.col("base") + (u < F.col("fraction")).cast("int")).alias("copies"))
    return done.unionByName(last).where("copies > 0").withColumnRenamed("name", "source"), goals


def report(docs: DataFrame, targets: DataFrame, measure: str = UNITS) -> DataFrame:
    """(source, target_ppm, max_repeats, target_size, available_size, mixed_size, mixed_ppm, short), a row for each
    target source."""
    mixed, goals = mix(docs, targets, measure)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n")).collect()}  # at most MOST_SOURCES rows
    total = max(sum(got.values()), 1)
    rows = [(g["source"], g["target_ppm"], g["max_repeats"], g["target_size"], g["available_size"], got.get(g["name"], 0), got.get(g["name"], 0) * 1e6 / total, g["short"]) for g in goals]
    return docs.sparkSession.createDataFrame(rows, "source string, target_ppm int, max_repeats int, target_size double, available_size bigint, mixed_size bigint, mixed_ppm double, short boolean")
