"""Problem 1: near-duplicate records with small edits, by a MinHash LSH forest and exact verification.

Each of TREES trees holds every text's signature as a path of DEPTH components; a component is the smallest hash, under
one of DEPTH permutations, of the text's substrings that fall into the tree's share of the hash space. A tree is a table
of paths sorted by prefix (see forest.py), in which records that share a prefix lie side by side. Matching starts at the
longest prefix whose recall at the threshold reaches the target; where a prefix is crowded it is lengthened, and for
records whose recall that would push under the target, prefixes are shortened in their other trees until it is met again.
A sketch comparison removes the plainly unlike, and the rest is verified on exact distinct substrings.

Copies (equal normal form as written) share one class and are signed, matched and verified once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import HOT_PARTS, split_join
from ..session import ship, stash
from . import textkit as T
from .components import components
from .forest import DEPTH, TREES, candidates, packed

THRESHOLD, TARGET_RECALL, MIN_GRAMS = 0.7, 0.98, 200
SKETCH = 64
#: A sketch of 64 one-byte minima estimates the similarity with a deviation of at most 0.0625; pairs at the threshold
#: fall under threshold - SLACK with a probability under 1e-4.
SLACK = 0.25


def signatures(uniq: np.ndarray, n: int, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, depth, trees) minima of the distinct 44-bit hashes in ``uniq`` and the number of distinct hashes. Empty
    bins borrow from a full one, each in an order of its own, so the trees of a text of few substrings stay different."""
    doc = (uniq >> np.uint64(44)).astype(np.int64)
    count = np.bincount(doc, minlength=n)
    low = uniq & np.uint64((1 << 44) - 1)
    none = np.uint64(np.iinfo(np.uint64).max)
    out = np.empty((n, depth, trees), np.uint64)
    for p in range(depth):
        h = T.mix(low + np.uint64(0x9E3779B97F4A7C15 * (p + 1) % 2**64)) >> np.uint64(20)
        bins = np.full(n * trees, none, np.uint64)
        np.minimum.at(bins, doc * trees + ((h >> np.uint64(12)) * np.uint64(trees) >> np.uint64(32)).astype(np.int64), h)
        bins = bins.reshape(n, trees)
        full = bins != none
        base, held = bins.copy(), full.copy()
        some = held.any(1)
        tree = np.arange(trees, dtype=np.uint64)
        for step in range(1, 4 * trees + 1):
            if full[some].all():
                break
            # the first steps ask bins in an order of each bin's own, the last ones all of them in turn
            ask = (T.mix(tree + np.uint64((step * trees * DEPTH + p * trees))) % np.uint64(trees)).astype(np.int64) if step <= 3 * trees else (np.arange(trees) + step) % trees
            take = ~full & held[:, ask]
            bins = np.where(take, base[:, ask], bins)
            full |= take
        out[:, p] = bins
    return out, count


_SIGNED = [("doc_id", pa.string()), ("written", pa.binary()), ("normal", pa.binary()), ("n", pa.int32()), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int32())), ("sketch", pa.binary())]
Prints = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """Row lists of ``values``, whose row numbers ``owner`` ascend."""
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32), pa.array(values))


def _sign(min_grams: int, every: bool, prints: Prints | None):
    schema = pa.schema(_SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in T.slices(texts):
                part = texts[lo:hi]
                cp, off = T.kept(part)
                uniq = T.distinct(*T.grams(cp, off))
                doc = (uniq >> np.uint64(44)).astype(np.int64)
                count = np.bincount(doc, minlength=len(part))
                big = count >= min_grams
                rows = np.flatnonzero(np.diff(off) > 0) if every else np.flatnonzero(big)
                if not len(rows):
                    continue
                ok = np.flatnonzero(big)
                renumber = np.zeros(len(part), np.uint64)
                renumber[ok] = np.arange(len(ok), dtype=np.uint64)
                u = uniq[big[doc]]
                u = (renumber[(u >> np.uint64(44)).astype(np.int64)] << np.uint64(44)) | (u & np.uint64((1 << 44) - 1))
                sig, _ = signatures(u, len(ok), TREES, DEPTH)
                sketch = (T.mix(sig[:, :2].reshape(len(ok), -1)[:, :SKETCH]) & np.uint64(255)).astype(np.uint8)
                head, tail = packed(sig)
                owner = np.repeat(np.arange(len(ok)), TREES)
                head, tail = head.ravel(), tail.ravel()
                if prints and len(ok):
                    d, _, h = prints(cp, off)
                    mine = big[d]
                    owner = np.concatenate((owner, renumber[d[mine]].astype(np.int64)))
                    order = np.argsort(owner, kind="stable")
                    owner, head = owner[order], np.concatenate((head, h[mine].view(np.int64) | np.int64(-(2**63))))[order]
                    tail = np.concatenate((tail, np.zeros(int(mine.sum()), np.int32)))[order]
                spot = np.full(len(part), -1)
                spot[ok] = np.arange(len(ok))
                at = pa.array(spot[rows], mask=spot[rows] < 0)
                written, normal, _ = T.keys(part)
                lists = [_lists(x, owner, len(ok)) if len(ok) else pa.nulls(1, t) for x, t in ((head, pa.list_(pa.int64())), (tail, pa.list_(pa.int32())))]
                sketches = pa.array([x.tobytes() for x in sketch] or [None], pa.binary())
                cols = [pa.array([ids[lo + i] for i in rows], pa.string()), pa.array([written[i] for i in rows], pa.binary()), pa.array([normal[i] for i in rows], pa.binary()), pa.array(count[rows], pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *(x.take(at) for x in (*lists, sketches))], schema=schema)

    return run


def sign(docs: DataFrame, min_grams: int = MIN_GRAMS, every: bool = False, prints: Prints | None = None) -> DataFrame:
    """Signature table of ``docs`` (doc_id string, text): one row for each text with at least ``min_grams`` distinct
    substrings, with a bigint ``rid`` that is unique in the table; with ``every``, also a row of keys without signature
    for each shorter text. Null and empty texts and those without letter or digit have no row. ``prints`` adds the
    fingerprints that it selects from the same pass over the text, as negative heads."""
    ship(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("string"), "text").where("text is not null" if every else F.length("text") >= min_grams + T.GRAM - 1)
    made = made.mapInArrow(_sign(min_grams, every, prints), "doc_id string, written binary, normal binary, n int, heads array<bigint>, tails array<int>, sketch binary")
    return stash(made.withColumn("rid", F.monotonically_increasing_id()), "signed")


def classes(signed: DataFrame) -> DataFrame:
    """(rep, rid, doc_id, normal): every signed row with the representative of its copies. A text that a third of all
    rows share meets its representative by a broadcast."""
    reps = signed.groupBy("written").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("n_copies"))
    reps = stash(reps, "reps")
    hot = reps.where(F.col("n_copies") > max(signed.count() // HOT_PARTS, 10_000)).select("written")
    return stash(split_join(signed.select("rid", "doc_id", "written", "normal"), reps.select("written", "rep"), "written", hot).select("rep", "rid", "doc_id", "normal"), "classes")


def paths(reps: DataFrame, side: str | F.Column = "0") -> DataFrame:
    """(rid, head, tail, tag): a row for each tree and fingerprint of each text; ``side`` are the bits of forest.py."""
    tag = F.col("n").bitwiseOR(F.expr(side) if isinstance(side, str) else side).cast("int")
    zipped = reps.select("rid", tag.alias("tag"), F.explode(F.arrays_zip("heads", "tails")).alias("p"))
    return zipped.select("rid", F.col("p.heads").alias("head"), F.col("p.tails").alias("tail"), "tag")


def _alike(least: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, SKETCH)
            y = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)
            keep = pa.array((x == y).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], schema=schema)

    return run


def prune(pairs: DataFrame, reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Candidate pairs (a, b) whose sketches don't rule the threshold out."""
    s = reps.select("rid", "sketch")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(_alike(threshold - SLACK), "a bigint, b bigint")


def _verify(threshold: float, min_grams: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            for lo, hi in T.slices(left):
                s, na, nb = T.jaccard(left[lo:hi], right[lo:hi])
                keep = pa.array((s >= threshold) & (na >= min_grams) & (nb >= min_grams))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi].filter(keep), b.column(1)[lo:hi].filter(keep), pa.array(s).filter(keep)], schema=schema)

    return run


def verify(pairs: DataFrame, signed: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, min_grams: int = MIN_GRAMS) -> DataFrame:
    """(a, b, similarity) of the pairs of rids that meet the threshold on their whole texts. Only the texts of
    documents in a pair are moved."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    wanted = signed.select("rid", "doc_id").join(needed, "rid", "left_semi")
    texts = stash(docs.select(F.col("doc_id").cast("string"), "text").join(wanted, "doc_id").select("rid", "text"), "texts")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_verify(threshold, min_grams), "a bigint, b bigint, similarity double")


def links(docs: DataFrame, threshold: float = THRESHOLD, min_grams: int = MIN_GRAMS, target: float = TARGET_RECALL, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, similarity) between class representatives, a < b, and the classes they stand for; with
    ``every``, also the classes of texts with fewer substrings."""
    signed = sign(docs, min_grams, every)
    members = classes(signed)
    reps = signed.where(F.col("n") >= min_grams).select("rid", "n", "heads", "tails").join(members.where("rep = rid").select("rid"), "rid", "left_semi")
    found = candidates(paths(reps), threshold, target)
    found = stash(prune(found, signed, threshold), "candidates")
    return stash(verify(found, signed, docs, threshold, min_grams), "links"), members


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, min_grams: int = MIN_GRAMS, target: float = TARGET_RECALL) -> DataFrame:
    """All pairs (doc_id_a < doc_id_b) of documents at or over the threshold whose normal forms differ, copies
    included. Two copies as written with different normal forms (one a field list, one not) are a pair."""
    linked, members = links(docs, threshold, min_grams, target)
    m = members.select("rep", "doc_id", "normal")
    within = members.groupBy("rep").agg(F.min("normal").alias("lo"), F.max("normal").alias("hi")).where("lo <> hi").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    pairs = linked.select("a", "b").unionByName(within)
    out = pairs.join(m.toDF("a", "da", "na"), "a").join(m.toDF("b", "db", "nb"), "b").where("na <> nb and (a <> b or da < db)")
    return out.select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, min_grams: int = 1) -> DataFrame:
    """One row for each document of a near-duplicate group: doc_id, the group's smallest doc_id, the group's size and
    the number of verified links of its class. Documents without a near duplicate or copy have no row. All texts with a
    letter or digit count, those too short for a substring by their copies alone; MIN_GRAMS is a bound of near_pairs."""
    linked, members = links(docs, threshold, min_grams, every=True)
    degree = linked.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(linked.select("a", "b")).toDF("rep", "root")
    m = members.join(roots, "rep", "left").join(degree, "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    groups = m.groupBy("root").agg(F.min("doc_id").alias("group_doc_id"), F.count(F.lit(1)).alias("n_docs")).where("n_docs > 1")
    return m.join(groups, "root").select("doc_id", "group_doc_id", "n_docs", "n_links")
