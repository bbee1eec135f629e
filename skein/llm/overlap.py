"""Problem 6: same or near-same records across splits, by winnowing fingerprints.

Every text's normal form gives the smallest rolling hash of each window; two texts that share GRAM + WINDOW - 1
characters on end share a fingerprint. Small edits all over a text leave no run of that length (at similarity 0.7 one
letter in 29 may be changed), so the paths of problem 1's forest are matched in the same pass: they find a pair at the
threshold with a probability of RECALL whatever its runs. Pairs of a train and an evaluation text are verified by their
exact similarity. The substrings that a pair shares are chained into collinear runs, the runs extended by comparing
characters in both directions, and the characters covered are reported on both sides.

Copies share one class, so a text that a third of all records repeat is fingerprinted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import HOT_PARTS, split_join
from ..session import stash
from . import near
from . import textkit as T
from .families import plain_id
from .forest import LEFT, RIGHT, candidates

#: Characters of a fingerprint and fingerprints of a window. Scripts that say more in a character have shorter ones.
GRAM, WINDOW = 48, 64
DENSE_GRAM, DENSE_WINDOW = 20, 24
#: Chance that the forest finds a pair at the threshold; characters of a seed of the chain, under the runs that edits leave.
RECALL, SEED = 0.98, 16
TRAIN = "train"


def winnow(cp: np.ndarray, off: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, position in the document, hash) of the selected minima. The last of equal minima counts. A
    document with fewer than ``window`` grams gives the smallest it has; one shorter than a gram gives none."""
    n = len(off) - 1
    doc, h = T.grams(cp, off, gram)
    if not len(h):
        return doc, doc, h
    first = np.searchsorted(doc, np.arange(n))
    count = np.bincount(doc, minlength=n)
    place = np.arange(len(h)) - first[doc]
    # the upper 40 bits of the hash decide, ties go to the right; the lower 24 bits tell the place
    low24 = np.uint64((1 << 24) - 1)
    key = (h & ~low24) | (low24 - (np.arange(len(h)).astype(np.uint64) & low24))
    low, w = key, 1
    while w * 2 <= window:  # sliding minimum by doubling; places near a document's end are handled below
        shifted = np.concatenate((low[w:], np.full(w, np.iinfo(np.uint64).max, np.uint64)))
        low = np.minimum(low, shifted)
        w *= 2
    if w < window:
        rest = window - w
        low = np.minimum(low, np.concatenate((low[rest:], np.full(rest, np.iinfo(np.uint64).max, np.uint64))))
    chosen = np.zeros(len(h), bool)
    full = np.flatnonzero(place + window <= count[doc])
    chosen[full + (((low24 - (low[full] & low24)).astype(np.int64) - full) & ((1 << 24) - 1))] = True
    present = np.flatnonzero(count > 0)
    least, few = np.minimum.reduceat(key, first[present]), count[present] < window
    begin = first[present][few]
    chosen[begin + (((low24 - (least[few] & low24)).astype(np.int64) - begin) & ((1 << 24) - 1))] = True
    at = np.flatnonzero(chosen)
    return doc[at], place[at], h[at]


def fingerprints(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing with the gram of the text's script: texts of mostly CJK, kana or Hangul take the short one, all others
    the long one, and texts in between both."""
    heavy = ((cp >= 0x3040) & (cp < 0xA000)) | ((cp >= 0xAC00) & (cp < 0xD7B0))
    at = np.concatenate(([0], np.cumsum(heavy)))
    share = (at[off[1:]] - at[off[:-1]]) / np.maximum(np.diff(off), 1)
    parts = []
    for chosen, gram, window in ((share < 0.7, GRAM, WINDOW), (share > 0.3, DENSE_GRAM, DENSE_WINDOW)):
        ids = np.flatnonzero(chosen)
        if len(ids):
            mask = np.repeat(chosen, np.diff(off))
            d, place, h = winnow(cp[mask], np.concatenate(([0], np.cumsum(np.diff(off)[ids]))), gram, window)
            parts.append((ids[d], place, h))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    doc, place, h = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(doc, kind="stable")
    return doc[order], place[order], h[order]


def shared(x: np.ndarray, y: np.ndarray, gram: int = SEED) -> list[tuple[int, int]]:
    """Places (in x, in y) of equal substrings of ``gram`` characters, the i-th occurrence in x with the i-th in y; of a
    run of neighbours each ``gram``-th."""
    keys = []
    for cp in (x, y):
        _, h = T.grams(cp, np.array([0, len(cp)]), gram)
        order = np.argsort(h, kind="stable")
        new = np.concatenate(([True], h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, bool)
        nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        key = np.empty(len(h), np.uint64)
        key[order] = h[order] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys.append(key)
    _, p, q = np.intersect1d(*keys, return_indices=True)
    order = np.argsort(p)
    p, q = p[order], q[order]
    at = np.arange(len(p))
    begins = np.concatenate(([True], (np.diff(p) != 1) | (np.diff(q) != 1)))[: len(p)]
    kept = (at - np.maximum.accumulate(np.where(begins, at, 0))) % gram == 0
    return list(zip(p[kept].tolist(), q[kept].tolist()))


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of seeds that rise on both sides (ties: the smaller places)."""
    from bisect import bisect_left

    seeds = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(seeds)
    for i, (_, y) in enumerate(seeds):
        k = bisect_left(tails, y)
        back[i] = last[k - 1] if k else -1
        if k == len(tails):
            tails.append(y)
            last.append(i)
        else:
            tails[k], last[k] = y, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def extend(x: np.ndarray, y: np.ndarray, seeds: list[tuple[int, int]], gram: int = DENSE_GRAM) -> tuple[int, int]:
    """Characters of x and y that the chained seeds cover once each is extended to both sides as far as they agree."""
    inx, iny = np.zeros(len(x), bool), np.zeros(len(y), bool)
    for a, b in seeds:
        if inx[a] and inx[min(a + gram, len(x)) - 1] and iny[b] and iny[min(b + gram, len(y)) - 1]:
            continue
        k = min(len(x) - a, len(y) - b)
        miss = np.flatnonzero(x[a : a + k] != y[b : b + k])
        right = int(miss[0]) if len(miss) else k
        k = min(a, b)
        miss = np.flatnonzero(x[a - k : a][::-1] != y[b - k : b][::-1])
        left = int(miss[0]) if len(miss) else k
        inx[a - left : a + right] = True
        iny[b - left : b + right] = True
    return int(inx.sum()), int(iny.sum())


def _align(threshold: float, least: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64()), ("cover_a", pa.float64()), ("cover_b", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            for lo, hi in T.slices(left):
                s, na, nb = T.jaccard(left[lo:hi], right[lo:hi])
                keep = np.flatnonzero((s >= threshold) & (na >= least) & (nb >= least))
                ca, cb = np.zeros(len(keep)), np.zeros(len(keep))
                for k, i in enumerate(keep):
                    cp, off = T.kept([left[lo + i], right[lo + i]])
                    x, y = cp[: off[1]], cp[off[1] :]
                    u, v = extend(x, y, chain(shared(x, y)), SEED)
                    ca[k], cb[k] = u / len(x), v / len(y)
                at = pa.array(keep + lo)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(s[keep]), pa.array(ca), pa.array(cb)], schema=schema)

    return run


def aligned(docs: DataFrame, split: DataFrame, threshold: float = near.THRESHOLD, min_grams: int = near.MIN_GRAMS) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity, cover_a, cover_b) between class representatives, a with a member in train, b with one
    in another split, and the members (rep, doc_id, normal, split)."""
    at = split.select(F.col("doc_id").cast("string"), "split").where("split is not null").distinct()
    signed = near.sign(docs, min_grams, every=True, prints=fingerprints)
    placed = stash(signed.select("rid", "doc_id", "written", "normal", "n").join(at, "doc_id"), "placed")
    reps = placed.groupBy("written").agg(F.min("rid").alias("rep"), F.max(F.col("split") == TRAIN).alias("in_train"), F.max(F.col("split") != TRAIN).alias("in_eval"), F.count(F.lit(1)).alias("n_copies"))
    reps = stash(reps, "reps")
    hot = reps.where(F.col("n_copies") > max(placed.count() // HOT_PARTS, 10_000)).select("written")
    members = stash(split_join(placed, reps.select("written", "rep"), "written", hot).drop("written"), "members")
    side = F.when(F.col("in_train"), F.lit(LEFT)).otherwise(0).bitwiseOR(F.when(F.col("in_eval"), F.lit(RIGHT)).otherwise(0))
    sides = signed.where(F.col("n") >= min_grams).select("rid", "n", "heads", "tails").join(reps.select(F.col("rep").alias("rid"), side.alias("side")), "rid")
    met = candidates(near.paths(sides, "side"), threshold, RECALL)
    likely = stash(near.prune(met, signed, threshold), "likely")
    needed = likely.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    whole = docs.select(F.col("doc_id").cast("string"), "text").join(signed.select("rid", "doc_id").join(needed, "rid", "left_semi"), "doc_id").select("rid", "text")
    whole = stash(whole, "texts")
    both = likely.join(whole.toDF("a", "ta"), "a").join(whole.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    links = both.mapInArrow(_align(threshold, min_grams), "a bigint, b bigint, similarity double, cover_a double, cover_b double")
    return stash(links, "overlaps"), members


def crossing(docs: DataFrame, split: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b, train_id, eval_id, eval_split, kind, cover): all pairs of a train and another document with
    equal normal form (kind same, cover 1) or at the threshold (kind near, cover of the evaluation text). Null and
    blank texts and documents in no split are in no pair."""
    links, members = aligned(docs, split)
    long = members.where(F.col("n") >= near.MIN_GRAMS)
    m = long.select("rep", "doc_id", "normal", "split")
    train, other = m.where(F.col("split") == TRAIN), m.where(F.col("split") != TRAIN)
    own = long.select("rep").distinct().select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cover_b"))
    mixed = long.groupBy("rep").agg(F.min("normal").alias("lo"), F.max("normal").alias("hi")).where("lo <> hi").select("rep")
    own = own.join(mixed.toDF("a"), "a", "left_semi")
    pairs = links.select("a", "b", "cover_b").unionByName(own)
    nearly = pairs.join(train.toDF("a", "train_id", "na", "sa"), "a").join(other.toDF("b", "eval_id", "nb", "eval_split"), "b").where("na <> nb")
    nearly = nearly.select("train_id", "eval_id", "eval_split", F.lit("near").alias("kind"), F.col("cover_b").alias("cover"))
    keyed = members.select("doc_id", F.col("normal").alias("key"), "split")
    same = keyed.where(F.col("split") == TRAIN).select("key", F.col("doc_id").alias("train_id")).join(keyed.where(F.col("split") != TRAIN).select("key", F.col("doc_id").alias("eval_id"), F.col("split").alias("eval_split")), "key")
    same = same.select("train_id", "eval_id", "eval_split", F.lit("same").alias("kind"), F.lit(1.0).alias("cover"))
    out = nearly.unionByName(same)
    return out.select(F.least("train_id", "eval_id").alias("doc_id_a"), F.greatest("train_id", "eval_id").alias("doc_id_b"), *out.columns)


def report(docs: DataFrame, split: DataFrame) -> DataFrame:
    """(split, source, n_docs, n_same, n_same_author, mean_cover): evaluation documents that occur in train, by split
    and source. Author ids and sources are compared without case and outer blanks; a null author equals none. Made of
    classes, links between classes and their distinct authors: no pairs of documents are formed."""
    info = docs.select(F.col("doc_id").cast("string"), plain_id("author_id").alias("author"), plain_id("source").alias("source"))
    links, members = aligned(docs, split)
    m = stash(members.select("rep", "doc_id", "normal", "n", "split").join(info, "doc_id"), "placed-members")
    train, other = m.where(F.col("split") == TRAIN), m.where(F.col("split") != TRAIN)
    # equal normal forms: forms of train, and their authors
    forms = train.select("normal").distinct().withColumn("same", F.lit(True))
    form_authors = train.select("normal", "author").where("author is not null").distinct().withColumn("own_same", F.lit(True))
    # near: the best cover of a class, and the authors of the train classes linked to it. Two forms of one class are near.
    long = train.where(F.col("n") >= near.MIN_GRAMS)
    own_class = long.groupBy("rep").agg(F.min("normal").alias("lo"), F.max("normal").alias("hi")).select(F.col("rep").alias("b"), "lo", "hi")
    cover = links.groupBy("b").agg(F.max("cover_b").alias("cover"))
    near_authors = links.select("a", "b").join(long.select(F.col("rep").alias("a"), "author").where("author is not null").distinct(), "a").select("b", "author").distinct().withColumn("own_near", F.lit(True))
    class_authors = long.groupBy("rep", "author").agg(F.min("normal").alias("alo"), F.max("normal").alias("ahi")).where("author is not null").select(F.col("rep").alias("b"), "author", "alo", "ahi")
    e = other.withColumnRenamed("rep", "b").join(forms, "normal", "left").join(form_authors, ["normal", "author"], "left").join(cover, "b", "left")
    e = e.join(own_class, "b", "left").join(near_authors, ["b", "author"], "left").join(class_authors, ["b", "author"], "left")
    differs = (F.col("n") >= near.MIN_GRAMS) & ((F.col("lo") != F.col("normal")) | (F.col("hi") != F.col("normal")))
    differs_own = (F.col("n") >= near.MIN_GRAMS) & ((F.col("alo") != F.col("normal")) | (F.col("ahi") != F.col("normal")))
    no = lambda c: F.coalesce(c, F.lit(False))
    best = F.greatest("cover", F.when(no(F.col("same")) | no(differs), 1.0))
    rows = e.select("split", "source", no(F.col("same")).alias("same"), (no(F.col("own_same")) | no(F.col("own_near")) | no(differs_own)).alias("own"), best.alias("cover")).where("cover is not null")
    return rows.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("same").cast("int")).alias("n_same"), F.sum(F.col("own").cast("int")).alias("n_same_author"), F.avg("cover").alias("mean_cover"))
