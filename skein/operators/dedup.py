"""De-duplication: exact texts, SimHash fingerprints, banded near pairs, greedy removal, author profiles."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..session import release, ship, stash

NEAR_BITS, AUTHOR_BITS, BANDS, LEAST_TOKENS, PROFILE_DOCS = 5, 3, 4, 20, 3
_WORD = re.compile(r"[^\W]+")


def exact(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row, in ``order``, of each text key; rows without text stay. The last column of ``order`` identifies a
    row. Keys are worked out once and written without the texts; the smallest row of a key is found by an aggregate with
    map-side combination, so a text that a third of all rows share is no hot window."""
    keys = stash(df.select(*order, X.text_key(text).alias("text_key")), "text-keys")
    first = keys.where("text_key is not null").groupBy("text_key").agg(F.min(F.struct(*order)).alias("first"))
    last = order[-1]
    kept = first.select(F.col(f"first.{last}").alias(last)).unionByName(keys.where("text_key is null").select(last))
    return df.join(kept, last, "left_semi")


def fingerprint(texts: list[str]) -> np.ndarray:
    """64-bit SimHash of the words and word pairs with their counts: a bit is set when its weighted vote is at least 0.
    No words: 0. Feature hashes are the first eight bytes of md5, so that other engines get the same value."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for lo in range(0, len(texts), 500):
        number: dict[str, int] = {}
        ids, counts, starts, rows = [], [], [], []
        for i, t in enumerate(texts[lo : lo + 500]):
            words = _WORD.findall((t or "").lower())
            if not words:
                continue
            features = Counter(words)
            features.update([f"{a} {b}" for a, b in zip(words, words[1:])])
            starts.append(len(ids))
            rows.append(lo + i)
            ids += [number.setdefault(f, len(number)) for f in features]
            counts += features.values()
        if not rows:
            continue
        digests = b"".join(hashlib.md5(f.encode("utf-8", "surrogatepass")).digest()[:8] for f in number)
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).astype(np.int8) * 2 - 1
        ids_, counts_ = np.asarray(ids), np.asarray(counts, np.int32)
        ends = [*starts[1:], len(ids)]
        for row, a, b in zip(rows, starts, ends):
            votes = counts_[a:b] @ bits[ids_[a:b]].astype(np.int32)
            out[row] = weights[votes >= 0].sum(dtype=np.uint64)
    return out


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash bigint). Arrow batches; md5 of each distinct feature of a batch once."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint(b.column(1).to_pylist()).view(np.int64))], names=[key, "simhash"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, simhash bigint")


def bands(df: DataFrame, n: int = BANDS) -> DataFrame:
    """A row for each of ``n`` bands of the fingerprint: band, bits."""
    width = 64 // n
    if 64 % n:
        raise ValueError("the number of bands must divide 64")
    cut = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("simhash", width * (n - 1 - i)).bitwiseAND(F.lit((1 << width) - 1)).alias("bits")) for i in range(n)])
    return df.withColumn("__b", F.explode(cut)).select(*df.columns, F.col("__b.band").alias("band"), F.col("__b.bits").alias("bits"))


def near_pairs(df: DataFrame, key: str, rank: str, block: str, most: int = NEAR_BITS, differ: str | None = None) -> DataFrame:
    """(lo, hi, bits): pairs of one block (language) that share a band and differ in at most ``most`` bits; lo comes
    before hi in rank. With ``differ``, only pairs that differ in that column."""
    cols = [key, rank, "simhash", block, *([differ] if differ else [])]
    b = bands(df.select(*cols))
    left, right = (b.select(*[F.col(c).alias(f"{s}_{c}") for c in [key, rank, "simhash", *([differ] if differ else [])]], F.col(block).alias("__block"), "band", "bits") for s in ("l", "r"))
    distance = F.bit_count(F.col("l_simhash").bitwiseXOR(F.col("r_simhash")))
    ok = (F.col(f"l_{rank}") < F.col(f"r_{rank}")) & (distance <= most)
    if differ:
        ok &= F.col(f"l_{differ}") != F.col(f"r_{differ}")
    j = left.join(right, ["__block", "band", "bits"]).where(ok)
    return j.select(F.col(f"l_{key}").alias("lo"), F.col(f"r_{key}").alias("hi"), distance.alias("bits")).distinct()


def greedy(pairs: DataFrame) -> DataFrame:
    """(id, status kept or dropped, matched_by) of every id in a pair, as taking them in rank order and dropping each
    that is near a kept one. Rounds: an id without a kept or undecided neighbour before it is kept; one with a kept
    neighbour before it is dropped. Only the pair graph is iterated; each round is a written table."""
    pairs = stash(pairs.select("lo", "hi"), "pairs")
    ids = pairs.select(F.explode(F.array("lo", "hi")).alias("id")).distinct()
    state = stash(ids.select("id", F.lit("open").alias("status"), F.lit(None).cast(pairs.schema["lo"].dataType).alias("matched_by")), "state")
    while state.where("status = 'open'").limit(1).count():
        before = state.select(F.col("id").alias("lo"), F.col("status").alias("lo_status"))
        open_ = state.where("status = 'open'").select("id")
        seen = pairs.join(open_.withColumnRenamed("id", "hi"), "hi", "left_semi").join(before, "lo").groupBy(F.col("hi").alias("id")).agg(
            F.min(F.when(F.col("lo_status") == "kept", F.col("lo"))).alias("kept_by"), F.max((F.col("lo_status") == "open").cast("int")).alias("waits")
        )
        new = F.when(F.col("status") != "open", F.col("status")).when(F.col("kept_by").isNotNull(), "dropped").when(F.coalesce("waits", F.lit(0)) == 0, "kept").otherwise("open")
        after = stash(state.join(seen, "id", "left").select("id", new.alias("status"), F.coalesce("matched_by", F.when(new == "dropped", F.col("kept_by"))).alias("matched_by")), "state")
        release(state)
        state = after
    release(pairs)
    return state


def ranked(df: DataFrame, order: list) -> DataFrame:
    """A sortable rank key from the order columns, without a global sort: larger token lengths first."""
    return df.withColumn("rank", F.concat_ws("\x01", *order))


def near_dedup(df: DataFrame, key: str, text: str, block: str, order: list, least: int = LEAST_TOKENS) -> DataFrame:
    """(key, status, matched_by) of all documents: kept, or dropped as near a kept one. Documents of fewer than
    ``least`` tokens take no part and are kept."""
    long = df.where(X.token_count(text) >= least)
    marked = stash(ranked(long, order).select(key, block, "rank").join(simhash(long, key, text), key), "fingerprints")
    state = greedy(near_pairs(marked, key, "rank", block))
    out = df.select(key).join(state.withColumnRenamed("id", key), key, "left")
    return out.select(key, F.coalesce("status", F.lit("kept")).alias("status"), "matched_by")


def author_profiles(df: DataFrame, author: str, key: str, text: str, lang: str, source: str, n: int = PROFILE_DOCS) -> DataFrame:
    """(author, n_docs, n_tokens, lang of the longest document, majority source, profile text of the ``n`` longest)."""
    d = df.where(F.col(author).isNotNull()).select(F.col(author).alias("author"), key, text, lang, source, X.token_count(text).alias("n_tokens"))
    top = d.withColumn("__r", F.row_number().over(W.partitionBy("author").orderBy(F.desc("n_tokens"), key))).where(F.col("__r") <= n)
    text_of = top.groupBy("author").agg(F.sort_array(F.collect_list(F.struct("__r", text))).alias("t"), F.min(F.when(F.col("__r") == 1, F.col(lang))).alias("lang"))  # at most n rows an author
    totals = d.groupBy("author").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    c = d.groupBy("author", source).agg(F.count(F.lit(1)).alias("n"))
    major = c.withColumn("__r", F.row_number().over(W.partitionBy("author").orderBy(F.desc("n"), source))).where("__r = 1").select("author", F.col(source).alias("source"))
    profile = F.array_join(F.transform("t", lambda x: F.coalesce(x[text], F.lit(""))), "\n")
    return totals.join(text_of, "author").join(major, "author").select("author", "n_docs", "n_tokens", "lang", "source", profile.alias("profile"))


def near_authors(profiles: DataFrame) -> DataFrame:
    """(lo, hi, bits): authors of one language but different majority sources with nearly one profile; lo is the
    stronger (more documents, more tokens, smaller id)."""
    size = lambda c: F.lpad((F.lit(10**12) - F.col(c)).cast("string"), 13, "0")
    p = ranked(profiles.where(F.length("profile") > 0), [size("n_docs"), size("n_tokens"), F.col("author")])
    p = stash(p.select("author", "lang", "source", "rank").join(simhash(profiles, "author", "profile"), "author"), "profiles")
    return near_pairs(p, "author", "rank", "lang", AUTHOR_BITS, "source")
