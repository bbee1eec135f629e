"""Whole pipelines: construct a corpus, merge two phases, score a split, audit it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, chunking, dedup, detection, sampling, scoring, splits, studies
from ..session import stash

@dataclass
class Corpus:
    documents: DataFrame
    stages: DataFrame
    truth: DataFrame


def _cleaned(raw: DataFrame) -> DataFrame:
    """Raw documents to processed ones: spaced letters collapsed, lengths taken from the text, dirty ones dropped. Native
    tests run before anything in Python."""
    d = raw.where(F.col("text").isNotNull() & F.col("author").isNotNull()).withColumn("source", F.lower(F.trim("source"))).withColumn("lang", X.canonical_language("lang")).withColumn("text", X.despaced("text"))
    d = stash(d, "despaced")  # written once, not inlined into every later test
    d = d.withColumn("token_length", X.token_count("text")).withColumn("length_bucket", X.length_class("token_length")).withColumn("author_id", X.author_key("source", "author"))
    return d.where(X.filter_reason("text", "source", "lang").isNull())


def _audited(d: DataFrame) -> DataFrame:
    """Languages that the detector, trained on the documents' own labels, surely contradicts are set right."""
    seen = detection.detect(d, detection.fit_detector(d, "text", "lang"), "text")
    return detection.audit(seen, "text", "lang").withColumn("lang", F.coalesce("final_lang", "lang")).select(*d.columns)


def _cut(d: DataFrame, most: int, share: float, limit: int, seed: int) -> DataFrame:
    """Long documents in chunks, named after their document, or, for the part that is not chunked, cut at ``limit``
    tokens; lengths are taken anew."""
    parts = chunking.chunk_documents(d.select(F.col("doc_id").alias("raw_id"), "text"), most, share=share, seed=seed).withColumnRenamed("raw_id", "part_id")
    short = chunking.truncate(parts, "part_id", limit).select("part_id", "text")
    whole = d.drop("text").join(short.withColumn("doc_id", F.substring_index("part_id", "#chunk_", 1)), "doc_id")
    made = whole.withColumn("raw_id", F.when(F.col("part_id") == F.col("doc_id"), F.col("raw_id")).otherwise(F.concat(F.coalesce("raw_id", "doc_id"), F.lit("#chunk_"), F.substring_index("part_id", "#chunk_", -1))))
    made = made.withColumn("doc_id", F.col("part_id")).drop("part_id").withColumn("token_length", X.token_count("text"))
    return made.withColumn("length_bucket", X.length_class("token_length")).select(*d.columns)


def _deduplicated(d: DataFrame) -> DataFrame:
    """Without repeated and near texts, the longest kept, and without authors that are near a stronger author."""
    one = dedup.exact(d, "text", ["doc_id"])
    order = [F.lpad((F.lit(10**9) - F.col("token_length")).cast("string"), 10, "0"), "lang", "source", F.coalesce("author_id", F.lit("")), F.coalesce("raw_id", F.lit("")), F.col("doc_id").cast("string")]
    kept = dedup.near_dedup(one, "doc_id", "text", "lang", order).where("status = 'kept'").select("doc_id")
    one = stash(one.join(kept, "doc_id", "left_semi"), "near-free")
    profiles = dedup.author_profiles(one, "author_id", "doc_id", "text", "lang", "source")
    gone = dedup.greedy(dedup.near_authors(profiles)).where("status = 'dropped'").select(F.col("id").alias("author_id"))
    return one.join(gone, "author_id", "left_anti")


def sample(d: DataFrame, total: int, seed: int, genres: dict[str, float] | None = None) -> DataFrame:
    """``total`` documents by the languages' weights; in each language by genre quotas with spill if ``genres`` is given,
    else by length quotas with fill. What the weighted languages lack comes from the other ones."""
    there = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    goals = {r.lang: r.target for r in sampling.language_targets(there, "lang", "n", total, sampling.LANGUAGE_WEIGHTS).collect()}  # a dozen languages
    d = d.withColumn("__cell", sampling.genre_key(F.col("genre"), list(genres)) if genres else F.col("length_bucket"))
    picked = sampling.planned_fill(d, "lang", "__cell", "doc_id", goals, genres or sampling.LENGTH_WEIGHTS, seed).drop("pass")
    lacking = total - sum(goals.values())
    others = sampling.uniform_cap(d.where(~F.coalesce(F.col("lang"), F.lit("")).isin(list(goals))), "doc_id", max(lacking, 0), seed)
    return picked.unionByName(others).drop("__cell")


def construct(raw: DataFrame, total: int, seed: int = 42, most_per_author: int = 5, most_tokens: int = 500, chunk_share: float = 0.7, cut_tokens: int = 2000, genres: dict[str, float] | None = None) -> Corpus:
    """Raw documents (doc_id, raw_id, author, text, lang, source, genre) to a split corpus with retrieval roles: cleaned,
    languages audited, authors capped, long texts chunked or cut, de-duplicated by text, near text and near author,
    sampled to the languages' and lengths' (or genres') shares, split.

    Tables are written after each costly step, so a lost executor never repeats more than one of them.
    """
    raw = raw.withColumn("doc_id", F.col("doc_id").cast("string"))
    clean = stash(_cleaned(raw), "cleaned")
    right = stash(_audited(clean), "audited")
    capped = stash(sampling.author_limits(right, "author_id", "doc_id", 3, 2, most_per_author, seed), "capped")
    cut = stash(_cut(capped, most_tokens, chunk_share, cut_tokens, seed), "cut")
    unique = stash(_deduplicated(cut), "unique")
    chosen = stash(sample(unique, total, seed, genres), "picked")
    split = splits.stratified(chosen, ["lang", "genre", "length_bucket"], "doc_id", seed)
    roles = stash(splits.retrieval_roles(split, "author_id", "doc_id", seed, ["split"]), "roles")
    truth = splits.ground_truth(roles, "author_id", "doc_id", ["split"])
    stages = [("raw", raw), ("clean", clean), ("audited", right), ("author_capped", capped), ("chunked", cut), ("unique", unique), ("sampled", chosen), ("with_role", roles)]
    counts = None
    for i, (name, df) in enumerate(stages):
        c = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("stage"), F.lit(name).alias("name"), "n")
        counts = c if counts is None else counts.unionByName(c)
    return Corpus(roles, counts, truth)


def merge(phase1: DataFrame, phase2: DataFrame, seed: int = 42, total: int | None = None, shares: dict[str, float] | None = None) -> DataFrame:
    """Two phases into one corpus: texts of phase 2 removed from phase 1, exact and near texts de-duplicated, languages
    audited, sampled to ``total`` with the phases' ``shares`` if given, ids given anew, authors kept whole in a split,
    every document of an author with a role. Documents without author are split in proportion by language and have no
    role. Input columns: doc_id, author_id, text, lang, source, genre."""
    p2 = dedup.exact(phase2, "text", ["doc_id"]).withColumn("phase", F.lit("phase2"))
    keys = p2.select(X.text_key("text").alias("k")).where("k is not null")
    p1 = dedup.exact(phase1, "text", ["doc_id"]).withColumn("phase", F.lit("phase1")).withColumn("k", X.text_key("text")).join(keys, "k", "left_anti").drop("k")
    both = stash(p1.unionByName(p2), "joined")
    order = [F.lpad((F.lit(10**9) - X.token_count("text")).cast("string"), 10, "0"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("author_id", F.lit("")), F.col("doc_id").cast("string")]
    kept = dedup.near_dedup(both, "doc_id", "text", "lang", order).where("status = 'kept'").select("doc_id")
    both = stash(_audited(both.join(kept, "doc_id", "left_semi")), "merged")
    if total is not None:
        both = stash(studies.phase_sample(both, "phase", "doc_id", total, shares or {"phase1": 0.5, "phase2": 0.5}, seed), "merged-sample")
    both = splits.position_ids(both, ["phase", "doc_id"], "mix")
    by_author = splits.author_aware(both, "author_id", "lang").select(F.col("author").alias("author_id"), "split")
    placed = splits.keep_all_roles(both.join(by_author, "author_id"), "author_id", "new_id", seed, ["split"])
    alone = splits.stratified(both.where("author_id is null"), ["lang"], "new_id", seed).withColumn("retrieval_role", F.lit(None).cast("string"))
    return placed.unionByName(alone)


def score(scored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean ranking metrics, equal error rate and ROC-AUC of scored pairs."""
    s = stash(scored, "scored")
    g = scoring.by_score(s)
    return scoring.mean_ranking(scoring.ranking(s)), scoring.eer(g), scoring.roc_auc(g)


def audit_split(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The summary of all shortcut schemes."""
    out = None
    for name, fields in audit.SCHEMES.items():
        r = audit.scheme_rows(pairs, candidates, name, fields)
        out = r if out is None else out.unionByName(r)
    return audit.scheme_summary(out)
