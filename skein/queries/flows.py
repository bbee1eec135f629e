"""Chunking, detection, streams and whole pipelines; mostly checked against plain Python instead of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, detection
from ..plans import pipelines
from ..registry import query
from ..session import stash, table
from ..streaming import operators as ST
from .corpus import labelled
from .metrics import scored
from .rows import docs


@query(name="chunk_documents")
def chunk_documents(spark, d):
    p = docs(spark, d, "doc_id", "text").select(F.col("doc_id").alias("raw_id"), "text")
    return chunking.chunk_documents(p)


@query(name="truncate_documents")
def truncate_documents(spark, d):
    return chunking.truncate(docs(spark, d, "doc_id", "text"), "doc_id", 200)


def _detected(spark, d):
    p = labelled(spark, d, "doc_id", "text", "language")
    return detection.detect(p, detection.fit_detector(p, "text", "language"), "text")


@query(name="detect_language")
def detect_language(spark, d):
    return _detected(spark, d).select("doc_id", "language", "detected_lang", F.round("detected_confidence", 4).alias("detected_confidence"))


@query(name="language_audit")
def language_audit(spark, d):
    """Counters by declared language."""
    a = detection.audit(_detected(spark, d), "text", "language")
    return a.groupBy("language").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("detected_lang").alias("n_detected"), F.sum(F.array_contains("reasons", "detected_other").cast("int")).alias("n_other"),
        F.sum(F.array_contains("reasons", "script_mismatch").cast("int")).alias("n_script"), F.sum((F.col("final_lang") != F.col("language")).cast("int")).alias("n_retagged"),
    )


@query(name="language_suspects")
def language_suspects(spark, d):
    return detection.suspects(detection.audit(_detected(spark, d), "text", "language"), "doc_id", "text").select("doc_id", "language", "detected_lang", "reasons", "text_preview")


@query("""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, label, round(score, 6) AS score FROM r WHERE r <= 12""")
def cluster_neighbours(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label", "embedding").withColumn("n", F.lit(1))
    return detection.neighbours(e, "vec_id", "label", "embedding", "n")


@query("""
WITH r AS (SELECT user_id::VARCHAR AS author, event_id::VARCHAR AS id, row_number() OVER (PARTITION BY user_id ORDER BY md5('42:' || event_id)) AS r FROM events WHERE user_id IS NOT NULL)
SELECT author, string_agg(id, ',' ORDER BY id) AS ids FROM r WHERE r <= 5 GROUP BY ALL""")
def stream_author_cap(spark, d):
    """Bounded state of each user of the event stream; equals the batch sample."""
    s = ST.latest(ST.run(ST.capped_state(ST.scan(spark, d, "events"), "user_id", "event_id", 5, 42), "update"), "author")
    return s.select("author", F.array_join(F.sort_array("ids"), ",").alias("ids"))


@query("SELECT count(DISTINCT comment_id) AS n_comments FROM crawl_comments")
def stream_seen_ids(spark, d):
    rows = ST.run(ST.seen_once(ST.scan(spark, d, "crawl_comments").select("comment_id"), "comment_id"), "append")
    return rows.agg(F.count(F.lit(1)).alias("n_comments"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counters(spark, d):
    return ST.latest(ST.run(ST.counters(ST.scan(spark, d, "events"), "event_type"), "update"), "event_type").select("event_type", "n")


@query(name="construct")
def construct(spark, d):
    """The construction pipeline's stages."""
    raw = table(spark, d, "documents", "doc_id", "raw_id", "author", "text", "lang", "source", "genre")
    return pipelines.construct(raw, 600_000).stages


@query(name="merge_phases")
def merge_phases(spark, d):
    p = labelled(spark, d, "doc_id", "author_id", "text", "language", "source", "genre").withColumnRenamed("language", "lang")
    two = F.coalesce(F.col("source").contains("_crawl"), F.lit(False))
    m = pipelines.merge(p.where(~two), p.where(two))
    return m.select("new_id", "doc_id", "author_id", "phase", "split", "retrieval_role")


@query(name="score_pipeline")
def score_pipeline(spark, d):
    mean, eer, auc = pipelines.score(scored(spark, d))
    return mean.crossJoin(eer.select("eer")).crossJoin(auc.select("roc_auc"))  # one row each


@query(name="audit_pipeline")
def audit_pipeline(spark, d):
    from .audits import candidates, pairs, split_table

    q = split_table(spark, d).select(F.col("doc_id").alias("query_id"), "lang", "primary_genre", "genre", "source", "length_bucket")
    return pipelines.audit_split(stash(pairs(spark, d).join(q, "query_id", "left"), "pairs"), stash(candidates(spark, d), "candidates"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS n_keys FROM events WHERE props IS NOT NULL")
def json_fields(spark, d):
    e = table(spark, d, "events", "event_id", "props").where("props is not null")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).cast("bigint").alias("n_keys"))


@query(f"SELECT metadata['dataset'] AS dataset, count(*) AS n_docs, sum((map_contains(metadata, 'chunk_tokens'))::INT)::BIGINT AS n_chunks FROM processed_documents GROUP BY ALL")
def metadata_map(spark, d):
    m = docs(spark, d, "metadata")
    return m.groupBy(F.element_at("metadata", "dataset").alias("dataset")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.map_contains_key("metadata", "chunk_tokens"), F.lit(False)).cast("int")).alias("n_chunks"))
