"""Topic pools, phase and stratified samples, pair studies, comparisons, leaderboards of real scorers, round trips."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit as A
from ..operators import lexical, sampling, stats
from ..operators import leaderboard as B
from ..operators import scoring as S
from ..operators import studies as U
from ..operators import vectors as V
from ..registry import SQL, query
from ..session import stash, table, workdir
from ..sources import readers, writers
from .audits import candidates, pairs, split_table
from .corpus import P, labelled
from .duplicates import _FOLDED
from .lexicon import _AUTHOR, _HASHED, at_scores, best, tfidf_space
from .metrics import _PER_QUERY, _SCORED, auc_sql, eer_sql, scored
from .rows import docs

SEED = 42

# -- topic pools

_TOPIC = "label % 3"
_POOLED = _SCORED.replace("s AS (SELECT", "s0 AS (SELECT") + f""",
s1 AS (SELECT s0.* FROM s0 JOIN embeddings q ON q.vec_id = query_id JOIN embeddings c ON c.vec_id = candidate_id WHERE q.{_TOPIC} = c.{_TOPIC}),
s AS (SELECT * FROM s1 WHERE positive UNION ALL SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY positive DESC, md5('{SEED}:' || query_id || ':' || candidate_id), candidate_id) AS r FROM s1) WHERE r <= 60 AND NOT positive)"""


def _topic_scored(spark, d):
    """Pairs of one topic (a third of the labels), the pool of each query capped at 60."""
    s = scored(spark, d)
    of = table(spark, d, "embeddings", "vec_id", "label").select("vec_id", F.expr(_TOPIC).alias("topic"))
    same = s.join(of.toDF("query_id", "tq"), "query_id").join(of.toDF("candidate_id", "tc"), "candidate_id").where("tq = tc").drop("tq", "tc")
    return U.capped_pool(stash(same, "topic-scored"), 60, SEED)


_RANKED = _PER_QUERY.replace(_SCORED, _POOLED)


@query(f"WITH {_RANKED.replace('any_value(query_label) AS query_label, count', 'any_value(query_label) AS qlabel, count').replace('any_value(query_label) AS query_label, any_value(n_c', 'any_value(n_c')} SELECT * FROM m")
def topic_pool_ranking(spark, d):
    return S.ranking(stash(_topic_scored(spark, d), "pooled"))


@query(f"WITH {_POOLED}, {eer_sql('s')}")
def topic_pool_eer(spark, d):
    return S.eer(S.by_score(_topic_scored(spark, d)))


# -- samples

_PHASES = {"phase1": 0.6, "phase2": 0.4}


@query(f"""
WITH s AS (SELECT DISTINCT doc_id, phase, lang FROM split_documents), r AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY md5('{SEED}:' || doc_id), doc_id) AS r FROM s)
SELECT doc_id, phase, lang FROM r WHERE r <= CASE phase {' '.join(f"WHEN '{k}' THEN {v}" for k, v in sampling.targets_of(300, _PHASES).items())} ELSE 0 END""")
def phase_share_sample(spark, d):
    s = table(spark, d, "split_documents", "doc_id", "phase", "lang").distinct()
    return U.phase_sample(s, "phase", "doc_id", 300, _PHASES, SEED)


@query(name="stratified_sample")
def stratified_sample(spark, d):
    p = labelled(spark, d, "doc_id", "language", "primary_genre")
    return U.stratified_sample(p, ["language", "primary_genre"], "doc_id", 400, SEED)


# -- topics


def _clusters(spark, d):
    p = labelled(spark, d, "doc_id", "text", "language", "primary_genre")
    return A.topic_clusters(p, "doc_id", "text", ["language", "primary_genre"]).select("doc_id", "topic_cluster", F.concat_ws("/", "language", "primary_genre", F.col("topic_cluster").cast("string")).alias("topic"))


@query(name="topic_shortcut")
def topic_shortcut(spark, d):
    """How far language, genre and topic cluster give the author away, and how often a positive shares the topic."""
    t = stash(_clusters(spark, d).select("doc_id", "topic"), "topic-of")
    q = split_table(spark, d).select(F.col("doc_id").alias("query_id"), "lang").join(t.withColumnRenamed("doc_id", "query_id"), "query_id", "left")
    c = candidates(spark, d).join(t, "doc_id", "left")
    rows = A.scheme_rows(stash(pairs(spark, d).join(q, "query_id", "left"), "topic-pairs"), stash(c, "topic-candidates"), "topic", ["topic"])
    both = pairs(spark, d).join(t.toDF("query_id", "x"), "query_id", "left").join(t.toDF("positive_id", "y"), "positive_id", "left")
    same = both.agg((F.avg(F.coalesce(F.col("x") == F.col("y"), F.lit(False)).cast("double")) * 100).alias("pct_same_topic"))
    return A.scheme_summary(rows).crossJoin(same)  # one row each


_TOP = f"""{_HASHED}, s AS (SELECT q.doc_id AS query_id, r.doc_id AS candidate_id, round(sum(q.weight * r.weight), 6) AS score FROM v q JOIN v r ON q.term = r.term AND q.doc_id % 50 = 0 AND q.doc_id <> r.doc_id GROUP BY ALL),
t AS (SELECT query_id, candidate_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM s) WHERE rank <= 10),
k AS (SELECT t.*, CASE WHEN coalesce(q.author = c.author, false) THEN 'same_author' ELSE 'other_author' END || '_' || CASE WHEN coalesce(lower(trim(q.source)) = lower(trim(c.source)), false) THEN 'same_source' ELSE 'other_source' END AS kind FROM t JOIN documents q ON q.doc_id = query_id JOIN documents c ON c.doc_id = candidate_id)"""


def _kinds(spark, d):
    top = best(spark, d, V.hashed_space(lexical.FEATURES)).drop("rank")
    m = table(spark, d, "documents", "doc_id", "author", "source").select("doc_id", "author", F.lower(F.trim("source")).alias("source"))
    j = top.join(m.toDF("query_id", "qa", "qs"), "query_id").join(m.toDF("candidate_id", "ca", "cs"), "candidate_id")
    return j.select("query_id", "candidate_id", "score", U.pair_kind(F.col("qa") == F.col("ca"), F.col("qs") == F.col("cs")).alias("kind"))


@query(f"WITH {_TOP} SELECT kind, count(*) AS n_pairs, avg(score) AS mean_score, quantile_cont(score, 0.9) AS p90_score FROM k GROUP BY ALL")
def near_pair_kinds(spark, d):
    return U.kind_summary(_kinds(spark, d), "kind")


@query(f"WITH {_TOP} SELECT kind, place::INT AS place, query_id, candidate_id, score FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, query_id, candidate_id) AS place FROM k) WHERE place <= 3")
def near_pair_examples(spark, d):
    return U.top_examples(_kinds(spark, d), ["kind"], [F.desc("score"), "query_id", "candidate_id"]).select("kind", "place", "query_id", "candidate_id", "score")


# -- scorers, evaluated and compared

_HASHED_ALL = f"{_HASHED}, s AS (SELECT q.doc_id AS query_id, r.doc_id AS candidate_id, sum(q.weight * r.weight) AS score FROM v q JOIN v r ON q.term = r.term AND q.doc_id % 50 = 0 AND q.doc_id <> r.doc_id GROUP BY ALL)," + _AUTHOR + """,
every AS (SELECT round(score, 6) AS score, positive FROM sp UNION ALL SELECT 0.0, coalesce(q.author = r.author, false) FROM a q JOIN a r ON q.doc_id % 50 = 0 AND q.doc_id <> r.doc_id ANTI JOIN s ON s.query_id = q.doc_id AND s.candidate_id = r.doc_id)"""


@query(f"WITH {_HASHED_ALL}, {eer_sql('every')}")
def hashed_ngram_eer(spark, d):
    return S.eer(at_scores(spark, d, V.hashed_space(lexical.FEATURES)))


@query(f"WITH {_HASHED_ALL}, {auc_sql('every')}")
def hashed_ngram_roc_auc(spark, d):
    return S.roc_auc(at_scores(spark, d, V.hashed_space(lexical.FEATURES)))


_BOARD = " UNION ALL ".join(f"SELECT '{m}' AS model, '{k}' AS metric, {k} AS value FROM ({SQL[f'{m}_{k}']})" for m in ("tfidf", "hashed_ngram") for k in ("eer", "roc_auc"))


@query(f"""
WITH b AS ({_BOARD}), g AS (SELECT *, CASE WHEN metric = 'eer' THEN -value ELSE value END AS good FROM b)
SELECT metric, model, value, dense_rank() OVER (PARTITION BY metric ORDER BY good DESC)::INT AS place FROM g""")
def scorer_leaderboard(spark, d):
    """The lexical scorers of this library by their own verification results."""
    long = None
    for name, space in (("tfidf", tfidf_space(spark, d)), ("hashed_ngram", V.hashed_space(lexical.FEATURES))):
        g = at_scores(spark, d, space)
        both = S.eer(g).select(F.lit("eer").alias("metric"), F.col("eer").alias("value")).unionByName(S.roc_auc(g).select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")))
        both = both.withColumn("model", F.lit(name))
        long = both if long is None else long.unionByName(both)
    return B.top_two(long).select("metric", "model", "value", "place")


_RP = """r AS (SELECT source AS model, genre AS bucket, count(*) AS n_queries, count(*)::DOUBLE AS num_docs, min(token_length)::DOUBLE AS min_length, max(token_length)::DOUBLE AS max_length, avg(token_length) AS mean_length FROM split_documents GROUP BY ALL),
l AS (SELECT model, bucket, n_queries, unnest(['num_docs', 'min_length', 'max_length', 'mean_length']) AS metric, unnest([num_docs, min_length, max_length, mean_length]) AS value FROM r)"""


@query(f"WITH {_RP} SELECT model, metric, split_part(bucket, '/', 1) AS primary_genre, sum(n_queries)::BIGINT AS n_queries, CASE metric WHEN 'num_docs' THEN sum(value) WHEN 'min_length' THEN min(value) WHEN 'max_length' THEN max(value) ELSE sum(value * n_queries) / sum(n_queries) END AS value FROM l GROUP BY model, metric, split_part(bucket, '/', 1)")
def genre_rollup_pools(spark, d):
    s = table(spark, d, "split_documents", "source", "genre", "token_length").groupBy(F.col("source").alias("model"), F.col("genre").alias("bucket"))
    n = F.col("token_length")
    r = s.agg(F.count(F.lit(1)).alias("n_queries"), F.count(F.lit(1)).cast("double").alias("num_docs"), F.min(n).cast("double").alias("min_length"), F.max(n).cast("double").alias("max_length"), F.avg(n).alias("mean_length"))
    return B.rollup_genre(r.unpivot(["model", "bucket", "n_queries"], ["num_docs", "min_length", "max_length", "mean_length"], "metric", "value"))


# -- comparisons

_FIELDS = ["lang", "genre", "source", "split"]
_SIDE = "SELECT phase, " + "unnest(['" + "', '".join(_FIELDS) + "']) AS field, unnest([" + ", ".join(_FIELDS) + "]) AS value FROM (SELECT DISTINCT * FROM split_documents)"


@query(f"""
WITH u AS ({_SIDE}), n AS (SELECT phase, field, value, count(*) AS n FROM u GROUP BY ALL), p AS (SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY phase, field) AS pct FROM n WHERE phase IN ('phase1', 'phase2'))
SELECT field, value, {', '.join(f"coalesce(sum(CASE WHEN phase = '{k}' THEN n END), 0)::BIGINT AS n_{k}, coalesce(sum(CASE WHEN phase = '{k}' THEN pct END), 0.0) AS pct_{k}" for k in ('phase1', 'phase2'))} FROM p GROUP BY field, value""")
def side_by_side(spark, d):
    s = table(spark, d, "split_documents").distinct()
    return U.side_by_side({k: s.where(F.col("phase") == k) for k in ("phase1", "phase2")}, _FIELDS)


@query("""
WITH s AS (SELECT DISTINCT * FROM split_documents), q AS (SELECT author_id, phase, count(*) AS n FROM s GROUP BY ALL)
SELECT s.phase, count(*) AS n_docs, count(DISTINCT author_id) AS n_authors, count(DISTINCT lang) AS n_langs, count(DISTINCT genre) AS n_genres, count(DISTINCT source) AS n_sources, avg(token_length) AS mean_length,
 sum((retrieval_role = 'query')::INT)::BIGINT AS n_queries, sum((retrieval_role = 'candidate')::INT)::BIGINT AS n_candidates FROM s GROUP BY s.phase""")
def benchmark_summary(spark, d):
    s = table(spark, d, "split_documents").distinct()
    role = lambda r: F.sum((F.col("retrieval_role") == r).cast("int"))
    return s.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n_docs"), F.countDistinct("author_id").alias("n_authors"), F.countDistinct("lang").alias("n_langs"), F.countDistinct("genre").alias("n_genres"), F.countDistinct("source").alias("n_sources"),
        F.avg("token_length").alias("mean_length"), role("query").alias("n_queries"), role("candidate").alias("n_candidates"),
    )


@query(f"""
WITH c AS (SELECT author_id, primary_genre, count(*) AS n FROM {P} WHERE author_id IS NOT NULL AND primary_genre IS NOT NULL GROUP BY ALL), p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY author_id) AS p FROM c),
e AS (SELECT author_id, sum(-p * log2(p)) AS entropy FROM p GROUP BY ALL), t AS (SELECT author_id, count(*) AS n_docs, avg(token_length) AS mean_length FROM {P} WHERE author_id IS NOT NULL GROUP BY ALL),
m AS (SELECT author_id, source FROM (SELECT author_id, source, row_number() OVER (PARTITION BY author_id ORDER BY count(*) DESC, source) AS r FROM {P} WHERE author_id IS NOT NULL GROUP BY author_id, source) WHERE r = 1)
SELECT author_id, entropy, n_docs, mean_length, source FROM e LEFT JOIN t USING (author_id) LEFT JOIN m USING (author_id)""")
def entropy_with_author(spark, d):
    p = labelled(spark, d, "author_id", "primary_genre", "token_length", "source")
    e = stats.entropy(p, "author_id", "primary_genre").select("author_id", "entropy")
    t = p.where("author_id is not null").groupBy("author_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("token_length").alias("mean_length"))
    return e.join(t, "author_id", "left").join(stats.majority(p, "author_id", "source").drop("n"), "author_id", "left")


# -- de-duplication reports


@query(name="dedup_summary")
def dedup_summary(spark, d):
    """Documents before and after each step: exact texts, near documents; and authors near a stronger one."""
    from .duplicates import author_near_dedup, near_dedup

    p = docs(spark, d, "doc_id", "text", "author_id")
    near = stash(near_dedup(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n")), "near-status")
    dropped = F.coalesce(F.sum(F.when(F.col("status") == "dropped", F.col("n"))), F.lit(0))
    a = author_near_dedup(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    exact = p.agg(F.count(F.lit(1)).alias("n_in")).crossJoin(near.agg(F.sum("n").alias("left")))  # one row each
    return exact.select(F.lit("exact").alias("step"), "n_in", (F.col("n_in") - F.col("left")).alias("n_dropped")).unionByName(near.agg(F.sum("n").alias("n_in"), dropped.alias("n_dropped")).withColumn("step", F.lit("near"))).unionByName(
        p.where("author_id is not null").agg(F.countDistinct("author_id").alias("n_in")).crossJoin(a.agg(dropped.alias("n_dropped"))).withColumn("step", F.lit("near_author"))
    )


@query(f"""
WITH k AS (SELECT doc_id, author_id, {_FOLDED} AS k FROM processed_documents WHERE text IS NOT NULL), g AS (SELECT k, min(doc_id) AS kept, count(*) AS n_copies, count(DISTINCT author_id) AS n_authors FROM k GROUP BY k HAVING count(*) > 1),
r AS (SELECT CASE WHEN n_authors > 1 THEN 'across_authors' ELSE 'within_author' END AS reason, kept, n_copies FROM g)
SELECT reason, place::INT AS place, kept, n_copies FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY n_copies DESC, kept) AS place FROM r) WHERE place <= 3""")
def dedup_examples(spark, d):
    k = docs(spark, d, "doc_id", "author_id", "text").where("text is not null").select("doc_id", "author_id", X.text_key("text").alias("k")).where("k is not null")
    g = k.groupBy("k").agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("n_copies"), F.countDistinct("author_id").alias("n_authors")).where("n_copies > 1")
    r = g.select(F.when(F.col("n_authors") > 1, "across_authors").otherwise("within_author").alias("reason"), "kept", "n_copies")
    return U.top_examples(r, ["reason"], [F.desc("n_copies"), "kept"])


# -- training


@query(f"WITH {_SCORED}, x AS (SELECT *, exp(score / 0.07::DOUBLE) AS e FROM s), q AS (SELECT query_id, sum(CASE WHEN positive THEN e END) AS p, sum(e) AS t FROM x GROUP BY ALL), c AS (SELECT candidate_id, sum(CASE WHEN positive THEN e END) AS p, sum(e) AS t FROM x GROUP BY ALL), ql AS (SELECT count(*) AS n_queries, avg(-ln(p / t)) AS query_loss FROM q WHERE p IS NOT NULL), cl AS (SELECT count(*) AS n_candidates, avg(-ln(p / t)) AS candidate_loss FROM c WHERE p IS NOT NULL) SELECT *, (query_loss + candidate_loss) / 2 AS loss FROM ql, cl")
def symmetric_contrastive_loss(spark, d):
    return U.symmetric_info_nce(stash(scored(spark, d), "scored"))


@query(f"WITH {_SCORED}, q AS (SELECT query_id, avg(CASE WHEN positive THEN score / 0.07::DOUBLE END) AS s, ln(sum(exp(score / 0.07::DOUBLE))) AS t FROM s GROUP BY ALL) SELECT count(*) AS n_queries, avg(t - s) AS loss FROM q WHERE s IS NOT NULL")
def supervised_contrastive_loss(spark, d):
    return U.supervised_contrastive(scored(spark, d))


_DRAW = "('0x' || substr(md5('42:' || {}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"""
WITH r AS (SELECT doc_id, author_id, row_number() OVER (PARTITION BY author_id ORDER BY md5('42:' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY author_id) AS n FROM processed_documents WHERE author_id IS NOT NULL),
a AS (SELECT author_id, n, greatest(1, ceil(pow({_DRAW.format('author_id')}, 1.0::DOUBLE / 3.0::DOUBLE) * 8))::BIGINT AS size FROM r WHERE i = 1), p AS (SELECT author_id, n, unnest(range(1, size + 1)) AS place FROM a)
SELECT p.author_id, place::INT AS place, doc_id FROM p JOIN r ON r.author_id = p.author_id AND r.i = floor({_DRAW.format("(p.author_id || ':' || place)")} * p.n)::BIGINT + 1""")
def training_episodes(spark, d):
    return U.episodes(docs(spark, d, "author_id", "doc_id"), "author_id", "doc_id", 8, SEED)


# -- catalogue rows and multi-valued fields, on rows made from the documents' own columns

_WANTED = ["en", "fr", "de", "zh"]


@query(f"""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'Sound' ELSE ' Text' END AS kind, CASE WHEN doc_id % 11 = 0 THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS number, coalesce(lang, '') || '; EN' AS languages, coalesce(author, ' ') || ';' || coalesce(source, '') AS authors FROM documents),
e AS (SELECT *, list_filter(list_transform(string_split(languages, ';'), lambda x: lower(trim(x))), lambda x: x IN ({', '.join(f"'{x}'" for x in _WANTED)}))[1] AS l, list_filter(list_transform(string_split(authors, ';'), lambda x: trim(x)), lambda x: x <> '')[1] AS a FROM c)
SELECT number AS id, l AS lang, a AS author FROM e WHERE kind = ' Text' AND regexp_full_match(number, '[0-9]+') AND l IS NOT NULL AND a IS NOT NULL""")
def catalogue_acceptance(spark, d):
    t = table(spark, d, "documents", "doc_id", "lang", "author", "source")
    c = t.select(
        F.when(F.col("doc_id") % 9 == 0, "Sound").otherwise(" Text").alias("kind"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("x"), "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("number"),
        F.concat(F.coalesce("lang", F.lit("")), F.lit("; EN")).alias("languages"), F.concat(F.coalesce("author", F.lit(" ")), F.lit(";"), F.coalesce("source", F.lit(""))).alias("authors"),
    )
    e = c.select(X.catalogue_entry(F.col("kind"), F.col("number"), F.col("languages"), F.col("authors"), _WANTED).alias("e"))
    return e.where("e is not null").select("e.*")


@query("""
WITH v AS (SELECT doc_id, coalesce(nullif(array_to_string(list_filter([trim(author), trim(genre)], lambda x: x <> ''), ', '), ''), nullif(trim(source), '')) AS value FROM documents) SELECT doc_id, value FROM v""")
def multi_valued_field(spark, d):
    t = table(spark, d, "documents", "doc_id", "author", "genre", "source")
    return t.select("doc_id", X.flat_values(F.array("author", "genre"), F.array("source")).alias("value"))


# -- round trips: written, read back

_TRIP = "SELECT doc_id, author_id, lang, genre, source, token_length::VARCHAR AS token_length, split, retrieval_role FROM split_documents"
_COLUMNS = ["doc_id", "author_id", "lang", "genre", "source", "token_length", "split", "retrieval_role"]


def _trip(spark, d):
    return table(spark, d, "split_documents", *_COLUMNS), f"{workdir(spark)}/skein/trip-{uuid.uuid4().hex}"


@query(_TRIP)
def jsonl_round_trip(spark, d):
    df, path = _trip(spark, d)
    writers.jsonl(df, path)
    return readers.jsonl(spark, path, _COLUMNS)


@query("SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in _COLUMNS) + f" FROM ({_TRIP})")
def csv_round_trip(spark, d):
    """CSV has one form for null and for an empty text: both come back as null."""
    df, path = _trip(spark, d)
    writers.csv(df, path)
    return readers.delimited(spark, path, _COLUMNS, ",")


@query("SELECT doc_id::VARCHAR AS raw_id, author, text, coalesce(nullif(lower(trim(lang)), ''), 'unknown') AS lang, genre, 'trip' AS source FROM documents WHERE text IS NOT NULL AND author IS NOT NULL")
def loader_round_trip(spark, d):
    """Documents written as JSON lines and read through a manifest entry to the raw schema."""
    t = table(spark, d, "documents", "doc_id", "author", "text", "lang", "genre")
    path = f"{workdir(spark)}/skein/trip-{uuid.uuid4().hex}"
    writers.jsonl(t, path)
    entry = {"name": "trip", "loader": "jsonl", "path": path, "raw_id_field": "doc_id", "lang_field": "lang", "genre_field": "genre"}
    return readers.load(spark, readers.manifest(json.dumps([entry]))[0]).select("raw_id", "author", "text", "lang", "genre", "source")
