"""Lexical scorers. Searches take as queries the documents whose id 50 divides, against all documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..operators import lexical as L
from ..operators import scoring as S
from ..operators import vectors as V
from ..registry import query
from ..session import spread, stash, table
from .metrics import auc_sql, eer_sql
from .rows import TOKENS, WS

_WORDS = "w AS (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '" + WS + "+'), lambda t: t <> '')) || ' ' AS w FROM documents)"
_GRAMS = _WORDS + """,
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(length(w) - n + 1, 1)::BIGINT + 1), lambda p: substring(w, p, n))) AS term FROM w, (SELECT unnest([3, 4, 5]) AS n) WHERE length(w) > CASE n WHEN 3 THEN 0 ELSE n - 1 END),
c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL)"""


def counts(spark, d):
    docs = spread(table(spark, d, "documents", "doc_id", "text"), "doc_id")
    return L.term_counts(docs.where("text is not null"), "doc_id", L.padded_grams(F.col("text")))


@query(f"WITH {_GRAMS}, d AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM c GROUP BY ALL) SELECT df, count(*) AS n_terms, sum(tf)::BIGINT AS n_occurrences FROM d GROUP BY ALL")
def charwb_df(spark, d):
    t = counts(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    return t.groupBy("df").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_occurrences"))


_TFIDF = _GRAMS + """,
f AS (SELECT term, count(*) AS df FROM c GROUP BY ALL HAVING count(*) >= 2), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM c JOIN f USING (term), n),
v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM x)"""


def weights(spark, d):
    return L.tfidf(stash(counts(spark, d), "counts"), "doc_id", table(spark, d, "documents", "doc_id").count())


@query(f"WITH {_TFIDF} SELECT doc_id, count(*) AS n_terms, round(max(weight), 6) AS top_weight, round(sum(weight), 4) AS total_weight FROM v GROUP BY ALL")
def tfidf_weights(spark, d):
    w = weights(spark, d)
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("weight"), 6).alias("top_weight"), F.round(F.sum("weight"), 4).alias("total_weight"))


_PAIRS = _TFIDF + ", s AS (SELECT q.doc_id AS query_id, r.doc_id AS candidate_id, sum(q.weight * r.weight) AS score FROM v q JOIN v r ON q.term = r.term AND q.doc_id % 50 = 0 AND q.doc_id <> r.doc_id GROUP BY ALL)"


def lexical_rows(spark, d):
    """(doc_id, author, words) of the documents with text: rows, and as doc_id % 50 = 0 queries, of the all-pairs scorers."""
    return V.tokens_of(spread(table(spark, d, "documents", "doc_id", "text", "author"), "doc_id"), "doc_id", "text", "author")


def tfidf_space(spark, d):
    return V.tfidf_space(lexical_rows(spark, d), table(spark, d, "documents", "doc_id").count())


def best(spark, d, space, k=10):
    """The ``k`` best candidates of each query: query_id, candidate_id, score, rank."""
    rows = lexical_rows(spark, d)
    found = V.best(rows, rows.where("doc_id % 50 = 0"), space, k)
    return S.topk(found.withColumn("score", F.round("score", 6)), k).select("query_id", "candidate_id", "score", "rank")


def at_scores(spark, d, space):
    """by_score rows of all query-document pairs."""
    rows = lexical_rows(spark, d)
    return with_zeros(spark, d, V.at_scores(rows, rows.where("doc_id % 50 = 0"), space))


@query(f"WITH {_PAIRS}, t AS (SELECT query_id, candidate_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, candidate_id) AS rank FROM s) SELECT query_id, candidate_id, score, rank::INT AS rank FROM t WHERE rank <= 10")
def tfidf_cosine(spark, d):
    return best(spark, d, tfidf_space(spark, d))


_AUTHOR = """
a AS (SELECT doc_id, author FROM documents),
z AS (SELECT query_id, sum(p)::BIGINT AS p, sum(k)::BIGINT AS k FROM (SELECT q.doc_id AS query_id, CASE WHEN q.author = r.author THEN 1 ELSE 0 END AS p, 1 AS k FROM a q JOIN a r ON q.doc_id % 50 = 0 AND q.doc_id <> r.doc_id) GROUP BY ALL),
sp AS (SELECT s.*, coalesce(q.author = r.author, false) AS positive FROM s JOIN a q ON s.query_id = q.doc_id JOIN a r ON s.candidate_id = r.doc_id)"""


def with_zeros(spark, d, have):
    """by_score rows of all query-document pairs from those of some: the others stand as one block at score 0. They are at
    most a row for each rounded score, in one partition: what ranks them shuffles nothing."""
    a = table(spark, d, "documents", "doc_id", "author")
    per = a.where("author is not null").groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    n = a.count()
    q = a.where("doc_id % 50 = 0").join(per, "author", "left").agg(F.sum(F.coalesce(F.col("n") - 1, F.lit(0))).alias("p"), F.count(F.lit(1)).alias("q"))
    have = stash(have, "scores").where("score <> 0")
    rest = q.crossJoin(have.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("hp"), F.coalesce(F.sum("n"), F.lit(0)).alias("hn")))  # one row each
    zero = rest.select(F.lit(0.0).alias("score"), (F.col("p") - F.col("hp")).alias("p"), (F.col("q") * (n - 1) - F.col("p") - F.col("hn")).alias("n"))
    return have.unionByName(stash(zero, "zeros")).coalesce(1)


_ALL_SCORES = _PAIRS + "," + _AUTHOR + """,
al AS (SELECT round(score, 6) AS score, positive FROM sp UNION ALL SELECT 0.0, coalesce(q.author = r.author, false) FROM a q JOIN a r ON q.doc_id % 50 = 0 AND q.doc_id <> r.doc_id ANTI JOIN s ON s.query_id = q.doc_id AND s.candidate_id = r.doc_id)"""


@query(f"WITH {_ALL_SCORES}, {eer_sql('al')}")
def tfidf_eer(spark, d):
    return S.eer(at_scores(spark, d, tfidf_space(spark, d)))


@query(f"WITH {_ALL_SCORES}, {auc_sql('al')}")
def tfidf_roc_auc(spark, d):
    return S.roc_auc(at_scores(spark, d, tfidf_space(spark, d)))


_HASHED = _GRAMS.replace("\nc AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL)", f"""
tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{WS}+'), lambda t: t <> '') AS t FROM documents WHERE text IS NOT NULL),
al AS (SELECT doc_id, term FROM g UNION ALL SELECT doc_id, 'w:' || unnest(t) FROM tk UNION ALL SELECT doc_id, 'w:' || unnest(list_transform(list_zip(t[:-2], t[2:]), lambda p: p[1] || ' ' || p[2])) FROM tk WHERE len(t) > 1),
cc AS (SELECT doc_id, term, count(*) AS tf FROM al GROUP BY ALL),
h AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 65536 AS term, sum(tf)::BIGINT AS tf FROM cc GROUP BY ALL),
v AS (SELECT doc_id, term, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS weight FROM h)""")


@query(f"WITH {_HASHED}, s AS (SELECT q.doc_id AS query_id, r.doc_id AS candidate_id, round(sum(q.weight * r.weight), 6) AS score FROM v q JOIN v r ON q.term = r.term AND q.doc_id % 50 = 0 AND q.doc_id <> r.doc_id GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM s) SELECT query_id, candidate_id, score, rank::INT AS rank FROM t WHERE rank <= 10")
def hashed_ngram_cosine(spark, d):
    return best(spark, d, V.hashed_space(L.FEATURES))


_POS = "pr AS (SELECT query_id, unnest(positive_ids) AS candidate_id FROM query_positives)"
_ENTROPY = f"""
{_POS}, ids AS (SELECT DISTINCT query_id, candidate_id FROM pr), t AS (SELECT doc_id, text FROM processed_documents WHERE length(text) > 4),
g AS (SELECT doc_id, unnest(list_transform(range(1, length(text)::BIGINT - 3), lambda p: substring(text, p, 5))) AS term FROM t),
c0 AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), c AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 8192 AS term, sum(tf)::BIGINT AS tf FROM c0 GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY ALL),
k AS (SELECT query_id, candidate_id, sum(q.tf * (ln(r.tf + 0.5::DOUBLE) - ln(0.5::DOUBLE))) AS f, sum(r.tf * (ln(q.tf + 0.5::DOUBLE) - ln(0.5::DOUBLE))) AS b FROM ids JOIN c q ON q.doc_id = query_id JOIN c r ON r.doc_id = candidate_id AND r.term = q.term GROUP BY ALL),
j AS (SELECT ids.*, coalesce(f, 0) AS f, coalesce(b, 0) AS b, greatest(coalesce(nq.n, 1), 1) AS nq, greatest(coalesce(nc.n, 1), 1) AS nc FROM ids LEFT JOIN k USING (query_id, candidate_id) LEFT JOIN n nq ON nq.doc_id = query_id LEFT JOIN n nc ON nc.doc_id = candidate_id),
e AS (SELECT query_id, candidate_id, -(ln(0.5::DOUBLE) - ln(nc + 4096.0::DOUBLE) + f / nq) AS forward, -(ln(0.5::DOUBLE) - ln(nq + 4096.0::DOUBLE) + b / nc) AS backward FROM j)"""


def positive_pairs(spark, d):
    return table(spark, d, "query_positives", "query_id", "positive_ids").select("query_id", F.explode("positive_ids").alias("candidate_id"))


@query(f"WITH {_ENTROPY} SELECT *, (forward + backward) / 2 AS mean_entropy, abs(forward - backward) AS gap FROM e")
def compression_entropy(spark, d):
    return L.cross_entropy(positive_pairs(spark, d), table(spark, d, "processed_documents", "doc_id", "text"), "doc_id", "text")


def _feature_pairs(spark, d):
    """Positive pairs and as many negatives: each query with the next query's positive of another author, by hash."""
    qp = table(spark, d, "query_positives")
    pos = qp.select("query_id", F.element_at("positive_ids", 1).alias("candidate_id"), "author_id")
    u = X.shuffle_key(42, F.col("query_id"))
    part = F.pmod(X.md5_int(F.col("query_id"), 8), F.lit(16))
    neg = pos.withColumn("p", part)
    w = W.partitionBy("p").orderBy(u, "query_id")
    neg = neg.select("query_id", F.lead("candidate_id").over(w).alias("candidate_id"), "author_id", F.lead("author_id").over(w).alias("other")).where("other <> author_id")
    return pos.select("query_id", "candidate_id", F.lit(1).alias("label")).unionByName(neg.select("query_id", "candidate_id", F.lit(0).alias("label")))


_SURFACE_SQL = f"""
f AS (SELECT doc_id, length(text)::DOUBLE AS chars, len({TOKENS})::DOUBLE AS tokens, len(regexp_extract_all(text, '{X.SYMBOL}'))::DOUBLE / greatest(length(text), 1) AS punctuation, len(regexp_extract_all(text, '\\p{{Nd}}'))::DOUBLE / greatest(length(text), 1) AS digits,
 len(regexp_extract_all(text, '\\p{{Lu}}'))::DOUBLE / greatest(length(text), 1) AS upper, len(regexp_extract_all(text, '{WS}'))::DOUBLE / greatest(length(text), 1) AS spaces,
 CASE WHEN len({TOKENS}) > 0 THEN (length(text) - len(regexp_extract_all(text, '{WS}')))::DOUBLE / len({TOKENS}) ELSE 0.0 END AS token_length FROM (SELECT doc_id, coalesce(text, '') AS text FROM processed_documents))"""


@query(f"""
WITH pos AS (SELECT query_id, positive_ids[1] AS candidate_id, author_id, ('0x' || substr(md5(query_id), 1, 8))::BIGINT % 16 AS p FROM query_positives),
ng AS (SELECT query_id, lead(candidate_id) OVER w AS candidate_id, author_id, lead(author_id) OVER w AS other FROM pos WINDOW w AS (PARTITION BY p ORDER BY md5('42:' || query_id), query_id)),
pr AS (SELECT query_id, candidate_id, 1 AS label FROM pos UNION ALL SELECT query_id, candidate_id, 0 FROM ng WHERE other <> author_id), {_SURFACE_SQL}
SELECT query_id, candidate_id, label, {', '.join(f"least(q.{c}, r.{c}) / greatest(q.{c}, r.{c}, 1.0::DOUBLE) AS s_{c}" for c in L.SURFACE[:2])}, {', '.join(f"least(greatest(1 - abs(q.{c} - r.{c}), 0), 1) AS s_{c}" for c in L.SURFACE[2:])}
FROM pr JOIN f q ON q.doc_id = query_id JOIN f r ON r.doc_id = candidate_id""")
def pair_features(spark, d):
    f = table(spark, d, "processed_documents", "doc_id", "text").select("doc_id", *X.surface("text"))
    return L.surface_similarity(_feature_pairs(spark, d), f, "doc_id")


@query(name="pair_calibrator")
def pair_calibrator(spark, d):
    """Surface and entropy features, fitted and folded to one linear score."""
    p = stash(pair_features(spark, d), "pair-features")
    e = L.cross_entropy(p, table(spark, d, "processed_documents", "doc_id", "text"), "doc_id", "text").select("query_id", "candidate_id", "mean_entropy", "gap")
    x = stash(p.join(e, ["query_id", "candidate_id"]), "examples")
    names = [f"s_{n}" for n in L.SURFACE] + ["mean_entropy", "gap"]
    return L.calibrated(x, names, *L.fit_calibrator(x, names)).select("query_id", "candidate_id", "label", F.round("score", 4).alias("score"))
