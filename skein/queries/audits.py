"""Shortcut audit, alignment, topic strata, leaderboards and training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit as A
from ..operators import leaderboard as B
from ..operators import stats
from ..operators import training as T
from ..registry import query
from ..session import stash, table
from .corpus import labelled
from .metrics import _SCORED, scored
from .rows import docs

_BUCKET = "CASE WHEN token_length IS NULL THEN NULL WHEN token_length <= 10 THEN 'short' WHEN token_length <= 100 THEN 'medium' WHEN token_length <= 500 THEN 'long' ELSE 'extra_long' END"
_S = f"s AS (SELECT DISTINCT doc_id, author_id, lang, genre, split_part(genre, '/', 1) AS primary_genre, source, {_BUCKET} AS length_bucket, retrieval_role FROM split_documents)"
_C = _S + ", c AS (SELECT * FROM s WHERE retrieval_role = 'candidate' AND author_id IS NOT NULL), pr AS (SELECT query_id, author_id AS true_author, unnest(positive_ids) AS positive_id FROM query_positives)"


def split_table(spark, d):
    s = table(spark, d, "split_documents", "doc_id", "author_id", "lang", "genre", "source", "token_length", "retrieval_role").distinct()
    return s.withColumn("primary_genre", X.primary("genre")).withColumn("length_bucket", X.length_class("token_length"))


def pairs(spark, d):
    """(query_id, author_id, positive_id)."""
    return table(spark, d, "query_positives").select("query_id", "author_id", F.explode("positive_ids").alias("positive_id"))


def candidates(spark, d):
    return split_table(spark, d).where("retrieval_role = 'candidate' and author_id is not null")


_FIELDS = {"same_language": "lang", "same_primary_genre": "primary_genre", "same_fine_genre": "genre", "same_source": "source", "same_length_bucket": "length_bucket"}


def _aligned(spark, d):
    s = split_table(spark, d)
    q = s.select(F.col("doc_id").alias("query_id"), *[F.col(f).alias(f"q_{f}") for f in _FIELDS.values()])
    c = s.select(F.col("doc_id").alias("positive_id"), *[F.col(f).alias(f"c_{f}") for f in _FIELDS.values()])
    return pairs(spark, d).join(q, "query_id", "left").join(c, "positive_id", "left")


_AL = "al AS (SELECT pr.*, " + ", ".join(f"coalesce(q.{f} = k.{f}, false) AS {m}" for m, f in _FIELDS.items()) + ", q.lang FROM pr LEFT JOIN s q ON q.doc_id = query_id LEFT JOIN s k ON k.doc_id = positive_id)"


@query(f"WITH {_C}, {_AL} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS pairs, sum({m}::INT)::BIGINT AS matches, sum({m}::INT) * 100.0::DOUBLE / count(*) AS pct FROM al" for m in _FIELDS))
def pair_alignment(spark, d):
    return stats.flag_rates(_aligned(spark, d), {m: F.col(f"q_{f}") == F.col(f"c_{f}") for m, f in _FIELDS.items()})


@query(f"WITH {_C}, {_AL} SELECT lang, count(*) AS n_pairs, count(DISTINCT query_id) AS n_queries, avg(same_primary_genre::INT) AS same_genre, avg(same_source::INT) AS same_source FROM al GROUP BY ALL")
def pair_summary_by_lang(spark, d):
    flag = lambda f: F.avg(F.coalesce(F.col(f"q_{f}") == F.col(f"c_{f}"), F.lit(False)).cast("double"))
    return _aligned(spark, d).groupBy(F.col("q_lang").alias("lang")).agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("query_id").alias("n_queries"), flag("primary_genre").alias("same_genre"), flag("source").alias("same_source"))


_SPAN = ["lang", "primary_genre", "genre", "source", "length_bucket"]


@query(f"WITH {_C} SELECT author_id, count(*) AS n_docs, {', '.join(f'count(DISTINCT {f}) AS n_{f}' for f in _SPAN)} FROM c GROUP BY ALL")
def author_span(spark, d):
    return A.span(candidates(spark, d), _SPAN)


@query(f"WITH {_C}, x AS (SELECT author_id, {', '.join(f'count(DISTINCT {f}) = 1 AS single_{f}' for f in _SPAN)} FROM c GROUP BY ALL) " + " UNION ALL ".join(f"SELECT 'single_{f}' AS metric, count(*) AS pairs, sum(single_{f}::INT)::BIGINT AS matches, sum(single_{f}::INT) * 100.0::DOUBLE / count(*) AS pct FROM x" for f in _SPAN))
def author_span_summary(spark, d):
    return A.span_summary(A.span(candidates(spark, d), _SPAN), _SPAN)


def _pool_sql(fields: list[str]) -> str:
    f = "".join(f"{x}, " for x in fields)
    part = "PARTITION BY " + ", ".join(fields) if fields else ""
    return f"SELECT {f}author_id, row_number() OVER ({part} ORDER BY m DESC, t DESC, author_id) AS rank, count(*) OVER ({part}) AS pool_size FROM (SELECT {f}author_id, count(*) AS m FROM c GROUP BY ALL) JOIN (SELECT author_id, count(*) AS t FROM c GROUP BY ALL) USING (author_id)"


@query(f"WITH {_C} SELECT lang, genre, author_id, rank::INT AS rank, pool_size FROM ({_pool_sql(['lang', 'genre'])})")
def author_rank_pool(spark, d):
    return A.author_pool(candidates(spark, d), ["lang", "genre"])


def _scheme_sql(name: str, fields: list[str]) -> str:
    on_pool = " AND ".join([*[f"p.{f} = q.{f}" for f in fields], "p.author_id = pr.true_author"])
    size = f"(SELECT {''.join(f'{x}, ' for x in fields)}max(pool_size) AS pool_size FROM p_{name} {'GROUP BY ' + ', '.join(fields) if fields else ''})"
    on_size = " AND ".join(f"z.{f} = q.{f}" for f in fields) or "true"
    return f"SELECT '{name}' AS scheme, query_id, q.lang, coalesce(z.pool_size, 0) AS pool_size, p.rank FROM pr LEFT JOIN s q ON q.doc_id = query_id LEFT JOIN {size} z ON {on_size} LEFT JOIN p_{name} p ON {on_pool}"


_SCHEMES = _C + "".join(f", p_{n} AS ({_pool_sql(f)})" for n, f in A.SCHEMES.items()) + ", r0 AS (" + " UNION ALL ".join(_scheme_sql(n, f) for n, f in A.SCHEMES.items()) + """),
hh AS (SELECT pool_size, list_sum(list_transform(range(1, pool_size + 1), lambda i: 1.0::DOUBLE / i)) / pool_size AS h FROM (SELECT DISTINCT pool_size FROM r0 WHERE pool_size > 0)),
r AS (SELECT r0.*, CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE / pool_size ELSE 0 END AS e1, CASE WHEN rank IS NOT NULL THEN least(5.0::DOUBLE / pool_size, 1) ELSE 0 END AS e5, CASE WHEN rank IS NOT NULL THEN h ELSE 0 END AS em FROM r0 LEFT JOIN hh USING (pool_size))"""


def _summary_sql(by: str = "") -> str:
    return f"""WITH {_SCHEMES} SELECT scheme, {by}count(*) AS n_pairs, avg((pool_size > 0)::INT) * 100 AS pct_pool, avg((rank IS NOT NULL)::INT) * 100 AS pct_covered, avg(pool_size) AS pool_mean, quantile_cont(pool_size, 0.5)::DOUBLE AS pool_median, quantile_cont(pool_size, 0.9)::DOUBLE AS pool_p90, quantile_cont(pool_size, 0.95)::DOUBLE AS pool_p95,
 avg((pool_size <= 1)::INT) * 100 AS pct_le_1, avg((pool_size <= 5)::INT) * 100 AS pct_le_5, avg((pool_size <= 10)::INT) * 100 AS pct_le_10, avg(e1) AS expected_1, avg(e5) AS expected_5, avg(em) AS expected_mrr,
 avg(coalesce((rank = 1)::INT, 0)) AS first_1, avg(coalesce((rank <= 5)::INT, 0)) AS first_5, avg(coalesce(1.0::DOUBLE / rank, 0)) AS first_mrr FROM r GROUP BY ALL"""


def scheme_rows(spark, d):
    s = split_table(spark, d)
    q = s.select(F.col("doc_id").alias("query_id"), "lang", "primary_genre", "genre", "source", "length_bucket")
    p = stash(pairs(spark, d).join(q, "query_id", "left"), "shortcut-pairs")
    c = stash(candidates(spark, d), "candidates")
    out = None
    for name, fields in A.SCHEMES.items():
        r = A.scheme_rows(p, c, name, fields)
        out = r if out is None else out.unionByName(r)
    return out


@query(_summary_sql())
def shortcut_schemes(spark, d):
    return A.scheme_summary(scheme_rows(spark, d))


@query(_summary_sql("lang, "))
def shortcut_by_lang(spark, d):
    return A.scheme_summary(scheme_rows(spark, d), "lang")


@query("SELECT n_positives, count(*) AS n_queries FROM (SELECT query_id, len(positive_ids) AS n_positives FROM query_positives) GROUP BY ALL")
def positives_per_query(spark, d):
    return table(spark, d, "query_positives", "query_id", "positive_ids").groupBy(F.size("positive_ids").cast("bigint").alias("n_positives")).agg(F.count(F.lit(1)).alias("n_queries"))


_POOL = f"""
WITH {_C}, g AS (SELECT primary_genre, count(*) AS n FROM s WHERE retrieval_role = 'candidate' GROUP BY ALL),
x AS (SELECT pr.query_id, q.primary_genre, sum((k.primary_genre = q.primary_genre AND pr.positive_id <> pr.query_id)::INT)::BIGINT AS n_positives FROM pr JOIN s q ON q.doc_id = query_id JOIN s k ON k.doc_id = positive_id GROUP BY ALL)
SELECT query_id, x.primary_genre, n_positives, coalesce(n, 0) AS pool_size FROM x LEFT JOIN g USING (primary_genre) WHERE n_positives > 0"""


@query(_POOL)
def topic_pool(spark, d):
    """Candidates of the query's primary genre; queries all of whose positives lie in other genres are left out."""
    s = split_table(spark, d)
    g = s.where("retrieval_role = 'candidate'").groupBy("primary_genre").agg(F.count(F.lit(1)).alias("pool_size"))
    q, c = s.select(F.col("doc_id").alias("query_id"), "primary_genre"), s.select(F.col("doc_id").alias("positive_id"), F.col("primary_genre").alias("pg"))
    x = pairs(spark, d).join(q, "query_id").join(c, "positive_id").groupBy("query_id", "primary_genre").agg(F.sum(F.coalesce(((F.col("pg") == F.col("primary_genre")) & (F.col("positive_id") != F.col("query_id"))).cast("bigint"), F.lit(0))).alias("n_positives"))
    return x.where("n_positives > 0").join(g, "primary_genre", "left").select("query_id", "primary_genre", "n_positives", F.coalesce("pool_size", F.lit(0)).alias("pool_size"))


_P2 = "(SELECT coalesce(lang, '') AS lang, split_part(lower(trim(genre)), '/', 1) AS pg FROM processed_documents WHERE length(text) > 0)"


@query(f"""
WITH n AS (SELECT lang, pg AS primary_genre, count(*) AS n_docs FROM {_P2} GROUP BY ALL)
SELECT lang, primary_genre, n_docs, CASE WHEN n_docs < 30 THEN 0 ELSE least(greatest(3, least(12, greatest(3, round_even(sqrt(n_docs) / 2, 0)), greatest(3, n_docs // 40))), n_docs) END::INT AS clusters, CASE WHEN n_docs < 30 THEN 'too_small' ELSE 'clustered' END AS status FROM n""")
def topic_strata(spark, d):
    p = docs(spark, d, "lang", "genre", "text").where("length(text) > 0").select(F.coalesce("lang", F.lit("")).alias("lang"), X.primary(F.lower(F.trim("genre"))).alias("primary_genre"))
    return A.strata(p, ["lang", "primary_genre"])


@query(name="topic_clusters")
def topic_clusters(spark, d):
    p = labelled(spark, d, "doc_id", "text", "language", "primary_genre")
    return A.topic_clusters(p, "doc_id", "text", ["language", "primary_genre"])


# -- leaderboards on a long table derived from the split: a model a source, a bucket a genre


_R = """r AS (SELECT source AS model, genre AS bucket, 'recall_5' AS metric, avg((token_length % 100) / 100.0::DOUBLE) AS value, count(*) AS n_queries FROM split_documents GROUP BY ALL
 UNION ALL SELECT source, genre, 'eer', avg((token_length % 37) / 100.0::DOUBLE), count(*) FROM split_documents GROUP BY ALL)"""


def results(spark, d):
    s = table(spark, d, "split_documents", "source", "genre", "token_length").select(F.col("source").alias("model"), F.col("genre").alias("bucket"), "token_length")
    g = s.groupBy("model", "bucket").agg(F.avg(F.col("token_length") % 100 / 100.0).alias("recall_5"), F.avg(F.col("token_length") % 37 / 100.0).alias("eer"), F.count(F.lit(1)).alias("n_queries"))
    return g.select("model", "bucket", F.expr("stack(2, 'recall_5', recall_5, 'eer', eer) as (metric, value)"), "n_queries")


_GOOD = "CASE WHEN metric = 'eer' THEN -value ELSE value END"


@query(f"WITH {_R} SELECT bucket, metric, model, value FROM (SELECT *, row_number() OVER (PARTITION BY bucket, metric ORDER BY {_GOOD} DESC, model DESC) AS r FROM r WHERE value IS NOT NULL) WHERE r = 1")
def best_by_metric(spark, d):
    return B.best_by_metric(results(spark, d), "bucket")


@query(f"WITH {_R} SELECT bucket, metric, model, value, place::INT AS place FROM (SELECT *, dense_rank() OVER (PARTITION BY bucket, metric ORDER BY {_GOOD} DESC) AS place FROM r WHERE value IS NOT NULL) WHERE place <= 2")
def top_two(spark, d):
    return B.top_two(results(spark, d), "bucket")


@query(f"WITH {_R} SELECT CASE WHEN lower(model) LIKE '%tfidf%' OR lower(model) LIKE '%ngram%' OR lower(model) LIKE '%ppm%' THEN 'baseline' WHEN lower(model) LIKE '%e5%' OR lower(model) LIKE '%bge%' THEN 'encoder' WHEN lower(model) LIKE '%llama%' OR lower(model) LIKE '%qwen%' THEN 'decoder' ELSE 'other' END AS family, metric, count(value) AS n_models, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM r GROUP BY ALL")
def by_type_median(spark, d):
    return B.by_type(results(spark, d))


@query(f"WITH {_R} SELECT bucket, metric, avg(value) AS mean, min(value) AS worst, max(value) AS best, max(value) - min(value) AS spread FROM r GROUP BY ALL")
def slice_difficulty(spark, d):
    return B.difficulty(results(spark, d), "bucket")


@query(f"""
WITH {_R}, b AS (SELECT bucket, metric, CASE WHEN metric = 'eer' THEN min(value) ELSE max(value) END AS baseline FROM r WHERE model IN ('wikitext_crawl', 'freebook_crawl') AND value IS NOT NULL GROUP BY bucket, metric)
SELECT bucket, metric, model, value, baseline, CASE WHEN metric = 'eer' THEN baseline - value ELSE value - baseline END AS gap FROM r JOIN b USING (bucket, metric) WHERE model NOT IN ('wikitext_crawl', 'freebook_crawl')""")
def gap_to_baseline(spark, d):
    return B.gap_to_baseline(results(spark, d), ["wikitext_crawl", "freebook_crawl"], "bucket")


_SLICES = ["news", "literature", "speech", "poetry"]


@query(f"WITH {_R}, p AS (SELECT model, metric, {', '.join(f'''any_value(value) FILTER (WHERE bucket = '{s}') AS {s}''' for s in _SLICES)} FROM r GROUP BY ALL) SELECT *, (SELECT avg(v) FROM (SELECT unnest([{', '.join(_SLICES)}]) AS v)) AS macro FROM p")
def slice_wide_macro(spark, d):
    return B.wide(results(spark, d), _SLICES)


@query(f"WITH {_R} SELECT model, metric, split_part(bucket, '/', 1) AS primary_genre, sum(n_queries)::BIGINT AS n_queries, CASE WHEN sum(n_queries) > 0 THEN sum(value * n_queries) / sum(n_queries) END AS value FROM r GROUP BY ALL")
def genre_rollup_weighted(spark, d):
    return B.rollup_genre(results(spark, d))


# -- training tables


@query("""
SELECT author_id, n_docs, doc_id FROM (SELECT author_id, doc_id, count(*) OVER (PARTITION BY author_id) AS n_docs FROM processed_documents WHERE author_id IS NOT NULL) WHERE n_docs >= 2""")
def author_text_map(spark, d):
    """The map's documents, one a row: its blocks are of bounded length, and all of an author's documents are in them."""
    m = T.author_map(docs(spark, d, "doc_id", "author_id"), "author_id", "doc_id")
    return m.select("author_id", "n_docs", F.explode("ids").alias("doc_id"))


@query("""
WITH r AS (SELECT doc_id, author_id, row_number() OVER (PARTITION BY author_id ORDER BY md5('42:' || doc_id), doc_id) AS r FROM processed_documents WHERE author_id IS NOT NULL)
SELECT author_id, max(CASE WHEN r = 1 THEN doc_id END) AS anchor, max(CASE WHEN r = 2 THEN doc_id END) AS positive FROM r WHERE r <= 2 GROUP BY ALL HAVING count(*) = 2""")
def training_pairs(spark, d):
    return T.two_examples(docs(spark, d, "doc_id", "author_id"), "author_id", "doc_id", 42)


@query("""
WITH a AS (SELECT doc_id, author_id, source, genre FROM processed_documents WHERE author_id IS NOT NULL),
n AS (SELECT source, genre, count(DISTINCT author_id) AS n FROM a WHERE genre IS NOT NULL AND source IS NOT NULL GROUP BY ALL), s AS (SELECT source, count(DISTINCT author_id) AS n FROM a WHERE source IS NOT NULL GROUP BY ALL), g AS (SELECT genre, count(DISTINCT author_id) AS n FROM a WHERE genre IS NOT NULL GROUP BY ALL)
SELECT doc_id AS anchor, CASE WHEN coalesce(n.n, 0) > 1 THEN 1 WHEN coalesce(s.n, 0) > 1 THEN 2 WHEN coalesce(g.n, 0) > 1 THEN 3 ELSE 4 END AS level, true AS other_author FROM a LEFT JOIN n USING (source, genre) LEFT JOIN s ON a.source = s.source LEFT JOIN g ON a.genre = g.genre""")
def controlled_negative(spark, d):
    p = docs(spark, d, "doc_id", "author_id", "source", "genre")
    n = T.controlled_negatives(p, "author_id", "doc_id", "source", "genre", 42)
    a = docs(spark, d, "doc_id", "author_id")
    j = n.join(a.toDF("anchor", "x"), "anchor").join(a.toDF("negative", "y"), "negative")
    return j.select("anchor", "level", (F.col("x") != F.col("y")).alias("other_author"))


@query(f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{X.WS}+'), lambda t: t <> '') AS t FROM processed_documents), n AS (SELECT doc_id, t, ceil(len(t) / 64.0)::INT AS n FROM t WHERE len(t) > 0),
w AS (SELECT doc_id, n, unnest(CASE WHEN n <= 4 THEN range(0, n) ELSE list_transform(range(0, 4), lambda i: round_even(i * (n - 1) / 3.0::DOUBLE, 0)::BIGINT) END) AS i, t FROM n)
SELECT doc_id, i::INT AS window_no, md5(array_to_string(t[i * 64 + 1:i * 64 + 64], ' ')) AS digest FROM w""")
def token_windows(spark, d):
    t = docs(spark, d, "doc_id", "text").select("doc_id", X.tokens(F.coalesce("text", F.lit(""))).alias("t")).where(F.size("t") > 0)
    n = F.ceil(F.size("t") / F.lit(64)).cast("int")
    i = F.when(n <= 4, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.bround(k * (n - 1) / F.lit(3.0), 0).cast("int")))
    w = t.select("doc_id", F.explode(F.arrays_zip(i.alias("i"), T.windows(F.col("t"), 64, 4).alias("w"))).alias("x"))
    return w.select("doc_id", F.col("x.i").alias("window_no"), F.md5(F.array_join("x.w", " ")).alias("digest"))


@query(f"WITH {_SCORED}, ee AS (SELECT query_id, sum(CASE WHEN positive THEN exp(score / 0.07) END) AS p, sum(exp(score / 0.07)) AS t FROM s GROUP BY ALL) SELECT count(*) AS n_queries, avg(-ln(p / t)) AS loss FROM ee WHERE p IS NOT NULL")
def contrastive_loss(spark, d):
    return T.info_nce(scored(spark, d))


@query(f"WITH {_SCORED}, m AS (SELECT query_id, max(CASE WHEN positive THEN score END) AS p, max(CASE WHEN NOT positive THEN score END) AS n FROM s GROUP BY ALL) SELECT count(*) AS n_queries, avg(greatest(0, n - p + 0.2::DOUBLE)) AS loss FROM m WHERE p IS NOT NULL AND n IS NOT NULL")
def triplet_loss(spark, d):
    m = scored(spark, d).groupBy("query_id").agg(F.max(F.when(F.col("positive"), F.col("score"))).alias("p"), F.max(F.when(~F.col("positive"), F.col("score"))).alias("n")).where("p is not null and n is not null")
    return m.agg(F.count(F.lit(1)).alias("n_queries"), F.avg(T.triplet(m, "p", "n")).alias("loss"))
