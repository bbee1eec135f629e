"""Sampling, splits, retrieval tables and release."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import release, sampling, splits
from ..operators.sampling import LANGUAGE_WEIGHTS, LENGTH_WEIGHTS
from ..registry import query
from ..session import table
from .corpus import P, labelled, split_docs
from .rows import docs

SEED = 42
GENRE_WEIGHTS = {"news": 0.30, "social_media": 0.30, "literature": 0.20, "blog": 0.10, "speech": 0.10}
_U = f"md5('{SEED}:' || doc_id)"
_CAP = f"row_number() OVER (PARTITION BY author_id ORDER BY {_U}, doc_id)"


@query(f"SELECT doc_id, author_id FROM (SELECT *, {_CAP} AS r FROM processed_documents WHERE author_id IS NOT NULL) WHERE r <= 5")
def author_cap(spark, d):
    return sampling.author_cap(docs(spark, d, "doc_id", "author_id"), "author_id", "doc_id", 5, SEED)


@query(f"""
WITH n AS (SELECT doc_id, author_id, count(*) OVER (PARTITION BY author_id) AS author_docs, {_CAP} AS r FROM processed_documents WHERE author_id IS NOT NULL)
SELECT doc_id, author_id, author_docs, CASE WHEN author_docs >= 3 THEN 'full' ELSE 'fallback' END AS author_class FROM n WHERE author_docs >= 2 AND r <= 5""")
def author_limits(spark, d):
    return sampling.author_limits(docs(spark, d, "doc_id", "author_id"), "author_id", "doc_id", 3, 2, 5, SEED)


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_U}, doc_id) AS r FROM processed_documents) WHERE r <= CASE source WHEN 'feedpulse' THEN 50 WHEN 'headline_briefs' THEN 200 ELSE 100 END")
def dataset_cap(spark, d):
    return sampling.dataset_cap(docs(spark, d, "doc_id", "source"), "source", "doc_id", 100, {"feedpulse": 50, "headline_briefs": 200}, SEED)


def _weights_case(column: str, total: int, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in sampling.targets_of(total, weights).items()) + " ELSE 0 END"


@query(f"""
WITH q AS (SELECT doc_id, language, length_bucket, row_number() OVER (PARTITION BY language, length_bucket ORDER BY {_U}, doc_id) <= {_weights_case('length_bucket', 40, LENGTH_WEIGHTS)} AS first FROM {P}),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY first DESC, {_U}, doc_id) AS r FROM q)
SELECT doc_id, language, length_bucket, CASE WHEN first THEN 'quota' ELSE 'fill' END AS pass FROM r WHERE r <= 40""")
def bucket_quota(spark, d):
    return sampling.bucket_fill(labelled(spark, d, "doc_id", "language", "length_bucket"), "language", "length_bucket", "doc_id", 40, LENGTH_WEIGHTS, SEED)


_TARGET_GENRE = "CASE " + " ".join(f"WHEN genre = '{g}' OR starts_with(genre, '{g}/') THEN '{g}'" for g in GENRE_WEIGHTS) + " END"


@query(f"""
WITH g AS (SELECT doc_id, language, genre, {_TARGET_GENRE} AS target_genre FROM {P}),
q AS (SELECT *, target_genre IS NOT NULL AND row_number() OVER (PARTITION BY language, target_genre ORDER BY {_U}, doc_id) <= {_weights_case('target_genre', 60, GENRE_WEIGHTS)} AS first FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY first DESC, {_U}, doc_id) AS r FROM q)
SELECT doc_id, language, genre, target_genre, CASE WHEN first THEN 'quota' ELSE 'spill' END AS pass FROM r WHERE r <= 60""")
def genre_quota_spill(spark, d):
    return sampling.genre_spill(labelled(spark, d, "doc_id", "language", "genre"), "language", "genre", "doc_id", 60, GENRE_WEIGHTS, SEED)


_QUOTAS = [(lang, b, n) for lang in LANGUAGE_WEIGHTS for b, n in sampling.targets_of(60, LENGTH_WEIGHTS).items()]


@query(f"""
WITH q(language, length_bucket, quota) AS (VALUES {', '.join(f"('{a}', '{b}', {n})" for a, b, n in _QUOTAS)}), h AS (SELECT language, length_bucket, count(*) AS n FROM {P} GROUP BY ALL)
SELECT language, length_bucket, quota, least(quota, coalesce(n, 0))::BIGINT AS selected, quota - least(quota, coalesce(n, 0)) AS missing FROM q LEFT JOIN h USING (language, length_bucket) WHERE quota > coalesce(n, 0)""")
def bucket_deficits(spark, d):
    quotas = spark.createDataFrame(_QUOTAS, "language string, length_bucket string, quota int")
    return sampling.deficits(labelled(spark, d, "language", "length_bucket"), ["language", "length_bucket"], quotas)


@query(f"""
WITH s AS (SELECT language, row_number() OVER (ORDER BY language) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT language FROM {P})),
q AS (SELECT language, 300 // k + (i < 300 % k)::INT AS q FROM s),
r AS (SELECT doc_id, language, row_number() OVER (PARTITION BY language ORDER BY {_U}, doc_id) AS n FROM {P}),
m AS (SELECT *, n <= q AS picked FROM r JOIN q USING (language))
SELECT doc_id, language, picked FROM m ORDER BY picked DESC, {_U}, doc_id LIMIT 300""")
def detection_sample(spark, d):
    return sampling.balanced_pick(labelled(spark, d, "doc_id", "language"), "language", "doc_id", 300, SEED).select("doc_id", "language", "picked")


@query(f"""
WITH s AS (SELECT language, count(*) AS n_docs, row_number() OVER (ORDER BY language) - 1 AS i, count(*) OVER () AS k FROM {P} GROUP BY language)
SELECT language, n_docs, (500 // k + (i < 500 % k)::INT)::BIGINT AS target FROM s""")
def equal_lang_targets(spark, d):
    from pyspark.sql import Window as W

    n = labelled(spark, d, "language").groupBy("language").agg(F.count(F.lit(1)).alias("n_docs"))
    i, k = F.row_number().over(W.partitionBy().orderBy("language")) - 1, F.count(F.lit(1)).over(W.partitionBy())  # over one row a language
    return n.select("language", "n_docs", (F.floor(F.lit(500) / k) + (i < F.pmod(F.lit(500), k)).cast("int")).alias("target"))


_WEIGHTS = ", ".join(f"('{k}', {w}::DOUBLE, {i})" for i, (k, w) in enumerate(sorted(LANGUAGE_WEIGHTS.items(), key=lambda x: -x[1])))


@query(f"""
WITH c AS (SELECT language, count(*) AS n_docs FROM {P} WHERE language IS NOT NULL GROUP BY ALL), w(language, w, i) AS (VALUES {_WEIGHTS}),
g AS (SELECT language, n_docs, w, i, (SELECT least(sum(n_docs), (SELECT sum(n_docs) // 2 FROM c)) FROM c)::BIGINT AS goal FROM c JOIN w USING (language)),
f AS (SELECT *, round_even(goal * w / sum(w) OVER (), 0)::BIGINT AS first, row_number() OVER (ORDER BY w DESC, i) AS place FROM g),
h AS (SELECT *, least(first + CASE WHEN place <= abs(goal - sum(first) OVER ()) THEN sign(goal - sum(first) OVER ()) ELSE 0 END, n_docs)::BIGINT AS held FROM f),
s AS (SELECT *, n_docs - held AS slack, goal - sum(held) OVER () AS rest, coalesce(sum(n_docs - held) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT language, n_docs, (held + greatest(0, least(slack, rest - before)))::BIGINT AS target FROM s""")
def language_targets(spark, d):
    """Targets by weight with redistribution, for half of all documents."""
    n = labelled(spark, d, "language").where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n_docs"))
    return sampling.language_targets(n, "language", "n_docs", sum(r.n_docs for r in n.collect()) // 2, LANGUAGE_WEIGHTS)  # a dozen rows


@query(f"SELECT doc_id FROM processed_documents ORDER BY {_U}, doc_id LIMIT 100")
def uniform_cap(spark, d):
    return sampling.uniform_cap(docs(spark, d, "doc_id"), "doc_id", 100, SEED)


# -- splits


_COUNTS = """
e AS (SELECT *, n * 0.8::DOUBLE AS a, n * 0.1::DOUBLE AS b FROM g), f AS (SELECT *, floor(a + 1e-9)::BIGINT AS fa, floor(b + 1e-9)::BIGINT AS fb FROM e),
l AS (SELECT *, round(a - fa, 9) AS la, round(b - fb, 9) AS lb, n - fa - 2 * fb AS rest FROM f),
c AS (SELECT *, fa + ((lb > la)::INT * 2 < rest)::INT AS n_train, fb + ((la >= lb)::INT < rest)::INT AS n_dev, fb + ((la >= lb)::INT + 1 < rest)::INT AS n_test FROM l)"""


@query(f"WITH g AS (SELECT language, primary_genre, count(*) AS n FROM {P} GROUP BY ALL), {_COUNTS} SELECT language, primary_genre, n AS n_docs, n_train, n_dev, n_test FROM c")
def largest_remainder(spark, d):
    g = labelled(spark, d, "language", "primary_genre").groupBy("language", "primary_genre").agg(F.count(F.lit(1)).alias("n_docs"))
    c = splits.split_counts(F.col("n_docs"))
    return g.select("language", "primary_genre", "n_docs", *[v.alias(f"n_{k}") for k, v in c.items()])


@query(f"""
WITH g AS (SELECT doc_id, language, primary_genre, length_bucket, count(*) OVER w AS n, row_number() OVER (w ORDER BY {_U}, doc_id) AS r FROM {P} WINDOW w AS (PARTITION BY language, primary_genre, length_bucket)), {_COUNTS}
SELECT doc_id, language, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_dev THEN 'dev' ELSE 'test' END AS split FROM c""")
def stratified_split(spark, d):
    p = labelled(spark, d, "doc_id", "language", "primary_genre", "length_bucket")
    return splits.stratified(p, ["language", "primary_genre", "length_bucket"], "doc_id", SEED).select("doc_id", "language", "split")


@query(name="author_split")
def author_split(spark, d):
    return splits.author_aware(labelled(spark, d, "author_id", "language"), "author_id", "language")


_ROLES = f"""
n AS (SELECT doc_id, author_id, split, row_number() OVER (PARTITION BY split, author_id ORDER BY {_U}, doc_id) AS i, count(*) OVER (PARTITION BY split, author_id) AS n FROM (SELECT DISTINCT doc_id, author_id, split FROM split_documents WHERE author_id IS NOT NULL)),
r AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN i <= CASE WHEN n = 2 THEN 1 ELSE 2 END THEN 'candidate' WHEN i <= CASE WHEN n = 2 THEN 2 WHEN n = 3 THEN 3 ELSE 4 END THEN 'query' END AS role FROM n)"""


def _roles(spark, d):
    s = split_docs(spark, d).select("doc_id", "author_id", "split").distinct()
    return splits.retrieval_roles(s, "author_id", "doc_id", SEED, ["split"])


@query(f"WITH {_ROLES} SELECT doc_id, author_id, split, role AS retrieval_role FROM r WHERE role IS NOT NULL")
def retrieval_roles(spark, d):
    return _roles(spark, d)


@query(f"""
WITH n AS (SELECT doc_id, author_id, split, row_number() OVER (PARTITION BY split, author_id ORDER BY {_U}, doc_id) AS i, count(*) OVER (PARTITION BY split, author_id) AS n FROM (SELECT DISTINCT doc_id, author_id, split FROM split_documents WHERE author_id IS NOT NULL))
SELECT doc_id, author_id, split, CASE WHEN i <= ceil(n / 2) THEN 'candidate' ELSE 'query' END AS retrieval_role FROM n""")
def keep_all_roles(spark, d):
    s = split_docs(spark, d).select("doc_id", "author_id", "split").distinct()
    return splits.keep_all_roles(s, "author_id", "doc_id", SEED, ["split"])


@query(f"""
WITH {_ROLES}, c AS (SELECT split, author_id, string_agg(doc_id, ',' ORDER BY doc_id) AS positive_ids FROM r WHERE role = 'candidate' GROUP BY ALL)
SELECT doc_id AS query_id, positive_ids, author_id, split FROM r JOIN c USING (split, author_id) WHERE role = 'query'""")
def ground_truth(spark, d):
    g = splits.ground_truth(_roles(spark, d), "author_id", "doc_id", ["split"])
    return g.withColumn("positive_ids", F.array_join("positive_ids", ","))


@query("SELECT doc_id, format('doc_{:06d}', row_number() OVER (ORDER BY lang, source, doc_id) - 1) AS new_id FROM (SELECT doc_id, coalesce(lang, '') AS lang, source FROM processed_documents)")
def doc_ids(spark, d):
    p = docs(spark, d, "doc_id", "lang", "source").withColumn("lang", F.coalesce("lang", F.lit("")))
    return splits.position_ids(p, ["lang", "source", "doc_id"]).select("doc_id", "new_id")


# -- release


ALLOWED = ["headline_briefs", "feedpulse", "wikitext_crawl", "weblog_corpus", "askbench_crawl"]
_OK = "source IN (" + ", ".join(f"'{s}'" for s in ALLOWED) + ")"


@query(f"""
WITH ids AS (SELECT DISTINCT doc_id FROM split_documents WHERE {_OK}), p AS (SELECT query_id, author_id, unnest(positive_ids) AS doc_id FROM query_positives WHERE query_id IN (SELECT doc_id FROM ids))
SELECT query_id, author_id, string_agg(DISTINCT doc_id, ',' ORDER BY doc_id) AS positive_ids FROM p WHERE doc_id IN (SELECT doc_id FROM ids) GROUP BY ALL""")
def release_filter(spark, d):
    _, truth = release.release_filter(table(spark, d, "split_documents"), table(spark, d, "query_positives"), ALLOWED)
    return truth.select("query_id", "author_id", F.array_join("positive_ids", ",").alias("positive_ids"))


@query(f"SELECT split, count(DISTINCT doc_id) AS n_docs, CASE WHEN count(DISTINCT doc_id) < 1000 THEN 'n<1K' WHEN count(DISTINCT doc_id) < 10000 THEN '1K<n<10K' WHEN count(DISTINCT doc_id) < 100000 THEN '10K<n<100K' WHEN count(DISTINCT doc_id) < 1000000 THEN '100K<n<1M' ELSE '1M<n' END AS size_class FROM split_documents WHERE {_OK} GROUP BY ALL")
def release_counts(spark, d):
    kept, _ = release.release_filter(table(spark, d, "split_documents"), table(spark, d, "query_positives"), ALLOWED)
    n = kept.groupBy("split").agg(F.count(F.lit(1)).alias("n_docs"))
    return n.withColumn("size_class", release.size_class(F.col("n_docs")))


@query("""
WITH ids AS (SELECT DISTINCT doc_id, retrieval_role FROM split_documents), p AS (SELECT unnest(positive_ids) AS doc_id FROM query_positives),
c AS (SELECT (SELECT count(*) FROM split_documents) AS n_rows, (SELECT count(DISTINCT doc_id) FROM split_documents) AS n_ids, (SELECT count(*) FROM query_positives) AS n_truth, (SELECT count(DISTINCT query_id) FROM query_positives) AS n_truth_ids,
 (SELECT count(*) FROM ids WHERE retrieval_role = 'query') AS n_queries, (SELECT count(*) FROM ids WHERE retrieval_role = 'query' AND doc_id NOT IN (SELECT query_id FROM query_positives)) AS n_queries_without,
 (SELECT count(*) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM ids)) AS n_missing, (SELECT count(*) FROM ids WHERE retrieval_role = 'candidate' AND doc_id IN (SELECT doc_id FROM p)) AS n_used, (SELECT count(*) FROM ids WHERE retrieval_role = 'candidate') AS n_candidates)
SELECT *, coalesce(n_used::DOUBLE / nullif(n_candidates, 0), 0.0) AS coverage FROM c""")
def consistency_counts(spark, d):
    return release.consistency(table(spark, d, "split_documents"), table(spark, d, "query_positives"))


@query("SELECT query_id, doc_id FROM (SELECT query_id, unnest(positive_ids) AS doc_id FROM query_positives) WHERE doc_id NOT IN (SELECT doc_id FROM split_documents WHERE retrieval_role = 'candidate')")
def missing_references(spark, d):
    pos = table(spark, d, "query_positives").select("query_id", F.explode("positive_ids").alias("doc_id"))
    return pos.join(table(spark, d, "split_documents").where("retrieval_role = 'candidate'").select("doc_id"), "doc_id", "left_anti").select("query_id", "doc_id")
