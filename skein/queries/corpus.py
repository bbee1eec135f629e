"""Distributions, balance, overlap and duplicates of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import stats as S
from ..registry import query
from ..session import spread, table
from .rows import docs, squeeze_sql

_PRIMARY = "split_part(lower(trim(genre)), '/', 1)"


def labelled(spark, d, *columns: str) -> DataFrame:
    """processed_documents with the label columns that the statistics use."""
    p = docs(spark, d)
    if "text" in columns and "doc_id" in columns:
        p = spread(p, "doc_id")
    return p.withColumn("primary_genre", X.primary(F.lower(F.trim("genre")))).withColumn("language", X.canonical_language("lang")).select(*columns)


_LANGUAGE = """coalesce(CASE WHEN starts_with(v, 'zh') THEN 'zh' WHEN starts_with(v, 'en') THEN 'en' WHEN starts_with(v, 'es') THEN 'es' WHEN starts_with(v, 'fr') THEN 'fr' WHEN starts_with(v, 'de') THEN 'de'
 WHEN starts_with(v, 'ar') THEN 'ar' WHEN starts_with(v, 'ru') THEN 'ru' WHEN starts_with(v, 'ja') THEN 'ja' WHEN starts_with(v, 'ko') THEN 'ko' WHEN starts_with(v, 'hi') THEN 'hi' ELSE split_part(v, '-', 1) END, '')"""
P = f"(SELECT *, {_LANGUAGE} AS language, {_PRIMARY} AS primary_genre FROM (SELECT *, replace(lower(trim(lang)), '_', '-') AS v FROM processed_documents))"
_SD = "(SELECT DISTINCT * FROM split_documents)"


def split_docs(spark, d) -> DataFrame:
    """The delivered split without repeated deliveries."""
    return table(spark, d, "split_documents").distinct()


@query(f"SELECT language, count(*) AS n_docs FROM {P} GROUP BY ALL")
def count_by_lang(spark, d):
    return S.counts(labelled(spark, d, "language"), "language")


@query(f"SELECT split, lang, count(*) AS n_docs, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY split) AS pct FROM {_SD} GROUP BY split, lang")
def lang_share_by_split(spark, d):
    return S.counts_with_share(split_docs(spark, d), ["split", "lang"], ["split"])


@query(f"SELECT split, input_doc_type, lang, count(*) AS n_docs, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY split, input_doc_type) AS pct FROM {_SD} GROUP BY split, input_doc_type, lang")
def lang_share_by_split_type(spark, d):
    return S.counts_with_share(split_docs(spark, d), ["split", "input_doc_type", "lang"], ["split", "input_doc_type"])


@query(f"SELECT language, primary_genre, count(*) AS n_docs, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY language) AS pct FROM {P} GROUP BY language, primary_genre")
def genre_share_in_lang(spark, d):
    return S.counts_with_share(labelled(spark, d, "language", "primary_genre"), ["language", "primary_genre"], ["language"])


@query(f"SELECT phase, count(*) AS n_docs, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM {_SD} GROUP BY ALL")
def phase_share(spark, d):
    return S.counts_with_share(split_docs(spark, d), ["phase"])


@query("""
SELECT 'lang' AS field, lang AS value, count(*) AS n_docs FROM processed_documents GROUP BY ALL UNION ALL SELECT 'genre', genre, count(*) FROM processed_documents GROUP BY ALL
UNION ALL SELECT 'source', source, count(*) FROM processed_documents GROUP BY ALL UNION ALL SELECT 'length_bucket', length_bucket, count(*) FROM processed_documents GROUP BY ALL""")
def stage_counts(spark, d):
    return S.counts_by_each(docs(spark, d, "lang", "genre", "source", "length_bucket"), ["lang", "genre", "source", "length_bucket"])


_Q = ", ".join(f"quantile_cont(token_length, {q}) AS p{int(q * 100)}" for q in S.QUANTILES)


@query(f"SELECT language, count(token_length) AS n, avg(token_length) AS mean, stddev_samp(token_length) AS std, min(token_length) AS min, max(token_length) AS max, {_Q} FROM {P} GROUP BY ALL")
def token_quantiles_by_lang(spark, d):
    return S.number_summary(labelled(spark, d, "language", "token_length"), "token_length", "language")


@query(f"SELECT count(token_length) AS n, avg(token_length) AS mean, stddev_samp(token_length) AS std, min(token_length) AS min, max(token_length) AS max, {_Q} FROM processed_documents")
def token_quantiles(spark, d):
    return S.number_summary(docs(spark, d, "token_length"), "token_length")


@query("SELECT source, count(*) AS n_docs, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct FROM processed_documents GROUP BY ALL")
def source_table(spark, d):
    return S.counts_with_share(docs(spark, d, "source"), ["source"])


@query(f"SELECT language, primary_genre, count(DISTINCT author_id) AS n_distinct FROM {P} GROUP BY ALL")
def authors_by_cell(spark, d):
    return S.distinct_by(labelled(spark, d, "language", "primary_genre", "author_id"), "author_id", "language", "primary_genre")


@query("WITH a AS (SELECT author_id, count(*) AS n_docs FROM processed_documents WHERE author_id IS NOT NULL GROUP BY ALL) SELECT n_docs, count(*) AS n_keys, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM a GROUP BY ALL")
def docs_per_author_dist(spark, d):
    return S.size_distribution(docs(spark, d, "author_id"), "author_id")


def _balance_sql(view: str, key: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    g = f"{by}, " if by else ""
    return f"""
WITH c AS (SELECT {g}{key} AS k, count(*) AS x FROM {view} WHERE {key} IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER ({part} ORDER BY x DESC, k) AS down, row_number() OVER ({part} ORDER BY x, k DESC) AS up FROM c)
SELECT {g}sum(x)::BIGINT AS n_docs, count(*) AS n_keys, avg(x) AS mean, quantile_cont(x, 0.5)::DOUBLE AS median, max(x) AS largest, max(CASE WHEN down = 1 THEN k END) AS top_key, sum(CASE WHEN down = 1 THEN x END)::DOUBLE / sum(x) AS top1_share,
 sum(CASE WHEN down <= 5 THEN x END)::DOUBLE / sum(x) AS top5_share, 2.0::DOUBLE * sum(up * x) / (count(*) * sum(x)) - (count(*) + 1)::DOUBLE / count(*) AS gini, sum(x * x)::DOUBLE / (sum(x)::DOUBLE * sum(x)) AS hhi FROM r {'GROUP BY ' + by if by else ''}"""


@query(_balance_sql(P, "author_id", "language"))
def author_balance(spark, d):
    return S.balance(labelled(spark, d, "language", "author_id"), "author_id", "language")


@query(_balance_sql("processed_documents", "author_id", ""))
def author_balance_all(spark, d):
    return S.balance(docs(spark, d, "author_id"), "author_id")


@query(_balance_sql("(SELECT o_custkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)", "o_custkey", "n_name"))
def customer_balance(spark, d):
    """The same operator on the star schema: orders of a customer for documents of an author."""
    o, c, n = table(spark, d, "orders", "o_custkey"), table(spark, d, "customer", "c_custkey", "c_nationkey"), table(spark, d, "nation", "n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return S.balance(j.select("o_custkey", "n_name"), "o_custkey", "n_name")


@query(f"""
SELECT language, primary_genre, n_docs, n_keys, top1_share, CASE WHEN n_keys < 5 OR top1_share >= 0.4 THEN 'high' WHEN n_keys < 15 OR top1_share >= 0.25 THEN 'medium' ELSE 'low' END AS risk FROM ({_balance_sql(P, 'author_id', 'language, primary_genre')})""")
def cell_risk(spark, d):
    return S.cell_risk(labelled(spark, d, "language", "primary_genre", "author_id"), "author_id", "language", "primary_genre")


@query(f"""
WITH c AS (SELECT author_id, primary_genre, count(*) AS n FROM {P} WHERE author_id IS NOT NULL AND primary_genre IS NOT NULL GROUP BY ALL),
p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY author_id) AS p, row_number() OVER (PARTITION BY author_id ORDER BY n DESC, primary_genre) AS rank FROM c),
e AS (SELECT author_id, sum(n)::BIGINT AS n_docs, count(*) AS n_values, sum(-p * log2(p)) AS entropy, max(CASE WHEN rank = 1 THEN primary_genre END) AS dominant, max(p) AS dominant_share FROM p GROUP BY ALL)
SELECT *, CASE WHEN n_values > 1 THEN entropy / log2(n_values) ELSE 0.0 END AS normalised FROM e""")
def genre_entropy(spark, d):
    return S.entropy(labelled(spark, d, "author_id", "primary_genre"), "author_id", "primary_genre")


@query(f"""
WITH v AS (SELECT DISTINCT author_id, primary_genre AS g FROM {P} WHERE author_id IS NOT NULL AND primary_genre IS NOT NULL)
SELECT a.g AS value_a, b.g AS value_b, count(*) AS n_keys FROM v a JOIN v b ON a.author_id = b.author_id AND a.g < b.g GROUP BY ALL""")
def genre_pairs(spark, d):
    return S.value_pairs(labelled(spark, d, "author_id", "primary_genre"), "author_id", "primary_genre")


@query("SELECT author_id, source, n FROM (SELECT author_id, source, count(*) AS n, row_number() OVER (PARTITION BY author_id ORDER BY count(*) DESC, source) AS r FROM processed_documents WHERE author_id IS NOT NULL GROUP BY author_id, source) WHERE r = 1")
def dominant_source(spark, d):
    return S.majority(docs(spark, d, "author_id", "source"), "author_id", "source")


@query(f"WITH g AS (SELECT author_id, string_agg(DISTINCT split, '+' ORDER BY split) AS groups FROM {_SD} WHERE author_id IS NOT NULL GROUP BY ALL) SELECT groups, count(*) AS n_keys FROM g GROUP BY ALL")
def split_membership(spark, d):
    return S.membership(split_docs(spark, d), "author_id", "split")


@query("WITH v AS (SELECT DISTINCT author_id, split FROM split_documents WHERE author_id IS NOT NULL) SELECT a.split AS group_a, b.split AS group_b, count(*) AS n_keys FROM v a JOIN v b USING (author_id) GROUP BY ALL")
def split_overlap_matrix(spark, d):
    return S.overlap_matrix(split_docs(spark, d), "author_id", "split")


@query("WITH v AS (SELECT DISTINCT author_id, phase FROM split_documents WHERE author_id IS NOT NULL) SELECT a.phase AS group_a, b.phase AS group_b, count(*) AS n_keys FROM v a JOIN v b USING (author_id) GROUP BY ALL")
def phase_overlap(spark, d):
    return S.overlap_matrix(split_docs(spark, d), "author_id", "phase")


_KEYED = f"(SELECT md5(lower({squeeze_sql('text')})) AS text_key, doc_id, author_id, source, lang FROM processed_documents WHERE text IS NOT NULL)"


def keyed(spark, d, *columns: str) -> DataFrame:
    return docs(spark, d, "text", *columns).where("text is not null").select(F.md5(F.lower(X.squeeze("text"))).alias("text_key"), *columns)


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY text_key ORDER BY doc_id) AS rn FROM {_KEYED})
SELECT text_key, count(*) AS n_docs, count(DISTINCT author_id) AS n_authors, count(DISTINCT source) > 1 AS cross_source, count(DISTINCT lang) > 1 AS cross_lang, string_agg(CASE WHEN rn <= 8 THEN doc_id END, ',' ORDER BY doc_id) AS first_ids FROM r GROUP BY ALL HAVING count(*) > 1""")
def duplicate_groups(spark, d):
    return S.duplicate_groups(keyed(spark, d, "doc_id", "author_id", "source", "lang"), "text_key", "doc_id", "author_id", cross_source="source", cross_lang="lang")


_PHASED = _KEYED.replace("lang FROM", "lang, CASE WHEN contains(source, '_crawl') THEN 'phase2' ELSE 'phase1' END AS phase FROM")


def phased(spark, d) -> DataFrame:
    return keyed(spark, d, "doc_id", "author_id", "source", "lang").withColumn("phase", F.when(F.col("source").contains("_crawl"), "phase2").otherwise("phase1"))


@query(f"WITH k AS (SELECT * FROM {_PHASED}) SELECT doc_id, source FROM k WHERE phase = 'phase1' AND text_key NOT IN (SELECT text_key FROM k WHERE phase = 'phase2')")
def cross_phase_anti(spark, d):
    """Phase 2 wins: phase 1 documents whose text isn't in phase 2."""
    k = phased(spark, d)
    return k.where("phase = 'phase1'").join(k.where("phase = 'phase2'").select("text_key"), "text_key", "left_anti").select("doc_id", "source")


@query(f"""
WITH k AS (SELECT * FROM {_PHASED}), f AS (SELECT text_key, doc_id, row_number() OVER (PARTITION BY text_key ORDER BY doc_id) AS r FROM k WHERE phase = 'phase2')
SELECT k.doc_id AS phase1_id, f.doc_id AS phase2_id, k.source FROM k JOIN f ON k.text_key = f.text_key AND f.r = 1 WHERE k.phase = 'phase1'""")
def cross_phase_examples(spark, d):
    k = phased(spark, d)
    first = k.where("phase = 'phase2'").groupBy("text_key").agg(F.min("doc_id").alias("phase2_id"))
    return k.where("phase = 'phase1'").join(first, "text_key").select(F.col("doc_id").alias("phase1_id"), "phase2_id", "source")


@query("""
WITH c AS (SELECT source, count(*) AS n FROM processed_documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS r FROM c)
SELECT CASE WHEN r <= 10 THEN source ELSE 'other' END AS label, sum(n)::BIGINT AS n_docs FROM r GROUP BY ALL""")
def top_sources_other(spark, d):
    return S.top_with_other(docs(spark, d, "source"), "source", 10)


@query(f"""
WITH c AS (SELECT language, primary_genre, count(*) AS n FROM {P} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY n DESC, primary_genre NULLS LAST) AS r FROM c)
SELECT language, CASE WHEN r <= 3 THEN coalesce(primary_genre, 'unknown') ELSE 'other' END AS label, sum(n)::BIGINT AS n_docs FROM r GROUP BY ALL""")
def top_genres_by_lang(spark, d):
    return S.top_with_other(labelled(spark, d, "language", "primary_genre"), "primary_genre", 3, "language")


_BUCKETS = ["short", "medium", "long", "extra_long"]


@query(f"""
WITH c AS (SELECT language, length_bucket AS b, count(*) AS n FROM {P} GROUP BY ALL), t AS (SELECT language, sum(n) FILTER (WHERE b IN ('short', 'medium', 'long', 'extra_long')) AS t FROM c GROUP BY ALL)
SELECT language, {', '.join(f"coalesce(sum(n) FILTER (WHERE b = '{b}'), 0)::DOUBLE / greatest(coalesce(any_value(t), 0), 1) AS {b}" for b in _BUCKETS)} FROM c JOIN t USING (language) GROUP BY ALL""")
def crosstab_lang_length(spark, d):
    return S.crosstab(labelled(spark, d, "language", "length_bucket"), "language", "length_bucket", _BUCKETS)


@query(f"""
WITH a AS (SELECT author_id, count(*) AS x FROM processed_documents WHERE author_id IS NOT NULL GROUP BY ALL),
p AS (SELECT count(*) AS n_authors, avg(x) AS mean_docs, quantile_cont(x, 0.5)::DOUBLE AS median_docs, quantile_cont(x, 0.9)::DOUBLE AS p90_docs, quantile_cont(x, 0.95)::DOUBLE AS p95_docs, max(x) AS max_docs FROM a)
SELECT count(*) AS n_docs, any_value(p.n_authors) AS n_authors, any_value(p.mean_docs) AS mean_docs, any_value(p.median_docs) AS median_docs, any_value(p.p90_docs) AS p90_docs, any_value(p.p95_docs) AS p95_docs, any_value(p.max_docs) AS max_docs,
 avg(token_length) AS mean_length, count(DISTINCT language) AS n_language, count(DISTINCT primary_genre) AS n_primary_genre, count(DISTINCT source) AS n_source FROM {P} CROSS JOIN p""")
def overview(spark, d):
    return S.overview(labelled(spark, d, "author_id", "token_length", "language", "primary_genre", "source"), "author_id", "token_length", ["language", "primary_genre", "source"])


@query(f"SELECT source, language, count(*) AS n_docs, count(DISTINCT author_id) AS n_authors, count(DISTINCT primary_genre) AS n_genres, sum((length_bucket = 'short')::INT)::BIGINT AS n_short, sum((length_bucket = 'extra_long')::INT)::BIGINT AS n_extra_long FROM {P} GROUP BY ALL")
def source_profile(spark, d):
    p = labelled(spark, d, "source", "language", "author_id", "primary_genre", "length_bucket")
    is_ = lambda b: F.sum((F.col("length_bucket") == b).cast("int"))
    return p.groupBy("source", "language").agg(S.rows().alias("n_docs"), F.countDistinct("author_id").alias("n_authors"), F.countDistinct("primary_genre").alias("n_genres"), is_("short").alias("n_short"), is_("extra_long").alias("n_extra_long"))


@query("""
WITH s AS (SELECT 1 AS stage, 'raw' AS name, count(*) AS n FROM documents UNION ALL SELECT 2, 'processed', count(*) FROM processed_documents UNION ALL SELECT 3, 'split', count(*) FROM (SELECT DISTINCT doc_id FROM split_documents) UNION ALL SELECT 4, 'queries', count(*) FROM query_positives)
SELECT stage, name, n, coalesce(n::DOUBLE / nullif(first_value(n) OVER (ORDER BY stage), 0), 0.0) AS of_first, coalesce(n::DOUBLE / nullif(lag(n) OVER (ORDER BY stage), 0), 0.0) AS of_previous, coalesce(lag(n) OVER (ORDER BY stage), n) - n AS dropped FROM s""")
def stage_flow(spark, d):
    one = lambda df, i, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("stage"), F.lit(name).alias("name"), "n")
    s = one(table(spark, d, "documents", "doc_id"), 1, "raw").unionByName(one(docs(spark, d, "doc_id"), 2, "processed"))
    s = s.unionByName(one(table(spark, d, "split_documents", "doc_id").distinct(), 3, "split")).unionByName(one(table(spark, d, "query_positives", "query_id"), 4, "queries"))
    return S.stage_flow(s, "stage", "n")
