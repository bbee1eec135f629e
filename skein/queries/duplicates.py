"""De-duplication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedup
from ..registry import query
from .corpus import P, labelled
from .rows import TOKENS, docs, squeeze_sql

_FOLDED = "lower(upper(replace(replace(" + squeeze_sql("text") + ", 'ß', 'ss'), 'ẞ', 'ss')))"


@query(f"SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY {_FOLDED} ORDER BY doc_id) AS r FROM processed_documents) WHERE r = 1 OR text IS NULL")
def exact_dedup(spark, d):
    return dedup.exact(docs(spark, d, "doc_id", "text"), "text", ["doc_id"]).select("doc_id")


_SIM = f"""
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {{view}}),
f AS (SELECT doc_id, unnest(w) AS f FROM w UNION ALL SELECT doc_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM w WHERE len(w) > 1),
h AS (SELECT doc_id, ('0x' || substr(md5(f), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(f), 9, 8))::BIGINT AS lo, n FROM (SELECT doc_id, f, count(*) AS n FROM f GROUP BY ALL)),
v AS (SELECT doc_id, j, sum(CASE WHEN ((CASE WHEN j < 32 THEN hi >> (31 - j) ELSE lo >> (63 - j) END) & 1) = 1 THEN n ELSE -n END) AS v FROM h, (SELECT unnest(range(64)) AS j) GROUP BY ALL),
u AS (SELECT doc_id, sum(CASE WHEN v >= 0 THEN 1::HUGEINT << (63 - j)::INT ELSE 0 END) AS u FROM v GROUP BY ALL),
s AS (SELECT w.doc_id, (CASE WHEN coalesce(u, 0) >= 9223372036854775808 THEN u - 18446744073709551616 ELSE coalesce(u, 0) END)::BIGINT AS simhash FROM w LEFT JOIN u USING (doc_id))"""


@query(f"WITH {_SIM.replace('{view}', 'processed_documents')} SELECT doc_id, simhash FROM s")
def simhash(spark, d):
    return dedup.simhash(docs(spark, d, "doc_id", "text"), "doc_id", "text")


_LONG = f"(SELECT * FROM {P} WHERE len({TOKENS}) >= 20)"
_BANDS = f"""
WITH {_SIM.replace('{view}', _LONG)}, m AS (SELECT p.doc_id, language, simhash FROM s JOIN {_LONG} p USING (doc_id)),
b AS (SELECT *, j AS band, (simhash >> (48 - 16 * j)) & 65535 AS bits FROM m, (SELECT unnest(range(4)) AS j))"""


@query(f"{_BANDS} SELECT band, count(*) AS n_rows, count(DISTINCT bits) AS n_values FROM b GROUP BY ALL")
def simhash_bands(spark, d):
    b = dedup.bands(_marked(spark, d))
    return b.groupBy("band").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("bits").alias("n_values"))


def _marked(spark, d):
    long = labelled(spark, d, "doc_id", "text", "language").where(X.token_count("text") >= dedup.LEAST_TOKENS)
    return long.select("doc_id", "language").join(dedup.simhash(long, "doc_id", "text"), "doc_id")


@query(f"""{_BANDS} SELECT DISTINCT l.doc_id AS lo, r.doc_id AS hi, bit_count(xor(l.simhash, r.simhash))::INT AS bits FROM b l JOIN b r ON l.language = r.language AND l.band = r.band AND l.bits = r.bits AND l.doc_id < r.doc_id
WHERE bit_count(xor(l.simhash, r.simhash)) <= 5""")
def simhash_near_pairs(spark, d):
    m = _marked(spark, d).withColumn("rank", F.col("doc_id"))
    return dedup.near_pairs(m, "doc_id", "rank", "language")


@query(name="near_dedup")
def near_dedup(spark, d):
    """Exact texts first, then greedy near removal, longest documents first."""
    p = labelled(spark, d, "doc_id", "text", "language", "source", "author_id", "raw_id")
    left = dedup.exact(p, "text", ["doc_id"])
    longest = F.lpad((F.lit(10**9) - X.token_count("text")).cast("string"), 10, "0")
    order = [longest, "language", "source", F.coalesce("author_id", F.lit("")), "raw_id", "doc_id"]
    return dedup.near_dedup(left, "doc_id", "text", "language", order)


_PROFILE = f"""
d AS (SELECT doc_id, author_id, text, language, source, len({TOKENS}) AS n_tokens FROM {P} WHERE author_id IS NOT NULL),
t AS (SELECT author_id, count(*) AS n_docs, sum(n_tokens)::BIGINT AS n_tokens FROM d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY n_tokens DESC, doc_id) AS r FROM d),
x AS (SELECT author_id, string_agg(coalesce(text, ''), chr(10) ORDER BY r) AS profile, max(CASE WHEN r = 1 THEN language END) AS lang FROM r WHERE r <= 3 GROUP BY ALL),
m AS (SELECT author_id, source FROM (SELECT author_id, source, row_number() OVER (PARTITION BY author_id ORDER BY count(*) DESC, source) AS r FROM d GROUP BY author_id, source) WHERE r = 1)"""


@query(f"WITH {_PROFILE} SELECT author_id AS author, n_docs, n_tokens, lang, source, md5(profile) AS profile FROM t JOIN x USING (author_id) JOIN m USING (author_id)")
def author_profiles(spark, d):
    p = dedup.author_profiles(labelled(spark, d, "author_id", "doc_id", "text", "language", "source"), "author_id", "doc_id", "text", "language", "source")
    return p.withColumn("profile", F.md5("profile"))


@query(name="author_near_pairs")
def author_near_pairs(spark, d):
    return dedup.near_authors(dedup.author_profiles(labelled(spark, d, "author_id", "doc_id", "text", "language", "source"), "author_id", "doc_id", "text", "language", "source"))


@query(name="author_near_dedup")
def author_near_dedup(spark, d):
    """Authors dropped as near a stronger author of another source."""
    return dedup.greedy(author_near_pairs(spark, d))
