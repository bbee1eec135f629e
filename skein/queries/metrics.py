"""Dense retrieval and verification on the vectors: queries are the rows whose id 50 divides, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..registry import query
from ..session import stash, table

_SCORED = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, q.label AS query_label, q.label = c.label AS positive,
 list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)"""


def scored(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return S.dense_scores(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "label")


_TOP = _SCORED + ", t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM s)"


@query(f"WITH {_TOP} SELECT query_id, candidate_id, round(score, 6) AS score, rank::INT AS rank, positive FROM t WHERE rank <= 10")
def dense_topk(spark, d):
    return S.topk(scored(spark, d), 10).select("query_id", "candidate_id", F.round("score", 6).alias("score"), "rank", "positive")


_IDEAL = "list_sum(list_transform(range(1, least(any_value(n_positives), {k})::BIGINT + 1), lambda i: 1 / log2(i + 1)))"
_PER_QUERY = _TOP + """,
b AS (SELECT query_id, any_value(query_label) AS query_label, count(*) AS n_candidates, sum(positive::INT)::BIGINT AS n_positives, max(CASE WHEN positive THEN score END) AS best FROM s GROUP BY ALL),
m AS (SELECT query_id, any_value(query_label) AS query_label, any_value(n_candidates) AS n_candidates, any_value(n_positives) AS n_positives, """ + ", ".join(
    f"sum((positive AND rank <= {k})::INT)::DOUBLE / any_value(n_positives) AS recall_{k}, max((positive AND rank <= {k})::INT)::DOUBLE AS success_{k}, coalesce(sum(CASE WHEN positive AND rank <= {k} THEN 1 / log2(rank + 1) END), 0) / {_IDEAL.format(k=k)} AS ndcg_{k}"
    for k in S.KS
) + ", 1.0::DOUBLE / (1 + sum((score > best)::INT)) AS mrr FROM t JOIN b USING (query_id) WHERE n_positives > 0 GROUP BY query_id)"
_NAMES = [f"{m}_{k}" for k in S.KS for m in ("recall", "success", "ndcg")] + ["mrr"]


@query(f"WITH {_PER_QUERY.replace('any_value(query_label) AS query_label, count', 'any_value(query_label) AS qlabel, count').replace('any_value(query_label) AS query_label, any_value(n_c', 'any_value(n_c')} SELECT * FROM m")
def ranking_metrics(spark, d):
    return S.ranking(stash(scored(spark, d), "scored"))


_MEAN = "count(*) AS n_queries, " + ", ".join(f"avg({n}) AS {n}" for n in _NAMES) + ", min(n_candidates) AS min_pool, max(n_candidates) AS max_pool"
_LABELLED = _PER_QUERY.replace("any_value(query_label) AS query_label, count", "count").replace("any_value(query_label) AS query_label, any_value(n_c", "any_value(query_label) AS query_label, any_value(n_c")


@query(f"WITH {_LABELLED} SELECT query_label, {_MEAN} FROM m GROUP BY ALL")
def ranking_by_group(spark, d):
    s = stash(scored(spark, d), "scored")
    labels = s.select("query_id", "query_label").distinct()
    return S.mean_ranking(S.ranking(s).join(labels, "query_id"), "query_label")


def _grouped(by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"gs AS (SELECT {g}round(score, 6) AS score, sum(positive::INT)::BIGINT AS p, sum((NOT positive)::INT)::BIGINT AS n FROM {{src}} GROUP BY ALL)"


def eer_sql(src: str, by: str = "") -> str:
    part, g = (f"PARTITION BY {by} " if by else ""), (f"{by}, " if by else "")
    return f"""{_grouped(by).format(src=src)},
gt AS (SELECT *, sum(p) OVER ({part}) AS P_, sum(n) OVER ({part}) AS N_, sum(p) OVER ({part}ORDER BY score DESC) AS cp, sum(n) OVER ({part}ORDER BY score DESC) AS cn FROM gs),
gr AS (SELECT *, cn::DOUBLE / N_ AS x1, (P_ - cp)::DOUBLE / P_ AS y1 FROM gt WHERE P_ > 0 AND N_ > 0),
gl AS (SELECT *, coalesce(lag(x1) OVER ({part}ORDER BY score DESC), 0) AS x0, coalesce(lag(y1) OVER ({part}ORDER BY score DESC), 1) AS y0 FROM gr),
gc AS (SELECT *, row_number() OVER ({part}ORDER BY score DESC) AS r FROM gl WHERE sign(x0 - y0) <> sign(x1 - y1))
SELECT {g}P_::BIGINT AS n_positive, N_::BIGINT AS n_negative, CASE WHEN (y0 - x0) + (x1 - y1) = 0 THEN (x0 + y0) / 2 ELSE x0 + least(greatest((y0 - x0) / ((y0 - x0) + (x1 - y1)), 0), 1) * (x1 - x0) END AS eer FROM gc WHERE r = 1"""


def auc_sql(src: str, by: str = "") -> str:
    part, g = (f"PARTITION BY {by} " if by else ""), (f"{by}, " if by else "")
    return f"""{_grouped(by).format(src=src)},
gt AS (SELECT *, coalesce(sum(p + n) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM gs),
ga AS (SELECT {g}sum(p)::DOUBLE AS P_, sum(n)::DOUBLE AS N_, sum(p * (before + (p + n + 1) / 2.0::DOUBLE)) AS s FROM gt {'GROUP BY ' + by if by else ''})
SELECT {g}P_::BIGINT AS n_positive, N_::BIGINT AS n_negative, (s - P_ * (P_ + 1) / 2) / (P_ * N_) AS roc_auc FROM ga WHERE P_ > 0 AND N_ > 0"""


@query(f"WITH {_SCORED}, {eer_sql('s')}")
def eer(spark, d):
    return S.eer(S.by_score(scored(spark, d)))


@query(f"WITH {_SCORED}, {auc_sql('s')}")
def roc_auc(spark, d):
    return S.roc_auc(S.by_score(scored(spark, d)))


@query(f"WITH {_SCORED}, {eer_sql('s', 'query_label')}")
def eer_by_group(spark, d):
    return S.eer(S.by_score(scored(spark, d), "query_label"), "query_label")


@query(f"WITH {_SCORED}, {auc_sql('s', 'query_label')}")
def roc_auc_by_group(spark, d):
    return S.roc_auc(S.by_score(scored(spark, d), "query_label"), "query_label")


_SAMPLED = _SCORED + ", ng AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('42:' || query_id || ':' || candidate_id), candidate_id) AS nr FROM s WHERE NOT positive), sm AS (SELECT query_label, score, positive FROM s WHERE positive UNION ALL SELECT query_label, score, positive FROM ng WHERE nr <= 20)"


@query(f"WITH {_SAMPLED}, {eer_sql('sm')}")
def eer_sampled_negatives(spark, d):
    return S.eer(S.by_score(S.sampled_negatives(scored(spark, d), 20, 42)))


_TOK = "list_transform(range(0, 8), lambda i: v[i * 8 + 1:i * 8 + 8])"


@query(f"""
WITH e AS (SELECT vec_id, {_TOK} AS t FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))
SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, round(list_avg(list_transform(q.t, lambda x: list_max(list_transform(c.t, lambda y: list_dot_product(x, y))))), 6) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id""")
def maxsim(spark, d):
    """Late interaction on vectors read as eight tokens of eight dimensions. Blocks of queries are shuffled to the rows."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    t = e.select("vec_id", F.expr("transform(sequence(0, 7), i -> slice(embedding, i * 8 + 1, 8))").alias("t"))
    n = 16
    q = t.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("t").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    c = t.select(F.col("vec_id").alias("candidate_id"), F.col("t").alias("c"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("b"))
    return q.join(c, "b").where("query_id <> candidate_id").select("query_id", "candidate_id", F.round(S.max_similarity(F.col("q"), F.col("c")), 6).alias("score"))


@query(f"""
WITH e AS (SELECT vec_id, {_TOK} AS t FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)), m AS (SELECT vec_id, list_transform(range(1, 9), lambda j: list_avg(list_transform(t, lambda x: x[j]))) AS m FROM e)
SELECT vec_id, list_transform(m, lambda x: round(x / sqrt(list_dot_product(m, m)), 6)) AS pooled FROM m""")
def mean_pooling(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.expr("transform(sequence(0, 7), i -> slice(embedding, i * 8 + 1, 8))").alias("t"))
    return e.select("vec_id", F.transform(S.pooled(F.col("t"), 8), lambda x: F.round(x, 6)).alias("pooled"))


_CHANCE_K = ", ".join(
    f"1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, least({k}, n)::BIGINT), lambda i: greatest(n - r - i, 0)::DOUBLE / (n - i))), lambda a, b: a * b) AS success_{k}, least({k}, n)::DOUBLE / n AS recall_{k},"
    f" r::DOUBLE / n * list_sum(list_transform(range(1, least({k}, n)::BIGINT + 1), lambda i: 1 / log2(i + 1))) / list_sum(list_transform(range(1, least(r, {k})::BIGINT + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}"
    for k in S.KS
)
_SIZES = "d AS (SELECT DISTINCT n_candidates AS n, n_positives AS r FROM b WHERE n_positives > 0)"
_B = "b AS (SELECT q.vec_id, count(*) AS n_candidates, sum((q.label = c.label)::INT)::BIGINT AS n_positives FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)"


@query(f"""
WITH RECURSIVE {_B}, {_SIZES}, p(n, r, i, p, s) AS (SELECT n, r, 1::BIGINT, r::DOUBLE / n, 0.0::DOUBLE FROM d UNION ALL SELECT n, r, i + 1, p * greatest(n - r - i + 1, 0) / greatest(n - i, 1), s + p / i FROM p WHERE i <= n - r + 1)
SELECT n AS n_candidates, r AS n_positives, {_CHANCE_K}, (SELECT max(s) FROM p WHERE p.n = d.n AND p.r = d.r) AS mrr FROM d""")
def random_expectation(spark, d):
    """Pool sizes from counts of labels: no pair is scored for a chance level."""
    e = table(spark, d, "embeddings", "vec_id", "label")
    n = e.count()
    sizes = e.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("vec_id") % 50 == 0).alias("asked")).where("asked and c > 1")
    return S.chance(sizes.select(F.lit(n - 1).cast("bigint").alias("n_candidates"), (F.col("c") - 1).alias("n_positives")))


@query(f"""
WITH {_LABELLED}, x AS (SELECT query_id, success_5, n_candidates AS n, n_positives AS r FROM m), y AS (SELECT *, 1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, least(5, n)::BIGINT), lambda i: greatest(n - r - i, 0)::DOUBLE / (n - i))), lambda a, b: a * b) AS expected FROM x)
SELECT query_id, success_5, expected, CASE WHEN expected < 1 THEN (success_5 - expected) / (1 - expected) END AS adjusted FROM y""")
def chance_adjusted(spark, d):
    per = S.ranking(stash(scored(spark, d), "scored")).select("query_id", "n_candidates", "n_positives", "success_5")
    c = S.chance(per).select("n_candidates", "n_positives", F.col("success_5").alias("expected"))
    j = per.join(c, ["n_candidates", "n_positives"])
    return j.select("query_id", "success_5", "expected", S.chance_adjusted(F.col("success_5"), F.col("expected")).alias("adjusted"))
