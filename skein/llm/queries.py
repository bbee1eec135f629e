"""The pN_ queries, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import containers, copies, families, labels, language, mixing, near, overlap, pieces, quotas, sizes, subjects


def _processed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "processed_documents", *columns)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(_processed(spark, d, "doc_id", "text"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(_processed(spark, d, "doc_id", "text"))


def _families(spark: SparkSession, d: str) -> DataFrame:
    return families.families(_processed(spark, d, "doc_id", "author_id", "source", "raw_id"), table(spark, d, "author_links", "author_id_a", "author_id_b"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "split_documents", "doc_id", "split")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return families.torn(_families(spark, d), _split(spark, d))


def p2_assign(spark: SparkSession, d: str) -> DataFrame:
    return families.assign(_families(spark, d), _split(spark, d))


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = _processed(spark, d, "doc_id", "author_id", "source", "raw_id")
    return families.in_batches(docs, table(spark, d, "author_links", "author_id_a", "author_id_b"), _split(spark, d))


def p2_fresh_shares(spark: SparkSession, d: str) -> DataFrame:
    return families.shares_reached(families.assign(_families(spark, d)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized(_processed(spark, d, "doc_id", "text"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(_processed(spark, d, "doc_id", "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(_processed(spark, d, "doc_id", "text"))


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(_processed(spark, d, "doc_id", "text"))


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _processed(spark, d, "doc_id", "lang", "genre", "length_bucket"), table(spark, d, "sampling_targets")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quotas.cell_report(*_cells(spark, d)).where("short").select("lang", "genre", "length_bucket")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return quotas.cell_report(*_cells(spark, d))


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return quotas.sample(*_cells(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.crossing(_processed(spark, d, "doc_id", "text"), _split(spark, d)).select("doc_id_a", "doc_id_b")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(_processed(spark, d, "doc_id", "text", "author_id", "source"), _split(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(_processed(spark, d, "doc_id", "lang", "text"))


def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.documents(_processed(spark, d, "doc_id", "lang", "text"))


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(_processed(spark, d, "doc_id", "lang", "text"))


def _raw(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents", *columns)


_VOCABULARY = f"{sizes.TOKENIZERS}/{sizes.VOCABULARY}"


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    placed = containers.containers(_raw(spark, d, "doc_id", "text"), sizes.UNITS)
    return placed.where("piece_no = 0 and n_pieces > 1").select(F.col("doc_id").cast("bigint").alias("doc_id"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers.containers(_raw(spark, d, "doc_id", "text"), _VOCABULARY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return containers.fill(containers.containers(_raw(spark, d, "doc_id", "text"), _VOCABULARY))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(_raw(spark, d, "doc_id", "source", "text"), table(spark, d, "mix_targets")).where("short").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_raw(spark, d, "doc_id", "source", "text"), table(spark, d, "mix_targets"), _VOCABULARY)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(_raw(spark, d, "doc_id", "source", "text"), table(spark, d, "mix_targets"), _VOCABULARY)


def _areas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return _raw(spark, d, "doc_id", "text"), table(spark, d, "subject_labels", "doc_id", "subject"), table(spark, d, "subject_areas", "subject")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects(*_areas(spark, d))


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(*_areas(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


_SPACE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_DENSE = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}"
_UNITS = f"len(regexp_extract_all(coalesce(text, ''), '[{_DENSE}]|[^{_SPACE}{_DENSE}]+'))"
_FORM = r"regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g')"
_PARTS = rf"list_filter(regexp_split_to_array(text, '[\n\r\x{{b}}\x{{c}}\x{{85}}\x{{2028}}\x{{2029}}|]'), lambda p: regexp_matches(p, '[^{_SPACE}]'))"
_NORMAL = f"""
p AS (SELECT doc_id, text, {_PARTS} AS parts FROM processed_documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, CASE WHEN len(parts) > 1 AND len(list_filter(parts, lambda x: NOT regexp_matches(x, '^[{_SPACE}]*\\p{{L}}{{2,20}}:'))) = 0
  THEN 'fields:' || array_to_string(list_sort(list_distinct(list_filter(list_transform(parts, lambda x: {_FORM.format('x')}), lambda x: x <> ''))), '|') ELSE {_FORM.format('text')} END AS form FROM p)"""
_LABEL = "CASE " + " ".join("WHEN b IN (" + ", ".join(f"'{x}'" for x in names) + f") THEN '{names[0]}'" for names in labels.LANGUAGES) + " END"
_CELLS = f"""
r AS (SELECT regexp_extract(lower(trim(lang)), '^([a-z]+)(?:[-_].*)?$', 1) AS b, nullif(replace(trim(split_part(lower(trim(genre)), '/', 1)), ' ', '_'), '') AS genre, nullif(replace(lower(trim(length_bucket)), '-', '_'), '') AS length_bucket FROM processed_documents),
c AS (SELECT {_LABEL} AS lang, genre, length_bucket, count(*) AS n FROM r GROUP BY ALL), n AS (SELECT count(*) // 10 AS n FROM processed_documents)"""


_NEAR = f"""{_NORMAL},
t AS (SELECT doc_id, {_FORM.format('text')} AS s FROM processed_documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, list_distinct(list_transform(range(1, len(s) - 3), lambda i: substring(s, i, 5))) AS l FROM t WHERE len(s) >= 204),
u AS (SELECT doc_id, len(l) AS n, hash(unnest(l)) AS h FROM l WHERE len(l) >= 200),
near AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n)
 GROUP BY a.doc_id, b.doc_id HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.7)"""
_RELATED = """
k AS (SELECT doc_id, 'a:' || nullif(lower(trim(author_id)), '') AS a, 'r:' || nullif(lower(trim(source)), '') || '|' || split_part(raw_id, '#', 1) AS r FROM processed_documents),
e0 AS (SELECT a AS x, r AS y FROM k WHERE a IS NOT NULL AND r IS NOT NULL UNION SELECT 'a:' || nullif(lower(trim(author_id_a)), ''), 'a:' || nullif(lower(trim(author_id_b)), '') FROM author_links WHERE trim(author_id_a) <> '' AND trim(author_id_b) <> ''),
e AS (SELECT x, y FROM e0 UNION SELECT y, x FROM e0), v AS (SELECT a AS x FROM k WHERE a IS NOT NULL UNION SELECT r FROM k WHERE r IS NOT NULL),
w(x, root) AS (SELECT x, x FROM v UNION SELECT e.y, w.root FROM w JOIN e USING (x)), c AS (SELECT x, min(root) AS root FROM w GROUP BY x),
d AS (SELECT k.doc_id, coalesce(c.root, 'd:' || k.doc_id) AS root FROM k LEFT JOIN c ON c.x = coalesce(k.r, k.a)), g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS group_doc_id FROM d),
s AS (SELECT DISTINCT group_doc_id, split FROM g JOIN split_documents USING (doc_id) WHERE split IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say about the operators' results on whole tables in reasonable time; the rest is tested against
    brute force on small rows."""
    return {
        "p1_found": f"WITH {_NEAR} SELECT doc_id_a, doc_id_b FROM near JOIN f x ON x.doc_id = doc_id_a JOIN f y ON y.doc_id = doc_id_b WHERE x.form <> y.form",
        "p2_found": f"WITH RECURSIVE {_RELATED} SELECT group_doc_id, split FROM s WHERE group_doc_id IN (SELECT group_doc_id FROM s GROUP BY ALL HAVING count(*) > 1)",
        "p6_found": f"""WITH {_NEAR}, sp AS (SELECT DISTINCT doc_id, split FROM split_documents WHERE split IS NOT NULL),
 same AS (SELECT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM f x JOIN f y ON x.form = y.form AND x.form <> '' AND x.doc_id < y.doc_id)
SELECT doc_id_a, doc_id_b FROM (SELECT * FROM near UNION SELECT * FROM same) JOIN sp p ON p.doc_id = doc_id_a JOIN sp q ON q.doc_id = doc_id_b WHERE (p.split = 'train') <> (q.split = 'train')""",
        "p3_found": f"SELECT doc_id FROM processed_documents WHERE {_UNITS} > 500",
        "p4_found": f"WITH {_NORMAL}, m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS first_doc_id FROM f WHERE form <> '') SELECT first_doc_id, doc_id FROM m WHERE doc_id <> first_doc_id",
        "p4_collapsed": f"WITH {_NORMAL} SELECT min(doc_id) AS first_doc_id, count(*) AS n_copies FROM f WHERE form <> '' GROUP BY form",
        "p5_found": f"WITH {_CELLS} SELECT t.lang, t.genre, t.length_bucket FROM sampling_targets t CROSS JOIN n LEFT JOIN c USING (lang, genre, length_bucket) WHERE coalesce(c.n, 0) < greatest(t.min_docs, t.share_ppm::BIGINT * n.n // 1000000)",
        "p8_found": f"SELECT doc_id FROM documents WHERE {_UNITS} > 1024",
        "p9_found": f"WITH u AS (SELECT lower(trim(source)) AS source, sum({_UNITS}) AS n FROM documents GROUP BY ALL), t AS (SELECT sum(n) AS n FROM u) SELECT m.source FROM mix_targets m CROSS JOIN t LEFT JOIN u ON lower(trim(m.source)) = u.source WHERE m.target_ppm::HUGEINT * t.n > m.max_repeats * coalesce(u.n, 0) * 1000000",
    }
