"""Row-level queries: keys, labels, quality measures, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query
from ..session import spread, stash, table

WS = X.WS
#: SQL pieces shared by the statements. DuckDB's regular expressions lack look-behind and back-references.
TOKENS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda t: t <> '')"


def squeeze_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def count_sql(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


SYM, SYM_WS = X.SYMBOL, X.SYMBOL_OR_WS
#: The rule table of this data's sources: a fixed genre, or a primary genre to put the given one under.
GENRES = {
    "headline_briefs": ("fixed", "news"), "feedpulse": ("under", "social_media"), "weblog_corpus": ("under", "blog/general"), "cartvoice_reviews": ("fixed", "ecommerce_reviews"),
    "preprint_digest": ("fixed", "research_paper"), "ar_verse": ("fixed", "poetry"), "hindi_tales": ("fixed", "literature"), "ru_pd_texts": ("fixed", "literature"),
    "de_pd_shelf": ("fixed", "literature"), "fr_pd_shelf": ("fixed", "literature"), "es_pd_shelf": ("fixed", "literature"), "leafboard_notes": ("fixed", "social_media/leafboard"),
}


def docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = table(spark, d, "processed_documents", *columns)
    return spread(df, "doc_id") if "text" in columns and "doc_id" in columns else df


@query("SELECT doc_id, sha256(concat_ws(':', source, author)) AS author_id FROM documents")
def author_hash(spark, d):
    return table(spark, d, "documents", "doc_id", "source", "author").select("doc_id", X.author_key("source", "author").alias("author_id"))


@query(f"""
WITH r AS (SELECT doc_id, coalesce(text, '') AS t, author, coalesce(nullif(lower(trim(lang)), ''), 'unknown') AS lang, source, raw_id FROM documents)
SELECT coalesce(raw_id, source || ':' || doc_id) AS raw_id, doc_id, author, lang, source, length(t)::INT AS n_chars FROM r WHERE regexp_matches(t, '{X.NOT_WS}') AND author IS NOT NULL""")
def field_mapping(spark, d):
    """Raw schema: rows without text or author are dropped, a missing language becomes unknown, a missing id is made."""
    r = table(spark, d, "documents", "doc_id", "text", "author", "lang", "source", "raw_id").where(F.coalesce("text", F.lit("")).rlike(X.NOT_WS) & F.col("author").isNotNull())
    lang = F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("unknown"))
    made = F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))
    return r.select(F.coalesce("raw_id", made).alias("raw_id"), "doc_id", "author", lang.alias("lang"), "source", F.length("text").alias("n_chars"))


def _genre_sql() -> str:
    parts = []
    for name, (kind, base) in GENRES.items():
        top = base.split("/")[0]
        made = f"'{base}'" if kind == "fixed" else f"CASE WHEN g IS NULL THEN '{base}' WHEN starts_with(g, '{top}') THEN g ELSE '{top}/' || g END"
        parts.append(f"WHEN source = '{name}' THEN {made}")
    return f"""WITH r AS (SELECT doc_id, source, nullif(translate(lower(regexp_replace(genre, '^{WS}+|{WS}+$', '', 'g')), ' \\', '_/'), '') AS g FROM processed_documents)
SELECT doc_id, CASE {' '.join(parts)} ELSE coalesce(g, 'unknown') END AS genre FROM r"""


@query(_genre_sql())
def genre_normalise(spark, d):
    return docs(spark, d, "doc_id", "source", "genre").select("doc_id", X.normal_genre("genre", "source", GENRES).alias("genre"))


@query(f"""
SELECT doc_id, n_tokens::INT AS n_tokens, CASE WHEN n_tokens <= 10 THEN 'short' WHEN n_tokens <= 100 THEN 'medium' WHEN n_tokens <= 500 THEN 'long' ELSE 'extra_long' END AS length_bucket
FROM (SELECT doc_id, len({TOKENS}) AS n_tokens FROM processed_documents)""")
def length_bucket(spark, d):
    n = docs(spark, d, "doc_id", "text").select("doc_id", X.token_count("text").alias("n_tokens"))
    return n.select("doc_id", "n_tokens", X.length_class("n_tokens").alias("length_bucket"))


@query(f"""
SELECT doc_id, split_part(genre, '/', 1) AS primary_genre, translate(lower(regexp_replace(genre, '^{WS}+|{WS}+$', '', 'g')), ' \\', '_/') AS slug,
 coalesce(nullif(trim(genre), ''), 'unknown') AS label FROM processed_documents""")
def genre_labels(spark, d):
    return docs(spark, d, "doc_id", "genre").select("doc_id", X.primary("genre").alias("primary_genre"), X.slug("genre").alias("slug"), X.label_or_unknown("genre").alias("label"))


@query(f"""
WITH s AS (SELECT doc_id, {squeeze_sql('text')} AS t FROM processed_documents)
SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(substring(t, 1, 217), ' ') || '...' END AS snippet FROM s""")
def snippet(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", X.snippet("text").alias("snippet"))


_FOLDED = "lower(upper(replace(replace(" + squeeze_sql("text") + ", 'ß', 'ss'), 'ẞ', 'ss')))"


@query(f"SELECT doc_id, md5({_FOLDED}) AS text_key FROM processed_documents")
def text_key(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", X.text_key("text").alias("text_key"))


@query("""
WITH r AS (SELECT doc_id, replace(lower(trim(lang)), '_', '-') AS v FROM processed_documents)
SELECT doc_id, coalesce(CASE WHEN starts_with(v, 'zh') THEN 'zh' WHEN starts_with(v, 'en') THEN 'en' WHEN starts_with(v, 'es') THEN 'es' WHEN starts_with(v, 'fr') THEN 'fr' WHEN starts_with(v, 'de') THEN 'de'
 WHEN starts_with(v, 'ar') THEN 'ar' WHEN starts_with(v, 'ru') THEN 'ru' WHEN starts_with(v, 'ja') THEN 'ja' WHEN starts_with(v, 'ko') THEN 'ko' WHEN starts_with(v, 'hi') THEN 'hi' ELSE split_part(v, '-', 1) END, '') AS lang FROM r""")
def canonical_language(spark, d):
    return docs(spark, d, "doc_id", "lang").select("doc_id", X.canonical_language("lang").alias("lang"))


@query(f"SELECT doc_id, substring(text, 1, 2000) AS text, {squeeze_sql('text')} AS flat FROM processed_documents")
def truncate_chars(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.substring("text", 1, 2000).alias("text"), X.squeeze("text").alias("flat"))


# -- quality


@query(f"SELECT doc_id, CASE WHEN len(t) > 0 THEN len(list_distinct(t))::DOUBLE / len(t) ELSE 0.0 END AS unique_share FROM (SELECT doc_id, {TOKENS} AS t FROM processed_documents)")
def unique_token_ratio(spark, d):
    text = F.coalesce("text", F.lit(""))
    return docs(spark, d, "doc_id", "text").select("doc_id", X.unique_token_share(text).alias("unique_share"))


_SYMBOL_SHARE = f"(CASE WHEN coalesce(contains(lower(source), 'pd'), false) THEN {count_sql('text', SYM_WS)} ELSE {count_sql('text', SYM)} END)::DOUBLE / greatest(length(text), 1)"


@query(f"SELECT doc_id, {_SYMBOL_SHARE} AS symbol_share FROM processed_documents WHERE text IS NOT NULL")
def symbol_ratio(spark, d):
    return docs(spark, d, "doc_id", "text", "source").where("text is not null").select("doc_id", X.symbol_share("text", "source").alias("symbol_share"))


@query(f"SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(text, '{SYM}+'), lambda r: length(r))), 0)::INT AS symbol_run FROM processed_documents WHERE text IS NOT NULL")
def symbol_run(spark, d):
    return docs(spark, d, "doc_id", "text").where("text is not null").select("doc_id", X.symbol_run("text").alias("symbol_run"))


_ISLANDS = f"""
chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM processed_documents WHERE length(text) > 0),
marked AS (SELECT *, CASE WHEN lag(c) OVER (PARTITION BY doc_id ORDER BY i) = c THEN 0 ELSE 1 END AS new FROM chars),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked),
runs AS (SELECT doc_id, island, any_value(c) AS c, count(*) AS n FROM islands GROUP BY ALL),
longest AS (SELECT doc_id, max(n) AS n FROM runs WHERE NOT regexp_matches(c, '{WS}') GROUP BY ALL)"""


@query(f"WITH {_ISLANDS} SELECT p.doc_id, CASE WHEN n > 1 THEN n ELSE 0 END::INT AS repeat_run FROM processed_documents p LEFT JOIN longest USING (doc_id) WHERE p.text IS NOT NULL")
def repeat_run(spark, d):
    return docs(spark, d, "doc_id", "text").where("text is not null").select("doc_id", X.repeat_run("text").alias("repeat_run"))


_REASON = f"""
WITH {_ISLANDS}, t AS (SELECT p.doc_id, source, coalesce(text, '') AS text, {TOKENS} AS t, coalesce(n, 0) AS n FROM processed_documents p LEFT JOIN longest USING (doc_id))
SELECT doc_id, source, CASE WHEN len(t) = 0 THEN 'zero_length' WHEN len(list_distinct(t))::DOUBLE / len(t) < 0.2 THEN 'low_unique_ratio' WHEN {_SYMBOL_SHARE} > 0.4 THEN 'high_symbol_ratio'
 WHEN contains(lower(source), 'pd') AND regexp_matches(text, '{SYM}{{6,}}') THEN 'long_symbol_run' WHEN n > 20 THEN 'long_repeat_run' END AS reason FROM t"""


@query(f"SELECT doc_id, reason FROM ({_REASON})")
def dirty_reason(spark, d):
    return docs(spark, d, "doc_id", "text", "source").select("doc_id", X.dirty_reason("text", "source", X.token_count("text")).alias("reason"))


@query(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_docs, count(DISTINCT source) AS n_sources FROM ({_REASON}) GROUP BY ALL")
def dirty_reason_counts(spark, d):
    r = docs(spark, d, "doc_id", "text", "source").select("source", F.coalesce(X.dirty_reason("text", "source", X.token_count("text")), F.lit("kept")).alias("reason"))
    return r.groupBy("reason").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("source").alias("n_sources"))


_SPACING = f"""
tk AS (SELECT doc_id, unnest({TOKENS}) AS t, generate_subscripts({TOKENS}, 1) AS i FROM processed_documents WHERE text IS NOT NULL),
sg AS (SELECT *, regexp_full_match(t, '\\p{{L}}') AS single, i - row_number() OVER (PARTITION BY doc_id, regexp_full_match(t, '\\p{{L}}') ORDER BY i) AS g FROM tk),
rn AS (SELECT doc_id, g, count(*) AS n FROM sg WHERE single GROUP BY ALL),
mx AS (SELECT doc_id, max(n) AS run FROM rn GROUP BY ALL),
sp AS (SELECT doc_id, avg(single::INT) AS ratio FROM sg GROUP BY ALL)"""


@query(f"WITH {_SPACING} SELECT p.doc_id, coalesce(ratio, 0.0) AS single_share, coalesce(run, 0)::INT AS single_run FROM processed_documents p LEFT JOIN sp USING (doc_id) LEFT JOIN mx USING (doc_id) WHERE text IS NOT NULL")
def spacing_stats(spark, d):
    return docs(spark, d, "doc_id", "text").where("text is not null").select("doc_id", X.single_letter_share("text").alias("single_share"), X.single_letter_run("text").alias("single_run"))


_LETTERS = count_sql("text", r"\p{L}")
_ALPHA = f"CASE WHEN {count_sql('text', X.NOT_WS)} > 0 THEN {_LETTERS}::DOUBLE / {count_sql('text', X.NOT_WS)} ELSE 0.0 END"
_ALPHA_TOKENS = f"CASE WHEN len({TOKENS}) > 0 THEN len(list_filter({TOKENS}, lambda t: regexp_matches(t, '\\p{{L}}')))::DOUBLE / len({TOKENS}) ELSE 0.0 END"


@query(f"SELECT doc_id, {_ALPHA} AS letter_share, {_ALPHA_TOKENS} AS letter_token_share FROM processed_documents WHERE text IS NOT NULL")
def alpha_ratio(spark, d):
    return docs(spark, d, "doc_id", "text").where("text is not null").select("doc_id", X.letter_share("text").alias("letter_share"), X.letter_token_share("text").alias("letter_token_share"))


def _script_sql() -> str:
    parts = []
    for code, names in X.SCRIPTS.items():
        cls = "[" + "".join(rf"\p{{{n}}}" for n in names) + "]"
        keep = f"len(list_filter(regexp_extract_all(text, '\\p{{L}}'), lambda c: regexp_matches(c, '{cls}')))"
        parts.append(f"WHEN lang = '{code}' THEN CASE WHEN {_LETTERS} > 0 THEN {keep}::DOUBLE / {_LETTERS} ELSE 0.0 END")
    return f"CASE {' '.join(parts)} END"


@query(f"SELECT doc_id, {_script_sql()} AS script_share FROM processed_documents WHERE text IS NOT NULL")
def script_ratio(spark, d):
    return docs(spark, d, "doc_id", "text", "lang").where("text is not null").select("doc_id", X.script_share("text", "lang").alias("script_share"))


_LEAST = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.LEAST_SCRIPT.items()) + f" ELSE {X.LEAST_SCRIPT_ELSE} END"
_UNTRANSLATABLE = f"""({_ALPHA_TOKENS} = 0 OR {_ALPHA} < 0.25 OR {_ALPHA_TOKENS} < 0.5 OR coalesce(ratio, 0) > 0.45 OR coalesce(run, 0) >= 10
 OR coalesce({_LETTERS} >= 8 AND {_script_sql()} < {_LEAST}, false))"""


@query(f"WITH {_SPACING} SELECT p.doc_id, {_UNTRANSLATABLE} AS untranslatable FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM processed_documents) p LEFT JOIN sp USING (doc_id) LEFT JOIN mx USING (doc_id)")
def untranslatable(spark, d):
    return docs(spark, d, "doc_id", "text", "lang").select("doc_id", X.untranslatable("text", "lang").alias("untranslatable"))


@query(f"""
SELECT doc_id, length(text)::DOUBLE AS chars, len({TOKENS})::DOUBLE AS tokens, {count_sql('text', SYM)}::DOUBLE / greatest(length(text), 1) AS punctuation, {count_sql('text', chr(92) + 'p{Nd}')}::DOUBLE / greatest(length(text), 1) AS digits,
 {count_sql('text', chr(92) + 'p{Lu}')}::DOUBLE / greatest(length(text), 1) AS upper, {count_sql('text', WS)}::DOUBLE / greatest(length(text), 1) AS spaces,
 CASE WHEN len({TOKENS}) > 0 THEN (length(text) - {count_sql('text', WS)})::DOUBLE / len({TOKENS}) ELSE 0.0 END AS token_length
FROM (SELECT doc_id, coalesce(text, '') AS text FROM processed_documents)""")
def surface_features(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", *X.surface("text"))


@query(name="quality_filter")
def quality_filter(spark, d):
    """Collapse spaced letters, then keep or drop with the first reason; the drop log's columns."""
    r = stash(docs(spark, d, "raw_id", "doc_id", "lang", "source", "text").withColumn("text", X.despaced("text")), "despaced")
    reason = X.filter_reason("text", "source", X.canonical_language("lang"))
    return r.select("raw_id", "doc_id", "lang", "source", reason.alias("reason"), F.substring(X.squeeze("text"), 1, 100).alias("snippet"))


@query(name="collapse_spacing")
def collapse_spacing(spark, d):
    return docs(spark, d, "doc_id", "text").where("text is not null").select("doc_id", X.despaced("text").alias("text"))


# -- segments and cleaning


@query(f"""
WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n[\\x{{9}}-\\x{{d}}\\x{{20}}]*\\n'), lambda p: regexp_replace(p, '^{WS}+|{WS}+$', '', 'g')), lambda p: p <> '') AS p FROM processed_documents WHERE text IS NOT NULL)
SELECT doc_id, len(p)::INT AS n_paragraphs, list_max(list_transform(p, lambda x: length(x)))::INT AS longest FROM c WHERE len(p) > 0""")
def paragraphs(spark, d):
    p = docs(spark, d, "doc_id", "text").where(F.col("text").isNotNull() & (F.length(X.strip("text")) > 0)).select("doc_id", X.paragraphs("text").alias("p"))
    return p.select("doc_id", F.size("p").alias("n_paragraphs"), F.array_max(F.transform("p", F.length)).alias("longest"))


@query(f"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '({X.SENTENCE_END}){WS}+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g') AS t FROM processed_documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda p: regexp_replace(p, '^{WS}+|{WS}+$', '', 'g')), lambda p: p <> '') AS s FROM m)
SELECT doc_id, len(s)::INT AS n_sentences, list_max(list_transform(s, lambda x: length(x)))::INT AS longest FROM s WHERE len(s) > 0""")
def sentences(spark, d):
    s = docs(spark, d, "doc_id", "text").where(F.col("text").isNotNull() & (F.length(X.strip("text")) > 0)).select("doc_id", X.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.array_max(F.transform("s", F.length)).alias("longest"))


def unescape_sql(x: str) -> str:
    for name, char in X.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _replace(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


_HTML = _replace(_replace(unescape_sql("text"), "(?is)<pre><code>.*?</code></pre>", " "), "(?s)<[^>]+>", " ")


@query(f"SELECT doc_id, {squeeze_sql(_HTML)} AS text FROM processed_documents")
def html_clean(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", X.html_clean("text").alias("text"))


def _markup_sql() -> str:
    x = "text"
    for p, by in [(r"(?s)<!--.*?-->", " "), (r"(?is)<ref[^>]*/>|<ref[^>]*>.*?</ref>", " "), (r"(?s)<[^>]+>", " "), *[(r"\{\{[^{}]*\}\}", " ")] * 8, (r"(?s)\{\|.*?\|\}", " "), (r"(?i)\[\[(?:category|file|image):[^\]]*\]\]", " "), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1"), (r"\[https?://[^\s\]]+ ?([^\]]*)\]", r"\1"), (r"(?m)^=+[ \t]*(.*?)[ \t]*=+[ \t]*$", r"\1"), ("''{2,}", "")]:
        x = _replace(x, p, by)
    return f"SELECT doc_id, {squeeze_sql(unescape_sql(x))} AS text FROM processed_documents WHERE source LIKE 'wikitext%'"


@query(_markup_sql())
def markup_clean(spark, d):
    return docs(spark, d, "doc_id", "text", "source").where("source like 'wikitext%'").select("doc_id", X.markup_clean("text").alias("text"))


@query(f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?is)^.*?\\*\\*\\* ?START OF[^\\n]*\\*\\*\\*', ''), '(?is)\\*\\*\\* ?END OF.*$', ''), '^{WS}+|{WS}+$', '', 'g') AS text FROM processed_documents""")
def boilerplate_strip(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", X.boilerplate_strip("text").alias("text"))


#: Keyword rules of the genre classifiers for shelves.
KEYWORDS = [("poetry", ["poem", "verse", "poes", "gedicht", "стих"]), ("drama", ["drama", "play", "theat", "comed"]), ("letters", ["letter", "carta", "lettre", "brief", "письм"])]
_KEY_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{g}'" for g, w in KEYWORDS) + " ELSE 'prose' END"


@query(f"SELECT genre, count(*) AS n_docs FROM (SELECT {_KEY_CASE} AS genre FROM processed_documents WHERE text IS NOT NULL) GROUP BY ALL")
def keyword_genre(spark, d):
    return docs(spark, d, "text").where("text is not null").groupBy(X.keyword_genre("text", KEYWORDS, "prose").alias("genre")).agg(F.count(F.lit(1)).alias("n_docs"))


@query("""
SELECT doc_id, CASE WHEN genre LIKE 'qna/question%' THEN 'question' WHEN genre LIKE 'qna/answer%' THEN 'answer' WHEN genre LIKE 'qna/comment%' THEN 'comment' ELSE 'post' END AS post_type,
 CASE WHEN author IS NULL THEN 'no_author' WHEN text IS NULL OR trim(text) = '' THEN 'no_text' WHEN length(text) < 20 THEN 'too_short' END AS reject FROM documents WHERE source LIKE '%\\_crawl%' ESCAPE '\\'""")
def post_typing(spark, d):
    r = table(spark, d, "documents", "doc_id", "genre", "author", "text", "source").where("source like '%\\_crawl%'")
    kind = F.when(F.col("genre").startswith("qna/question"), "question").when(F.col("genre").startswith("qna/answer"), "answer").when(F.col("genre").startswith("qna/comment"), "comment").otherwise("post")
    reject = F.when(F.col("author").isNull(), "no_author").when(F.col("text").isNull() | (F.trim("text") == ""), "no_text").when(F.length("text") < 20, "too_short")
    return r.select("doc_id", kind.alias("post_type"), reject.alias("reject"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY received_at, raw_id) AS n FROM crawl_comments WHERE author IS NOT NULL AND length(trim(text)) >= 20)
SELECT comment_id, raw_id, video_id, coalesce(channel_id, author) AS author, coalesce(lower(trim(lang)), 'unknown') AS lang FROM r WHERE n = 1""")
def comment_accept(spark, d):
    """Comments with an author and at least 20 characters; of those received several times, the first."""
    from pyspark.sql import Window as W

    r = table(spark, d, "crawl_comments").where("author is not null and length(trim(text)) >= 20")
    r = r.withColumn("n", F.row_number().over(W.partitionBy("comment_id").orderBy("received_at", "raw_id"))).where("n = 1")
    return r.select("comment_id", "raw_id", "video_id", F.coalesce("channel_id", "author").alias("author"), F.coalesce(F.lower(F.trim("lang")), F.lit("unknown")).alias("lang"))


#: Language of a source by its name.
SOURCE_LANGUAGE = {"ru": "ru", "de": "de", "fr": "fr", "es": "es", "ar": "ar", "hindi": "hi", "cartvoice": "en", "preprint": "en"}


@query("SELECT source, CASE split_part(source, '_', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE_LANGUAGE.items()) + " ELSE 'unknown' END AS lang, count(*) AS n_docs FROM processed_documents GROUP BY ALL")
def site_language(spark, d):
    r = docs(spark, d, "source").select("source", X.mapped(F.split_part("source", F.lit("_"), F.lit(1)), SOURCE_LANGUAGE, F.lit("unknown")).alias("lang"))
    return r.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"))


@query("""
WITH t(i, name) AS (VALUES (1, 'EER_mean'), (2, 'roc-auc'), (3, ' Recall@5 '), (4, 'mrr')), m(i, model, n) AS (VALUES (1, 'my-e5-large', 560000000::BIGINT), (2, 'Llama3-8b', 8030000000::BIGINT), (3, 'tfidf', 0::BIGINT), (4, 'other', 33000000::BIGINT)),
x AS (SELECT *, replace(lower(trim(name)), '-', '_') AS v FROM t JOIN m USING (i))
SELECT i, CASE WHEN starts_with(v, 'eer') THEN 'eer' ELSE v END AS metric, starts_with(v, 'eer') AS lower_is_better, CASE WHEN starts_with(v, 'eer') OR v = 'roc_auc' THEN 'attribution' ELSE 'representation' END AS task,
 CASE WHEN model LIKE '%e5%' THEN 'encoder' WHEN lower(model) LIKE '%llama%' THEN 'decoder' WHEN model LIKE '%tfidf%' THEN 'baseline' ELSE 'other' END AS family,
 CASE WHEN n >= 1000000000 THEN round_even(n / 1e9, 1)::DECIMAL(9, 1)::VARCHAR || 'B' WHEN n >= 1000000 THEN round_even(n / 1e6, 0)::INT::VARCHAR || 'M' ELSE n::VARCHAR END AS size FROM x""")
def metric_labels(spark, d):
    rows = [(1, "EER_mean", "my-e5-large", 560_000_000), (2, "roc-auc", "Llama3-8b", 8_030_000_000), (3, " Recall@5 ", "tfidf", 0), (4, "mrr", "other", 33_000_000)]
    t = spark.createDataFrame(rows, "i int, name string, model string, n bigint")
    return t.select("i", X.metric_name("name").alias("metric"), X.lower_is_better("name").alias("lower_is_better"), X.metric_task("name").alias("task"), X.model_family("model").alias("family"), X.parameters_for_humans("n").alias("size"))
