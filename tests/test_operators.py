"""Operators against plain Python, on small rows with every awkward case."""

import json
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.plans import skew
from skein.operators import chunking, dedup, detection, lexical, sampling, scoring, splits, studies, training
from skein.plans.skew import split_join
from skein.sources import readers, writers


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column("t").alias("x")).first().x


@pytest.mark.parametrize("text,want", [("h e l l o there", "hello there"), ("a b", "ab"), ("I am x", "I am x"), ("", ""), ("c a t ( d o g ) !", "cat (dog)!")])
def test_collapse(spark, text, want):
    assert one(spark, text, X.collapse_spaced) == want


def test_quality_of_null_and_empty(spark):
    rows = spark.createDataFrame([(None, None, "en"), ("", "a_pd", "en"), (" 　 ", "x", "zz"), ("!" * 30, "a_pd", "en"), ("aaaa " + "b" * 30, "x", "en")], "t string, s string, l string")
    r = [x.r for x in rows.select(X.dirty_reason("t", "s", X.token_count("t")).alias("r")).collect()]
    assert r == ["zero_length", "zero_length", "zero_length", "high_symbol_ratio", "long_repeat_run"]
    assert all(x.u for x in rows.select(X.untranslatable("t", "l").alias("u")).collect()[:4])


@pytest.mark.parametrize("lang,text,want", [("ru", "Привет мир", 1.0), ("ja", "漢字かなカナ", 1.0), ("en", "Привет ab", 0.25), ("xx", "abc", None), ("hi", "नमस्ते", 1.0), ("en", "123", 0.0)])
def test_script_share(spark, lang, text, want):
    got = spark.createDataFrame([(text, lang)], "t string, l string").select(X.script_share("t", "l").alias("x")).first().x
    assert got == want


def test_markup(spark):
    text = "<!-- x -->'''Bold''' [[File:a.png|b]] [[Page|label]] {{a {{b}} c}} == Head ==\n<ref>no</ref>end &amp; more"
    assert one(spark, text, X.markup_clean) == "Bold label == Head == end & more"


WORD = st.text("ab.!? \n", min_size=0, max_size=300)


@settings(max_examples=60, deadline=None)
@given(WORD)
def test_segments_keep_all_words(text):
    parts = chunking.segments(text, 7)
    assert " ".join(parts).split() == text.split()
    assert all(len(p.split()) <= 7 for p in parts)


@settings(max_examples=60, deadline=None)
@given(WORD)
def test_packed_chunks(text):
    chunks = chunking.pack(text, 20, 10, 3)
    words = " ".join(c for _, c in chunks).split()
    assert len(words) <= len(text.split())
    assert all(len(c.split()) >= 3 for _, c in chunks[:-1])


def test_split_counts(spark):
    rows = spark.range(0, 60)
    c = splits.split_counts(F.col("id"))
    for r in rows.select("id", *[v.alias(k) for k, v in c.items()]).collect():
        assert r.train + r.dev + r.test == r.id
        assert abs(r.train - 0.8 * r.id) < 1


def test_author_split_keeps_authors(spark):
    rnd = random.Random(1)
    docs = [(f"d{i}", f"a{min(int(rnd.expovariate(0.1)), 40)}", "en") for i in range(500)] + [("x", None, "en")]
    out = splits.author_aware(spark.createDataFrame(docs, "d string, a string, l string"), "a", "l").collect()
    assert len({r.author for r in out}) == len(out)
    n = {}
    for r in out:
        n[r.split] = n.get(r.split, 0) + r.n_docs
    assert sum(n.values()) == 500 and 380 <= n["train"] <= 420


def test_greedy_equals_the_sequential_rule(spark):
    rnd = random.Random(3)
    pairs = sorted({tuple(sorted(rnd.sample([f"{i:02}" for i in range(40)], 2))) for _ in range(70)})
    kept, dropped = [], set()
    for i in sorted({x for p in pairs for x in p}):
        if any((k, i) in pairs for k in kept):
            dropped.add(i)
        else:
            kept.append(i)
    got = {r.id: r.status for r in dedup.greedy(spark.createDataFrame(pairs, "lo string, hi string")).collect()}
    assert {k for k, v in got.items() if v == "kept"} == set(kept)
    assert {k for k, v in got.items() if v == "dropped"} == dropped


def test_fingerprint_edges():
    same = dedup.fingerprint(["a b c", "A  b, c!", "", None])
    assert same[0] == same[1] and same[2] == same[3] == 0


def test_exact_keeps_one_of_each_and_all_nulls(spark):
    d = spark.createDataFrame([("1", "A b"), ("2", "a  B"), ("3", None), ("4", None), ("5", "c")], "d string, t string")
    assert sorted(r.d for r in dedup.exact(d, "t", ["d"]).collect()) == ["1", "3", "4", "5"]
    assert dedup.exact(d.limit(0), "t", ["d"]).count() == 0


def test_metrics_against_plain_python(spark):
    rnd = random.Random(2)
    rows = [(q, c, round(rnd.random(), 2), rnd.random() < 0.2) for q in range(12) for c in range(30)]
    df = spark.createDataFrame(rows, "query_id int, candidate_id int, score double, positive boolean")
    got = {r.query_id: r for r in scoring.ranking(df).collect()}
    for q in range(12):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        pos = [r for r in mine if r[3]]
        if not pos:
            assert q not in got
            continue
        assert got[q].recall_5 == sum(r[3] for r in mine[:5]) / len(pos)
        assert abs(got[q].mrr - 1 / (1 + sum(r[2] > max(p[2] for p in pos) for r in mine))) < 1e-12
    p, n = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    auc = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / len(p) / len(n)
    g = scoring.by_score(df)
    assert abs(scoring.roc_auc(g).first().roc_auc - auc) < 1e-9
    assert 0 <= scoring.eer(g).first().eer <= 1
    flipped = scoring.by_score(df.withColumn("score", -F.col("score")))
    assert abs(scoring.roc_auc(flipped).first().roc_auc - (1 - auc)) < 1e-9


def test_empty_metrics(spark):
    e = spark.createDataFrame([], "query_id int, candidate_id int, score double, positive boolean")
    assert scoring.ranking(e).count() == 0 and scoring.eer(scoring.by_score(e)).count() == 0 and scoring.roc_auc(scoring.by_score(e)).count() == 0


def test_language_targets(spark):
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    cases = [({"a": 50, "b": 50, "c": 50}, 10, {"a": 5, "b": 3, "c": 2}), ({"a": 2, "b": 50, "c": 50}, 10, {"a": 2, "b": 6, "c": 2}), ({"a": 2, "b": 4, "c": 50}, 10, {"a": 2, "b": 4, "c": 4}),
             ({"a": 9, "b": 9, "z": 9}, 7, {"a": 4, "b": 3}), ({"a": 1, "b": 1, "c": 1}, 99, {"a": 1, "b": 1, "c": 1}), ({"x": 5, "y": 5}, 3, {"x": 1, "y": 2})]
    for there, total, want in cases:
        df = spark.createDataFrame([*there.items(), (None, 4)], "language string, n bigint")
        assert {r.language: r.target for r in sampling.language_targets(df, "language", "n", total, weights).collect()} == want
    assert sampling.language_targets(df.limit(0), "language", "n", 5, weights).count() == 0


def test_ranks_in_ranges_are_whole(spark):
    """A group of a third of all rows, null groups and ties: the same ranks as a plain window."""
    from pyspark.sql import Window

    rows = [(f"d{i:04}", "hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{i % 11}", f"{i * 2654435761 % 2**32:08x}" if i % 5 else "00000000") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id string, g string, u string")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("u", "doc_id"))).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    got = skew.in_order(df, ["g"], F.col("u"), "doc_id", "r", "n", ranges=16)
    assert {tuple(r) for r in got.select("doc_id", "r", "n").collect()} == {tuple(r) for r in want.select("doc_id", "r", "n").collect()}
    assert skew.in_order(df.limit(0), ["g"], F.col("u"), "doc_id", "r").count() == 0


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 50), min_size=1), st.integers(1, 300))
def test_largest_gap(sizes, total):
    got = sampling.largest_gap_quotas(sizes, total)
    assert all(0 <= v <= sizes[k] for k, v in got.items())
    assert sum(got.values()) >= min(total, sum(sizes.values())) or sum(got.values()) == sum(sizes.values())


def test_negatives_are_of_other_authors(spark):
    rows = [("1", "a", "s", "g"), ("2", "a", "s", "g"), ("3", "b", "s", "g"), ("4", "c", "t", "g"), ("5", "d", None, None), ("6", None, "s", "g")]
    got = training.controlled_negatives(spark.createDataFrame(rows, "d string, a string, s string, g string"), "a", "d", "s", "g", 1).collect()
    author = {r[0]: r[1] for r in rows}
    level = {r.anchor: r.level for r in got}
    assert all(author[r.anchor] != author[r.negative] for r in got)
    assert level == {"1": 1, "2": 1, "3": 1, "4": 3, "5": 4}


def test_calibrator_separates(spark):
    rnd = random.Random(5)
    rows = [(i, y, y + rnd.gauss(0, 0.3), rnd.random()) for i in range(200) for y in [int(i % 4 == 0)]]
    df = spark.createDataFrame(rows, "i int, label int, x double, z double")
    w, b = lexical.fit_calibrator(df, ["x", "z"])
    out = lexical.calibrated(df, ["x", "z"], w, b).collect()
    assert sum((r.score > 0) == (r.label == 1) for r in out) > 180
    with pytest.raises(ValueError):
        lexical.fit_calibrator(df.where("label = 1"), ["x"])


def test_split_join_with_a_hot_key(spark):
    left = spark.range(0, 30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 30_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = spark.createDataFrame([(7,)], "k bigint")
    got = split_join(left, right, "k", hot)
    assert got.count() == 30_000 and got.where("w <> 2 * k").count() == 0


def test_readers_and_writers(spark, tmp_path):
    rows = spark.createDataFrame([("1", "ann", "hello\nworld", None), ("2", None, "x", "en"), ("3", "bob", 'say "hi", you', "EN ")], "id string, author string, body string, lang string")
    writers.jsonl(rows, str(tmp_path / "j"))
    writers.csv(rows.where("id <> '1'"), str(tmp_path / "c.csv"))
    text = json.dumps({"datasets": [{"name": "j", "loader": "jsonl", "path": str(tmp_path / "j"), "text_field": "body", "lang_field": "lang"}, {"name": "c", "loader": "csv", "path": str(tmp_path / "c.csv"), "text_field": "body", "raw_id_field": "id"}]})
    a, b = (readers.load(spark, d).collect() for d in readers.manifest(text))
    assert sorted((r.author, r.lang) for r in a) == [("ann", "unknown"), ("bob", "en")]
    assert [r.text for r in b] == ['say "hi", you'] and b[0].raw_id == "3"
    with pytest.raises(ValueError):
        readers.manifest('{"x": 1}')
    with pytest.raises(ValueError):
        readers.manifest('[{"name": "n", "loader": "ftp"}]')
    with pytest.raises(ValueError):
        writers.manifest([], str(tmp_path / "m.json"))
    (tmp_path / "doc.json").write_text('{"a": {"id": "1", "t": "x"}, "b": {"id": "2", "t": "y"}}')
    assert sorted(r.t for r in readers.json_document(spark, str(tmp_path / "doc.json"), ["id", "t"]).collect()) == ["x", "y"]


def test_blog_zip_and_xml(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "blogs.zip", "w") as z:
        z.writestr("7.male.24.job.sign.xml", "<Blog>\n<date>1,May,2004</date>\n<post>\nfirst\nsecond\n</post>\n<date>2,May,2004</date>\nthird\n</Blog>")
    got = sorted((r.text, r.date, r.author) for r in readers.blog_zip(spark, str(tmp_path)).collect())
    assert got == [("first", "1,May,2004", "7"), ("second", "1,May,2004", "7"), ("third", "2,May,2004", "7")]
    (tmp_path / "p.xml").write_text('<posts><row Id="1" Body="a"/><row Id="2"/></posts>')
    assert sorted((r.Id, r.Body) for r in readers.xml_rows(spark, str(tmp_path / "p.xml"), "row", ["Id", "Body"]).collect()) == [("1", "a"), ("2", None)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5)], "k string, v double")
    assert "a\\|b" in writers.markdown(df, "T")
    assert writers.json_report({"t": df, "n": {"x": 1}}, str(tmp_path / "r" / "x.json"))["t"] == [{"k": "a|b", "v": 0.5}]


def test_escapes():
    assert chunking.repair_escapes("\\u0939\\u093f x \\ud83d\\ude00") == "हि x 😀"


def test_author_map_holds_all_documents(spark):
    rows = [(f"d{i:04}", "big" if i % 3 else "mid" if i % 2 else None) for i in range(900)] + [("x", "one")]
    df = spark.createDataFrame(rows, "doc_id string, author_id string")
    want = {a: sorted(d for d, x in rows if x == a) for a in ("big", "mid")}
    got = training.author_map(df, "author_id", "doc_id").collect()
    assert {r.author_id: r.ids for r in got} == want and len(got) == 2
    blocks = training.author_map(df, "author_id", "doc_id", block=100).collect()
    assert all(sorted(d for r in blocks if r.author_id == a for d in r.ids) == want[a] for a in want)
    assert all(r.n_docs == len(want[r.author_id]) and len(r.ids) < 150 for r in blocks)


def test_detection_sees_whole_texts(spark):
    en, ru = "the quiet river and the old house waited all winter. ", "тихая река и старый дом ждали всю долгую зиму. "
    rows = [(f"{lang}{i}", lang, part * 3) for lang, part in (("en", en), ("ru", ru)) for i in range(5)] + [("long", "en", en * 60 + ru * 600), ("odd", "en", "a\U0001f600b  \u00e9"), ("empty", "en", "")]
    df = spark.createDataFrame(rows, "doc_id string, lang string, text string")
    owner, place = detection.pairs([t for *_, t in rows])
    for i, (*_, t) in enumerate(rows):
        t = f" {' '.join(t.lower().split())} "
        assert (owner == i).sum() == len(t) - 1 and len(set(place[owner == i])) == len({t[k : k + 2] for k in range(len(t) - 1)})
    model = detection.fit_detector(df.where("doc_id not in ('long', 'odd', 'empty')"), "text", "lang")
    assert {r.doc_id: r.detected_lang for r in detection.detect(df, model, "text").collect()}["long"] == "ru"


def test_topic_clusters_in_each_language_and_genre(spark, small):
    from skein.queries.audits import topic_clusters

    assert topic_clusters(spark, small).columns == ["doc_id", "language", "primary_genre", "topic_cluster"]


def test_stratified_sample_and_dedup_summary(spark, small):
    rows = [(f"d{i:03}", "hot" if i % 3 else None, f"g{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, a string, b string")
    got = studies.stratified_sample(df, ["a", "b"], "doc_id", 60, 1).collect()
    n = {}
    for r in got:
        n[r.a, r.b] = n.get((r.a, r.b), 0) + 1
    assert len(got) == 60 and len(n) == 10 and all(abs(v - (8 if a else 4)) <= 1 for (a, _), v in n.items())
    assert studies.stratified_sample(df.limit(0), ["a", "b"], "doc_id", 60, 1).count() == 0
    from skein.queries.studies import dedup_summary

    steps = {r.step: r for r in dedup_summary(spark, small).collect()}
    assert steps["exact"].n_in - steps["exact"].n_dropped == steps["near"].n_in and all(0 <= r.n_dropped < r.n_in for r in steps.values())


def test_capped_pool_keeps_positives(spark):
    rows = [(q, c, c / 100, c % 10 == 0) for q in (1, 2) for c in range(100)]
    df = spark.createDataFrame(rows, "query_id int, candidate_id int, score double, positive boolean")
    got = studies.capped_pool(df, 25, 42).collect()
    for q in (1, 2):
        mine = [r for r in got if r.query_id == q]
        assert len(mine) == 25 and sum(r.positive for r in mine) == 10
    assert {r.candidate_id for r in got if r.query_id == 1} != {r.candidate_id for r in got if r.query_id == 2}
    assert sum(r.positive for r in studies.capped_pool(df, 5, 42).collect()) == 20


def test_catalogue_entry(spark):
    rows = [("Text", "12", "xx; EN;fr", "Ann; Bob"), (" text ", " 7 ", "de", " ;Cid"), ("Sound", "1", "en", "A"), ("Text", "x1", "en", "A"), ("Text", "2", "xx", "A"), ("Text", "3", "en", " ; "), (None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, n string, l string, a string")
    got = [r.e and tuple(r.e) for r in df.select(X.catalogue_entry(*map(F.col, "knla"), ["en", "fr", "de"]).alias("e")).collect()]
    assert got == [("12", "en", "Ann"), ("7", "de", "Cid"), None, None, None, None, None]


def test_topic_shortcut(spark, small):
    from skein.queries.studies import topic_shortcut

    r = topic_shortcut(spark, small).first()
    assert r.n_pairs > 0 and 0 <= r.pct_same_topic <= 100


def test_planned_fill_is_bucket_fill_of_each_group(spark):
    rnd = random.Random(2)
    rows = [(f"d{i:04}", rnd.choice("xyz"), rnd.choice(["a", "b", "c", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id string, g string, c string")
    weights = {"a": 0.6, "b": 0.4}
    got = {(r.doc_id, r["pass"]) for r in sampling.planned_fill(df, "g", "c", "doc_id", {"x": 120, "y": 30}, weights, 5).collect()}
    want = set()
    for g, n in (("x", 120), ("y", 30)):
        want |= {(r.doc_id, r["pass"]) for r in sampling.bucket_fill(df.where(F.col("g") == g), "g", "c", "doc_id", n, weights, 5).collect()}
    assert got == want and len(got) == 150


def test_construct_and_merge(spark, small):
    """Chunks are named after their document, splits keep to the stages' counts, documents without author stay."""
    from skein.plans import pipelines

    raw = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "raw_id", "author", "text", "lang", "source", "genre")
    c = pipelines.construct(raw, 50, genres={"news": 0.5, "social_media": 0.5})
    n = {r.name: r.n for r in c.stages.collect()}
    assert n["raw"] >= n["clean"] == n["audited"] >= n["author_capped"] and n["sampled"] <= 50 and n["unique"] <= n["chunked"]
    assert c.documents.select("doc_id").distinct().count() == n["with_role"]
    docs = [(f"d{i}", None if i % 5 == 0 else f"a{i % 7}", f"the text of number {i} and its own words w{i} x{i * 7} y{i * 13} z{i * 17} " * 3, "en", "s", "news") for i in range(60)]
    p = spark.createDataFrame([*docs, ("again", "a1", docs[3][2], "en", "s", "news")], "doc_id string, author_id string, text string, lang string, source string, genre string")
    m = pipelines.merge(p.where("doc_id <> 'again'"), p.where("doc_id = 'again'")).collect()
    assert "d3" not in {r.doc_id for r in m} and "again" in {r.doc_id for r in m}
    assert all(r.split and (r.retrieval_role is None) == (r.author_id is None) for r in m) and any(r.author_id is None for r in m)
