"""The scorers that work on texts inside a task: what they move, and batches and blocks of any size."""

import os
import subprocess

import pyarrow as pa
import pytest

from skein import catalogue
from skein.operators import vectors
from skein.session import tables
from tests.compare import both

FOLDER = "/root/testdata/sf0.01"


def size(path):
    return int(subprocess.run(["du", "-sb", path], capture_output=True, text=True).stdout.split()[0]) if os.path.exists(path) else 0


def moved(spark, name):
    """Bytes that a query shuffles or writes to the shared folder."""
    shuffled = lambda: sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    stashed = lambda: size(tables(spark).removeprefix("file://"))
    before = shuffled() + stashed()
    catalogue.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return shuffled() + stashed() - before


def read(*names):
    return sum(os.path.getsize(f"{FOLDER}/{n}.parquet") for n in names)


@pytest.mark.parametrize("name", ["compression_entropy", "pair_calibrator"])
def test_entropies_move_texts_not_contexts(spark, name):
    assert moved(spark, name) < 4 * read("processed_documents", "query_positives")


def test_contexts_of_odd_texts():
    texts = ["", "abcd", "abcde", "aaaaaaa", "naïve \U0001f600\U0001f600 text", "".join(map(chr, range(0x4E00, 0x4E00 + 7000)))]
    for batch in (texts, texts[::-1], texts[:0]):
        for t, (at, count, total) in zip(batch, vectors.contexts(batch, 5, 8192), strict=True):
            want = {}
            for g in (t[p : p + 5] for p in range(len(t) - 4)):
                b = (vectors.digest(g) >> 32) % 8192
                want[b] = want.get(b, 0) + 1
            assert dict(zip(at.tolist(), count.tolist())) == want and total == max(len(t) - 4, 0)


def test_entropy_of_missing_null_and_short_texts(spark):
    from skein.operators import lexical

    docs = spark.createDataFrame([("a", "abcdefgh"), ("b", None), ("c", "abc"), ("d", "")], "id string, t string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("a", "gone"), ("a", "a"), ("a", "a")], "query_id string, candidate_id string")
    rows = {(r.query_id, r.candidate_id): r for r in lexical.cross_entropy(pairs, docs, "id", "t").collect()}
    assert len(rows) == 5 and rows["a", "b"][2:] == rows["a", "c"][2:] == rows["a", "gone"][2:]
    assert rows["a", "a"].gap == 0 and rows["a", "a"].forward < rows["a", "b"].forward



@pytest.mark.parametrize("hot", [0, 3, 256])
def test_products_are_those_of_the_counts(monkeypatch, hot):
    import random
    from collections import Counter

    import numpy as np

    monkeypatch.setattr(vectors, "HOT", hot)
    draw = random.Random(hot)
    texts = [[draw.choice(["the", "of", "naïve", "日本語の文", "a", "stone", "stones"]) for _ in range(draw.randrange(9))] for _ in range(70)] + [[], ["alone"]]
    space = vectors.Hashed(512)
    rows = pa.array(texts, pa.list_(pa.string()))

    def count(words):
        terms = [*(g for w in words for g in vectors.grams(w)), *("w:" + w for w in words), *(f"w:{a} {b}" for a, b in zip(words, words[1:]))]
        return Counter(space.places(terms).tolist()) if terms else Counter()

    t = vectors.Texts(rows, space)
    q = vectors.Queries(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["x"] * len(texts)), rows], names=["a", "b", "c"]), space)
    got = vectors.products(t, q, space.n)
    c = [count(w) for w in texts]
    norm = [sum(v * v for v in x.values()) ** 0.5 for x in c]
    assert [n for _, _, n in t.vectors(space.weight)] == pytest.approx(norm)
    want = np.array([[sum(x[k] * y[k] for k in x) / (n or 1) for y, n in zip(c, norm)] for x in c])
    assert np.allclose(got, want) and ((got == 0) == (want == 0)).all()



def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["x"] * len(texts)), pa.array(texts, pa.list_(pa.string()))], names=["a", "b", "c"])


def test_vectors_of_queries_are_worked_out_once_for_all_batches_of_texts(monkeypatch, tmp_path):
    import pyarrow.parquet as pq

    texts = [["one", "two"], [], ["two", "two", "three"], ["four"], ["one", "two"]]
    space = vectors.Hashed(512)
    pq.write_table(pa.Table.from_batches([vectors.encoded(batch(texts), space)]), tmp_path / "q.parquet")
    made = []
    texts_of = vectors.Texts
    monkeypatch.setattr(vectors, "Texts", lambda *a: made.append(1) or texts_of(*a))
    monkeypatch.setattr(vectors, "BLOCK", 2)
    monkeypatch.setattr(vectors, "ROWS", 2)
    got = {(int(i), int(j)): int(v) for ids, _, _, q, s in vectors._scored(iter([batch(texts)]), str(tmp_path), ("hashed", 512)) for i, x in zip(ids, s) for j, v in zip(q.ids, x)}
    assert len(made) == 3 and len(got) == 25
    assert got[0, 4] == got[4, 0] == got[2, 2] == vectors.SCALE and got[1, 1] == got[0, 1] == -1 and 0 < got[0, 2] < vectors.SCALE


def test_small_batches_are_joined_and_large_ones_cut(monkeypatch):
    monkeypatch.setattr(vectors, "TOKENS", 6)
    monkeypatch.setattr(vectors, "ROWS", 3)
    texts = [["a"], [], ["b", "c"], ["d"], ["e"] * 9, ["f"] * 4, ["g"] * 2, [], []]
    for step in (1, 2, 4, 9):
        got = [b.column(2).to_pylist() for b in vectors._cut((batch(texts[i : i + step]) for i in range(0, 9, step)), 2)]
        assert got == [texts[:3], texts[3:4], texts[4:5], texts[5:8], texts[8:]]


@pytest.mark.parametrize("groups", [1, 2, 24])
def test_groups_of_texts_change_no_product(monkeypatch, groups):
    import numpy as np

    texts = [["the", "stone", str(i % 7)] for i in range(40)] + [["la", "pierre", str(i % 5), "la"] for i in range(40)] + [[], ["x" * 900]]
    space, found = vectors.Hashed(512), []
    for g, hot in ((groups, 512), (1, 0)):
        monkeypatch.setattr(vectors, "GROUPS", g)
        monkeypatch.setattr(vectors, "HOT", hot)
        t, q = vectors.Texts(batch(texts).column(2), space), vectors.Queries(batch(texts), space)
        found.append(vectors.products(t, q, space.n, max(n for _, _, n in t.vectors(space.weight))))
    assert np.array_equal(*found) and found[0].max() > 0
    none = vectors.Texts(batch([[], []]).column(2), space)
    assert not vectors.products(none, q, space.n).any()


def test_sums_above_single_precision_are_exact():
    import numpy as np

    space = vectors.Hashed(512)
    t, q = vectors.Texts(batch([["a"] * 4097]).column(2), space), vectors.Queries(batch([["a"] * 4099, ["b"]]), space)
    at, w, norm = next(t.vectors(space.weight))
    have = np.zeros(512)
    have[at] = w
    want = sum(have[p] * v for p, v, i in zip(q.known[q.row], q.value, q.query) if i == 0)
    assert want > vectors.EXACT and vectors.products(t, q, space.n, norm)[0, 0] == want / q.norm[0]


PAIRS = ["hashed_ngram_eer", "tfidf_eer", "near_pair_kinds", "hashed_ngram_roc_auc", "tfidf_roc_auc", "hashed_ngram_cosine", "near_pair_examples", "scorer_leaderboard", "tfidf_cosine"]


@pytest.mark.parametrize("name", PAIRS)
def test_all_pairs_scorers_move_neither_terms_nor_pairs(spark, name):
    vocabulary = 0 if name.startswith(("hashed", "near")) else 6_000_000  # a row for each distinct term of a task
    assert moved(spark, name) < 4 * read("documents") + 300_000 + vocabulary


@pytest.mark.parametrize("name", PAIRS)
def test_all_pairs_scorers_on_more_rows_than_the_smallest_tables(spark, name):
    got, want = both(spark, FOLDER, catalogue.queries()[name], catalogue.oracle_sql()[name])
    assert got == want


def test_packed_numbers_come_back():
    import numpy as np

    for x in ([], [0], [1, 0, 255, 256, -1], [2**63 - 1, -(2**63), 7], range(70_000)):
        assert vectors.unpacked(vectors.packed(np.array(x, np.int64))).tolist() == list(x)
    few = np.zeros(vectors.SCORES, np.int64)
    few[5:50] = 3
    assert len(vectors.packed(few)) < few.nbytes / 100
    h = np.sort(np.array([vectors.digest(str(i)) for i in range(5_000)], np.uint64))
    steps = vectors.packed(np.diff(h, prepend=np.uint64(0)))
    assert len(steps) < 7.5 * len(h) and np.array_equal(np.cumsum(vectors.unpacked(steps), dtype=np.int64), h.view(np.int64))


def test_ranked_scores_are_not_shuffled_and_have_all_pairs(spark):
    from skein.operators import scoring
    from skein.queries import lexicon

    have = spark.createDataFrame([(0.25, 2, 5), (0.0, 1, 1), (0.5, 3, 0)], "score double, p bigint, n bigint")
    rows = lexicon.with_zeros(spark, FOLDER, have)
    got = {r.score: (r.p, r.n) for r in rows.collect()}
    docs, queries = (spark.read.parquet(f"{FOLDER}/documents.parquet").where(x).count() for x in ("true", "doc_id % 50 = 0"))
    assert got.keys() == {0.0, 0.25, 0.5} and got[0.25] == (2, 5) and sum(p + n for p, n in got.values()) == queries * (docs - 1)
    for ranked in (scoring.eer(rows), scoring.roc_auc(rows)):
        assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_leaderboard_moves_packed_ranges(spark):
    assert moved(spark, "scorer_leaderboard") < 18 * read("documents")  # most of it terms of few documents
