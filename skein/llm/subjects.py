"""Problem 10: subject areas of documents, by a seeded non-negative factorisation of the document-term matrix.

Components 0..K-1 are anchored to the subjects: their term weights start from the hand-labelled documents and keep
those counts as a prior. One more component starts from all labelled documents and takes what belongs to no subject.
Alternating multiplicative updates (for the Kullback-Leibler divergence) run over all documents: the document weights
are updated where the document is, the term weights are summed over all documents. A sentence is about the subject
to which its terms owe most, if one of them clearly belongs to it; a document has the subjects of at least a third of
its sentences.

Terms are words; where scripts write without spaces, runs of two and three characters. The vocabulary is that of the
labelled documents, at most LABELLED of them, and holds at most MOST_TERMS anchored terms, so the model's size does not
depend on the number of documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stash
from . import textkit as T
from .language import _sentences

LABELLED, LEAST_DOCS, PRIOR, ROUNDS, INNER = 50_000, 3, 5.0, 3, 12
#: Anchored terms of the model: bounds what the driver holds and each task gets, K + 1 numbers a term.
MOST_TERMS = 100_000
CLEAR, SHARE = 0.5, 1 / 3


@dataclass
class Terms:
    """Terms of a batch: sentence and hash of each occurrence, and of each sentence its document and whether it counts."""

    sentence: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    counts: np.ndarray


def terms(texts: list[str]) -> Terms:
    """A sentence counts if it has a letter and is more than a lone tag or mention."""
    cp, sentence, doc, first, n_words, n_chars, _ = _sentences(texts)
    k = T.kinds()[np.minimum(cp, 0x10FFFF)]
    letter = ((k & T.KEPT) != 0) & ((k & T.DIGIT) == 0)
    cjk = letter & ((k & T.CJK) != 0)
    word = letter & ~cjk
    n = len(doc)
    lettered = np.bincount(sentence[letter], minlength=n) if n else np.zeros(0, int)
    alone = n_words <= 1
    tag = np.zeros(n, bool)
    for i in np.flatnonzero(alone & (lettered > 0) & (n_chars < 40)):
        text = texts[doc[i]][first[i] : first[i] + 60].strip()
        tag[i] = bool(re.match(r"[@#]|\w+://", text))
    ok = (lettered > 1) & ~tag
    if not n:
        return Terms(np.zeros(0, np.int64), np.zeros(0, np.uint64), doc, ok)
    # words
    start = word & (~np.concatenate(([False], word[:-1])) | np.concatenate(([True], sentence[1:] != sentence[:-1])))
    at = np.flatnonzero(word)
    parts_s, parts_h = [], []
    if len(at):
        head = np.flatnonzero(start[at])
        length = np.diff(np.concatenate((head, [len(at)])))
        place = (np.arange(len(at)) - np.repeat(head, length)).astype(np.uint64)
        h = np.add.reduceat(T.mix(cp[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place), head)
        parts_s.append(sentence[at[head]])
        parts_h.append(T.mix(h))
    c = cp.astype(np.uint64)
    for g in (2, 3):
        m = len(cp) - g + 1
        if m <= 0:
            continue
        inside = cjk[:m].copy()
        x = np.full(m, g, np.uint64)
        for j in range(g):
            inside &= cjk[j : m + j] & (sentence[j : m + j] == sentence[:m])
            x = x * np.uint64(0x9E3779B97F4A7C15) + c[j : m + j]
        parts_s.append(sentence[:m][inside])
        parts_h.append(T.mix(x[inside]))
    s, h = np.concatenate(parts_s), np.concatenate(parts_h)
    order = np.argsort(s, kind="stable")
    return Terms(s[order], h[order], doc, ok)


def _count(subjects: list[str]):
    schema = pa.schema([("term", pa.int64()), ("k", pa.int32()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, marks = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in T.slices(texts):
                t = terms(texts[lo:hi])
                pair = np.unique(np.stack([t.doc[t.sentence].astype(np.uint64), t.hash]), axis=1) if len(t.hash) else np.zeros((2, 0), np.uint64)
                d, h = pair[0].astype(np.int64), pair[1]
                out_t, out_k, out_n = [], [], []
                for k in range(len(subjects) + 1):  # the last: every labelled document
                    w = np.array([1.0 if k == len(subjects) else (1.0 / len(m) if subjects[k] in m else 0.0) for m in marks[lo:hi]])
                    have = w[d] > 0
                    if have.any():
                        u, inverse = np.unique(h[have], return_inverse=True)
                        out_t.append(u.view(np.int64))
                        out_k.append(np.full(len(u), k, np.int32))
                        out_n.append(np.bincount(inverse, w[d[have]]))
                if out_t:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_t, out_k, out_n)], schema=schema)

    return run


@dataclass
class Model:
    """vocabulary: sorted hashes of the anchored terms; weights: (K + 1, V) shares of each component's terms; seed: the
    labelled counts; other: labelled count of all terms without anchor, which only the last component has."""

    subjects: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray
    seed: np.ndarray
    other: float


def _shares(counts: np.ndarray, other: float) -> np.ndarray:
    total = counts.sum(1)
    total[-1] += other
    return counts / np.maximum(total, 1e-9)[:, None]


def seeded(docs: DataFrame, labels: DataFrame, subjects: list[str], least: int = LEAST_DOCS, labelled: int = LABELLED, most: int = MOST_TERMS) -> Model:
    """Component weights from the labelled documents, at most ``labelled`` of them by smallest hash. A null subject
    counts for no component; a document with several shares itself among them. The terms are counted and anchored where
    they are; the ``most`` anchored terms of most documents reach the driver, the others count as terms without anchor."""
    ship(docs.sparkSession)
    marks = labels.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("marks"))  # a handful a document
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = docs.select("doc_id", "text").where("text is not null").join(marks, "doc_id").select("text", "marks")
    counted = rows.mapInArrow(_count(subjects), "term bigint, k int, n double").groupBy("term", "k").agg(F.sum("n").alias("n"))
    # anchors: a subject keeps the terms that clearly more of its documents have than all documents (the lower end of
    # Wilson's interval at 1.64); the rest are zero, and multiplicative updates leave zeros alone
    n_subjects = len(subjects)
    counts = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0.0)) for k in range(n_subjects + 1)]
    by_term = stash(counted.groupBy("term").agg(F.array(*counts).alias("c")).withColumn("all", F.element_at("c", -1)).where(F.col("all") >= least), "term-counts")
    sums = by_term.agg(*(F.coalesce(F.sum(F.col("c")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(n_subjects + 1))).first()
    z2 = 1.64**2
    seeds = []
    for k in range(n_subjects):
        n, all_ = F.col("c")[k], F.col("all")
        part = n / all_
        low = (part + z2 / (2 * all_) - 1.64 * F.sqrt(F.greatest(part * (1 - part), F.lit(0.0)) / all_ + z2 / (4 * all_ * all_))) / (1 + z2 / all_)
        seeds.append(F.when(low > max(1.2 * sums[k] / max(sums[n_subjects], 1e-9), 0.2), n).otherwise(0.0))
    by_term = by_term.select("term", "all", F.array(*seeds).alias("seed")).withColumn("anchored", F.aggregate("seed", F.lit(0.0), lambda x, y: x + y))
    rest = F.greatest(F.col("all") - F.col("anchored"), 0.02 * F.col("all") + PRIOR / 10)
    by_term = by_term.withColumn("rest", rest)
    other = by_term.where("anchored = 0").agg(F.coalesce(F.sum("rest"), F.lit(0.0)).alias("n")).first().n
    kept = by_term.where("anchored > 0").orderBy(F.desc("anchored"), "term").limit(most)  # a tie at the end: by hash
    got = kept.select("term", "seed", "rest").toPandas()  # at most ``most`` rows
    other += by_term.where("anchored > 0").agg(F.coalesce(F.sum("rest"), F.lit(0.0)).alias("n")).first().n - float(got.rest.sum())
    vocabulary = got.term.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(vocabulary)
    seed = np.zeros((n_subjects + 1, len(got)))
    if len(got):
        seed[:-1], seed[-1] = np.array(got.seed.tolist()).reshape(len(got), -1).T, got.rest
    seed = seed[:, order]
    return Model(subjects, vocabulary[order], _shares(seed, other), seed, other)


def matrix(docs: DataFrame, model: Model) -> DataFrame:
    """The document-term matrix, sentence by sentence: (doc_id, numbers of the anchored terms, their count in each
    sentence that counts, count of all other terms). What no subject is anchored to belongs to the last component
    whatever the weights, so its number is all that the updates need. Null and blank texts have no row."""
    ship(docs.sparkSession)
    vocabulary = model.vocabulary
    rows = docs.select("doc_id", "text").where("text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in T.slices(texts):
                t = terms(texts[lo:hi])
                at = np.searchsorted(vocabulary, t.hash)
                counted = t.counts[t.sentence]
                known = (at < len(vocabulary)) & counted
                known[known] = vocabulary[at[known]] == t.hash[known]
                s, at = t.sentence[known], at[known].astype(np.int32)
                per = np.bincount(s, minlength=len(t.doc))[t.counts].astype(np.int32)
                sentences = np.bincount(t.doc[t.counts], minlength=hi - lo)
                words = np.bincount(t.doc[s], minlength=hi - lo)
                other = np.bincount(t.doc[t.sentence[counted]], minlength=hi - lo) - words
                first_s, first_w = (np.concatenate(([0], np.cumsum(x))).astype(np.int32) for x in (sentences, words))
                full = pa.array(sentences > 0)
                cols = [b.column(0)[lo:hi], pa.ListArray.from_arrays(first_w, pa.array(at)), pa.ListArray.from_arrays(first_s, pa.array(per)), pa.array(other.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([c.filter(full) for c in cols], names=["doc_id", "terms", "lengths", "other"])

    return stash(rows.mapInArrow(run, f"doc_id {kind}, terms array<int>, lengths array<int>, other int"), "matrix")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row number of each."""
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())


def _mixtures(terms_: np.ndarray, doc: np.ndarray, other: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document weights (n, K + 1) after INNER updates, and each occurrence's shares among the components."""
    h = weights[:, terms_].T  # occurrences x components
    n = len(other)
    w = np.full((n, weights.shape[0]), 1.0 / weights.shape[0])
    total = np.maximum(np.bincount(doc, minlength=n) + other, 1)[:, None]
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, int)
    r = h
    for _ in range(INNER):
        r = w[doc] * h
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        w = np.zeros(w.shape)
        if len(first):
            w[doc[first]] = np.add.reduceat(r, first, axis=0)
        w[:, -1] += other
        w = (w + 1e-3) / total
    return w, r


def _blocks(b: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for lo in range(0, b.num_rows, rows):
        yield b.slice(lo, rows)


def factorise(x: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Alternating updates over all documents; what reaches the driver each round is a (K + 1, V) sum."""
    unanchored = model.other + float(x.agg(F.coalesce(F.sum("other"), F.lit(0)).alias("n")).first().n)
    for _ in range(rounds):
        weights = model.weights.astype(np.float32)
        v = weights.shape[1]

        def run(batches: Iterator[pa.RecordBatch], weights=weights, v=v) -> Iterator[pa.RecordBatch]:
            total = np.zeros(weights.shape)
            for b in batches:
                for part in _blocks(b):
                    t, doc = _flat(part.column(0))
                    if len(t):
                        _, r = _mixtures(t, doc, part.column(1).to_numpy(), weights)
                        for k in range(len(total)):
                            total[k] += np.bincount(t, r[:, k], minlength=v)
            k, at = np.nonzero(total > 1e-6)
            for lo in range(0, len(k), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array((k * v + at)[lo : lo + 50_000]), pa.array(total[k, at][lo : lo + 50_000])], names=["cell", "n"])

        sums = x.select("terms", "other").mapInArrow(run, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        new = np.bincount(sums.cell.to_numpy(), sums.n.to_numpy(), minlength=weights.size).reshape(weights.shape) + model.seed if len(sums) else model.seed
        model = Model(model.subjects, model.vocabulary, _shares(new, unanchored), model.seed, model.other)
    return model


def shares(x: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, n_about, n_sentences, weight): each subject that a sentence of the document is about, with the
    number of such sentences and the subject's weight in the document."""
    weights, names = model.weights.astype(np.float32), pa.array(model.subjects, pa.string())
    kind = x.schema["doc_id"].dataType.simpleString()
    n_subjects = len(model.subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _blocks(b):
                t, doc = _flat(part.column(1))
                lengths, owner = _flat(part.column(2))
                w, r = _mixtures(t, doc, part.column(3).to_numpy(), weights)
                r = r[:, :n_subjects]
                about = np.full(len(lengths), -1)
                full = np.flatnonzero(lengths > 0)
                if len(full):
                    first = np.concatenate(([0], np.cumsum(lengths[full])))[:-1]
                    mass, clear = np.add.reduceat(r, first, axis=0), np.maximum.reduceat(r, first, axis=0)
                    best = mass.argmax(1)
                    about[full] = np.where(clear[np.arange(len(full)), best] >= CLEAR, best, -1)
                counts = np.zeros((part.num_rows, n_subjects), np.int64)
                np.add.at(counts, (owner[about >= 0], about[about >= 0]), 1)
                d, k = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(d)), names.take(pa.array(k)), pa.array(counts[d, k].astype(np.int32)), pa.array(np.bincount(owner, minlength=part.num_rows)[d].astype(np.int32)), pa.array(w[d, k])],
                    names=["doc_id", "subject", "n_about", "n_sentences", "weight"],
                )

    return x.mapInArrow(run, f"doc_id {kind}, subject string, n_about int, n_sentences int, weight double")


def subject_shares(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    subjects = [r.subject for r in areas.select("subject").distinct().orderBy("subject").collect()]  # the list of areas
    model = seeded(docs, labels, subjects)
    x = matrix(docs, model)
    return shares(x, factorise(x, model))


def subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject): the subjects that at least a third of a document's sentences are about. A document without
    sentences, or about nothing, has no row."""
    return subject_shares(docs, labels, areas).where("n_about * 3 >= n_sentences").select("doc_id", "subject")


def composition(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(subject, n_docs, n_sentences): the corpus by subject."""
    s = subject_shares(docs, labels, areas)
    return s.groupBy("subject").agg(F.sum((F.col("n_about") * 3 >= F.col("n_sentences")).cast("int")).alias("n_docs"), F.sum("n_about").alias("n_sentences"))
