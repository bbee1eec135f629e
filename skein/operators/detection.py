"""Language detection by a naive Bayes model on pairs of characters, and the language audit.

Texts are judged whole: alphabetic scripts by their pairs of neighbouring characters, the others by their characters'
company. Pairs are counted and scored in Arrow batches, one table lookup for each pair and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY
from pyspark.sql import Window as W

from ..functions import text as X
from ..session import ship

LEAST_CHARS, CONFIDENCE, SCRIPT_LETTERS, SUSPECTS = 80, 0.85, 8, 5000
FEATURES, SMOOTHING = 1 << 13, 0.1


@dataclass
class Detector:
    """labels: the languages; weights: (languages, FEATURES) log shares of the pairs; prior: log shares of the languages."""

    labels: list[str]
    weights: np.ndarray
    prior: np.ndarray


def pairs(texts: list[str], features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place among ``features``) of each pair of neighbouring characters of the squeezed, lower-cased texts,
    with a blank at either end."""
    flat = [f" {' '.join(t.lower().split())} " for t in texts]
    c = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(flat)), [len(t) for t in flat])
    h = (c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    inside = owner[1:] == owner[:-1]
    return owner[1:][inside], (h[inside] >> np.uint64(33)).astype(np.int64) % features


def _parts(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together; a longer text is alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def fit_detector(docs: DataFrame, text: str, lang: str, features: int = FEATURES) -> Detector:
    """Train on every labelled document of a known language, whole. What reaches the driver is the model: a number for
    each language and feature."""
    ship(docs.sparkSession)
    labels = sorted(X.SCRIPTS)
    rows = docs.where(F.col(lang).isin(labels) & (F.length(text) >= LEAST_CHARS)).select(F.col(text), F.col(lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(labels), features + 1))  # the last place: documents
        for b in batches:
            texts, langs = b.column(0).to_pylist(), np.array([labels.index(x) for x in b.column(1).to_pylist()], np.int64)
            for lo, hi in _parts(texts):
                owner, place = pairs(texts[lo:hi], features)
                total[:, :features] += np.bincount(langs[lo:hi][owner] * features + place, minlength=len(labels) * features).reshape(len(labels), features)
            total[:, features] += np.bincount(langs, minlength=len(labels))
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(at), pa.array(total[k, at])], names=["k", "place", "n"])

    got = rows.mapInArrow(run, "k bigint, place bigint, n double").groupBy("k", "place").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((len(labels), features + 1))
    n[got.k.to_numpy(np.int64), got.place.to_numpy(np.int64)] = got.n
    there = np.flatnonzero(n[:, features] > 0)
    counts, per = n[there, :features] + SMOOTHING, n[there, features] + SMOOTHING
    return Detector([labels[k] for k in there], np.log(counts / counts.sum(1, keepdims=True)), np.log(per / per.sum()))


def judge(texts: list[str], model: Detector) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best language and confidence of each text: its share among all after scaling by the square root of
    the text's length, so that long texts are no surer than their characters."""
    best, sure = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for lo, hi in _parts(texts):
        owner, place = pairs(texts[lo:hi], model.weights.shape[1])
        raw = np.stack([np.bincount(owner, w[place], minlength=hi - lo) for w in model.weights], 1) + model.prior
        raw /= np.sqrt(np.maximum(np.bincount(owner, minlength=hi - lo), 1))[:, None]
        top = raw.max(1)
        best[lo:hi], sure[lo:hi] = raw.argmax(1), 1 / np.exp(raw - top[:, None]).sum(1)
    return best, sure


def detect(docs: DataFrame, model: Detector, text: str) -> DataFrame:
    """Adds detected_lang and detected_confidence. Texts under LEAST_CHARS, and all if the model knows no language, are
    not judged (null)."""
    ship(docs.sparkSession)
    schema = TY.StructType([*docs.schema.fields, TY.StructField("detected_lang", TY.StringType()), TY.StructField("detected_confidence", TY.DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            enough = np.array([len(t) >= LEAST_CHARS for t in texts], bool)
            best, sure = judge(texts, model) if model.labels else (np.zeros(len(texts), np.int64), np.zeros(len(texts)))
            none = ~enough | (not model.labels)
            lang = pa.array([None if x else model.labels[k] for k, x in zip(best, none)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, lang, pa.array(sure, mask=none)], names=[*b.schema.names, "detected_lang", "detected_confidence"])

    return docs.mapInArrow(run, schema)


def audit(docs: DataFrame, text: str, lang: str, drop: bool = False) -> DataFrame:
    """Adds script_share, reasons (array) and final_lang to detected documents: a sure other language retags (or drops:
    null), too little of the language's script is a reason of its own."""
    sure = F.coalesce((F.col("detected_confidence") >= CONFIDENCE) & (F.col("detected_lang") != F.col(lang)), F.lit(False))
    script = X.script_share(F.coalesce(F.col(text), F.lit("")), lang)
    weak = F.coalesce((script < X.least_script(lang)) & (X.count_of(F.coalesce(F.col(text), F.lit("")), X.LETTER) >= SCRIPT_LETTERS), F.lit(False))
    reasons = F.filter(F.array(F.when(sure, "detected_other"), F.when(weak, "script_mismatch")), lambda r: r.isNotNull())
    final = F.when(sure, F.lit(None).cast("string") if drop else F.col("detected_lang")).otherwise(F.col(lang))
    return docs.withColumns({"script_share": script, "reasons": reasons, "final_lang": final})


def suspects(audited: DataFrame, key: str, text: str, most: int = SUSPECTS) -> DataFrame:
    """The report: at most ``most`` documents with a reason, surest first, with a preview."""
    return audited.where(F.size("reasons") > 0).orderBy(F.desc_nulls_last("detected_confidence"), key).limit(most).withColumn("text_preview", F.substring(X.squeeze(text), 1, 300)).drop(text)


def neighbours(vectors: DataFrame, key: str, cluster: str, vector: str, length: str, k: int = 12, ratio: float = 1.6) -> DataFrame:
    """(a, b, cluster, score): within each cluster every document's ``k`` nearest by cosine, unordered pairs once, of
    like length. Clusters are bounded by the plan that made them."""
    from .scoring import dot

    left = vectors.select(F.col(key).alias("a"), cluster, F.col(vector).alias("va"), F.col(length).alias("la"))
    right = vectors.select(F.col(key).alias("b"), F.col(cluster).alias("__c"), F.col(vector).alias("vb"), F.col(length).alias("lb"))
    j = left.join(right, (F.col(cluster) == F.col("__c")) & (F.col("a") != F.col("b"))).where(F.greatest("la", "lb") <= F.least("la", "lb") * ratio)
    s = j.select("a", "b", cluster, (dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb")))).alias("score"))
    near = s.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("r") <= k)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), cluster, F.round("score", 6).alias("score")).distinct()
