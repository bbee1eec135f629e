"""Lexical scorers: TF-IDF on padded-word n-grams, hashed n-grams with surface features, compression-style entropy,
and the pair calibrator.

Weights are long tables (doc_id, term, weight); dot products and entropies are worked out from the texts (``vectors``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import vectors

NGRAMS = (3, 4, 5)
FEATURES, ENTROPY_FEATURES, ORDER, ALPHA = 1 << 16, 8192, 4, 0.5


def padded_grams(text: Column, sizes: tuple[int, ...] = NGRAMS) -> Column:
    """n-grams inside words padded with one blank on either side; a padded word no longer than n yields itself once and
    no longer sizes."""
    words = F.transform(X.tokens(F.lower(text)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(w: Column) -> Column:
        parts = []
        for i, n in enumerate(sizes):
            every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda p: F.substring(w, p, F.lit(n)))
            before = sizes[i - 1] if i else 0
            parts.append(F.when(F.length(w) > before, every).otherwise(F.array().cast("array<string>")))
        return F.flatten(F.array(*parts))

    return F.flatten(F.transform(words, of))


def term_counts(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf), aggregated within the documents before any shuffle is needed for weights."""
    return df.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(counts: DataFrame, key: str, n_docs: int, least: int = 2) -> DataFrame:
    """(key, term, weight): raw counts times ln((1 + n) / (1 + df)) + 1, unit length, terms of at least ``least``
    documents."""
    df_ = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1
    w = counts.join(df_, "term").select(key, "term", (F.col("tf") * idf).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def cross_entropy(pairs: DataFrame, docs: DataFrame, key: str, text: str, order: int = ORDER, n: int = ENTROPY_FEATURES, alpha: float = ALPHA) -> DataFrame:
    """(query_id, candidate_id, forward, backward, mean_entropy, gap) for given pairs: smoothed cross entropy of each text under
    the other's counts of (order + 1)-grams of the raw text. Only the pairs' texts are shuffled; contexts are counted where
    both texts are. Documents too short for a context have a total of 1, as in the smoothing."""
    ids = pairs.select("query_id", "candidate_id").distinct()
    q = docs.select(F.col(key).alias("query_id"), F.col(text).alias("query_text"))
    c = docs.select(F.col(key).alias("candidate_id"), F.col(text).alias("candidate_text"))
    return vectors.entropies(ids.join(q, "query_id", "left").join(c, "candidate_id", "left"), order, n, alpha)


SURFACE = ["chars", "tokens", "punctuation", "digits", "upper", "spaces", "token_length"]


def surface_similarity(pairs: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Seven similarities of each pair: ratios for the two counts, one minus the difference for the shares."""
    q = features.select(F.col(key).alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in SURFACE])
    r = features.select(F.col(key).alias("candidate_id"), *[F.col(c).alias(f"c_{c}") for c in SURFACE])
    j = pairs.join(q, "query_id").join(r, "candidate_id")
    ratio = [(F.least(f"q_{c}", f"c_{c}") / F.greatest(F.greatest(f"q_{c}", f"c_{c}"), F.lit(1.0))).alias(f"s_{c}") for c in SURFACE[:2]]
    near = [F.least(F.greatest(1 - F.abs(F.col(f"q_{c}") - F.col(f"c_{c}")), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in SURFACE[2:]]
    return j.select(*pairs.columns, *ratio, *near)


def fit_calibrator(examples: DataFrame, features: list[str], label: str = "label"):
    """Balanced logistic regression on scaled features; returns (weights, bias) folded onto the raw features. The
    examples are few columns of sampled pairs; training is Spark's own, distributed."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n, pos = examples.count(), examples.where(F.col(label) == 1).count()
    if not 0 < pos < n:
        raise ValueError("both classes are needed")
    weighted = examples.withColumn("__w", F.when(F.col(label) == 1, F.lit(n / (2.0 * pos))).otherwise(F.lit(n / (2.0 * (n - pos)))))
    v = VectorAssembler(inputCols=features, outputCol="__raw").transform(weighted)
    scaler = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True).fit(v)
    model = LogisticRegression(featuresCol="__x", labelCol=label, weightCol="__w", regParam=1.0 / n, standardization=False, maxIter=200, tol=1e-9).fit(scaler.transform(v))
    scale = [s if s > 0 else 1.0 for s in scaler.std.toArray()]
    weights = [float(c) / s for c, s in zip(model.coefficients.toArray(), scale)]
    bias = float(model.intercept) - sum(w * m for w, m in zip(weights, scaler.mean.toArray()))
    return weights, bias


def calibrated(df: DataFrame, features: list[str], weights: list[float], bias: float) -> DataFrame:
    """The linear score from folded literals: stays in generated code."""
    return df.withColumn("score", sum((F.col(c) * F.lit(w) for c, w in zip(features, weights)), F.lit(bias)))
