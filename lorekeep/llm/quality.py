"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text. Preference pairs (a document
labelled 1 over one labelled 0) are drawn from the training rows; the weights minimise the
logistic loss of the feature differences. A quantile of the training strengths is the threshold;
the score is the logistic function of the distance to it, placed so that the threshold has
``CUT`` (0.3).

Defined results: a null or empty text has the features of no words (all zero) and is scored like
any other; texts of any length are read whole; equal texts score alike; repeated rows are scored
once each; an empty table gives no rows; other columns of the input pass through untouched, but for
one named as the score, which is replaced (``name`` names the score). An id with several labels
counts as good if one of them says so; of an id with several texts the least is learned from.
Without both labels every document scores 0.5.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, in_small_batches, read, working

#: Bound of the labelled sample: so many rows, those with the smallest hashes.
SAMPLE_ROWS = 20_000
#: Preference pairs drawn from the sample.
PAIRS = 200_000
#: The score that the quantile threshold is given.
CUT = 0.3
_SYMBOLS = "&%$#*^~@=<>{}[]\\_+"
FEATURES = (
    "upper_words", "exclamations", "bars", "symbols", "adjacent_repeats", "distinct_share", "top_word_share", "word_length",
    "digits", "sentence_ends", "repeated_lines", "log_words", "long_words",
)


def features(text: str | None) -> list[float]:
    """The features of a whole text, in the order of FEATURES."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lines = text.split("\n")
    return [
        sum(map(str.isupper, words)) / n,
        min(text.count("!") / n, 3.0),
        counts.get("|", 0) / n,
        min(sum(map(text.count, _SYMBOLS)) / n, 4.0),
        sum(map(eq, words, words[1:])) / n,
        len(counts) / n,
        max(counts.values()) / n,
        min(len(text) / n, 40.0) / 10,
        sum(map(text.count, "0123456789")) / len(text),
        (text.count(".") + text.count("?")) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n)) / 10,
        sum(len(w) > 25 for w in words) / n,
    ]


class Ranking:
    """Fitted weights: strength = weights . clip((features - mean) / scale)."""

    def __init__(self, mean, scale, weights, threshold):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        away = self.strength(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(away, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> Ranking:
    """Bradley-Terry weights by Newton's method on the logistic loss of feature differences."""
    k = x.shape[1] if x.size else len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), np.log(CUT / (1 - CUT)))
    model = Ranking(x.mean(0), np.maximum(x.std(0), 1e-3), np.zeros(k), 0.0)
    z = model.standard(x)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(k)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # of the worse one being preferred
        gradient = -(p @ d) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + (ridge + 1e-9) * np.eye(k)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    model.threshold = quantile_threshold(model.strength(x), y)
    return model


def quantile_threshold(strength: np.ndarray, y: np.ndarray, quantiles: int = 1000) -> float:
    """The quantile of the strengths that best parts the labels (balanced error); of equal ones, the middle."""
    at = np.unique(np.quantile(strength, np.linspace(0, 1, quantiles + 1)))
    cuts = (at[1:] + at[:-1]) / 2
    if not len(cuts):
        return float(strength[0])
    good, bad = np.sort(strength[y == 1]), np.sort(strength[y == 0])
    error = np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    best = cuts[error <= error.min() + 1e-12]
    return float((best[0] + best[-1]) / 2)


def _with_features(batches):
    working("quality")
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch.doc_id, "y": batch.y, "x": [features(t) for t in batch.text]})


def train(docs: DataFrame, labels: DataFrame, held_out_of: int = 5) -> Ranking:
    """Fits on at most SAMPLE_ROWS labelled rows outside the held-out fold (crc32 of doc_id mod 5 is 0)."""
    sample = (
        labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", held_out_of) != 0))
        .groupBy("doc_id").agg(F.max("quality").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    )
    # ids may repeat: one row for each of the SAMPLE_ROWS
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    found = rows.mapInPandas(_with_features, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(found.x.tolist(), dtype=float).reshape(len(found), len(FEATURES))
    return fit(x, found.y.to_numpy())


def score(docs: DataFrame, model: Ranking, name: str = "quality_score") -> DataFrame:
    """docs with the score as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        working("quality")
        if not len(text):
            return pd.Series([], dtype=float)
        return pd.Series(shared.value.score(np.array([features(t) for t in text])))

    return docs.withColumn(name, scored(F.col("text")))


def quality(docs: DataFrame, labels: DataFrame, name: str = "quality_score") -> DataFrame:
    """docs with the score, by a model fitted on its labelled part."""
    docs = in_small_batches(docs)
    return score(docs, train(docs, labels), name)


def op10_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= CUT).cast("int").alias("predicted"),
    )
