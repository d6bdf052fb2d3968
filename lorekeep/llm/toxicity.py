"""Toxicity by a bag of subwords: hashed word and character n-gram vectors, averaged over a text,
feed a linear softmax; both are trained jointly in numpy, so that misspellings and compounds which
training never saw share the vectors of their n-grams.

At scoring time the average of vectors followed by a linear layer equals an average of one number
per subword, so a worker keeps that number per distinct word and a text costs a look-up per word.

Training documents come to the driver as bags of words, from whole texts of any length.

Defined results: a null or empty text is scored by the intercept alone; equal texts score alike;
repeated rows are scored once each; an empty table gives no rows; other columns pass through
untouched, but for one named as the score, which is replaced (``name`` names the score). An id with
several labels counts as toxic if one of them says so; of an id with several texts the least is
learned from. Without labelled rows of both kinds every document scores 0.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, in_small_batches, read, working

#: Bounds of the labelled sample: rows (those with the smallest hashes), of which a quarter are toxic where there are enough.
SAMPLE_ROWS = 6_000
BUCKETS = 1 << 20
DIM = 2
NGRAMS = (3, 4)
#: A subword has a vector if the sample names it so often at least, and LEAST_MENTIONS times; others are zero.
MENTIONS_PER_TEXT, LEAST_MENTIONS = 1 / 150, 3
#: Documents with this score or more are predicted toxic.
CUT = 0.7
#: Distinct words whose number a worker keeps before it starts anew.
CACHE_WORDS = 200_000
_WORDS = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def subwords(word: str) -> list[int]:
    """Buckets of the word and of all its n-grams."""
    marked = f"<{word}>".encode()
    size, (low, high) = len(marked), NGRAMS
    crc, mask = zlib.crc32, BUCKETS - 1
    return [crc(marked) & mask, *(crc(marked[i : i + n]) & mask for n in range(low, min(high, size - 1) + 1) for i in range(size - n + 1))]


class Bag:
    """value: number per subword bucket, its vector times the difference of the two classes' weights."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value.astype(np.float32), bias
        self._words: dict[str, float] = {}

    def __getstate__(self):
        return self.value, self.bias

    def __setstate__(self, state):
        self.value, self.bias = state
        self._words = {}

    def forget(self) -> None:
        self._words = {}

    def word(self, word: str) -> float:
        found = self._words.get(word)
        if found is None:
            if len(self._words) >= CACHE_WORDS:
                self._words.clear()
            found = self._words[word] = float(self.value[subwords(word)].mean())
        return found

    def logit(self, text: str | None) -> float:
        found = tokens(text)
        if not found:
            return self.bias
        known = self._words.get
        total = 0.0
        for w in found:
            v = known(w)
            total += self.word(w) if v is None else v
        return total / len(found) + self.bias

    def score(self, text: str | None) -> float:
        if self.bias == -np.inf:  # nothing was learned
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -60, 60))))


class _Sparse:
    """A matrix by its entries; products with narrow matrices in both directions."""

    def __init__(self, rows, cols, weight, shape: tuple[int, int]):
        self.rows, self.cols, self.weight, self.shape = rows, cols, weight.astype(float), shape

    def _product(self, to, of, x, n):
        return np.stack([np.bincount(to, self.weight * column[of], n) for column in np.ascontiguousarray(x.T)], 1)

    def times(self, x):
        return self._product(self.rows, self.cols, x, self.shape[0])

    def turned_times(self, x):
        return self._product(self.cols, self.rows, x, self.shape[1])


def bag_of(text: str | None) -> tuple[str, np.ndarray]:
    """The distinct words of a whole text, by lines, and their numbers."""
    found = Counter(tokens(text))
    return "\n".join(found), np.fromiter(found.values(), np.uint32, len(found))


def _matrices(bags: Iterable[tuple[str, np.ndarray]]) -> tuple[_Sparse, _Sparse, np.ndarray]:
    """Documents by words, words by the subwords that have vectors, and those subwords' buckets."""
    vocabulary: dict[str, int] = {}
    cols, sizes, weight = array("q"), array("q"), array("d")
    for lines, counts in bags:
        sizes.append(len(counts))
        if len(counts):
            cols.extend([vocabulary.setdefault(w, len(vocabulary)) for w in lines.split("\n")])
            weight.extend((counts / counts.sum()).tolist())
    flat, lengths = array("q"), array("q")
    for w in vocabulary:
        found = subwords(w)
        lengths.append(len(found))
        flat.extend(found)
    n_words = len(vocabulary)
    del vocabulary
    cols, sizes, weight, flat, lengths = (np.frombuffer(x, x.typecode) if len(x) else np.zeros(0, x.typecode) for x in (cols, sizes, weight, flat, lengths))
    of_word = np.repeat(np.arange(n_words), lengths)
    mentions = np.bincount(flat, np.bincount(cols, minlength=n_words)[of_word], BUCKETS)
    enough = max(LEAST_MENTIONS, MENTIONS_PER_TEXT * len(sizes))
    keep = mentions[flat] >= enough
    used = np.flatnonzero(mentions >= enough)
    place = np.zeros(BUCKETS, np.int64)
    place[used] = np.arange(len(used))
    of_docs = _Sparse(np.repeat(np.arange(len(sizes)), sizes), cols, weight, (len(sizes), n_words))
    return of_docs, _Sparse(of_word[keep], place[flat[keep]], (1 / lengths)[of_word[keep]], (n_words, len(used))), used


def fit(bags: Iterable[tuple[str, np.ndarray]], y: np.ndarray, epochs: int = 80, rate: float = 0.1, decay: float = 1e-4, steep: float = 400.0, seed: int = 7) -> Bag:
    """Adam on the mean cross-entropy, classes weighted alike; vectors and softmax weights move together.

    steep: size of the first softmax weights; a text's average moves little by one word in hundreds.
    """
    y = np.asarray(y)
    if not len(y) or y.min() == y.max():
        return Bag(np.zeros(BUCKETS, np.float32), -np.inf)
    of_docs, of_words, used = _matrices(bags)
    rng = np.random.default_rng(seed)
    # a softmax of two classes: the weights of the second minus those of the first
    p = [rng.uniform(-0.5, 0.5, (len(used), DIM)) / DIM, steep * rng.normal(0, 1, (DIM, 1)), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())[:, None]
    target = y.astype(float)[:, None]
    for t in range(1, epochs + 1):
        mean = of_docs.times(of_words.times(p[0]))
        guess = 1 / (1 + np.exp(-np.clip(mean @ p[1] + p[2], -40, 40)))
        error = (guess - target) * share
        back = of_words.turned_times(of_docs.turned_times(error @ p[1].T)) + decay * p[0]
        for k, g in enumerate((back, mean.T @ error, error.sum(0))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (1 - (t - 1) / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-9)
    value = np.zeros(BUCKETS, np.float32)
    value[used] = (p[0] @ p[1])[:, 0]
    return Bag(value, float(p[2][0]))


def _bags(batches):
    working("toxicity")
    for batch in batches:
        found = [bag_of(t) for t in batch.text]
        yield pd.DataFrame({"doc_id": batch.doc_id, "y": batch.y, "words": [w for w, _ in found], "counts": [c.tobytes() for _, c in found]})


def train(docs: DataFrame, labels: DataFrame, held_out_of: int = 3, held_out: int = 1) -> Bag:
    """Fits on at most SAMPLE_ROWS labelled rows outside the held-out fold (crc32 of doc_id mod 3 is 1)."""
    rows = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", held_out_of) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    pick = lambda y, n: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = F.broadcast(pick(0, SAMPLE_ROWS * 3 // 4).union(pick(1, SAMPLE_ROWS // 4)))  # SAMPLE_ROWS ids
    # ids may repeat: one row for each
    sample = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    found = sample.mapInPandas(_bags, "doc_id long, y int, words string, counts binary").toPandas().sort_values("doc_id", kind="stable")
    y = found.y.to_numpy()
    return fit(((w, np.frombuffer(c, np.uint32)) for w, c in zip(found.words, found.counts, strict=True)), y)


def score(docs: DataFrame, model: Bag, name: str = "toxic_score") -> DataFrame:
    """docs with the score as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        model = shared.value
        working("toxicity", model.forget)
        return pd.Series([model.score(t) for t in text], dtype=float)

    return docs.withColumn(name, scored(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, name: str = "toxic_score") -> DataFrame:
    """docs with the score, by a model fitted on its labelled part."""
    docs = in_small_batches(docs)
    return score(docs, train(docs, labels), name)


def op5_toxicity_subword_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= CUT).cast("int").alias("predicted"),
    )
