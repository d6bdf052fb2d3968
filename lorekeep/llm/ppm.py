"""Prediction by partial matching: code length of whole texts under a byte-context trie.

The trie holds, for every context of up to ORDER bytes, how often each byte followed it in the
training texts. A byte is coded in its longest context with escape estimation (method C: a context
seen T times with q different bytes escapes with q / (T + q)) and symbol exclusion (bytes that a
longer context offered are left out of the shorter ones); below the empty context, bytes never seen
are equally likely. Texts are lower-cased (A-Z), begin after START bytes and close with an END byte.

As the trie of a large corpus fits no one machine, it is never in one place. Documents are cut into
blocks of bounded size, kept compressed in a shared table. A block sends each distinct gram (context
and byte) with its count to the bucket of the gram's last three context bytes; there the trie's part
for those contexts is complete up to the three shortest orders, whose counts (at most 2^24 rows, as
many as the corpus has of three bytes in a row) every bucket is given. Buckets grow with the input. The bucket returns the log-probability of each gram to the blocks that have it. The
unigram baseline counts words in the same way.

A document that the corpus holds twice is not told apart by it: a context of ORDER bytes is too
short to know one document from others that use the same words.

Defined results: texts of any length are scored whole; a null text is an empty one (its end is coded); repeated rows are scored and, in
training, counted each; an empty table gives no rows; without training rows every byte is equally
likely and no word is known; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, fold, packed, packed_sorted, raw_text, read, restored, unpacked, unpacked_sorted, whole_id, words, working, written

ORDER = 4
#: Bytes that no UTF-8 text has: before it, and after it.
START, END = 0xFE, 0xFF
BLOCK_BYTES = 6 << 20
#: Bytes of text whose grams a bucket takes, and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 64
#: Smoothing of the baseline.
ADD = 0.1
_END_WORD = 1
_hashes = WordHashes()


def grams(text: str | None) -> np.ndarray:
    """A gram per byte of the text and one for its end: ORDER context bytes and the byte."""
    raw = raw_text(text)
    line = np.frombuffer(bytes([START]) * ORDER + raw + bytes([END]), np.uint8).astype(np.uint64)
    n = len(raw) + 1
    out = np.zeros(n, np.uint64)
    for i in range(ORDER + 1):
        out <<= np.uint64(8)
        out |= line[i : i + n]
    return out


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash per word of the text and one for its end."""
    return np.array([*_hashes(words(text)), _END_WORD], np.uint64)


def _block(name: str, rows: list[tuple[int, bool, bool, str]]) -> tuple:
    """One row: the documents, and their distinct grams and words with the counts in training rows."""
    found = []
    for make in (grams, word_hashes):
        known, counts = np.unique(np.concatenate([make(t) for _, _, learn, t in rows if learn] or [np.zeros(0, np.uint64)]), return_counts=True)
        others = np.unique(np.concatenate([make(t) for _, _, learn, t in rows if not learn] or [np.zeros(0, np.uint64)]))
        others = others[~np.isin(others, known)]
        every = np.r_[known, others]
        order = np.argsort(every, kind="stable")
        found += [packed_sorted(every[order]), packed(np.r_[counts, np.zeros(len(others), int)][order].astype(np.uint32))]
    raw = [t.encode("utf-8", "surrogatepass") for _, _, _, t in rows]
    ids = np.array([[d for d, *_ in rows], [unnamed for _, unnamed, *_ in rows]], np.int64).ravel()  # then whether each is null
    return name, packed(ids), packed(np.array([len(r) for r in raw], np.int64)), zstandard.compress(b"".join(raw), 3), *found


_BLOCKS = "block string, ids binary, sizes binary, texts binary, gram binary, gram_n binary, word binary, word_n binary"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    working("ppm", _hashes.known.clear)
    at, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    columns = [c.split()[0] for c in _BLOCKS.split(", ")]
    for batch in batches:
        for row in zip(batch.doc_id.tolist(), batch.unnamed.tolist(), batch.learn.tolist(), batch.text.fillna("").tolist(), strict=True):
            held.append(row)
            size += len(row[3])
            if size >= BLOCK_BYTES:
                yield pd.DataFrame([_block(f"{at}-{number}", held)], columns=columns)
                number, held, size = number + 1, [], 0
    if held:
        yield pd.DataFrame([_block(f"{at}-{number}", held)], columns=columns)


def _dealt(features: str, counts: str, bucket):
    """Each block's features and counts, cut by bucket."""

    def run(batches):
        for batch in batches:
            for block, f, n in zip(batch.block, batch[features], batch[counts], strict=True):
                f, n = unpacked_sorted(f), unpacked(n, np.uint32)
                to = bucket(f)
                order = np.argsort(to, kind="stable")
                parts = [p for p in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(p)]
                yield pd.DataFrame([(int(to[p[0]]), block, packed_sorted(f[p]), packed(n[p])) for p in parts], columns=["bucket", "block", "features", "counts"])

    return run


_DEALT = "bucket int, block string, features binary, counts binary"


def _gathered(part: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Each block's features, the distinct ones, where a block's stand among them, their counts."""
    features = [unpacked_sorted(f) for f in part.features]
    every, back = np.unique(np.concatenate(features), return_inverse=True)
    total = np.bincount(back, np.concatenate([unpacked(c, np.uint32) for c in part.counts]), len(every)).astype(np.int64)
    return features, every, back, total


def _returned(part: pd.DataFrame, features: list[np.ndarray], back: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    bounds = np.cumsum([0, *map(len, features)])
    return pd.DataFrame(
        [(b, packed_sorted(f), packed(value[back[i:j]])) for b, f, i, j in zip(part.block, features, bounds, bounds[1:], strict=False)],
        columns=["block", "features", "value"],
    )


def _gram_bucket(buckets: int):
    """By a hash of the last three context bytes."""
    return lambda f: ((((f >> np.uint64(8)) & np.uint64(0xFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % buckets


def _word_bucket(buckets: int):
    return lambda f: (f % np.uint64(buckets)).astype(np.int64)


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x stand, and whether they do."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


class _Level:
    """The contexts of one order: bytes that followed, with counts."""

    def __init__(self, grams_: np.ndarray, counts: np.ndarray, order: int):
        mask = np.uint64((1 << (8 * (order + 1))) - 1)
        self.keys, back = np.unique(grams_ & mask, return_inverse=True)
        self.n = np.bincount(back, counts, len(self.keys))
        self.contexts, self.start, self.q = np.unique(self.keys >> np.uint64(8), return_index=True, return_counts=True)
        self.total = np.add.reduceat(self.n, self.start) if len(self.start) else np.zeros(0)
        self.mask = mask

    def count(self, x: np.ndarray) -> np.ndarray:
        at, there = _find(self.keys, x & self.mask)
        return np.where(there, self.n[at] if len(self.n) else 0.0, 0.0)


#: The longest context of which every bucket is given all counts.
_LOW = 2


def log_probabilities(want: np.ndarray, grams_: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context.

    grams_, counts: the trained grams that share the last three context bytes with any of ``want``;
    low: three bytes in a row, over all trained grams, and their counts.
    """
    levels = [_Level(grams_, counts, k) for k in range(ORDER, _LOW, -1)] + [_Level(*low, k) for k in range(_LOW, -1, -1)]
    logs = np.zeros(len(want))
    open_ = np.ones(len(want), bool)
    offered, kinds = np.zeros(len(want)), np.zeros(len(want))  # by the longer context: their counts here, their number
    for level, below in zip(levels, [*levels[1:], None], strict=True):
        at, seen = _find(level.contexts, (want & level.mask) >> np.uint64(8))
        take = lambda v: np.where(seen, v[at] if len(v) else 0.0, 0.0)  # noqa: E731, B023
        total, q = take(level.total) - offered, take(level.q) - kinds
        n = level.count(want)
        coded = open_ & (n > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs[coded] += np.log10(n[coded] / (total + q)[coded])
            escapes = open_ & ~coded & (q > 0)
            logs[escapes] += np.log10(q[escapes] / (total + q)[escapes])
        open_ &= ~coded
        if below is not None and len(level.start):
            offered = take(np.add.reduceat(below.count(level.keys), level.start))
        kinds = take(level.q)
    logs[open_] -= np.log10(256 - kinds[open_]) if open_.any() else 0.0
    return logs


def _scored(texts: pd.DataFrame, grams_: pd.DataFrame, words_: pd.DataFrame) -> pd.DataFrame:
    def table(parts):
        f = np.concatenate([unpacked_sorted(x) for x in parts.features])
        v = np.concatenate([unpacked(x, np.float64) for x in parts.value])
        order = np.argsort(f)
        return f[order], v[order]

    out = []
    if len(texts):
        gram, log = table(grams_)
        word, count = table(words_)
        log_count = np.log10(count + ADD)
        for row in texts.itertuples():
            raw, at = zstandard.decompress(row.texts) if row.texts else b"", 0
            ids, unnamed = unpacked(row.ids, np.int64).reshape(2, -1)
            for doc_id, no_id, size in zip(ids.tolist(), (unnamed > 0).tolist(), unpacked(row.sizes, np.int64).tolist(), strict=True):
                text = raw[at : at + size].decode("utf-8", "surrogatepass")
                at += size
                w = np.searchsorted(word, word_hashes(text))
                out.append((doc_id, no_id, len(w), int((count[w] > 0).sum()), float(log_count[w].sum()), float(log[np.searchsorted(gram, grams(text))].sum())))
    return pd.DataFrame(out, columns=["doc_id", "unnamed", "n_tokens", "n_known", "log_counts", "score"])


def language_model_scores(docs: DataFrame, learn) -> DataFrame:
    """docs(doc_id, text), scored by a model of the rows where ``learn`` holds.

    -> doc_id, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    blocks = written(docs.select(*whole_id("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), "text").mapInPandas(_blocks, _BLOCKS), "blocks")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    gram_parts = blocks.select("block", "gram", "gram_n").mapInPandas(_dealt("gram", "gram_n", _gram_bucket(buckets)), _DEALT)
    word_parts = blocks.select("block", "word", "word_n").mapInPandas(_dealt("word", "word_n", _word_bucket(buckets)), _DEALT)

    def lows(batches):  # counts of the last three bytes of grams
        known, total = np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            for f, n in zip(batch.gram, batch.gram_n, strict=True):
                f, n = unpacked_sorted(f) & np.uint64(0xFFFFFF), unpacked(n, np.uint32)
                known, back = np.unique(np.append(known, f), return_inverse=True)
                total = np.bincount(back, np.append(total, n), len(known))
        yield pd.DataFrame({"low": known[total > 0].astype(np.int32), "n": total[total > 0].astype(np.int64)})

    low = blocks.select("gram", "gram_n").mapInPandas(lows, "low int, n long").groupBy("low").agg(F.sum("n").alias("n")).toPandas()  # 2^24 rows at most
    low = spark.sparkContext.broadcast((low.low.to_numpy(np.uint64), low.n.to_numpy(np.float64)))

    def grams_back(part):
        features, every, back, total = _gathered(part)
        learned = total > 0
        return _returned(part, features, back, log_probabilities(every, every[learned], total[learned], low.value))

    def words_back(part):
        features, _, back, total = _gathered(part)
        found = _returned(part, features, back, total.astype(np.float64))
        return found.assign(n=[int(total.sum())] + [0] * (len(found) - 1), v=[int((total > 0).sum())] + [0] * (len(found) - 1))

    back = "block string, features binary, value binary"
    known_words = written(word_parts.groupBy("bucket").applyInPandas(words_back, back + ", n long, v long"), "words", let_go=False)
    known_grams = written(gram_parts.groupBy("bucket").applyInPandas(grams_back, back), "grams")
    sums = known_words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    both = known_grams.withColumn("kind", F.lit(0)).unionByName(known_words.select("block", "features", "value").withColumn("kind", F.lit(1)))

    def scored(texts, found):
        return _scored(texts, found[found.kind == 0], found[found.kind == 1])

    scores = blocks.select("block", "ids", "sizes", "texts").groupBy("block").cogroup(both.groupBy("block")).applyInPandas(
        scored, "doc_id long, unnamed boolean, n_tokens long, n_known long, log_counts double, score double"
    )
    each = F.log10(F.col("train_tokens") + ADD * (F.col("v") + 1))
    return scores.crossJoin(F.broadcast(sums)).select(  # one row
        restored().alias("doc_id"), "n_tokens", "n_known", "train_tokens", (F.col("log_counts") - F.col("n_tokens") * each).alias("base_score"), "score"
    )


def op6_ppm_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_model_scores(docs, fold("doc_id", 10) != 0)
    return found.withColumn("held_out", fold("doc_id", 10) == 0)
