"""Phrase collocations from suffix arrays of word ids.

Three passes. The first cuts each partition's texts into words, language by language, and keeps
shards of bounded length: a shard's word sequence as local numbers, and its distinct words with
their counts. The counts, summed by key, give the words that reach the least count; only these get
a number of their own, since a phrase is no more frequent than its words. The second pass sends each
shard the numbers of its words and sorts the shard's suffixes by prefix doubling in numpy; where
neighbours in the suffix array share fewer than n words, an n-gram's interval ends, so the intervals'
lengths are the shard's counts of its n-grams. They are summed by key over all shards: n-grams are
keyed by word numbers, exactly, never by hashes. The third scores the phrases by joins with the
counts of their parts and ranks them per language, first in salted groups, so that no language's
candidates meet in one task.

Memory: a shard has at most ``shard_words`` words (and one more text); a task of the last ranking
gets at most ``top`` rows of a language from each of its salted groups.

Defined results: a null text is an empty one, and null languages are ``und`` (as is the language
named so); texts of any length are one sequence, parted at ``[.,;:!?\\x0A-\\x0D]``; repeated rows are
counted each; ties in the ranking go by count, then by the phrase's bytes; an empty table gives no
rows; other columns of the input are left out, whatever their names. Counts of up to 10^15 are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, packed, raw_text, read, unpacked, written

LEAST, LONGEST, TOP, SUBSUMED = 10, 3, 2000, 50
#: Words of a shard, and phrases of a salted group in the ranking.
SHARD_WORDS, GROUP_ROWS = 4_000_000, 500_000
_TO_BORDER = bytes.maketrans(b",;:!?\n\v\f\r", b"." * 9)


def _pieces(text: str | None) -> list[bytes]:
    """Words of a text, with ``.`` for each border between pieces."""
    return raw_text(text).translate(_TO_BORDER).replace(b".", b" . ").split()  # space and tab are all white space left


class _Shard:
    """Word sequences of one language; number 0 is a border."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.numbers[b"."]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> int:
        found = _pieces(text)
        part = np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found))
        self.parts += [part, np.zeros(1, np.int32)]
        self.size += len(part) + 1
        return len(part) + 1

    def rows(self, shard: int, lang: str) -> Iterator[pa.RecordBatch]:
        """The distinct words with their counts, and the sequence in a row of its own."""
        sequence = np.concatenate(self.parts)
        counts = np.bincount(sequence, minlength=len(self.numbers))
        words = [w.decode("utf-8", "surrogatepass") for w in self.numbers][1:]
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            n = len(part)
            numbers = np.arange(i + 1, i + 1 + n, dtype=np.int32)
            columns = [np.full(n, shard), [lang] * n, numbers, part, counts[numbers], pa.nulls(n, pa.binary())]
            yield pa.record_batch([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, _SHARD_TYPES, strict=True)], _SHARD_NAMES)
        yield pa.record_batch([pa.array([x], t) for x, t in zip((shard, lang, None, None, None, packed(sequence)), _SHARD_TYPES, strict=True)], _SHARD_NAMES)


_SHARD_NAMES = ["shard", "lang", "number", "word", "c", "sequence"]
_SHARD_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs(lang, text) -> rows of two kinds: shard, lang, number, word, c; and shard, lang, sequence."""

    def run(batches):
        held: defaultdict[str, _Shard] = defaultdict(_Shard)
        size, made = 0, count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                size += held[lang.as_py()].add(text.as_py())
                if size >= shard_words:
                    for of, shard in held.items():
                        yield from shard.rows(next(made), of)
                    held.clear()
                    size = 0
        for of, shard in held.items():
            yield from shard.rows(next(made), of)

    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "shard long, lang string, number int, word string, c long, sequence binary")


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes of symbols (0 or more each), sorted by their first ``depth`` or more symbols.

    Prefix doubling: from the ranks of the prefixes of h symbols, those of 2h come by one sort of pairs of ranks.
    """
    n = len(symbols)
    rank, h = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        after = np.zeros(n, np.int64)  # beyond the end: below all others
        after[: max(0, n - h)] = rank[h:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(ordered, prepend=ordered[:1]) != 0)
        h *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order: how many symbols it shares with the one before, up to ``most``."""
    lcp = np.zeros(len(order), np.int8)
    padded = np.concatenate([symbols, np.full(most, -1, symbols.dtype)])
    alike = np.ones(max(0, len(order) - 1), bool)
    for k in range(most):
        at = padded[order + k]
        alike &= (at[1:] == at[:-1]) & (at[1:] >= 0)
        lcp[1:] += alike
    return lcp


def grams(symbols: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of 2 to ``longest`` symbols without a 0 among them, as rows, with their counts."""
    # a 0 after a 0 bears no n-gram, nor does a symbol between two
    keep = symbols != 0
    near = keep & (np.r_[False, keep[:-1]] | np.r_[keep[1:], False])
    symbols = np.where(near, symbols, 0)[near | np.r_[False, near[:-1]]]
    order = suffix_array(symbols, longest)
    lcp = common_prefixes(symbols, order, longest)
    padded = np.concatenate([symbols, np.zeros(longest, symbols.dtype)])
    for n in range(2, longest + 1):
        starts = np.flatnonzero(lcp < n)
        sizes = np.diff(np.r_[starts, len(order)])
        found = padded[order[starts][:, None] + np.arange(n)]
        real = (found != 0).all(1)
        yield found[real], sizes[real]


def _shard_grams(key, sequences: pd.DataFrame, numbers: pd.DataFrame) -> pd.DataFrame:
    ids = [np.zeros(0, np.int64)] * 3
    for sequence in sequences.sequence:
        local = unpacked(sequence, np.int32)
        own = np.zeros(int(local.max(initial=0)) + 1, np.int64)
        own[numbers.number.to_numpy()] = numbers.id.to_numpy()
        parts = [(g[:, 0] << 32 | g[:, 1], g[:, 2] if g.shape[1] > 2 else np.zeros(len(g), np.int64), c) for g, c in grams(own[local])]
        ids = [np.concatenate(x) for x in zip(ids, *parts, strict=True)]
    return pd.DataFrame({"pair": ids[0], "third": ids[1].astype(np.int32), "c": ids[2]})


def _numbered(words: DataFrame, name: str) -> DataFrame:
    """A written table with an ``id`` from 1: each partition's rows in order, partition after partition in turn."""
    held = written(words.withColumn("p", F.spark_partition_id()), f"{name}-plain", let_go=False)
    parts = (held.agg(F.max("p")).first()[0] or 0) + 1
    place = F.row_number().over(Window.partitionBy("p").orderBy("lang", "word")) - 1
    found = written(held.withColumn("id", place.cast("long") * parts + F.col("p") + 1).drop("p"), name, let_go=False)
    dropped(held)
    if (found.agg(F.max("id")).first()[0] or 0) >= 1 << 31:
        raise ValueError("over 2^31 words reach the least count")
    return found


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED, shard_words: int = SHARD_WORDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs(lang, text) -> lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two or three words.

    subsumed: a phrase goes whose words lie in a longer one that has at least so many per cent of its count.
    """
    table = written(shards(docs, shard_words), "shards")
    words = table.where("word is not null").select("shard", "lang", "number", "word", "c")
    counts = written(words.groupBy("lang", "word").agg(F.sum("c").alias("f")), "words", let_go=False)
    total = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    known = _numbered(counts.where(F.col("f") >= least), "known")
    told = words.join(known.select("lang", "word", "id"), ["lang", "word"]).select(F.col("shard").alias("to"), "number", "id")
    sequences = table.where("sequence is not null").select("shard", "sequence")
    found = sequences.groupBy("shard").cogroup(told.groupBy("to")).applyInPandas(_shard_grams, "pair long, third int, c long")
    # a shard has each n-gram once: dealt by key before they are summed, they need no table on the sending side
    found = found.repartition("pair", "third").groupBy("pair", "third").agg(F.sum("c").alias("a")).where(F.col("a") >= least)
    phrases = written(found, "phrases")
    dropped(table)
    ranked = written(_ranked(_scored(phrases, known, subsumed), phrases.count(), top, group_rows), "ranked")
    found = written(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for used in (phrases, known, counts, ranked):
        dropped(used)
    return found


def _scored(phrases: DataFrame, known: DataFrame, subsumed: int) -> DataFrame:
    """phrases(pair, third, a) that no longer one subsumes -> lang, phrase, a, l, r, score."""
    first, second = F.shiftright("pair", 32), F.col("pair").bitwiseAND((1 << 32) - 1)
    pairs = phrases.where("third = 0").select("pair", "a")
    triples = phrases.where("third <> 0").select("pair", "third", "a", (F.shiftleft(second, 32) + F.col("third")).alias("rest"))
    above = triples.select("pair", "a").unionByName(triples.select(F.col("rest").alias("pair"), "a")).groupBy("pair").agg(F.max("a").alias("above"))
    pairs = pairs.join(above, "pair", "left").where(F.col("above").isNull() | (F.col("above") * 100 < F.col("a") * subsumed))
    cut = triples.join(phrases.where("third = 0").select("pair", F.col("a").alias("f12")), "pair")
    cut = cut.join(phrases.where("third = 0").select(F.col("pair").alias("rest"), F.col("a").alias("f23")), "rest")
    both = pairs.select(first.alias("w1"), second.alias("w2"), F.lit(0).cast("long").alias("w3"), "a", F.lit(None).cast("long").alias("f12"), F.lit(None).cast("long").alias("f23"))
    both = both.unionByName(cut.select(first.alias("w1"), second.alias("w2"), F.col("third").cast("long").alias("w3"), "a", "f12", "f23"))
    both = both.join(known.select(F.col("id").alias("w1"), "lang", F.col("word").alias("t1"), F.col("f").alias("f1")), "w1")
    both = both.join(known.select(F.col("id").alias("w2"), F.col("word").alias("t2"), F.col("f").alias("f2")), "w2")
    both = both.join(known.select(F.col("id").alias("w3"), F.col("word").alias("t3"), F.col("f").alias("f3")), "w3", "left")
    exact = "cast({} as decimal(19, 0))"
    score = lambda l, r: F.expr(f"cast(1000000 * {exact.format('a')} * {exact.format('a')} div ({exact.format(l)} * {exact.format(r)}) as bigint)")  # noqa: E731, E741
    both = both.withColumns({"s1": F.when(F.col("w3") == 0, score("f1", "f2")).otherwise(score("f1", "f23")), "s2": F.when(F.col("w3") != 0, score("f12", "f3"))})
    later = F.col("s2") < F.col("s1")  # of equal scores the first cut counts
    return both.select(
        "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(later, F.col("f12")).otherwise(F.col("f1")).alias("l"),
        F.when(later, F.col("f3")).when(F.col("w3") == 0, F.col("f2")).otherwise(F.col("f23")).alias("r"), F.when(later, F.col("s2")).otherwise(F.col("s1")).alias("score"),
    )


def _ranked(scored: DataFrame, rows: int, top: int, group_rows: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(max(1, rows // group_rows))).cast("int"))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def op12_collocations_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents),
piece AS (SELECT d, lang, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM pieces),
listed AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM piece),
word AS (SELECT lang, unnest(ws) AS w FROM listed),
f1 AS (SELECT lang, w AS g, count(*)::HUGEINT AS f FROM word GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
p2 AS (SELECT lang, unnest([[ws[i], ws[i + 1]] FOR i IN range(1, len(ws))]) AS g FROM listed WHERE len(ws) > 1),
p3 AS (SELECT lang, unnest([[ws[i], ws[i + 1], ws[i + 2]] FOR i IN range(1, len(ws) - 1)]) AS g FROM listed WHERE len(ws) > 2),
f2 AS (SELECT lang, g, count(*)::HUGEINT AS f FROM p2 GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, g, count(*)::HUGEINT AS f FROM p3 GROUP BY ALL HAVING count(*) >= 10),
above AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, g[1:2] AS g, f FROM f3 UNION ALL SELECT lang, g[2:3], f FROM f3) GROUP BY lang, g),
two AS (
  SELECT x.lang, x.g, x.f AS a, y.f AS l, z.f AS r, (1000000 * x.f * x.f) // (y.f * z.f) AS score
  FROM f2 x JOIN f1 y ON y.lang = x.lang AND y.g = x.g[1] JOIN f1 z ON z.lang = x.lang AND z.g = x.g[2]
  LEFT JOIN above b ON b.lang = x.lang AND b.g = x.g WHERE b.f IS NULL OR 100 * b.f < 50 * x.f),
cuts AS (
  SELECT x.lang, x.g, x.f AS a, 1 AS k, y.f AS l, z.f AS r FROM f3 x
  JOIN f1 y ON y.lang = x.lang AND y.g = x.g[1] JOIN f2 z ON z.lang = x.lang AND z.g = x.g[2:3]
  UNION ALL
  SELECT x.lang, x.g, x.f, 2, y.f, z.f FROM f3 x
  JOIN f2 y ON y.lang = x.lang AND y.g = x.g[1:2] JOIN f1 z ON z.lang = x.lang AND z.g = x.g[3]),
three AS (
  SELECT lang, g, a, l, r, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS q FROM (SELECT *, (1000000 * a * a) // (l * r) AS score FROM cuts)) WHERE q = 1),
both_ AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM (SELECT * FROM two UNION ALL SELECT * FROM three)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM both_)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
